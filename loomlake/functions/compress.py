"""Compression of message lists: labels of single messages, head, summary and tail, and how many key entities remain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, tokens_by_script

# Marks of messages, the words of their labels, the head of a summary.
FOUND, TOOL, REPEAT, STATE = "[系统] 已检索到", "[系统] 工具结果：", "↑ [见第", "当前状态"
SUMMARY, TRAIL, JOINT = "[系统] 早期上下文摘要：", "推理轨迹:", "；"
LABEL, NOTES, HEAD = 80, 200, 2
# Four kinds of key entities.
NUMBERS = r"\d+(?:\.\d+)?\s*(?:%|％|元|万元|亿元|万|亿|天|个工作日|小时|次|条|篇|人|份)|\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?|\d+\.\d+\.\d+|第?\d+(?:号|条|款|章|节)"
QUOTED = '《[^》]{2,30}》|“[^”]{2,30}”|"[^"]{2,30}"'
NAMES = r"\b[A-Z][A-Z0-9_-]{1,15}\b|\b[A-Za-z]+-[A-Za-z0-9]+\b"
SUFFIXES = ["流程", "制度", "政策", "规定", "规范", "标准", "方案", "报告", "部门", "系统", "平台", "项目", "预算", "费用", "发票", "合同", "权限", "密码", "账号", "指标", "模型", "接口", "数据库", "服务器"]
TERMS = r"[\x{4e00}-\x{9fff}]{2,10}?(?:" + "|".join(SUFFIXES) + ")"
#: Share of entities that a compression must keep.
KEPT = 0.90


def label(c: Column) -> Column:
    """A message in a few words: how much was retrieved, what it repeats, a tool's result, a round, else its first LABEL characters."""
    n, round_ = F.regexp_extract(c, r"已检索到\s*(\d+)\s*篇", 1), F.regexp_extract(c, r"迭代\s*(\d+)", 1)
    seen, what = (F.regexp_extract(c, r"见第(\d+)轮\s*(\S+)", g) for g in (1, 2))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(c.contains(FOUND), F.when(n != "", F.concat(F.lit("检索"), n, F.lit("篇"))).otherwise("检索文档"))
        .when(c.contains(REPEAT), F.when(seen != "", F.concat(F.lit("重复结果(见"), seen, F.lit("轮"), what, F.lit(")"))).otherwise("重复结果"))
        .when(c.contains(TOOL), F.concat(F.lit("工具:"), F.substring(strip(F.replace(c, F.lit(TOOL), F.lit(""))), 1, LABEL)))
        .when(c.contains(STATE), F.when(round_ != "", F.concat(F.lit("第"), round_, F.lit("轮决策"))).otherwise("决策上下文"))
        .otherwise(F.substring(c, 1, LABEL))
    )


def tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda s, m: s + tokens_by_script(F.coalesce(m["content"], F.lit(""))).cast("long"))


def compress(messages: Column, recent: int = 2, notes: Column | None = None) -> Column:
    """messages (array of role, content): the first two, one summary of the labels of the others and the end of the notes, the last `recent`; as they are where there is nothing between."""
    n = F.size(messages)
    said = F.filter(F.transform(F.slice(messages, HEAD + 1, F.greatest(n - HEAD - recent, F.lit(0))), lambda m: label(m["content"])), lambda x: x != "")
    if notes is not None:
        said = F.concat(said, F.when(F.length(notes) > 0, F.array(F.concat(F.lit(TRAIL), F.substr(notes, F.greatest(F.length(notes) - NOTES + 1, F.lit(1)))))).otherwise(F.array().cast("array<string>")))
    summary = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(SUMMARY), F.array_join(said, JOINT)).alias("content")))
    ends = F.slice(messages, 1, HEAD), F.slice(messages, F.greatest(n - recent + 1, F.lit(1)), recent)
    return F.when(n <= HEAD + recent, messages).when(F.size(said) == 0, F.concat(*ends)).otherwise(F.concat(ends[0], summary, ends[1]))


def within_budget(messages: Column, most: int, recent: int = 2, notes: Column | None = None) -> Column:
    """Compressed only where the messages hold more tokens than that and there is something between head and tail."""
    return F.when((F.size(messages) > HEAD + recent) & (tokens(messages) > most), compress(messages, recent, notes)).otherwise(messages)


def entities(c: Column) -> Column:
    """Distinct key entities of a text, of two characters at least: numbers with a unit, quoted terms, names, and words with one of the suffixes."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (NUMBERS, QUOTED, NAMES, TERMS)])
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: F.length(x) >= 2))


def retention(before: Column, after: Column) -> tuple[Column, Column]:
    """(entities in the messages before, those that the messages after still hold); system messages do not count."""
    text = lambda ms: F.array_join(F.transform(F.filter(ms, lambda m: m["role"] != "system"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    had = entities(text(before))
    return F.size(had), F.size(F.filter(had, lambda x: F.contains(text(after), x)))
