"""Text rules worked by hand: spans and their verification, compression, intents, grouping, coreference, errors, heuristic scores."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import compress as M
from loomlake.functions import folds, maths, rules
from loomlake.functions import spans as S

LIT = lambda x: F.lit(x).cast("string")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_spans_with_offsets(spark):
    text = "合同金额1,000.5 万元（2024年1月3日），另付 20usd；合同违约"
    got = [(x.type, x.value, x.start, x.end) for x in one(spark, S.high_risk_spans(F.lit(text)))]
    at = lambda v, a=0: (v, text.index(v, a), text.index(v, a) + len(v))
    want = [("amount", *at("1,000.5 万元")), ("amount", *at("20usd")), ("date", *at("2024年1月3日")), ("legal_term", *at("合同")), ("legal_term", *at("合同", 5)), ("legal_term", *at("违约"))]
    assert sorted(got) == sorted(want)
    assert all(text[a:b] == v for _, v, a, b in got)
    assert one(spark, S.high_risk_spans(F.lit(""))) == []


def judge(spark, answer, sources):
    items = S.verified_spans(S.high_risk_spans(F.lit(answer)), F.array(*map(LIT, sources)).cast("array<string>"))
    r = spark.range(1).select(items.alias("i"), S.risk_action(items).alias("a")).first()
    return [(x.value, x.verified, x.level, x.deviation and round(x.deviation, 4)) for x in r.i], r.a


def test_verification_and_action(spark):
    assert judge(spark, "nothing here", ["x"]) == ([], "pass")
    assert judge(spark, "5万元", []) == ([("5万元", False, None, None)], "warn")
    assert judge(spark, "5万元", ["", None]) == ([("5万元", False, None, None)], "warn")
    assert judge(spark, "50,000 元", ["共 50000元"]) == ([("50,000 元", True, None, None)], "pass")
    assert judge(spark, "5.0万元", ["5 万元"]) == ([("5.0万元", True, None, None)], "pass")
    assert judge(spark, "1005元", ["1000 元"]) == ([("1005元", False, "low", 0.005)], "warn")
    assert judge(spark, "105元", ["100 元", "1元"]) == ([("105元", False, "medium", 0.05)], "confirm")
    assert judge(spark, "150元", ["100 元"]) == ([("150元", False, "high", 0.5)], "block")
    assert judge(spark, "150元", ["100 万元"]) == ([("150元", False, "high", None)], "block")
    assert judge(spark, "150元", ["0元"]) == ([("150元", False, "high", 1.0)], "block")
    assert judge(spark, "2024-01-02 违约", ["合同"]) == ([("2024-01-02", False, "low", None), ("违约", False, "low", None)], "warn")


def test_labels_and_folding(spark):
    says = {
        "": "", "[系统] 已检索到 12 篇文档": "检索12篇", "[系统] 已检索到": "检索文档", "[系统] 工具结果：↑ [见第3轮 kb]": "重复结果(见3轮kb])", "↑ [见第": "重复结果",
        "[系统] 工具结果： abc ": "工具:abc", "当前状态：迭代 4": "第4轮决策", "当前状态": "决策上下文", "y" * 90: "y" * 80,
    }
    assert {k: one(spark, M.label(F.lit(k))) for k in says} == says
    ms = lambda texts: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in texts])
    talk = [("system", "s"), ("user", "q"), ("assistant", "[系统] 已检索到 3 篇"), ("user", ""), ("assistant", "a"), ("user", "b")]
    out = [tuple(m) for m in one(spark, M.compress(ms(talk), 2, F.lit("n" * 300)))]
    assert out == [*talk[:2], ("user", "[系统] 早期上下文摘要：检索3篇；推理轨迹:" + "n" * 200), *talk[4:]]
    assert len(one(spark, M.compress(ms(talk[:4]), 2))) == 4
    empty = [*talk[:2], ("user", ""), *talk[4:]]
    assert [tuple(m) for m in one(spark, M.compress(ms(empty), 2))] == [*talk[:2], *talk[4:]]
    assert len(one(spark, M.within_budget(ms(talk), 10**6))) == 6 and len(one(spark, M.within_budget(ms(talk), 1))) == 5
    before, after = ms([("system", "ABC"), ("user", "3.5万元 《差旅制度》 GPT-4 1.2.3")]), ms([("user", "《差旅制度》 GPT-4")])
    total, kept = M.retention(before, after)
    assert (one(spark, total), one(spark, kept)) == (5, 3)


def test_intents_in_order(spark):
    ask = lambda q: one(spark, rules.intent(F.lit(q)))
    assert ask("  ") is None and ask("hello") is None
    assert ask("帮我订一张去上海的机票，查询流程")[:2] == ("unsupported", None)
    assert ask("搜索一下 报销制度 ")[:2] == ("rag_search", "报销制度")
    assert ask("报销流程要求是")[:2] == ("rag_search", "报销流程要求是")
    assert ask("look for the handbook")[:2] == ("rag_search", "the handbook")
    assert tuple(ask("view x")) == ("get_document", "x", 0.85, True)
    assert tuple(ask("new document")) == ("create_document", None, 0.9, False)


def test_question_keys_coreference_answers(spark):
    key = lambda q: one(spark, folds.question_key(F.lit(q)))
    assert {key(q) for q in ("请问如何报销企业费用呢？", "我想知道咋报销费用", "文\n【问题】怎么报销费用？")} == {"怎么报销费用"}
    full = lambda q, t, e: one(spark, folds.completed(F.lit(q), LIT(t), LIT(e)))
    assert full("上海呢？", "限号政策", "北京") == "上海限号政策"
    assert full("北京呢？", "限号政策", "北京") == "北京呢？" and full("搜索这个", "限号政策", "北京") == "搜索这个" and full("上海呢", None, None) == "上海呢"
    answer = lambda c: one(spark, folds.after_first(F.lit(c), folds.ANSWERS))
    assert answer("问：X\n\n答：Y ") == "Y" and answer("Q: X\nA: Y") == "Y" and answer("Q: X\nA: \nAnswer: Z") == "Answer: Z" and answer(" plain ") == "plain"


def test_error_reasons(spark):
    of = lambda code, m=None: tuple(one(spark, folds.error_class(F.lit(code), LIT(m))))
    assert of(429) == ("rate_limited", True) and of(429, "Quota exceeded") == ("quota_exhausted", False)
    assert of(408) == ("timeout", True) and of(529) == ("service_unavailable", True) and of(418) == ("unknown", False) and of(404) == ("model_not_found", False)
    assert of(500, "maximum context length") == ("context_overflow", False) and of(400, "content_policy violation") == ("content_blocked", False)


def test_heuristic_scores(spark):
    ctx = F.array(F.lit("alpha beta"), F.lit("gamma delta"))
    assert one(spark, maths.supported(F.lit("alpha beta。zeta eta。gamma x"), ctx, 0.0)) == 1 / 3
    assert one(spark, maths.supported(F.lit(""), ctx, 1.0)) == 1.0
    assert one(spark, maths.graded_precision(F.lit("gamma delta"), ctx)) == pytest.approx(0.6309297535714575)
    assert one(spark, maths.graded_precision(F.lit(""), ctx)) == 1.0 and one(spark, maths.graded_precision(F.lit("omega"), ctx)) == 0.0
