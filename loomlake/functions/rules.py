"""Rule sets over text: injection patterns, intents, triples, high-risk spans, drift and coreference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, ngrams, strip

# Pattern families with their severity (low 1, medium 2, high 3), in an RE2-compatible dialect.
INJECTIONS = [
    ("instruction_hijack", 3, [r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|prompts?|rules?)", r"(?i)disregard\s+(?:all\s+)?(?:prior|previous|above)\s+(?:instructions?|prompts?|rules?)", r"(?i)forget\s+(?:everything|all\s+(?:previous|prior))", r"忽略(?:之前|前面|上面|先前)(?:所有|的)*(?:指令|提示|规则|内容)", r"无视(?:之前|前面|上面|先前)(?:所有|的)*(?:指令|提示|规则)", r"忘记(?:之前|前面|上面|先前)(?:所有|的)*(?:指令|内容)", r"从现在起(?:你|AI)?(?:是|扮演)", r"(?i)new\s+instructions?\s*[:：]\s*"]),
    ("jailbreak", 3, [r"(?i)\bDAN\b\s*(?:mode|prompt)?", r"(?i)developer\s+mode", r"(?i)jailbreak\s+(?:mode|prompt)?", r"(?:假装|假定|现在)(?:你是|AI是|你处于)(?:一个)?没有(?:限制|约束)", r"(?:现在|从现在起)(?:你)?(?:不受|没有)(?:任何)?(?:限制|约束)", r"(?i)do\s+anything\s+now", r"(?:进入|启用)(?:开发者|开发|越狱)模式"]),
    ("data_exfiltration", 3, [r"(?i)(?:print|show|reveal|display)\s+(?:your|the)\s+(?:system\s+)?prompt", r"(?i)what\s+(?:is|are)\s+your\s+(?:system|initial)\s+(?:prompt|instructions?)", r"(?:输出|显示|打印|泄露)(?:你的)?(?:系统|初始)?(?:提示词?|指令|配置|prompt)", r"列出(?:所有|全部)?(?:可见|能访问|能看到的)?文档", r"(?i)(?:列出|show\s+me)\s+(?:all\s+)?(?:documents?|files?|knowledge)", r"(?i)(?:泄露|exfiltrate|export)\s+(?:all\s+)?(?:data|content)"]),
    ("role_override", 2, [r"(?im)^\s*system\s*[:：]", r"(?im)^\s*assistant\s*[:：]", r"(?i)\[\s*system\s*\]", r"(?i)\[\s*assistant\s*\]", r"(?i)<\|system\|>", r"(?i)<\|assistant\|>", r"(?i)<\|im_start\|>", r"(?i)<\|im_end\|>", r"(?i)#\s*system\s*[:：]"]),
    ("tool_abuse", 2, [r"(?i)(?:call|invoke|execute|run)\s+(?:tool\s+)?(?:document_create|create_it_ticket|delete_)", r"(?:调用|执行|使用)(?:工具|函数)?[:：]?\s*(?:document_create|create_it_ticket|delete_)", r"(?i)execute\s+(?:command|shell|bash)\s*[:：]", r"(?:执行|运行)(?:命令|shell|脚本)\s*[:：]", r"(?i)please\s+(?:create|delete|update)\s+(?:a\s+)?(?:document|ticket|expense)", r"(?:请|现在)(?:帮我|直接)?(?:创建|删除|修改|提交)(?:文档|工单|报销单)"]),
    ("delimiter_injection", 1, [r"(?i)```\s*(?:system|assistant|user)\s*```", r"(?i)---\s*(?:system|assistant)\s*---", r"(?i)<<\s*(?:SYSTEM|ASSISTANT)\s*>>", r"(?i)===+\s*(?:system|assistant)\s*===+"]),
]
#: Relation patterns with two groups, and the relation each stands for.
TRIPLES = [
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})属于([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "属于"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})包[含括]([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "包含"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})引[用考]([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "引用"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})[替取]代([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "替代"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})依赖([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "依赖"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})基于([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "基于"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,15})是一?[种个项类]?([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})", "属于"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})[使采]用([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "使用"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})定义了?([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "定义"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})管理([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "管理"),
    (r"([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,20})实现了?([\x{4e00}-\x{9fa5}A-Za-z0-9_]{2,30})", "实现"),
]
#: Words that are no entity.
NO_ENTITY = ["我们", "你们", "他们", "她们", "它们", "这个", "那个", "这些", "那些", "什么", "怎么", "为什么", "因为", "所以", "但是", "不过", "而且", "可以", "不能", "能够", "应该", "需要", "必须", "如果", "虽然", "一个", "一种", "一些", "这项", "该", "此", "其", "本", "本文", "本文档", "该文档", "该系统", "该功能"]
#: Legal terms and currency units.
LEGAL = ["合同", "协议", "条款", "法律", "法规", "权利", "义务", "违约", "赔偿", "解除", "终止", "生效", "失效", "甲方", "乙方", "知识产权", "保密", "竞业"]
AMOUNT = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(?:元|万元|亿元|美元|欧元|人民币|港币|日元|英镑|USD|EUR|CNY|RMB|JPY|GBP|HKD)"
DATE = r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?|\d{1,2}/\d{1,2}/\d{4}"


def injection_hits(c: Column, families=INJECTIONS) -> Column:
    """Ids and severities of the families of which a pattern matches."""
    found = [F.when(reduce(lambda a, b: a | b, [c.rlike(p) for p in ps]), F.struct(F.lit(n).alias("id"), F.lit(s).alias("severity"))) for n, s, ps in families]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def quarantined(c: Column, least: int = 2) -> Column:
    return F.exists(injection_hits(c), lambda h: h["severity"] >= least)


def is_entity(c: Column) -> Column:
    return ~c.isin(NO_ENTITY) & F.length(c).between(2, 30) & ~c.rlike("^[0-9]+$")


def _triple(predicate: str):
    return lambda a, b: F.struct(F.trim(a).alias("subject"), F.lit(predicate).alias("predicate"), F.trim(b).alias("object"))


def triples(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep…, subject, predicate, object) for every match of a relation pattern with valid ends."""
    arrays = []
    for pattern, predicate in TRIPLES:
        s, o = (F.regexp_extract_all(F.col(text), F.lit(pattern), g) for g in (1, 2))
        arrays.append(F.zip_with(s, o, _triple(predicate)))
    rows = df.select(*keep, F.explode(F.concat(*arrays)).alias("t")).select(*keep, "t.*")
    return rows.where(is_entity(F.col("subject")) & is_entity(F.col("object")))


def high_risk(c: Column) -> dict[str, Column]:
    """How many amounts, dates and legal terms a text names."""
    legal = reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(w)) for w in LEGAL])
    return {"amounts": F.regexp_count(c, F.lit(AMOUNT)), "dates": F.regexp_count(c, F.lit(DATE)), "legal_terms": legal}


def amount_risk(said: Column, sources: Column) -> Column:
    """Risk of an amount by its smallest relative deviation from the sources' amounts: under 1% low, to 10% medium, else high."""
    dev = F.array_min(F.transform(F.filter(sources, lambda s: s != 0), lambda s: F.abs(said - s) / F.abs(s)))
    return F.when(dev.isNull() | (dev > 0.10), "high").when(dev >= 0.01, "medium").otherwise("low")


# Intents in order, with their confidence, whether they take the short way, and their patterns.
INTENTS = [
    ("unsupported", 0.9, True, [r"(?i)(订|买|抢|退).*(机票|火车票|高铁票|酒店|宾馆|外卖|门票|演唱会)", r"(?i)(今天|明天|后天|周末|下周).*(天气|气温|降雨|台风|空气质量)", r"(?i)(推荐|预测|帮我选|买哪只|买什么|该买).*(股票|基金|股价|行情)", r"(?i)(讲个笑话|讲个故事|写一首诗|写作文|编个故事|闲聊|聊聊)"]),
    ("list_documents", 0.9, True, [r"(?i)(列出|列表|有哪些|显示一下|看一下列表).*(文档|知识库|文件|资料)", r"(?i)(list|show|all)\s+(documents?|knowledge|files?)", r"(?i)(我的|所有).*(文档|知识库)"]),
    ("rag_search", 0.85, True, [r"(?i)(搜索一下|搜一下|查找一下|查一下|找一下|帮我查|搜索|查找|查询|检索)(.+)", r"(?i)(search|find|query|look\s+for)\s+(.+)", r".*(是什么|怎么|如何|为什么|什么是|区别|对比|优缺点)", r".*(流程|步骤|方法|规范|要求).*(是|有)"]),
    ("get_document", 0.85, True, [r"(?i)(查看|打开|看看|详情|阅读)(.+)", r"(?i)(view|open|detail|read)\s+(.+)"]),
    ("create_document", 0.9, False, [r"(?i)(创建|上传|添加|新建|导入).*(文档|文件|知识|资料)", r"(?i)(create|upload|add|new|import)\s+(document|file|knowledge)"]),
]
#: Patterns with a second group, which is what a search or a look-up is for.
ASKS = {"rag_search": [0, 1, 3], "get_document": [0, 1]}


def intent(c: Column) -> Column:
    """(intent, parameter, confidence, shortcut) of the first pattern that a request matches, null for none.

    A search's parameter is the pattern's second group if it is longer than a character, else the whole request; a
    look-up's is the second group.
    """
    said = strip(c)
    kind = "struct<intent:string,parameter:string,confidence:double,shortcut:boolean>"
    out = F.lit(None).cast(kind)
    for name, confidence, shortcut, patterns in reversed(INTENTS):
        for i, pattern in reversed(list(enumerate(patterns))):
            asked = strip(F.regexp_extract(said, pattern, 2)) if i in ASKS.get(name, []) else F.lit("")
            parameter = F.when(F.length(asked) > 1, asked).otherwise(said) if name == "rag_search" else asked if name == "get_document" else F.lit(None).cast("string")
            out = F.when(said.rlike(pattern), F.struct(F.lit(name).alias("intent"), parameter.alias("parameter"), F.lit(confidence).alias("confidence"), F.lit(shortcut).alias("shortcut"))).otherwise(out)
    return out


# --- skill tokens, preferences, facts

# fixed values: words that say nothing of a skill
STOP_CN = [
    "的", "了", "在", "是", "我", "你", "他", "她", "它", "们", "和", "与", "或", "及", "等", "把", "被", "让", "给", "向", "这", "那", "些", "个", "中", "上", "下", "里", "外", "前", "后", "对", "于", "从", "到",
    "要", "会", "能", "可", "以", "有", "无", "不", "没", "都", "也", "还", "又", "再", "就", "一", "二", "三", "请", "帮", "帮我", "一下", "需要", "想要",
]
STOP_EN = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "can", "need", "want", "please", "help", "me", "i", "you", "he", "she", "it", "we", "they", "this", "that", "these", "those", "and", "or", "but", "not", "for", "with",
    "about", "to", "of", "in", "on", "at", "by", "from", "as", "into",
]
# fixed values: what asks for another style, in order
PREFERENCES = {
    "concise": ["简单点", "太长了", "简洁", "简短", "精简", "少说"],
    "detailed": ["详细点", "展开", "具体", "详尽", "多说", "详细说明"],
    "en": ["用英文", "in english", "answer in english", "用英语"],
    "zh": ["用中文", "用汉语", "answer in chinese"],
    "no_code": ["不要代码", "别给代码", "不用代码"],
    "with_code": ["给代码", "要代码", "带代码", "show code"],
}
PREFERENCE_TYPES = {"concise": "concise", "detailed": "detailed", "en": "language", "zh": "language", "no_code": "code", "with_code": "code"}
# fixed values: what opens a fact
FACT_TRIGGERS = ["我喜欢", "我偏好", "请用", "请使用", "我希望"]


def skill_terms(c: Column) -> Column:
    """English words of two letters and more, then pairs, triples and single CJK characters, stop words left out; repeats stay."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z][a-zA-Z0-9_]*"), 0), F.lower)
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_EN))
    cjk = F.array_join(F.regexp_extract_all(c, F.lit(r"[\x{4E00}-\x{9FFF}]"), 0), "")
    grams = [F.filter(ngrams(cjk, n), lambda g: ~g.isin(STOP_CN)) for n in (2, 3, 1)]
    return F.concat(words, *grams)


def preference(c: Column, current: dict[str, Column] | None = None) -> Column:
    """The first style asked for that is not the current one of its type (current: type to column), else null."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for value, marks in reversed(PREFERENCES.items()):
        hit = any_of(low, marks)
        if current and PREFERENCE_TYPES[value] in current:
            hit = hit & ~F.coalesce(current[PREFERENCE_TYPES[value]] == value, F.lit(False))
        out = F.when(hit, value).otherwise(out)
    return out
