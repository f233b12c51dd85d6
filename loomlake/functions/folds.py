"""Text rules composed of several steps, and ordered folds that no single function expresses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import strip


# What stands before the answer in a stored question with its answer, in this order.
ANSWERS = ["\n\n答：", "\n答：", "\n\n答:", "\n答:", "\n\nA:", "\nA:", "\n\nAnswer:", "\nAnswer:"]


def after_first(c: Column, separators: list[str]) -> Column:
    """What follows the first separator of the list that something follows, without white space at its ends; else the whole text, likewise."""
    rest = lambda s: F.nullif(strip(F.substr(c, F.locate(s, c) + F.lit(len(s)))), F.lit(""))
    return F.coalesce(*[F.when(c.contains(s), rest(s)) for s in separators], strip(c))


def fact_after(c: Column, triggers: list[str], n: int) -> Column:
    """n characters from the first trigger of the list that occurs."""
    return F.coalesce(*[F.when(c.contains(t), F.substr(c, F.locate(t, c), F.lit(n))) for t in triggers])


# Where the question of a prompt begins, polite beginnings, characters that may end a question, beginnings that mean the same, a word that may be left out.
QUESTION, POLITE, ENDING = "【问题】", ["请问", "我想知道", "麻烦问下"], "？?。.！!~～呢 "
SAME, DROPPED = {"如何": "怎么", "咋": "怎么"}, "企业"


def question_key(c: Column) -> Column:
    """One key for the ways to put a question: what follows the mark, without a polite beginning and the ending, one beginning for several, the word left out."""
    c = F.when(c.contains(QUESTION), F.substr(c, F.locate(QUESTION, c) + F.lit(len(QUESTION)))).otherwise(c)
    c = F.regexp_replace(strip(c), "^(?:" + "|".join(POLITE) + ")", "")
    c = F.regexp_replace(c, f"[{ENDING}]+$", "")
    begin = F.lit(None).cast("string")
    for word, by in reversed(SAME.items()):
        begin = F.when(c.startswith(word), F.concat(F.lit(by), F.substr(c, F.lit(len(word) + 1)))).otherwise(begin)
    return F.replace(F.coalesce(begin, c), F.lit(DROPPED), F.lit(""))


# Words that stand for what was said before, and words of a request that is whole.
HINTS = ["呢", "怎么样", "如何", "也是", "他", "她", "它", "这个", "那个", "上面", "刚才", "也是这样", "同样"]
VERBS = ["搜索", "查找", "查看", "创建", "上传", "提交", "列出", "search", "find", "view", "create", "upload", "list", "什么是", "为什么", "解释"]
MARKS = "？?！!，,。."


def needs_coreference(c: Column, hints: list[str] = HINTS, verbs: list[str] = VERBS) -> Column:
    """A short request (2 to 30 characters) that leans on what was said before."""
    any_of = lambda ws: reduce(lambda a, b: a | b, [c.contains(w) for w in ws])
    return F.length(strip(c)).between(2, 30) & any_of(hints) & ~any_of(verbs)


def completed(c: Column, topic: Column, entity: Column) -> Column:
    """A request that leans on the focus (topic, entity), completed: what it names, without the leaning words, before the topic; else as it is."""
    own = strip(c)
    for h in HINTS:
        own = F.replace(own, F.lit(h), F.lit(""))
    own = F.regexp_replace(own, f"^[{MARKS}]+|[{MARKS}]+$", "")
    lean = needs_coreference(c) & topic.isNotNull() & (own != "") & ~own.eqNullSafe(entity)
    return F.when(lean, F.concat(own, topic)).otherwise(c)


# Reasons by status, those that may be tried again, and words of messages that decide.
STATUS = {400: "format_error", 401: "auth_invalid", 402: "billing", 403: "auth_invalid", 404: "model_not_found", 408: "timeout", 422: "format_error", 500: "server_error", 502: "bad_gateway", 503: "service_unavailable", 504: "timeout", 529: "service_unavailable"}
AGAIN = [408, 500, 502, 503, 504, 529]
QUOTA = ["quota", "exhausted", "insufficient", "balance", "credit", "payment", "billing"]
MESSAGES = {
    "context_overflow": ["context_length", "context window", "maximum context", "context length", "too long"],
    "content_blocked": ["content_policy", "content policy", "safety", "content filter", "blocked by policy"],
    "model_not_found": ["model_not_found", "model not found", "does not exist", "invalid model", "unknown model"],
}


def error_class(code: Column, message: Column | None = None) -> Column:
    """(reason, retryable) of a failed call: what the message says first, then quota or limit of a 429, then the status; other statuses are unknown and not tried again."""
    said = F.lower(F.coalesce(message, F.lit("")) if message is not None else F.lit(""))
    said = F.when(F.length(said) <= 500, said).otherwise(F.concat(F.substring(said, 1, 250), F.lit("..."), F.right(said, F.lit(247))))
    any_of = lambda ws: reduce(lambda a, b: a | b, [said.contains(w) for w in ws])
    out = lambda reason, again: F.struct(F.lit(reason).alias("reason"), F.lit(again).alias("retryable"))
    c = F.when(any_of(MESSAGES["context_overflow"]), out("context_overflow", False))
    for reason in ("content_blocked", "model_not_found"):
        c = c.when(any_of(MESSAGES[reason]), out(reason, False))
    c = c.when((code == 429) & any_of(QUOTA), out("quota_exhausted", False)).when(code == 429, out("rate_limited", True))
    for status, reason in STATUS.items():
        c = c.when(code == status, out(reason, status in AGAIN))
    return c.otherwise(out("unknown", False))


def parse_time(c: Column) -> Column:
    """ISO text (also with Z) or epoch seconds; anything else is null."""
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_seconds(c.try_cast("double")))


def json_shape(c: Column) -> Column:
    keys = F.json_object_keys(c)
    has = lambda *ks: reduce(lambda a, b: a & b, [F.array_contains(keys, k) for k in ks])
    return F.when(has("messages"), "sft").when(has("prompt", "chosen", "rejected"), "dpo").when(has("query", "pos", "neg"), "embedding").when(has("golden"), "golden").otherwise("unknown")


# --- quality of parsing: what a parser gave against the standard text

# fixed values
TABLE = r"\|[^\n]+\|[\n\r]+\|[-\s|:]+\|[\n\r]+(?:\|[^\n]+\|[\n\r]+)+"
LATEX, MATH = r"\$([^\$]+)\$", r"[A-Za-z]+\s*[=≈≠<>≤≥]\s*[A-Za-z0-9+\-*/^()²³√]+"
SYMBOLS = ["∑", "∫", "∂", "π", "√", "∞", "±", "×", "÷", "≈", "≠", "≤", "≥", "²", "³", "α", "β", "γ", "θ", "λ", "μ", "Ω"]
SAME_SIGN = [(" ", ""), ("*", "×"), ("/", "÷"), (">=", "≥"), ("<=", "≤"), ("!=", "≠"), ("~=", "≈")]
LAYOUT = {"headings": r"(?is)<h[1-6][^>]*>.*?</h[1-6]>", "paragraphs": r"(?is)<p[^>]*>.*?</p>", "items": r"(?is)<li[^>]*>.*?</li>"}
MD_HEADING = r"(?m)^#{1,6}\s+.+$"
WEIGHTS = {"text": 0.4, "tables": 0.2, "formulas": 0.2, "layout": 0.2}


def tables(c: Column) -> Column:
    """Markdown tables, and runs of two or more lines with a bar or a tab (a table can be both)."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    run = lambda line: line.contains("|") | line.contains("\t")
    # what is no such line becomes a mark; runs are what stands between marks
    marked = F.array_join(F.transform(lines, lambda x: F.when(run(x), x).otherwise(F.lit("\x00"))), "\n")
    runs = F.filter(F.transform(F.split(marked, "\x00"), lambda x: F.regexp_replace(x, r"^\n+|\n+$", "")), lambda x: x.contains("\n"))
    return F.concat(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TABLE), 0), runs)


def cells(found: Column) -> Column:
    """Stripped cells of tables; empty ones and rules left out."""
    rows = F.filter(F.flatten(F.transform(found, lambda x: F.split(x, "\n"))), lambda x: x.contains("|"))
    every = F.flatten(F.transform(rows, lambda x: F.transform(F.split(x, r"\|"), lambda y: F.regexp_replace(y, r"^\s+|\s+$", ""))))
    return F.filter(every, lambda x: (x != "") & ~x.rlike(r"^[-:\s]+$"))


def formulas(c: Column) -> Column:
    """LaTeX, plain equations, and what surrounds mathematical signs; each once."""
    c = F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    around = [F.when(c.contains(s), F.regexp_extract_all(c, F.lit(f".{{0,20}}{s}.{{0,20}}"), 0)).otherwise(none) for s in SYMBOLS]  # a pattern that starts with anything is slow
    return F.filter(F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(LATEX), 1), F.regexp_extract_all(c, F.lit(MATH), 0), *around)), lambda x: x != "")


def same_signs(c: Column) -> Column:
    return reduce(lambda x, by: F.replace(x, F.lit(by[0]), F.lit(by[1])), SAME_SIGN, c)


def layout(c: Column) -> Column:
    """Headings, paragraphs (non-blank lines where the text has no tags) and list items."""
    n = {k: F.regexp_count(c, F.lit(p)) for k, p in LAYOUT.items()}
    lines = F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""))
    paragraphs = F.when((n["paragraphs"] == 0) & ~c.contains("<"), lines).otherwise(n["paragraphs"])
    return F.struct((n["headings"] + F.regexp_count(c, F.lit(MD_HEADING))).alias("headings"), paragraphs.cast("int").alias("paragraphs"), n["items"].alias("items"))


def distance(a: str, b: str) -> int:
    """Edit distance; a row of the matrix is one step on the bits of large integers (Myers), after what both begin and end with."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, len(a) - 1
    more, less, out = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        across = (((eq & more) + more) ^ more) | eq
        up, down = less | (mask & ~(across | more)), more & across
        out += (up >> last & 1) - (down >> last & 1)
        up, eq = (up << 1 | 1) & mask, eq | less
        more, less = (down << 1 & mask) | (mask & ~(eq | up)), up & eq
    return out


def parse_quality(df: DataFrame, standard: str, parsed: str) -> DataFrame:
    """df with text_score, table_score, formula_score, layout_score and overall (weighted) of the parsed text.

    Tables and formulas: mean of the count's share and of the share of the standard's cells or formulas that
    are found (text similarity over 0.9, 0.8 for formulas with like signs).  Layout: mean share of headings,
    paragraphs and items; what the standard lacks counts 1 if it is absent and half if not.
    """
    from .text import similarity

    ship(df.sparkSession)

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in zip(a, b)], dtype=float)

    whole = F.pandas_udf(alike, "double")
    share = lambda got, want: F.least(got, want) / want
    sizes = lambda a, b, least: F.abs(F.length(a) - F.length(b)) <= (1 - least) * F.greatest(F.length(a), F.length(b)) + 1e-9  # noqa: E731  else they cannot be alike
    like = lambda a, b, least: (a == b) | (sizes(a, b, least) & (similarity(a, b) > least))
    found = lambda want, got, least: F.size(F.filter(want, lambda a: F.array_contains(got, a) | F.exists(got, lambda b: like(a, b, least)))) / F.size(want)
    d = df.withColumns({"__ta": tables(F.col(standard)), "__tb": tables(F.col(parsed)), "__fa": formulas(F.col(standard)), "__fb": formulas(F.col(parsed)), "__la": layout(F.coalesce(standard, F.lit(""))), "__lb": layout(F.coalesce(parsed, F.lit("")))})
    d = d.withColumns({"__ca": cells(F.col("__ta")), "__cb": cells(F.col("__tb")), "__na": F.transform("__fa", same_signs), "__nb": F.transform("__fb", same_signs)})
    ta, tb, fa, fb = (F.size(c) for c in ("__ta", "__tb", "__fa", "__fb"))
    table_count = F.when(ta == 0, (tb == 0).cast("double")).otherwise(share(tb, ta))
    table_cells = F.when((ta == 0) | (F.size("__ca") == 0), F.lit(1.0)).otherwise(found(F.col("__ca"), F.col("__cb"), 0.9))
    formula = F.when(fa == 0, (fb == 0).cast("double")).otherwise((share(fb, fa) + found(F.col("__na"), F.col("__nb"), 0.8)) / 2)
    one = lambda k: F.when(F.col(f"__la.{k}") == 0, F.when(F.col(f"__lb.{k}") == 0, F.lit(1.0)).otherwise(F.lit(0.5))).otherwise(share(F.col(f"__lb.{k}"), F.col(f"__la.{k}")))
    scores = {
        "text_score": F.round(whole(F.coalesce(standard, F.lit("")), F.coalesce(parsed, F.lit(""))), 4),
        "table_score": F.round((table_count + table_cells) / 2, 4),
        "formula_score": F.round(formula, 4),
        "layout_score": F.round((one("headings") + one("paragraphs") + one("items")) / 3, 4),
    }
    d = d.withColumns(scores)
    overall = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(scores, WEIGHTS.values())])
    return d.select(*df.columns, *scores, F.round(overall, 4).alias("overall"))


_CJK = re.compile("[\u4e00-\u9fff]")


def score_tokens(text: str | None) -> list[str]:
    """Single characters where a text holds CJK characters, else words."""
    text = text or ""
    return [c for c in text if not c.isspace()] if _CJK.search(text) else text.split()


def bleu(out: list[str], ref: list[str], most: int = 4) -> float:
    """Add-one smoothed BLEU with a brevity penalty, over n-grams up to the shorter text's length."""
    grams = lambda x, n: Counter(zip(*(x[i:] for i in range(n))))
    orders = range(1, min(most, len(out), len(ref)) + 1)
    if not orders:
        return 0.0
    logs = [math.log(((grams(out, n) & grams(ref, n)).total() + 1) / (len(out) - n + 2)) for n in orders]
    return math.exp(min(0.0, 1 - len(ref) / len(out)) + sum(logs) / len(logs))


def rouge_l(out: list[str], ref: list[str]) -> float:
    """F1 of the longest common subsequence."""
    row = [0] * (len(ref) + 1)
    for x in out:
        diag = 0
        for j, y in enumerate(ref, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(out) + len(ref)) if row[-1] else 0.0


def keyword_overlap(out: list[str], ref: list[str]) -> float:
    """Share of the reference's distinct tokens that the text has."""
    return len(set(out) & set(ref)) / len(set(ref)) if ref else 0.0


def bleu_rouge(df: DataFrame, out: str, ref: str, key: str) -> DataFrame:
    ship(df.sparkSession)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pairs = [(score_tokens(a), score_tokens(b)) for a, b in zip(pdf["o"], pdf["r"])]
            yield pd.DataFrame({key: pdf["k"], **{name: [round(f(*p), 4) for p in pairs] for name, f in (("bleu", bleu), ("rouge_l", rouge_l), ("overlap", keyword_overlap))}})

    return df.select(F.col(key).alias("k"), F.col(out).alias("o"), F.col(ref).alias("r")).mapInPandas(score, f"{key} long, bleu double, rouge_l double, overlap double")


def reading_order(blocks: DataFrame, page: str, tolerance: float = 20.0, width: float = 400.0) -> DataFrame:
    """(page, text, position): full-width blocks cut a page into bands; within a band columns by their left edge, top to bottom."""
    ship(blocks.sparkSession)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (r.y0, r.x0, r.text))
        out, band = [], []

        def flush():
            lefts: list[float] = []
            for r in sorted(band, key=lambda r: r.x0):
                if not lefts or r.x0 - lefts[-1] > tolerance:
                    lefts.append(r.x0)
            col = lambda r: max(i for i, x in enumerate(lefts) if r.x0 >= x)
            out.extend(sorted(band, key=lambda r: (col(r), r.y0, r.text)))
            band.clear()

        for r in rows:
            if r.x1 - r.x0 >= width:
                flush()
                out.append(r)
            else:
                band.append(r)
        flush()
        return pd.DataFrame({"page": [r.page for r in out], "text": [r.text for r in out], "position": range(len(out))})

    return blocks.withColumnRenamed(page, "page").groupBy("page").applyInPandas(order, "page long, text string, position long")
