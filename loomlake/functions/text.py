"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: look-up lists and patterns of the knowledge-base rules.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}]"
REFUSALS = ["拒绝", "无权", "无法提供", "不能提供", "无法访问", "未授权", "没有权限", "禁止", "不被允许", "无法执行", "不会执行", "不予提供", "无法回答", "不能回答"]
VAGUE = ["这个", "那个", "怎么办", "怎么处理", "怎么弄", "如何办", "咋办", "啥"]
MULTI_STRONG = ["以及", "同时", "还要", "另外", "然后", "并且", "；", ";"]
MULTI_WEAK = ["和", "与", "并", "再"]
PHONE, IDCARD, EMAIL, BANKCARD = r"(?<!\d)1[3-9]\d{9}(?!\d)", r"(?<![0-9A-Za-z])\d{17}[\dXx](?![0-9A-Za-z])", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?<!\d)\d{16,19}(?!\d)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def length_reason(c: Column, least: int = 10, most: int = 8000) -> Column:
    n = F.length(strip(c))
    return F.when(n < least, "too_short").when(n > most, "too_long")


def golden_bucket(c: Column, n: int = 10) -> Column:
    """SHA-256 of the stripped text mod 10 without big integers: 16^k is 6 mod 10 for k >= 1."""
    assert n == 10
    # 15 digits at a time fit a long; the hash is bound to a variable, so that it is made once a text
    piece = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long") % 10
    mod = lambda h: (6 * (piece(h, 1, 15) + piece(h, 16, 15) + piece(h, 31, 15) + piece(h, 46, 15)) + piece(h, 61, 4)) % 10
    return F.get(F.transform(F.array(F.sha2(strip(c), 256)), mod), F.lit(0)).cast("int")


def tokens_by_length(c: Column) -> Column:
    """ceil(length / 3.5), at least 1; empty text has none."""
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 3.5))).cast("long")


def tokens_by_script(c: Column) -> Column:
    """CJK characters count 1/1.5 and others 1/4, cut to a whole number."""
    n = F.regexp_count(c, F.lit(CJK))
    return F.floor(n / 1.5 + (F.length(c) - n) / 4.0).cast("long")


def normalise_query(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def chunk_hash(content: Column, title: Column, kind: Column) -> Column:
    return F.sha2(F.concat(content, F.lit("\u0000"), title, F.lit("\u0000"), kind), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) from SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def mask_pii(c: Column) -> Column:
    """Identity cards before bank cards (18 of 16 to 19 digits), then phones, then mail addresses."""
    for pattern, mark in ((IDCARD, "[IDCARD]"), (BANKCARD, "[BANKCARD]"), (PHONE, "[PHONE]"), (EMAIL, "[EMAIL]")):
        c = F.regexp_replace(c, pattern, mark)
    return c


def pii_counts(c: Column) -> dict[str, Column]:
    """Hits by kind, each counted on what the kinds before it leave."""
    out = {}
    for name, pattern, mark in (("idcard", IDCARD, "[IDCARD]"), ("bankcard", BANKCARD, "[BANKCARD]"), ("phone", PHONE, "[PHONE]"), ("email", EMAIL, "[EMAIL]")):
        out[name] = F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, mark)
    return out


def citations(c: Column) -> Column:
    """Citation numbers in first-seen order, square or full-width brackets, 1 to 3 digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[\[【](\d{1,3})[\]】]"), 1), lambda x: x.cast("int")))


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def count_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def query_type(c: Column) -> Column:
    weak = count_of(c, MULTI_WEAK)
    multi = any_of(c, MULTI_STRONG) | (F.regexp_count(c, F.lit("[?？]")) >= 2) | (weak >= 2) | ((weak >= 1) & (F.length(c) >= 12))
    return F.when(any_of(c, VAGUE), "vague").when(multi, "multi").otherwise("single")


def word_set(c: Column) -> Column:
    """Lower-case runs of ASCII letters and single CJK characters, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+|[\x{4E00}-\x{9FFF}]"), 0))


def units(c: Column) -> Column:
    """Paragraphs, or sentences where there is only one; stripped of ASCII white space, none empty."""
    blank = r"[ \t\n\f\r\x0B]"
    cut = lambda pattern: F.filter(F.transform(F.split(c, pattern), lambda u: F.regexp_replace(u, f"^{blank}+|{blank}+$", "")), lambda u: u != "")
    paragraphs = cut(rf"\n{blank}*\n")
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(cut(rf"(?<=[。！？.!?]){blank}*"))


def mixed_tokens(c: Column) -> Column:
    """ASCII words, CJK characters, and pairs of CJK characters that follow each other in their sequence."""
    low = F.lower(c)
    cjk = F.regexp_extract_all(low, F.lit(r"[\x{2E80}-\x{9FFF}]"), 0)
    pairs = F.when(F.size(cjk) > 1, F.zip_with(F.slice(cjk, F.lit(1), F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, F.lit(2), F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0), cjk, pairs))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are alike."""
    n = F.greatest(F.length(a), F.length(b))
    return F.round(F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n), 4)


def token_jaccard(a: Column, b: Column) -> Column:
    from .maths import jaccard

    cut = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), 0))
    return jaccard(cut(a), cut(b))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?。！？\n]+"), strip), lambda s: s != "")


def ngrams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def json_score(c: Column) -> Column:
    """Score of a model's reply: JSON field `score`, fenced or not, else the first number (over 1: a percentage), within 0 and 1."""
    body = F.coalesce(F.nullif(F.regexp_extract(c, r"```(?:json)?\s*(\{[^`]*\})\s*```", 1), F.lit("")), c)
    number = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    got = F.coalesce(F.get_json_object(body, "$.score").try_cast("double"), F.when(number > 1, number / 100).otherwise(number))
    return F.when(got.isNotNull(), F.least(F.greatest(got, F.lit(0.0)), F.lit(1.0)))
