"""Records of open datasets by shape, read as variants: rankings, reading questions, instructions and preferences become embedding, SFT and DPO rows.

Fields may be strings, lists or objects from record to record; what does not give a whole row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def _string(x: Column) -> Column:
    """A variant's text without white space at its ends; null where it is no string or blank."""
    return F.nullif(F.when(F.schema_of_variant(x) == "STRING", strip(F.try_variant_get(x, "$", "string"))), F.lit(""))


def text_at(v: Column, path: str) -> Column:
    return _string(F.try_variant_get(v, path, "variant"))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _first(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda x: x.isNotNull()), F.lit(0))


def first_text(v: Column, path: str) -> Column:
    """A string, or the first string of a list that is not blank."""
    return F.coalesce(text_at(v, path), _first(F.transform(_list(v, path), _string)))


def first_answer(v: Column, path: str) -> Column:
    """The first text of a list of strings or of objects with a text, or of an object whose text is a string or a list."""
    each = F.transform(_list(v, path), lambda x: F.coalesce(_string(x), _string(F.try_variant_get(x, "$.text", "variant"))))
    return F.coalesce(_first(each), first_text(v, f"{path}.text"))


def converted(records: DataFrame, raw: str = "raw", shape: str = "shape") -> DataFrame:
    """records with kind and the columns of a row: query, pos, neg (embedding), question, answer (sft), prompt, chosen, rejected (dpo).

    shape: ranking (query, positive, negative), reading (question, answers), instruction (instruction, input, output) or
    preference (question, response_chosen, response_rejected).  Records that are no JSON or lack a part are dropped, and
    preferences whose two answers are the same.
    """
    v = records.withColumn("__v", F.try_parse_json(raw))
    of = F.col("__v")
    more = text_at(of, "$.input")
    asked = F.when(F.col(shape) == "reading", text_at(of, "$.question")).when(F.col(shape) == "instruction", F.concat(text_at(of, "$.instruction"), F.coalesce(F.concat(F.lit("\n\n"), more), F.lit(""))))
    answer = F.when(F.col(shape) == "reading", first_answer(of, "$.answers")).when(F.col(shape) == "instruction", text_at(of, "$.output"))
    only = lambda s, c: F.when(F.col(shape) == s, c)
    out = v.select(
        *records.columns, F.when(F.col(shape) == "ranking", "embedding").when(F.col(shape).isin("reading", "instruction"), "sft").when(F.col(shape) == "preference", "dpo").alias("kind"),
        only("ranking", text_at(of, "$.query")).alias("query"), only("ranking", first_text(of, "$.positive")).alias("pos"), only("ranking", first_text(of, "$.negative")).alias("neg"), asked.alias("question"), answer.alias("answer"),
        only("preference", text_at(of, "$.question")).alias("prompt"), only("preference", text_at(of, "$.response_chosen")).alias("chosen"), only("preference", text_at(of, "$.response_rejected")).alias("rejected"),
    )
    whole = (F.col("kind") == "embedding") & F.col("query").isNotNull() & F.col("pos").isNotNull() & F.col("neg").isNotNull()
    whole |= (F.col("kind") == "sft") & F.col("question").isNotNull() & F.col("answer").isNotNull()
    whole |= (F.col("kind") == "dpo") & F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & (F.col("chosen") != F.col("rejected"))
    return out.where(whole)
