"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty.
Refinement: (1) byte length, which needs no hashing; lengths seen once leave.  (2) hash of the first
PREFIX characters; (length, prefix) pairs seen once leave.  (3) SHA-256 of the whole text, taken for
the survivors alone.  Of equal texts the row with the largest id stays; of rows that repeat that id,
one stays.  A null id is smaller than any other.  Texts of any length are read whole, by the JVM, a row at
a time.  An empty table gives an empty result; further columns of the input, whatever their names, do not
matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, lower_ascii

PREFIX = 64
#: Rows up to which a key table is broadcast (about 30 bytes a row); beyond, the join is shuffled.
BROADCAST_KEYS = 400_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, F.col(id_col).alias("__id"), text.alias("__text"), F.octet_length(text).alias("__len"),
                       F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX))).alias("__pre"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, prefix hash) pairs that more than one row has: the groups whose content must be read."""
    keyed = _keyed(docs, id_col, text_col, [])
    lens = keyed.groupBy("__len").count().where("count > 1").select("__len")
    lens = cut(lens, "lengths")
    pairs = keyed.select("__len", "__pre").join(bounded(lens, BROADCAST_KEYS), "__len", "left_semi")
    return cut(pairs.groupBy("__len", "__pre").count().where("count > 1").select("__len", "__pre", F.lit(True).alias("__hit")), "prefixes")


def hashed(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, keep: list[str], digest_all: bool = False) -> DataFrame:
    """keep columns, __id, __full (SHA-256 of the normalised text of rows that pairs names, else null) and, if asked, __sha of every row.

    The keys are joined first and the content is read after, of surviving rows alone; only where every
    row's digest is asked for is it taken before the join, so that digests move and not texts.
    """
    sha = F.sha2(lower_ascii(F.col("__text")), 256)
    keyed = _keyed(docs, id_col, text_col, keep)
    if digest_all:
        keyed, sha = keyed.withColumn("__sha", sha).drop("__text"), F.col("__sha")
    rows = keyed.join(bounded(pairs, BROADCAST_KEYS), ["__len", "__pre"], "left")
    return rows.select(*keep, "__id", F.when(F.col("__hit"), sha).alias("__full"), *([sha.alias("__sha")] if digest_all else []))


def groups(rows: DataFrame) -> DataFrame:
    """One row for each text that several rows have: __full, keep_id, group_size, __repeats (rows that share keep_id), __row (the one that stays).  Counted by (text, id) first, so a group of any size is combined before it moves."""
    one = rows.where("__full is not null").groupBy("__full", "__id").agg(F.count("*").alias("n"), F.min("__row").alias("r"))
    top = one.groupBy("__full").agg(F.max(F.struct("__id", "n", "r")).alias("t"), F.sum("n").alias("group_size"))
    return top.where("group_size > 1").select("__full", F.col("t.__id").alias("keep_id"), "group_size", F.col("t.n").alias("__repeats"), F.col("t.r").alias("__row"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = hashed(docs, survivors(docs, id_col, text_col), id_col, text_col, [], digest_all=True).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows, "hashed")
    found = cut(groups(rows), "groups")
    many = rows.where("__full is not null").join(bounded(found.withColumnRenamed("__row", "__top"), BROADCAST_KEYS // 4), "__full", "left")
    alone = rows.where("__full is null")
    out = [F.col("__id").alias(id_col)]
    return many.select(*out, F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("__id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                       F.coalesce(F.col("__row") == F.col("__top"), F.lit(True)).alias("kept"), F.col("__sha").alias("text_sha256")).unionByName(
        alone.select(*out, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    names = [f"__k{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    pairs = survivors(flat, i, t)
    found = cut(groups(hashed(flat, pairs, i, t, []).withColumn("__row", F.lit(0))), "groups")
    joined = hashed(flat, pairs, i, t, names).join(bounded(found.drop("group_size", "__row"), BROADCAST_KEYS // 4), "__full", "left")
    stay = joined.where(F.col("__repeats").isNull() | F.col("__id").eqNullSafe(F.col("keep_id")))
    if found.where("__repeats > 1").limit(1).count():
        stay = stay.where("coalesce(__repeats, 1) = 1").unionByName(stay.where("__repeats > 1").dropDuplicates(["__full"]))
    return stay.select(*names).toDF(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
