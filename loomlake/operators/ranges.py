"""Range joins and splits by running size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, bin: int) -> DataFrame:
    """Points with the spans that contain them, both ends included: an equi-join on bins of a fixed width, then the exact test."""
    p = points.withColumn("__bin", F.floor(F.col(at) / bin).cast("long"))
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / bin).cast("long"), F.floor(F.col(hi) / bin).cast("long"))))
    return p.join(s, "__bin").where(F.col(at).between(F.col(lo), F.col(hi))).drop("__bin")


def grouped_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """Whole groups go to the test side, in the order of a hash of the key, until it holds the share.  The running sum is over one row per group, by partial sums of hash ranges first."""
    n = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("h", F.md5(key))
    part = n.withColumn("p", F.substring("h", 1, 2))
    sums = part.groupBy("p").agg(F.sum("n").alias("s"))  # at most 256 rows
    sums = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("own", own).join(F.broadcast(sums), "p").select(key, (F.col("base") + F.col("own") < share * F.col("total")).alias("in_test"))
