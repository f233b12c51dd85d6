"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (a null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def sample(labels: DataFrame, label: str, n_folds: int, held: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(__lid, __label): at most `most` labelled rows outside the held-out fold, first in the order of a hash of the id.  A small table by construction."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).where(fold(F.col(id_col), n_folds) != held)
    pick = rows.select(F.col(id_col).alias("__lid"), F.col(label).cast("int").alias("__label")).distinct()
    return pick.orderBy(F.xxhash64("__lid"), "__lid", "__label").limit(most)


def texts(docs: DataFrame, picked: DataFrame, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Whole texts of the picked rows with their labels, in hash order, as far as `most_bytes` go in sum; a text that does not fit is passed over.

    A text counts once for an id and label, and of an id that several texts have, the first by hash is
    taken, so no more than the picked rows and the bytes reach the driver, whatever repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__lid"), text.alias("__text")).join(F.broadcast(picked), "__lid")
    rows = rows.groupBy("__lid", "__label").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))
    rows = cut(rows.withColumn("__h", F.xxhash64("__lid")), "labelled")
    sizes = sorted(rows.select("__h", "__lid", "__label", F.octet_length("__text")).collect())
    room, take = most_bytes, []
    for _, i, y, size in sizes:
        if size <= room:
            room -= size
            take.append((i, y))
    if not take:
        return []
    ids = docs.sparkSession.createDataFrame(take, f"__lid {dict(rows.dtypes)['__lid']}, __label int")
    got = rows.join(F.broadcast(ids), ["__lid", "__label"]).select("__h", "__lid", "__label", "__text").collect()
    return [(r["__text"], r["__label"]) for r in sorted(got, key=lambda r: (r["__h"], r["__lid"], r["__label"]))]
