"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a pseudo-random score that depends on nothing
else; a record belongs to the shard of its highest score. A further shard can
therefore only take records into itself, and taking a shard away only moves
that shard's records. Weights enter as ``-w / ln(u)`` (weighted rendezvous
hashing, Schindelhauer and Schomaker 2005), which keeps that property.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, whole_text


def _scores(key: Column, weights: Sequence[float], salt: int) -> list[Column]:
    if not weights or any(w <= 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite, positive and not empty")
    # The key is hashed once; each shard's score mixes that hash with the shard's number.
    k = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(salt))

    def pair(s: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(k, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(-float(weights[s])) / F.ln(u)).alias("score"), F.lit(s).alias("shard"))

    return [pair(s) for s in range(len(weights))]


def shard_of(key: Column, weights: Sequence[float], salt: int = 0) -> Column:
    """Index of the shard with the highest weighted rendezvous score for ``key``.

    ``weights[s]`` is shard s's share; equal or not, one law holds. Ties go to
    the larger shard index, a null key hashes as its own key.
    """
    scores = _scores(key, weights, salt)
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def numbered(df: DataFrame, group: str, order: Sequence[str], rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within ``group``, without one task per group.

    Rows are numbered inside (group, bucket) cells, where the bucket is a hash
    of ``order``; the cells' offsets come from a table of counts, which is
    ``groups x buckets`` rows. Equal rows get different, interchangeable slots.
    """
    spark = df.sparkSession
    buckets = max(shuffle_partitions(spark), -(-df.count() // rows_per_bucket))
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cells.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_group"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    ranked = cells.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(offsets, (F.col(group) == F.col("_group")) & (F.col("_cell") == F.col("_at")))
    return joined.withColumn("slot", (F.col("_base") + F.col("_rank") - 1).cast("long")).drop(
        "_group", "_at", "_base", "_rank", "_cell"
    )


def shard_documents(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", salt: int = 0, next_weight: float | None = None
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``text_crc32``, ``shard``, ``grown_shard`` and ``slot``.

    ``size`` is the UTF-8 length of the text plus 16 (null text: 16).
    ``grown_shard`` is the shard after one more shard joins, of ``next_weight`` or else the mean weight.
    Rows with equal keys, copies included, share a shard; null keys count as
    one key; an empty table gives no rows. Only key, size and checksum are
    shuffled. Columns of the input with the names of the new ones are replaced.
    """
    scores = _scores(F.col("doc_id"), [*weights, sum(weights) / len(weights) if next_weight is None else next_weight], salt)
    body = whole_text(text).cast("binary")
    flat = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    best = flat.withColumn("best", F.greatest(*scores[:-1]) if len(weights) > 1 else scores[0])
    placed = best.withColumns({"shard": F.col("best")["shard"], "grown_shard": F.greatest("best", scores[-1])["shard"]}).drop("best")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"])
