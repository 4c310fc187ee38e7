"""Byte histograms under pluggable mappings from bytes to bins.

Bytes are counted in bulk where they are read (Arrow buffers, one bincount a
batch); 256 counts a task are all that is shuffled, and the mapping is applied
to those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalar import MAPPINGS

Mapping = str | tuple[Callable[[Column], Column], int]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch in one array, and the length of each row's."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(ends)
    if data is None:
        return np.zeros(0, np.uint8), sizes
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], sizes


def byte_counts(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """byte, n (and ``by``): how often each byte occurs in the UTF-8 text or binary ``column``; absent bytes have no row."""
    keyed = by is not None
    kind = df.schema[by].dataType.simpleString() if keyed else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            data, sizes = _bytes(batch.column(0))
            if keyed:
                codes = batch.column(1).dictionary_encode()
                keys = codes.dictionary.to_pylist() + [None]
                index = codes.indices.fill_null(len(keys) - 1).to_numpy().astype(np.int64)
                found = np.bincount(np.repeat(index, sizes) * 256 + data, minlength=256 * len(keys)).reshape(-1, 256)
                for k, row in zip(keys, found, strict=True):
                    totals[k] = totals.get(k, 0) + row
            else:
                totals[None] = totals.get(None, 0) + np.bincount(data, minlength=256)
        for k, row in totals.items():
            at = np.flatnonzero(row)
            cols = [pa.array(at, pa.int32()), pa.array(row[at], pa.int64())]
            if keyed:
                cols.append(pa.array([k] * len(at), batch.schema.field(1).type))
            yield pa.RecordBatch.from_arrays(cols, names=["byte", "n", "by"][: len(cols)])

    rows = df.select(column, by) if keyed else df.select(column)
    counted = rows.mapInArrow(count, "byte int, n bigint" + (f", by {kind}" if keyed else ""))
    if keyed:
        return counted.groupBy(F.col("by").alias(by), "byte").agg(F.sum("n").alias("n"))
    return counted.groupBy("byte").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, mapping: Mapping = "128", by: str | None = None, dense: bool = False) -> DataFrame:
    """bin, n (and ``by``): counts by bin; ``dense`` adds the bins that do not occur, with 0."""
    to_bin, bins = MAPPINGS[mapping] if isinstance(mapping, str) else mapping
    keys = [by] if by else []
    out = byte_counts(df, column, by).groupBy(*keys, to_bin(F.col("byte")).alias("bin")).agg(F.sum("n").alias("n"))
    if not dense:
        return out
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        every = every.crossJoin(df.select(by).distinct())
        on = (F.col("a.bin") == F.col("b.bin")) & F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))
    else:
        on = F.col("a.bin") == F.col("b.bin")
    picked = [F.col(f"a.{k}") for k in [*keys, "bin"]]
    return every.alias("a").join(out.alias("b"), on, "left").select(*picked, F.coalesce("b.n", F.lit(0)).cast("long").alias("n"))


def relative(hist: DataFrame) -> DataFrame:
    """bin, n, share of the non-zero bins, and a total row whose bin is -1."""
    total = hist.agg(F.sum("n").alias("n")).select(F.lit(-1).alias("bin"), "n")
    rows = hist.filter("n > 0").select("bin", "n").unionByName(total)
    whole = F.max(F.when(F.col("bin") == -1, F.col("n"))).over(Window.partitionBy())
    return rows.select("bin", "n", (F.col("n") / whole).alias("share"))


def deviation(hist: DataFrame) -> DataFrame:
    """Largest and smallest share and their distance."""
    total = F.sum("n")
    return hist.agg(
        (F.max("n") / total).alias("max_share"), (F.min("n") / total).alias("min_share"), ((F.max("n") - F.min("n")) / total).alias("deviation")
    )
