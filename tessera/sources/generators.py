"""Generated inputs: constants, bytes, random vectors, blobs and grids; all lazy and split over tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the byte generator: modulus, multiplier and seed.
LCG_MODULUS, LCG_MULTIPLIER, LCG_SEED = 2**31 - 1, 48271, 2236631296
_BLOCK = 1 << 16


def ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).cast("float").alias("v"))


def uniform_bytes(spark: SparkSession, n: int, byte: int = 97) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(byte).cast("smallint").alias("byte"))


def lcg_bytes(spark: SparkSession, n: int, seed: int = LCG_SEED) -> DataFrame:
    """i, byte in 1..128 of a Lehmer generator; every task jumps to its place by modular powers.

    Within a task, blocks advance as whole vectors: the multiplier's powers of
    a block times the state at its start.
    """
    powers = np.ones(_BLOCK + 1, np.uint64)
    for k in range(1, _BLOCK + 1):
        powers[k] = int(powers[k - 1]) * LCG_MULTIPLIER % LCG_MODULUS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            at = 0
            while at < len(i):  # runs of consecutive positions
                stop = min(len(i), at + _BLOCK)
                gap = np.flatnonzero(np.diff(i[at:stop]) != 1)
                stop = at + int(gap[0]) + 1 if len(gap) else stop
                state = seed * pow(LCG_MULTIPLIER, int(i[at]), LCG_MODULUS) % LCG_MODULUS
                states = powers[1 : stop - at + 1] * np.uint64(state) % np.uint64(LCG_MODULUS)
                out = ((states >> np.uint64(16)) & np.uint64(0x7F)) + np.uint64(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(out.astype(np.int16))], names=["i", "byte"])
                at = stop

    return spark.range(n).mapInArrow(fill, "i bigint, byte smallint")


def random_vectors(spark: SparkSession, n: int, seed: int = 0, integers: bool = False) -> DataFrame:
    """i, a, b: uniform in [0, 1), or integers below 100 and 200 as floats."""
    a, b = F.rand(seed), F.rand(seed + 1)
    if integers:
        a, b = F.floor(a * 100).cast("float"), F.floor(b * 200).cast("float")
    return spark.range(n).select(F.col("id").alias("i"), a.alias("a"), b.alias("b"))


def blobs(spark: SparkSession, n: int, centers: Sequence[Sequence[float]], std: float = 0.5, seed: int = 0) -> DataFrame:
    """id, x0.., center: normal clouds of equal size around the centers."""
    k, d = len(centers), len(centers[0])
    which = (F.col("id") % k).cast("int")
    at = [F.element_at(F.array(*(F.lit(float(c[j])) for c in centers)), which + 1) + std * F.randn(seed + j) for j in range(d)]
    return spark.range(n).select("id", *(x.alias(f"x{j}") for j, x in enumerate(at)), which.alias("center"))


def sequence(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """i, x: n equally spaced values, both ends included."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("x"))


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of some parameters' values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out
