"""Histograms over streams: event-time windows with a watermark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import MAPPINGS

_COUNTS = T.ArrayType(T.StructType([T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())]))


def windowed_byte_histogram(stream: DataFrame, ts: str, column: str, window: str = "1 hour", late: str = "2 hours", mapping: str = "128") -> DataFrame:
    """start, bin, n over a streaming (or static) table; the state is bins x open windows.

    A text's bytes are counted at once: a row for each byte that occurs in it, not for each byte.
    """
    to_bin, _ = MAPPINGS[mapping]

    @F.pandas_udf(_COUNTS)
    def counted(texts: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            n = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
            return [{"byte": int(b), "n": int(n[b])} for b in np.flatnonzero(n)]

        return texts.map(one)

    rows = stream.withWatermark(ts, late).select(F.col(ts), F.explode(counted(F.col(column).cast("binary"))).alias("x"))
    out = rows.groupBy(F.window(ts, window), to_bin(F.col("x.byte")).alias("bin")).agg(F.sum("x.n").alias("n"))
    return out.select(F.col("window.start").alias("start"), "bin", "n")
