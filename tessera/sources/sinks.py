"""File sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def medoids_csv(rows: DataFrame, coords: Sequence[str], path: str) -> None:
    """The medoids' coordinates in order of slots, headerless, in one file (k rows), at full precision."""
    rows.coalesce(1).sortWithinPartitions("slot").select(*coords).write.mode("overwrite").csv(path, header=False)


def points_csv(points: DataFrame, coords: Sequence[str], path: str, decimals: int = 18) -> None:
    """Headerless CSV with a fixed number of decimals."""
    points.select(*(F.format_string(f"%.{decimals}f", c).alias(c) for c in coords)).write.mode("overwrite").csv(path, header=False)


def table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def records_json(df: DataFrame, path: str) -> None:
    """One JSON record a line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def measurement_json(df: DataFrame, path: str, one_a_file: bool = False) -> None:
    """Measurement objects, one a line (or one a file, as the source reads them), times with 7 decimals."""
    times = ("timesTransferToDevice", "timesExecution", "timesTransferFromDevice")
    rounded = F.transform_values(
        "measurements",
        lambda _, m: F.struct(*(F.transform(m[t], lambda v: F.round(v, 7)).alias(t) for t in times), m["bins"].alias("bins")),
    )
    writer = df.withColumn("measurements", rounded).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", 1) if one_a_file else writer).json(path)


def report_text(lines: DataFrame, column: str, path: str) -> None:
    """Lines verbatim."""
    lines.select(column).write.mode("overwrite").text(path)


def pixels_parquet(pixels: DataFrame, path: str) -> None:
    pixels.write.mode("overwrite").parquet(path)
