"""Flattening of measurement objects and parsing of profiler reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import grouped_number, microseconds, without_prefix

#: The fields of a profiler table's row, in order; the rest of the line is the name.
FIELDS = ("percent", "total", "instances", "avg", "med", "min", "max", "stddev")
COUNTS = ("percent", "instances")


def flatten_measurements(rows: DataFrame, device: str = "device") -> DataFrame:
    """A row for each kernel and repetition; aligned lists are exploded together, ``run`` counts from 1."""
    extra = [device] if device in rows.columns else []
    kernels = rows.select("source_key", *extra, "useMappingLetter", "uniformInput", "fileName", "inputLengthInCharacters", F.explode("measurements").alias("kernel", "m"))
    aligned = F.arrays_zip(F.col("m.timesTransferToDevice").alias("to"), F.col("m.timesExecution").alias("run"), F.col("m.timesTransferFromDevice").alias("back"))
    runs = kernels.select("*", F.posexplode(aligned).alias("at", "t"))
    return runs.select(
        "source_key", *extra, without_prefix(F.col("kernel"), "histogram_").alias("kernel"),
        F.col("useMappingLetter").alias("mapping_letter"), F.col("uniformInput").alias("uniform_input"),
        F.col("fileName").alias("input_file_name"), F.col("inputLengthInCharacters").alias("input_length"),
        (F.col("at") + 1).alias("run"), F.col("t.to").alias("time_to_device"), F.col("t.run").alias("time_execution"), F.col("t.back").alias("time_from_device"),
        (F.col("t.to") + F.col("t.run") + F.col("t.back")).alias("time_total"), F.col("m.bins").alias("bins"),
    )


def first_lines(lines: DataFrame, patterns: dict[str, str], path: str = "path") -> DataFrame:
    """path, kind, line: for each report and kind the first line that contains the kind's text."""
    kind = F.array_compact(F.array(*(F.when(F.contains("line", F.lit(p)), F.lit(k)) for k, p in patterns.items())))
    found = lines.select(path, "line_no", "line", F.explode(kind).alias("kind"))
    return found.groupBy(path, "kind").agg(F.min_by("line", "line_no").alias("line"))


def parse_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """The fields of profiler table rows: times in microseconds, counts as they are, the name last."""
    parts = F.split(F.trim("line"), r"\s+")
    cells = []
    for i, name in enumerate(FIELDS):
        cell = F.get("_p", F.lit(i))
        cells.append((grouped_number(cell) if name in COUNTS else microseconds(cell)).alias(name))
    rest = F.array_join(F.slice("_p", len(FIELDS) + 1, F.greatest(F.size("_p") - len(FIELDS), F.lit(0))), " ")
    return lines.withColumn("_p", parts).select(*keep, *cells, rest.alias("name"))


def traces(lines: DataFrame, key: str, path: str = "path") -> DataFrame:
    """path, value: the number of the one line ``TRACE: key value`` of each report; any other number of lines is an error."""
    value = F.regexp_extract("line", rf"TRACE: {key}\s+([0-9.]+)", 1)
    found = lines.select(path, value.alias("v")).filter("v != ''").groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return found.select(path, F.when(F.col("n") == 1, F.col("v").cast("double")).otherwise(F.raise_error(F.lit(f"TRACE: {key} is not there exactly once")).cast("double")).alias("value"))
