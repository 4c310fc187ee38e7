"""File sources: points, texts, images, measurement JSON and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def csv_points(spark: SparkSession, path: str, d: int, kind: str = "double") -> DataFrame:
    """id, x0..: a headerless CSV of numbers, any bad cell an error; id is the row's place in order of files.

    A split's rows follow each other, so a row's place is that of its split's
    first row and its distance from it: one row a split tells the former.
    """
    names = [f"x{j}" for j in range(d)]
    rows = spark.read.csv(path, schema=", ".join(f"{x} {kind}" for x in names), header=False, mode="FAILFAST")
    rows = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_start", "_first", before.alias("_before"))
    placed = rows.join(splits, ["_file", "_start"])
    return placed.select((F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("id"), *names)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are inferred unless given."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def whole_texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, content (binary) of whole files; NUL bytes are bytes like others."""
    reader = spark.read.format("binaryFile")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path).select("path", "content")


def report_lines(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """path, line_no, line of text reports."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


MEASUREMENT = T.StructType(
    [
        T.StructField("fileName", T.StringType()),
        T.StructField("inputLengthInCharacters", T.LongType()),
        T.StructField("uniformInput", T.BooleanType()),
        T.StructField("useMappingLetter", T.BooleanType()),
        T.StructField(
            "measurements",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("timesTransferToDevice", "timesExecution", "timesTransferFromDevice")]
                    + [T.StructField("bins", T.ArrayType(T.LongType()))]
                ),
            ),
        ),
    ]
)


def measurement_json(spark: SparkSession, path: str) -> DataFrame:
    """One object a file, with the file's stem as source_key; a missing fileName is null."""
    rows = spark.read.schema(MEASUREMENT).option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(path)
    return rows.withColumn("source_key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def records_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A list of records a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def images(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """img (file stem), width, height, channels, data: decoded images, bytes interleaved in BGR order as Spark stores them."""
    rows = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", f"*{suffix}").load(path).select("image.*")
    name = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("img"), "width", "height", F.col("nChannels").alias("channels"), "data")


#: Pixels of an output batch.
PIXEL_ROWS = 1 << 16


def pixels(decoded: DataFrame) -> DataFrame:
    """img, y, x, c, p with c in RGB order, from ``images``; rows come in blocks cut from an image's bytes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.frombuffer(data, np.uint8)
                for a in range(0, len(values), PIXEL_ROWS):
                    at = np.arange(a, min(a + PIXEL_ROWS, len(values)))
                    cell, k = at // channels, at % channels
                    columns = [
                        pa.array([img] * len(at), pa.string()), pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)),
                        pa.array((2 - k if channels == 3 else k).astype(np.int32)), pa.array(values[at].astype(np.int16)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["img", "y", "x", "c", "p"])

    return decoded.select("img", "width", "channels", "data").mapInArrow(spread, "img string, y int, x int, c int, p smallint")
