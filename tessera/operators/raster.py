"""Filters over pixel tables (img, y, x, c, p); any column set may name them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalar import gray


def grayscale(pixels: DataFrame, image: str = "img") -> DataFrame:
    """One channel from three (c: 0 red, 1 green, 2 blue): image, y, x, p."""
    channel = [F.max(F.when(F.col("c") == k, F.col("p"))).alias(n) for k, n in enumerate("rgb")]
    wide = pixels.groupBy(image, "y", "x").agg(*channel)
    return wide.select(image, "y", "x", gray(F.col("r"), F.col("g"), F.col("b")).alias("p"))


def box_blur(pixels: DataFrame, margin: int, image: str = "img") -> DataFrame:
    """Mean of the rows y-m .. y+m-1 and columns x-m .. x+m-1 that exist, truncated, for every channel.

    Two passes, along rows and then along columns, each over windows of one
    line of one channel of one image, so no task holds an image. Pixels are
    expected to fill their lines without gaps.
    """
    if margin < 1:
        raise ValueError("margin must be 1 or more")
    frame = (-margin, margin - 1)
    across = Window.partitionBy(image, "c", "y").orderBy("x").rowsBetween(*frame)
    down = Window.partitionBy(image, "c", "x").orderBy("y").rowsBetween(*frame)
    lines = pixels.select(image, "y", "x", "c", F.sum("p").over(across).alias("s"), F.count("p").over(across).alias("n"))
    boxes = lines.select(image, "y", "x", "c", F.sum("s").over(down).alias("s"), F.sum("n").over(down).alias("n"))
    return boxes.select(image, "y", "x", "c", F.expr("cast(s div n as int)").alias("p"))


def catalogue(pixels: DataFrame, image: str = "img") -> DataFrame:
    """Width, height, channels and number of pixels of every image."""
    out = pixels.groupBy(image).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.max("c") + 1).alias("channels")
    )
    return out.withColumn("pixels", (F.col("width") * F.col("height")).cast("long"))
