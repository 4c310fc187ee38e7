"""Element-wise arithmetic and reductions of numeric vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: Column | str, b: Column | str) -> Column:
    """Sum of two columns of one table: positions are rows."""
    return (F.col(a) if isinstance(a, str) else a) + (F.col(b) if isinstance(b, str) else b)


def add_arrays(a: Column | str, b: Column | str) -> Column:
    """Element-wise sum of two arrays; the longer one's rest is null."""
    return F.zip_with(a, b, lambda x, y: x + y)


def add_aligned(left: DataFrame, right: DataFrame, index: str, value: str) -> DataFrame:
    """``index``, c: sums of two vectors in tables of their own, by position."""
    r = right.select(F.col(index).alias("_i"), F.col(value).alias("_v"))
    return left.join(r, F.col(index) == F.col("_i")).select(index, (F.col(value) + F.col("_v")).alias("c"))


def total(df: DataFrame, value: str) -> DataFrame:
    """The sum of a vector in one row: partial sums in every task, then one addition a task."""
    return df.agg(F.sum(value).alias("total"))


def two_level_total(df: DataFrame, value: str, by: str) -> DataFrame:
    """The sum by way of partial sums for each ``by``, which themselves are of use."""
    return df.groupBy(by).agg(F.sum(value).alias("part")).agg(F.sum("part").alias("total"), F.count(F.lit(1)).alias("parts"))


def tree_total(df: DataFrame, value: str, index: str, fan_in: int = 1024) -> DataFrame:
    """The sum by passes that each add ``fan_in`` neighbours; for vectors whose order of addition must be fixed."""
    top = df.agg(F.max(index)).first()[0]
    level = df.select(F.col(index).cast("long").alias("i"), F.col(value).alias("v"))
    while top is not None and top > 0:
        level = level.groupBy(F.floor(F.col("i") / fan_in).cast("long").alias("i")).agg(
            F.expr("aggregate(array_sort(collect_list(struct(i as j, v))), 0D, (s, x) -> s + x.v)").alias("v")
        )
        top //= fan_in
    return level.agg(F.sum("v").alias("total"))
