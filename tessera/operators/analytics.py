"""Measurement analytics: summaries, pivots, ratios and fits over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rank error of the sketches that bracket a quantile, as a share of the rows: one in so many.
ACCURACY = 10_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``keys``, min, max and a column for each wanted share: exact quantiles with linear interpolation; nulls don't count.

    A mergeable sketch brackets every quantile; only values in the brackets, a
    small share of a large group, are ranked, and equal ones count before that.
    Groups of no more than ``ACCURACY`` rows are ranked whole.
    """
    reach = 4.0 / ACCURACY  # the sketch's error on either side, and two rows at least
    edges = [min(1.0, max(0.0, q + s)) for q in wanted.values() for s in (-reach, reach)]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, edges)), ACCURACY)
    stats = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(value).alias("min"), F.max(value).alias("max"), sketch.alias("_edges"))
    whole = F.flatten(F.array_repeat(F.array("min", "max"), len(wanted)))
    of = stats.select(*(F.col(k).alias(f"_{k}") for k in keys), "_n", F.when(F.col("_n") <= ACCURACY, whole).otherwise(F.col("_edges")).alias("_edges"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = df.select(*keys, F.col(value).alias("_v")).filter("_v is not null")
    rows = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).join(of, on).select(*keys, "_n", "_v", "_c", "_edges")
    # by quantile: how many lie below its bracket (one row a task and key), and each value in it
    inside = [F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.get("_edges", F.lit(2 * i)), F.col("_v")).alias("v"), F.col("_c").alias("c")) for i in range(len(wanted))]
    upto = F.filter(F.array(*inside), lambda x: F.col("_v") <= F.get("_edges", 2 * x["i"] + 1))
    counted = rows.select(*keys, "_n", F.explode(upto).alias("x")).groupBy(*keys, "_n", F.col("x.i").alias("_i"), F.col("x.v").alias("_v")).agg(F.sum("x.c").alias("_c"))
    by = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_c").over(by))
    shares = F.array(*map(F.lit, wanted.values()))
    place = F.get(shares, F.col("_i")) * (F.col("_n") - 1)
    at = lambda p: F.min(F.when(F.col("_upto") > p, F.col("_v")))
    found = ranked.groupBy(*keys, "_i").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.max(place - F.floor(place)).alias("_f"))
    found = found.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    wide = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"_q_{name}") for i, name in enumerate(wanted)))
    out = stats.join(wide, on, "left")
    return out.select(*keys, "min", "max", *(F.col(f"_q_{name}").alias(name) for name in wanted))


def quantile_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, q10, median, q90 and max by ``keys``, quantiles exact with linear interpolation."""
    out = quantiles(df, keys, value, {"q10": 0.1, "median": 0.5, "q90": 0.9})
    return out.select(*keys, "min", "q10", "median", "q90", "max")


def means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """avg, med, min, max and stddev, as profilers list them."""
    half = quantiles(df, keys, value, {"med": 0.5}).select(*(F.col(k).alias(f"_{k}") for k in keys), "med", "min", "max")
    moments = df.groupBy(*keys).agg(F.avg(value).alias("avg"), F.stddev_samp(value).alias("stddev"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return moments.join(half, on).select(*keys, "avg", "med", "min", "max", "stddev")


def relative_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(max - min) / sum by ``keys``."""
    return df.groupBy(*keys).agg(((F.max(value) - F.min(value)) / F.sum(value)).alias("deviation"))


def pivot_unique(df: DataFrame, index: Sequence[str], column: str, value: str, names: Sequence) -> DataFrame:
    """Long to wide for unique keys; two values for one cell are an error when the result is read."""
    cells = df.groupBy(*index, column).agg(F.first(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_v", F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.lit("pivot: duplicate entries")).cast(df.schema[value].dataType)))
    return cells.groupBy(*index).pivot(column, list(names)).agg(F.first("_v"))


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, value: str, names: Sequence) -> DataFrame:
    return df.groupBy(*index).pivot(column, list(names)).agg(F.avg(value))


def wide_to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def speedup(df: DataFrame, keys: Sequence[str], kind: str, value: str, baseline: str) -> DataFrame:
    """``df`` with speedup: the baseline's value over the row's own, within ``keys``."""
    within = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(kind) == baseline, F.col(value))).over(within)
    return df.withColumn("speedup", F.try_divide(base, F.col(value)))


def ratio(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """a's value over b's, aligned by ``keys``; keys of one side only have a null."""
    left = a.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_a"))
    right = b.select(*keys, F.col(value).alias("_b"))
    on = None
    for k in keys:
        same = F.col(f"_{k}").eqNullSafe(F.col(k))
        on = same if on is None else on & same
    both = left.join(right, on, "full")
    return both.select(*(F.coalesce(f"_{k}", k).alias(k) for k in keys), F.try_divide("_a", "_b").alias("ratio"))


def composition(df: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str], rest: str = "rest") -> DataFrame:
    """keys, part, amount and percent: the parts of a total and what they leave."""
    left = F.col(total)
    for p in parts:
        left = left - F.col(p)
    each = [F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("amount")) for p in parts]
    each.append(F.struct(F.lit(rest).alias("part"), left.cast("double").alias("amount")))
    long = df.select(*keys, F.col(total).alias("_t"), F.explode(F.array(*each)).alias("s"))
    return long.select(*keys, "s.part", "s.amount", (F.col("s.amount") / F.col("_t") * 100).alias("percent"))


def proportional_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """b of y = b x by least squares in logarithms; rows that are not positive do not count."""
    return df.filter((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.exp(F.avg(F.ln(y) - F.ln(x))).alias("b"))


def complete(agg: DataFrame, categories: dict[str, Sequence]) -> DataFrame:
    """``agg`` with a row for every combination of the categories; absent ones have nulls."""
    grid = None
    for name, values in categories.items():
        one = agg.sparkSession.createDataFrame([(v,) for v in values], f"{name} {agg.schema[name].dataType.simpleString()}")
        grid = one if grid is None else grid.crossJoin(one)
    return F.broadcast(grid).join(agg, list(categories), "left")


def ordinal(column: Column, order: Sequence) -> Column:
    """The position of a value in a custom order; null for others."""
    rank = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        rank = F.when(column == v, F.lit(i)).otherwise(rank)
    return rank


def only_value(df: DataFrame, column: str):
    """The one value of a column; any other number of values is an error."""
    found = df.select(column).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{column} does not have exactly one value")
    return found[0][0]


def edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: int = 1, last: int = 1) -> DataFrame:
    """The first and last rows of every group in an explicit order, with their position from each end.

    Either end is a limit by group, which each task applies to its own rows before anything is sent.
    """
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    sizes = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    names = [*df.columns, "from_first", "from_last"]
    head = df.withColumn("from_first", F.row_number().over(up)).filter(F.col("from_first") <= first).join(sizes, on)
    tail = df.withColumn("from_last", F.row_number().over(down)).filter(F.col("from_last") <= last).join(sizes, on)
    head = head.withColumn("from_last", F.col("_n") - F.col("from_first") + 1).select(*names)
    tail = tail.withColumn("from_first", F.col("_n") - F.col("from_last") + 1).filter(F.col("from_first") > first).select(*names)
    return head.unionByName(tail)


def without_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """All but the last ``n`` rows of every group."""
    down = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") > n).drop("_r")
