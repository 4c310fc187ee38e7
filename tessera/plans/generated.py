"""Generated inputs: what is known of them whatever the random numbers are."""

from pyspark.sql import functions as F

from tessera.operators import histogram
from tessera.plans.registry import query
from tessera.sources import generators

CENTERS = ((0.0, 0.0), (5.0, 1.0), (-3.0, 4.0))


@query("SELECT 97 AS byte, 1000000::BIGINT AS n")
def uniform_bytes(spark, d):
    rows = generators.uniform_bytes(spark, 1_000_000)
    return rows.groupBy(F.col("byte").cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS bin, 4096::BIGINT AS n")
def uniform_letters(spark, d):
    """The letter histogram of a text of one letter."""
    text = generators.uniform_bytes(spark, 4096).select(F.chr(F.col("byte").cast("int")).alias("c"))
    return histogram.histogram(text, "c", "letter")


@query("SELECT 200000::BIGINT AS n, true AS within, true AS whole, 100::BIGINT AS as_, 200::BIGINT AS bs")
def random_integers(spark, d):
    """Two vectors of whole numbers below 100 and 200, all of which occur."""
    rows = generators.random_vectors(spark, 200_000, integers=True)
    within = F.bool_and(F.col("a").between(0, 99) & F.col("b").between(0, 199))
    whole = F.bool_and((F.col("a") == F.floor("a")) & (F.col("b") == F.floor("b")))
    return rows.agg(F.count(F.lit(1)).alias("n"), within.alias("within"), whole.alias("whole"), F.countDistinct("a").alias("as_"), F.countDistinct("b").alias("bs"))


@query("SELECT unnest([0, 1, 2])::INTEGER AS center, 20000::BIGINT AS n, true AS near, true AS spread")
def blobs(spark, d):
    """Clouds of equal size, their means at the centers and their deviation a half."""
    rows = generators.blobs(spark, 60_000, CENTERS)
    off = [F.abs(F.avg(f"x{j}") - F.element_at(F.array(*(F.lit(c[j]) for c in CENTERS)), F.first("center") + 1)) < 0.05 for j in range(2)]
    return rows.groupBy("center").agg(F.count(F.lit(1)).alias("n"), (off[0] & off[1]).alias("near"), F.stddev("x0").between(0.48, 0.52).alias("spread"))
