"""Raster filters; embeddings serve as images: vectors are lines, dimensions are columns or channels."""

from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.plans.registry import query, table

_QUANTIZED = "(floor(abs(v::DOUBLE) * 64)::BIGINT % 256)::INTEGER"
_PIXELS = f"""SELECT 'e' AS img, y, (i // {{width}})::INTEGER AS x, (i % {{width}})::INTEGER AS c, {_QUANTIZED} AS p
    FROM (SELECT vec_id::INTEGER AS y, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)"""


def _pixels(spark, d, channels):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("i", "v"))
    p = (F.floor(F.abs(F.col("v").cast("double")) * 64) % 256).cast("int")
    return rows.select(F.lit("e").alias("img"), "y", F.floor(F.col("i") / channels).cast("int").alias("x"), (F.col("i") % channels).cast("int").alias("c"), p.alias("p"))


def _blur_sql(margin, channels=1):
    frame = f"ROWS BETWEEN {margin} PRECEDING AND {margin - 1} FOLLOWING"
    return f"""WITH px AS ({_PIXELS.format(width=channels)}),
        a AS (SELECT img, y, x, c, sum(p) OVER w AS s, count(p) OVER w AS n FROM px WINDOW w AS (PARTITION BY img, c, y ORDER BY x {frame})),
        b AS (SELECT img, y, x, c, sum(s) OVER w AS s, sum(n) OVER w AS n FROM a WINDOW w AS (PARTITION BY img, c, x ORDER BY y {frame}))
        SELECT img, y, x, c, (s // n)::INTEGER AS p FROM b"""


def _register_blur(name, margin, channels=1):
    @query(_blur_sql(margin, channels), name)
    def blur(spark, d):
        return raster.box_blur(_pixels(spark, d, channels), margin)


for _m in (1, 2, 3):
    _register_blur(f"blur_m{_m}", _m)
_register_blur("blur_channels", 2, 4)


@query(
    f"""WITH px AS ({_PIXELS.format(width=3)})
        SELECT a.img, a.y, a.x, ((299 * a.p + 587 * b.p + 114 * c.p) // 1000)::INTEGER AS p
        FROM px a JOIN px b ON b.y = a.y AND b.x = a.x AND b.c = 1 JOIN px c ON c.y = a.y AND c.x = a.x AND c.c = 2 WHERE a.c = 0"""
)
def gray(spark, d):
    whole = _pixels(spark, d, 3).filter("x < 21")  # 64 dimensions make 21 pixels of 3 channels
    return raster.grayscale(whole)


@query(
    f"""SELECT img, (max(x) + 1)::INTEGER AS width, (max(y) + 1)::INTEGER AS height, (max(c) + 1)::INTEGER AS channels, ((max(x) + 1) * (max(y) + 1))::BIGINT AS pixels
        FROM ({_PIXELS.format(width=4)}) GROUP BY img"""
)
def image_sizes(spark, d):
    return raster.catalogue(_pixels(spark, d, 4))
