"""Distances, assignment and PAM over all embeddings: of two dimensions (x, y), of all 64, in single precision, by a matrix."""

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.operators import cluster
from tessera.plans.registry import query, table
from tessera.sources.scratch import drop, scratch_path

XY = ("x", "y")
_PTS = "pts AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_D = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
_D2 = "(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
#: Rows of a distance matrix that pam_matrix stores, at most: some 300 MB.
STORED_ROWS = 1 << 24
#: Medoids of the queries that take them as given.
GIVEN = (0, 1, 2)


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def _given(points):
    at = {r.id: (r.x, r.y) for r in points.filter(F.col("id").isin(*GIVEN)).collect()}
    return [at[m] for m in GIVEN]


@query(f"WITH {_PTS} SELECT a.id AS i, b.id AS j, round({_D.format(a='a', b='b')}, 6) AS d FROM pts a CROSS JOIN pts b")
def distance_matrix(spark, d):
    return cluster.whole_distance_matrix(_points(spark, d), XY).select("i", "j", rounded(F.col("d"), 6).alias("d"))


_NEAREST = f"""SELECT p.id, min({{'d': {_D.format(a="p", b="m")}, 'slot': m.id}}) AS b FROM pts p CROSS JOIN (SELECT * FROM pts WHERE id IN (0, 1, 2)) m GROUP BY p.id"""


@query(f"WITH {_PTS} SELECT id, (b.slot)::INTEGER AS slot, round(b.d, 6) AS d FROM ({_NEAREST})")
def assign(spark, d):
    points = _points(spark, d)
    return cluster.assign(points, XY, _given(points)).select("id", "slot", F.round("d", 6).alias("d"))


@query(f"WITH {_PTS} SELECT round(sum(b.d), 4) AS cost FROM ({_NEAREST})")
def total_cost(spark, d):
    points = _points(spark, d)
    return cluster.total_cost(points, XY, _given(points)).select(F.round("cost", 4).alias("cost"))


#: Naively: for every swap, every point's distance to each of the medoids after it.
_SWAPS = f"""SELECT c.id AS point, s.slot, sum(least({_D.format(a="p", b="m0")}, {_D.format(a="p", b="m1")}, {_D.format(a="p", b="m2")})) AS cost
    FROM pts c CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS slot) s
    JOIN pts m0 ON m0.id = CASE WHEN s.slot = 0 THEN c.id ELSE 0 END
    JOIN pts m1 ON m1.id = CASE WHEN s.slot = 1 THEN c.id ELSE 1 END
    JOIN pts m2 ON m2.id = CASE WHEN s.slot = 2 THEN c.id ELSE 2 END
    CROSS JOIN pts p WHERE c.id NOT IN (0, 1, 2) GROUP BY c.id, s.slot"""


@query(f"WITH {_PTS} SELECT point, slot, round(cost, 4) AS cost FROM ({_SWAPS})")
def swap_cost(spark, d):
    points = _points(spark, d)
    return cluster.swap_costs(points, XY, GIVEN, _given(points)).select("point", "slot", F.round("cost", 4).alias("cost"))


@query(f"WITH {_PTS} SELECT round(cost, 4) AS cost, slot, point FROM ({_SWAPS}) ORDER BY 1, slot, point LIMIT 1")
def best_swap(spark, d):
    points = _points(spark, d)
    best = cluster.best_swap(cluster.swap_costs(points, XY, GIVEN, _given(points)))
    return best.select(F.round("cost", 4).alias("cost"), "slot", "point")


def _pam_sql(dist, stop, first="'infinity'::DOUBLE", pts=_PTS, out="round(x, 6) AS x, round(y, 6) AS y, "):
    dist = dist.format
    return f"""WITH RECURSIVE {pts}, st AS (
        SELECT 0 AS it, 0::BIGINT AS m0, 1::BIGINT AS m1, 2::BIGINT AS m2, {first} AS cost, false AS done
        UNION ALL
        SELECT it + 1, CASE WHEN {stop} OR b.slot <> 0 THEN m0 ELSE b.point END, CASE WHEN {stop} OR b.slot <> 1 THEN m1 ELSE b.point END,
               CASE WHEN {stop} OR b.slot <> 2 THEN m2 ELSE b.point END, CASE WHEN {stop} THEN cost ELSE b.cost END, {stop}
        FROM (
          SELECT it, m0, m1, m2, cost, min({{'cost': c, 'slot': slot, 'point': point}}) AS b
          FROM (
            SELECT t.it, t.m0, t.m1, t.m2, t.cost, s.slot, c.id AS point,
                   sum(least({dist(a="p", b="a0")}, {dist(a="p", b="a1")}, {dist(a="p", b="a2")})) AS c
            FROM st t CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS slot) s CROSS JOIN pts c
            JOIN pts a0 ON a0.id = CASE WHEN s.slot = 0 THEN c.id ELSE t.m0 END
            JOIN pts a1 ON a1.id = CASE WHEN s.slot = 1 THEN c.id ELSE t.m1 END
            JOIN pts a2 ON a2.id = CASE WHEN s.slot = 2 THEN c.id ELSE t.m2 END
            CROSS JOIN pts p
            WHERE NOT t.done AND c.id NOT IN (t.m0, t.m1, t.m2)
            GROUP BY ALL)
          GROUP BY ALL))
        SELECT slot, id, {out}round(cost, 4) AS cost, it AS rounds
        FROM (SELECT *, unnest([0, 1, 2])::INTEGER AS slot, unnest([m0, m1, m2]) AS id FROM st WHERE done) JOIN pts USING (id)"""


def _register_pam(name, metric, stop, tol=None, computed=False):
    first = f"(SELECT sum(b.d) FROM ({_NEAREST}))" if computed else "'infinity'::DOUBLE"

    @query(_pam_sql(_D if metric == "l2" else _D2, stop, first), name)
    def pam(spark, d):
        points = _points(spark, d)
        more = {"initial_cost": "computed", "same_within": 2.220446049250313e-16} if computed else {}
        found = cluster.k_medoids(points, XY, 3, metric=metric, tol=tol, **more)
        rows = cluster.medoid_rows(points, XY, found)
        return rows.select("slot", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.lit(round(found.cost, 4)).alias("cost"), F.lit(found.rounds).alias("rounds"))


_register_pam("pam_l2", "l2", "(b.cost >= cost)")
_register_pam("pam_sq", "sqeuclidean", "(b.cost >= cost)")
_register_pam("pam_early", "l2", "(b.cost >= cost OR b.cost / cost > 0.95)", tol=0.95)
_register_pam("pam_strict", "l2", "(b.cost >= cost)", computed=True)


#: All 64 dimensions.
_PTS64 = "pts AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_D64 = "list_distance({a}.v, {b}.v)"
_NEAREST64 = f"""SELECT p.id, min({{'d': {_D64.format(a="p", b="m")}, 'slot': m.id}}) AS b FROM pts p CROSS JOIN (SELECT * FROM pts WHERE id IN (0, 1, 2)) m GROUP BY p.id"""
ALL = tuple(f"x{k}" for k in range(64))


def _points64(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(e[k].cast("double").alias(c) for k, c in enumerate(ALL)))


def _given64(points):
    at = {r.id: [r[c] for c in ALL] for r in points.filter(F.col("id").isin(*GIVEN)).collect()}
    return [at[m] for m in GIVEN]


@query(f"WITH {_PTS64} SELECT a.id AS i, b.id AS j, round({_D64.format(a='a', b='b')}, 5) AS d FROM pts a CROSS JOIN pts b")
def distance_matrix_64(spark, d):
    return cluster.whole_distance_matrix(_points64(spark, d), ALL).select("i", "j", rounded(F.col("d"), 5).alias("d"))


@query(f"WITH {_PTS64} SELECT id, (b.slot)::INTEGER AS slot, round(b.d, 5) AS d FROM ({_NEAREST64})")
def assign_64(spark, d):
    points = _points64(spark, d)
    return cluster.assign(points, ALL, _given64(points)).select("id", "slot", F.round("d", 5).alias("d"))


_SWAPS64 = f"""SELECT c.id AS point, s.slot, sum(least({_D64.format(a="p", b="m0")}, {_D64.format(a="p", b="m1")}, {_D64.format(a="p", b="m2")})) AS cost
    FROM pts c CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS slot) s
    JOIN pts m0 ON m0.id = CASE WHEN s.slot = 0 THEN c.id ELSE 0 END
    JOIN pts m1 ON m1.id = CASE WHEN s.slot = 1 THEN c.id ELSE 1 END
    JOIN pts m2 ON m2.id = CASE WHEN s.slot = 2 THEN c.id ELSE 2 END
    CROSS JOIN pts p WHERE c.id NOT IN (0, 1, 2) GROUP BY c.id, s.slot"""


@query(f"WITH {_PTS64} SELECT point, slot, round(cost, 4) AS cost FROM ({_SWAPS64})")
def swap_cost_64(spark, d):
    points = _points64(spark, d)
    return cluster.swap_costs(points, ALL, GIVEN, _given64(points)).select("point", "slot", F.round("cost", 4).alias("cost"))


def _result(rows, found):
    return rows.select("slot", "id", F.lit(round(found.cost, 4)).alias("cost"), F.lit(found.rounds).alias("rounds"))


@query(_pam_sql(_D64, "(b.cost >= cost)", pts=_PTS64, out=""))
def pam_64(spark, d):
    points = _points64(spark, d)
    found = cluster.k_medoids(points, ALL, 3)
    return _result(cluster.medoid_rows(points, ALL, found), found)


_PTS_FLOAT = "pts AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::FLOAT AS x, embedding[2]::FLOAT AS y FROM embeddings)"


@query(_pam_sql(_D2, "(b.cost >= cost)", pts=_PTS_FLOAT, out=""))
def pam_float(spark, d):
    """Squared distances in single precision, their sums in double."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    found = cluster.k_medoids(points, XY, 3, metric="sqeuclidean")
    return _result(cluster.medoid_rows(points, XY, found), found)


@query(_pam_sql(_D, "(b.cost >= cost)", out=""))
def pam_matrix(spark, d):
    """The distance matrix is stored first, up to STORED_ROWS; a larger one takes form in blocks where its distances are read."""
    points = _points(spark, d)
    if points.count() ** 2 <= STORED_ROWS:
        path = scratch_path(spark, "matrix")
        try:
            cluster.distance_matrix(points, XY).write.parquet(path)
            found = cluster.k_medoids_by_matrix(spark.read.parquet(path), 3)
        finally:
            drop(spark, path)
    else:
        found = cluster.k_medoids(points, XY, 3)
    return _result(cluster.medoid_rows(points, XY, found), found)
