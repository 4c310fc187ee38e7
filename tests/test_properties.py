"""Properties and brute-force comparisons of the engine's operators."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import analytics, cluster, histogram, raster, vector
from tessera.plans import clusters, registry
from tessera.sources import generators
from tessera.streaming.histograms import windowed_byte_histogram


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_mappings(spark):
    got = {r.b: (r.m, r.l) for r in spark.range(256).select(F.col("id").cast("int").alias("b")).select("b", scalar.bin_128(F.col("b")).alias("m"), scalar.bin_letter(F.col("b")).alias("l")).collect()}
    assert [got[b][0] for b in (1, 2, 128, 129, 0, 255)] == [0, 1, 127, 0, 127, 126]
    letters = {0: 0, "@": 0, "A": 1, "C": 3, "Z": 26, "[": 0, "`": 0, "a": 1, "c": 3, "z": 26, "{": 0}
    assert all(got[ord(k) if isinstance(k, str) else k][1] == v for k, v in letters.items())


def test_gray_is_close_to_the_float_formula(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(256) for _ in "rgb") for _ in range(3000)] + [(255, 255, 255), (0, 0, 0)]
    df = spark.createDataFrame(rows, "r int, g int, b int").withColumn("p", scalar.gray(F.col("r"), F.col("g"), F.col("b")))
    for r in df.collect():
        f = np.float32(0.299) * np.float32(r.r) + np.float32(0.587) * np.float32(r.g) + np.float32(0.114) * np.float32(r.b)
        assert abs(r.p - int(f)) <= 1 and 0 <= r.p <= 255


def test_sum_of_ones(spark):
    for n in (1, 1024, 100_000):
        ones = generators.ones(spark, n)
        assert vector.total(ones, "v").first().total == n
        assert vector.tree_total(ones, "v", "i").first().total == n
    assert vector.total(generators.ones(spark, 0), "v").first().total is None


@pytest.mark.parametrize("mapping", ["128", "letter"])
def test_histogram_of_rows_with_nulls(spark, mapping):
    texts = [("a", "Zebra é"), ("a", None), (None, "😀 x"), ("b", ""), ("a", "{|}\x00\x7f")]
    df = spark.createDataFrame(texts, "k string, t string").repartition(3)
    data = [(k, b) for k, t in texts for b in (t or "").encode()]
    fn = (lambda b: (b + 127) % 128) if mapping == "128" else (lambda b: b & 31 if chr(b).isalpha() and b < 128 else 0)
    want = {}
    for k, b in data:
        want[k, fn(b)] = want.get((k, fn(b)), 0) + 1
    got = {(r.k, r.bin): r.n for r in histogram.histogram(df, "t", mapping, by="k").collect()}
    assert got == want
    dense = histogram.histogram(df, "t", mapping, dense=True).collect()
    assert len(dense) == scalar.MAPPINGS[mapping][1] and sum(r.n for r in dense) == len(data)
    keyed = histogram.histogram(df, "t", mapping, by="k", dense=True).collect()
    assert len(keyed) == 3 * scalar.MAPPINGS[mapping][1] and {(r.k, r.bin): r.n for r in keyed if r.n} == want
    binary = df.select(F.col("t").cast("binary").alias("t"))
    assert sum(r.n for r in histogram.histogram(binary, "t", mapping).collect()) == len(data)


def test_generated_bytes(spark):
    state, want = generators.LCG_SEED, []
    for _ in range(150_000):
        state = state * 48271 % (2**31 - 1)
        want.append((state >> 16 & 0x7F) + 1)
    got = [r.byte for r in generators.lcg_bytes(spark, 150_000).orderBy("i").collect()]
    assert got == want and min(got) == 1 and max(got) == 128
    assert generators.uniform_bytes(spark, 10).filter("byte = 97").count() == 10


def test_generated_points(spark):
    rows = generators.blobs(spark, 3000, [(0, 0), (10, 10), (-5, 5)]).groupBy("center").agg(F.count("*").alias("n"), F.avg("x0").alias("x"), F.stddev("x1").alias("s")).collect()
    assert {r.center: r.n for r in rows} == {0: 1000, 1: 1000, 2: 1000}
    assert all(abs(r.x - (0, 10, -5)[r.center]) < 0.1 and abs(r.s - 0.5) < 0.05 for r in rows)
    v = generators.random_vectors(spark, 1000, integers=True).agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    assert v.a == 99 or v.a < 99 and v.b < 200


@pytest.mark.parametrize(("w", "h", "c", "m"), [(1, 1, 1, 1), (5, 4, 1, 1), (7, 6, 3, 2), (3, 9, 2, 5)])
def test_blur(spark, w, h, c, m):
    rng = np.random.default_rng(w * h)
    images = {name: rng.integers(0, 256, (h, w, c)) for name in "ab"}
    rows = [(n, y, x, k, int(im[y, x, k])) for n, im in images.items() for y in range(h) for x in range(w) for k in range(c)]
    got = raster.box_blur(spark.createDataFrame(rows, "img string, y int, x int, c int, p int"), m).collect()
    assert len(got) == len(rows)
    for r in got:
        box = images[r.img][max(r.y - m, 0) : min(r.y + m, h), max(r.x - m, 0) : min(r.x + m, w), r.c]
        assert r.p == int(box.sum()) // box.size
    with pytest.raises(ValueError):
        raster.box_blur(spark.createDataFrame(rows, "img string, y int, x int, c int, p int"), 0)


def plain_pam(points, k, metric, tol=None, computed=False):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) if metric == "l2" else ((points[:, None] - points[None]) ** 2).sum(-1)
    medoids, cost, rounds = list(range(k)), d[:, :k].min(1).sum() if computed else math.inf, 0
    while True:
        rounds += 1
        best = min((d[:, medoids[:s] + [p] + medoids[s + 1 :]].min(1).sum(), s, p) for s in range(k) for p in range(len(points)) if p not in medoids)
        if best[0] >= cost or (tol and best[0] / cost > tol):
            return tuple(medoids), cost, rounds
        cost = best[0]
        medoids[best[1]] = best[2]


@pytest.mark.parametrize(("k", "metric", "tol", "initial"), [(1, "l2", None, "max"), (3, "l2", None, "max"), (2, "sqeuclidean", None, "max"), (3, "l2", 0.95, "max"), (2, "l2", None, "computed")])
def test_pam(spark, k, metric, tol, initial):
    points = np.random.default_rng(k).normal(size=(40, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id bigint, x double, y double")
    found = cluster.k_medoids(df, ["x", "y"], k, metric=metric, tol=tol, initial_cost=initial)
    medoids, cost, rounds = plain_pam(points, k, metric, tol, initial == "computed")
    assert found.medoids == medoids and found.rounds == rounds and found.cost == pytest.approx(cost)
    at = [points[m].tolist() for m in found.medoids]
    assert cluster.total_cost(df, ["x", "y"], at, metric).first().cost == pytest.approx(cost)
    assert [r.id for r in cluster.medoid_rows(df, ["x", "y"], found).collect()] == list(medoids)


def test_pam_edges(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(3)], "id bigint, x double")
    assert cluster.k_medoids(df, ["x"], 3) == cluster.Clustering((0, 1, 2), 0.0, 1)
    for k in (0, 4):
        with pytest.raises(ValueError):
            cluster.k_medoids(df, ["x"], k)
    twice = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 5.0), (3, 6.0)], "id bigint, x double")
    ids = {r.point for r in cluster.swap_costs(twice, ["x"], [0], [[0.0]], same_within=1e-12).collect()}
    assert ids == {2, 3}
    alike = spark.createDataFrame([(i, 1.0) for i in range(4)], "id bigint, x double")
    assert cluster.k_medoids(alike, ["x"], 2, initial_cost="computed", same_within=1e-12) == cluster.Clustering((0, 1), 0.0, 1)
    single = twice.select("id", F.col("x").cast("float").alias("x"))
    assert cluster.distance_matrix(single, ["x"], metric="sqeuclidean").schema["d"].dataType.typeName() == "float"
    assert cluster.assign(single, ["x"], [[0.1]], "sqeuclidean").schema["d"].dataType.typeName() == "float"
    assert cluster.k_medoids(single, ["x"], 2, metric="sqeuclidean").cost == 1.0
    same = spark.createDataFrame([(i, 1.0) for i in range(4)], "id bigint, x double")
    assert cluster.k_medoids(same, ["x"], 2).cost == 0
    assert cluster.assign(same, ["x"], [[1.0], [1.0]]).select("slot").distinct().first().slot == 0
    assert one(spark, scalar.array_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-100, 100)), min_size=1, max_size=20))
def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    for r in analytics.quantile_summary(df, ["k"], "v").collect():
        v = [x for k, x in rows if k == r.k]
        assert (r.min, r.max) == (min(v), max(v))
        assert [r.q10, r.median, r.q90] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.9]).tolist())


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_large_groups(spark, monkeypatch, accuracy):
    """Brackets are narrow, values repeat, groups are of all sizes, keys and values may be null."""
    monkeypatch.setattr(analytics, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [(k, float(rng.choice([rng.randrange(5), rng.randrange(10**6)]))) for k, n in (("a", 3000), ("b", 21), ("c", 2), ("d", 1), (None, 50)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("a", None), ("e", None)], "k string, v double").repartition(3)
    got = {r.k: r for r in analytics.quantile_summary(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None} and got["e"].median is None
    for k in set(got) - {"e"}:
        v = [x for g, x in rows if g == k]
        assert [got[k].q10, got[k].median, got[k].q90] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.9]).tolist())


def test_edges_of_groups(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 9), ("b", 2), (None, 1)) for i in range(n)], "k string, v int")
    got = sorted((r.k or "", r.v, r.from_first, r.from_last) for r in analytics.edges(df, ["k"], ["v"], 2, 3).collect())
    assert got == sorted([("a", 0, 1, 9), ("a", 1, 2, 8), ("a", 6, 7, 3), ("a", 7, 8, 2), ("a", 8, 9, 1), ("b", 0, 1, 2), ("b", 1, 2, 1), ("", 0, 1, 1)])


@pytest.mark.parametrize("d", [1, 5])
def test_swap_costs_by_plain_loops(spark, monkeypatch, d):
    """Blocks of any size, broadcast or not, more medoids than a GPU block would take."""
    rng = np.random.default_rng(d)
    pts = rng.normal(size=(30, d))
    coords = [f"c{j}" for j in range(d)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, " + ", ".join(f"{c} double" for c in coords))
    for size, most in ((2048, 1 << 26), (4, 0)):
        monkeypatch.setattr(cluster, "BLOCK_POINTS", size)
        monkeypatch.setattr(cluster, "BROADCAST_BYTES", most)
        for m in ([0], [3, 9, 1]):
            got = {(r.point, r.slot): r.cost for r in cluster.swap_costs(df, coords, m, pts[m].tolist()).collect()}
            assert set(got) == {(c, s) for c in range(30) if c not in m for s in range(len(m))}
            for (c, s), cost in got.items():
                now = [*m[:s], c, *m[s + 1 :]]
                assert cost == pytest.approx(np.sqrt(((pts[:, None] - pts[now][None]) ** 2).sum(2)).min(1).sum())
    matrix = cluster.distance_matrix(df, coords).cache()
    by_matrix, by_points = cluster.k_medoids_by_matrix(matrix, 3), cluster.k_medoids(df, coords, 3)
    assert by_matrix.cost == pytest.approx(by_points.cost)
    if d > 1:  # on a line, neighbours in the middle of an even group cost the same
        assert by_matrix.medoids == by_points.medoids


@pytest.mark.parametrize("metric", ["l2", "sqeuclidean"])
@pytest.mark.parametrize(("d", "k", "kind"), [(1, 1, "<f8"), (2, 3, "<f8"), (2, 3, "<f4"), (3, 1, "<f8"), (24, 3, "<f8")])
def test_bounds_of_swaps(d, k, kind, metric):
    """Bounds are below the costs, the cheapest swap is the one of all, and near points are not all priced."""
    rng = np.random.default_rng(d)
    for offset, copies in ((0.0, 1), (1000.0, 1), (0.0, 40)):
        pts = np.repeat(rng.normal(size=(2000 // copies, d)) + offset, copies, 0).astype(kind)
        pts = pts[cluster._neighbours(pts)]
        ids = rng.permutation(len(pts))
        swaps = cluster._Swaps(pts, pts[:k], metric)
        now = lambda c, s: np.concatenate([pts[:k][:s], c[None], pts[:k][s + 1 :]])
        costs = swaps.exact(pts)
        for i in (500, 1999):
            for s in range(k):
                assert costs[i, s] == pytest.approx(cluster._between(pts, now(pts[i], s), metric).min(1).sum(dtype=float), rel=1e-6)
        slack = swaps.slack(float(costs.max()))
        assert (swaps.screen(pts) <= costs + slack).all()
        for size in (*cluster.LEAVES, 1):
            cells = [np.arange(a, min(a + size, len(pts))) for a in range(0, len(pts), size)]
            for x, low in zip(cells, swaps.bounds([pts[x] for x in cells]), strict=True):
                assert (low <= costs[x] + slack).all()
        leaves = [np.arange(a, min(a + 128, len(pts))) for a in range(0, len(pts), 128)]
        # on a line, two points in the middle may cost the same: sums of one order decide
        want = min((swaps.price(pts[p], int(s)), int(s), int(ids[p])) for p, s in np.argwhere(costs <= costs.min() * (1 + 1e-12)))
        priced, exact = [], swaps.exact
        swaps.exact = lambda x: priced.append(len(x)) or exact(x)
        for limit in (np.inf, float(costs[::256].min()), want[0]):
            assert swaps.cheapest(ids, pts, leaves, limit) == want
        assert swaps.cheapest(ids, pts, leaves, want[0] * 0.9) is None
        if d < 4 and copies == 1 and offset == 0 and kind == "<f8":
            assert sum(priced[8:]) < 300  # of 2000, twice


@pytest.mark.parametrize(("d", "metric"), [(1, "l2"), (2, "sqeuclidean"), (16, "l2")])
def test_pam_of_many_points(spark, d, metric):
    """Several leaves a task, some of copies; the same medoids as when all swaps are priced."""
    points = np.random.default_rng(d).normal(size=(1500, d))
    points[700:1000] = points[700]
    coords = [f"c{j}" for j in range(d)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "id bigint, " + ", ".join(f"{c} double" for c in coords))
    found = cluster.k_medoids(df, coords, 2, metric=metric)
    medoids, cost, rounds = plain_pam(points, 2, metric)
    assert found.cost == pytest.approx(cost) and found.rounds == rounds
    assert [points[m].tolist() for m in found.medoids] == [points[m].tolist() for m in medoids]


def test_pam_with_known_costs_of_many_points(spark, monkeypatch):
    """From the first points' cost, without copies of medoids, and not by pricing all swaps."""
    points = np.random.default_rng(5).normal(size=(3000, 2))
    points[100:400] = points[1]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "id bigint, x double, y double")
    monkeypatch.setattr(cluster, "_swap_costs", None)  # which prices all of them
    found = cluster.k_medoids(df, ["x", "y"], 3, initial_cost="computed", same_within=2.2e-16)
    medoids, cost, rounds = plain_pam(points, 3, "l2", computed=True)
    assert found.medoids == medoids and found.rounds == rounds and found.cost == pytest.approx(cost)


def test_large_matrix_is_not_stored(spark, monkeypatch):
    """Up to a number of rows the matrix is stored, and deleted; beyond it nothing is, with the same result."""
    wrote, path = [], clusters.scratch_path
    monkeypatch.setattr(clusters, "scratch_path", lambda s, tag: wrote.append(path(s, tag)) or wrote[-1])
    small = registry.QUERIES["pam_matrix"](spark, "/root/testdata/sf0.001").collect()
    assert len(wrote) == 1 and not os.path.exists(wrote[0].removeprefix("file://"))
    monkeypatch.setattr(clusters, "STORED_ROWS", 100)
    assert registry.QUERIES["pam_matrix"](spark, "/root/testdata/sf0.001").collect() == small and len(wrote) == 1


def test_many_medoids(spark):
    df = spark.range(700).selectExpr("id", "cast(id as double) as x")
    found = cluster.k_medoids(df, ["x"], 600, max_iter=1000, tol=1e-9, initial_cost="computed")
    assert len(set(found.medoids)) == 600


def test_ratios_and_pivots(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 3.0), (None, 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", 4.0), ("z", 1.0), (None, 0.0)], "k string, v double")
    assert {r.k: r.ratio for r in analytics.ratio(a, b, ["k"], "v").collect()} == {"x": 0.5, "y": None, "z": None, None: None}
    twice = spark.createDataFrame([(1, "p", 1.0), (1, "p", 2.0)], "i int, c string, v double")
    with pytest.raises(Exception, match="duplicate"):
        analytics.pivot_unique(twice, ["i"], "c", "v", ["p"]).collect()
    with pytest.raises(ValueError):
        analytics.only_value(a, "k")
    assert analytics.only_value(a.filter("k = 'x'"), "v") == 2.0
    fast = spark.createDataFrame([("s", "base", 4.0), ("s", "new", 2.0), ("t", "new", 0.0)], "k string, kind string, v double")
    assert {(r.k, r.kind): r.speedup for r in analytics.speedup(fast, ["k"], "kind", "v", "base").collect()} == {("s", "base"): 1.0, ("s", "new"): 2.0, ("t", "new"): None}


def test_scalars(spark):
    cases = [
        (scalar.darken(F.lit("ff8000")), "#994c00"), (scalar.darken(F.lit("#000000")), "#000000"), (scalar.stem(F.lit("/a/b.c/d.tar.gz")), "d.tar"),
        (scalar.stem(F.lit("/a/.hidden")), ".hidden"), (scalar.without_prefix(F.lit("histogram_x"), "histogram_"), "x"), (scalar.microseconds(F.lit("1'234,500")), 1234.5),
        (scalar.passes(F.lit(1)), 0), (scalar.passes(F.lit(1024)), 1), (scalar.passes(F.lit(1025)), 2), (scalar.previous_power_of_two(F.lit(1)), 0),
        (scalar.previous_power_of_two(F.lit(64)), 32), (scalar.previous_power_of_two(F.lit(65)), 64), (scalar.shown_byte(F.lit(10)), "10"), (scalar.shown_byte(F.lit(65)), "A"),
        (scalar.clamp(F.lit(300), 0, 255), 255), (scalar.last_digit(F.lit("kernel7")), 7),
        (scalar.stamp(F.lit("2025-01-02 03:04:05.678").cast("timestamp")), "20250102-030405678"),
    ]
    for column, want in cases:
        assert one(spark, column) == want


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"2025-01-01 {h:02d}:{m:02d}:00", t) for (h, m), t in zip(itertools.product((1, 2, 3), (5, 50)), ["ab", "b", "é", None, "zz", "a"], strict=True)]
    df = spark.createDataFrame(rows, "ts string, t string").select(F.col("ts").cast("timestamp").alias("ts"), "t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windowed_byte_histogram(stream, "ts", "t", mapping="letter").writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windowed_byte_histogram(df, "ts", "t", mapping="letter")
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, want.collect()))


def test_rounded(spark):
    """A half of the product goes up, all else to the nearest; what cannot be scaled stays."""
    for x, digits, want in ((0.0, 6, 0.0), (0.5, 0, 1.0), (1.5, 0, 2.0), (2.5, 0, 3.0), (0.49999999999999994, 0, 0.0), (2.0140985, 6, 2.014098), (1.3647974999999999, 6, 1.364798), (1.7e308, 6, 1.7e308), (float("inf"), 6, float("inf"))):
        assert one(spark, scalar.rounded(F.lit(x), digits)) == want
    assert one(spark, F.isnan(scalar.rounded(F.lit(float("nan")), 6)))
    assert one(spark, scalar.rounded(F.lit(None).cast("double"), 6)) is None


def test_files_of_a_wide_matrix(spark, tmp_path):
    """A second side of more points than a Parquet page has rows: its ids take little beside the distances' 8 bytes."""
    points = spark.range(0, 30_000, 1, 1).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    points.write.parquet(f"{tmp_path}/points")
    matrix = cluster.distance_matrix(spark.read.parquet(f"{tmp_path}/points"), ["x", "y"]).filter("i < 20")
    matrix.write.parquet(f"{tmp_path}/matrix")
    got = spark.read.parquet(f"{tmp_path}/matrix")
    assert got.count() == got.select("i", "j").distinct().count() == 20 * 30_000
    assert sum(p.stat().st_size for p in (tmp_path / "matrix").glob("*.parquet")) < 10 * 20 * 30_000


@pytest.mark.parametrize("dims", [2, 64])
@pytest.mark.parametrize("cells", [2048, 2])
def test_whole_distance_matrix(spark, monkeypatch, dims, cells):
    """The rows of distance_matrix to the last bit, also of missing, infinite, repeated and unnamed points, and of leaves that are not full."""
    monkeypatch.setattr(cluster, "MOST_CELLS", cells)
    monkeypatch.setattr(cluster, "TASK_ROWS", 9000)
    coords = [f"x{k}" for k in range(dims)]
    x = np.random.default_rng(3).normal(size=(214, dims)).astype("<f4").astype(float).tolist()
    x[7][1], x[8][0], x[9][1], x[200] = float("inf"), float("nan"), None, x[100]
    rows = [(None if i == 11 else 50 if i == 12 else i, *p) for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in coords))
    for metric in ("l2", "sqeuclidean"):
        got, want = (f(points, coords, metric=metric) for f in (cluster.whole_distance_matrix, cluster.distance_matrix))
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_whole_distance_matrix_beyond_a_broadcast(spark, monkeypatch):
    points = spark.range(100).select(F.col("id").cast("string").alias("id"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    monkeypatch.setattr(cluster, "TASK_ROWS", 1000)
    few = sorted(map(tuple, cluster.whole_distance_matrix(points, ["x", "y"]).collect()))
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 100)
    assert len(few) == 100 * 100 and few == sorted(map(tuple, cluster.whole_distance_matrix(points, ["x", "y"]).collect()))
    assert cluster.whole_distance_matrix(points.filter("false"), ["x", "y"]).count() == 0


@pytest.mark.parametrize("name", ["distance_matrix", "distance_matrix_64"])
def test_files_of_the_distance_queries(spark, tmp_path, name):
    """All pairs take under 2 bytes a row of 24 where rounded distances fit a dictionary."""
    n = 2500
    x = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.xxhash64("vec_id", k) % 1000 / 4e4).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id")).select("vec_id", x.alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    registry.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/matrix")
    got = spark.read.parquet(f"{tmp_path}/matrix")
    assert got.count() == got.select("i", "j").distinct().count() == n * n
    assert sum(p.stat().st_size for p in (tmp_path / "matrix").glob("*.parquet")) < 2 * n * n
