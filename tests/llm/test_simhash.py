"""Fingerprints, candidate search and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components


def plain_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    u = np.unique(np.array(fps, np.uint64))
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return {int(x): int(k) for x, k in zip(u, label, strict=True)}
        label = new


def check(rows, got):
    of = groups([f for _, f in rows])
    least = {}
    for d, f in rows:
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    assert Counter(got) == Counter((d, f, least.get(of[f])) for d, f in rows)


@pytest.mark.parametrize("name", ["edge", "docs"])
def test_near(request, name):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, plain_fp(r.text)) for r in df.collect()]
    got = simhash.mark_near(df).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
    check(rows, [(r.doc_id, int(r.h, 16), r.component_id) for r in got])
    assert all(re.fullmatch("[0-9a-f]{16}", r.h) for r in got)
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    assert kept.columns == df.columns
    of = groups([f for _, f in rows])
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min(((d is None, d) for d, f in rows if of[f] == g), default=None)[1] for g in set(of.values()))


def planted(n, seed=3):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            f ^= 1 << b
        fps.append(f)
    return fps


def test_probes_are_spread(spark):
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in set(planted(300))], "fp bigint")
    n = nodes.count()
    four = [simhash.Part(tuple(range(k, k + 16)), 0) for k in (0, 16, 32, 48)]
    rows = simhash.probes(nodes, four)
    assert rows.count() == 4 * n and rows.select("part", "key").distinct().count() > 2 * n
    one = simhash.probes(nodes, [simhash.Part(tuple(range(8)), 1), simhash.Part(tuple(range(8, 64)), -1)])
    assert one.count() == 9 * n and one.select("key").distinct().count() > 200


@pytest.mark.parametrize("parts", [None, [(0, 22, 1), (22, 43, 0), (43, 64, 0)], [(0, 32, 1), (32, 64, 1)], [(0, 12, 2), (12, 64, 0)]])
def test_every_group_is_found(spark, monkeypatch, parts):
    fps = planted(300)
    if parts:
        fixed = [simhash.Part(tuple(range(a, b)), t) for a, b, t in parts]
        monkeypatch.setattr(simhash, "plan", lambda *_: fixed)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp bigint")
    got = {r.node % (1 << 64): r.root for r in components(simhash.links(nodes)).collect()}
    of = groups(fps)
    sizes = Counter(of.values())
    assert set(got) == {f for f in of if sizes[of[f]] > 1}
    assert len({(of[f], r) for f, r in got.items()}) == len({of[f] for f in got}) == len(set(got.values()))


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | set(planted(50))
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    got = {r.node % (1 << 64): r.root for r in components(simhash.links(nodes)).collect()}
    of = groups(list(fps))
    sizes = Counter(of.values())
    assert set(got) == {f for f in of if sizes[of[f]] > 1}
    assert len({(of[f], r) for f, r in got.items()}) == len(set(got.values()))


def test_thresholds_hold_the_principle():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 64))
    x[:, 1] = x[:, 0]  # correlated bits share a part
    for n in (10, 10**4, 10**6, 10**8, 10**10):
        parts = simhash.plan(n, (x.T @ x) / 2000 * n, 3)
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
        assert sum(p.threshold for p in parts) == 3 - len(parts) + 1
        assert any({0, 1} <= set(p.bits) for p in parts)


def test_parts_and_thresholds_are_unequal_where_bits_are(spark):
    """Copies of one bit say nothing: their part is wider, or its threshold larger."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 1:24] = x[:, :1]
    x[:, 40:] = rng.random((4000, 24)) < 0.04
    parts = simhash.plan(10**6, (x.T @ x) / 4000 * 10**6, 3)
    assert len({(len(p.bits), p.threshold) for p in parts}) > 1
    assert sorted(b for p in parts for b in p.bits) == list(range(64)) and sum(p.threshold for p in parts) == 3 - len(parts) + 1
    agree = simhash._agreement(4000, x.T @ x)
    for m in (2, 3, 4):
        wide = simhash.group_bits(agree, m, True)
        info = [simhash._information(agree, p) for p in wide]
        assert sorted(b for p in wide for b in p) == list(range(64)) and len({len(p) for p in wide}) > 1
        assert max(info) - min(info) < max(simhash._information(agree, p) for p in simhash.group_bits(agree, m)) * 1.5
    fps = {int(sum(int(b) << i for i, b in enumerate(r))) for r in x[:300]} | set(planted(50))
    got = {r.node % (1 << 64): r.root for r in components(simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint"))).collect()}
    of = groups(list(fps))
    sizes = Counter(of.values())
    assert set(got) == {f for f in of if sizes[of[f]] > 1} and len({(of[f], r) for f, r in got.items()}) == len(set(got.values()))


def test_rows_have_their_own_identity(spark):
    a, b = " ".join(f"w{i}" for i in range(90)), "quite another text under the same id, and a good deal longer than a few words"
    rows = [(1, a, 5), (2, a, 6), (2, b, 7), (None, b, 8), (None, "a text of its own", 9), (None, a, 10), (1, a, 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int")
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    assert sorted((r.text, r.doc_id or 0) for r in kept.collect()) == sorted([(a, 1), (b, 2), ("a text of its own", 0)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=4), st.data())
def test_bucket_links_span(bases, data):
    fps = [b ^ (1 << data.draw(st.integers(0, 63))) for b in bases for _ in range(30)]
    u, v = simhash._bucket_links(np.array(fps, np.uint64), 3)
    of = groups(fps)
    assert all(of[a] == of[b] for a, b in zip(u.tolist(), v.tolist(), strict=True))
    assert len(u) == len(of) - len(set(of.values()))


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    mesh = [(rng.randrange(2000, 2040), rng.randrange(2000, 2040)) for _ in range(30)]
    links = chain + star + mesh + [(5, 5)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def test_empty(empty):
    assert simhash.mark_near(empty).count() == 0
    assert simhash.drop_near(empty).count() == 0


def test_words_per_shingle_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    one, three = (simhash.mark_near(df, words=k).select(F.col("fp")).first().fp for k in (1, 3))
    assert one != three
