"""Sharding, exact dedup, line dedup and quality rules against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import drop_exact, mark_exact
from tessera.llm.line_dedup import mark_lines
from tessera.llm.quality import judge, measures
from tessera.llm.queries import SHARES
from tessera.llm.sharding import shard_documents

WS = " \t\n\x0b\x0c\r"


def both(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(params=["edge", "docs"])
def table(request):
    return both(request)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_shard(key, weights, salt=0):
    """The plain maximum of weighted scores; Spark hashes a number as its little-endian bytes, seeded by the hash before it."""
    k = xxhash.xxh64_intdigest((str(key) if key is not None else "\0null").encode(), 42)
    k = xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), k)
    scores = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42))
        scores.append((-w / math.log(((h >> 11) + 0.5) / (1 << 53)), s))
    return max(scores)[1]


@pytest.mark.parametrize(("weights", "more"), [(SHARES[:40], SHARES[40]), ([1.0] * 40, None), ([0.1] * 3, None), ([2.5], 0.5)])
def test_shards(table, weights, more):
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(table))
    got = shard_documents(table, weights, next_weight=more).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    grown = [*weights, sum(weights) / len(weights) if more is None else more]
    for r in got:
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, weights), plain_shard(r.doc_id, grown))
        assert r.grown_shard in (r.shard, len(weights))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in shard_documents(df, [1.0, 3.0]).collect())
    assert 0.72 < n[1] / 20000 < 0.78
    assert {r.shard for r in shard_documents(df.limit(10), [2.0]).collect()} == {0}
    with pytest.raises(ValueError):
        shard_documents(df, [1.0, 0.0])


def test_exact(table):
    rows = rows_of(table)
    norm = lambda t: "".join(c for c in t or "" if c not in WS)
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    got = mark_exact(table).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g)
        assert r.keep_id == min(g)[2]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by_sha))
    kept = drop_exact(table)
    assert kept.columns == table.columns
    assert Counter(d for d, _ in rows_of(kept)) == Counter(min(g)[2] for g in groups.values())


def test_a_full_filter_changes_nothing(monkeypatch, docs):
    """Few bits for many repeats: more rows are compared, the result is the same."""
    from tessera.llm import exact_dedup

    twice = docs.union(docs.selectExpr("doc_id + 1000000", "text", "lang", "source", "n_chars"))
    want = sorted(map(tuple, mark_exact(twice).collect()))
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64 * exact_dedup.WORDS_IN_BLOCK)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64 * exact_dedup.WORDS_IN_BLOCK)
    monkeypatch.setattr(exact_dedup, "PLACES", 1 << 4)
    assert sorted(map(tuple, mark_exact(twice).collect())) == want
    assert drop_exact(twice).count() == drop_exact(docs).count()


def test_filter_lets_through_what_repeats(spark):
    from tessera.llm.exact_dedup import possibly_repeated, repeat_filter

    keys = spark.range(20000).selectExpr("cast(cast(if(id % 10 = 0, id div 20, 1000000 + id) as string) as binary) as k", "id")
    filter_, bits = repeat_filter(keys, "k")
    again = {r.id for r in keys.filter(possibly_repeated(F.col("k"), filter_, bits)).collect()}
    repeats = {i for i in range(20000) if i % 10 == 0}
    assert repeats <= again and len(again - repeats) < 200


def test_lines(table):
    rows = rows_of(table)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WS))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or d == max(held[key(x)], key=lambda y: (y is not None, y))]
        want[d, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in mark_lines(table).collect()) == want


def test_quality(table):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(table).collect()
    )
    want = Counter()
    for d, t in rows_of(table):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.strip(WS):
                dup += x in seen
                seen.add(x)
        n = len(w)
        want[d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n] += 1
    assert got == want


def test_quality_drops_outliers_of_their_group(spark):
    plain = [(i, " ".join(f"w{(i * 7 + j * j) % 97}x{j}" for j in range(80)), "en", "a") for i in range(200)]
    odd = [(900, " ".join(f"{'y' * 60}{j}" for j in range(80)), "en", "a")]
    df = spark.createDataFrame(plain + odd, "doc_id bigint, text string, lang string, source string")
    assert [r.doc_id for r in judge(df).filter("not kept").collect()] == [900]


def test_quality_leans_on_own_rows_as_they_grow(spark):
    """A group whose words are long: the more rows it has, the longer a word that it keeps."""

    def text(i, size):
        return " ".join(f"{'z' * size}{(i * 7 + j * j) % 89:02d}" for j in range(60))

    def kept(n):
        rows = [(i, text(i, 3), "en", "a") for i in range(400)] + [(1000 + i, text(i, 12), "en", "b") for i in range(n)]
        odd = [(5000 + size, text(size, size), "en", "b") for size in (30, 36, 42)]
        df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, source string")
        return {r.doc_id: r.kept for r in judge(df).filter("doc_id >= 1000").collect()}

    few, some, many = kept(3), kept(12), kept(300)
    assert [sum(x[5000 + size] for size in (30, 36, 42)) for x in (few, some, many)] == sorted(sum(x[5000 + size] for size in (30, 36, 42)) for x in (few, some, many))
    assert not few[5036] and many[5036] and not many[5042]
    assert all(many[1000 + i] for i in range(300)) and all(some[1000 + i] for i in range(12))


def test_measures_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c a b c", 5, "x", 7, 9)], "doc_id int, text string, _body int, _w string, __g int, n_words int")
    row = measures(df).first().asDict()
    assert (row["_body"], row["_w"], row["__g"], row["n_words"], row["n_repeat_words"]) == (5, "x", 7, 6, 6)


def test_empty(empty):
    for f in (mark_exact, drop_exact, mark_lines, judge, lambda df: shard_documents(df, [1.0])):
        assert f(empty).count() == 0
