"""The pipeline's near stage against all pairs' exact Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def plain(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept(rows):
    """Texts of the rows that stay, by all pairs."""
    sets, label = [plain(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for g, (d, t) in zip(label, rows, strict=True):
        row = (d is None, d or 0, t or "")
        best[g] = min(best.get(g, row), row)
    return sorted(best.values())


def planted(seed=1):
    """Texts, near copies on both sides of 0.8, and chains of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(40):
        text = [word() for _ in range(rng.randrange(60, 300))]
        rows.append(text)
        for _ in range(rng.randrange(4)):
            text = list(text)
            for _ in range(max(1, int(len(text) * rng.choice((0.01, 0.02, 0.03, 0.06))))):
                text[rng.randrange(len(text))] = word()
            rows.append(text)
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def got(out):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())


@pytest.mark.parametrize(("rounds", "block"), [(1, 512), (3, 3)])
def test_planted_near_copies(spark, monkeypatch, rounds, block):
    """With leaders, and without: buckets in blocks."""
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = planted()
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), DATA)
    assert got(out) == kept(rows) and len(kept(rows)) < len(rows)


def test_documents(docs):
    out = jaccard.drop_similar(docs)
    assert out.columns == docs.columns
    assert got(out) == kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_rows_have_their_own_identity(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (7, long + " end"), (7, "quite another text under the same id"), (None, long + " fin"), (None, "a text of its own"), (None, "one more of its own")]
    assert got(jaccard.drop_similar(spark.createDataFrame(rows, SCHEMA))) == kept(rows)
    assert len(kept(rows)) == 4


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    made, verify = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: made.append(pairs.count()) or verify(pairs, *a))
    out = jaccard.drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert [r.doc_id for r in out.select(F.col("doc_id")).collect()] == [0]
    assert sum(made) < 600 * jaccard.BANDS


def test_spanning_links():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64)) for _ in range(4)]
    sets = []
    for i in range(60):
        s = base[i % 4].copy()
        s[rng.integers(0, len(s), 9)] = rng.integers(0, 1 << 62, 9, dtype=np.uint64)
        sets.append(np.unique(s))
    fp = np.array([jaccard.fingerprint(s) for s in sets], np.uint64)
    sketch = np.stack([jaccard.bands(s)[1] for s in sets])
    label = np.arange(60)
    label[4::8] = label[4]
    links = jaccard._spanning(label, np.array([len(s) for s in sets]), fp, sketch, [s.tobytes() for s in sets], 0.8)
    assert all(jaccard.similar(sets[i], sets[j]) for i, j in links)
    of = {i: i for i in range(60)}
    for i, j in [*links, *((4, k) for k in range(4, 60, 8))]:
        of = {k: of[i] if x == of[j] else x for k, x in of.items()}
    assert len(set(of.values())) == 4 and len(links) < 60


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share half of their words are no near copies, and hardly ever candidates."""
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"{i}x{rng.randrange(10**6)}" for _ in range(55))])) for i in range(700)]
    made, verify = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: made.append(pairs.count()) or verify(pairs, *a))
    assert jaccard.drop_similar(spark.createDataFrame(rows, SCHEMA)).count() == 700
    assert sum(made) < 700


def test_empty(empty):
    assert jaccard.drop_similar(empty).count() == 0
