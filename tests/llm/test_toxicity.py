"""The automaton against plain edit distance, the scores by held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import toxicity
from tessera.llm.fuzzy import Lexicon, budget


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = ["abc", "abcab", "bcabca", "aabbccaab", "caca", "bbbbbbbbbb"]


@settings(max_examples=500, deadline=None)
@given(st.text("abcx", max_size=12))
def test_automaton(word):
    want = min(((d, t) for t in TERMS if (d := distance(word, t)) <= budget(t)), default=None)
    got = Lexicon(TERMS).match(word)
    assert got == (want and (want[1], want[0]))


def test_stems():
    lex = Lexicon(["clown"], ["trol"])
    assert lex.match("trolling") == ("trol", 0)
    assert lex.match("clwn") == ("clown", 1)
    assert lex.match("trl") is None
    assert lex.match("") is None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    bad = ["nincompoop", "blockhead", "scoundrel", "grubworm"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 7)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) if rng.random() < 0.7 else "grimb" + rng.choice(words))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels), toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_held_out_accuracy(corpus):
    docs, _, labels, model = corpus
    got = toxicity.score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in out) / len(out) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_misspelling_and_quotation(corpus):
    *_, model = corpus
    plain = "you nincompoop and blockhead, such a scoundrel of a man " * 2
    assert model.score(plain) > 0.9
    assert model.score(plain.replace("nincompoop", "nincompop").replace("blockhead", "blokhead")) > 0.7
    quoted = 'she said "you nincompoop and blockhead" and left the room after that '
    assert model.score(quoted) < model.score(quoted.replace('"', ""))
    assert model.score("") < 0.5


def test_misspelled_words_of_a_stem(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    forms = ["blorgus", "blorgusen", "blorgustic"]
    rows = [(i, " ".join([*rng.choices(words, k=30), *([forms[i // 5 % 3]] * 3 if i % 5 == 0 else [])])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id bigint, toxic int"))
    assert any(f.startswith(s) for s in model.stems for f in forms)
    for word in ("b1orgus", "blrgusen", "1lorgustik"):
        assert 0 < model.hit(word) < model.hit("blorgus")
    assert model.hit("blorgusing") == model.hit("blorgus")


def plain_score(model, text, known):
    """A document's score with every word held against every term, quotations and windows by plain loops."""
    low = (text or "").lower()
    worth = known
    for w in set(re.findall(r"[^\W_]+", low)) - known.keys():
        worth[w] = 0.0
        stems = [s for s in model.stems if w.startswith(s)]
        near = [(d, t) for t in model.terms if abs(len(t) - len(w)) <= budget(t) and (d := distance(w, t)) <= budget(t)]
        if stems:
            worth[w] = model.stems[min(stems, key=len)]
        elif near and not (min(near)[0] and w in model.harmless):
            worth[w] = model.terms[min(near)[1]] * toxicity.FUZZY_WORTH ** min(near)[0]
    quoted, hits, n = 0.0, [], 0
    inside = set()
    for marks in ('""', "“”", "«»", "„“", "„”", "‘’"):
        for line in re.finditer(r"[^\n]*", low):
            at = 0
            while (a := line[0].find(marks[0], at)) >= 0 and (b := line[0].find(marks[1], a + 1)) >= 0:
                if marks[0] != marks[1]:
                    a = line[0].rfind(marks[0], 0, b)
                inside.update(range(line.start() + a + 1, line.start() + b))
                at = b + 1
    for n, m in enumerate(re.finditer(r"[^\W_]+", low), 1):
        x = worth.get(m[0], 0.0)
        if m.start() in inside:
            quoted += x
        elif x:
            hits.append((n, x))
    total = sum(x for _, x in hits)
    dense = max((sum(x for b, x in hits if a <= b <= a + toxicity.WINDOW) for a, _ in hits), default=0.0)
    measures = [1.0, math.log1p(total), math.log1p(quoted), math.log1p(dense), math.log1p(100 * total / n) if n else 0.0]
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, measures, strict=True))))


def test_scores_by_plain_loops(spark, edge, corpus):
    _, _, _, model = corpus
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert own.terms
    known, known_own = {}, {}
    tries = ['he said "nincompop, grimbaz" and «blockhed» then „scoundrel“ went', "nincompoop " * 30, '"' + "x " * 300 + 'nincompoop"', '"open nincompoop\nend"', "‘a ‘grubworm’ b’"]
    texts = [*tries, *(r.text for r in corpus[0].limit(60).collect()), *(r.text for r in edge.collect())]
    for text in texts:
        assert model.score(text or "") == pytest.approx(plain_score(model, text, known), abs=1e-9), text[:80]
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, own).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(plain_score(own, r.text, known_own), abs=1e-9)


def test_lexicon_by_plain_counts(corpus):
    docs, _, labels, model = corpus
    seen = {r.text: labels[r.doc_id] for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows, counts = Counter(seen.values()), {0: Counter(), 1: Counter()}
    for text, toxic in seen.items():
        counts[toxic].update(set(text.split()))
    want = {}
    for w, t in counts[1].items():
        p, q = (t + 0.5) / (rows[1] + 1), (counts[0][w] + 0.5) / (rows[0] + 1)
        mean = (t + counts[0][w]) * rows[1] / (rows[0] + rows[1])
        chance = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(t))
        if t >= max(3, 0.01 * rows[1]) and p >= 10 * q and chance < 1e-4:
            want[w] = math.log(p / q)
    assert set(model.terms) == set(want)
    top = max([*want.values(), *(x * want[w] / model.terms[w] for w in want for x in model.stems.values())])
    assert all(model.terms[w] == pytest.approx(want[w] / top) for w in want)


def test_chance():
    for a, mean in ((3, 0.2), (10, 2.5), (40, 21.0), (100, 60.0)):
        want = 1 - math.fsum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(a))
        assert toxicity._chance(a, mean) == pytest.approx(want, rel=1e-4)
    assert toxicity._chance(5000, 2550) < 1e-300 and toxicity._chance(1800, 1000) < 1e-90
    assert 1e-3 < toxicity._chance(5100, 5000) < 0.2 and toxicity._chance(5000, 5000) == 1.0 and toxicity._chance(1, 0.0) == 0.0


def test_a_large_lexicon_keeps_all_terms(spark):
    """Thousands of terms, each in a share of the toxic rows."""
    terms = [f"zq{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2600)]
    rows = [(i, " ".join([*terms[i % 2 :: 2], f"x{i}"]) if i < 60 else f"a clean text of its own {i}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 60)) for i in range(240)], "doc_id bigint, toxic int"))
    assert set(terms) <= set(model.terms)


def test_states_are_bounded(monkeypatch):
    from tessera.llm import fuzzy

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 12)))
    terms, words = [word() for _ in range(200)], [word() for _ in range(1500)]
    whole = Lexicon(terms)
    want = [whole.match(w) for w in words]
    monkeypatch.setattr(fuzzy, "MAX_STATES", 50)
    small = Lexicon(terms)
    assert [small.match(w) for w in words] == want and any(want)
    assert len(small._states) <= 50 + 12 < len(whole._states)


def test_rows_of_all_kinds(spark, edge, empty, corpus):
    _, labels, _, model = corpus
    got = toxicity.score_documents(edge, model).collect()
    assert len(got) == edge.count() and not any(r.predicted for r in got)
    assert toxicity.drop_toxic(edge, model).columns == edge.columns
    assert toxicity.score_documents(empty, model).count() == toxicity.drop_toxic(empty, model).count() == 0
    nothing = toxicity.learn(edge, labels.limit(0))
    assert not nothing.terms and {r.predicted for r in toxicity.score_documents(edge, nothing).collect()} == {0}
    assert not toxicity.learn(empty, labels).terms
