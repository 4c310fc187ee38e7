"""The batched Viterbi against the library's unigram search, a plain search, and round trips."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentencepieces as S

MODEL = S.default_model()


def fields(data):
    """(field, wire, value, start, end) of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        key = shift = 0
        while True:
            b = data[at]
            key |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                break
        n = {0: None, 1: 8, 5: 4}.get(key & 7, -1)
        if n in (None, -1):
            v = shift = 0
            while True:
                b = data[at]
                v |= (b & 127) << shift
                at, shift = at + 1, shift + 7
                if b < 128:
                    break
            if n == -1:
                yield key >> 3, key & 7, data[at : at + v], start, at + v
                at += v
            else:
                yield key >> 3, 0, v, start, at
        else:
            yield key >> 3, key & 7, data[at : at + n], start, at + n
            at += n


@pytest.fixture(scope="module")
def unigram():
    """The same vocabulary with the model type set to unigram, so that the library searches as we do."""
    data = open(MODEL, "rb").read()
    out = bytearray(data)
    for field, _, value, _, end in fields(data):
        if field == 2:
            for f, _, v, s, e in fields(value):
                if f == 3:
                    assert v == 2
                    out[end - len(value) + e - 1] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in S.loaded(MODEL).encode(texts)]


def test_library_agrees(unigram, docs):
    """The best path of the library's lattice has our path's score (paths of equal scores are as good)."""
    words = sorted({w for r in docs.limit(100).collect() for w in (r.text or "").split()[:8]})
    words += ["two  spaces here", "antidisestablishmentarianism", "x" * 40, "internationalization of the"]
    score = lambda x: sum(map(unigram.get_score, x))
    for w, got in zip(words, ids(words), strict=True):
        best = max(unigram.nbest_encode(w, nbest_size=8, out_type=int), key=score)
        assert score(got) == score(best), w
        assert unigram.decode(got) == w
    for w in ["日本語 テキスト é 😀🙃", "tab\there", "\u0378"]:  # characters without a piece become bytes
        assert unigram.decode(ids([w])[0]) == w


def test_small_vocabulary_is_searched_fully():
    rng = random.Random(3)
    vocabulary = ["<unk>"] + sorted({"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(25)} - {"a", "▁"})
    scores = [0.0] + [-float(rng.randrange(1, 12)) for _ in vocabulary[1:]]
    sp = S.Pieces(vocabulary, scores, [False] + [True] * (len(vocabulary) - 1))
    of = dict(zip(vocabulary[1:], scores[1:], strict=True))
    for n in range(1, 9):
        for w in map("".join, itertools.islice(itertools.product("abx", repeat=n), 0, None, max(1, 3**n // 60))):
            best = -np.inf
            for cuts in itertools.product([0, 1], repeat=n - 1):
                parts, last = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(w[last:i])
                        last = i
                if all(p in of or len(p) == 1 for p in parts):
                    best = max(best, sum(of.get(p, sp.unknown_score) for p in parts))
            for got in (sp.viterbi([w])[0], sp.plain(w)):
                total, rest = 0.0, w
                for i in np.frombuffer(got, "<u4").tolist():
                    if i:
                        assert rest.startswith(vocabulary[i])
                        total, rest = total + scores[i], rest[len(vocabulary[i]) :]
                    else:  # unknown characters in a row are one id
                        break
                else:
                    assert rest == "" and total == best
            assert sp.viterbi([w])[0] == sp.plain(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_round_trip(texts):
    sp = S.loaded(MODEL)
    # a lone leading mark of a space is the one thing that the text form can't tell from a space
    texts = [t.replace(S.SPACE, " ") for t in texts]
    assert [sp.decode(np.array(x, np.int64)) for x in ids(texts)] == texts


def test_long_and_short_words_agree():
    sp = S.loaded(MODEL)
    for w in ("▁the", "▁" + "internationalization" * 3, "é😀" * 20, "▁▁▁x"):
        assert sp.viterbi([w])[0] == sp.plain(w)


@pytest.mark.parametrize(("chunk", "chunks"), [(256, 512), (8, 3), (3, 2)])
def test_chunks_change_nothing(monkeypatch, chunk, chunks):
    """Words of both sides of a chunk's length, many at once; scores whole and not."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "CHUNKS", chunks)
    rng = random.Random(chunk)
    made = sorted({"".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 7))) for _ in range(60)} - {"b"})
    for sp in (S.loaded(MODEL), S.Pieces(["<unk>", *made], [0.0, *(-rng.random() * 9 for _ in made)], [False] + [True] * len(made))):
        words = ["".join(rng.choice("ab▁éthein日😀") for _ in range(n)) for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 511, 512, 513, 1700)]
        assert sp.chunked(words) == [sp.plain(w) for w in words]
        fresh = [w + "x" * i for i, w in enumerate(words)]
        texts = [w.replace(S.SPACE, " ") for w in fresh]
        assert sp.encode(texts) == [b"".join(sp.plain(w) for w in S._WORDS(sp.normalize(t))) for t in texts]


def test_a_long_text_without_spaces():
    sp = S.loaded(MODEL)
    text = "".join(random.Random(4).choices("internationalization日本語テキスト0123456789", k=1 << 20))
    began = time.perf_counter()
    got = sp.encode([text])[0]
    assert time.perf_counter() - began < 30
    assert sp.decode(np.frombuffer(got, "<u4")) == text


@pytest.mark.parametrize("name", ["edge", "docs"])
def test_documents(request, name):
    df = request.getfixturevalue(name)
    encoded = S.encode_documents(df, MODEL)
    back = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in S.decode_documents(encoded, MODEL).collect())
    assert back == sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())
    nulls = encoded.limit(2).selectExpr("doc_id", "cast(null as binary) as ids")
    assert all(r.text is None for r in S.decode_documents(nulls, MODEL).collect())
    crc = sorted((zlib.crc32(r.ids), len(r.ids) // 4) for r in encoded.collect())
    got = S.round_trips(df, MODEL).collect()
    assert all(r.round_trip for r in got) and sorted((r.ids_crc32, r.n_ids) for r in got) == crc


def test_empty(empty):
    assert S.round_trips(empty, MODEL).count() == S.encode_documents(empty, MODEL).count() == 0
