"""Records, packing and the encoder against plain uses of the tokenizers library."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, records, tokens
from tessera.llm.crc32c import _plain, crc32c

PATH = records.default_tokenizer()
ENCODERS = {flag: tokens.Encoder(PATH, flag) for flag in (False, True)}
LIBRARY = {flag: Tokenizer.from_file(PATH) for flag in (False, True)}
LIBRARY[True].encode_special_tokens = True


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def want(df, plain):
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(d, [*plain(t), 0]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abdsQÄß1 '\n\t\x1c\x85  　é😀.s<|>endoftext"), max_size=30) | st.text(max_size=30), max_size=6))
def test_cuts_change_nothing(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    got = tokens.encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_are_the_librarys():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b \t<|endoftext|>é　x", "<|endoftext|", "plain"]
    t = Tokenizer.from_file(PATH)
    got = [np.frombuffer(g, "<u2").tolist() for g in tokens.encoder(PATH).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [31373, 220, 50256, 995]


def test_plain_classes():
    for c in map(chr, range(0x2100)):
        if tokens._PLAIN(c):
            for own, full in ((tokens._LETTERS, r"\p{L}"), (tokens._NUMBERS, r"\p{N}")):
                assert bool(re.fullmatch(f"[{own}]", c)) == bool(regex.fullmatch(full, c)), hex(ord(c))
            assert c.isspace() == (c in " \n")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("adsrevltmQ\u00c4\u00df1\u00b2 '\n.-\u2019\u2014<|>"), max_size=40), max_size=5))
def test_words_change_nothing(texts):
    t = LIBRARY[False]
    assert all(map(tokens._PLAIN, texts))
    got = tokens.encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_memo_is_bounded(monkeypatch, plain):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    enc = tokens.Encoder(PATH)
    for i in range(5):
        text = " ".join(f"w{i}x{j}" for j in range(10)) + ("\t" if i % 2 else "")
        assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == plain(text)
        assert len(enc.memo) <= 12 and len(enc.words) <= 40  # the bound and one batch


def test_crc32c():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 8, 255, 256, 257, 511, 512, 513, 5000)]
    n = np.array([len(p) for p in parts])
    assert crc32c(b"".join(parts), np.cumsum(n) - n, n).tolist() == [_plain(p) for p in parts]
    assert _plain(b"123456789") == 0xE3069283


@pytest.mark.parametrize("name", ["edge", "docs"])
def test_records(request, spark, plain, name):
    df = request.getfixturevalue(name)
    manifest = records.write_records(df, PATH)
    rows, start = [], 0
    for d, ids in want(df, plain):
        rows.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    got = records.read_digests(spark, manifest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == rows
    back = Counter((k, tuple(ids.tolist())) for k, ids in records.shuffled(manifest, 5))
    assert back == Counter((d, tuple(ids)) for d, ids in want(df, plain))


def test_damage_is_found(spark, edge, tmp_path):
    manifest = records.write_records(edge, PATH, f"file://{tmp_path}/r", files=1)
    path = manifest[0]["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    for at in (3, 9, 20, len(data) - 1):
        data[at] ^= 1
        open(path, "wb").write(data)
        with pytest.raises((records.CorruptRecord, IndexError)):
            list(records.read_file(path))
        data[at] ^= 1
    open(path, "wb").write(data)
    assert sum(1 for _ in records.read_file(path)) == manifest[0]["records"]
    assert not [f for f in os.listdir(tmp_path / "r") if f.startswith("_trial")]


@pytest.mark.parametrize(("name", "max_len"), [("edge", 2048), ("edge", 16), ("docs", 2048)])
def test_packing(request, plain, name, max_len):
    df = request.getfixturevalue(name)
    got = packing.pack_documents(df, max_len, PATH).collect()
    expected = Counter()
    for d, ids in want(df, plain):
        at, stop, piece = 0, (len(ids) - 1) % max_len + 1, 0
        while at < len(ids):
            expected[d, piece, at, stop - at, crc(ids[at:stop])] += 1
            at, stop, piece = stop, stop + max_len, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
        total += at
    assert len(inside) <= -(-total // max_len) * 1.02 + 1
    for s in packing.sequences(packing.pack_documents(df, max_len, PATH)).collect():
        assert len(s.ids) == 4 * s.length and s.n_pieces == len(inside[s.sequence_id])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), max_size=12))
def test_plans_use_every_piece_once(counts):
    used = Counter()
    recipes = packing.plan(counts, 24)
    for k, lengths in recipes:
        assert k > 0 and sum(lengths) <= 24
        for x in lengths:
            used[x] += k
    assert used == Counter(counts)
    for x, (first, _, _) in packing.places(recipes).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < counts[x]


def test_complements_fill_exactly():
    for counts, n in (({10: 5, 14: 5}, 5), ({12: 4}, 2), ({9: 3, 8: 3, 7: 3}, 3), ({9: 2, 5: 6}, 2)):
        assert sum(k for k, _ in packing.plan(counts, 24)) == n


def test_empty(spark, empty):
    assert records.write_records(empty, PATH) == []
    assert records.read_digests(spark, []).count() == 0
    assert packing.pack_documents(empty).count() == 0
