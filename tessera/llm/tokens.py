"""Batch encoding with the tokenizers library, each distinct stretch of text once.

A byte-level BPE with the common splitting pattern never joins what the
pattern parts. Text in plain letters is parted into words here, and the
library's model encodes each distinct word once. Other text is cut at spaces
that a non-space character follows, where the pattern always parts, and the
library encodes each distinct cut once. Bounded memos in the worker process
serve the rest. Added tokens, such as the end of a text, are what the library
makes of them: a text is parted at them first. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_CUT = re.compile(r" (?=\S)").split
_NOT_ALL_SPACES_CUT = re.compile(r" (?!\S)").search
#: Entries that each of a worker's two memos may hold, and the longest cut that it keeps. About 150 bytes each.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
#: Cuts that the library gets in one text.
JOINED_CUTS = 2048
#: Text in Latin letters and common punctuation, whose classes no Unicode version changes, and no white space but spaces and line ends.
_PLAIN = re.compile("[\n\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u205e]*").fullmatch
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: What the common splitting pattern makes of such text.
_WORDS = re.compile(f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+").findall


def _byte_alphabet() -> dict[int, str]:
    """The character that spells each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(other)}


_SPELLED = _byte_alphabet()


def cuts_of(text: str) -> list[str]:
    """The text parted at spaces that a non-space character follows, without those spaces."""
    return _CUT(text) if _NOT_ALL_SPACES_CUT(text) else text.split(" ")


class Encoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes each, as the library's ``encode`` does.

    With ``special_as_text`` a special token's name in a text is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        added = [t for t in spec.get("added_tokens", []) if not (special_as_text and t["special"])]
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self._at_added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = bool(
            spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and simple
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)  # byte-level tokens spell a byte as a character
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in done]

    def _cut_ids(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut with its space in front."""
        return self._joined([" " + x for x in cuts])

    def _joined(self, led: list[str]) -> list[bytes]:
        """Ids of texts that begin with a cut; the library gets many at once, which the ids' byte lengths part again."""
        out: list[bytes] = []
        for a in range(0, len(led), JOINED_CUTS):
            some = led[a : a + JOINED_CUTS]
            ids = np.frombuffer(self._library(["".join(some)])[0], f"<u{self.width}")
            ends = np.cumsum([len(x.encode()) for x in some])
            upto = np.cumsum(self.token_bytes[ids])
            parts = np.searchsorted(upto, ends)
            if parts[-1] >= len(upto) or (upto[parts] != ends).any():
                out += self._library(some)  # a token crosses cuts: this tokenizer is not of the kind, or changes bytes
                continue
            data, at = ids.tobytes(), [0, *((parts + 1) * self.width).tolist()]
            out += [data[x:y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a word of plain text by the library's model alone."""
        spelled = word.encode().decode("latin-1").translate(_SPELLED)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _plain_text(self, text: str) -> bytes:
        words = _WORDS(text)
        ids = list(map(self.words.get, words))
        if None in ids:
            fresh: dict[str, bytes] = {}
            for i, x in enumerate(ids):
                if x is None:
                    w = words[i]
                    if w not in fresh:
                        fresh[w] = self._word(w)
                    ids[i] = fresh[w]
            if len(self.words) < MEMO_ENTRIES:
                self.words.update((w, x) for w, x in fresh.items() if len(w) <= MEMO_CHARS)
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        if not self.cuts:
            return self._library(texts)
        if any(name in t for name in self.added for t in texts):
            return self._between_added(texts)
        return self._encode_parts(texts)

    def _between_added(self, texts: list[str]) -> list[bytes]:
        """Texts with added tokens: what stands between them is encoded on its own."""
        split = [self._at_added.split(t) for t in texts]
        parts = iter(self._encode_parts([x for p in split for x in p[::2]]))
        size = self.width
        return [b"".join(self.added[x].to_bytes(size, "little") if k % 2 else next(parts) for k, x in enumerate(p)) for p in split]

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        out = [self._plain_text(t) if _PLAIN(t) else None for t in texts]
        if None in out:
            rest = iter(self._by_cuts([t for t, x in zip(texts, out, strict=True) if x is None]))
            out = [next(rest) if x is None else x for x in out]
        return out

    def _by_cuts(self, texts: list[str]) -> list[bytes]:
        split = [cuts_of(t) for t in texts]
        heads = self._library([p[0] for p in split])
        memo = self.memo
        found = [list(map(memo.get, p[1:])) for p in split]
        fresh: dict[str, bytes] = {}
        for p, ids in zip(split, found, strict=True):
            if None in ids:
                fresh.update((x, b"") for x, y in zip(p[1:], ids, strict=True) if y is None)
        if fresh:
            fresh = dict(zip(fresh, self._cut_ids(list(fresh)), strict=True))
            for p, ids in zip(split, found, strict=True):
                if None in ids:
                    ids[:] = [fresh[x] if y is None else y for x, y in zip(p[1:], ids, strict=True)]
            # early entries tend to be the frequent ones: beyond the bound, no more come in
            if len(memo) < MEMO_ENTRIES:
                memo.update((x, y) for x, y in fresh.items() if len(x) <= MEMO_CHARS)
        return [h + b"".join(ids) for h, ids in zip(heads, found, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
