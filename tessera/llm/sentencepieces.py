"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

The normalised text is cut into words (runs of ``▁`` with what follows), each
distinct word once. Words of equal length advance together: rolling hashes of
all their substrings probe the sorted hashes of the pieces of that length, and
vectorised maxima of score sums store backpointers. Ties go to the longest
last piece. The search maximises the sum of piece scores
(the unigram objective) for any vocabulary that it is given.

Long words, such as text without spaces, are cut into chunks that advance
together too: once from every state that a chunk may begin in, which gives its
transition in max-plus algebra; the transitions are chained; and once more from
the true states. Sums are integers, so their order changes nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

SPACE = "▁"
#: What an unknown character costs below the worst piece's score (the library's penalty).
UNKNOWN_PENALTY = 10.0
#: Words of more characters are searched in chunks of so many, this number of chunks at once.
CHUNK, CHUNKS = 256, 512
#: Below any sum of scores; twice it is still a 64-bit integer.
_NONE = -(1 << 60)
#: A code that no character has.
_NOTHING = np.uint64(0xFFFFFFFF)
#: Distinct words that a worker keeps, the longest of them, and cells (words x length x piece lengths) of a batch.
MEMO_ENTRIES, MEMO_CHARS, BATCH_CELLS = 300_000, 32, 1 << 18
#: Texts whose words are searched together.
BATCH_TEXTS = 1024
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary for searching: pieces by length as sorted hashes, with scores and ids."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], bytes_of: dict[int, int] | None = None, unknown: int = 0):
        self.pieces, self.unknown = pieces, unknown
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, usable, strict=True)) if ok}
        scores = np.array(scores, float)
        # fixed point: exact for whole scores and for single precision ones from a half on
        scale = 1.0 if (scores == np.rint(scores)).all() else float(1 << 24)
        self.scores = np.rint(scores * scale).astype(np.int64)
        self.byte_ids = {b: i for i, b in (bytes_of or {}).items()}
        self.byte_fallback = len(self.byte_ids) == 256
        self.unknown_score = min((int(self.scores[i]) for i in self.ids.values()), default=0) - int(UNKNOWN_PENALTY * scale)
        self.longest = max(map(len, self.ids), default=1)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)), dtype=np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == n]
            if own:
                keys = self._prefixes(own, n)[:, n]
                order = np.argsort(keys)
                if len(np.unique(keys)) != len(keys):
                    raise ValueError("two pieces have equal hashes")
                at = np.array([self.ids[p] for p in own])[order]
                self.by_length[n] = keys[order], at, self.scores[at]
        self._decoding(bytes_of or {})
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """The vocabulary of a model file; pieces that are neither control, unknown, unused nor bytes may be used."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
        made = cls(names, [sp.get_score(i) for i in range(n)], usable, {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}, sp.unk_id())
        made.normalize = lambda text: sp.normalize(text) if text else ""
        return made

    @staticmethod
    def normalize(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    @staticmethod
    def _prefixes(words: list[str], n: int) -> np.ndarray:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
        out = np.zeros((len(words), n + 1), np.uint64)
        for k in range(n):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
        return out

    def _probe(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if none) and scores (_NONE) of substrings of length ``n`` by their hashes."""
        keys, ids, scores = self.by_length[n]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        return np.where(hit, ids[at], -1), np.where(hit, scores[at], _NONE)

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (u32, little-endian) of words of one length, which advance together."""
        n, count = len(words[0]), len(words)
        hashes = np.ascontiguousarray(self._prefixes(words, n).T)
        lengths = [k for k in sorted({1, *self.by_length}, reverse=True) if k <= n]
        # by length and start: the piece there, if there is one, and its score
        found = {}
        for k in lengths:
            if k in self.by_length:
                found[k] = self._probe(hashes[k:] - hashes[: n - k + 1] * self.power[k], k)
            else:
                found[k] = np.full((n, count), -1), np.full((n, count), _NONE)
            if k == 1:
                found[k] = found[k][0], np.where(found[k][0] < 0, self.unknown_score, found[k][1])
        best = np.zeros((n + 1, count), np.int64)
        back, piece = np.zeros((n + 1, count), np.int64), np.full((n + 1, count), -2, np.int64)
        every = np.arange(count)
        for end in range(1, n + 1):
            ks = [k for k in lengths if k <= end]  # longest first: the first maximum keeps ties
            totals = np.stack([best[end - k] + found[k][1][end - k] for k in ks])
            top = totals.argmax(0)
            best[end], back[end] = totals[top, every], np.array(ks)[top]
            piece[end] = np.stack([found[k][0][end - k] for k in ks])[top, every]
        end, steps = np.full(count, n), []
        while end.any():
            steps.append(piece[end, every])  # -2 where a word's path is complete
            end = end - back[end, every]
        paths = np.stack(steps[::-1], 1)
        lens = (paths > -2).sum(1)
        flat = paths[paths > -2]
        if (flat >= 0).all() and self._shown_bytes(flat) == "".join(words).encode("utf-8", "surrogatepass"):
            data, ends = flat.astype("<u4").tobytes(), [0, *(4 * np.cumsum(lens)).tolist()]
            return [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]
        return [self._checked(w, row[row > -2].tolist()) for w, row in zip(words, paths, strict=True)]

    def _checked(self, word: str, path: list[int]) -> bytes:
        """Ids of one word's path; a hash that only looked like a piece's has the word searched plainly."""
        out, at = [], 0
        for i in path:
            text = self.pieces[i] if i >= 0 else word[at : at + 1]
            if not word.startswith(text, at):
                return self.plain(word)
            out.append((i, text))
            at += len(text)
        return self._ids(out) if at == len(word) else self.plain(word)

    def _ids(self, path: list[tuple[int, str]]) -> bytes:
        ids: list[int] = []
        for i, text in path:
            if i >= 0:
                ids.append(i)
            elif self.byte_fallback:
                ids += (self.byte_ids[b] for b in text.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def plain(self, word: str) -> bytes:
        """The same search without numpy, where a hash only looked like a piece's."""
        best, back = [0], [(0, -1)]
        for end in range(1, len(word) + 1):
            top = (2 * _NONE, 0, -1)
            for k in range(min(end, self.longest), 0, -1):
                i = self.ids.get(word[end - k : end], -1)
                if i >= 0 or k == 1:
                    total = best[end - k] + (int(self.scores[i]) if i >= 0 else self.unknown_score)
                    if total > top[0]:
                        top = (total, k, i)
            best.append(top[0])
            back.append(top[1:])
        out, end = [], len(word)
        while end:
            k, i = back[end]
            out.append((i, word[end - k : end]))
            end -= k
        return self._ids(out[::-1])

    def chunked(self, words: list[str]) -> list[bytes]:
        """Ids (u32, little-endian) of words of any lengths, whose chunks advance together.

        A state holds the best sums at the last ``longest`` positions, latest
        first. What follows a word in its last chunk, one position at least,
        is a code without pieces, so no piece crosses words.
        """
        size = self.longest
        counts = np.array([len(w) // CHUNK + 1 for w in words])
        first = np.cumsum(counts) - counts
        codes = np.full(size - 1 + int(counts.sum()) * CHUNK, _NOTHING, np.uint64)
        for w, a in zip(words, first.tolist()):
            at = size - 1 + a * CHUNK
            codes[at : at + len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
        opens = np.zeros(int(counts.sum()), bool)
        opens[first] = True
        back, piece = np.empty(len(opens) * CHUNK, np.int32), np.empty(len(opens) * CHUNK, np.int32)
        lengths = sorted({1, *self.by_length}, reverse=True)
        state = start = np.append(0, np.full(size - 1, _NONE))
        for a in range(0, len(opens), CHUNKS):
            rows = np.arange(a, min(a + CHUNKS, len(opens)))
            m = len(rows)
            block = codes[rows[:, None] * CHUNK + np.arange(CHUNK + size - 1)] + np.uint64(1)
            ids, scores, h = {}, {}, np.zeros((m, CHUNK + size), np.uint64)
            for k in range(1, size + 1):  # hashes of all substrings of length k, from those one shorter
                h = h[:, :-1] * _BASE + block[:, k - 1 :]
                if k in lengths:
                    ends = np.ascontiguousarray(h[:, size - k : size - k + CHUNK].T)
                    ids[k], scores[k] = self._probe(ends, k) if k in self.by_length else (np.full(ends.shape, -1), np.full(ends.shape, _NONE))
            scores[1] = np.where(ids[1] < 0, self.unknown_score, scores[1])
            # from every state of one position alone: the chunks' transitions
            best = np.full((size + CHUNK, m, size), _NONE)
            for i in range(size):
                best[size - 1 - i, :, i] = 0
            for t in range(CHUNK):
                now = best[size + t]
                for k in lengths:
                    np.maximum(now, best[size + t - k] + scores[k][t][:, None], out=now)
            last = best[CHUNK:][::-1]
            states = np.empty((m, size), np.int64)
            for c in range(m):
                if opens[a + c]:
                    state = start
                states[c] = state
                state = np.maximum((last[:, c] + state).max(1), _NONE)
            # from the true states, with backpointers
            best = np.full((size + CHUNK, m), _NONE)
            best[:size] = states.T[::-1]
            steps, pieces = np.empty((CHUNK, m), np.int32), np.empty((CHUNK, m), np.int32)
            ks, every = np.array(lengths, np.int32), np.arange(m)
            for t in range(CHUNK):
                totals = np.stack([best[size + t - k] + scores[k][t] for k in lengths])
                top = totals.argmax(0)  # longest first: the first maximum keeps ties
                best[size + t] = np.maximum(totals[top, every], _NONE)
                steps[t] = ks[top]
                pieces[t] = np.stack([ids[k][t] for k in lengths])[top, every]
            back[a * CHUNK : (a + m) * CHUNK] = steps.T.ravel()
            piece[a * CHUNK : (a + m) * CHUNK] = pieces.T.ravel()
        out = []
        for w, a in zip(words, first.tolist()):
            at, end, path = a * CHUNK - 1, len(w), []
            while end > 0:
                path.append(int(piece[at + end]))
                end -= int(back[at + end])
            out.append(self._checked(w, path[::-1]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (u32, little-endian) of every text."""
        split = [_WORDS(self.normalize(t)) for t in texts]
        memo = self.memo
        found = [list(map(memo.get, p)) for p in split]
        fresh: dict[str, bytes] = {}
        new = {w for p, ids in zip(split, found, strict=True) if None in ids for w, x in zip(p, ids, strict=True) if x is None}
        groups: dict[int, list[str]] = {}
        long = []
        for w in new:
            if len(w) > CHUNK:
                long.append(w)
            else:
                groups.setdefault(len(w), []).append(w)
        if long:
            fresh.update(zip(long, self.chunked(long), strict=True))
        for n, words in groups.items():
            step = max(1, BATCH_CELLS // (n + 1))
            for a in range(0, len(words), step):
                fresh.update(zip(words[a : a + step], self.viterbi(words[a : a + step]), strict=True))
        out = [b"".join([fresh[w] if x is None else x for w, x in zip(p, ids, strict=True)] if None in ids else ids) for p, ids in zip(split, found, strict=True)]
        if len(memo) < MEMO_ENTRIES:
            memo.update((w, x) for w, x in fresh.items() if len(w) <= MEMO_CHARS)
        return out

    def _decoding(self, bytes_of: dict[int, int]) -> None:
        shown = [bytes([bytes_of[i]]) if i in bytes_of else p.encode("utf-8") for i, p in enumerate(self.pieces)]
        shown = [x if i in bytes_of or self.pieces[i] in self.ids else (" ⁇ ".encode() if i == self.unknown else b"") for i, x in enumerate(shown)]
        self._size = np.array([len(x) for x in shown], np.int64)
        self._from = np.cumsum(self._size) - self._size
        self._shown = np.frombuffer(b"".join(shown), np.uint8)

    def _shown_bytes(self, ids: np.ndarray) -> bytes:
        size = self._size[ids]
        at = np.repeat(self._from[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self._shown[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: the pieces' bytes are gathered in one step; the space in front is dropped."""
        text = self._shown_bytes(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """This worker process's vocabulary of a model file."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces.load(model_file)
    return _LOADED[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (u32, little-endian) of every row; null and empty texts have none; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = loaded(model_file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), BATCH_TEXTS):
                ids = sp.encode(texts[a : a + BATCH_TEXTS])
                yield pa.RecordBatch.from_arrays([keys.slice(a, len(ids)), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows of ``encode_documents``; null ids have a null text, no ids an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = loaded(model_file)
        for batch in batches:
            texts = [None if x is None else sp.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding the ids gives the text again, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = loaded(model_file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), BATCH_TEXTS):
                some = texts[a : a + BATCH_TEXTS]
                ids = sp.encode(some)
                same = [sp.decode(np.frombuffer(x, "<u4")) == t for x, t in zip(ids, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)],
                    names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
