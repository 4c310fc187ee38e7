"""Best-fit packing of tokenized documents into sequences of a fixed length.

Packing needs only how many pieces there are of each length, at most
``max_len`` numbers. The plan is made from those: exact-complement hashing
first (a length, and a single, pair or triple of other lengths that fills its
gap exactly, consumed as often as all are available), then best-fit decreasing
for the rest, whole batches of equal bins at a time. Pieces then take the
plan's places by their rank among the pieces of their length: a task numbers
its own as it cuts them, and a small table tells how many of each length the
tasks before it have, so neither pieces nor ids need a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, whole_text, written
from .records import default_tokenizer
from .tokens import encoder

Recipe = tuple[int, list[int]]
#: Rows of the table of offsets (one for each task and length in it, some 160 bytes) up to which it is broadcast.
BROADCAST_OFFSETS = 200_000


class _Complements:
    """Which lengths are left, with the sums that single lengths, pairs and triples of them make."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.sums: np.ndarray | None = None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the longest member whose lengths add up to ``gap``."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (self.left[a] > 0) & (self.left[gap - a] > (a == gap - a))
        return [int(a[k := int(ok.argmax())]), gap - int(a[k])] if len(a) and ok.any() else None

    def triple(self, gap: int) -> list[int] | None:
        if self.sums is None:
            # the index of pair sums: a self-convolution of the lengths that are left
            there = np.fft.rfft((self.left > 0).astype(float), 2 * len(self.left))
            self.sums = np.fft.irfft(there * there)[: len(self.left)] > 0.5
        a = np.arange(gap - 2, 0, -1)
        for first in a[(self.left[a] > 0) & self.sums[gap - a]].tolist():
            self.left[first] -= 1  # the index may be stale or use ``first`` twice: the pair must be there without it
            rest = self.pair(gap - first)
            self.left[first] += 1
            if rest:
                return [first, *rest]
        return None

    def fill(self, gap: int) -> list[int] | None:
        if gap and self.left[gap] > 0:
            return [gap]
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], max_len: int) -> list[Recipe]:
    """Recipes (how many sequences, lengths in each) that use every piece exactly once."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= max_len:
            raise ValueError(f"length {length} is not in 1..{max_len}")
        left[length] += n
    recipes: list[Recipe] = []
    if left[max_len]:
        recipes.append((int(left[max_len]), [max_len]))
        left[max_len] = 0
    index = _Complements(left)
    for length in range(max_len - 1, 0, -1):
        if not left[length]:
            continue
        index.sums = None
        while left[length]:
            left[length] -= 1
            found = index.fill(max_len - length)
            left[length] += 1
            if not found:
                break
            used: dict[int, int] = {}
            for x in [length, *found]:
                used[x] = used.get(x, 0) + 1
            k = min(int(left[x]) // m for x, m in used.items())
            for x, m in used.items():
                left[x] -= k * m
            recipes.append((k, sorted([length, *found], reverse=True)))
    return recipes + _best_fit(left, max_len)


def _best_fit(left: np.ndarray, max_len: int) -> list[Recipe]:
    """Best-fit decreasing over counted lengths; bins with equal gaps are handled together."""
    bins: list[list[Recipe]] = [[] for _ in range(max_len + 1)]
    there = np.zeros(max_len + 1, bool)
    for length in range(max_len, 0, -1):
        n = int(left[length])
        while n:
            fits = there[length:]
            if not fits.any():
                each = max_len // length
                for bins_of, inside in ((n // each, each), (1 if n % each else 0, n % each)):
                    if bins_of:
                        gap = max_len - inside * length
                        bins[gap].append((bins_of, [length] * inside))
                        there[gap] = True
                n = 0
                break
            gap = length + int(fits.argmax())
            have, inside = bins[gap].pop()
            # as many of this length as the gap takes: nothing fits it better until a shorter length comes
            each = min(gap // length, max(1, n // have))
            k = min(have, n // each)
            if k < have:
                bins[gap].append((have - k, inside))
            there[gap] = bool(bins[gap])
            bins[gap - each * length].append((k, inside + [length] * each))
            there[gap - each * length] = True
            n -= k * each
    return [r for group in bins for r in group]


def places(recipes: list[Recipe]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of places, ranks ascending."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for k, lengths in recipes:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((ranks.get(x, 0), sequence, offset))
            ranks[x] = ranks.get(x, 0) + k
            offset += x
        sequence += k
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACE = "part int, nth bigint"


def _cutter(tokenizer_path: str, max_len: int, end_id: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (max_len + 1)  # pieces of each length so far
        end = end_id.to_bytes(enc.width, "little")
        kind = "<u2" if enc.width == 2 else "<u4"
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                rows: list[tuple] = []
                for key, ids in zip(keys[a : a + 256], enc.encode(texts[a : a + 256]), strict=True):
                    own = np.frombuffer(ids + end, kind)
                    at, stop = 0, (len(own) - 1) % max_len + 1
                    piece = 0
                    while at < len(own):
                        narrow, length = own[at:stop], stop - at
                        rows.append((key, piece, at, length, zlib.crc32(narrow.astype("<u4").tobytes()), part, seen[length], narrow.tobytes() if keep_ids else b""))
                        seen[length] += 1
                        at, stop, piece = stop, stop + max_len, piece + 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 7 + keep_ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + keep_ids]
                )

    return cut


def _placer(table, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, seq, off = by_length[x]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[run] + rank[at] - first[run], off[run]
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names]
            if "ids" in names:
                columns[names.index("ids")] = pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pack_documents(
    docs: DataFrame, max_len: int = 2048, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text",
    end_id: int = 0, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    A document is its ids and ``end_id``; only longer ones than ``max_len`` are
    cut, into pieces of ``max_len`` of which the first may be shorter. A null
    text is empty, so it is one id; null and repeated keys are documents like
    others; an empty table gives no rows. ``ids`` are little-endian u32. Other
    columns are not read. To the driver come the counts by length alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    tokenizer_path = tokenizer_path or default_tokenizer()
    ids = ", ids binary" if keep_ids else ""  # as wide as the tokenizer needs until the last step
    pieces = written(rows.mapInArrow(_cutter(tokenizer_path, max_len, end_id, keep_ids), f"{_PIECES}, {_PLACE}{ids}"), "pieces")
    each = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, max_len)))  # its size depends on max_len, not on the data
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = written(offsets, "offsets")
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return ranked.select(*names, "rank").mapInArrow(_placer(table, encoder(tokenizer_path).width), f"{_PIECES}{ids}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, length and ids (u32, little-endian)."""
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum("length").alias("length"),
        F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (acc, x) -> concat(acc, x.ids))").alias("ids"),
    )
