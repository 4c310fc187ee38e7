"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash first, MinHash bands for what it can't reach.

Rows with equal shingle sets are one node. The nodes' SimHash fingerprints are
linked by the generalised pigeonhole search of ``simhash``, which joins close
copies, large groups of them above all. Texts at a similarity of 0.8 differ in
about 10 of 64 bits, though, and a search of that radius meets a share of all
pairs; so MinHash bands complete the candidates: with ``BANDS`` bands of
``ROWS`` values a pair at 0.8 is missed with probability (1 - 0.8^ROWS)^BANDS,
2e-4, and one at 0.5 met with less than 0.2. Members of a bucket that are linked
already need no further test, and neither do pairs whose fingerprints, or whose
sketches of one bit a MinHash value, are too far apart for a similarity of 0.8.
Every candidate is verified on its shingle sets before it is a link; connected
components of the links are the groups. First every member of a bucket is held
against one leader, which joins large groups in a few rounds; then what is left
of a bucket, e.g. texts with a passage in common, is compared in its task,
block by block, and emits the links that span its groups, never all pairs. Only
the texts of candidates are read again, and only their sets are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import done, fresh, shuffle_partitions, small_batches, whole_text, written
from .components import components
from .exact_dedup import filter_of, place_of, possibly_repeated, repeat_filter

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 8
#: 64-bit words of a sketch. At 0.8 a tenth of its bits differ, 38 with a deviation of 6: more than this with probability 1e-5.
SKETCH = BANDS * ROWS // 64
MOST_SKETCH_BITS = 64
#: Of a pair at 0.8 about 9.7 bits of 64 differ, with a deviation of 2.9: more than this with probability 1e-7.
MOST_BITS = 25
#: Rounds of leaders; then members of a bucket are compared with each other, dealt out by pairs of blocks of so many.
LEADER_ROUNDS, BLOCK_ROWS = 1, 512
_CHUNK = 2048
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_WORDS = [f"w{i}" for i in range(SKETCH)]
_FACTOR, _SHIFT = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    w = text.lower().split()  # bytes: A-Z and the six white space characters only
    if not w:
        return np.zeros(0, np.uint64)
    digest = {x: xxhash.xxh64_intdigest(x, 42) for x in set(w)}
    h = np.fromiter((digest[x] for x in w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def bands(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of the set's MinHash values, and the values' last bits in words; a set without members has them too."""
    least = np.full((BANDS * ROWS, 1), (1 << 64) - 1, np.uint64)
    for a in range(0, len(s), _CHUNK):
        least = np.minimum(least, (s[a : a + _CHUNK] * _FACTOR + _SHIFT).min(1, keepdims=True))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key, np.packbits((_mixed(least) & np.uint64(1)).astype(np.uint8)).view("<u8")


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets' Jaccard similarity is ``least`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of hashes; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(s), _CHUNK):
        ones += np.unpackbits(s[a : a + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(s)].sum(dtype=np.uint64))


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, node (a hash of the row's set), its size n, fingerprint, sketch (a word a column) and bands."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64))
            fps = pa.array(np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64))
            made = [bands(s) for s in sets]
            keys = np.concatenate([k for k, _ in made]).view(np.int64) if sets else np.zeros(0, np.int64)
            bits = np.stack([w for _, w in made]).view(np.int64) if sets else np.zeros((0, SKETCH), np.int64)
            cut = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(cut, pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array([len(s) for s in sets], pa.int64()), fps, *(pa.array(np.ascontiguousarray(c)) for c in bits.T), lists], names=["rid", "doc_id", "node", "n", "fp", *_WORDS, "bands"])

    return rows.mapInArrow(run, "rid bigint, doc_id bigint, node bigint, n bigint, fp bigint, " + "".join(f"{w} bigint, " for w in _WORDS) + "bands array<bigint>")


def _sets(used: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """node, set of the nodes in ``used``. Texts of other nodes are not shuffled: a filter tells them."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    wanted = written(nodes.join(used, "node").select(F.col("rid").alias("_of"), "node"), "wanted")
    filter_, bits = filter_of(wanted.select(place_of(F.col("_of")).alias("p")))
    some = rows.filter(possibly_repeated(F.col("rid"), filter_, bits))
    out = written(some.join(wanted, F.col("rid") == F.col("_of")).select("node", "text").mapInArrow(as_sets, "node bigint, set binary"), "sets")
    done(wanted)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The written pairs u, v whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            ok = pa.array([similar(x, y, least) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    used = pairs.select("u").unionAll(pairs.select("v")).distinct().withColumnRenamed("u", "node")
    sets = _sets(used, nodes, rows, words)
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    other = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    out = written(pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint"), "found")
    done(sets)
    return out


def _spanning(label: np.ndarray, n: np.ndarray, fp: np.ndarray, sketch: np.ndarray, sets: list[bytes], least: float) -> list[tuple[int, int]]:
    """Verified links between members of a bucket that join all groups that can be joined; members are tested only across groups."""
    _, label = np.unique(label, return_inverse=True)
    out = []
    for i in range(len(label) - 1):
        rest = slice(i + 1, None)
        near = (label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= least * np.maximum(n[rest], n[i]) - 1e-9)
        near &= np.bitwise_count(fp[rest] ^ fp[i]) <= MOST_BITS
        near &= np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1, dtype=int) <= MOST_SKETCH_BITS
        own = np.frombuffer(sets[i], np.uint64)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[j] != label[i] and similar(own, np.frombuffer(sets[j], np.uint64), least):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _inside(left: DataFrame, sizes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v: verified links across the groups of each bucket; a large bucket is dealt out by pairs of blocks."""
    columns = ["node", "n", "fp", *_WORDS, "label"]

    def links_of(cell: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(cell)
        node, n, fp, *words, label = (table.column(c).to_numpy() for c in columns)
        sketch = np.stack(words, 1).view(np.uint64)
        found = _spanning(label, n, fp.view(np.uint64), sketch, table.column("set").to_pylist(), least)
        u, v = ([node[p[k]] for p in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, in any batches."""
        cell, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(i).to_numpy() for i in range(2)], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if cell and tuple(at[a]) != last:
                    yield links_of(cell)
                    cell = []
                last = tuple(at[a])
                cell.append(batch.slice(a, b - a))
        if cell:
            yield links_of(cell)

    blocks = F.ceil(F.col("of") / BLOCK_ROWS).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: (F.least(block, y) * F.col("blocks") + F.greatest(block, y)).cast("long"))
    dealt = left.join(sizes.select("key", blocks.alias("blocks")), "key").select("key", F.explode(across).alias("cell"), *columns)
    dealt = dealt.join(sets, "node").select("key", "cell", *columns, "set")
    dealt = dealt.repartition(shuffle_partitions(left.sparkSession), "key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _close(nodes: DataFrame) -> DataFrame:
    """u, v: nodes whose fingerprints are linked at 3 or fewer bits, by links that span their groups."""
    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
    ends = [reps.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_")) for x in "uv"]
    across = simhash.links(reps.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
    same = nodes.join(reps, "fp").filter("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    out = written(_ordered(across.unionAll(same), "u", "v"), "close")
    done(reps)
    return out


def _ordered(pairs: DataFrame, u: str, v: str) -> DataFrame:
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def links(sketches: DataFrame, rows: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """u, v: verified links between nodes that span all groups of candidates linked at ``least`` or more."""
    of = [F.first(c).alias(c) for c in ("n", "fp", *_WORDS)]  # functions of the node
    nodes = written(sketches.groupBy("node").agg(F.min("rid").alias("rid"), *of), "nodes")
    close = _close(nodes)
    first = sketches.select("rid", "bands").join(nodes.select("rid", "node"), "rid")
    keyed = written(first.select("node", F.explode("bands").alias("key")), "keyed")
    filter_, bits = repeat_filter(keyed, "key")
    members = keyed.filter(possibly_repeated(F.col("key"), filter_, bits))
    new = _verified(close, nodes, rows, words, least)
    found, made = [new], components(new)
    # Every bucket member with its group so far; buckets of one group drop out for good.
    now = members.join(nodes.drop("rid"), "node").join(made, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    now = written(now, "now")
    done(keyed, close)
    for turn in range(LEADER_ROUNDS + 1):
        lead = F.min_by(F.struct("node", "n", "fp", *_WORDS, "label"), F.xxhash64("node", F.lit(turn))).alias("x")
        open_ = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("of"), lead).filter("a != b")
        open_ = written(open_.select("key", "of", "x.*"), "open")
        if not open_.count():
            break
        left = written(now.join(open_.select("key"), "key"), "left")
        if turn == LEADER_ROUNDS:
            sets = _sets(left.select("node").distinct(), nodes, rows, words)
            found.append(written(_inside(left, open_, sets, least).distinct(), "found"))
            done(sets, left)
            break
        apart = F.lit(0)
        for w in _WORDS:
            apart = apart + F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}")))
        may = (
            (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label"))
            & (F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n") - 1e-9)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS) & (apart <= MOST_SKETCH_BITS)
        )
        pairs = open_.alias("a").join(left.alias("b"), may).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.label").alias("x"), F.col("b.label").alias("y"))
        pairs = written(pairs.select(*(F.when(F.col("u") < F.col("v"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in ("uv", "vu", "xy", "yx"))).distinct(), "pairs")
        new = _verified(pairs.select("u", "v"), nodes, rows, words, least)
        found.append(new)
        # the groups' links among themselves: a small graph
        made = components(pairs.join(new, ["u", "v"]).select(F.col("x").alias("u"), F.col("y").alias("v")))
        after = left.join(made, F.col("label") == made["node"], "left").select("key", left["node"], "n", "fp", *_WORDS, F.coalesce("root", "label").alias("label"))
        done(now, open_, pairs)
        now = written(after, "now")
        done(left)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = written(out, "links")
    done(now, nodes, *found)
    return out


def drop_similar(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group of near-duplicates with all its columns: the one with the smallest doc_id.

    Texts are near when their sets of ``words``-word shingles have a Jaccard
    similarity of ``least`` or more (not below 0.8, for which candidates are searched);
    groups are connected components. Texts
    without words, null ones included, are one group. Rows have an identity of
    their own, so null and repeated doc_ids lose no row of another group; a
    null doc_id loses against any other. An empty table gives no rows.
    """
    if least < SIMILARITY:
        raise ValueError(f"the similarity must be {SIMILARITY} or more")
    small_batches(docs.sparkSession)
    rid = fresh(docs, "_rid")
    whole = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    rows = whole.select(F.col(rid).alias("rid"), F.col(f"`{key}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    sketches = written(_sketches(rows, words), "sketches")
    roots = written(components(links(sketches, rows, words, least)), "near_roots")
    of = sketches.select("rid", "doc_id", "node").join(roots, "node", "left").select("rid", "doc_id", F.coalesce("root", "node").alias("group"), "node")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("node"), F.col("rid"))
    best = of.groupBy("group").agg(F.min(rank).alias("x"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    best = written(best.select("group", F.col("x.rid").alias("stays")), "best")
    lost = fresh(whole, "_gone")
    gone = written(of.join(best, "group").filter("rid != stays").select(F.col("rid").alias(lost)), "gone")
    done(sketches, roots, best)
    return whole.join(gone, F.col(rid) == F.col(lost), "left_anti").drop(rid)
