"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most t of 64 bits agree, for any partition of
the bits into m parts with thresholds that add up to t - m + 1, within the
threshold in some part (Qin et al., GPH: Similarity Search in Hamming Space,
ICDE 2018). Correlated bits are grouped into the same part; dynamic
programming allocates unequal thresholds so that the estimated numbers of
probes and candidates cost least; the fingerprints are probed and verified.

Equal fingerprints are one node. Candidates meet in buckets and are verified
there with numpy, block against block; a bucket emits links that span its
linked groups, never all pairs, and a hot bucket is dealt out over several
tasks. Connected components of the links are the groups of near-duplicates.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done, fresh, shuffle_partitions, small_batches, whole_text, written
from .components import components

BITS = 64
#: Estimated cost of a probe (a shuffled row) and of a verified candidate pair, in microseconds.
PROBE_COST, PAIR_COST = 1.5, 0.01
#: A bucket of more rows than this is dealt out by pairs of blocks of about this many.
BLOCK_ROWS = 1024
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
_CHUNK = 1 << 18


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash over the XXH64 (seed 42) of all shingles of ``words`` words, repeats included."""
    import xxhash

    w = text.lower().split()  # bytes: A-Z and the six white space characters only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes: Iterator[int] = iter([digest(b" ".join(w), 42)])
    else:
        joined = zip(*(itertools.islice(w, k, None) for k in range(words)), strict=False)
        hashes = (digest(x, 42) for x in map(b" ".join, joined))
    ones, n = np.zeros(BITS, np.int64), 0
    while len(h := np.fromiter(itertools.islice(hashes, _CHUNK), "<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a bigint) of every row; a null text is empty, its fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Part:
    """Some bits and how many of them may differ; ``threshold`` -1: the part is not probed."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """Every pattern of at most ``threshold`` bits of the part, as signed 64-bit integers."""
        all_ = (sum(1 << b for b in c) for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k))
        return [_signed(x) for x in all_]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how many have both set; all fingerprints count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for a in range(0, len(fps), _CHUNK):
                x = np.unpackbits(fps[a : a + _CHUNK].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x  # exact: counts in a chunk are below 2^24
                n += len(x)
        if n:
            cell = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> np.ndarray:
    """Probability that two fingerprints agree in bits i and j; on the diagonal in bit i."""
    p11 = both / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    agree = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    np.fill_diagonal(agree, p**2 + (1 - p) ** 2)
    return agree


def group_bits(agree: np.ndarray, m: int, by_information: bool = False) -> list[list[int]]:
    """``m`` parts; each grows by the bit that is correlated most with what it has.

    Parts are of nearly equal size or, ``by_information``, of nearly equal
    information: one of correlated or lopsided bits then gets more of them.
    """
    single = np.diag(agree)
    lift = np.abs(agree - np.outer(single, single))
    np.fill_diagonal(lift, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        seed = max(left, key=lambda b: (lift[b, list(left)].max(), -b))
        part = [seed]
        left.remove(seed)
        share = _information(agree, [seed, *sorted(left)]) / (m - k)

        def full(part: list[int], size: int = size, share: float = share, k: int = k) -> bool:
            if not by_information:
                return len(part) >= size
            return k < m - 1 and (len(left) < m - k or _information(agree, part) >= share)

        while left and not full(part):
            best = max(left, key=lambda b: (lift[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(part)
    return parts


def _information(agree: np.ndarray, part: list[int]) -> float:
    """Bits of information in a part: how rarely two fingerprints agree in all of it."""
    return -math.log2(max(_within(part, agree, 0)[0], 1e-30))


def _within(part: list[int], agree: np.ndarray, most: int) -> list[float]:
    """Estimated probabilities that two fingerprints differ in at most 0..most bits of the part.

    Each bit differs on its own, given that the bit it is correlated with most agrees.
    """
    dist = [1.0] + [0.0] * most
    for i, b in enumerate(part):
        same = agree[b, b]
        if i:
            before = part[:i]
            parent = before[int(np.argmax(agree[b, before] / np.maximum(np.diag(agree)[before], 1e-9)))]
            same = max(same, agree[b, parent] / max(agree[parent, parent], 1e-9))
        same = min(same, 1.0)
        dist = [d * same + (dist[k - 1] * (1 - same) if k else 0.0) for k, d in enumerate(dist)]
    return list(itertools.accumulate(dist))


def plan(n: int, both: np.ndarray, threshold: int = 3) -> list[Part]:
    """The partition and thresholds of least estimated cost for a self-join of ``n`` fingerprints."""
    agree, n = _agreement(n, both), max(n, 1)
    best, chosen = math.inf, []
    for m, by_information in itertools.product(range(1, threshold + 2), (False, True)):
        parts = group_bits(agree, m, by_information)
        costs = []
        for part in parts:
            near = _within(part, agree, threshold)
            probes = list(itertools.accumulate(math.comb(len(part), k) for k in range(threshold + 1)))
            costs.append([0.0] + [n * probes[t] * PROBE_COST + n * n / 2 * near[t] * PAIR_COST for t in range(threshold + 1)])
        # dynamic programme over parts: least cost for each sum of (threshold + 1); the sum must be t + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t in range(-1, threshold + 1):
                    at = s + t + 1
                    if at <= threshold + 1 and c + cost[t + 1] < nxt.get(at, (math.inf,))[0]:
                        nxt[at] = (c + cost[t + 1], [*ts, t])
            table = nxt
        cost, ts = table.get(threshold + 1, (math.inf, []))
        if cost < best:
            best, chosen = cost, [Part(tuple(sorted(p)), t) for p, t in zip(parts, ts, strict=True)]
    return chosen


def _bucket_links(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked groups of one bucket's distinct fingerprints."""
    fps = np.unique(fps)
    n = len(fps)
    label = np.arange(n)
    rows, cols = [], []
    for a in range(0, n, 512):
        i, j = np.nonzero(np.bitwise_count(fps[a : a + 512, None] ^ fps[None, :]) <= threshold)
        up = j > i + a
        rows.append(i[up] + a)
        cols.append(j[up])
    i, j = np.concatenate(rows), np.concatenate(cols)
    while len(i):  # smallest labels spread over links, and jump
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def _links(threshold: int):
    def verify(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
        sizes = np.diff(np.append(edge, len(fps)))
        us, vs = [], []
        small = np.repeat(sizes <= 48, sizes)
        run = np.repeat(np.arange(len(edge)), sizes)
        for d in range(1, int(sizes[sizes <= 48].max(initial=0))):
            at = np.flatnonzero(small[:-d] & (run[d:] == run[:-d]))
            ok = at[(np.bitwise_count(fps[at] ^ fps[at + d]) <= threshold) & (fps[at] != fps[at + d])]
            us.append(fps[ok])
            vs.append(fps[ok + d])
        for k in np.flatnonzero(sizes > 48).tolist():
            u, v = _bucket_links(fps[edge[k] : edge[k] + sizes[k]], threshold)
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch waits for the next."""
        cells, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)])
            fps = np.concatenate([fps, batch.column(3).to_numpy().view(np.uint64)])
            if not len(fps):
                continue
            last = (cells != cells[-1]).any(1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield verify(cells[:cut], fps[:cut])
                cells, fps = cells[cut:], fps[cut:]
        if len(fps):
            yield verify(cells, fps)

    return run


def probes(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """part, key, fp: every fingerprint in all buckets in which it can meet one that differs little in a part."""

    def buckets(i: int, part: Part):
        value = F.col("fp").bitwiseAND(F.lit(_signed(part.mask)))
        flips = F.array(*(F.lit(x).cast("long") for x in part.flips()))
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(x).alias("key")))

    arrays = [buckets(i, part) for i, part in enumerate(parts) if part.threshold >= 0]
    return nodes.select(F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("x"), "fp").select("x.part", "x.key", "fp")


def links(nodes: DataFrame, threshold: int = 3) -> DataFrame:
    """u, v: links between distinct fingerprints that span all groups linked at ``threshold`` or fewer bits."""
    n, both = bit_counts(nodes)
    rows = probes(nodes, plan(n, both, threshold))
    hot = written(
        rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BLOCK_ROWS)
        .select(F.col("part").alias("_part"), F.col("key").alias("_key"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")),
        "hot",
    )
    # Hot buckets number at most probes / BLOCK_ROWS; Spark broadcasts them if they are small, AQE splits the join if not.
    dealt = rows.join(hot, (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key")), "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least(block, y) * F.col("blocks") + F.greatest(block, y))
    )
    dealt = dealt.select("part", "key", F.explode(cells).alias("cell"), "fp")
    dealt = dealt.repartition(shuffle_partitions(nodes.sparkSession), "part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    return dealt.mapInArrow(_links(threshold), "u bigint, v bigint")


def mark_near(docs: DataFrame, threshold: int = 3, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id that its fingerprint reaches by links.

    Null and empty texts and texts of white space have fingerprint zero, which
    links like any other. Null doc_ids take part but are never the smallest
    unless a group has no other. Repeated rows share a component. An empty
    table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, key, text, words), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(components(links(nodes, threshold)), "roots")
    linked = roots.join(nodes, F.col("node") == F.col("fp"))
    group = linked.groupBy("root").agg(F.min("least").alias("component"))
    group = written(group, "groups")
    of = roots.join(group, "root").select("node", "component")
    named = written(
        nodes.join(of, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id")), "named"
    )
    done(nodes, roots, group)
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, threshold: int = 3, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row of each component with all its columns: the one with the smallest doc_id, a null one last.

    Rows have an identity of their own: of repeated rows one stays, and null
    or repeated doc_ids lose no row of another component. Texts without words,
    null ones included, are one component. An empty table gives no rows.
    """
    rid, lost = fresh(docs, "_rid"), fresh(docs, "_gone")
    whole = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    marks = mark_near(whole, threshold, rid, text, words)  # the component's name is its first row's number
    of = whole.select(F.col(rid).alias("rid"), F.col(f"`{key}`").alias("key")).join(marks.select(F.col("doc_id").alias("rid"), "component_id"), "rid")
    of = written(of, "of")
    best = of.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull(), "key", "rid")).alias("x"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    best = written(best.select("component_id", F.col("x.rid").alias("stays")), "best")
    gone = written(of.join(best, "component_id").filter("rid != stays").select(F.col("rid").alias(lost)), "gone")
    return whole.join(gone, F.col(rid) == F.col(lost), "left_anti").drop(rid)


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
