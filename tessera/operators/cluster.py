"""k-medoids (PAM) and its parts: distances, assignment, cost and swaps.

Points are rows (id, coordinates), of any number of dimensions. Medoids are few
and enter as literals. For every point the nearest medoid, its slot and the
second nearest distance tell what any swap costs it, so one pass over pairs of
points and candidates prices all swaps (Schubert and Rousseeuw 2019). Points
are packed into blocks once; a task prices a block of candidates against the
points' blocks with numpy and sends one sum for each candidate and slot. One
row per round comes to the driver.

k-medoids needs the cheapest swap only. Where all points can be broadcast,
candidates whose lower bound is above a swap already priced are left out
(``_search``); all others are priced as above, so that the swap is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.scalar import distance

#: Points whose coordinates and ids take up to so many bytes are broadcast; more are paired in blocks by Spark.
BROADCAST_BYTES = 64 << 20
#: Points of a block, at most.
BLOCK_POINTS = 2048
#: Points of the second side of a distance matrix that follow each other, about.
RUN_POINTS = 1024
#: Points of a leaf, and of a strip of it, whose pairs with another leaf are written in one direction, then in the other. These 400 rows
#: are few enough for Snappy to find again, divisible by 8, so that numbers packed bit by bit come again byte by byte, and fill pages evenly.
LEAF, STRIP = 40, 10
#: Cells of leaves, at most; their pairs are put in order on the driver.
MOST_CELLS = 2048
#: Rows of a distance matrix that a task makes, and pairs of leaves of a batch, about.
TASK_ROWS, BATCH_LEAVES = 1 << 25, 24
#: Distances that a worker holds at once.
CELLS = 1 << 21
#: Candidates that are bounded together, first many neighbours, then fewer of those that are left.
LEAVES = (128, 16)
#: Candidates priced first, for an upper bound, at most; else one of so many points.
FIRST, FIRST_OF = 1024, 256


@dataclass(frozen=True)
class Swap:
    cost: float
    slot: int
    point: int


@dataclass(frozen=True)
class Clustering:
    medoids: tuple[int, ...]
    cost: float | None
    rounds: int


def _literals(points: DataFrame, coords: Sequence[str], medoids: Sequence[Sequence[float]]) -> list[list[Column]]:
    """Medoids in their columns' own types: float columns are compared in single precision."""
    kinds = [points.schema[c].dataType for c in coords]
    return [[F.lit(float(x)).cast(k) for x, k in zip(m, kinds, strict=True)] for m in medoids]


def _distances(points: DataFrame, coords: Sequence[str], medoids: Sequence[Sequence[float]], metric: str) -> list[Column]:
    own = [F.col(c) for c in coords]
    return [distance(own, m, metric) for m in _literals(points, coords, medoids)]


def distance_matrix(points: DataFrame, coords: Sequence[str], id_: str = "id", metric: str = "l2") -> DataFrame:
    """i, j, d for all pairs of points. Quadratic by nature.

    Each i meets RUN_POINTS j at a time: files take less where values come again within a page.
    """
    a = points.select(F.col(id_).alias("i"), *(F.col(c).alias(f"a_{c}") for c in coords))
    b = points.select(F.col(id_).alias("j"), *(F.col(c).alias(f"b_{c}") for c in coords))
    d = distance([F.col(f"a_{c}") for c in coords], [F.col(f"b_{c}") for c in coords], metric)
    runs = b.repartition(max(1, -(-points.count() // RUN_POINTS))).hint("shuffle_replicate_nl")
    return a.crossJoin(runs).select("i", "j", d.alias("d"))


def whole_distance_matrix(points: DataFrame, coords: Sequence[str], id_: str = "id", metric: str = "l2") -> DataFrame:
    """The rows of ``distance_matrix`` for one who stores them all: in an order that makes small files, each distance computed once.

    Strips and leaves of near points are paired, in one direction, then in
    the other and in the same order, which the files' compression finds. A
    task takes pairs of cells that are about as wide and as far from each
    other, so that rounded distances are often few enough for a dictionary.
    A filter on i or j does not get below this.
    """
    if metric not in ("l2", "sqeuclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    n = points.count()
    if {points.schema[c].dataType.typeName() for c in coords} != {"double"} or not 0 < 8 * n * (1 + len(coords)) <= BROADCAST_BYTES:
        return distance_matrix(points, coords, id_, metric)
    spark, kind = points.sparkSession, points.schema[id_].dataType
    read = points.select(F.col(id_).alias("_id"), *coords).toArrow()
    x = np.stack([c.to_numpy() for c in read.columns[1:]], 1)
    gone = np.any([c.is_null().to_numpy() for c in read.columns[1:]], 0)
    cell = LEAF * -(-n // (MOST_CELLS * LEAF))
    order = _neighbours(x, (cell, LEAF))
    ids, x, gone = read.column(0).combine_chunks().take(pa.array(order)), x[order], gone[order]
    with np.errstate(all="ignore"):  # only the order depends on these
        centre = np.stack([x[a : a + cell].mean(0) for a in range(0, n, cell)])
        radius = np.array([np.sqrt(((x[a : a + cell] - c) ** 2).sum(1).max()) for a, c in zip(range(0, n, cell), centre, strict=True)])
        a, b = np.triu_indices(len(centre))
        width = np.ceil(2 * np.log2(radius[a] + radius[b]))
        pairs = np.stack([a, b], 1).astype("<i4")[np.lexsort([_between(centre, centre, "l2")[a, b], width])]
    tasks = min(len(pairs), max(spark.sparkContext.defaultParallelism, -(-n * n // TASK_ROWS)))
    shared = spark.sparkContext.broadcast((ids, x, gone if gone.any() else None, pairs))

    def rows(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        ids, _, gone, _ = shared.value
        missing = None if gone is None else gone[i] | gone[j]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(d, mask=missing)], names=["i", "j", "d"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x, _, pairs = shared.value
        full, unit, every = n // LEAF, np.arange(cell // LEAF), np.arange(LEAF)
        leaves = np.ascontiguousarray(x[: full * LEAF].reshape(full, LEAF, x.shape[1]).transpose(2, 0, 1))  # coordinate, leaf, point
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            own = pairs[task * len(pairs) // tasks : (task + 1) * len(pairs) // tasks, :, None] * len(unit) + unit
            a, b = (z.ravel() for z in np.broadcast_arrays(own[:, 0, :, None], own[:, 1, None, :]))
            there = (a <= b) & (b * LEAF < n)
            a, b = a[there], b[there]
            plain = (a < b) & (b < full)
            left, right = a[plain], b[plain]
            for at in range(0, len(left), BATCH_LEAVES):
                p, q = left[at : at + BATCH_LEAVES], right[at : at + BATCH_LEAVES]
                i, j, d = (np.empty((len(p), LEAF // STRIP, 2, STRIP, LEAF), z) for z in ("<i4", "<i4", "<f8"))
                total, diff = np.zeros((2, len(p), LEAF, LEAF))
                for c in leaves:
                    np.subtract(c[p][:, :, None], c[q][:, None, :], out=diff)
                    np.multiply(diff, diff, out=diff)
                    total += diff
                d[:] = (np.sqrt(total, out=total) if metric == "l2" else total).reshape(-1, LEAF // STRIP, 1, STRIP, LEAF)
                i[:, :, 0] = j[:, :, 1] = (p[:, None] * LEAF + every).reshape(-1, LEAF // STRIP, STRIP, 1)
                i[:, :, 1] = j[:, :, 0] = (q[:, None] * LEAF + every).reshape(-1, 1, 1, LEAF)
                yield rows(i.ravel(), j.ravel(), d.ravel())
            for p, q in zip(a[~plain].tolist(), b[~plain].tolist(), strict=True):
                i, j = np.arange(p * LEAF, min(n, (p + 1) * LEAF)), np.arange(q * LEAF, min(n, (q + 1) * LEAF))
                d = _between(x[i], x[j], metric).ravel()
                i, j = np.repeat(i, len(j)), np.tile(j, len(i))
                yield rows(i, j, d)
                if p < q:
                    yield rows(j, i, d)

    return spark.range(0, tasks, 1, tasks).mapInArrow(make, StructType([StructField("i", kind), StructField("j", kind), StructField("d", DoubleType())]))


def assign(points: DataFrame, coords: Sequence[str], medoids: Sequence[Sequence[float]], metric: str = "l2") -> DataFrame:
    """``points`` with slot and d of the nearest medoid; the first of equals."""
    pairs = [F.struct(d.alias("d"), F.lit(k).alias("slot")) for k, d in enumerate(_distances(points, coords, medoids, metric))]
    best = F.least(*pairs) if len(pairs) > 1 else pairs[0]
    return points.withColumn("_best", best).withColumns({"slot": F.col("_best.slot"), "d": F.col("_best.d")}).drop("_best")


def total_cost(points: DataFrame, coords: Sequence[str], medoids: Sequence[Sequence[float]], metric: str = "l2") -> DataFrame:
    """cost: the sum of distances to the nearest medoid."""
    return assign(points, coords, medoids, metric).agg(F.sum("d").alias("cost"))


def _kind(points: DataFrame, coords: Sequence[str]) -> str:
    """numpy's type for the coordinates: single precision if all columns are float."""
    return "<f4" if all(points.schema[c].dataType.typeName() == "float" for c in coords) else "<f8"


def _neighbours(x: np.ndarray, units: Sequence[int] = LEAVES) -> np.ndarray:
    """An order in which aligned runs of ``units`` points are near each other: halves along the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        unit = next((u for u in units if len(at) > u), 0)
        if not unit:
            out.append(at)
            continue
        own = x[at]
        mid = unit * (-(-len(at) // unit) // 2)
        parted = np.argpartition(own[:, np.ptp(own, 0).argmax()], mid)
        todo += [at[parted[mid:]], at[parted[:mid]]]
    return np.concatenate(out)


def blocks(points: DataFrame, coords: Sequence[str], id_: str = "id", n: int | None = None, near: bool = False) -> DataFrame:
    """ids, data: points packed into binary blocks (i8 ids, coordinates row by row), dealt out over the tasks; ``near``: of neighbours."""
    kind, tasks = _kind(points, coords), max(1, points.sparkSession.sparkContext.defaultParallelism)
    n = points.count() if n is None else n
    size = min(BLOCK_POINTS, max(1, -(-n // tasks)))
    rows = points.select(F.col(id_).cast("long").alias("_id"), *coords)
    if near:
        size = min(BLOCK_POINTS, -(-size // LEAVES[0]) * LEAVES[0])
        spread = points.agg(*(F.stddev_pop(c) for c in coords)).first()
        widest = max(zip(coords, spread, strict=True), key=lambda x: x[1] or 0.0)[0]
        rows = rows.repartitionByRange(max(tasks, -(-n // 8192)), widest, "_id").sortWithinPartitions(widest, "_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).astype(kind)
            if near and len(ids):
                order = _neighbours(data)
                ids, data = ids[order], data[order]
            at = range(0, len(ids), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a : a + size].tobytes() for a in at], pa.binary()), pa.array([data[a : a + size].tobytes() for a in at], pa.binary())], names=["ids", "data"]
            )

    return rows.mapInArrow(pack, "ids binary, data binary").repartition(tasks)


def _between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances, coordinate by coordinate, so that memory is rows x columns whatever the dimensions."""
    out = np.zeros((len(a), len(b)), a.dtype)
    diff = np.empty_like(out)
    for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
        np.subtract(x[:, None], y[None, :], out=diff)
        np.multiply(diff, diff, out=diff)
        out += diff
    return np.sqrt(out) if metric == "l2" else out


def _prices(medoid_ids: Sequence[int], medoids: Sequence[Sequence[float]], kind: str, metric: str, same_within: float | None):
    centres = np.array(medoids, kind)
    k = len(centres)

    def sums(candidates: np.ndarray, points: np.ndarray) -> np.ndarray:
        """What all points cost if a candidate takes a slot: candidates x slots."""
        near = _between(points, centres, metric)
        order = np.argsort(near, 1, kind="stable")
        every = np.arange(len(points))
        slot, first = order[:, 0], near[every, order[:, 0]]
        second = near[every, order[:, 1]] if k > 1 else np.full(len(points), np.inf, near.dtype)
        out = np.zeros((len(candidates), k))
        step = max(1, CELLS // max(1, len(candidates)))
        for at in range(0, len(points), step):
            d = _between(candidates, points[at : at + step], metric)
            low = np.minimum(d, first[at : at + step])
            out += low.sum(1, dtype=float)[:, None]
            more = np.minimum(d, second[at : at + step]) - low
            for j in range(k):
                own = slot[at : at + step] == j
                if own.any():
                    out[:, j] += more[:, own].sum(1, dtype=float)
        return out

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for ids, data, points in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at, own = np.frombuffer(ids, "<i8"), np.frombuffer(data, kind)
                own = own.reshape(len(at), -1)
                if ids != last:
                    if last is not None:
                        yield rows(np.frombuffer(last, "<i8"), total, keep)
                    last, total = ids, 0.0
                    keep = ~np.isin(at, list(medoid_ids))
                    if same_within is not None:
                        for m in centres:
                            keep &= ~(np.abs(own - m) < same_within).all(1)
                other = np.frombuffer(points, kind)
                total = total + sums(own, other.reshape(-1, own.shape[1]))
        if last is not None:
            yield rows(np.frombuffer(last, "<i8"), total, keep)

    def rows(ids: np.ndarray, total: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        n = int(keep.sum())
        columns = [np.repeat(ids[keep], k), np.tile(np.arange(k, dtype=np.int32), n), total[keep].ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point", "slot", "cost"])

    return price


def _swap_costs(packed: DataFrame, n: int, d: int, kind: str, medoid_ids, medoids, metric: str, same_within: float | None) -> DataFrame:
    other = packed.select(F.col("data").alias("points"))
    if n * (8 + d * np.dtype(kind).itemsize) <= BROADCAST_BYTES:
        other = F.broadcast(other)
    each = packed.crossJoin(other).mapInArrow(_prices(medoid_ids, medoids, kind, metric, same_within), "point bigint, slot int, cost double")
    return each.groupBy("point", "slot").agg(F.sum("cost").alias("cost"))


def swap_costs(
    points: DataFrame, coords: Sequence[str], medoid_ids: Sequence[int], medoids: Sequence[Sequence[float]],
    id_: str = "id", metric: str = "l2", n: int | None = None, same_within: float | None = None,
) -> DataFrame:
    """point, slot, cost for every point that is no medoid and every slot that it might take. Quadratic by nature.

    A point is a medoid by its id or, with ``same_within``, if it differs from one by less than that in every coordinate.
    """
    n = points.count() if n is None else n
    return _swap_costs(blocks(points, coords, id_, n), n, len(coords), _kind(points, coords), medoid_ids, medoids, metric, same_within)


def best_swap(costs: DataFrame) -> DataFrame:
    """cost, slot, point of the cheapest swap; ties go to the lowest slot, then the lowest point."""
    return costs.agg(F.min(F.struct("cost", "slot", "point")).alias("b")).select("b.cost", "b.slot", "b.point")


class _Swaps:
    """What swaps of medoids cost over points held in memory: exactly, and from below for many candidates at once."""

    def __init__(self, points: np.ndarray, centres: np.ndarray, metric: str, chunk: int = 1024):
        near = _between(points, centres, metric)
        order = np.argsort(near, 1, kind="stable")
        slot, every = order[:, 0], np.arange(len(points))
        second = near[every, order[:, 1]] if len(centres) > 1 else np.full(len(points), np.inf, near.dtype)
        by = np.argsort(slot, kind="stable")
        self.given = points, slot, near[every, slot], second
        self.points, self.metric, self.k = points[by], metric, len(centres)
        self.first, self.second = near[every, slot][by], second[by]
        ends = np.searchsorted(slot[by], np.arange(self.k + 1))
        #: Each has points of one slot.
        self.parts = [(j, slice(a, min(a + chunk, ends[j + 1]))) for j in range(self.k) for a in range(ends[j], ends[j + 1], chunk)]
        self.single = None
        self.mean = points.mean(0, dtype=float) if len(points) else 0.0

    def _slots(self, rows: int, of_part) -> np.ndarray:
        """of_part gives a part's sums with the nearest and the second nearest as they are; rows x slots."""
        out, more = 0.0, np.zeros((rows, self.k))
        for j, at in self.parts:
            low, high = of_part(at)
            out = out + low
            more[:, j] += high - low
        return np.add(out, more.T).T

    def exact(self, candidates: np.ndarray) -> np.ndarray:
        def priced(some):
            def part(at):
                d = _between(some, self.points[at], self.metric)
                return np.minimum(d, self.first[at]).sum(1, dtype=float), np.minimum(d, self.second[at]).sum(1, dtype=float)

            return self._slots(len(some), part)

        return np.concatenate([priced(candidates[a : a + 32]) for a in range(0, len(candidates), 32)])

    def price(self, candidate: np.ndarray, slot: int) -> float:
        """One swap's cost, added up in the points' given order: medoids that are copies of each other cost the same to the last bit."""
        points, slots, first, second = self.given
        d = _between(candidate[None], points, self.metric)[0]
        return float(np.minimum(d, np.where(slots == slot, second, first)).sum(dtype=float))

    def slack(self, limit: float) -> float:
        """More than rounding can make of a bound and of a cost around ``limit``."""
        if self.points.dtype.itemsize == 4:
            return 1e-5 * limit
        n, d = self.points.shape
        most = float(np.abs(self.points).max(initial=0.0))
        far = 1.0 if self.metric == "l2" else 2 * d**0.5 * float(np.abs(self.points - self.mean).max(initial=0.0))
        return 1e-9 * limit + n * d**0.5 * 4e-15 * most * far

    def screen(self, candidates: np.ndarray) -> np.ndarray:
        """Costs from below in single precision: squared distances by a matrix product, less its largest error."""
        if self.single is None:
            p = (self.points.astype(float) - self.mean).astype("<f4")
            pp = np.einsum("ij,ij->i", p, p, dtype=float)
            self.single = np.column_stack([p, np.ones(len(p)), pp]).astype("<f4"), pp.max(initial=0.0) ** 0.5, self.first.astype("<f4"), self.second.astype("<f4")
        right, most, first, second = self.single
        c = (candidates.astype(float) - self.mean).astype("<f4")
        cc = np.einsum("ij,ij->i", c, c, dtype=float)
        wrong = (c.shape[1] + 16) * 2.0**-23 * (most + cc.max(initial=0.0) ** 0.5) ** 2
        left = np.column_stack([-2 * c, cc - wrong, np.ones(len(c))]).astype("<f4")
        room = np.empty((2, len(c) * max((z.stop - z.start for _, z in self.parts), default=0)), "<f4")

        def part(at):
            d, low = (x[: len(c) * (at.stop - at.start)].reshape(len(c), -1) for x in room)
            np.matmul(left, right[at].T, out=d)
            np.maximum(d, 0, out=d)
            if self.metric == "l2":
                np.sqrt(d, out=d)
            np.minimum(d, first[at], out=low)
            np.minimum(d, second[at], out=d)
            return low.sum(1).astype(float) * (1 - 4e-6), d.sum(1).astype(float) * (1 - 4e-6)

        return self._slots(len(c), part)

    def bounds(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        """For the members of each cell, costs from below.

        A member's distance to a point is the centre's up to the radius. Points
        that are nearer to all members than to their medoid count by the
        distance's tangent at the centre, which is below it everywhere.
        """
        cells = [c.astype(float) for c in cells]
        centre = np.stack([c.mean(0) for c in cells])
        radius = np.array([np.sqrt(((c - r) ** 2).sum(1).max()) for c, r in zip(cells, centre, strict=True)])[:, None] * (1 + 1e-12)
        l2 = self.metric == "l2"
        tiny = 1e-9 * max(1e-300, float(np.abs(self.points - self.mean).max(initial=0.0)))
        dims = centre.shape[1]
        moved = centre - self.mean

        def part(at):
            p = self.points[at].astype(float) - self.mean
            d = _between(moved, p, "l2")
            low, outside = np.maximum(d - radius, 0), d > radius + tiny
            value, least = (d, low) if l2 else (d * d, low * low)
            both = []
            for base in (self.first[at].astype(float), self.second[at].astype(float)):
                inner = outside & (d + radius <= (base if l2 else np.sqrt(base)))
                total = np.where(inner, value, np.minimum(least, base)).sum(1)
                weight = np.divide(1.0, d, out=np.zeros_like(d), where=inner) if l2 else 2.0 * inner
                both.append(np.column_stack([total, moved * weight.sum(1)[:, None] - weight @ p]))
            return both

        out, more = np.zeros((len(cells), 1 + dims)), np.zeros((len(cells), self.k, 1 + dims))
        for j, at in self.parts:
            low, high = part(at)
            out += low
            more[:, j] += high - low
        total = out[:, None] + more  # cells x slots x (value, slope)
        return [total[i, :, 0] + (c - centre[i]) @ total[i, :, 1:].T for i, c in enumerate(cells)]

    def cheapest(self, ids: np.ndarray, rows: np.ndarray, leaves: list[np.ndarray], limit: float) -> tuple[float, int, int] | None:
        """cost, slot and id of the cheapest of the candidates, given by leaves of places in ``ids`` and ``rows``, if it costs no more than ``limit``."""
        upto = limit + self.slack(limit) if limit < np.inf else np.inf
        for size in LEAVES if upto < np.inf else ():
            cells = [x[a : a + size] for x in leaves for a in range(0, len(x), size)]

            def left(some):
                both = zip(some, self.bounds([rows[x] for x in some]), strict=True) if some else ()
                return [x[~(low.min(1) > upto)] for x, low in both]

            some = cells[:: max(1, len(cells) // 8)]
            if sum(map(len, left(some))) > sum(map(len, some)) // 2:
                break  # the bounds are of little use here, as in many dimensions
            leaves = [x for a in range(0, len(cells), 64) for x in left(cells[a : a + 64]) if len(x)]
        rest = np.concatenate(leaves) if leaves else np.empty(0, int)
        if upto < np.inf and len(rest) > 64:
            rest = np.concatenate([x[~(self.screen(rows[x]).min(1) > upto)] for x in np.array_split(rest, -(-len(rest) // 128))])
        least, found = np.inf, []
        for a in range(0, len(rest), 256):
            x = rest[a : a + 256]
            cost = self.exact(rows[x])
            least = min(least, cost.min())
            at, slot = np.nonzero(cost <= min(upto, least + 1e-11 * abs(least)))
            found.append((cost[at, slot], slot, x[at]))
        if not found:
            return None
        cost, slot, at = map(np.concatenate, zip(*found, strict=True))
        near = cost <= least + 1e-11 * abs(least)
        lowest = {}  # of copies, the lowest id
        for j, x in zip(slot[near].tolist(), at[near].tolist(), strict=True):
            key = j, rows[x].tobytes()
            if key not in lowest or ids[x] < ids[lowest[key]]:
                lowest[key] = x
        return min(((self.price(rows[x], j), j, int(ids[x])) for (j, _), x in lowest.items()), default=None)


def _kept(ids: np.ndarray, rows: np.ndarray, medoid_ids: Sequence[int], centres: np.ndarray, same_within: float | None) -> np.ndarray:
    """Which points may take a slot."""
    keep = ~np.isin(ids, list(medoid_ids))
    if same_within is not None:
        for m in centres:
            keep &= ~(np.abs(rows - m) < same_within).all(1)
    return keep


def _some(packed: DataFrame, n: int, d: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and coordinates of a few points from all over."""
    step = max(FIRST_OF, -(-n // FIRST))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = ([np.frombuffer(x, k) for x in c.to_pylist()] for c, k in zip(batch.columns, ("<i8", kind), strict=True))
            taken = [(i[::step].tobytes(), x.reshape(-1, d)[::step].tobytes()) for i, x in zip(ids, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in taken], pa.binary()) for c in (0, 1)], names=["ids", "data"])

    found = packed.mapInArrow(take, "ids binary, data binary").collect()
    return np.frombuffer(b"".join(r.ids for r in found), "<i8"), np.frombuffer(b"".join(r.data for r in found), kind).reshape(-1, d)


def _first_costs(packed: DataFrame, ids: np.ndarray, rows: np.ndarray, medoid_ids, medoids, kind: str, metric: str, same_within: float | None) -> float:
    """The cost of the cheapest swap of a few candidates."""
    centres = np.array(medoids, kind)
    some = rows[_kept(ids, rows, medoid_ids, centres, same_within)]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = total + _Swaps(np.frombuffer(data, kind).reshape(-1, centres.shape[1]), centres, metric).exact(some)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "cost"])

    if not len(some):
        return float("inf")
    return packed.select("data").mapInArrow(price, "i bigint, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).agg(F.min("cost")).first()[0]


def _search(packed: DataFrame, limit: float, kind: str, medoid_ids, medoids, metric: str, same_within: float | None) -> DataFrame:
    """cost, slot, point: the cheapest swap of each task's share of the candidates, if it costs no more than ``limit``.

    Each task holds all points and takes every so many-th leaf.
    """
    spark = packed.sparkSession
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    centres = np.array(medoids, kind)
    whole = packed.agg(F.sort_array(F.collect_list(F.struct("ids", "data"))).alias("all")).select("all.ids", "all.data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                task, ids, data = (batch.column(c)[i].as_py() for c in range(3))
                ends = np.cumsum([0, *(len(x) // 8 for x in ids)])
                ids, rows = np.frombuffer(b"".join(ids), "<i8"), np.frombuffer(b"".join(data), kind)
                rows = rows.reshape(len(ids), -1)
                leaves = [np.arange(a, min(a + LEAVES[0], z)) for b, z in zip(ends, ends[1:], strict=False) for a in range(b, z, LEAVES[0])]
                keep = _kept(ids, rows, medoid_ids, centres, same_within)
                own = [x[keep[x]] for x in leaves[task::tasks]]
                best = _Swaps(rows, centres, metric).cheapest(ids, rows, [x for x in own if len(x)], limit)
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int32()), pa.array([best[2]])], names=["cost", "slot", "point"])

    each = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(whole))
    return each.mapInArrow(search, "cost double, slot int, point bigint")


def k_medoids(
    points: DataFrame, coords: Sequence[str], k: int, id_: str = "id", metric: str = "l2", tol: float | None = None,
    max_iter: int = 1000, initial_cost: str = "max", same_within: float | None = None,
) -> Clustering:
    """PAM from the first k points by id.

    Each round applies the cheapest swap and stops when none is cheaper than
    what there is. With ``initial_cost="max"`` the first swap is always
    applied; with "computed" it must improve on the first points' cost.
    ``tol`` also stops when the new cost is above that share of the old one,
    without applying the swap. ``same_within`` rules out candidates that equal
    a medoid by value. Float columns give single-precision distances.
    """
    if initial_cost not in ("max", "computed"):
        raise ValueError("initial_cost is max or computed")
    points = points.select(id_, *coords).cache()
    packed = None
    try:
        n, kind = points.count(), _kind(points, coords)
        if not 1 <= k <= n:
            raise ValueError(f"k must be 1 to {n}")
        whole = n * (8 + len(coords) * np.dtype(kind).itemsize) <= BROADCAST_BYTES
        packed = blocks(points, coords, id_, n, near=whole).cache()
        first = points.orderBy(id_).limit(k).collect()
        at = {r[id_]: [r[c] for c in coords] for r in first}
        medoids = [r[id_] for r in first]
        cost = None
        if initial_cost == "computed" or k == n:
            cost = total_cost(points, coords, [at[m] for m in medoids], metric).first().cost
        if k == n:
            return Clustering(tuple(medoids), cost, 1)
        some = _some(packed, n, len(coords), kind) if whole else None
        for rounds in range(1, max_iter + 1):
            now = (medoids, [at[m] for m in medoids])
            if whole:
                limit = min(float("inf") if cost is None else cost, _first_costs(packed, *some, *now, kind, metric, same_within))
                costs = _search(packed, limit, kind, *now, metric, same_within)
            else:
                costs = _swap_costs(packed, n, len(coords), kind, *now, metric, same_within)
            best = best_swap(costs).first()
            if best.cost is None:  # no candidates, or none as cheap
                return Clustering(tuple(medoids), cost, rounds)
            if cost is not None and (best.cost >= cost or (tol is not None and best.cost / cost > tol)):
                return Clustering(tuple(medoids), cost, rounds)
            cost = best.cost
            medoids[best.slot] = best.point
            row = points.filter(F.col(id_) == best.point).first()
            at[best.point] = [row[c] for c in coords]
        raise RuntimeError(f"no end after {max_iter} rounds")
    finally:
        points.unpersist()
        if packed is not None:
            packed.unpersist()


def k_medoids_by_matrix(matrix: DataFrame, k: int, max_iter: int = 1000) -> Clustering:
    """PAM over a stored distance matrix i, j, d of all ordered pairs, from the first k points by id.

    Each round reads the medoids' columns for the two nearest distances of
    every point, then all of the matrix for the swaps' costs.
    """
    medoids = [r.i for r in matrix.select("i").distinct().orderBy("i").limit(k).collect()]
    if len(medoids) < k or k < 1:
        raise ValueError(f"k must be 1 to {len(medoids)}")
    cost, n = None, matrix.select("i").distinct().count()
    for rounds in range(1, max_iter + 1):
        slot = F.array_position(F.array(*(F.lit(m).cast("long") for m in medoids)), F.col("j")) - 1
        pairs = F.array_sort(F.collect_list(F.struct("d", slot.cast("int").alias("slot"))))  # k for each point
        near = matrix.filter(F.col("j").isin(medoids)).groupBy("i").agg(pairs.alias("r"))
        second = F.coalesce(F.get("r", F.lit(1))["d"], F.lit(float("inf")))
        near = near.select("i", F.get("r", F.lit(0))["d"].alias("d1"), F.get("r", F.lit(0))["slot"].alias("j1"), second.alias("d2"))
        near = F.broadcast(near) if n <= BROADCAST_BYTES // 128 else near  # a row a point
        rows = matrix.filter(~F.col("j").isin(medoids)).join(near, "i")
        base, more = F.sum(F.least("d", "d1")), F.least("d", "d2") - F.least("d", "d1")
        gains = [F.sum(F.when(F.col("j1") == s, more).otherwise(0.0)).alias(f"s{s}") for s in range(k)]
        wide = rows.groupBy(F.col("j").alias("point")).agg(base.alias("base"), *gains)
        each = F.array(*(F.struct(F.lit(s).alias("slot"), (F.col("base") + F.col(f"s{s}")).alias("cost")) for s in range(k)))
        best = best_swap(wide.select("point", F.explode(each).alias("s")).select("point", "s.slot", "s.cost")).first()
        if best.cost is None or (cost is not None and best.cost >= cost):
            return Clustering(tuple(medoids), cost, rounds)
        cost = best.cost
        medoids[best.slot] = best.point
    raise RuntimeError(f"no end after {max_iter} rounds")


def medoid_rows(points: DataFrame, coords: Sequence[str], found: Clustering, id_: str = "id") -> DataFrame:
    """slot, id and coordinates of the medoids, in order of slots."""
    slots = points.sparkSession.createDataFrame([(i, int(m)) for i, m in enumerate(found.medoids)], "slot int, _id bigint")
    return slots.join(points, F.col("_id") == F.col(id_)).select("slot", F.col(id_), *coords).orderBy("slot")
