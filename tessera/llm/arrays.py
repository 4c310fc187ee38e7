"""Array expressions in linear time, for texts of any length: no step copies what it has made so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a scan takes at once; within them it copies what it has.
BLOCK = 128
#: Code points of a text's chunks.
CHUNK = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever and however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array's running results of an associative ``op`` on ints, for which 0 is neutral: block by block, then over the blocks."""

    def scan(block: Column, inclusive: bool) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = op(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now if inclusive else acc["last"])).alias("out"))

        return F.aggregate(block, start, step)["out"]

    def joined(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))), False)
        return let(before, lambda off: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: op(F.get(off, i), x)))))

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda a: scan(F.slice(v, a, F.lit(BLOCK)), True)), joined)

    return let(values, blocked)


def replaced(text: Column, spans: Column) -> Column:
    """The text with disjoint ascending spans (structs of start, end, put; code points) replaced by their ``put``."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        whole = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(whole, a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))

    def build(chunks: Column) -> Column:
        def put(s: Column) -> Column:
            before = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
            parts = F.transform(s, lambda x, i: F.concat(piece(chunks, before(i), x["start"]), x["put"]))
            return F.concat(F.array_join(parts, ""), piece(chunks, before(F.size(s)), F.length(text)))

        return let(spans, put)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), build)
