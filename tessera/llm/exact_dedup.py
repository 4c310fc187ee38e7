"""Exact deduplication with two passes over a Bloom filter of text hashes.

Pass one counts, for every place of a blocked Bloom filter (a word and two of
its bits, 8 bytes), how many rows have it; equal places combine before they
are sent, and neither texts nor whole hashes shuffle. The places that two or
more rows have make the filter. In pass two a row whose bits are set possibly
repeats; only such rows shuffle and are compared by SHA-256, the rest pass
straight through. Absence is certain, so no copy is ever missed; a full filter
merely lets more rows shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole_text, without_spaces, written

#: Bits of the filter for each repeated place, and its size's bounds: 2^16 to 2^28 bits (32 MB in each executor).
BITS_PER_PLACE, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
WORDS_IN_BLOCK = 1024
#: Places are counted among so many; much finer than the filter, so that few rows share one by accident.
PLACES = 1 << 56


def normal_form(text: str = "text") -> Column:
    return without_spaces(whole_text(text))


def place_of(key: Column) -> Column:
    """A row's place: its word (of any power of two, the lowest bits decide) and, above that, its two bits."""
    return F.xxhash64(key).bitwiseAND(F.lit(PLACES - 1))


def _word_and_bits(place: Column, bits: int) -> tuple[Column, Column]:
    word = place.bitwiseAND(F.lit(bits // 64 - 1))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(place, at).bitwiseAND(F.lit(63)).cast("int"))
    return word, one(44).bitwiseOR(one(50))


def repeat_filter(keys: DataFrame, key: str) -> tuple[Column, int]:
    """The filter of the places that two or more rows have, as blocks of 64-bit words, and its number of bits.

    Its size depends on the number of such places up to ``MOST_BITS`` and on
    nothing else. It enters plans as a scalar subquery: one row, computed once.
    """
    counted = keys.select(place_of(F.col(key)).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return filter_of(counted.filter("n > 1").select("p"))


def filter_of(places: DataFrame) -> tuple[Column, int]:
    """The filter of the places in column ``p``."""
    hot = written(places, "places")
    n, bits = hot.count(), LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_PER_PLACE):
        bits *= 2
    word, both = _word_and_bits(F.col("p"), bits)
    zeros = hot.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = zeros.unionAll(hot.select(word.alias("w"), both.alias("bits"))).groupBy("w").agg(F.expr("bit_or(bits)").alias("bits"))
    blocks = words.groupBy(F.expr(f"w div {WORDS_IN_BLOCK}").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct(F.expr(f"w % {WORDS_IN_BLOCK}").alias("i"), "bits")))["bits"].alias("words")
    )
    whole = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("b", "words")))["words"].alias("f"))
    return whole.scalar(), bits


def possibly_repeated(key: Column, filter_: Column, bits: int) -> Column:
    """True for a key that may occur in another row, or whose place the filter may hold; false only if that is not so."""
    word, both = _word_and_bits(place_of(key), bits)
    words = F.get(filter_, F.shiftright(word, 10).cast("int"))
    return F.get(words, word.bitwiseAND(F.lit(WORDS_IN_BLOCK - 1)).cast("int")).bitwiseAND(both) == both


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(normal_form(text), 256))


def mark_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null equals empty. The
    row with most code points, then the smallest doc_id stays (a null doc_id
    loses against any other). Of repeated rows with one doc_id and length one
    stays. An empty table gives no rows; further columns are not read.
    """
    length = F.length(whole_text(text)).cast("long")
    digests = written(docs.select(F.col(key).alias("doc_id"), length.alias("_len"), _digest(text).alias("_sha"), F.monotonically_increasing_id().alias("_rid")), "digests")
    filter_, bits = repeat_filter(digests, "_sha")
    marked = digests.withColumn("_again", possibly_repeated(F.col("_sha"), filter_, bits))
    hexed = F.lower(F.hex("_sha")).alias("text_sha256")
    once = marked.filter(~F.col("_again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed
    )
    again = marked.filter("_again")
    rank = F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_rid").alias("r"))
    groups = again.groupBy(F.col("_sha").alias("_of")).agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("_best"))
    groups = written(groups, "groups")  # a shuffle of its own, without which AQE can't split the join
    # One row for each hash on the right; a hot group only lengthens the left, which AQE splits.
    more = again.join(groups, F.col("_sha") == F.col("_of")).select(
        "doc_id", F.col("_best.d").alias("keep_id"), "group_size", (F.col("_best.r") == F.col("_rid")).alias("kept"), hexed
    )
    return once.unionByName(more)


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, under the rules of ``mark_exact``.

    Each text is normalised and hashed once: the rows are written with their
    digests. Rows that cannot repeat are never shuffled. Of a hot group each
    task keeps one row before anything is sent. Rows alike in key and text are
    interchangeable; one of them stays.
    """
    sha, rid, again = fresh(docs, "_sha"), fresh(docs, "_rid"), fresh(docs, "_again")
    hashed = written(docs.withColumns({sha: _digest(text), rid: F.monotonically_increasing_id()}), "hashed")
    filter_, bits = repeat_filter(hashed, sha)
    marked = hashed.withColumn(again, possibly_repeated(F.col(sha), filter_, bits))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(-F.length(whole_text(text)), F.col(f"`{key}`").isNull(), F.col(f"`{key}`"), F.col(rid))
    best = marked.filter(again).groupBy(sha).agg(F.min_by(F.struct(*names), rank).alias(again))
    return marked.filter(~F.col(again)).select(*names).unionByName(best.select(*(F.col(again)[c].alias(c) for c in docs.columns)))
