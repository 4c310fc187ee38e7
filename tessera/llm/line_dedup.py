"""Line deduplication across documents.

Lines explode with their normalised key's 128-bit hash and their position; a
hash found in enough distinct documents is frequent and stays only in the
largest doc_id holding it. Each document that loses lines learns their
positions and is put together again from the stretches between them; the texts
of all others, which a filter tells, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, done, lower_ascii, whole_text, written
from .exact_dedup import filter_of, place_of, possibly_repeated


def _keyed(lines: Column, min_chars: int) -> Column:
    """Positions from 0 and hashes of the lines whose keys are long enough."""

    def one(line: Column, at: Column) -> Column:
        # a line shorter than the minimum has no longer key
        key = lower_ascii(F.trim(line, F.lit(SPACES)))
        h = F.struct(at.alias("at"), F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))
        return F.when((F.length(line) >= min_chars) & (F.length(key) >= min_chars), h)

    return F.array_compact(F.transform(lines, one))


def mark_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row's doc_id, n_lines, n_dropped and the text without its dropped lines (``kept_text``).

    A null or empty text is one empty line. Short lines never go. Documents
    count by doc_id: repeated rows of one doc_id are one document and lose the
    same lines; a null doc_id is the smallest. An empty table gives no rows;
    other columns are ignored.
    """
    # A row is told by its doc_id and its text's hash, so that repeated doc_ids keep their own positions.
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("_text")).withColumn("_row", F.xxhash64("_text"))
    found = rows.select("doc_id", "_row", F.explode(_keyed(F.split("_text", "\n", -1), min_chars)).alias("h"))
    # Small beside the texts: some 30 bytes for each line that is long enough, so the texts are read twice, not three times.
    found = written(found.select("doc_id", "_row", "h.at", "h.a", "h.b"), "lines")
    # Rows bound documents from above, and counting them combines before the shuffle; few hashes pass.
    often = written(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs).select("a", "b"), "often")
    held = written(found.join(often, ["a", "b"]), "held")
    frequent = written(
        held.select("a", "b", "doc_id")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("_keeper"))
        .filter(F.col("_docs") >= min_docs)
        .select("a", "b", "_keeper"),
        "frequent",
    )
    # Unique hashes on the right; a line of a third of all documents only lengthens the left, which AQE splits.
    lost = held.join(frequent, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    lost = lost.select(F.col("doc_id").alias("_doc"), F.col("_row").alias("_of"), "at")
    lost = written(lost.groupBy("_doc", "_of").agg(F.array_sort(F.collect_set("at")).alias("_lost")), "lost")
    done(found, often, held, frequent)
    filter_, bits = filter_of(lost.select(place_of(F.struct(F.col("_doc"), F.col("_of"))).alias("p")))
    may = possibly_repeated(F.struct(F.col("doc_id"), F.col("_row")), filter_, bits)
    total = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    n_lines = total.cast("long").alias("n_lines")
    straight = rows.filter(~may).select("doc_id", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.col("_text").alias("kept_text"))
    # The same plan at every size: what is lost grows with the input, so it is never broadcast.
    joined = rows.filter(may).join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_of")), "left")
    joined = joined.withColumn("_lines", F.when(F.col("_lost").isNotNull(), F.split("_text", "\n", -1)))
    # Reassembly by position: what lies between the lost positions, stretch by stretch.
    n = F.size("_lost")

    def stretch(k: Column) -> Column:
        after = F.when(k == 0, F.lit(-1)).otherwise(F.get("_lost", k - 1))
        upto = F.when(k == n, F.size("_lines")).otherwise(F.get("_lost", k))
        return F.slice("_lines", after + 2, upto - after - 1)

    stays = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), stretch)), "\n")
    dropped = F.when(F.col("_lost").isNotNull(), n).otherwise(F.lit(0))
    kept = F.when(F.col("_lost").isNotNull(), stays).otherwise(F.col("_text"))
    return straight.unionByName(joined.select("doc_id", n_lines, dropped.cast("long").alias("n_dropped"), kept.alias("kept_text")))
