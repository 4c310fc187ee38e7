"""Quality rules whose cutoffs adapt to each language and source.

Every document's measures go, per language and source, into logarithmic
quantile sketches (DDSketch: Masson, Rim and Lee, VLDB 2019): counts of
values by bucket of relative width, which merge by addition in any order.
Cutoffs come from the sketches' quartiles (wide outer fences), so they follow
each group's own distribution instead of fixed numbers. A group's quartiles
are drawn towards those of all groups as if it had some more rows of theirs,
so a small group leans on the others and a large one on itself, by one rule.
A join brings the cutoffs to the documents, which are then filtered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, done, whole_text, written

SYMBOLS = "#*$%&|<>"
#: Relative accuracy of the sketches' quantiles.
ACCURACY = 0.02
#: A value is out beyond the quartile by so many times the quartiles' distance, in logarithms, and by this factor at least.
FENCE, LEAST_FACTOR = 3.0, 3.0
#: The quartiles over all groups count in each group's as so many rows.
PRIOR_ROWS = 20.0


def _cleared(text: Column, characters: str) -> Column:
    """``text`` without some ASCII characters, byte-wise."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _starts(df: DataFrame, p: str) -> DataFrame:
    """From column ``g``, the hashes of a text's windows in order, ``s``: the sorted positions of those that occur again.

    Hashes and positions are packed into one long each (43 and 21 bits) and
    sorted, so that equal hashes are neighbours. Texts in which two hashes
    share their 43 bits, or with over 2^21 windows, take whole structs.
    """
    high, low = F.lit(-(1 << 21)), F.lit((1 << 21) - 1)
    n, kinds = F.size(f"{p}g"), F.size(F.array_distinct(f"{p}g"))
    df = df.withColumn(f"{p}again", n > kinds)
    df = df.withColumn(f"{p}p", F.when(F.col(f"{p}again"), F.sort_array(F.transform(f"{p}g", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))))
    df = df.withColumn(f"{p}packs", (n <= 1 << 21) & (F.size(F.array_distinct(F.transform(f"{p}p", lambda x: x.bitwiseAND(high)))) == kinds))
    near = F.filter(
        F.sequence(F.lit(0), F.size(f"{p}p") - 2),
        lambda k: F.get(f"{p}p", k).bitwiseXOR(F.get(f"{p}p", k + 1)).between(F.lit(0), low),
    )
    packed = F.flatten(F.transform(near, lambda k: F.array(F.get(f"{p}p", k).bitwiseAND(low), F.get(f"{p}p", k + 1).bitwiseAND(low))))
    pairs = F.array_sort(F.transform(f"{p}g", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn(f"{p}q", F.when(F.col(f"{p}again") & ~F.col(f"{p}packs"), pairs))
    plain = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(f"{p}q") - 2), lambda k: F.get(f"{p}q", k)["h"] == F.get(f"{p}q", k + 1)["h"]),
            lambda k: F.array(F.get(f"{p}q", k)["i"], F.get(f"{p}q", k + 1)["i"]),
        )
    )
    found = F.when(~F.col(f"{p}again"), F.array().cast("array<bigint>")).when(F.col(f"{p}packs"), packed).otherwise(plain)
    return df.withColumn(f"{p}s", F.sort_array(F.array_distinct(found)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added (null text: none).

    Columns of ``docs`` with these names are replaced, all others kept.
    """
    p = "_"  # no column's name begins with it
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    out = docs.withColumn(f"{p}body", whole_text(text))
    spaced = F.col(f"{p}body")
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    out = out.withColumn(f"{p}w", F.array_remove(F.split(spaced, " ", -1), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size(f"{p}w") - 3), lambda i: F.xxhash64(F.get(f"{p}w", i), F.get(f"{p}w", i + 1), F.get(f"{p}w", i + 2)))
    out = out.withColumn(f"{p}g", F.when(F.size(f"{p}w") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    out = _starts(out, p)
    # each start adds three words less what the start before it has covered
    prior = F.concat(F.array(F.lit(-3).cast("long")), F.slice(f"{p}s", 1, F.greatest(F.size(f"{p}s") - 1, F.lit(0))))
    covered = F.aggregate(F.zip_with(f"{p}s", prior, lambda s, q: F.least(s - q, F.lit(3))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = out.withColumn(f"{p}ls", F.filter(F.split(f"{p}body", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0))
    return out.withColumns(
        {
            "n_words": F.size(f"{p}w").cast("long"),
            "word_chars": F.length(_cleared(F.col(f"{p}body"), SPACES)).cast("long"),
            "n_symbols": (F.octet_length(f"{p}body") - F.octet_length(_cleared(F.col(f"{p}body"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(f"{p}ls") - F.size(F.array_distinct(f"{p}ls"))).cast("long"),
            "n_repeat_words": F.when(F.size(f"{p}s") > 0, covered).otherwise(F.lit(0)).cast("long"),
        }
    ).drop(f"{p}w", f"{p}g", f"{p}ls", f"{p}body", f"{p}s", f"{p}p", f"{p}q", f"{p}again", f"{p}packs")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The adaptive measures, null where undefined, and which sides are cut. Where most documents have none of a
#: thing, a constant keeps little of it from being far out: 0.2 symbols a word, 4 lines, 0.15 of the words.
RULES = {
    "mean_word": (lambda: F.col("word_chars") / F.col("n_words"), True, True),
    "symbols": (lambda: F.col("n_symbols") / F.col("n_words") + 0.2, False, True),
    "dup_lines": (lambda: F.col("n_dup_lines") + F.lit(4.0), False, True),
    "repeats": (lambda: F.col("n_repeat_words") / F.col("n_words") + 0.15, False, True),
}


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """Bucket counts (group, rule, bucket, n): rows of two such tables merge by summing ``n``."""
    width = math.log((1 + ACCURACY) / (1 - ACCURACY))
    buckets = [
        F.struct(F.lit(rule).alias("rule"), F.floor(F.ln(value()) / width).cast("int").alias("bucket"))
        for rule, (value, _, _) in RULES.items()
    ]
    passing = measured.filter(~base_failed())  # so there are words to divide by
    return (
        passing.select(*groups, F.explode(F.array(*buckets)).alias("x"))
        .groupBy(*groups, F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cutoffs(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: [low, high] of every rule, from the sketches' quartiles and those of all groups together."""
    width = math.log((1 + ACCURACY) / (1 - ACCURACY))

    def quartiles(counted: DataFrame, by: list[str]) -> DataFrame:
        run = Window.partitionBy(*by, "rule").orderBy("bucket")
        whole = Window.partitionBy(*by, "rule")
        ranked = counted.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(whole)})

        def quantile(q: float) -> Column:
            # the first bucket that reaches the quantile's rank; its middle, in logarithms
            return (F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bucket"))) + 0.5) * width

        return ranked.groupBy(*by, "rule").agg(F.max("total").alias("total"), quantile(0.25).alias("lo"), quantile(0.75).alias("hi"))

    own = quartiles(sketch, groups)
    merged = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    every = quartiles(merged, []).select(F.col("rule").alias("_rule"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    joined = own.join(F.broadcast(every), F.col("rule") == F.col("_rule"))  # a row for each rule
    drawn = lambda q: (F.col("total") * F.col(q) + F.lit(PRIOR_ROWS) * F.col(f"_{q}")) / (F.col("total") + F.lit(PRIOR_ROWS))
    joined = joined.withColumns({"lo": drawn("lo"), "hi": drawn("hi")})
    reach = F.greatest(F.lit(FENCE) * (F.col("hi") - F.col("lo")), F.lit(math.log(LEAST_FACTOR)))
    joined = joined.withColumns({"low": F.col("lo") - reach, "high": F.col("hi") + reach})
    aggs = [F.max(F.when(F.col("rule") == r, F.struct("low", "high"))).alias(f"_cut_{r}") for r in RULES]
    return joined.groupBy(*groups).agg(*aggs)


def judge(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Every row's doc_id, measures, ``base_failed`` and ``kept``.

    ``kept`` is false if a base rule fails or a measure lies beyond its
    group's adaptive fence. Null languages and sources are groups of their
    own. A group without a passing document has no fences. An empty table
    gives no rows; other columns are ignored.
    """
    keys = [f"_by{i}" for i in range(len(groups))]
    flat = docs.select("doc_id", F.col(text).alias("_text"), *(F.coalesce(F.col(g).cast("string"), F.lit("\x00")).alias(k) for g, k in zip(groups, keys, strict=True)))
    columns = ["doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = written(measures(flat, "_text").select(*columns), "measures")
    sketch = written(sketches(measured, keys), "sketches")
    cuts = cutoffs(sketch, keys)
    # A row a group. Written, so that its size is known: Spark broadcasts it where it is small, and the measures stay where they are.
    cuts = written(cuts.select(*(F.col(k).alias(f"{k}_") for k in keys), *(f"_cut_{r}" for r in RULES)), "cutoffs")
    done(sketch)
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"{k}_")) if on is None else on & (F.col(k) == F.col(f"{k}_"))
    out = measured.join(cuts, on, "left")
    verdict = ~base_failed()
    for rule, (value, low, high) in RULES.items():
        x = F.ln(F.when(F.col("n_words") > 0, value()))
        for used, side in ((low, "low"), (high, "high")):
            if used:
                edge = F.col(f"_cut_{rule}")[side]
                verdict = verdict & F.coalesce(x >= edge if side == "low" else x <= edge, F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("kept")
    )
