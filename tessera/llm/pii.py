"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base patterns find emails, IP addresses, cards and phone numbers. They seed a
bootstrap: what stands around seeds induces lexical patterns (a label with = or
: that touches it or else the two words in front, the two words behind, the
words on either side); patterns and what they extract form a graph, which is
scored in rounds until no instance is added (RlogF of the pattern, noisy-or of
the instance); what high-confidence patterns extract becomes an instance of
their kind, and adds spans where they stand. Against a pattern count values of
other kinds and those that cannot be of its kind; values that may be and are
not known yet count neither way. What stands behind, or on either side, weighs
less than what stands in front, so that it needs company.

Everything is DataFrame functions, in linear time on long texts. Only 64-bit
hashes of contexts and instances are shuffled, aggregated before they are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, replaced, running
from .common import done, fresh, whole_text, written
from .exact_dedup import filter_of, place_of, possibly_repeated

#: The order of kinds at equal starts.
KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats where nothing that follows can need what they give back,
# and a start only where a run begins or a match has ended, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match.
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OPEN = r"[\[({<]\x20?(?:%s)\x20?[\])}>]"
_AT, _DOT = (_OPEN % "at|@"), (_OPEN % r"dot|\.")
#: What the bootstrap may add: groups of digits over several tokens, disguised addresses, single tokens with a digit.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:"
    r"[(+]*+[0-9][0-9()./+-]*+(?:\x20\(?[0-9]{2,}+[0-9()./-]*+(?![A-Za-z]))++"
    r"|[(<\[\"']{0,3}+(?:[A-Za-z_-]{2,}+[=:][\"']?)?[A-Za-z0-9._%+-]{1,64}+(?i:"
    rf"(?:\x20?{_AT}\x20?|@)[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?{_DOT}\x20?|\x20dot\x20)[A-Za-z0-9-]{{1,63}}+)*+"
    rf"|\x20at\x20[A-Za-z0-9-]{{1,63}}+(?:(?:\x20dot\x20|\x20?{_DOT}\x20?)[A-Za-z0-9-]{{1,63}}+)++)"
    r"|[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)"
)
#: Contexts by place, and what a pattern of that place weighs beside others: in front, behind, on either side.
PLACES = {"front": 1.0, "behind": 0.7, "around": 0.75}
#: Words of a context are the outermost of so many pieces between spaces, and between line ends.
PIECES = 6
_BLANK = r"[\x20\x09-\x0D]+"
#: A pattern needs so many different instances of its kind, and this share of all that speak for or against; an instance this score.
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 5, 0.8, 0.8
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"
_SLIM = "array<struct<kind:string,start:int,end:int>>"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", F.when(F.length(digits) <= 19, digits).otherwise("1"))
    return F.length(digits).between(10, 15)


def _contexts(left: Column, right: Column) -> Column:
    """Hashes of the contexts that a span has: an array of structs of place and hash. Lower case, digits as 0.

    Seeds and candidates alike; opening brackets and quotes in front and closing ones and stops behind don't count.
    """

    def normal(side: Column, n: int) -> Column:
        near = F.substring_index(F.substring_index(side, " ", n), "\n", n)
        return F.lower(F.regexp_replace(near, "[0-9]+", "0"))

    def words(side: Column) -> Column:
        return F.array_remove(F.split(side, _BLANK, -1), "")

    def hashed(place: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.struct(F.lit(place).alias("place"), F.xxhash64(F.lit(place), value).alias("c")))

    before = F.regexp_replace(normal(left, -PIECES), r"(?<![(<\[\"'])[(<\[\"']++$", "")
    after = F.regexp_replace(normal(right, PIECES), r"^[)>\]\"'.,;:!?]+", "")

    def made(front: Column) -> Column:
        def both(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            last = F.get(a, F.size(a) - 1)
            touching = F.when(~F.regexp_like(front, F.lit(r"[\x20\x09-\x0D]$")), last)
            key = F.regexp_extract(F.coalesce(touching, F.lit("")), r"(?:^|(?<=[(<\[\"']))([a-z_-]{2,}+[=:])$", 1)
            two = F.concat_ws(" ", F.get(a, F.size(a) - 2), last)
            return F.array_compact(
                F.array(
                    hashed("front", F.when(F.length(key) > 0, key).otherwise(two)),
                    hashed("behind", F.concat_ws(" ", F.get(b, F.lit(0)), F.get(b, F.lit(1)))),
                    hashed("around", F.concat(last, F.lit(" | "), F.get(b, F.lit(0)))),
                )
            )

        return let(F.struct(words(front).alias("a"), words(after).alias("b")), both)

    return let(before, made)


def _may_be(kind: str, value: Column) -> Column:
    """Whether a value that no base pattern finds can be of a kind by its form."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "email":
        return F.regexp_like(value, F.lit(r"(?i)^[a-z0-9._%+-]+(?:@|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)[a-z0-9-]"))
    if kind == "ip":
        plain = F.regexp_like(value, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$"))
        form = r"^(?:[0-9]{1,3}(?:[\[({]?(?:\.|dot)[\])}]?[0-9]{1,3}){3}(?:[:/][0-9]+)?|(?=.*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})$"
        return ~plain & F.regexp_like(value, F.lit(form)) & ~F.regexp_like(value, F.lit("^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"))
    form = F.regexp_like(value, F.lit(r"^[(+]*[0-9][0-9\s().+/-]*$")) & ~F.regexp_like(value, F.lit(r"^(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4})$"))
    if kind == "card":
        return form & (digits.between(12, 13) | _valid("card", value))
    return form & digits.between(7, 15) & ~F.regexp_like(value, F.lit(r"^[0-9]+\.[0-9]+$|^[0-9]+(?:\.[0-9]+){3}$"))


def _matches(kind: str, pattern: str, text: Column, guard: str | None, keep=None) -> Column:
    """The matches that ``keep`` wants, in order, with code point positions: running sums of what lies between them and of themselves.

    ``left`` and ``right`` are the text on either side, as far as the match
    before the last and the match after the next, so each stretch of the text
    is in a few of them only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard:
        found = F.when(F.contains(text, F.lit(guard)), found).otherwise(F.array().cast("array<string>"))
    nothing = F.array().cast(_SPAN)

    def spans(m: Column, gap: Column, ends: Column) -> Column:
        def one(i: Column) -> Column:
            left = F.concat_ws("", F.get(gap, i - 1), F.get(m, i - 1), F.get(gap, i))
            right = F.concat_ws("", F.get(gap, i + 1), F.get(m, i + 1), F.get(gap, i + 2))
            end, value = F.get(ends, i), F.get(m, i)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), left.alias("left"), right.alias("right"))

        at = F.sequence(F.lit(0), F.size(m) - 1)
        return F.transform(F.filter(at, lambda i: keep(F.get(m, i))) if keep else at, one)

    def measured(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        with_gaps = lambda gap: let(running(F.zip_with(F.slice(gap, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x)), lambda x, y: x + y), lambda ends: spans(m, gap, ends))
        return F.when(F.size(m) > 0, let(gaps, with_gaps)).otherwise(nothing)

    return let(found, measured)


def base_spans(text: Column) -> Column:
    """Base spans of a text, by start, then by the order of kinds."""
    each = [_matches(k, PATTERNS[k], text, GUARDS[k], lambda v, k=k: _valid(k, v)) for k in KINDS]
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s.alias("s")))
    any_ = F.regexp_like(text, F.lit("[0-9@]"))
    return F.when(any_, F.transform(F.array_sort(keyed), lambda x: x["s"])).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column, base: Column) -> Column:
    """Candidates that touch no base span, without brackets, quotes and a key with = or : in front; these are context."""

    def parted(s: Column) -> Column:
        key = F.regexp_extract(s["value"], r"^((?:[<\[\"']|\((?![0-9]+\)))*(?:[A-Za-z_-]{2,}+[=:][\"']?(?![=:]|$))?)", 1)
        rest = F.regexp_replace(F.substr(s["value"], F.length(key) + 1), "(?<![\"'.,;:!?)])[\"'.,;:!?)]++$", "")

        def cut(x: Column) -> Column:
            a = s["start"] + F.length(x["key"])
            off = F.substr(s["value"], F.length(x["key"]) + F.length(x["rest"]) + 1)
            return F.struct(
                s["kind"].alias("kind"), a.alias("start"), (a + F.length(x["rest"])).alias("end"), x["rest"].alias("value"),
                F.concat(s["left"], x["key"]).alias("left"), F.concat(off, s["right"]).alias("right"),
            )

        return let(F.struct(key.alias("key"), rest.alias("rest")), cut)

    def free(tokens: Column) -> Column:
        # By start: a token is touched by a base span in front of it that ends in it or behind, or by the one that comes next.
        # Tokens are disjoint, so no other token stands between.
        own = F.transform(base, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.lit(-1).alias("i")))
        all_ = F.array_sort(F.concat(own, F.transform(tokens, lambda t, i: F.struct(t["start"].alias("a"), t["end"].alias("b"), i.alias("i")))))

        def untouched(both: Column) -> Column:
            reach = running(F.transform(both, lambda x: F.when(x["i"] < 0, x["b"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y))

            def keep(upto: Column) -> Column:
                def ok(p: Column) -> Column:
                    x, y = F.get(both, p), F.get(both, p + 1)
                    return (x["i"] >= 0) & (F.get(upto, p) <= x["a"]) & ~F.coalesce((y["i"] < 0) & (y["a"] < x["b"]), F.lit(False))

                return F.transform(F.filter(F.sequence(F.lit(0), F.size(both) - 1), ok), lambda p: F.get(tokens, F.get(both, p)["i"]))

            return let(reach, keep)

        return F.when(F.size(base) == 0, tokens).when(F.size(tokens) == 0, tokens).otherwise(let(all_, untouched))

    tokens = F.filter(F.transform(_matches("", CANDIDATE, text, None), parted), lambda t: F.length(t["value"]) >= 4)
    any_ = F.regexp_like(text, F.lit(r"[0-9@]|(?i:[\[({<\x20]at[\])}>\x20])"))
    return F.when(any_, let(tokens, free)).otherwise(F.array().cast(_SPAN))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: doc_id, rid, base spans and candidates (the latter as hashes) of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), whole_text(text).alias("text"))
    return _found(rows)


def _found(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("free", _candidates(F.col("text"), F.col("base")))

    def slim(s: Column) -> list[Column]:
        return [s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h"), _contexts(s["left"], s["right"]).alias("contexts")]

    can = lambda s: F.struct(*(_may_be(k, s["value"]).alias(k) for k in KINDS))
    base = F.transform("base", lambda s: F.struct(*slim(s)))
    free = F.transform("free", lambda s: F.struct(*slim(s), can(s).alias("can")))
    return written(rows.select("doc_id", "rid", base.alias("base"), free.alias("free")), "found")


def bootstrap(table: DataFrame) -> DataFrame:
    """c, h, kind: the contexts and instances that the rounds' high-confidence patterns extract, apart from the seeds."""
    nothing = F.struct(*(F.lit(False).alias(k) for k in KINDS))
    seeds = table.select(F.explode("base").alias("s")).select(F.explode("s.contexts").alias("x"), "s.h", "s.kind", nothing.alias("can"))
    free = table.select(F.explode("free").alias("s")).select(F.explode("s.contexts").alias("x"), "s.h", F.lit(None).cast("string").alias("kind"), "s.can")
    # The graph: one edge for each pattern and distinct instance. A value that is a seed anywhere is one everywhere.
    edges = seeds.unionAll(free).groupBy(F.col("x.c").alias("c"), "h").agg(F.min("x.place").alias("place"), F.max("kind").alias("seed"), F.max("can").alias("can"))
    edges = written(edges, "edges")
    accepted = edges.select("h", F.col("seed").alias("kind")).filter("kind is not null").groupBy("h").agg(F.min("kind").alias("kind"))
    accepted = written(accepted, "seeds")
    weight = F.lit(0.0)
    for place, w in PLACES.items():
        weight = F.when(F.col("place") == place, F.lit(w)).otherwise(weight)
    while True:
        known = edges.join(accepted, "h", "left")
        support = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS]
        # what speaks against a kind: other kinds, and values that cannot be of it
        against = [F.count(F.when(F.coalesce(F.col("kind") != k, ~F.col(f"can.{k}")), 1)).alias(f"not_{k}") for k in KINDS]
        counted = known.groupBy("c").agg(F.min("place").alias("place"), *support, *against)
        best = F.greatest(*(F.struct(F.col(k).alias("f"), (-F.col(f"not_{k}")).alias("against"), F.lit(k).alias("kind")) for k in KINDS))
        scored = counted.withColumn("b", best).select(
            "c", "place", F.col("b.kind").alias("by"), F.col("b.f").alias("f"), (F.col("b.f") / (F.col("b.f") - F.col("b.against"))).alias("confidence")
        )
        # RlogF weighs a pattern's confidence by how much it extracts; both of its factors are held to a bound
        patterns = written(
            scored.filter((F.col("f") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE))
            .select("c", "by", (F.col("confidence") * weight).alias("confidence"), (F.col("confidence") * F.log2("f")).alias("rlogf")),
            "patterns",
        )
        able = F.coalesce(*(F.when(F.col("by") == k, F.col(f"can.{k}")) for k in KINDS))
        drawn = known.filter("kind is null").join(patterns, "c").filter(able)
        miss = F.exp(F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        new = drawn.groupBy("h", "by").agg((1 - miss).alias("score"), F.sum("rlogf").alias("rlogf")).filter(F.col("score") >= LEAST_SCORE)
        # of several kinds, the one whose patterns are the strongest
        new = new.groupBy("h").agg(F.max_by("by", F.struct("rlogf", "score", "by")).alias("kind"))
        last, accepted = accepted, written(accepted.unionByName(new), "accepted")
        if accepted.count() == last.count():
            break
        done(last, patterns)
    induced = written(edges.filter("seed is null").join(accepted, "h").join(patterns, "c").filter("kind = by").select("c", "h", "kind"), "induced")
    done(edges, last, accepted, patterns)
    return induced


def _marked(table: DataFrame) -> DataFrame:
    """doc_id, rid, base and spans of the rows of ``found``."""
    induced = bootstrap(table)
    each = table.select("rid", F.explode("free").alias("s")).select("rid", "s.start", "s.end", "s.h", F.explode("s.contexts.c").alias("c"))
    more = each.join(induced, ["c", "h"])
    more = written(
        more.groupBy(F.col("rid").alias("_rid")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")), "more"
    )
    done(induced)
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = table.select("doc_id", "rid", slim.alias("base")).join(more, F.col("rid") == F.col("_rid"), "left")
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    both = F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SLIM))), lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s["end"].alias("b"), s.alias("s")))
    return out.select("doc_id", "rid", "base", F.transform(F.array_sort(both), lambda x: x["s"]).alias("spans"))


def mark_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every row.

    ``spans`` are the base spans and those that the bootstrap adds. A null
    text is empty, so it has none. Repeated rows count once among instances;
    null doc_ids are kept. An empty table gives no rows; other columns are
    ignored. Time is linear in a text's length.
    """
    return _marked(found(docs, key, text)).drop("rid")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets, e.g. <EMAIL>.

    Overlapping spans become one, named by the first. ``n_chars``, if there,
    becomes the new length. Every row is a row of its own, so null and
    repeated doc_ids share nothing. Texts without spans, null ones included,
    are unchanged. An empty table gives no rows. Rows are written once with a
    number; those whose numbers a filter of the rows with spans does not hold
    pass straight through, whatever the number of spans.
    """
    names, rid = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "_rid")
    whole = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    table = _found(whole.select(F.lit(None).cast("string").alias("doc_id"), F.col(rid).alias("rid"), whole_text(text).alias("text")))
    marked = _marked(table).filter(F.size("spans") > 0)
    of, spans = fresh(whole, "_of"), fresh(whole, "_spans")
    marked = written(marked.select(F.col("rid").alias(of), F.col("spans").alias(spans)), "spans")
    filter_, bits = filter_of(marked.select(place_of(F.col(of)).alias("p")))
    may = possibly_repeated(F.col(rid), filter_, bits)

    def merged(s: Column) -> Column:
        """Overlapping spans as one: each that begins where all before it have ended, up to where the next such begins."""

        def parts(reach: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))

            def one(firsts: Column) -> Column:
                upto = lambda j: F.get(reach, F.coalesce(F.get(firsts, j + 1), F.size(s)) - 1)
                return F.transform(
                    firsts, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), upto(j).alias("end"), F.concat(F.lit("<"), F.upper(F.get(s, i)["kind"]), F.lit(">")).alias("put"))
                )

            return let(at, one)

        return let(running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), parts)

    clean = F.when(F.col(spans).isNull(), F.col(f"`{text}`")).otherwise(replaced(whole_text(text), let(F.col(spans), merged)))
    changed = whole.filter(may).join(marked, F.col(rid) == F.col(of), "left")
    changed = changed.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
    out = whole.filter(~may).select(*names).unionByName(changed)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("long", "integer") else out
