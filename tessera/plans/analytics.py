"""Measurement analytics over the test tables."""

from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import reports
from tessera.plans.registry import query, table
from tessera.sources import generators

TYPES = ("click", "error", "purchase", "signup", "view")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    """SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS median,
              round(quantile_cont(value, 0.9), 6) AS q90, round(max(value), 6) AS max FROM events GROUP BY event_type"""
)
def quantile_summary(spark, d):
    return _rounded(A.quantile_summary(table(spark, d, "events"), ["event_type"], "value"), "min", "q10", "median", "q90", "max")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY ALL")
def group_mean(spark, d):
    out = A.means(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", "l_linestatus", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(
    """SELECT event_type, round(avg(value), 6) AS avg, round(median(value), 6) AS med, round(min(value), 6) AS min, round(max(value), 6) AS max,
              round(stddev_samp(value), 6) AS stddev FROM events GROUP BY event_type"""
)
def row_statistics(spark, d):
    return _rounded(A.statistics(table(spark, d, "events"), ["event_type"], "value"), "avg", "med", "min", "max", "stddev")


@query("SELECT event_type, round((max(value) - min(value)) / sum(value), 9) AS deviation FROM events GROUP BY event_type")
def relative_deviation(spark, d):
    return _rounded(A.relative_deviation(table(spark, d, "events"), ["event_type"], "value"), "deviation", digits=9)


_PIVOT = ", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 4) AS \"{t}\"" for t in TYPES)


@query(f"SELECT user_id, {_PIVOT} FROM events GROUP BY user_id")
def pivot(spark, d):
    """Unique cells: sums by user and type first."""
    sums = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return _rounded(A.pivot_unique(sums, ["user_id"], "event_type", "v", TYPES), *TYPES, digits=4)


@query("SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY user_id")
def pivot_mean(spark, d):
    return _rounded(A.pivot_mean(table(spark, d, "events"), ["user_id"], "event_type", "value", TYPES), *TYPES)


@query(
    """SELECT l_orderkey, l_linenumber, name, round(CASE name WHEN 'l_discount' THEN l_discount ELSE l_tax END, 4) AS value
       FROM lineitem CROSS JOIN (SELECT unnest(['l_discount', 'l_tax']) AS name)"""
)
def unstack(spark, d):
    return _rounded(A.wide_to_long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]), "value", digits=4)


@query(
    """WITH m AS (SELECT user_id, event_type, median(value) AS med FROM events GROUP BY ALL)
       SELECT user_id, event_type, round(max(CASE WHEN event_type = 'view' THEN med END) OVER (PARTITION BY user_id) / nullif(med, 0), 6) AS speedup FROM m"""
)
def speedup(spark, d):
    medians = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("med"))
    return _rounded(A.speedup(medians, ["user_id"], "event_type", "med", "view"), "speedup").select("user_id", "event_type", "speedup")


@query(
    """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
            b AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
       SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, round(a.v / nullif(b.v, 0), 6) AS ratio FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey"""
)
def penalty(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    out = A.ratio(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'N'"), ["l_suppkey"], "v")
    return _rounded(out, "ratio")


@query(
    """WITH t AS (SELECT l_returnflag, sum(l_extendedprice) AS total, sum(l_extendedprice * l_discount) AS discount, sum(l_extendedprice * l_tax) AS tax FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, part, round(amount, 2) AS amount, round(amount / total * 100, 6) AS percent FROM (
         SELECT l_returnflag, total, unnest(['discount', 'tax', 'rest']) AS part, unnest([discount, tax, total - discount - tax]) AS amount FROM t)"""
)
def composition(spark, d):
    price = F.col("l_extendedprice")
    sums = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(price).alias("total"), F.sum(price * F.col("l_discount")).alias("discount"), F.sum(price * F.col("l_tax")).alias("tax"))
    out = A.composition(sums, ["l_returnflag"], "total", ["discount", "tax"])
    return out.select("l_returnflag", "part", F.round("amount", 2).alias("amount"), F.round("percent", 6).alias("percent"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice) - ln(l_quantity))), 4) AS b FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY ALL")
def powerlaw_fit(spark, d):
    return _rounded(A.proportional_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "b", digits=4)


@query(
    """SELECT f AS l_returnflag, s AS l_linestatus, n FROM (SELECT unnest(['A', 'N', 'R', 'Z']) AS f) CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS s)
       LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) ON l_returnflag = f AND l_linestatus = s"""
)
def category_complete(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return A.complete(counts, {"l_returnflag": ["A", "N", "R", "Z"], "l_linestatus": ["F", "O", "P"]}).select("l_returnflag", "l_linestatus", "n")


@query("SELECT DISTINCT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) OVER () AS suppliers FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem)")
def distinct_rows(spark, d):
    rows = table(spark, d, "lineitem")
    n = rows.agg(F.countDistinct("l_suppkey").alias("n"))
    return rows.select("l_returnflag", "l_linestatus").dropDuplicates().withColumn("suppliers", n.scalar())


@query(
    """SELECT event_type, event_id, from_first, from_last FROM (
         SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INTEGER AS from_first,
                row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS from_last FROM events)
       WHERE from_first <= 1 OR from_last <= 2"""
)
def first_last(spark, d):
    return A.edges(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 1, 2).select("event_type", "event_id", "from_first", "from_last")


@query(
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r > 2"""
)
def all_but_last_two(spark, d):
    return A.without_last(table(spark, d, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn")


@query(
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS kind FROM customer
       UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier"""
)
def union_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.lit("customer").alias("kind"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    return a.unionByName(b)


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END::INTEGER AS status,
              row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END, o_totalprice, o_orderkey)::INTEGER AS place
       FROM orders QUALIFY place <= 100"""
)
def ordinal_sort(spark, d):
    """The first hundred orders in a custom order of their status."""
    rows = table(spark, d, "orders").withColumn("status", A.ordinal(F.col("o_orderstatus"), ["P", "O", "F"]))
    top = rows.orderBy("status", "o_totalprice", "o_orderkey").limit(100)
    place = F.expr("row_number() over (order by status, o_totalprice, o_orderkey)")
    return top.select("o_orderkey", "status", place.alias("place"))


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 200000 AND o_orderdate IS NOT NULL
         AND o_custkey IN (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]))"""
)
def filters(spark, d):
    powers = [2**i for i in range(11)]
    wanted = (F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") <= 200000)
    return table(spark, d, "orders").filter(wanted & F.col("o_orderdate").isNotNull() & F.col("o_custkey").isin(powers)).select("o_orderkey", "o_orderpriority")


@query(
    """SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def metadata_join(spark, d):
    """Facts with their small metadata; Spark broadcasts what its threshold allows."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return counts.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers")


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS absent FROM events")
def json_fields(spark, d):
    parsed = F.from_json("props", "k bigint, missing string")
    return table(spark, d, "events").withColumn("j", parsed).select("event_id", "event_type", "j.k", F.col("j.missing").alias("absent"))


@query(
    """SELECT conv_id::VARCHAR AS source_key, role AS kernel, run::BIGINT AS run, time_to_device, time_execution, time_from_device, time_total FROM (
         SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run, turn::DOUBLE AS time_to_device,
                length(text)::DOUBLE AS time_execution, 0.5::DOUBLE AS time_from_device, turn + length(text) + 0.5::DOUBLE AS time_total FROM conversations)"""
)
def json_flatten(spark, d):
    """Conversations as measurement objects: written to JSON text, parsed and flattened again."""
    from tessera.sources.files import MEASUREMENT

    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n"))))
    by_role = table(spark, d, "conversations").groupBy("conv_id", "role").agg(turns.alias("t"))
    m = F.struct(
        F.transform("t", lambda x: x["turn"].cast("double")).alias("timesTransferToDevice"), F.col("t.n").alias("timesExecution"),
        F.transform("t", lambda x: F.lit(0.5)).alias("timesTransferFromDevice"), F.array(F.lit(1).cast("long")).alias("bins"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("histogram_"), "role"), m)))
    objects = by_role.groupBy("conv_id").agg(entries.alias("measurements"))
    text = objects.select(F.col("conv_id").cast("string").alias("source_key"), F.to_json(F.struct("measurements")).alias("json"))
    parsed = text.select("source_key", F.from_json("json", MEASUREMENT).alias("j")).select("source_key", "j.*")
    out = reports.flatten_measurements(parsed)
    return out.select("source_key", "kernel", F.col("run").cast("long").alias("run"), "time_to_device", "time_execution", "time_from_device", "time_total")


#: A report as profilers print it, with either mark between thousands.
REPORT = [
    " ** CUDA GPU Kernel Summary:",
    "     60.5        1,234,567        100  12,345.7  12,000.0     9,876    20,001      1,234.5  Blur(unsigned char *, int)",
    "     39.5        1'000'000          1  1'000'000.0  1'000'000.0  1'000'000  1'000'000          0.0  Grayscale(unsigned char *)",
    "      1.0        9,999            3   3,333.0   3,333.0     3,333     3,333          0.0  Blur(again)",
    "TRACE: ITERATIONS 12 ns",
]
_LINES = " UNION ALL ".join(f"SELECT {i} AS line_no, '{x.replace(chr(39), chr(39) * 2)}' AS line" for i, x in enumerate(REPORT))
_CELL = "replace(replace(regexp_split_to_array(trim(line), '\\s+')[{i}], ',', ''), '''', '')::DOUBLE"


@query(
    f"""WITH l AS ({_LINES}), f AS (
          SELECT 'blur' AS kind, arg_min(line, line_no) AS line FROM l WHERE contains(line, 'Blur') UNION ALL
          SELECT 'grayscale', arg_min(line, line_no) FROM l WHERE contains(line, 'Grayscale'))
        SELECT kind, {_CELL.format(i=1)} AS percent, round({_CELL.format(i=2)} / 1000, 6) AS total, {_CELL.format(i=3)} AS instances,
               round({_CELL.format(i=4)} / 1000, 6) AS avg, round({_CELL.format(i=8)} / 1000, 6) AS stddev,
               array_to_string(regexp_split_to_array(trim(line), '\\s+')[9:], ' ') AS name FROM f"""
)
def report_parse(spark, d):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(REPORT)], "path string, line_no int, line string")
    rows = reports.parse_rows(reports.first_lines(lines, {"blur": "Blur", "grayscale": "Grayscale"}), "kind")
    return rows.select("kind", "percent", F.round("total", 6).alias("total"), "instances", F.round("avg", 6).alias("avg"), F.round("stddev", 6).alias("stddev"), "name")


@query("SELECT 'r' AS path, 12.0::DOUBLE AS value")
def trace_parse(spark, d):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(REPORT)], "path string, line_no int, line string")
    return reports.traces(lines, "ITERATIONS")


@query("SELECT k, n FROM (SELECT unnest([3, 5, 10])::BIGINT AS k) CROSS JOIN (SELECT unnest([100, 1000, 10000])::BIGINT AS n)")
def parameter_grid(spark, d):
    return generators.grid(spark, k=[3, 5, 10], n=[100, 1000, 10000])


@query("SELECT range AS i, round(1 + range * 9 / 36.0, 9) AS x FROM range(37)")
def spaced_sequence(spark, d):
    out = generators.sequence(spark, 1.0, 10.0, 37)
    return out.select("i", F.round("x", 9).alias("x"))
