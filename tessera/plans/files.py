"""Sinks and sources: a table is written to scratch storage in a format of the engine's and read back."""

from pyspark.sql import functions as F

from tessera.functions.scalar import clamp, shown_byte
from tessera.operators import reports
from tessera.plans.registry import query, table
from tessera.sources import files, sinks
from tessera.sources.scratch import scratch_path

TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, round(embedding[1]::DOUBLE, 9) AS x0, round(embedding[2]::DOUBLE, 9) AS x1, round(embedding[64]::DOUBLE, 9) AS x2 FROM embeddings"""
)
def csv_points(spark, d):
    """Points in several files without a header; a row's place in order of files is its id."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", *(e[k].cast("double").alias(f"x{i}") for i, k in enumerate((0, 1, 63))))
    path = scratch_path(spark, "points")
    sinks.points_csv(rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id"), ["x0", "x1", "x2"], path)
    back = files.csv_points(spark, path, 3)
    return back.select("id", *(F.round(f"x{i}", 9).alias(f"x{i}") for i in range(3)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_table(spark, d):
    """With a header; types are inferred."""
    path = scratch_path(spark, "table")
    sinks.table_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    back = files.csv_table(spark, path)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CASE WHEN s_nationkey < 5 THEN s_name END AS note FROM supplier")
def json_records(spark, d):
    """One record a line; a null field is left out and null again."""
    path = scratch_path(spark, "records")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.when(F.col("s_nationkey") < 5, F.col("s_name")).alias("note"))
    sinks.records_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_list(spark, d):
    """A list of records in one file."""
    path = scratch_path(spark, "list")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    whole = nations.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("list"))
    sinks.report_text(whole, "list", path)
    return files.records_json(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query(
    """SELECT role AS input_file_name, 't' || turn AS kernel, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS run, conv_id::DOUBLE AS time_to_device,
              length(text)::DOUBLE AS time_execution, 0.1234568::DOUBLE AS time_from_device, round(conv_id + length(text) + 0.1234568::DOUBLE, 6) AS time_total FROM conversations"""
)
def measurement_files(spark, d):
    """Measurement objects, one a file, times with seven decimals; flattened again."""
    runs = F.array_sort(F.collect_list(F.struct("conv_id", F.length("text").cast("double").alias("n"))))
    kernels = table(spark, d, "conversations").groupBy("role", "turn").agg(runs.alias("t"))
    m = F.struct(
        F.transform("t", lambda x: x["conv_id"].cast("double")).alias("timesTransferToDevice"), F.col("t.n").alias("timesExecution"),
        F.transform("t", lambda x: F.lit(0.12345678)).alias("timesTransferFromDevice"), F.array(F.lit(1).cast("long")).alias("bins"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("histogram_t"), F.col("turn").cast("string")), m)))
    objects = kernels.groupBy(F.col("role").alias("fileName")).agg(entries.alias("measurements"))
    objects = objects.select("fileName", F.lit(8).cast("long").alias("inputLengthInCharacters"), F.lit(True).alias("uniformInput"), F.lit(False).alias("useMappingLetter"), "measurements")
    path = scratch_path(spark, "measurements")
    sinks.measurement_json(objects, path, one_a_file=True)
    out = reports.flatten_measurements(files.measurement_json(spark, path))
    return out.select("input_file_name", "kernel", F.col("run").cast("long").alias("run"), "time_to_device", "time_execution", "time_from_device", F.round("time_total", 6).alias("time_total"))


def _report(spark, d):
    """A profiler's table of the events' values, in thousandths, as text files; read as lines."""
    amount = F.round(F.col("value") * 1000).cast("long")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"), F.min(amount).alias("min"), F.max(amount).alias("max"))
    line = F.format_string("    10.0  %,d  %,d  %,d.0  %,d.0  %,d  %,d  0.0  kernel_%s(unsigned char *, int)", "total", "n", "max", "min", "min", "max", "event_type")
    text = rows.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"), F.sum("n").alias("n"))
    text = text.select(F.concat(F.lit(" ** CUDA GPU Kernel Summary:\n"), "t", F.lit("\nTRACE: EVENTS "), F.col("n").cast("string")).alias("line"))
    path = scratch_path(spark, "report")
    sinks.report_text(text, "line", path)
    return files.report_lines(spark, path)


_A = "round(value * 1000)::BIGINT"


@query(
    f"""SELECT event_type AS kind, 10.0::DOUBLE AS percent, round(sum({_A}) / 1000, 6) AS total, count(*)::DOUBLE AS instances, round(max({_A}) / 1000, 6) AS avg,
               round(min({_A}) / 1000, 6) AS min, 'kernel_' || event_type || '(unsigned char *, int)' AS name FROM events GROUP BY event_type"""
)
def report_scan(spark, d):
    rows = reports.parse_rows(reports.first_lines(_report(spark, d), {t: f"kernel_{t}" for t in TYPES}), "kind")
    return rows.select("kind", "percent", F.round("total", 6).alias("total"), "instances", F.round("avg", 6).alias("avg"), F.round("min", 6).alias("min"), "name")


@query("SELECT count(*)::DOUBLE AS value FROM events")
def trace_scan(spark, d):
    return reports.traces(_report(spark, d), "EVENTS").select("value")


@query("SELECT sum(octet_length(encode(r_name)) + 1)::BIGINT AS bytes, count(*) AS lines FROM region")
def whole_texts(spark, d):
    """Whole files as bytes; every line ends with a line feed."""
    path = scratch_path(spark, "texts")
    sinks.report_text(table(spark, d, "region"), "r_name", path)
    content = files.whole_texts(spark, path, ".txt").select(F.col("content").cast("string").alias("t"))
    lines = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit("")))
    return content.agg(F.sum(F.octet_length("t")).cast("long").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query(
    """SELECT vec_id, greatest(least(vec_id % 300, 255), 32)::INTEGER AS code, CASE WHEN vec_id % 128 < 32 THEN (vec_id % 128)::VARCHAR ELSE chr((vec_id % 128)::INTEGER) END AS shown
       FROM embeddings WHERE (CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 7 END) IS NULL OR vec_id % 2 = 0"""
)
def codes(spark, d):
    """Codes as characters, clamped numbers, and a filter for nulls."""
    rest = F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 7)
    rows = table(spark, d, "embeddings").select(
        "vec_id", clamp(F.col("vec_id") % 300, 32, 255).cast("int").alias("code"), shown_byte((F.col("vec_id") % 128).cast("int")).alias("shown"), rest.alias("rest")
    )
    return rows.filter(F.col("rest").isNull() | (F.col("vec_id") % 2 == 0)).drop("rest")
