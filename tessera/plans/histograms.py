"""Histograms over the test tables' texts."""

from pyspark.sql import functions as F

from tessera.operators import histogram as H
from tessera.plans.registry import query, table

#: SQL of all bytes of a column, one row each.
_BYTES = "SELECT {keys} ('0x' || unnest(regexp_extract_all(hex(encode({column})), '..')))::INTEGER AS b FROM {table}"
_BIN = {
    "128": "((b + 127) % 128)::INTEGER",
    "letter": "(CASE WHEN b BETWEEN 65 AND 90 THEN b - 64 WHEN b BETWEEN 97 AND 122 THEN b - 96 ELSE 0 END)::INTEGER",
}


def _sql(name: str, column: str, mapping: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}{_BIN[mapping]} AS bin, count(*) AS n FROM ({_BYTES.format(keys=keys, column=column, table=name)}) GROUP BY ALL"


@query(_sql("documents", "text", "128"))
def hist_128(spark, d):
    return H.histogram(table(spark, d, "documents"), "text")


@query(_sql("documents", "text", "letter"))
def hist_letter(spark, d):
    return H.histogram(table(spark, d, "documents"), "text", "letter")


@query(f"SELECT r::INTEGER AS bin, coalesce(n, 0) AS n FROM range(128) g(r) LEFT JOIN ({_sql('documents', 'text', '128')}) ON bin = r")
def hist_dense(spark, d):
    return H.histogram(table(spark, d, "documents"), "text", dense=True)


@query(_sql("documents", "text", "letter", "lang"))
def hist_by_lang(spark, d):
    return H.histogram(table(spark, d, "documents"), "text", "letter", by="lang")


@query(
    f"""SELECT lang, r::INTEGER AS bin, coalesce(n, 0) AS n FROM range(128) g(r) CROSS JOIN (SELECT DISTINCT lang FROM documents)
        LEFT JOIN ({_sql('documents', 'text', '128', 'lang')}) h USING (lang) WHERE true AND bin = r
        UNION ALL
        SELECT lang, r::INTEGER, 0 FROM range(128) g(r) CROSS JOIN (SELECT DISTINCT lang FROM documents)
        WHERE (lang, r::INTEGER) NOT IN (SELECT (lang, bin) FROM ({_sql('documents', 'text', '128', 'lang')}))"""
)
def hist_dense_by_lang(spark, d):
    return H.histogram(table(spark, d, "documents"), "text", by="lang", dense=True)


@query(
    f"""WITH h AS ({_sql('documents', 'text', '128')}), t AS (SELECT sum(n)::BIGINT AS total FROM h)
        SELECT bin, n, round(n / total, 9) AS share FROM h, t UNION ALL SELECT -1, total, 1.0 FROM t"""
)
def hist_relfreq(spark, d):
    out = H.relative(H.histogram(table(spark, d, "documents"), "text"))
    return out.select("bin", "n", F.round("share", 9).alias("share"))


@query(
    f"""SELECT round(max(n) / sum(n), 9) AS max_share, round(min(n) / sum(n), 9) AS min_share, round((max(n) - min(n)) / sum(n), 9) AS deviation
        FROM ({_sql('documents', 'text', 'letter')})"""
)
def hist_deviation(spark, d):
    out = H.deviation(H.histogram(table(spark, d, "documents"), "text", "letter"))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(_sql("conversations", "text", "letter", "role"))
def hist_conversations(spark, d):
    return H.histogram(table(spark, d, "conversations"), "text", "letter", by="role")


@query(_sql("pages", "html", "128"))
def hist_pages(spark, d):
    return H.histogram(table(spark, d, "pages"), "html")


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text)))::BIGINT AS counted FROM documents")
def hist_total(spark, d):
    docs = table(spark, d, "documents")
    counted = H.byte_counts(docs, "text").agg(F.sum("n").alias("counted"))
    return docs.agg(F.sum(F.octet_length("text")).alias("bytes")).select("bytes", counted.scalar().alias("counted"))


@query(
    f"""SELECT bin, n FROM (SELECT CASE WHEN b < 128 THEN 0 WHEN b < 192 THEN 1 ELSE 2 END::INTEGER AS bin, count(*) AS n
        FROM ({_BYTES.format(keys='', column='text', table='documents')}) GROUP BY ALL)"""
)
def hist_own_mapping(spark, d):
    """Any expression from byte to bin is a mapping: ASCII, continuation and leading bytes."""
    kind = (lambda b: F.when(b < 128, 0).when(b < 192, 1).otherwise(2), 3)
    return H.histogram(table(spark, d, "documents"), "text", kind)
