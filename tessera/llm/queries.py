"""Queries over the test tables, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table
from .exact_dedup import mark_exact
from .line_dedup import mark_lines
from .packing import pack_documents
from .pii import KINDS, count_of, joined, mark_pii
from .quality import judge
from .records import default_tokenizer, read_digests, write_records
from .sentencepieces import default_model, round_trips
from .sharding import shard_documents
from .simhash import hex_digits, mark_near
from .toxicity import learn, score_documents


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(spark, write_records(table(spark, sf_dir, "documents"), default_tokenizer()))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), default_model())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_pii(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Shares of shards 0 to 39 and of the next: those of machines of three sizes, by the shard's number alone.
SHARES = [1.0 + 0.5 * (s % 3) for s in range(41)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), SHARES[:40], next_weight=SHARES[40])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_near(table(spark, sf_dir, "documents")).select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), 2048, default_tokenizer(), keep_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": oracles.LINE_DEDUP,
    "op7_exact_dedup": oracles.EXACT_DEDUP,
    "op10_quality_rules": oracles.QUALITY,
}
