"""A corpus from raw documents to packed training sequences, in stages that each keep all that the last one kept.

Counted with ``tessera.llm``: it goes where that subpackage goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import done, table, written
from tessera.llm.exact_dedup import drop_exact
from tessera.llm.jaccard import drop_similar
from tessera.llm.packing import pack_documents
from tessera.llm.pii import redact
from tessera.llm.toxicity import drop_toxic, learn


# In all stages: a null text counts as empty and, where its row stays, stays null; null and repeated doc_ids are rows like
# others; an empty table gives no rows; other columns, whatever their names, are kept (by all stages but the last).


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose score is below the threshold; the model is learned from the labelled ones.

    Empty texts are no toxic ones; equal texts go or stay together.
    """
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of equal texts, white space aside; empty and null ones are one group."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8's SimHash links, verified, and what they can't reach: one document of each group of near-duplicates.

    Five-word shingles, Jaccard similarity 0.8 or more; the smallest doc_id
    stays, a null one only where there is no other. Texts without words are
    one group.
    """
    return drop_similar(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: all documents, personal data replaced by its kind; what the contexts induce is learned from this input."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: a row for each piece of a document with its ids and its place in a sequence; an empty text is one id."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("pii", pii), ("best_fit_packing", packing)]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        done(last)
    return STAGES[-1][1](spark, docs, sf_dir)
