"""Every operator on texts of a megabyte."""

import time

import pytest

from tessera.llm import exact_dedup, jaccard, line_dedup, packing, pii, quality, records, sentencepieces, sharding, simhash, toxicity

MODEL = toxicity.Model({"blockhead": 1.0}, {}, frozenset())
RUNS = {
    "records": lambda df: records.read_digests(df.sparkSession, records.write_records(df, records.default_tokenizer())),
    "sentencepiece": lambda df: sentencepieces.round_trips(df, sentencepieces.default_model()).filter("round_trip"),
    "redact": pii.redact,
    "sharding": lambda df: sharding.shard_documents(df, [1.0, 2.0]),
    "lines": line_dedup.mark_lines,
    "toxicity": lambda df: toxicity.drop_toxic(df, MODEL),
    "exact": exact_dedup.mark_exact,
    "simhash": simhash.mark_near,
    "packing": lambda df: packing.pack_documents(df).filter("piece = 0"),
    "quality": quality.judge,
}


@pytest.mark.parametrize("name", RUNS)
def test_long_texts(huge, name):
    began = time.perf_counter()
    assert len(RUNS[name](huge).select("doc_id").collect()) == 6
    assert time.perf_counter() - began < 90


def test_long_texts_near(huge):
    assert sorted(r.doc_id for r in jaccard.drop_similar(huge).select("doc_id").collect()) == [0, 1, 2, 4, 5]
