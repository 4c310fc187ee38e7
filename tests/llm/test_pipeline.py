"""The pipeline's stages, each against plain Python on its own input."""

import zlib
from collections import Counter

import numpy as np
from test_pii import plain as plain_spans
from test_jaccard import kept as near_kept
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm.records import default_tokenizer
from tessera.llm.toxicity import learn, score_documents

DATA = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def redacted(text):
    spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text)))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, -b)
    return out + text[at:]


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, DATA)
    model = learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    toxic = {r.doc_id for r in score_documents(docs, model).filter("predicted = 1").collect()}
    assert clean.schema.names == docs.schema.names
    kept = {d: t for d, t in rows.items() if d not in toxic}
    assert {r.doc_id: r.text for r in clean.collect()} == kept

    exact = stages["exact_dedup"](spark, clean, DATA)
    best = {}
    for d, t in kept.items():
        key = "".join(c for c in t if c not in WS)
        best[key] = min(best.get(key, (1, 0)), (-len(t), d))
    kept = {d: kept[d] for _, d in best.values()}
    assert {r.doc_id: r.text for r in exact.collect()} == kept

    near = stages["simhash_near_dedup"](spark, exact, DATA)
    kept = {d: t for _, d, t in near_kept(list(kept.items()))}
    assert {r.doc_id: r.text for r in near.collect()} == kept

    clear = stages["pii"](spark, near, DATA)
    assert clear.schema.names == docs.schema.names
    kept = {d: redacted(t) for d, t in kept.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in clear.collect()} == {d: (t, len(t)) for d, t in kept.items()}

    packed = stages["best_fit_packing"](spark, clear, DATA).collect()
    whole = corpus_pipeline.run(spark, DATA).collect()
    row = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(row, packed)) == Counter(map(row, whole))
    t = Tokenizer.from_file(default_tokenizer())
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert lengths == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in kept.items()}
    first = next(r for r in packed if lengths[r.doc_id] <= 2048)
    assert np.frombuffer(first.ids, "<u4").tolist() == [*t.encode(kept[first.doc_id], add_special_tokens=False).ids, 0]


def test_rows_of_all_kinds(spark, edge):
    for name, stage in corpus_pipeline.STAGES:
        for df in (edge, edge.limit(0)):
            out = stage(spark, df, DATA)
            if name == "best_fit_packing":
                assert out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
            else:
                assert out.columns == df.columns and out.count() <= df.count()


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in __spark_entry__.queries()}
