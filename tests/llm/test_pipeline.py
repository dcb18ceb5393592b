import numpy as np

import corpus_pipeline
from ionolake.llm import decontaminate, language_id, near_dedup, pii, sentencepiece_viterbi
from tests.llm.test_llm_operators import brute_classes


def test_pipeline_against_plain_python(spark, sf):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    told = {i: r for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    classes = brute_classes([(i, r["text"]) for i, r in told.items()])
    plain = lambda t: " ".join(t.split())
    clean = {i for i in set(classes.values()) if not any(plain(x["text"]) in plain(docs[i]["text"]) for x in items)}
    assert set(got) == clean
    with open(sentencepiece_viterbi.DEFAULT_MODEL, "rb") as f:
        codec = sentencepiece_viterbi.Codec(sentencepiece_viterbi.read_model(f.read()))
    for i in sorted(clean)[:60]:
        assert codec.decode(np.array(got[i]["ids"])) == pii.scrub(docs[i]["text"], pii.EXAMPLE_KEY)[0]


def test_stages_keep_the_columns(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.limit(30).unionByName(spark.createDataFrame([(None, "some words here", "en", "s", 3), (7001, None, "en", "s", None), (7002, "", "en", "s", 0)], d.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == d.columns and out.dtypes == d.dtypes, name
    assert {language_id, near_dedup, decontaminate} and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "sentencepiece"]
    assert all(stage(spark, rows.limit(0), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
