"""The pipeline's stages against brute-force versions, and the registration."""

import re

import numpy as np
import public_tokenizers as P

import __spark_entry__ as se
import corpus_pipeline
from quire.llm import packing, quality, toxicity
from quire.llm.common import table
from test_similarity import brute_components
from test_tokens import check_packing, whole

SF = "/root/testdata/sf0.01"


def norm(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    rows = docs.collect()

    def run(name, rows):
        df = steps[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        assert df.columns == docs.columns
        return df.collect()

    good = {r.doc_id for r in quality.quality_scores(docs, quality.quality_model(spark, docs, SF), "q").collect() if r.q >= 0.7}
    after = run("quality classifier", rows)
    assert {r.doc_id for r in after} == good
    kept = spark.createDataFrame(after, docs.schema)
    clean = {r.doc_id for r in toxicity.toxicity_scores(kept, toxicity.toxicity_index(spark, kept, SF), "t").collect() if r.t < 0.5}
    after = run("toxicity", after)
    assert {r.doc_id for r in after} == clean
    classes = brute_components([(r.doc_id, r.text) for r in after])
    after = run("n-gram Jaccard join", after)
    assert {r.doc_id for r in after} == {i for i, (_, c) in classes.items() if i == c}
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {r.doc_id for r in after if not any(i in norm(r.text) for i in items)}
    after = run("benchmark decontamination", after)
    assert {r.doc_id for r in after} == want
    packed = packing.pack_documents(spark.createDataFrame(after, docs.schema), P.path("word_bpe_49k.json"), "words", 2).collect()
    assert check_packing(packed, {r.doc_id: r.text for r in after}, whole("word_bpe_49k.json", 2), 4096) == 0
    digest = steps["packing"](spark, spark.createDataFrame(after, docs.schema), SF).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in digest) == sorted((r.doc_id, r.start, r.length) for r in packed)


def test_stages_on_odd_documents(spark):
    docs = table(spark, SF, "documents")
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", None), (3, "one word", "en", None, 8),
           (3, "one word", "en", None, 8), (4, "long " * 50_000, "en", "s", 5)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, docs.schema)
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, df, SF)
            assert out.count() <= max(1000, len(rows))
            assert name == "packing" or out.columns == docs.columns


def test_run_keeps_clean_documents_whole(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {"doc_id", "start", "length", "sequence_id"} <= set(got[0].asDict())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sum(p.length for p in ps) == ps[0].doc_tokens for ps in by.values())
    assert len(by) > 0.6 * table(spark, "/root/testdata/sf0.001", "documents").count()


def test_registration():
    names = se.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(se.oracle_sql()) <= set(names)


def test_ids_are_unsigned_little_endian():
    assert np.array([49406], "<u4").tobytes() == b"\xfe\xc0\x00\x00"
