"""The pipeline against a plain version of each stage on its own input."""

import os

import numpy as np
import pytest
from test_operators import check_pieces, plain_components

import corpus_pipeline
from isochron.llm import decontaminate, pii, simhash, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_each_stage_on_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / str(i))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name == "packing":
            check_pieces(after, {k: r["text"] for k, r in before.items()})
            continue
        assert docs.columns == columns
        kept = {r["doc_id"]: r for r in after}
        assert len(kept) == len(after)
        if name == "toxicity":
            ids = list(before)
            want = {k for k, s in zip(ids, model.scores([before[k]["text"] for k in ids]), strict=True) if s < toxicity.SCORE_LIMIT}
        elif name == "near_duplicates":
            ids = sorted(before)
            comp = plain_components(ids, [simhash.fingerprint(before[k]["text"]) for k in ids], 4)
            want = {k for k in ids if comp[k] == k}
        elif name == "decontamination":
            hit = decontaminate.brute_force([(k, r["text"]) for k, r in before.items()], bench)
            want = {k for k, v in hit.items() if not v[-1]}
        else:
            want = set(before)
            changed = [k for k in want if kept[k]["text"] != before[k]["text"]]
            found = {r["doc_id"]: len(r["spans"]) for r in pii.pii_spans(spark.createDataFrame([(k, before[k]["text"]) for k in before], "doc_id long, text string")).collect()}
            assert set(changed) == {k for k, n in found.items() if n} and all(r["n_chars"] == len(r["text"]) for r in after)
        assert set(kept) == want, name
        if name != "pii":
            assert all(kept[k] == before[k] for k in kept)


def test_stages_take_odd_and_no_rows(spark, weird, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (weird, nothing):
            out = stage(spark, docs, DIR)
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs is nothing else n > 0
    once = corpus_pipeline.near_duplicate_stage(spark, weird, DIR).select("doc_id").collect()
    ids = [r[0] for r in once]
    assert ids.count(9) == 1 and ids.count(None) == 1 and 6 not in ids and 2 not in ids and ids.count(1) == 1
    assert np.isin([5, 7, 8], ids).all()


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0
