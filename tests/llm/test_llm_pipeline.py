"""The pipeline against its operators and against brute force."""

from __future__ import annotations

import corpus_pipeline
import pandas as pd

from spanforge.llm import jaccard, packing, pii, quality, queries


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= rows, name
        rows = now


def test_run_matches_plain_steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r["doc_id"] for r in quality.quality(docs).collect() if r["kept"]}
    kept = docs.where(docs.doc_id.isin(list(verdict)))
    classes = {r["doc_id"] for r in jaccard.near_duplicates(kept).collect() if r["doc_id"] == r["class_id"]}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) <= classes
    lab = pd.read_parquet(f"{sf_dir}/labels.parquet")
    assert not set(got.doc_id) & set(lab.doc_id[lab.quality == 0])
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_masked_texts_have_no_base_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(not pii.base_spans(r["text"] or "") for r in pii.redact(docs).collect())


def test_all_queries_are_registered():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "pii", "mixing", "packing"]
