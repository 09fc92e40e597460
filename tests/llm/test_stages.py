"""Pipeline stages on edge rows: nulls, empty and long texts, repeats, an empty table, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import EDGES

STAGES = corpus_pipeline.STAGES


@pytest.mark.parametrize("name,stage", STAGES, ids=[n for n, _ in STAGES])
def test_stage_on_edge_rows(spark, data, edges, frame, name, stage):
    docs = edges.withColumn("text", F.when(F.col("doc_id") == 8, F.lit(None)).otherwise(F.col("text")))
    out = stage(spark, docs, data)
    rows = out.collect()
    kept = sorted(str(r.doc_id) for r in rows)
    every = sorted(str(i) for i, _ in EDGES)
    if name == "bpe":
        assert kept == every and all(r.n_tokens == len(r.ids) for r in rows)
        assert {r.doc_id: r.n_tokens for r in rows}[1] == 0
    else:
        assert out.columns == docs.columns
        assert all(r[c] == "clash" for r in rows for c in ("n_words", "class_id", "score", "labels", "seeds", "ids", "fingerprint", "lang_pred", "grade"))
    if name == "language_id":
        assert not {"1", "2", "3", "4", "8"} & set(kept) and "7" in kept  # no letters, no language
    if name == "near_dedup":
        assert kept.count("5") == 1 and "6" not in kept and {"1", "2", "3", "7", "9", "None"} <= set(kept)
    if name in ("substring_dedup", "decontamination"):
        assert kept == every
    empty = stage(spark, frame([]), data)
    assert empty.count() == 0 and empty.columns == out.columns


def test_run_over_no_documents(spark, data, frame, tmp_path):
    frame([], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
