"""Stages of the pipeline that drop rows, where doc_ids are null or repeated."""

from __future__ import annotations

import random

import corpus_pipeline

A, B, C, D = (" ".join(f"w{random.Random(i * 1000 + k).randrange(9999)}" for k in range(60)) for i in range(4))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_one_row_of_each_component_stays(spark, tmp_path):
    rows = [(1, A), (1, A), (None, A), (3, A), (3, C), (2, B), (None, D), (None, D)]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), str(tmp_path))
    assert got.columns == docs(spark, rows).columns
    assert kept(got) == sorted([(1, A), (2, B), (3, C), (None, D)], key=repr)


def test_contamination_is_of_rows(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(A.split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, A), (1, B), (None, A), (None, C), (2, D), (2, D)]
    assert kept(corpus_pipeline.drop_contaminated(spark, docs(spark, rows), str(tmp_path))) == sorted([(1, B), (None, C), (2, D), (2, D)], key=repr)
