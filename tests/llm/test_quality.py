"""The classifier: held-out accuracy, and what it may not look at."""

import zlib

import pytest
from pyspark.sql import functions as F

from chunkweave.llm.queries import op5_compression_classifier
from chunkweave.llm.quality import FitBounds, Model, fit, held_out, score


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op5_compression_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    truth = [(r.quality, rows[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = [p for q, p in truth if q == 1], [p for q, p in truth if q == 0]
    assert sum(good) / len(good) > 0.99 and 1 - sum(bad) / len(bad) > 0.85


def test_learns_nothing_from_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(docs, labels) == fit(docs, flipped)
    small = fit(docs, labels, FitBounds(dictionary_rows=10, good_rows=20, bad_rows=5))
    assert small.weights and small != fit(docs, labels)


def test_edges(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "é " * 400_000, 3.0), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, score double")
    out = score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.text in (None, "")}) == 1
    assert score(odd.limit(0), model).count() == 0
    assert fit(docs, labels.limit(0)) == Model(share=0.5)
    assert fit(docs, labels.where("quality = 1")) == Model(share=1.0)
    assert [r.predicted for r in score(odd, Model(share=0.5)).collect()] == [1] * 5
    nulls = spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert fit(docs, nulls) == Model(share=0.5)
    with pytest.raises(Exception):
        fit(docs, labels, label="none").weights
