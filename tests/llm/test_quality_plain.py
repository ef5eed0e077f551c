"""The classifier's scores against a plain form of them, one text after the other."""

import math

import zstandard
from pyspark.sql import functions as F

from chunkweave.llm.quality import fit, score
from chunkweave.llm.queries import op5_compression_classifier


def plain_score(model, text: str | None) -> float:
    def size(part: bytes, dictionary: bytes | None) -> int:
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return len(zstandard.ZstdCompressor(level=3, **given).compress(part))

    def clipped(x: float, most: float) -> float:
        return max(-most, min(most, x))

    raw = (text or "").encode()
    parts = [raw[i : i + 512] for i in range(0, len(raw), 512)] or [b""]
    sums = [0.0] * 9
    for part in parts:
        good, bad, alone = size(part, model.good), size(part, model.bad), size(part, None)
        d = 10 * clipped((bad - good) / (bad + good), 0.3)
        e = 10 * clipped((bad - good) / (len(part) + 20), 0.2)
        r = math.log((alone + 1) / (len(part) + 20)) + 0.7
        for k, x in enumerate((d, e, r, min(d, 0), min(e, 0), min(r, 0), r * r, d * r, float(d < 0))):
            sums[k] += x * len(part) / max(len(raw), 1)
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], sums))
    return 1 / (1 + math.exp(-z))


def test_scores_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = op5_compression_classifier(spark, sf).collect()
    assert len(rows) == len(texts) and model.weights
    for r in rows:
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9


def test_scores_of_odd_texts(spark, sf):
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "The " * 200_000), (5, "é" * 257), (6, "\x00 \t\n"), (6, "\x00 \t\n")], "doc_id long, text string")
    for r in score(odd, model).select("text", F.col("score")).collect():
        assert abs(r.score - plain_score(model, r.text)) < 1e-9
