"""Rows that share a doc_id and have other texts, or none."""

import corpus_pipeline as pipeline
from chunkweave.llm.setjoin import set_join

WORDS = [" ".join(f"w{i * 7 % 97}x{i}" for i in range(k, k + 60)) for k in (0, 500, 1000)]


def test_null_text_of_a_family_member(spark):
    rows = [(1, WORDS[0]), (1, None), (2, WORDS[0] + " x"), (3, WORDS[1])]
    out = set_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(1, 0, 1), (1, 58, 1), (2, 59, 1), (3, 58, 3)]
    assert {r.n_links for r in out if r.doc_id == 2} == {1} and {r.n_links for r in out if r.n_shingles == 58} == {0, 1}


def test_pipeline_keeps_other_texts_of_a_doc_id(spark, sf):
    rows = [(1, WORDS[0]), (1, WORDS[1]), (1, WORDS[1]), (1, None), (2, WORDS[0] + " x"), (3, WORDS[1] + " y"), (4, WORDS[2]), (None, WORDS[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in pipeline.ngram_jaccard_join(spark, docs, sf).collect()), key=str)
    assert kept == sorted([(1, WORDS[0]), (1, WORDS[1]), (1, None), (4, WORDS[2]), (None, WORDS[2])], key=str)
