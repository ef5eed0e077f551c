"""Packing: an exact round trip, full windows, and ids as the tokenizer gives them."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkweave.llm.packing import Packer, pack
from chunkweave.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def restored(rows):
    docs, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] <= 2048 and at & (at - 1) == 0
    out = {}
    for i, pieces in docs.items():
        at, ids = 0, b""
        for start, length, raw, total in sorted(pieces):
            assert start == at and len(raw) == 4 * length
            at, ids = at + length, ids + raw
        assert at == total
        out[i] = np.frombuffer(ids, "<u4").tolist()
    return out


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    for parts in (1, 5):
        rows = pack(docs.repartition(parts), PATH).collect()
        assert restored(rows) == want
        groups = {}
        for r in rows:
            groups[r.step_group] = groups.get(r.step_group, 0) + r.length
        assert max(groups.values()) == 16 * 2048 and sum(n != 16 * 2048 for n in groups.values()) <= parts


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "word " * 30_000), (5, "<|endoftext|>a<|startoftext|> don't ÀÉ ΑΣ σς é ́x   \x1c\x85 ㍿ 1234'll"), (6, "x")]
    df = spark.createDataFrame([(*x, "q", 0) for x in texts], "doc_id long, text string, ids string, tier int")
    tokenizer = Tokenizer.from_file(PATH)
    assert restored(pack(df, PATH).collect()) == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    assert pack(df.limit(0), PATH).collect() == []
    again = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in pack(again, PATH).collect()) == 8


@pytest.mark.parametrize("seed", range(5))
def test_packer_leaves_nothing(seed):
    r = np.random.default_rng(seed)
    packer, lengths, rows = Packer((256, 512, 1024, 2048), 8192, 0), {}, []
    for doc in range(400):
        lengths[doc] = int(r.choice([1, 2, r.integers(1, 300), r.integers(1, 5000)]))
        packer.add(doc, lengths[doc])
        if doc % 100 == 99:
            packer.pack()
            rows += packer.pieces()
    packer.finish()
    rows += packer.pieces(last=True)
    for doc, n in lengths.items():
        spans = sorted((s, length) for d, s, length, *_ in rows if d == doc)
        assert [s for s, _ in spans] == [0, *np.cumsum([length for _, length in spans])[:-1].tolist()] and sum(length for _, length in spans) == n
    assert sum(x[2] for x in rows if x[5] >= 256) > 0.999 * sum(lengths.values()) - 256


def test_words_as_whole_texts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text")).collect()]
    coder, tokenizer = WordTokens(PATH), Tokenizer.from_file(PATH)
    for ids, text in zip(coder.encode([t.encode() for t in texts]), texts):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
