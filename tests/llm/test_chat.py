"""Chat formatting: an exact round trip through the template."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkweave.llm.chat import CLOSE, END, JOIN, OPEN, format_chats, read_loss, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
PIECES = [OPEN, CLOSE, JOIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "&", "&lt;", "&#91;", "&amp;", "<", "|", ">", "é", "\n", "😀", " ", "ok", "assistant"]


def back(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)
    out = format_chats(df).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: (r.formatted, [tuple(t) for t in r.turns], r.loss) for r in out.collect()}


def plain(rows):
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    return want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "system", "a|>b", ""]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), min_size=1, max_size=40))
def test_round_trip(spark, rows):
    got, want = back(spark, rows), plain(rows)
    assert {c: x[1] for c, x in got.items()} == want
    for c, (_, _, loss) in got.items():
        assert loss == "".join(t for r, t in want[c] if r == "assistant")


def test_merges_adjacent_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b<|end|>"), (1, 2, "assistant", "c"), (1, 3, "assistant", ""), (1, 4, "user", None)]
    formatted, turns, loss = back(spark, rows)[1]
    assert formatted == "<|role:user|>a<|+|>b&lt;|end|&gt;<|end|><|role:assistant|>c<|+|><|end|><|role:user|><|end|>"
    assert turns == [("user", "a"), ("user", "b<|end|>"), ("assistant", "c"), ("assistant", ""), ("user", "")] and loss == "c"


def test_nulls_ties_long_and_empty(spark):
    rows = [(None, None, None, None), (2, None, "user", "x"), (2, 1, "user", "t"), (2, 1, "user", "t"), (2, 1, "assistant", "t"), (3, 0, "assistant", "long " * 50_000), *[(4, k, "user", str(k)) for k in range(300)]]
    got = back(spark, rows)
    assert {c: x[1] for c, x in got.items()} == plain(rows)
    assert hashlib.sha256(got[3][2].encode()).hexdigest() == hashlib.sha256(("long " * 50_000).encode()).hexdigest()
    assert back(spark, []) == {}


def test_rows_without_conv_id_are_conversations_of_their_own(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "user", "b"), (None, 1, "user", "a"), (7, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_chats(df).collect()
    assert sorted((str(r.conv_id), r.formatted) for r in out) == sorted([("None", "<|role:user|>a<|end|>"), ("None", "<|role:user|>b<|end|>"), ("None", "<|role:user|>a<|end|>"), ("7", "<|role:assistant|>c<|end|>")])
