"""Chat formatting with Spark expressions only.

Template: <|role:ROLE|>, the turn's text, <|end|>. Adjacent turns of one role are one block, with <|+|> between their
texts. Inside texts and roles the strings <| and |> and those of other common templates are escaped, and & with them:
see ESCAPES. The loss mask covers the assistant's texts, without any control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOIN, END = "<|role:", "|>", "<|+|>", "<|end|>"
#: In this order; & first, so that each & of an escaped text starts one of the entities.
ESCAPES = [("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]")]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&#91;", "["), ("&amp;", "&")]
SPANS = "array<struct<start:int,length:int>>"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of turns sorted by place: a turn joins the block before it if the roles are equal."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        fresh = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        longer = F.array(F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        joins = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(joins, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), longer)).otherwise(F.concat(blocks, fresh))

    return F.aggregate(turns, empty, add)


def _pieces(block: Column) -> Column:
    """What a block writes: strings, and whether the loss covers them."""
    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    no, said = F.lit(False), block["role"] == "assistant"
    texts = F.flatten(F.transform(block["texts"], lambda t, i: F.when(i == 0, F.array(piece(escape(t), said))).otherwise(F.array(piece(F.lit(JOIN), no), piece(escape(t), said)))))
    return F.concat(F.array(piece(F.concat(F.lit(OPEN), escape(block["role"]), F.lit(CLOSE)), no)), texts, F.array(piece(F.lit(END), no)))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start from 1 and length, in code points).

    Turns are rows by turn, null first; ties by role, then text, and repeated rows are turns of their own. A null role or
    text is empty. A row without conv_id is a conversation of its own. Other columns play no part. An empty table
    gives an empty one. A conversation is one row and so meets in one task, whatever other groups there are.
    """
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    pieces = turns.select("conv_id", F.flatten(F.transform(_merged(F.col("turns")), _pieces)).alias("pieces"))

    def span(state: Column, p: Column) -> Column:
        n = F.char_length(p["s"])
        more = F.when(p["loss"], F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), n.alias("length"))))).otherwise(state["spans"])
        return F.struct((state["at"] + n).alias("at"), more.alias("spans"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast(SPANS).alias("spans"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.aggregate("pieces", start, span)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: F.char_length(b) > 0)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), CLOSE, 1))
        texts = F.substr(block, F.instr(block, CLOSE) + F.lit(len(CLOSE)))
        return F.transform(F.split(texts, r"<\|\+\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
