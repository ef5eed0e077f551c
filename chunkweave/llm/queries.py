"""One query for each operator: it applies the operator to its whole table and derives the result that is asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.chat import format_chats, read_loss, read_turns
from chunkweave.llm.graph import search_all
from chunkweave.llm.html import extract
from chunkweave.llm.mixing import mix
from chunkweave.llm.oracle import SQL as SQL
from chunkweave.llm.packing import pack
from chunkweave.llm.pivots import near_vectors
from chunkweave.llm.quality import fit, held_out, score
from chunkweave.llm.setjoin import set_join
from chunkweave.llm.sharding import shard
from chunkweave.llm.substrings import without_repeats
from chunkweave.sources.files import spread


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (bigint(-7), bigint(0), 'user', '{said}'), (bigint(-7), bigint(1), 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    chats = format_chats(rows.unionByName(more)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), least=0.93)


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5)
    return score(docs, model, threshold=0.3).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op6_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, weights=(5, 2, 1), share=1.0, epochs=3).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), n=3, num=90, den=100)


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard(docs, 8, order=["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search_all(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_packing": op1_hierarchical_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pivot_permutations": op4_pivot_permutations,
    "op5_compression_classifier": op5_compression_classifier,
    "op6_weighted_fair_queueing": op6_weighted_fair_queueing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_pruned_graph": op9_pruned_graph,
    "op10_html_extraction": op10_html_extraction,
}
