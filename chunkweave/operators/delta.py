"""Typed payloads: chunks that are sent compressed, or as a delta against a base that the receiver has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.codecs import compressed, decompressed, delta_decoded, delta_encoded


def encoded(tagged: DataFrame, data: DataFrame, codec: str = "zstd") -> DataFrame:
    """(fp, kind, base_fp, codec, bytes, size) of tagged chunks (fp, tag, base_fp), from the sender's data (fp, data).

    A base that the sender lacks makes a chunk COMP_ONLY; otherwise the delta is sent whatever its size, and compression
    that gains on it makes it DELTA_COMP.
    """
    chunks = data.select("fp", "data")
    joined = tagged.join(chunks, "fp").join(chunks.select(F.col("fp").alias("base_fp"), F.col("data").alias("base")), "base_fp", "left")
    body = F.when(F.col("base").isNull(), F.col("data")).otherwise(delta_encoded(F.col("base"), F.col("data")))
    out = joined.withColumn("__body", body).withColumn("__packed", compressed(F.col("__body"), codec))
    delta = F.col("base").isNotNull()
    kind = F.when(~delta, "COMP_ONLY").when(F.col("__packed.codec") == "raw", "DELTA_ONLY").otherwise("DELTA_COMP")
    return out.select("fp", kind.alias("kind"), F.when(delta, F.col("base_fp")).alias("base_fp"), F.col("__packed.codec").alias("codec"), F.col("__packed.bytes").alias("bytes"), F.octet_length("__packed.bytes").alias("size"))


def decoded(payload: DataFrame, held: DataFrame) -> DataFrame:
    """(fp, data) of payloads. Bases are chunks that the receiver holds (fp, data), or COMP_ONLY ones of the payload.

    A delta is never made against a delta, so two steps do.
    """
    plain = payload.withColumn("__body", decompressed(F.col("codec"), F.col("bytes")))
    whole = plain.where("kind = 'COMP_ONLY'").select("fp", F.col("__body").alias("data"))
    bases = held.select("fp", "data").unionByName(whole).dropDuplicates(["fp"]).withColumnsRenamed({"fp": "base_fp", "data": "base"})
    deltas = plain.where("kind != 'COMP_ONLY'").join(bases, "base_fp", "left")
    missing = F.raise_error(F.concat(F.lit("no base for "), F.col("fp")))
    made = F.when(F.col("base").isNull(), missing.cast("binary")).otherwise(delta_decoded(F.col("base"), F.col("__body")))
    return whole.unionByName(deltas.select("fp", made.alias("data")))
