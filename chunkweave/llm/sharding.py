"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.frames import REST, even_bits, running, with_rest

#: The step of the published algorithm's 64-bit generator.
STEP = np.uint64(2862933555777941757)
ADDED = ("shard", "slot", "grown_shard")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. From n to n + 1 shards a key stays or moves to shard n."""
    if shards < 1:
        raise ValueError("there is at least one shard")
    key, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    after, going = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    while going.any():
        at[going] = after[going]
        key[going] = key[going] * STEP + np.uint64(1)
        after[going] = np.floor((at[going] + 1) * (2.0**31 / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        going &= after < shards
    return at.astype(np.int32)


def jump_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().astype(np.int64).view(np.uint64), shards))

    return of(key)


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", order: list[str] | None = None, slices: int = 1024) -> DataFrame:
    """The documents with shard, slot and grown_shard.

    shard depends on doc_id and the number of shards alone, grown_shard is the shard with one more: the same or the
    new one. slot numbers a shard's rows from 0 without gaps, in an order that depends on doc_id, then on the columns
    `order`. A null doc_id is a key like any other. Rows that repeat a doc_id share its shard and have slots of their own.
    Columns of the input stay, those named as the new ones are replaced. An empty table gives an empty one.
    """
    key = even_bits(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), ":shard")
    packed = with_rest(docs.withColumns({"__key": key, "__even": even_bits(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), ":slot")}), "__key", "__even")
    packed = packed.withColumn("__shard", jump_of(F.col("__key"), shards)).withColumn("__grown", jump_of(F.col("__key"), shards + 1))
    ties = [f"{REST}.`{c}`" for c in [doc_id, *(order or [])]]
    placed = running(packed.withColumns({f"__tie{i}": F.col(c) for i, c in enumerate(ties)}), "__shard", ["__even", *(f"__tie{i}" for i in range(len(ties)))], F.lit(1), "__slot", slices)
    columns = [F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return placed.select(*columns, F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.col("__grown").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; rows stand in the order of their slots in each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
