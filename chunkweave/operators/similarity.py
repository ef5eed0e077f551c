"""Bases for delta coding, found by shared super-features."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.operators.ordered import in_order


def feature_index(meta: DataFrame, order: str = "fp") -> DataFrame:
    """(feature, base_fp): of each feature the chunk that comes last in the order."""
    return meta.select(F.explode("features").alias("feature"), "fp", order).groupBy("feature").agg(F.max_by("fp", F.struct(order, "fp")).alias("base_fp"))


def votes(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(fp, base_fp, n_votes) for chunks with features: the base with the most features in common, ties to the first feature."""
    hits = chunks.select("fp", F.posexplode("features").alias("at", "feature")).join(index, "feature").where("fp != base_fp")
    counted = hits.groupBy("fp", "base_fp").agg(F.count(F.lit(1)).alias("n_votes"), F.min("at").alias("first"))
    best = F.max_by(F.struct("base_fp", "n_votes"), F.struct("n_votes", -F.col("first"))).alias("v")
    return counted.groupBy("fp").agg(best).select("fp", "v.base_fp", "v.n_votes")


def batch_bases(chunks: DataFrame, lane: str, order: tuple[str, ...], batch: int = 128) -> DataFrame:
    """Adds batch_base to chunks (fp, features): an earlier chunk of the same batch that has no base itself.

    Only chunks without a base become bases, so no delta is made against a delta; whether one does depends on those before
    it, so a batch is gone through in order.
    """
    window = Window.partitionBy(lane).orderBy(*order)
    numbered = chunks.withColumn("__batch", F.floor((F.row_number().over(window) - 1) / batch))

    def rows(groups: Iterator[tuple[tuple, pa.Table]]) -> Iterator[pa.Table]:
        for _, table in groups:
            by_feature: dict[int, str] = {}
            found = []
            for fp, features in zip(table["fp"].to_pylist(), table["features"].to_pylist()):
                tally: dict[str, int] = {}
                for f in features:
                    if f in by_feature:
                        tally[by_feature[f]] = tally.get(by_feature[f], 0) + 1
                base = max(tally, key=tally.__getitem__) if tally else None
                found.append(base)
                if base is None:
                    for f in features:
                        by_feature.setdefault(f, fp)
            yield table.drop_columns(["__batch"]).append_column("batch_base", pa.array(found, pa.string()))

    return in_order(numbered, [lane, "__batch"], list(order), rows, chunks, "batch_base string")


def tagged(chunks: DataFrame, index: DataFrame, lane: str, order: tuple[str, ...], batch: int = 128) -> DataFrame:
    """Adds tag and base_fp: SIMILAR to a chunk of the index, else BATCH_SIMILAR to one of the batch, else NON_SIMILAR and null."""
    voted = chunks.join(votes(chunks.dropDuplicates(["fp"]), index).select("fp", "base_fp"), "fp", "left")
    rest = voted.where("base_fp is null").drop("base_fp")
    local = batch_bases(rest, lane, order, batch).withColumnRenamed("batch_base", "base_fp")
    local = local.withColumn("tag", F.when(F.col("base_fp").isNull(), "NON_SIMILAR").otherwise("BATCH_SIMILAR"))
    return voted.where("base_fp is not null").withColumn("tag", F.lit("SIMILAR")).unionByName(local)
