"""Deduplication as joins and aggregations over fingerprints.

Metadata rows (file_id, pos, size, fp) are joined, never payloads. Repeats are aggregated before a shuffle where the result
allows it, and adaptive execution splits the keys that stay hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chunkweave.functions.scalars import ratio

UNIQUE, DUPLICATE = "UNIQUE", "DUPLICATE"


def probe(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks with the index's address columns and dedup_flag."""
    found = chunks.join(index.withColumn("__found", F.lit(True)), "fp", "left")
    return found.withColumn("dedup_flag", F.when(F.col("__found"), DUPLICATE).otherwise(UNIQUE)).drop("__found")


def addresses(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks with addresses and exist_flag, 1 if the fingerprint is in the index."""
    return probe(chunks, index).withColumn("exist_flag", (F.col("dedup_flag") == DUPLICATE).cast("int")).drop("dedup_flag")


def tiered_probe(chunks: DataFrame, cached: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks with dedup_flag and tier: CACHE if a cached container has the fingerprint, INDEX if only the index has, else NONE.

    cached: metadata rows (fp) of the containers at hand. The flag is that of probe(); only the tier tells them apart.
    """
    near = cached.select("fp").distinct().withColumn("__near", F.lit(True))
    far = index.select("fp").distinct().withColumn("__far", F.lit(True))
    out = chunks.join(near, "fp", "left").join(far, "fp", "left")
    tier = F.when(F.col("__near"), "CACHE").when(F.col("__far"), "INDEX").otherwise("NONE")
    return out.withColumn("tier", tier).withColumn("dedup_flag", F.when(F.col("tier") == "NONE", UNIQUE).otherwise(DUPLICATE)).drop("__near", "__far")


def unexpected(recovered: DataFrame, requested: DataFrame) -> DataFrame:
    """Fingerprints that were recovered but not asked for; a check that holds has no rows."""
    return recovered.select("fp").distinct().join(requested.select("fp"), "fp", "left_anti")


def observed(chunks: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows; while another query runs over them, their number and bytes are counted."""
    seen = Observation(name)
    return chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), seen


def missing(source: DataFrame, target: DataFrame, distinct: bool = False) -> DataFrame:
    """The source's rows whose fingerprint the target lacks; repeats stay unless distinct."""
    rows = source.join(target.select("fp").distinct(), "fp", "left_anti")
    return rows.select("fp").distinct() if distinct else rows


def shared(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.join(target.select("fp").distinct(), "fp", "left_semi")


def first_occurrence(chunks: DataFrame, order: tuple[str, ...] = ("file_id", "pos"), within: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_first: 1 for the first row of its fingerprint in the order, else 0; of the whole stream, or within groups.

    The first places come from a minimum that is taken before the shuffle, and are joined back; a hot fingerprint is
    not sorted in one task.
    """
    place = F.struct(*order)
    firsts = chunks.groupBy("fp", *within).agg(F.min(place).alias("__first"))
    return chunks.join(firsts, ["fp", *within]).withColumn("is_first", (F.col("__first") == place).cast("int")).drop("__first")


def insert_if_absent(index: DataFrame, batch: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The index with the batch's first row of each new fingerprint: what is there first stays."""
    columns = [c for c in index.columns if c != "fp"]
    new = batch.groupBy("fp").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("v")).select("fp", "v.*")
    return index.unionByName(new.join(index.select("fp"), "fp", "left_anti"))


def overwrite(index: DataFrame, batch: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The index after the batch's rows replace what is there: the last one stays."""
    columns = [c for c in index.columns if c != "fp"]
    new = batch.groupBy("fp").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select("fp", "v.*")
    return index.join(new.select("fp"), "fp", "left_anti").unionByName(new)


def totals(chunks: DataFrame, *by: str) -> DataFrame:
    """Logical and unique chunks and bytes and the dedup ratio, in all or by some columns.

    Chunks are first summed by fingerprint, so the second shuffle has a row for each fingerprint and group.
    """
    each = chunks.groupBy(*by, "fp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"))
    return _summed(each.groupBy(*by))


def totals_rollup(chunks: DataFrame, *by: str) -> DataFrame:
    """totals() of each level of a rollup; null stands for all."""
    each = chunks.groupBy(*by, "fp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"))
    levels = []  # coarser ones from the sums of the finest, whose shuffle they share
    for k in range(len(by), -1, -1):
        rows = each if k == len(by) else each.groupBy(*by[:k], "fp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
        levels.append(_summed(rows.groupBy(*by[:k])).withColumns({c: F.lit(None).cast(chunks.schema[c].dataType) for c in by[k:]}))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _summed(grouped) -> DataFrame:
    sums = grouped.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("logical_bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("logical_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("unique_bytes"), F.count(F.lit(1)).alias("unique_chunks"))
    return sums.withColumn("dedup_ratio", ratio(F.col("logical_bytes"), F.col("unique_bytes")))


def unique_chunks(chunks: DataFrame, mode: str, order: tuple[str, ...] = ("file_id", "pos")) -> DataFrame:
    """Adds is_unique by an exact index: modes out_enclave, in_enclave and frequency store the same chunks."""
    if mode not in ("out_enclave", "in_enclave", "frequency"):
        raise ValueError(f"{mode} is no exact index")
    return first_occurrence(chunks, order).withColumnRenamed("is_first", "is_unique")


def before(value: Column, by: str, *order: str) -> Column:
    """The sum of a column over the rows of a group before this one."""
    window = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")
