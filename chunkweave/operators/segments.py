"""Dedup by segments: near-exact indexes that look only where a segment's sample points.

Segments come as chunk rows (file_id, segment, pos, size, fp).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.hashing import byte_sum, fingerprint, is_hook
from chunkweave.operators.dedup import first_occurrence
from chunkweave.operators.ordered import streamed
from chunkweave.params import SparseParams


def representatives(chunks: DataFrame) -> DataFrame:
    """One row a segment: n_chunks, bytes, min_fp (by byte sum, the first of equals) and segment_fp over its list of chunks."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "size", "fp")))
    out = chunks.groupBy("file_id", "segment").agg(
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        F.sum("size").alias("bytes"),
        F.min_by("fp", F.struct(byte_sum(F.col("fp")), "pos")).alias("min_fp"),
        listed.alias("__list"),
    )
    written = F.array_join(F.transform("__list", lambda c: F.concat(c["size"].cast("string"), F.lit(":"), c["fp"])), ",")
    return out.withColumn("segment_fp", fingerprint(written)).drop("__list")


def binned(chunks: DataFrame) -> DataFrame:
    """Adds min_fp, the bin of each chunk's segment."""
    return chunks.join(representatives(chunks).select("file_id", "segment", "min_fp"), ["file_id", "segment"])


def extreme_binning(chunks: DataFrame) -> DataFrame:
    """Adds is_unique: 1 if no earlier chunk, of a segment with the same min_fp, has the fingerprint.

    A bin holds what all earlier segments of its min_fp brought, so a repeated segment is all duplicates and any other is
    looked up chunk by chunk; a duplicate under another min_fp is missed. Bins don't touch, so this is one grouping.
    """
    return first_occurrence(binned(chunks), ("file_id", "segment", "pos"), ("min_fp",)).withColumnRenamed("is_first", "is_unique")


def hooks(chunks: DataFrame, params: SparseParams = SparseParams()) -> DataFrame:
    """The distinct sampled fingerprints of each segment."""
    return chunks.where(is_hook(F.col("fp"), params.sample_bits)).select("file_id", "segment", F.col("fp").alias("hook_fp")).distinct()


def newest_manifests(of_segments: DataFrame, keep: int) -> DataFrame:
    """Of each hook the `keep` newest segments, with their age from 1."""
    window = Window.partitionBy("hook_fp").orderBy(F.desc("file_id"), F.desc("segment"))
    return of_segments.withColumn("age", F.row_number().over(window)).where(F.col("age") <= keep)


def candidates(of_segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """How many hooks each segment shares with each manifest of another file."""
    old = manifests.select("hook_fp", F.col("file_id").alias("old_file"), F.col("segment").alias("old_segment"))
    pairs = of_segments.join(old, "hook_fp").where("old_file < file_id or old_file = file_id and old_segment < segment")
    return pairs.groupBy("file_id", "segment", "old_file", "old_segment").agg(F.count(F.lit(1)).alias("score"))


def champions(scored: DataFrame, keep: int) -> DataFrame:
    """The best-scored manifests of each segment, ties to the newer."""
    window = Window.partitionBy("file_id", "segment").orderBy(F.desc("score"), F.desc("old_file"), F.desc("old_segment"))
    return scored.withColumn("place", F.row_number().over(window)).where(F.col("place") <= keep)


class SparseIndex:
    """A stream's hook index and manifests."""

    def __init__(self, params: SparseParams):
        self.params, self.manifests, self.by_hook = params, [], {}

    def segment(self, fps: list[str]) -> list[bool]:
        """Which chunks of the next segment are new; its manifest is kept if any is."""
        sampled = list(dict.fromkeys(fp for fp in fps if int(fp[:2], 16) < 1 << (8 - self.params.sample_bits)))
        scores: dict[int, int] = {}
        for fp in sampled:
            for m in self.by_hook.get(fp, ()):
                scores[m] = scores.get(m, 0) + 1
        best = sorted(scores, key=lambda m: (-scores[m], -m))[: self.params.champions]
        seen: set[str] = set().union(*(self.manifests[m] for m in best))
        new = []
        for fp in fps:
            new.append(fp not in seen)
            seen.add(fp)
        if any(new):
            self.manifests.append(frozenset(fps))
            for fp in sampled:
                kept = self.by_hook.setdefault(fp, [])
                kept.append(len(self.manifests) - 1)
                del kept[: -self.params.manifests]
        return new


def _flushed(index: SparseIndex, held: list[pa.Table]) -> Iterator[pa.Table]:
    if held:
        table = pa.concat_tables(held)
        yield table.append_column("is_unique", pa.array([int(x) for x in index.segment(table["fp"].to_pylist())], pa.int32()))


def sparse_indexing(chunks: DataFrame, lane: str, params: SparseParams = SparseParams()) -> DataFrame:
    """Adds is_unique by sparse indexing: a segment is compared with its champions only.

    Which manifests exist depends on all earlier segments, so a lane (a client's stream) is gone through in order; lanes
    run beside each other, each with an index of its own.
    """

    def rows(pieces: Iterator[tuple[tuple, bool, pa.Table]]) -> Iterator[pa.Table]:
        index, held, key = SparseIndex(params), [], None
        for _, new, table in pieces:  # a segment is held until its last chunk has come
            if new:
                yield from _flushed(index, held)
                index, held, key = SparseIndex(params), [], None
            places = list(zip(table["file_id"].to_pylist(), table["segment"].to_pylist()))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, b in zip(cuts, cuts[1:]):
                if places[a] != key:
                    yield from _flushed(index, held)
                    held, key = [], places[a]
                held.append(table.slice(a, b - a))
        yield from _flushed(index, held)

    return streamed(chunks, [lane], ["file_id", "segment", "pos"], rows, chunks, "is_unique int")
