"""Frequencies of fingerprints: exact, by a Count-Min sketch, and the index that keeps the most frequent at hand."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.hashing import little_u32
from chunkweave.operators.ordered import streamed
from chunkweave.params import FrequencyParams


def frequencies(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("freq"))


def top(chunks: DataFrame, k: int) -> DataFrame:
    """The k most frequent fingerprints, ties to the smaller; each task keeps k."""
    return frequencies(chunks).orderBy(F.desc("freq"), "fp").limit(k)


def running_frequency(chunks: DataFrame, order: tuple[str, ...] = ("file_id", "pos")) -> DataFrame:
    """Adds freq: how often the fingerprint has come by now, this row included."""
    window = Window.partitionBy("fp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("freq", F.count(F.lit(1)).over(window))


def _cells(params: FrequencyParams):
    return F.array(*[F.struct(F.lit(i).alias("row"), (little_u32(F.col("fp"), i) % params.width).alias("cell")) for i in range(params.depth)])


def sketch(chunks: DataFrame, params: FrequencyParams = FrequencyParams()) -> DataFrame:
    """The sketch as a table (row, cell, count). Sketches of parts add up to that of the whole."""
    cells = frequencies(chunks).select("freq", F.explode(_cells(params)).alias("c"))
    return cells.groupBy("c.row", "c.cell").agg(F.sum("freq").alias("count"))


def merged(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy("row", "cell").agg(F.sum("count").alias("count"))


def estimates(fps: DataFrame, table: DataFrame, params: FrequencyParams = FrequencyParams()) -> DataFrame:
    """The distinct fingerprints with estimate, the least of their cells; never below the true count."""
    cells = fps.select("fp").distinct().select("fp", F.explode(_cells(params)).alias("c")).select("fp", "c.row", "c.cell")
    return cells.join(table, ["row", "cell"], "left").groupBy("fp").agg(F.min(F.coalesce("count", F.lit(0))).cast("long").alias("estimate"))


def tiers(chunks: DataFrame, least: int, batch: str = "batch") -> DataFrame:
    """Adds freq and tier to chunks with batches: where the frequency index finds each chunk's address.

    All chunks of a batch are counted before its first is looked up. LOCAL: repeated in its batch. TOP: as frequent as
    the gate. OUTSIDE: asked of the index outside.
    """
    by_batch = Window.partitionBy("fp").orderBy("file_id", batch)  # up to the end of the batch
    in_batch = Window.partitionBy("file_id", batch, "fp").orderBy("pos")
    out = chunks.withColumn("freq", F.count(F.lit(1)).over(by_batch)).withColumn("__n", F.row_number().over(in_batch))
    tier = F.when(F.col("__n") > 1, "LOCAL").when(F.col("freq") >= least, "TOP").otherwise("OUTSIDE")
    return out.withColumn("tier", tier).drop("__n")


class FrequencyIndex:
    """The state of a stream: a sketch, and a heap of the most frequent fingerprints with their addresses."""

    def __init__(self, params: FrequencyParams):
        self.params, self.counts = params, np.zeros((params.depth, params.width), np.uint32)
        self.heap: list[tuple[int, str]] = []
        self.kept: dict[str, int] = {}

    def count(self, fp: str) -> int:
        raw, least = bytes.fromhex(fp), None
        for i in range(self.params.depth):
            cell = int.from_bytes(raw[4 * i : 4 * i + 4], "little") % self.params.width
            self.counts[i, cell] += 1
            least = int(self.counts[i, cell]) if least is None else min(least, int(self.counts[i, cell]))
        return least

    def least(self) -> int:
        """The smallest frequency in a full heap; 0 while there is room."""
        while self.heap and self.kept.get(self.heap[0][1]) != self.heap[0][0]:
            heapq.heappop(self.heap)  # replaced since
        return self.heap[0][0] if len(self.kept) >= self.params.top else 0

    def offer(self, fp: str, freq: int) -> None:
        if fp not in self.kept and len(self.kept) >= self.params.top:
            if freq < self.least():
                return
            while self.kept.get(self.heap[0][1]) != self.heap[0][0]:
                heapq.heappop(self.heap)
            del self.kept[heapq.heappop(self.heap)[1]]
        self.kept[fp] = freq
        heapq.heappush(self.heap, (freq, fp))

    def batch(self, fps: list[str]) -> list[tuple[int, str]]:
        """(estimate, tier) of each chunk of a batch; the heap learns of the batch at its end."""
        freqs = [self.count(fp) for fp in fps]
        gate, first, out = self.least(), {}, []
        for fp, freq in zip(fps, freqs):
            if fp in first:
                first[fp] = freq
                out.append((freq, "LOCAL"))
                continue
            first[fp] = freq
            out.append((freq, "TOP" if freq >= gate and fp in self.kept else "OUTSIDE"))
        for fp, freq in first.items():
            self.offer(fp, freq)
        return out

    def rows(self, table: pa.Table) -> pa.Table:
        """The table's rows, batch by batch, with freq and tier."""
        fps, found = table["fp"].to_pylist(), []
        for i in range(0, len(fps), self.params.batch):
            found += self.batch(fps[i : i + self.params.batch])
        freq, tier = zip(*found)
        return table.append_column("freq", pa.array(freq, pa.int64())).append_column("tier", pa.array(tier, pa.string()))


def replay(chunks: DataFrame, lane: str, params: FrequencyParams, order: tuple[str, ...] = ("file_id", "pos")) -> DataFrame:
    """Adds freq and tier as the frequency index finds them, for each lane's stream on its own."""

    def rows(pieces: Iterator[tuple[tuple, bool, pa.Table]]) -> Iterator[pa.Table]:
        index, held = None, None
        for _, new, table in pieces:
            if new:
                if held is not None and held.num_rows:
                    yield index.rows(held)
                index, held = FrequencyIndex(params), None
            held = table if held is None else pa.concat_tables([held, table])
            whole = held.num_rows - held.num_rows % params.batch
            if whole:
                yield index.rows(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield index.rows(held)

    return streamed(chunks, [lane], list(order), rows, chunks, "freq bigint, tier string")


def leakage(stored: DataFrame) -> DataFrame:
    """What stored frequencies tell: their Kullback-Leibler divergence from equal ones. One row, kld, in nats."""
    sums = frequencies(stored).agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("freq") * F.ln("freq")).alias("s"))
    return sums.select(F.round(F.col("s") / F.col("n") - F.ln("n") + F.ln("k"), 6).alias("kld"))
