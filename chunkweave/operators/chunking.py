"""Files to chunks, and the chunk stream to segments and batches.

A file is a row (file_id, source, content, file_size); a chunk is (file_id, pos, offset, size, data). Files are cut where
they are: chunking shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.hashing import byte_sum, fingerprint
from chunkweave.operators.ordered import in_order
from chunkweave.params import ChunkParams, SegmentParams


def chunk(files: DataFrame, params: ChunkParams) -> DataFrame:
    """All other columns of the files, and pos, offset, size, data. An empty or null file has no chunks."""
    if params.method == "fixed":
        return fixed_chunks(files, params.avg, params.block)
    if params.method != "fastcdc":
        raise ValueError(f"no chunking method is called {params.method}")
    return content_chunks(files, params)


def _cut(files: DataFrame, bounds: Column) -> DataFrame:
    others = [c for c in files.columns if c != "content"]
    cut = files.select(*others, "content", F.posexplode(bounds).alias("pos", "__c"))
    return cut.select(*others, "pos", F.col("__c.offset").alias("offset"), F.col("__c.size").alias("size"), F.substring("content", F.col("__c.offset").cast("int") + 1, F.col("__c.size")).alias("data"))


def fixed_chunks(files: DataFrame, size: int, block: int = 128 * 1024 * 1024) -> DataFrame:
    """Chunks of `size` bytes; a file's end, and the end of each block that is read of it, cut as well."""
    files = files.withColumn("__n", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).where("__n > 0")
    n = F.col("__n")

    def of_block(b: Column) -> Column:
        end = F.least(n, (b + 1) * block)
        return F.transform(F.sequence(b * block, end - 1, F.lit(size).cast("long")), lambda o: F.struct(o.alias("offset"), F.least(F.lit(size).cast("long"), end - o).cast("int").alias("size")))

    bounds = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block)), of_block))
    return _cut(files, bounds).drop("__n")


def cut_points(content: bytes, params: ChunkParams) -> list[int]:
    """Where the gear hash cuts: the ends of the chunks.

    From `min` bytes into a chunk on, the hash is halved and the byte's number added, in 32 bits. It cuts after a byte where
    the hash ends in zeros: more of them up to the normal size, fewer from there on; at `max` it cuts anyway. What is left
    of at most `min` bytes is one chunk. The halving makes each step wait for the one before, so this is a plain loop; a
    chunk's first `min` bytes are never looked at.
    """
    gear, bits = params.gear, round(math.log2(params.avg))
    hard, easy = ((1 << min(max(bits + d, 1), 31)) - 1 for d in (1, -1))
    normal = min(params.avg - min(params.min + -(-params.min // 2), params.avg), params.max)
    ends, start, n = [], 0, len(content)
    while start < n:
        at, end, hashed = min(start + params.min, n), min(start + params.max, n), 0
        for stop, mask in ((min(start + normal, end), hard), (end, easy)):
            for byte in content[at:stop]:
                hashed = (hashed >> 1) + gear[byte] & 0xFFFFFFFF
                at += 1
                if not hashed & mask:
                    break
            else:
                continue
            break
        ends.append(at)
        start = at
    return ends


def _bounds(params: ChunkParams) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int32())]))
        for batch in batches:
            found = []
            for content in batch.column("content"):
                ends = cut_points(content.as_py() or b"", params)
                found.append([{"offset": a, "size": b - a} for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "__bounds"])

    return task


def content_chunks(files: DataFrame, params: ChunkParams) -> DataFrame:
    """Content-defined chunks; an insertion moves few of a file's boundaries."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    bounded = files.mapInArrow(_bounds(params), f"{types}, __bounds array<struct<offset:bigint,size:int>>")
    return _cut(bounded, F.col("__bounds")).drop("__bounds")


def two_level_chunks(files: DataFrame, segments: ChunkParams, chunks: ChunkParams) -> DataFrame:
    """Content-defined segments, and chunks within each: a chunk never spans two segments. Adds segment."""
    outer = content_chunks(files, segments).withColumnsRenamed({"pos": "segment", "offset": "__base", "data": "content"}).drop("size")
    inner = content_chunks(outer, chunks).withColumn("offset", F.col("offset") + F.col("__base"))
    keys = [c for c in files.columns if c != "content"]
    order = Window.partitionBy("file_id").orderBy("segment", "pos")
    return inner.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).select(*keys, "segment", "pos", "offset", "size", "data")


def fingerprinted(chunks: DataFrame, kind: str = "sha256") -> DataFrame:
    return chunks.withColumn("fp", fingerprint(F.col("data"), kind))


def batches(chunks: DataFrame, size: int, order: tuple[str, ...] = ("pos",), by: str = "file_id") -> DataFrame:
    """Adds batch: runs of `size` rows of a file in order."""
    window = Window.partitionBy(by).orderBy(*order)
    return chunks.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size).cast("int"))


def boundary(fp: Column, params: SegmentParams) -> Column:
    """Whether a chunk's fingerprint may start a segment."""
    return byte_sum(fp) % params.divisor == params.pattern


def _segments(params: SegmentParams) -> Callable:
    def rows(groups):
        for _, table in groups:
            number, count, total, out = 0, 0, 0, []
            for size, cut in zip(table["size"].to_pylist(), table["__cut"].to_pylist()):
                full = count >= params.max_chunks or total + size > params.max_bytes or total >= params.min_bytes and cut
                if count and full:
                    number, count, total = number + 1, 0, 0
                out.append(number)
                count, total = count + 1, total + size
            yield table.drop_columns(["__cut"]).append_column("segment", pa.array(out, pa.int32()))

    return rows


def segment(chunks: DataFrame, params: SegmentParams) -> DataFrame:
    """Adds segment to chunk rows (file_id, pos, size, fp): content-defined segments of each file's chunk stream.

    A segment ends before a chunk if it has the most chunks, would pass the most bytes, or has the fewest bytes and the
    chunk's fingerprint matches the pattern. Sizes add up from the segment's start, so a file is gone through in order; its
    payload should not come along.
    """
    marked = chunks.withColumn("__cut", boundary(F.col("fp"), params))
    return in_order(marked, ["file_id"], ["pos"], _segments(params), chunks, "segment int")


def fixed_segments(chunks: DataFrame, size: int) -> DataFrame:
    """Adds segment: runs of `size` chunks of a file."""
    return batches(chunks, size).withColumnRenamed("batch", "segment")
