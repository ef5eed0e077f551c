"""Containers and recipes, and restoring files from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.operators.ordered import streamed
from chunkweave.params import ADDRESS_BYTES, FEATURE_BYTES, FP_BYTES, IV_BYTES, PackParams


def packed(chunks: DataFrame, lane: str, order: tuple[str, ...], params: PackParams = PackParams(), size: str = "size", metadata: bool = True) -> DataFrame:
    """Adds container and container_offset: each lane's chunks in order, in containers that are closed when the next won't fit.

    A chunk takes its bytes and an IV in the body, and with metadata a row of features and fingerprint. The fill starts anew
    with each container, so a lane is gone through in order; containers are numbered in each lane. Sizes and
    fingerprints are enough here, the payload is joined when containers are written.
    """
    row = FEATURE_BYTES + FP_BYTES if metadata else 0

    def rows(pieces: Iterator[tuple[tuple, bool, pa.Table]]) -> Iterator[pa.Table]:
        container = body = meta = 0
        for _, new, table in pieces:
            if new:
                container = body = meta = 0
            places, offsets = [], []
            for n in table[size].to_pylist():
                fits = IV_BYTES + n + body + row + meta < params.container_bytes and row + meta < params.meta_bytes
                if body and not fits:
                    container, body, meta = container + 1, 0, 0
                places.append(container)
                offsets.append(body)
                body, meta = body + n + IV_BYTES, meta + row
            yield table.append_column("container", pa.array(places, pa.int64())).append_column("container_offset", pa.array(offsets, pa.int64()))

    return streamed(chunks, [lane], list(order), rows, chunks, "container bigint, container_offset bigint")


def container_ids(placed: DataFrame, lane: str) -> DataFrame:
    """Adds container_id, which names lane and number: the same at each run."""
    return placed.withColumn("container_id", F.concat_ws("-", F.col(lane).cast("string"), F.lpad(F.col("container").cast("string"), 8, "0")))


def recipes(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """A file's chunks in order with their addresses: (file_id, pos, fp, container_id, offset, length)."""
    return chunks.select("file_id", "pos", "fp").join(index.select("fp", "container_id", "offset", "length"), "fp")


def file_heads(files: DataFrame, recipe: DataFrame) -> DataFrame:
    """(file_id, file_size, n_chunks) of all files, those without bytes too, which have no recipe rows."""
    sizes = files.select("file_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("file_size"), F.lit(0).alias("n_chunks"))
    counts = recipe.select("file_id", F.lit(0).cast("long").alias("file_size"), F.lit(1).alias("n_chunks"))
    return sizes.unionByName(counts).groupBy("file_id").agg(F.sum("file_size").alias("file_size"), F.sum("n_chunks").alias("n_chunks"))


def wanted_recipes(wanted: DataFrame, recipe: DataFrame, must_exist: bool = True, files: DataFrame | None = None) -> DataFrame:
    """The recipe rows of some file ids. A file without a recipe is an error, or left out.

    A file that has no chunks by `files` (file_id, n_chunks) has no rows, and is no error.
    """
    ids = wanted.select("file_id").distinct()
    if files is not None:
        ids = ids.join(files.where("n_chunks = 0"), "file_id", "left_anti")
    if not must_exist:
        return recipe.join(ids, "file_id", "left_semi")
    found = ids.join(recipe, "file_id", "left")
    gone = F.raise_error(F.concat(F.lit("no recipe of file "), F.col("file_id").cast("string")))
    return found.withColumn("pos", F.when(F.col("pos").isNull(), gone).otherwise(F.col("pos")))


def restored(recipe: DataFrame, store: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, content, n_chunks) of the recipes, from the store (container_id, offset, data).

    A file meets in one task, as it must to be written. A recipe entry that has no chunk is an error. With `files`
    (file_id, n_chunks) those without chunks are restored too, as empty ones, and a recipe of another length is an error.
    """
    joined = recipe.join(store.select("container_id", "offset", "data"), ["container_id", "offset"], "left")
    checked = F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("no chunk for "), F.col("fp")))).otherwise(F.col("data"))
    rows = joined.select("file_id", "pos", checked.alias("data"), F.lit(None).cast("long").alias("told"))
    if files is not None:
        rows = rows.unionByName(files.select("file_id", F.col("n_chunks").cast("long").alias("told")), allowMissingColumns=True)
    kind = dict(rows.dtypes)["file_id"]
    sorted_rows = rows.repartition("file_id").sortWithinPartitions("file_id", F.col("pos").asc_nulls_first())
    return sorted_rows.mapInArrow(_joined, f"file_id {kind}, content binary, n_chunks int")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of rows sorted by file and place; each is joined once, when its last row has come."""
    parts: list[bytes] = []
    told: int | None = None
    before, open_ = None, False

    def whole() -> pa.RecordBatch:
        if told is not None and told != len(parts):
            raise ValueError(f"recipe is not whole of file {before}")
        return pa.RecordBatch.from_arrays([pa.array([before], kind), pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int32())], names=["file_id", "content", "n_chunks"])

    for batch in batches:
        kind = batch.schema.field("file_id").type
        for file_id, data, count in zip(batch.column("file_id").to_pylist(), batch.column("data"), batch.column("told").to_pylist()):
            if not open_ or file_id != before:
                if open_:
                    yield whole()
                parts, told, before, open_ = [], None, file_id, True
            if count is not None:
                told = count + (told or 0)
            elif data.is_valid:
                parts.append(data.as_py())
    if open_:
        yield whole()


def containers_of(wanted: DataFrame, store: DataFrame, must_exist: bool = True) -> DataFrame:
    """The chunk rows of some container ids. Ids that are unknown: an error, or rows with size 0."""
    found = wanted.select("container_id").distinct().join(store, "container_id", "left")
    if must_exist:
        gone = F.raise_error(F.concat(F.lit("no container "), F.col("container_id")))
        return found.withColumn("size", F.when(F.col("size").isNull(), gone).otherwise(F.col("size")))
    return found.withColumn("size", F.coalesce("size", F.lit(0)))


def message_bytes(rows: str, kind: str):
    """Bytes that some rows take on the wire, by kind: fp, feature or address."""
    return F.col(rows) * {"fp": FP_BYTES, "feature": FEATURE_BYTES + FP_BYTES, "address": ADDRESS_BYTES + FP_BYTES}[kind]


def lru_hits(accesses: DataFrame, lane: str, key: str, order: tuple[str, ...], size: int) -> DataFrame:
    """Adds hit: whether a cache of the `size` last used keys would hold the key; each lane has its cache."""

    def rows(pieces: Iterator[tuple[tuple, bool, pa.Table]]) -> Iterator[pa.Table]:
        cache: dict = {}
        for _, new, table in pieces:
            if new:
                cache = {}
            hits = []
            for k in table[key].to_pylist():
                hits.append(int(k in cache))
                cache.pop(k, None)
                cache[k] = None
                if len(cache) > size:
                    del cache[next(iter(cache))]
            yield table.append_column("hit", pa.array(hits, pa.int32()))

    return streamed(accesses, [lane], list(order), rows, accesses, "hit int")


def container_cache(accesses: DataFrame, lane: str, order: tuple[str, ...], size: int, features: str | None = None) -> DataFrame:
    """Adds hit and similar: what a cache of the metadata of the `size` last used containers finds.

    accesses: (fp, container_id, fps of that container). A fingerprint that no cached container has brings its container in; the
    one used longest ago goes, with all its fingerprints and features. features: a column of arrays; similar says whether a
    container at hand has one of them (then `container_features` has those of the container brought in).
    """

    def rows(pieces: Iterator[tuple[tuple, bool, pa.Table]]) -> Iterator[pa.Table]:
        held: dict = {}
        where: dict[tuple, dict] = {}
        for _, new, table in pieces:
            if new:
                held, where = {}, {}
            hits, similar = [], []
            asked = table[features].to_pylist() if features else [()] * table.num_rows
            brought = table["container_features"].to_pylist() if features else [()] * table.num_rows
            for fp, container, fps, wanted, more in zip(table["fp"].to_pylist(), table["container_id"].to_pylist(), table["fps"].to_pylist(), asked, brought):
                near = next(iter(where.get((0, fp), ())), None)
                similar.append(int(any((1, f) in where for f in wanted or ())))
                hits.append(int(near is not None))
                used = near if near is not None else container
                if used in held:
                    held[used] = held.pop(used)
                    continue
                if used is None:
                    continue
                keys = {(0, x) for x in fps or ()} | {(1, x) for x in more or ()}
                held[used] = keys
                for k in keys:
                    where.setdefault(k, {})[used] = None
                if len(held) > size:
                    gone = next(iter(held))
                    for k in held.pop(gone):
                        del where[k][gone]
                        if not where[k]:
                            del where[k]
            yield table.append_column("hit", pa.array(hits, pa.int32())).append_column("similar", pa.array(similar, pa.int32()))

    return streamed(accesses, [lane], list(order), rows, accesses, "hit int, similar int")
