"""Embedding near-dedup with a pivot-permutation index (after Amato and Savino, 2008, and Tellez and others, 2013).

Each vector is described by the order of its nearest pivots, of a fixed sample of vectors. It is posted to inverted lists, kept
apart by label. A list's key is not one pivot but two, the first two by number that two vectors share; so a pair meets in one list
for each two pivots that it shares, and is taken in the first of them only. The number of shared pivots is counted on sets of bits, and
vectors are multiplied only for the pairs that share enough: each candidate once, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.llm.components import components
from chunkweave.llm.frames import checkpointed, grouped_tables
from chunkweave.llm.vectors import unit, usable

#: Vectors of a list that meet in one task as a block; pairs that are looked at in one step; classes that a task remembers.
BLOCK, STEP, CLASSES_HELD = 512, 500_000, 50_000
#: Long lists that are broadcast at most, a row of some 50 bytes each.
MOST_BROADCAST = 20_000

CLASSES = "id long, first_id long, label string, size int, vector binary, bits binary, keys array<long>, copies long"
_CLASSES = pa.schema([("id", pa.int64()), ("first_id", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("vector", pa.binary()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64())), ("copies", pa.int64())])


def _described(pivots: np.ndarray, nearest: int, shared: int, kind: str) -> Callable:
    """Row for row its class, the first equal vector of the task; and the classes, each with the bits of its nearest pivots and its lists."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple, list] = {}
        for batch in batches:
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            found = []
            for rows, matrix in usable(batch.column("vector")):
                order = _nearest(unit(matrix), pivots, nearest)
                for r, x, near in zip(rows.tolist(), matrix.astype(kind), order):
                    if labels[r] is None or ids[r] is None:
                        continue
                    kept = classes.setdefault((labels[r], x.tobytes()), [ids[r], labels[r], len(x), near, 0])
                    kept[-1] += 1
                    found.append((ids[r], kept[0]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(a), f.type) for f in list(_CLASSES)[2:]]], schema=_CLASSES)
            if len(classes) >= CLASSES_HELD:
                yield from _classes(classes, len(pivots), shared)
                classes = {}
        yield from _classes(classes, len(pivots), shared)

    return task


def _classes(classes: dict[tuple, list], pivots: int, shared: int) -> Iterator[pa.RecordBatch]:
    kept = list(classes.items())
    for i in range(0, len(kept), 5_000):
        (of, rows), near = zip(*kept[i : i + 5_000]), [np.sort(x[3]) for _, x in kept[i : i + 5_000]]
        yield pa.RecordBatch.from_pydict(
            {"id": [x[0] for x in rows], "first_id": [None] * len(rows), "label": [x[1] for x in rows], "size": [x[2] for x in rows], "vector": [k[1] for k in of], "bits": [_bits(x, pivots) for x in near], "keys": [_keys(x.tolist(), pivots, shared) for x in near], "copies": [x[-1] for x in rows]},
            schema=_CLASSES,
        )


def _bits(near: np.ndarray, pivots: int) -> bytes:
    words = np.zeros(pivots // 64 + 1, np.uint64)
    np.bitwise_or.at(words, near // 64, np.uint64(1) << (near % 64).astype(np.uint64))
    return words.tobytes()


def _keys(near: list[int], pivots: int, shared: int) -> list[int]:
    """The lists of a vector with these pivots, sorted: all twos that may be the first ones that it shares; -1 without pivots."""
    if not near:
        return [-1]
    if shared < 2 or len(near) < 2:
        return [p * pivots + p for p in near]
    return [p * pivots + q for p, q in combinations(near[: len(near) - (shared - 2)], 2)]


def _nearest(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    if not len(pivots) or vectors.shape[1] != pivots.shape[1]:
        return np.zeros((len(vectors), 0), np.int32)  # of another length than the sample: one list for all of that length
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)


SAMPLE = "place long, id long, direction binary, vector array<double>"


def _sampled(pivots: int) -> Callable:
    """The first rows of the task by place (a hash of the id) that are usable, one for each direction."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        for batch in batches:
            places, ids = batch.column("place").to_pylist(), batch.column("id").to_pylist()
            last = max(first.values())[:2] if len(first) >= pivots else None
            early = [k for k, at in enumerate(zip(places, ids)) if last is None or at < last]
            for rows, matrix in usable(batch.column("vector").take(pa.array(early, pa.int64()))):
                for r, x, u in zip(rows.tolist(), matrix, unit(matrix)):
                    direction = (np.round(u, 6) + 0.0).tobytes()
                    row = (places[early[r]], ids[early[r]], direction, x.tolist())
                    first[direction] = min(row, first.get(direction, row))
            first = {x[2]: x for x in sorted(first.values())[:pivots]}
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*first.values()), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())))], names=["place", "id", "direction", "vector"])

    return task


LINKS = "id long, root long, links long"


def _linked(least: float, shared: int, pivots: int, kind: str) -> Callable:
    """Of rows sorted by list and pair of blocks: the links of each vector, and the smallest that it reaches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_tables(batches, "label", "size", "key", "low", "high"):
            for part in _of_one_size(table.combine_chunks()):
                out = _links(part, least, shared, pivots, kind)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "root", "links"])

    return task


def _of_one_size(table: pa.Table) -> Iterator[pa.Table]:
    size = table["size"].to_numpy()
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        yield table.slice(a, b - a)


def _links(table: pa.Table, least: float, shared: int, pivots: int, kind: str) -> tuple | None:
    table = _once(table)
    n = table.num_rows
    if n < 2:
        return None
    same = np.ones(n - 1, bool)
    for c in ("key", "low", "high"):
        x = table[c].to_numpy()
        same &= x[1:] == x[:-1]
    labels = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    same &= labels[1:] == labels[:-1]
    ends = np.append(np.flatnonzero(~same) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    ids, copies, key, block = (table[c].to_numpy() for c in ("id", "copies", "key", "block"))
    across = table["low"].to_numpy() != table["high"].to_numpy()
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(n, -1)
    under = _upto(key, pivots, bits.shape[1])
    vectors = unit(np.frombuffer(b"".join(table["vector"].to_pylist()), kind).astype(float).reshape(n, -1))
    leading = np.where(key < 0, 0, np.where(key // max(pivots, 1) == key % max(pivots, 1), 1, 2))
    each = end - np.arange(n) - 1
    total = np.cumsum(each)
    links, firsts, seconds, row = np.zeros(n, np.int64), [], [], 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + STEP, "right")))
        a = np.repeat(np.arange(row, to), each[row:to])
        if len(a):
            first = np.cumsum(each[row:to]) - each[row:to]
            b = a + 1 + np.arange(len(a)) - np.repeat(first, each[row:to])
            fine = (ids[a] != ids[b]) & (~across[a] | (block[a] != block[b]))
            a, b = a[fine], b[fine]
            common = bits[a] & bits[b]
            fine = (np.bitwise_count(common & under[a]).sum(axis=1) == leading[a]) & ((np.bitwise_count(common).sum(axis=1) >= shared) | (key[a] < 0))
            a, b = a[fine], b[fine]
            near = _cosines(vectors, a, b) >= least
            firsts.append(a[near])
            seconds.append(b[near])
        row = to
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (firsts, seconds))
    if not len(a):
        return None
    links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
    names, node = np.unique(ids, return_inverse=True)
    root, a, b = np.arange(len(names)), node[a], node[b]
    while True:  # the smallest vector reachable; the pairs of a list make short chains
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    of_name = np.bincount(node, links, len(names)).astype(np.int64)
    linked = of_name > 0
    return names[linked], names[root][linked], of_name[linked]


def _cosines(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs of rows, a few at a time."""
    parts = [np.einsum("ij,ij->i", vectors[a[i : i + 20_000]], vectors[b[i : i + 20_000]]) for i in range(0, len(a), 20_000)]
    return np.concatenate([np.empty(0), *parts])


def _upto(key: np.ndarray, pivots: int, words: int) -> np.ndarray:
    """For each list the bits of all pivots up to its second one; none for the list of vectors without pivots."""
    second = np.where(key < 0, -1, key % max(pivots, 1))
    held = np.clip(second[:, None] + 1 - 64 * np.arange(words), 0, 64).astype(np.uint64)
    return np.where(held == 64, ~np.uint64(0), (np.uint64(1) << (held % np.uint64(64))) - np.uint64(1))


def _once(table: pa.Table) -> pa.Table:
    """A repeated row that several tasks read is one member of its list, with all its copies."""
    columns = ["label", "key", "low", "high", "block", "id"]
    if table.num_rows == table.select(columns).group_by(columns).aggregate([]).num_rows:
        return table
    columns.append("vector")
    summed = table.group_by([*columns, "size", "bits"], use_threads=False).aggregate([("copies", "sum")]).rename_columns({"copies_sum": "copies"})
    return summed.select(table.column_names).sort_by([(c, "ascending") for c in ("label", "key", "low", "high")])


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, pivots: int = 128, nearest: int = 7, shared: int = 3) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept. Links: equal labels and a cosine of at least `least`.

    The pivots are a sample of at most `pivots` usable vectors of different directions, the first by a hash of vec_id; every
    vector is indexed. Pairs that share fewer than `shared` of their `nearest` pivots, or than all if there are fewer
    pivots, are not found; the README has the recall. Pairs found are
    compared in double precision. Equal vectors of a task are one class, counted by its number.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and those without label, link with
    nothing; so do vectors of different lengths. A row without vec_id links with nothing and has no component. Rows that
    repeat a vec_id are linked if their vectors are equal. Other columns play no part. An empty table gives an empty
    one. A list may hold any share of the rows: beyond BLOCK rows it is cut into blocks, each pair of blocks a group.
    """
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").cast("string").alias("label"))
    able = rows.where("id is not null and label is not null and size(vector) > 0").select(F.xxhash64("id").alias("place"), "id", "vector")
    firsts = able.mapInArrow(_sampled(pivots), SAMPLE).groupBy("direction").agg(F.min(F.struct("place", "id", "vector")).alias("v"))
    sample = firsts.orderBy("v.place", "v.id", "direction").limit(pivots).select("v.vector").toArrow()
    chosen = max((unit(m) for _, m in usable(sample["vector"])), key=len, default=np.empty((0, 0)))
    shared = min(shared, nearest, max(len(chosen), 1))
    kind = "<f4" if table.schema[vector].dataType == T.ArrayType(T.FloatType()) or table.schema[vector].dataType == T.ArrayType(T.FloatType(), False) else "<f8"
    described = checkpointed(rows.mapInArrow(_described(chosen, nearest, shared, kind), CLASSES))
    classes = described.where("first_id is null")
    posted = classes.withColumn("key", F.explode("keys")).drop("keys")
    long = checkpointed(posted.groupBy("label", "size", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("label", "size", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if long.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        long = F.broadcast(long)  # else the postings are shuffled once more
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = posted.join(long, ["label", "size", "key"], "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["label", "size", "key", "low", "high"]
    dealt = dealt.select("label", "size", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "vector", "bits")
    # The dealing includes the blocks, so the pairs of blocks of a long list go to different tasks.
    found = checkpointed(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(least, shared, len(chosen), kind), LINKS))
    members = described.where("first_id is not null").select("id", "first_id")
    component = components(found.select("id", "root").unionByName(members.select("id", F.col("first_id").alias("root"))), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("id", "copies").groupBy("id").agg(F.sum("copies").alias("copies")).join(links, "id", "left").select(F.col("id").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    linked = members.join(of_class, F.col("first_id") == F.col("class")).join(component, F.col("id") == F.col("node"), "left").groupBy(F.col("id").alias("vec")).agg(F.max("links").alias("links"), F.min("component").alias("component"))
    result = rows.select("id").join(linked, F.col("id") == F.col("vec"), "left")
    component_id = F.coalesce("component", "id")
    return result.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), (F.col("id").isNotNull() & (component_id == F.col("id"))).alias("kept"))
