"""Approximate nearest neighbours on robust-pruned directed graphs (after Subramanya and others, 2019), one a shard.

A shard's graph grows from its medoid. For each point a greedy beam search in the graph so far proposes neighbours, and relaxed
distance pruning keeps a diverse few: a candidate goes if a kept one is closer to it, by a factor, than the point is. Edges are
put in both ways, and a point whose list is full is pruned again. A query searches the graph of every shard with a beam. Points
are taken a batch at a time, in lockstep, so each step is a few matrix operations. Equal vectors are one point.

A search visits some thousands of points, more or less whatever the size of the shard, so shards are large; the README has the
share visited and the recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.frames import checkpointed, grouped_tables
from chunkweave.llm.vectors import usable

BATCH, WIDE, ENTRIES = 256, 2, 8
ALPHA = 1.2
#: Vectors whose magnitudes differ by more than this power of two are searched in double precision.
FLOAT_RANGE = 20


def scaled(*matrices: np.ndarray) -> tuple[int, type, list[np.ndarray]]:
    """Non-zero vectors over one power of two, which makes the largest number one of 0.5 to 1; the type that holds their squares."""
    powers = np.concatenate([np.frexp(np.abs(m).max(axis=1))[1] for m in matrices])
    most = int(powers.max())
    return most, np.float32 if most - powers.min() <= FLOAT_RANGE else np.float64, [np.ldexp(m, -most) for m in matrices]


class Graph:
    """Points in rows of x, and up to `degree` neighbours of each, -1 for none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray, kind: type = np.float32):
        self.x, self.edges, self.entries = np.ascontiguousarray(x, kind), edges, entries
        #: Distances from queries to points that searches have computed.
        self.visits = 0
        self.norms = np.einsum("ij,ij->i", self.x, self.x)

    @classmethod
    def build(cls, x: np.ndarray, degree: int, beam: int, seed: int = 0, kind: type = np.float32) -> Graph:
        """Points come in one by one, later on in batches of up to BATCH, an eighth of the points before them."""
        r, n = np.random.default_rng(seed), len(x)
        order = r.permutation(n)
        centre = np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))
        order = np.append(centre, order[order != centre])
        graph = cls(x, np.full((n, degree), -1, np.int32), order[:1], kind)
        i = 1
        while i < n:
            batch = order[i : i + min(max(1, i // 8), BATCH)]
            graph._insert(batch, beam)
            i += len(batch)
        graph.entries = np.unique(order[:ENTRIES])
        return graph

    def _insert(self, points: np.ndarray, beam: int) -> None:
        """Edges to what pruning keeps of the points that a search finds, and back; a point without room is pruned first."""
        found, _ = self.search(self.x[points], beam)
        degree = self.edges.shape[1]
        slim = max(1, degree * 3 // 4)
        self.edges[points, :slim] = self._pruned(points, found, slim)
        a, b = np.repeat(points, slim), self.edges[points, :slim].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        target, first, count = np.unique(b, return_index=True, return_counts=True)
        held = (self.edges[target] >= 0).sum(axis=1)
        full = held + count > degree
        row = np.repeat(np.arange(len(target)), count)
        place = np.arange(len(a)) - first[row]
        roomy = ~full[row]
        self.edges[b[roomy], (held[row] + place)[roomy]] = a[roomy]
        over = np.flatnonzero(full)
        for i in range(0, len(over), BATCH):
            part = over[i : i + BATCH]
            more = np.full((len(part), int(count[part].max())), -1, np.int32)
            for k, t in enumerate(part):
                more[k, : count[t]] = a[first[t] : first[t] + count[t]]
            kept = self._pruned(target[part], np.concatenate([self.edges[target[part]], more], axis=1), slim)
            self.edges[target[part]] = -1
            self.edges[target[part], :slim] = kept

    def _pruned(self, points: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """The candidates, up to `most`, that pruning keeps for each point, nearest first."""
        rows = np.arange(len(points))
        candidates = np.sort(np.where(candidates == points[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        away = self._from(self.x[points], self.norms[points], candidates)
        order = np.argsort(away, axis=1, kind="stable")
        candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
        width = int((candidates >= 0).sum(axis=1).max(initial=0))
        candidates, away = candidates[:, :width], away[:, :width].copy()
        out, vectors = np.full((len(points), most), -1, np.int32), self.x[candidates]
        norms = self.norms[candidates]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        for k in range(min(most, width)):
            best = np.argmin(away, axis=1)
            live = np.isfinite(away[rows, best])
            if not live.any():
                break
            chosen = candidates[rows, best]
            out[live, k] = chosen[live]
            apart = norms + self.norms[chosen][:, None] - 2 * between[rows, best]
            away[(ALPHA * ALPHA * apart <= away) & live[:, None]] = np.inf
            away[rows, best] = np.inf
        return out

    def _from(self, queries: np.ndarray, norms: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Squared distances from each query to its row of points; infinite for -1."""
        d = self.norms[points] + norms[:, None] - 2 * np.matmul(self.x[points], queries[:, :, None])[:, :, 0]
        return np.where(points >= 0, d, np.inf)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam at its end: the nearest points found to each query, nearest first, and their squared distances."""
        queries = np.ascontiguousarray(queries, self.x.dtype)
        n, rows = len(queries), np.arange(len(queries))
        norms = np.einsum("ij,ij->i", queries, queries)
        beam = min(beam, len(self.x))
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        points = np.tile(self.entries.astype(np.int32), (n, 1))
        seen[:, self.entries] = True
        away, done = self._from(queries, norms, points), np.zeros(points.shape, bool)
        while True:
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            points, away, done = (np.take_along_axis(v, order, 1) for v in (points, away, done))
            left = np.where(done, np.inf, away)
            best = np.argsort(left, axis=1, kind="stable")[:, :WIDE]
            live = np.isfinite(np.take_along_axis(left, best, 1))
            if not live.any():
                return points, away
            np.put_along_axis(done, best, True, 1)
            new = np.where(live[:, :, None], self.edges[np.take_along_axis(points, best, 1)], -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[rows[:, None], new], -1, new)
            seen[rows[:, None], new] = True
            points = np.concatenate([points, new], axis=1)
            self.visits += int((new >= 0).sum())
            away = np.concatenate([away, self._from(queries, norms, new)], axis=1)
            done = np.concatenate([done, new < 0], axis=1)


def _gather(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Usable vectors with their shard, as bytes of doubles; a query row goes to every shard."""
    for batch in batches:
        ids, shards, asked = batch.column("id").to_pylist(), batch.column("shard").to_pylist(), batch.column("query").to_pylist()
        for rows, matrix in usable(batch.column("vector")):
            rows = [k for k in zip(rows.tolist(), matrix) if ids[k[0]] is not None]
            yield pa.RecordBatch.from_pydict({"shard": [shards[r] for r, _ in rows], "query": [asked[r] for r, _ in rows], "id": [ids[r] for r, _ in rows], "size": [len(x) for _, x in rows], "vector": [x.tobytes() for _, x in rows]}, schema=schema)


POINTS = "shard int, query boolean, id long, size int, vector binary"
_POINTS = pa.schema([("shard", pa.int32()), ("query", pa.bool_()), ("id", pa.int64()), ("size", pa.int32()), ("vector", pa.binary())])
INDEX = "shard int, size int, point int, ids array<long>, vector binary, edges array<int>, entry boolean"
_INDEX = pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("point", pa.int32()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary()), ("edges", pa.list_(pa.int32())), ("entry", pa.bool_())])


def points(table: DataFrame, vec_id: str, vector: str, shards: int, query: bool) -> DataFrame:
    shard = F.lit(-1) if query else F.pmod(F.xxhash64(vec_id), F.lit(shards)).cast("int")
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"), shard.alias("shard"), F.lit(query).alias("query"))
    return rows.mapInArrow(lambda batches: _gather(batches, _POINTS), POINTS)


def _built(degree: int, beam: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, size, table in _shards(batches):
            members: dict[bytes, list[int]] = {}
            for i, v in zip(table["id"].to_pylist(), table["vector"].to_pylist()):
                members.setdefault(v, []).append(i)
            x = np.frombuffer(b"".join(members), np.float64).reshape(len(members), -1)
            _, kind, (near,) = scaled(x)
            graph = Graph.build(near, degree, beam, kind=kind)
            n = len(members)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard] * n, "size": [size] * n, "point": np.arange(n, dtype=np.int32), "ids": [sorted(m) for m in members.values()], "vector": list(members), "edges": graph.edges.tolist(), "entry": np.isin(np.arange(n), graph.entries)},
                schema=_INDEX,
            )

    return task


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    for table in grouped_tables(batches, "shard", "size"):
        keys = np.stack([table["shard"].to_numpy(), table["size"].to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
        for a, b in zip(cuts, cuts[1:]):
            yield int(keys[0, a]), int(keys[1, a]), table.slice(a, b - a)


def build_index(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 100_000, degree: int = 64, beam: int = 48) -> DataFrame:
    """The graphs of all shards: shard, size, point, ids (of equal vectors), vector (bytes of doubles), edges, entry.

    Every vector is indexed, but those that are null, empty, zero or hold nulls or non-finite numbers, and rows without vec_id. A
    shard has about `shard_rows` vectors, dealt by a hash of vec_id, and is built in one task. Other columns play no part.
    """
    shards = max(1, -(-table.count() // shard_rows))
    rows = points(table, vec_id, vector, shards, False)
    return rows.repartition("shard", "size").sortWithinPartitions("shard", "size", "id").mapInArrow(_built(degree, beam), INDEX)


FOUND = "query_id long, vec_id long, score double"


def _answered(k: int, beam: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, table in _shards(batches):
            asked = table.filter(pc.is_null(table["point"]))
            table = table.filter(pc.is_valid(table["point"])).sort_by("point")
            if not asked.num_rows or not table.num_rows:
                continue
            x = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(table.num_rows, -1)
            edges, entries = np.array(table["edges"].to_pylist(), np.int32), np.flatnonzero(table["entry"].to_numpy())
            ids = table["ids"].to_pylist()
            queries = np.frombuffer(b"".join(asked["vector"].to_pylist()), np.float64).reshape(asked.num_rows, -1)
            names = asked["id"].to_pylist()
            power, kind, (x, queries) = scaled(x, queries)
            graph = Graph(x, edges, entries, kind)
            for i in range(0, len(queries), BATCH):
                near, away = graph.search(queries[i : i + BATCH], beam)
                out = []
                for q, name, row, d in zip(queries[i : i + BATCH], names[i : i + BATCH], near, away):
                    row = row[np.isfinite(d)]
                    exact = np.ldexp(np.sqrt(((x[row] - q) ** 2).sum(axis=1)), power)
                    best = sorted((s, j) for s, p in zip(exact.tolist(), row.tolist()) for j in ids[p][: k + 1] if j != name)
                    out += [(name, j, s) for s, j in best[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"]) if out else pa.RecordBatch.from_pydict({"query_id": [], "vec_id": [], "score": []}, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return task


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = 112, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest found to each query: query_id, rank from 1, vec_id, score, the Euclidean distance in double precision.

    A query isn't its own neighbour: the row of its vec_id is left out. Ties go to the smaller vec_id. A query whose
    vector can't be indexed finds nothing and has no rows; so has one of a length that no indexed vector has. An
    empty index or no queries give an empty table. Other columns of the queries play no part. The queries, a stated set, are sent to every shard. Vectors may be of any
    magnitude; differences under 1e-150 of the largest number of a shard or its queries count as none.
    """
    shards = index.select("shard", "size").distinct()
    asked = points(queries.dropDuplicates([vec_id]), vec_id, vector, 1, True).drop("shard").join(shards, "size")
    both = index.select("shard", "size", "point", "ids", "vector", "edges", "entry", F.lit(None).cast("long").alias("id")).unionByName(asked.select("shard", "size", "id", "vector"), allowMissingColumns=True)
    found = both.repartition("shard", "size").sortWithinPartitions("shard", "size").mapInArrow(_answered(k, beam), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_all(table: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", **built: int) -> DataFrame:
    """Builds the index of a table once, in the checkpoint folder, and searches it."""
    return nearest(checkpointed(build_index(table, vec_id, vector, **built)), queries, k, vec_id=vec_id, vector=vector)
