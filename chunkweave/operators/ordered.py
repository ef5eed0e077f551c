"""Operators that go through the rows of a group one after the other.

Rows are dealt by group and sorted. in_order() hands over whole groups, so a task holds the open group: for files and batches.
streamed() hands over pieces of a batch, and the function carries what it needs from piece to piece (a running size, a cache):
for long streams. Groups should be many: a file, a client's stream, a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _change(batch: pa.RecordBatch, keys: list[str], row: int) -> bool:
    return any(batch.column(k)[row] != batch.column(k)[row - 1] for k in keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The key and rows of each group, of batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for row, here in enumerate(zip(*columns)):
            if here != key:
                if row > start:
                    held.append(batch.slice(start, row - start))
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key, start = [], here, row
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def in_order(df: DataFrame, keys: list[str], order: list[str], rows: Callable, like: DataFrame, added: str) -> DataFrame:
    """Runs rows(groups) over the sorted groups of df; it yields tables of the columns of `like` and those added."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows(groups(batches, keys)):
            yield from table.combine_chunks().to_batches()

    return _run(df, keys, order, task, like, added)


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.Table]]:
    """The key of each run of rows of one group within a batch, whether the group is new, and the rows."""
    key: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        every = list(zip(*columns))
        cuts = [0, *(i for i in range(1, len(every)) if every[i] != every[i - 1]), len(every)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield every[a], every[a] != key, pa.Table.from_batches([batch.slice(a, b - a)])
                key = every[a]


def streamed(df: DataFrame, keys: list[str], order: list[str], rows: Callable, like: DataFrame, added: str) -> DataFrame:
    """Runs rows(pieces) over the sorted rows of df; it yields a table of the columns of `like` and those added for each piece."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows(pieces(batches, keys)):
            yield from table.combine_chunks().to_batches()

    return _run(df, keys, order, task, like, added)


def _run(df: DataFrame, keys: list[str], order: list[str], task: Callable, like: DataFrame, added: str) -> DataFrame:
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, f"{types}, {added}")
