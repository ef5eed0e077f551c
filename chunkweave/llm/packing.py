"""Hierarchical multi-length packing of tokenised documents.

Full windows of the longest tier are cut off a document; what is left goes to the smallest tier that it fits, and
each tier is packed from the longest down. A window starts with a document of its tier; the gap is filled with whole
documents of the shorter tiers, the longest that fit first, and closed by cutting the head off one more. So windows
are exactly full. The sequences are then dealt into step groups of equal numbers of tokens.

Each task packs the documents that it reads, so neither texts nor token ids are shuffled and a lost task is simply
run again. What a task has left at its end is cut into windows of falling powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.frames import batches_by_weight
from chunkweave.llm.tokens import word_tokens

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
#: Bytes of text tokenised at a time; remainders of documents that wait for a window before the tiers are packed.
SLICE_BYTES, WAITING = 1_000_000, 2_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """The pools of a task. Pieces come out as (document, start, length, sequence, offset, tier, step group)."""

    def __init__(self, tiers: tuple[int, ...], step: int, first: int):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are rising powers of two")
        if step % tiers[-1]:
            raise ValueError("a step is a multiple of the longest tier")
        self.tiers, self.step = tiers, step
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), by length
        self.sequence = self.group = first
        self.waiting = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, length: int) -> None:
        long, start = self.tiers[-1], 0
        while length - start >= long:
            self.windows.append((long, [(long, doc, start)]))
            start += long
        self._wait(doc, start, length - start)

    def _wait(self, doc: int, start: int, length: int) -> None:
        if length:
            insort(self.pools[self._tier(length)], (length, doc, start))
            self.waiting += 1

    def _tier(self, length: int) -> int:
        return next(k for k, t in enumerate(self.tiers) if length <= t)

    def _take(self, tier: int, most: int) -> tuple[int, int, int] | None:
        """The longest remainder of the tier that is not over `most`."""
        pool = self.pools[tier]
        k = bisect_right(pool, (most, np.inf, 0))
        if not k:
            return None
        self.waiting -= 1
        return pool.pop(k - 1)

    def pack(self) -> None:
        """Fills windows of each tier, longest first, for as long as the pools can fill them."""
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k] and self._window(k):
                pass

    def _window(self, tier: int) -> bool:
        size = self.tiers[tier]
        parts = [self._take(tier, size)]
        gap = size - parts[0][0]
        while gap:
            found = None
            for k in range(tier - 1, -1, -1):
                if found := self._take(k, gap):
                    break
            found = found or self._take(tier, gap)
            if not found:  # the head of the shortest that is longer closes the gap
                k = next((k for k in range(tier + 1) if self.pools[k]), None)
                if k is None:
                    for length, doc, start in parts:
                        self._wait(doc, start, length)
                    return False
                self.waiting -= 1
                length, doc, start = self.pools[k].pop(0)
                found = (gap, doc, start)
                self._wait(doc, start + gap, length - gap)
            parts.append(found)
            gap -= found[0]
        self.windows.append((size, parts))
        return True

    def finish(self) -> None:
        """Cuts what is left into windows of falling powers of two."""
        self.pack()
        left = sorted((x for pool in self.pools for x in pool), key=lambda x: x[1:])
        self.pools, self.waiting = [[] for _ in self.tiers], 0
        total = sum(x[0] for x in left)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            gap, parts = size, []
            while gap:
                length, doc, start = left.pop(0)
                take = min(gap, length)
                parts.append((take, doc, start))
                if take < length:
                    left.insert(0, (length - take, doc, start + take))
                gap -= take
            self.windows.append((size, parts))
            total -= size

    def pieces(self, last: bool = False) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """The windows that fill step groups, or all at last. Dealt longest first, falling powers of two fill a group exactly."""
        self.windows.sort(key=lambda w: -w[0])
        total = sum(w[0] for w in self.windows)
        ready, done = total if last else total - total % self.step, 0
        for n, (size, parts) in enumerate(self.windows):
            if done == ready:
                self.windows = self.windows[n:]
                return
            offset = 0
            for length, doc, start in parts:
                yield doc, start, length, self.sequence, offset, size, self.group
                offset += length
            self.sequence, done = self.sequence + 1, done + size
            if done % self.step == 0:
                self.group += 1
        self.windows = []


def _packed(path: str, end: int, tiers: tuple[int, ...], step: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, coder = Packer(tiers, step, TaskContext.get().partitionId() << 33), word_tokens(path)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        number = 0

        def out(last: bool = False) -> Iterator[pa.RecordBatch]:
            rows = list(packer.pieces(last))
            if not rows:
                return
            doc, start, length, sequence, offset, tier, group = zip(*rows)
            ids = [held[d][1][s : s + n].tobytes() for d, s, n in zip(doc, start, length)]
            columns = [[held[d][0] for d in doc], start, length, [len(held[d][1]) for d in doc], ids, sequence, offset, tier, group]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])
            waiting = {x[1] for pool in packer.pools for x in pool} | {x[1] for _, parts in packer.windows for x in parts}
            for d in [d for d in held if d not in waiting]:
                del held[d]

        for whole in batches:
            for batch in batches_by_weight(whole, "text", SLICE_BYTES):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                for i, ids in zip(batch.column("id").to_pylist(), coder.encode(texts)):
                    held[number] = (i, np.append(ids, np.uint32(end)).astype("<u4"))
                    packer.add(number, len(ids) + 1)
                    number += 1
                if packer.waiting >= WAITING:
                    packer.pack()
                yield from out()
        packer.finish()
        yield from out(last=True)

    return task


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, tiers: tuple[int, ...] = TIERS, step: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset, tier, step_group.

    A document is the ids that the tokenizer file gives for its whole text (null: empty), then the id `end`; so an empty
    text is one id. ids has the piece's ids as little-endian unsigned 32-bit numbers. A sequence holds `tier` ids, a
    power of two, without padding. A row is a document of its own: rows that repeat a doc_id, or have none, are each
    packed, with the doc_id they have. Other columns play no part. An empty table gives an empty one. All
    sequences of a step group together have `step` ids, but for the last group of a task.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return texts.mapInArrow(_packed(tokenizer, end, tiers, step), PIECES)
