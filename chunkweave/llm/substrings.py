"""Substring dedup by recompression: equal substrings share their interior symbols.

A round of recompression names, in a row of symbols, first the runs of one symbol (symbol, count) and then pairs: a symbol's
bit marks it left or right, and a left one followed by a right one is replaced by the pair's name. A run has the bit of
its symbol, whatever its count. Names are 64-bit hashes of what they stand for, so a name is the same in every task and
document, and no table deals names out.

What a symbol at the edge of a window will be depends on words outside. So in each round a window pops its first and last
run, and the neighbour that would pair with one of these; the rest, its interior, is the same wherever the window
occurs. Popped to the end, a window is a short row of symbols: its signature, which spells the window. Of the symbols of the
interior after LEVEL rounds, CHAIN neighbours with the smallest hash are the window's anchor.

Round 1 over Spark counts the names of all anchors. Round 2 gives documents the windows whose anchors have a name that occurs
twice. Round 3 compares those windows by their signatures, dealt by anchor; an anchor with many rows is dealt by
signature too, so windows that share a common phrase only are spread out, and of equal windows a task sends on
one only if it may be the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.frames import REST, checkpointed, grouped_tables, trimmed, with_rest
from chunkweave.llm.words import mixed, names_of, pair_names, span_names, words_of

LEVEL, CHAIN = 2, 3
BLOCK_WORDS = 200_000
#: Rows of an anchor that are dealt as one group; signatures of larger anchors that a task remembers.
GROUP_ROWS, REMEMBERED = 64, 500_000
ADDED = ("n_words", "n_removed", "kept_text")
TOP = np.uint64(63)
#: Bits of a run's span that hold its number of windows.
COUNT_BITS = 24
#: What a popped piece of a signature is.
FIRST, LAST, BEFORE, AFTER, WHOLE = 101, 102, 103, 104, 105


class Symbols:
    """One level: names of symbols, the documents they are in, their runs and the pairs of runs, which are the next level."""

    def __init__(self, names: np.ndarray, doc: np.ndarray, level: int):
        self.names, self.doc, n = names, doc, len(names)
        new = np.ones(n, bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        self.run = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), n)
        count, base = np.diff(self.first), names[self.first[:-1]]
        many = np.flatnonzero(count > 1)
        self.run_names = base.copy()
        self.run_names[many] = pair_names(base[many], count[many].astype(np.uint64), 2 * level + 1)
        left = (mixed(base ^ np.uint64(2 * level + 1)) >> TOP).astype(bool)
        of = doc[self.first[:-1]]
        self.paired = np.zeros(len(base) + 1, bool)  # a run with the one after it
        if len(base) > 1:
            self.paired[:-2] = left[:-1] & ~left[1:] & (of[:-1] == of[1:])
        starts = np.ones(len(base), bool)
        starts[1:] = ~self.paired[:-2]
        self.above = np.cumsum(starts) - 1
        at = np.flatnonzero(starts)
        two = np.flatnonzero(self.paired[at])
        self.up_names, self.up_doc = self.run_names[at], of[at]
        self.up_names[two] = pair_names(self.run_names[at[two]], self.run_names[at[two] + 1], 2 * level + 2)

    def interior(self, a: np.ndarray, b: np.ndarray, signature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of windows of symbols a up to b: the symbols of the next level that are theirs wherever they occur; b <= a for none.

        Windows are not empty. What they pop is added to their signatures.
        """
        p, q = self.run[a], self.run[b - 1]
        whole = p == q
        if signature is not None:
            ends = np.where(whole, pair_names(self.names[a], (b - a).astype(np.uint64), WHOLE), pair_names(self.names[a], (self.first[p + 1] - a).astype(np.uint64), FIRST))
            signature = pair_names(signature, ends, 1)
            signature = np.where(whole, signature, pair_names(signature, pair_names(self.names[b - 1], (b - self.first[q]).astype(np.uint64), LAST), 2))
        before, after = self.paired[p] & (p + 1 < q), self.paired[q - 1] & (p < q)
        low, high = p + 1 + before, q - after
        if signature is not None:
            signature = np.where(before & ~whole, pair_names(signature, self.run_names[np.minimum(p + 1, len(self.run_names) - 1)], BEFORE), signature)
            signature = np.where(after & ~whole & (q - 1 >= low), pair_names(signature, self.run_names[np.maximum(q - 1, 0)], AFTER), signature)
        some = ~whole & (low < high)
        up = np.where(some, self.above[np.minimum(low, len(self.above) - 1)], 0)
        down = np.where(some, self.above[np.maximum(high - 1, 0)] + 1, 0)
        return up, down, signature


def least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where values[low:high] is smallest, the first such place, for each pair; no range is empty."""
    bits = np.uint64(max(20, int(len(values)).bit_length()))
    packed = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    most = int((high - low).max())
    tables = [packed]
    while 2 << (len(tables) - 1) <= most:
        t, step = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.append(np.minimum(t[:-step], t[step:]), t[-step:]) if step < len(t) else t)
    k = np.frexp((high - low).astype(np.float64))[1] - 1
    both = np.stack(tables)
    best = np.minimum(both[k, low], both[k, high - (1 << k.astype(np.int64))])
    return (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Windows:
    """All windows of a block of documents, by their place in the row of all words."""

    def __init__(self, texts: list[bytes | None], width: int):
        each = [names_of(words_of(t)) for t in texts]
        self.width, self.sizes = width, np.array([len(x) for x in each], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        names = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.valid = np.arange(len(names)) + width <= (self.first + self.sizes)[self.doc]
        self.at = np.flatnonzero(self.valid)
        self.levels = [Symbols(names, self.doc, 0)] if len(self.at) else []

    def _level(self, k: int) -> Symbols:
        while len(self.levels) <= k:
            below = self.levels[-1]
            self.levels.append(Symbols(below.up_names, below.up_doc, len(self.levels)))
        return self.levels[k]

    def signatures(self, at: np.ndarray) -> np.ndarray:
        """The names of the windows at these places: all that they pop, round after round, until nothing is left."""
        out = np.zeros(len(at), np.uint64)
        live, a, b, k = np.arange(len(at)), at, at + self.width, 0
        while len(live):
            a, b, out[live] = self._level(k).interior(a, b, out[live])
            some = a < b
            live, a, b, k = live[some], a[some], b[some], k + 1
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window in `at`: its anchor's name, and a number that tells this place of the anchor from others."""
        a, b, live = self.at, self.at + self.width, np.ones(len(self.at), bool)
        for k in range(LEVEL):
            up, down, _ = self._level(k).interior(np.where(live, a, 0), np.where(live, b, 1))
            live &= up < down
            a, b = np.where(live, up, 0), np.where(live, down, 0)
        chained = live & (b - a >= CHAIN)
        name, place = np.zeros(len(a), np.uint64), -1 - self.at
        names = self._level(LEVEL).names
        if chained.any():
            chains = mixed(span_names(names, CHAIN))
            place[chained] = least_of(chains, a[chained], b[chained] - (CHAIN - 1))
            name[chained] = chains[place[chained]]
        short = ~chained
        if short.any():  # of few symbols, as with long runs: by itself
            name[short] = self.signatures(self.at[short])
        return name, place

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor's name, the first window and the number of windows, of windows in a row at one place of an anchor."""
        if not len(self.at):
            return np.empty(0, np.uint64), self.at, self.at
        name, place = self.anchors()
        new = np.ones(len(name), bool)
        new[1:] = (self.at[1:] != self.at[:-1] + 1) | (place[1:] != place[:-1]) | (self.doc[self.at[1:]] != self.doc[self.at[:-1]])
        index = np.flatnonzero(new)
        return name[index], self.at[index], np.diff(np.append(index, len(name)))


def _blocks(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list, list[list]]]:
    """Ids and keys, texts and further columns of about BLOCK_WORDS words at a time."""
    for batch in batches:
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key")}
        texts = batch.column("text").cast(pa.binary())
        more = [batch.column(c) for c in extra]
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // (6 * BLOCK_WORDS)
        for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
            if len(cut):
                yield {c: x[cut] for c, x in own.items()}, texts.slice(cut[0], len(cut)).to_pylist(), [c.slice(cut[0], len(cut)).to_pylist() for c in more]


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


RUNS = "anchor long, key long, span long"


def _runs(width: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts, _ in _blocks(batches, []):
            w = Windows(texts, width)
            name, at, n = w.runs()
            if len(at):
                doc = w.doc[at]
                yield _rows(anchor=name.view(np.int64), key=own["key"][doc], span=((at - w.first[doc]) << COUNT_BITS) + n)

    return task


def _anchor_counts(width: int) -> Callable:
    """The anchors of a block of documents and their numbers of runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in _blocks(batches, []):
            name, count = np.unique(Windows(texts, width).runs()[0], return_counts=True)
            yield _rows(anchor=name.view(np.int64), n=count)

    return task


class Places:
    """Windows (signature, id, key, start) in order of signature and place."""

    def __init__(self, name: np.ndarray, id_: np.ndarray, key: np.ndarray, start: np.ndarray, *more: np.ndarray):
        order = np.lexsort((start, key, id_, name))
        self.name, self.id, self.key, self.start, *self.more = (x[order] for x in (name, id_, key, start, *more))
        first = np.ones(len(order), bool)
        first[1:] = self.name[1:] != self.name[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        #: The smallest place of its signature; the same place given again is one too.
        self.least = (self.id == self.id[head]) & (self.key == self.key[head]) & (self.start == self.start[head])
        self.once = first

    def taken(self, which: np.ndarray) -> list[np.ndarray]:
        return [x[which] for x in (self.name, self.id, self.key, self.start, *self.more)]


WINDOWS = "anchor long, part int, id long, key long, known boolean, starts binary, names binary"


def _suspects(width: int) -> Callable:
    """The signatures of windows whose anchor occurs twice. Of equal ones in a block of documents only the first needs a partner.

    Of windows under anchors that are dealt by signature, a task remembers the least place that it sent for each.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))]
        for own, texts, (runs,) in _blocks(batches, ["runs"]):
            has = [i for i, r in enumerate(runs) if r]
            if not has:
                continue
            w = Windows([texts[i] for i in has], width)
            if not len(w.at):
                continue
            spans = np.array([(w.first[k], r["span"], r["parts"], r["anchor"]) for k, i in enumerate(has) for r in runs[i]], np.int64)
            n = spans[:, 1] & ((1 << COUNT_BITS) - 1)
            of = np.repeat(np.arange(len(n)), n)
            at = spans[of, 0] + (spans[of, 1] >> COUNT_BITS) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            doc, parts = w.doc[at], spans[of, 2]
            name = w.signatures(at)
            part = np.where(parts > 1, mixed(name).astype(np.uint64) % parts.astype(np.uint64), 0).astype(np.int64)
            id_, key = own["id"][has][doc], own["key"][has][doc]
            places = Places(name, id_, key, at - w.first[doc], spans[of, 3], part, parts)
            known = ~places.least
            yield from _packed(*places.taken(known)[:6], True)
            fresh = places.least & places.once
            hot = fresh & (places.more[2] > 1)
            if hot.any():
                again = _earlier(seen, [x[hot] for x in (places.name, places.id, places.key, places.start)])
                at_hot = np.flatnonzero(hot)
                repeat = np.zeros(len(fresh), bool)
                repeat[at_hot[again]] = True
                yield from _packed(*places.taken(repeat)[:6], True)
                fresh &= ~repeat
                every = Places(*(np.concatenate(x) for x in zip(seen, [x[hot] for x in (places.name, places.id, places.key, places.start)])))
                seen = every.taken(every.once)
                if len(seen[0]) > REMEMBERED:
                    seen = [x[:0] for x in seen]
            yield from _packed(*places.taken(fresh)[:6], False)

    return task


def _earlier(seen: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Which rows, sorted by signature, have a smaller place of the same signature among those seen."""
    if not len(seen[0]):
        return np.zeros(len(rows[0]), bool)
    at = np.minimum(np.searchsorted(seen[0], rows[0]), len(seen[0]) - 1)
    name, id_, key, start = (x[at] for x in seen)
    less = (id_ < rows[1]) | (id_ == rows[1]) & ((key < rows[2]) | (key == rows[2]) & (start < rows[3]))
    return (name == rows[0]) & less


def _packed(name: np.ndarray, id_: np.ndarray, key: np.ndarray, start: np.ndarray, anchor: np.ndarray, part: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """One row for the windows of a document under one anchor; one a document for windows that are known to be repeats.

    starts: the first window's, then the steps from one to the next.
    """
    if not len(name):
        return
    if known:
        anchor, part = key, np.zeros(len(key), np.int64)  # dealt out by document
    order = np.lexsort((start, key, part, anchor))
    anchor, part, id_, key, start = anchor[order], part[order], id_[order], key[order], start[order].astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    again = np.flatnonzero(~new)
    start[again] -= start[again - 1]  # steps, mostly of 1, which compress well
    offsets = lambda width: pa.py_buffer(np.append(first, len(order)).astype(np.int32) * np.int32(width))
    binary = lambda x, width: pa.Array.from_buffers(pa.binary(), len(first), [None, offsets(width), pa.py_buffer(np.ascontiguousarray(x))])
    names = pa.nulls(len(first), pa.binary()) if known else binary(name[order], 8)
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor[first]), pa.array(part[first].astype(np.int32)), pa.array(id_[first]), pa.array(key[first]), pa.array(np.full(len(first), known)), binary(start, 4), names],
        names=["anchor", "part", "id", "key", "known", "starts", "names"],
    )


def _started(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The windows of rows of n[i] steps each."""
    total = np.cumsum(steps, dtype=np.int64)
    ends = np.cumsum(n)
    return total - np.repeat(np.append(0, total)[ends - n], n)


REPEATS = "key long, starts binary"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and part: the windows that occur at an earlier place too."""
    for table in grouped_tables(batches, "anchor", "part"):
        known = table.filter(table["known"])
        if known.num_rows:
            yield from known.select(["key", "starts"]).combine_chunks().to_batches()
        table = table.filter(pc.invert(table["known"])).combine_chunks()
        if table.num_rows < 2:
            continue
        starts, names = table["starts"].to_pylist(), table["names"].to_pylist()
        n = np.array([len(x) // 4 for x in starts])
        row = np.repeat(np.arange(len(n)), n)
        start = _started(np.frombuffer(b"".join(starts), np.int32), n)
        id_, key = table["id"].to_numpy()[row], table["key"].to_numpy()[row]
        places = Places(np.frombuffer(b"".join(names), np.uint64), id_, key, start)
        name, id_, key, start = places.taken(~places.least)
        for found in _packed(name, id_, key, start, key, key, True):
            yield found.select(["key", "starts"])


def _kept(width: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeats = batch.column("text").cast(pa.binary()), batch.column("repeats")
            kept, total, removed = [], [], []
            for text, lists in zip(texts, repeats):
                words, found = words_of(text.as_py()), lists.as_py()
                total.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(np.concatenate([np.cumsum(np.frombuffer(x, np.int32)) for x in found]))
                    edge[at] += 1
                    edge[at + width] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            more = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "repeats"]
            names = [f.name for f in batch.schema if f.name != "repeats"]
            yield pa.RecordBatch.from_arrays([*more, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "__n", "__removed", "__kept"])

    return task


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """The documents with n_words, n_removed and kept_text: each word covered by a repeated window is removed.

    A window is `width` (at least 20) consecutive words, runs of bytes other than 0x20 and 0x09 to 0x0D. It is
    repeated if the same words also start earlier: in a document with a smaller doc_id, or earlier in its own. All
    windows are judged on the input. kept_text joins the kept words by one space.

    A document is a doc_id with a text, known by a 64-bit hash of both. Documents that share a doc_id are in the order of these
    hashes. Rows that repeat both are the same place, and get the same result. A null or empty text has no words. A row without
    doc_id has no place in the order: it is returned whole and removes nothing. Columns of the input stay; those named
    n_words, n_removed or kept_text are replaced. An empty table gives an empty one.
    """
    if width < 20:
        raise ValueError("a window has 20 words or more")
    packed = with_rest(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col("text") if text == "text" else F.col(f"`{text}`").alias("text"), REST)
    placed = packed.where("id is not null").withColumn("key", F.xxhash64("id", "text"))
    texts = placed.select("id", "key", "text")
    # A table of its own, so that the join below is of two plain shuffles and adaptive execution can split a hot anchor.
    counts = checkpointed(texts.mapInArrow(trimmed(_anchor_counts(width)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    shared = counts.select("anchor", F.least(F.ceil(F.col("n") / GROUP_ROWS), F.lit(1 << 20)).cast("int").alias("parts"))
    runs = texts.mapInArrow(trimmed(_runs(width)), RUNS).join(shared, "anchor")
    by_doc = runs.groupBy("key").agg(F.collect_list(F.struct("span", "parts", "anchor")).alias("runs"))
    suspects = placed.join(by_doc, "key")  # with the columns of the last join, whose shuffle of the texts is the same one
    windows = suspects.mapInArrow(trimmed(_suspects(width)), WINDOWS)
    repeats = windows.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(trimmed(_repeats), REPEATS)
    gone = repeats.groupBy("key").agg(F.collect_list("starts").alias("repeats"))
    joined = placed.join(gone, "key", "left").unionByName(packed.where("id is null").withColumns({"key": F.lit(0).cast("long"), "repeats": F.lit(None).cast("array<binary>")}))
    schema = joined.drop("repeats").schema.add("__n", "long").add("__removed", "long").add("__kept", "string")
    out = joined.mapInArrow(_kept(width), schema)
    own = {doc_id: F.col("id"), text: F.col("text")}
    columns = [(own[c] if c in own else F.col(f"{REST}.`{c}`")).alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*columns, F.col("__n").alias("n_words"), F.col("__removed").alias("n_removed"), F.col("__kept").alias("kept_text"))
