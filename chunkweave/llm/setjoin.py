"""Exact Jaccard self-join of n-gram sets with set-relation skipping.

Dealing out. Two sets of a and b >= a members link only if they differ in at most floor(a / 9) members at 0.9 (the
general bound is below). Members are hashed into one part more than that, so linked sets agree on a whole part.
Each set sends one key a part (a hash of the members in it) and only sets that share a key can link. At 0.9 a key covers
eight members or so, so a common word, line or passage is no key and makes no long list. At lower similarities it
covers fewer; then members that many sets have are counted first and left out of the keys. Sets that share keys are
put into families by connected components, and only families get their texts.

A key of few members is shared by chance too, the more often the more sets there are, and long sets would all become one family. So
sets that share a key with FEW others at most are paired with each, and a pair counts only if the sets' sketches allow it to link:
members are counted in buckets of a hash, and two sets differ in as many members at least as their counts do. A key that more sets have
joins them all.

A large family is cut into bands of sizes, each of which links with the bands beside it only, and bands into blocks of text.

Joining. In a family, inverted lists over the members, rarest first, are grouped into blocks by the member's
position in its set; a probe skips a block if its position, or all sizes in it, rule out a link, and skips what is
left of a list from the first set that is too small (index-level skipping). If no candidate is left, the set has no
partners among the sets before it. Otherwise its overlaps with all sets are derived from the overlaps already
computed for the most similar earlier set, by the members in which the two differ (answer-level skipping), or by a
scan of the lists if there is none. Both give exact overlaps.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.components import components
from chunkweave.llm.frames import batches_by_weight, checkpointed, grouped_tables, released, trimmed
from chunkweave.llm.words import HALF, mixed, names_of, pair_names, span_names, words_of

#: Bytes of text that a task hashes at a time, and that meet in one task as a block of a family.
SLICE_BYTES, BLOCK_BYTES = 2_000_000, 3_000_000
#: Bytes of text whose shingles are counted together.
COUNT_BYTES = 8_000_000
RESCUES = 3
#: Sets with a key that are compared in pairs, buckets of a sketch at least, and members a bucket at most in larger ones.
FEW, BUCKETS, FILLED = 4, 16, 8
#: The keys are shuffled in so many turns, each of which frees its disk.
TURNS = 2
#: Sets that have a member which is never common.
SELDOM = 100
#: More than the blocks of a band of sizes.
BANDED = 1 << 20
#: Sets of a family whose overlaps with all others are at hand at a time.
KEPT = 64
LOW = np.uint64(0xFFFFFFFF)


class Measure:
    """Jaccard similarity of at least num/den, in whole numbers: den * |A and B| >= num * |A or B|."""

    def __init__(self, num: int = 90, den: int = 100):
        if not 0 < num <= den or 2 * num <= den:
            raise ValueError("the similarity must be over 0.5 and at most 1")
        self.num, self.den = num, den
        #: Sizes are in bands of this width, as a logarithm; a little over the ratio of the sizes of sets that link.
        self.band = max(1e-3, math.log(den / num)) * 1.001

    def differ(self, a, b):
        """The most members in which linked sets of a and b members can differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, a):
        """Of a set that can link with one of a members."""
        return a * self.den // self.num

    def classes(self, most: int) -> list[tuple[int, int]]:
        """(end, parts) of classes of sizes, up to the size `most`. Sizes below 1 / (1 - similarity) link equals only."""
        ends, end = [], 1
        while self.largest(end) == end:
            end += 1
        while True:
            worst = parts = self.differ(end - 1, self.largest(end - 1))
            for _ in range(8 if worst else 0):  # more parts than differ and are likely to be empty
                empty = parts * math.exp(-0.8 * (ends[-1][0] if ends else 1) / parts)
                parts = worst + 2 + math.ceil(empty + 4 * math.sqrt(empty))
            ends.append((end, max(parts, 1)))
            if end > most:
                return ends
            end = max(end + 1, end * 27 // 20, self.largest(end - 1) + 1)


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The distinct n-grams of words, as sorted 64-bit names; the whole sequence as one if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        name = names_of([b" ".join(words)])
        return mixed(name + np.uint64(len(words)))
    return np.unique(span_names(names_of(words), n))


def part_keys(members: np.ndarray, measure: Measure, classes: list[tuple[int, int]], common: np.ndarray | None = None) -> np.ndarray:
    """The keys of a set: one for each part, in its own class and in the class below if it can link into that.

    Common members, given sorted, are left out of the parts at first: linked sets differ in no more of the others. If as
    many parts are empty as a linked set may share, the set sends keys of another deal of all its members as well; a linked
    set that shares empty parts only has as many, so it does the same. At last empty parts are keys themselves.
    """
    size, found = len(members), []
    if not size:
        return np.empty(0, np.uint64)
    own, every = next(i for i, (end, _) in enumerate(classes) if size < end), members
    if common is not None and len(common):
        members = members[common[np.minimum(np.searchsorted(common, members), len(common) - 1)] != members]
    deals = [members, *[every] * RESCUES]
    for c in {own, own - 1}:
        if c >= 0 and (c == own or size <= measure.largest(classes[c][0] - 1)):
            end, parts = classes[c]
            worst = measure.differ(end - 1, measure.largest(end - 1))
            for again, members in enumerate(deals):
                marks = mixed(members)
                part = (mixed(members ^ np.uint64(1000 + again)) % np.uint64(parts)).astype(np.int64)
                has = np.flatnonzero(np.bincount(part, minlength=parts))
                low, high = (np.bincount(part, weights=x.astype(np.float64), minlength=parts)[has].astype(np.uint64) for x in (marks & LOW, marks >> HALF))
                where = np.uint64(c * (RESCUES + 1) + again)
                found.append(pair_names(pair_names(low, high + (has.astype(np.uint64) << np.uint64(44)), 11), np.full(len(has), where), 12))
                if parts - len(has) < parts - worst:  # not all parts that are alike in a linked set can be empty
                    break
            else:
                none = np.setdiff1d(np.arange(parts), has).astype(np.uint64)
                found.append(pair_names(none, np.full(len(none), where), 13))
    return np.concatenate(found)


def sketch(members: np.ndarray) -> bytes:
    """Members counted in buckets of a hash, a byte each; as many buckets as the next power of two."""
    buckets = max(BUCKETS, 1 << (max(len(members), 1) // FILLED).bit_length())
    place = (mixed(members ^ np.uint64(77)) & np.uint64(buckets - 1)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=buckets), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many members sets with these sketches differ at least. The buckets of the larger sketch are added up to those of the other."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s, np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int64) for s in (a, b))
    return int(np.abs(x - y).sum())


def _possible(measure: Measure) -> Callable:
    """The pairs that sizes and sketches allow to link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
            fits = np.flatnonzero(np.maximum(n, m) <= measure.largest(np.minimum(n, m)))
            most, a, b = measure.differ(n, m), batch.column("sketch"), batch.column("sketch2")
            found = [i for i in fits.tolist() if least_difference(a[i].as_py(), b[i].as_py()) <= most[i]]
            yield batch.select(["id", "least"]).take(pa.array(found, pa.int64()))

    return task


SETS = "id long, n long, first_id long, keys array<long>, near array<long>, bytes long, sketch binary"


def _counted(n: int) -> Callable:
    """Members that several sets of a slice have, and how many; equal sets of a task count once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in batches_by_weight(whole, "text", COUNT_BYTES)):
            sets = []
            for text in batch.column("text").cast(pa.binary()):
                members = shingles(words_of((text.as_py() or b"").lower()), n)
                mark = _mark(members)
                if mark not in seen:
                    seen.add(mark)
                    sets.append(members)
            member, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            often = count >= max(2, len(sets) // 2000)
            yield pa.RecordBatch.from_arrays([pa.array(member[often].view(np.int64)), pa.array(count[often])], names=["member", "n"])

    return task


def _mark(members: np.ndarray) -> bytes:
    return members.sum().tobytes() + np.bitwise_xor.reduce(mixed(members)).tobytes() if len(members) else b""


def common_members(texts: DataFrame, n: int, share: float = 0.0005, most: int = 65_536) -> np.ndarray:
    """Sorted members that more than a share of the sets have, or more than SELDOM, the `most` most frequent of them.

    Which members these are changes the order of the work, never the result.
    """
    counted = texts.select("text").mapInArrow(trimmed(_counted(n)), "member long, n long").groupBy("member").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= min(max(8, int(share * texts.count())), SELDOM)).orderBy(F.desc("n"), "member").limit(most).select("member").toArrow()
    return np.sort(rows["member"].to_numpy().astype(np.int64).view(np.uint64))


def _sets(n: int, measure: Measure, common: np.ndarray | None = None) -> Callable:
    """Per document its set's size, keys and sketch. Of equal sets in one task, the later ones name the first instead.

    Of a key that more than FEW sets of a slice have, only the first sends it, so often that it counts as a key of more than FEW; the others
    name the first as near.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        classes = measure.classes(1000)
        for whole in batches:
            for batch in batches_by_weight(whole, "text", SLICE_BYTES):
                ids, sizes, first, keys, lengths, sketches = batch.column("id").to_pylist(), [], [], [], [], []
                for i, text in zip(ids, batch.column("text").cast(pa.binary())):
                    raw = (text.as_py() or b"").lower()
                    members = shingles(words_of(raw), n)
                    sizes.append(len(members))
                    lengths.append(len(raw))
                    mark = _mark(members)
                    first.append(seen.setdefault(mark, i) if mark and i is not None else i)
                    if len(members) >= classes[-1][0]:
                        classes = measure.classes(2 * len(members))
                    keys.append(part_keys(members, measure, classes, common).view(np.int64) if mark and i is not None and first[-1] == i else np.empty(0, np.int64))
                    sketches.append(sketch(members) if len(keys[-1]) else None)
                every, own = np.concatenate([np.empty(0, np.int64), *keys]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                _, at, inverse, shared = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
                hot, head = shared[inverse] > FEW, at[inverse] == np.arange(len(every))
                times = np.where(hot, np.where(head, FEW + 1, 0), 1)
                pairs = np.unique(np.stack([own, own[at][inverse]], axis=1)[hot & ~head], axis=0)
                known = np.array([-1 if i is None else i for i in ids], np.int64)
                lists = _lists(np.repeat(every, times), np.repeat(own, times), len(ids))
                near = _lists(known[pairs[:, 1]], pairs[:, 0], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), lists, near, pa.array(lengths, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "n", "first_id", "keys", "near", "bytes", "sketch"])

    return task


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """Values, sorted by row, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


class Family:
    """The sets of a family in order of size, and their exact overlaps."""

    def __init__(self, sets: list[np.ndarray], measure: Measure):
        self.measure, self.sizes = measure, np.array([len(s) for s in sets], np.int64)
        _, rank, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        by_df = np.argsort(df, kind="stable")
        place = np.empty(len(by_df), np.int64)
        place[by_df] = np.arange(len(by_df))
        rank, self.df = place[rank.ravel()], df[by_df]
        ends = np.cumsum(self.sizes)
        self.sets = [np.sort(rank[e - n : e]) for e, n in zip(ends, self.sizes)]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.owner = owner[np.argsort(rank, kind="stable")]
        self.ends = np.cumsum(self.df)

    def listed(self, members: np.ndarray) -> np.ndarray:
        """The sets in the inverted lists of these members, one after the other."""
        if not len(members):
            return np.empty(0, np.int64)
        ends, n = self.ends[members], self.df[members]
        return self.owner[np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())]

    def overlaps(self, members: np.ndarray) -> np.ndarray:
        return np.bincount(self.listed(members), minlength=len(self.sets))

    def answers(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each set that has any: the earlier sets that it links with."""
        blocks: dict[int, dict[int, list[int]]] = defaultdict(dict)  # member, its position: the sets, smallest first
        known: dict[int, np.ndarray] = {}
        sizes = self.sizes.tolist()

        def keep(y: int, overlap: np.ndarray) -> None:
            if len(known) >= KEPT:
                known.pop(next(iter(known)))
            known[y] = overlap

        for x, members in enumerate(self.sets):
            size = sizes[x]
            fewest = -(-size * self.measure.num // self.measure.den)
            prefix = members[: self.measure.differ(size, size) + 1].tolist()
            shared: dict[int, int] = defaultdict(int)
            for i, member in enumerate(prefix):
                for j, block in blocks[member].items() if member in blocks else ():
                    if i + j > self.measure.differ(size, sizes[block[-1]]) or sizes[block[-1]] < fewest:
                        continue
                    for y in block[bisect_left(block, fewest, key=sizes.__getitem__) :]:
                        shared[y] += 1
            if shared:
                near = max((y for y in shared if y in known), key=shared.__getitem__, default=None)
                if near is None:
                    near = max(shared, key=shared.__getitem__)
                    keep(near, self.overlaps(self.sets[near]))
                here, there = np.setdiff1d(members, self.sets[near], assume_unique=True), np.setdiff1d(self.sets[near], members, assume_unique=True)
                if len(here) + len(there) < size // 2:
                    overlap = known[near] + self.overlaps(here) - self.overlaps(there)
                else:
                    overlap = self.overlaps(members)
                    keep(x, overlap)
                overlap, both = overlap[:x], size + self.sizes[:x]
                linked = np.flatnonzero(self.measure.den * overlap >= self.measure.num * (both - overlap))
                if len(linked):
                    yield x, linked
            for i, member in enumerate(prefix):
                if self.df[member] > 1:
                    blocks[member].setdefault(i, []).append(x)


def _edges(keyed: DataFrame, measure: Measure) -> DataFrame:
    """Rows (id, least) of which the connected components hold all linked sets: pairs that share a key and may link, and all sets of a key of more than FEW."""
    listed = keyed.where("id = first_id").select("id", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key").orderBy("id")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = F.when(F.col("k") > FEW, F.array(F.min("id").over(whole))).otherwise(F.array_compact(F.array(*[F.lead("id", i).over(by_key) for i in range(1, FEW)])))
    turns = []
    for turn in range(TURNS):
        shared = listed.where(F.pmod("key", F.lit(TURNS)) == turn).withColumn("k", F.count(F.lit(1)).over(whole)).withColumn("others", others).where("k > 1")
        pairs = shared.select("id", F.explode("others").alias("least"), (F.col("k") > FEW).alias("many")).where("id != least")
        turns.append(checkpointed(pairs.groupBy("id", "least").agg(F.max("many").alias("many"))))
    pairs = functools.reduce(DataFrame.unionByName, turns).groupBy("id", "least").agg(F.max("many").alias("many"))
    pairs = checkpointed(pairs)
    marks = keyed.where("id = first_id and sketch is not null").select("id", "n", "sketch")
    both = pairs.where("not many").join(marks, "id").join(marks.select(F.col("id").alias("least"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "least")
    possible = both.mapInArrow(trimmed(_possible(measure)), "id long, least long")
    near = keyed.select("id", F.explode("near").alias("least"))
    edges = checkpointed(possible.unionByName(pairs.where("many").select("id", "least")).unionByName(near))
    for done in (*turns, pairs):
        released(done)
    return edges


LINKS = "id long, root long, links long"


def _joined(n: int, measure: Measure) -> Callable:
    """Of rows sorted by family and pair of blocks: each document's smallest partner in the block and its number of links."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_tables(batches, "family", "low", "high"):
            table = table.combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in ("family", "low", "high")])
            cut = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), table.num_rows)
            ids, own, texts = table["id"].to_numpy(), table["block"].to_numpy(), table["text"].combine_chunks().cast(pa.binary())
            weights = table["copies"].to_numpy()
            out: list[tuple] = []
            for a, b in zip(cut[:-1], cut[1:]):
                out += _family(ids[a:b], own[a:b], weights[a:b], [shingles(words_of(t.lower()), n) for t in texts.slice(a, b - a).to_pylist()], measure, keys[1, a] != keys[2, a])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "root", "links"])

    return task


def _family(ids, own, weights, sets, measure, across) -> list[tuple]:
    once = {(i, s.tobytes()): k for k, (i, s) in enumerate(zip(ids.tolist(), sets))}
    order = sorted(once.values(), key=lambda k: (len(sets[k]), ids[k]))
    ids, own, weights, sets = ids[order], own[order], weights[order], [sets[k] for k in order]
    links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, linked in Family(sets, measure).answers():
        if across:
            linked = linked[own[linked] != own[x]]
        links[x] += weights[linked].sum()
        links[linked] += weights[x]
        for y in linked.tolist():
            a, b = top(x), top(y)
            if a != b:
                root[a] = b
    least: dict[int, int] = {}
    for k, i in enumerate(ids.tolist()):
        least[top(k)] = min(i, least.get(top(k), i))
    return [(i, least[top(k)], n) for k, (i, n) in enumerate(zip(ids.tolist(), links.tolist())) if n]


def set_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row a document: doc_id, n_shingles, n_links, component_id, by exact Jaccard similarity of at least num/den.

    A document's set: the distinct n-grams of its words, A-Z lower-cased; with fewer words, all of them as one. n_links
    counts the other rows linked directly, component_id is the smallest doc_id reachable by links. Documents without
    words link with nothing. A null text has no words. A row without doc_id has no links and a null component. Rows
    that repeat a doc_id with its text count as linked copies; with other texts they share one component, and n_links
    counts the partners of all of them. Other columns play no part. An empty table gives an empty one.

    A family of copies may hold any share of the rows: it is cut into blocks of about BLOCK_BYTES and like sizes, and each pair of
    blocks that can hold links is a group of its own. Equal sets are joined once for each task that read some, and counted by their number.
    """
    measure = Measure(num, den)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    common = common_members(texts, n) if 10 * num < 9 * den else None  # parts are small then, and passages would match
    keyed = checkpointed(texts.mapInArrow(trimmed(_sets(n, measure, common)), SETS))
    sets = checkpointed(keyed.select("id", "n", "first_id", "bytes"))
    edges = _edges(keyed, measure)
    families = components(edges, "id", "least")
    released(keyed)
    released(edges)
    classes = sets.where("n > 0").groupBy("first_id").agg(F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"), F.max("n").alias("n"))
    members = families.join(classes, F.col("node") == F.col("first_id")).select(F.col("component").alias("family"), F.col("node").alias("id"), "copies", "bytes", F.floor(F.log("n") / F.lit(measure.band)).cast("int").alias("band"))
    members = checkpointed(members)  # a table of its own, so that adaptive execution can split a hot family below
    large = members.groupBy("family").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).select("family")
    blocks = members.join(large, "family").groupBy("family", "band").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    large = checkpointed(blocks.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("of_band")))  # some hundred bands at most
    # Sets of a band link with those of the bands beside it at most; a block is a band's number and one in it.
    split = members.join(large, "family", "left").withColumn("block", F.when(F.col("of_band").isNull(), 0).otherwise(F.col("band") * BANDED + F.pmod(F.xxhash64("id"), F.try_element_at("of_band", "band"))).cast("long"))
    near = F.expr(f"flatten(transform(filter(array(band - 1, band, band + 1), b -> try_element_at(of_band, b) is not null), b -> transform(sequence(0, try_element_at(of_band, b) - 1), i -> bigint(b) * {BANDED} + i)))")
    dealt = split.withColumn("other", F.explode(F.when(F.col("of_band").isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)))
    dealt = dealt.select("id", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "copies")
    keys = ["family", "low", "high"]
    grouped = texts.where("text is not null").join(dealt, "id").select(*keys, "block", "id", "copies", "text").repartition(*keys).sortWithinPartitions(*keys)
    found = checkpointed(grouped.mapInArrow(trimmed(_joined(n, measure)), LINKS))
    same = sets.where("id != first_id").select("id", F.col("first_id").alias("root"))
    component = components(found.select("id", "root").unionByName(same), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_first = classes.join(links, F.col("first_id") == F.col("id"), "left").select(F.col("first_id").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    counted = sets.select("id", "n", "first_id").join(of_first, F.col("first_id") == F.col("class"), "left")
    return counted.join(component, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
