"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.frames import REST, checkpointed, even_bits, running, with_rest

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "finish")
#: A source's key: its name after a sign, and this for none.
NO_SOURCE = ""


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Adds to each row (source, source_size) its weight and its target, a part of `share` of all sizes.

    Sources by code point, null last, take the weights in turn. No target is over `epochs` times its source: the
    excess goes to the others by weight, until none is above. Sources fill up in the order of size over weight, so the
    level at which the rest is shared is found in one pass over the sources.
    """
    place = Window.orderBy(F.col("source") == NO_SOURCE, "source")
    every, filled = Window.partitionBy(), Window.orderBy("full", "place")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", weight)
    t = t.withColumn("most", F.col("source_size") * epochs).withColumn("full", F.col("most").cast("double") / F.col("weight"))
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after))
    t = t.withColumn("level", F.min_by(F.when(F.col("full") > F.col("level"), F.col("level")), F.when(F.col("full") > F.col("level"), F.struct("full", "place"))).over(every))
    t = t.withColumn("target", F.when(F.col("full") > F.col("level"), F.col("level") * F.col("weight")).otherwise(F.col("most").cast("double")))
    return t.select("source", "source_size", "weight", "target", "budget")


def _finish(epoch: Column) -> Column:
    """The virtual time at which a document's copy is served: its source's words up to its end, over the weight."""
    return (epoch * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, epochs: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", slices: int = 1024) -> DataFrame:
    """The documents with size, source_size, target, taken and finish.

    Each source is a queue of its documents in shuffled order, over again for up to `epochs` times. A copy's virtual
    finish time is its source's cumulative words divided by the weight. All copies, sorted globally by finish time,
    are taken until the next would pass the budget, `share` of all words. taken: the words that the mix takes of
    the document, repeats counted; finish: when each copy that it takes is served.

    A null text has no words; a document without words is in the mix as often as its place in the queue says, and
    takes none. A null source is a source. The shuffle depends on doc_id and seed alone: ties go by doc_id, then size.
    Rows that repeat a doc_id are documents of their own. Columns of the input stay, those named as the new ones are
    replaced. An empty table gives an empty one.
    """
    even = even_bits(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), f":{seed}")
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    packed = with_rest(docs.withColumns({"__even": even, "__size": size, "__id": F.col(f"`{doc_id}`").cast("long"), "__source": F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(NO_SOURCE))}), "__even", "__size", "__id", "__source")
    packed = packed.select(F.col("__even").alias("even"), F.col("__size").alias("size"), F.col("__id").alias("id"), F.col("__source").alias("source"), REST)
    sized = checkpointed(packed.drop(REST))  # the texts are read once for it, and once for the result
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    order = ["even", "id", "size"]
    cut = _cut(running(sized, "source", order, F.col("size"), "before", slices, sources), epochs)
    queued = running(packed, "source", order, F.col("size"), "before", slices, sources, summed=sized)
    served = F.array(*[F.struct(_finish(F.lit(e)), F.col("even"), F.coalesce("id", F.lit(-(2**63))), F.col("size"), F.lit(e)) for e in range(epochs)])
    last = F.struct(*[F.lit(x).cast(t) for x, t in zip(cut or (None, 0, 0, 0, 0), ("double", "long", "long", "long", "int"))])
    times = F.transform(F.filter(served, lambda s: s <= last), lambda s: s["col1"])
    mixed = queued.withColumn("finish", times)
    columns = [F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return mixed.select(*columns, "size", "source_size", "target", (F.col("size") * F.size("finish")).alias("taken"), "finish")


def _cut(queued: DataFrame, epochs: int) -> tuple | None:
    """The sort key of the last copy that the budget takes; None if it takes none.

    The copies are sorted by ranges; each range's sum, a row a range, gives the words before it.
    """
    copies = queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    key = ["finish", "even", "id", "size", "epoch"]
    ranged = copies.withColumn("finish", _finish(F.col("epoch"))).select(*key, "budget").repartitionByRange(*key).withColumn("range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum("size").alias("sum")).select(F.col("range").alias("of"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    served = ranged.withColumn("inside", F.sum("size").over(inside)).join(offsets, F.col("range") == F.col("of"))
    last = served.where(F.col("offset") + F.col("inside") <= F.col("budget")).agg(F.max(F.struct(*key)).alias("last")).first()["last"]
    return tuple(last) if last is not None else None


def mixture(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The copies that the mix takes of documents with words, sorted by when they are served; columns of the input only."""
    copies = mixed.where("size > 0").withColumn("finish", F.explode("finish"))
    return copies.orderBy("finish", doc_id).drop(*ADDED)
