"""Upload, restore, and six-phase synchronisation between two clouds.

A cloud is its files and recipes and two tables of chunks: chunk_meta (fp, size, container_id, offset, features) and
chunk_data (fp, data). Phases hand over fingerprints first, then features, and payloads only of what is missing; payloads are joined last.
"""

from __future__ import annotations

import dataclasses

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.codecs import compressed, decompressed
from chunkweave.functions.features import features
from chunkweave.functions.hashing import decrypt, encrypt
from chunkweave.operators import chunking, dedup, delta, segments, similarity, store
from chunkweave.params import SyncParams


@dataclasses.dataclass
class Cloud:
    """What a cloud holds. recipes: (file_id, pos, fp, size). files: (file_id, file_size, n_chunks), without bytes too."""

    recipes: DataFrame
    meta: DataFrame
    data: DataFrame
    files: DataFrame
    #: Near-exact modes may store a chunk more than once: all stored copies (fp, size, container_id, offset). None: those of meta.
    copies: DataFrame | None = None
    #: Extreme Binning's state: the fingerprints (fp) that each bin (min_fp) has seen.
    bins: DataFrame | None = None

    def stored(self) -> DataFrame:
        return self.meta.select("fp", "size", "container_id", "offset") if self.copies is None else self.copies

    def persisted(self) -> Cloud:
        """The same tables, each computed once; a cloud that lasts is written and read instead."""
        return Cloud(*(t if t is None else t.persist(StorageLevel.MEMORY_AND_DISK) for t in (getattr(self, f.name) for f in dataclasses.fields(self))))


def _placed(unique: DataFrame, name: str, params: SyncParams) -> DataFrame:
    """Addresses of new chunks (fp, file_id, pos, size). Files are dealt to lanes, and each lane fills containers of its own."""
    laned = unique.withColumn("lane", F.concat(F.lit(name), F.pmod(F.xxhash64("file_id"), F.lit(params.lanes)).cast("string")))
    placed = store.container_ids(store.packed(laned, "lane", ("file_id", "pos"), params.pack), "lane")
    return placed.select("fp", "size", "container_id", F.col("container_offset").alias("offset"))


#: Which chunks of an upload are stored: by an index of all fingerprints, outside or inside (0, 1), by Extreme Binning (2), by Sparse
#: Indexing (3), or by the frequency index (4), which stores what the full index does.
MODES = ("out_enclave", "in_enclave", "extreme_binning", "sparse", "frequency")


def upload(files: DataFrame, params: SyncParams, kind: str = "sha256", name: str = "up", into: Cloud | None = None, mode: int = 0) -> Cloud:
    """Chunks, fingerprints, dedup by the mode, features, packing. name: what the containers' ids start with.

    into: a cloud that the files are added to; what it holds is not stored again, and its tables are part of the result. A file
    id that it has already is an error when files are read. Uploads into one cloud need names of their own. Mode 3 keeps its
    index in the tasks that go through a stream (`source`), so it can't go on from a cloud.
    """
    chunks = chunking.fingerprinted(chunking.chunk(files, params.chunks), kind)
    recipes = chunks.select("file_id", "pos", "fp", "size")
    new, bins = recipes, None
    if MODES[mode] == "extreme_binning":
        binned = segments.binned(chunking.segment(recipes, params.segments))
        if into is not None and into.bins is not None:
            seen = binned.join(into.bins, ["min_fp", "fp"], "left_anti")
            bins = binned.select("min_fp", "fp").unionByName(into.bins).distinct()
        else:
            seen, bins = binned, binned.select("min_fp", "fp").distinct()
        new = dedup.first_occurrence(seen, ("file_id", "segment", "pos"), ("min_fp",)).where("is_first = 1").select("file_id", "pos", "fp", "size")
    elif MODES[mode] == "sparse":
        if into is not None:
            raise ValueError("mode 3 can't go on from a cloud")
        laned = chunks.select("source", "file_id", "pos", "fp", "size")
        new = segments.sparse_indexing(chunking.segment(laned, params.segments), "source", params.sparse).where("is_unique = 1").select("file_id", "pos", "fp", "size")
    elif into is not None:
        new = dedup.missing(recipes, into.meta)
    near = MODES[mode] in ("extreme_binning", "sparse")
    if near:
        copies = _placed(new, name, params)
        first = copies.groupBy("fp").agg(F.min(F.struct("container_id", "offset", "size")).alias("v")).select("fp", "v.size", "v.container_id", "v.offset")
        if into is not None:
            first = first.join(into.meta.select("fp"), "fp", "left_anti")
            copies = copies.unionByName(into.stored())
        held = recipes.join(first.select("fp"), "fp", "left_semi")
        unique = held.groupBy("fp").agg(F.min(F.struct("file_id", "pos")).alias("v")).select("fp", "v.*")
    else:
        copies = None
        unique = new.groupBy("fp").agg(F.min(F.struct("file_id", "pos", "size")).alias("v")).select("fp", "v.*")
        first = _placed(unique, name, params)
    data = unique.select("fp", "file_id", "pos").join(chunks.select("file_id", "pos", "data"), ["file_id", "pos"]).select("fp", "data")
    meta = first.join(data.select("fp", features(F.col("data")).alias("features")), "fp")
    heads = store.file_heads(files, recipes)
    if into is None:
        return Cloud(recipes, meta, data, heads, copies, bins)
    return Cloud(into.recipes.unionByName(recipes), into.meta.unionByName(meta), into.data.unionByName(data), into.files.unionByName(heads), copies, bins)


def totals(cloud: Cloud, codec: str = "zstd") -> DataFrame:
    """Logical, stored and compressed bytes and chunks of a cloud, one row; each stored copy is compressed by itself."""
    logical = cloud.recipes.agg(F.count(F.lit(1)).alias("logical_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("logical_bytes"))
    packed = cloud.data.select("fp", F.octet_length(compressed(F.col("data"), codec)["bytes"]).alias("packed"))
    stored = cloud.stored().join(packed, "fp").agg(F.count(F.lit(1)).alias("stored_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("stored_bytes"), F.coalesce(F.sum("packed"), F.lit(0)).cast("long").alias("compressed_bytes"))
    return logical.crossJoin(stored)  # one row each


def sealed(data: DataFrame, codec: str = "zstd", key: Column | None = None, cipher: str = "GCM") -> DataFrame:
    """(fp, codec, bytes) of chunks (fp, data) as they are stored: compressed, and encrypted if there is a key."""
    packed = data.select("fp", compressed(F.col("data"), codec).alias("v")).select("fp", "v.codec", "v.bytes")
    return packed if key is None else packed.withColumn("bytes", encrypt(F.col("bytes"), key, cipher))


def opened(stored: DataFrame, key: Column | None = None, cipher: str = "GCM") -> DataFrame:
    """(fp, data) of what sealed() made."""
    packed = stored if key is None else stored.withColumn("bytes", decrypt(F.col("bytes"), key, cipher))
    return packed.select("fp", decompressed(F.col("codec"), F.col("bytes")).alias("data"))


def restore(cloud: Cloud) -> DataFrame:
    """(file_id, content, n_chunks) of all files."""
    recipe = store.recipes(cloud.recipes, cloud.meta.withColumnRenamed("size", "length"))
    chunks = cloud.meta.select("fp", "container_id", "offset").join(cloud.data, "fp")
    return store.restored(recipe, chunks, cloud.files)


@dataclasses.dataclass
class Sync:
    """What the phases hand over, and the target cloud after them."""

    requested: DataFrame  # 1: all fingerprints of the source's recipes
    missing: DataFrame  # 2: those that the target lacks, once each
    featured: DataFrame  # 3: with features
    tagged: DataFrame  # 4: with a base that the target has or is to get
    payload: DataFrame  # 5: encoded chunks
    target: Cloud  # 6: decoded, verified and packed


def synchronise(source: Cloud, target: Cloud, params: SyncParams, kind: str = "sha256") -> Sync:
    requested = source.recipes.select("file_id", "pos", "fp", "size")
    lacking = dedup.missing(requested, target.meta)
    missing = lacking.groupBy("fp").agg(F.min(F.struct("file_id", "pos")).alias("at"), F.max("size").alias("size")).select("fp", "at.file_id", "at.pos", "size")
    featured = missing.join(source.meta.select("fp", "features"), "fp")
    tagged = similarity.tagged(featured, similarity.feature_index(target.meta, "offset"), "file_id", ("pos", "fp"), params.batch)
    payload = delta.encoded(tagged, source.data, params.codec).persist(StorageLevel.MEMORY_AND_DISK)  # what is sent is made once
    got = delta.decoded(payload, target.data)
    wrong = F.raise_error(F.concat(F.lit("decoded chunk differs: "), F.col("fp")))
    data = got.withColumn("__fp", chunking.fingerprint(F.col("data"), kind)).select(F.when(F.col("__fp") == F.col("fp"), F.col("fp")).otherwise(wrong).alias("fp"), "data")
    meta = _placed(missing, "sync", params).join(data.select("fp", features(F.col("data")).alias("features")), "fp")
    recipes = target.recipes.unionByName(source.recipes)
    return Sync(requested, missing, featured, tagged, payload, Cloud(recipes, target.meta.unionByName(meta), target.data.unionByName(data), target.files.unionByName(source.files)))


def traffic(sync: Sync) -> DataFrame:
    """(phase, rows, bytes) that each phase sends."""
    count = F.count(F.lit(1)).alias("rows")
    sent = [
        sync.requested.agg(count).select(F.lit(1).alias("phase"), "rows", store.message_bytes("rows", "fp").alias("bytes")),
        sync.missing.agg(count).select(F.lit(2).alias("phase"), "rows", store.message_bytes("rows", "fp").alias("bytes")),
        sync.featured.agg(count).select(F.lit(3).alias("phase"), "rows", store.message_bytes("rows", "feature").alias("bytes")),
        sync.tagged.agg(count).select(F.lit(4).alias("phase"), "rows", (store.message_bytes("rows", "fp") * 2 + F.col("rows") * 4).alias("bytes")),
        sync.payload.agg(count, F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count("base_fp").alias("b")).select(F.lit(5).alias("phase"), "rows", (F.col("s") + F.col("rows") * 8 + F.col("b") * 32).alias("bytes")),
    ]
    out = sent[0]
    for more in sent[1:]:
        out = out.unionByName(more)
    return out


def statistics(sync: Sync) -> DataFrame:
    """(metric, value): chunks and bytes by tag and payload kind, those that were there, and bytes received and written."""
    tags = sync.tagged.groupBy(F.concat(F.lit("tag:"), F.col("tag")).alias("metric")).agg(F.count(F.lit(1)).cast("long").alias("value"))
    kinds = sync.payload.groupBy(F.concat(F.lit("bytes:"), F.col("kind")).alias("metric")).agg(F.sum("size").cast("long").alias("value"))
    total = sync.requested.agg(F.count(F.lit(1)).cast("long").alias("value")).select(F.lit("requested").alias("metric"), "value")
    gone = sync.missing.agg(F.count(F.lit(1)).cast("long").alias("value")).select(F.lit("missing").alias("metric"), "value")
    there = sync.requested.select("fp").distinct().join(sync.missing.select("fp"), "fp", "left_anti").agg(F.count(F.lit(1)).cast("long").alias("value")).select(F.lit("present").alias("metric"), "value")
    sums = sync.payload.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("value")).select(F.lit("received_bytes").alias("metric"), "value")
    written = sync.missing.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("value")).select(F.lit("written_bytes").alias("metric"), "value")
    similar = sync.tagged.groupBy(F.concat(F.lit("plain_bytes:"), F.col("tag")).alias("metric")).agg(F.sum("size").cast("long").alias("value"))
    out = tags
    for more in (kinds, total, gone, there, sums, written, similar):
        out = out.unionByName(more)
    return out
