"""The named queries of the library and their SQL.

Text documents stand for files, even doc_id for those of the source cloud and odd ones for the target's. Chunks are 256
bytes; the content-defined ones 256, 512 and 1024, as documents are small.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.codecs import compressed
from chunkweave.functions.features import features
from chunkweave.functions.hashing import byte_sum, hmac_sha3, is_hook, murmur3, token, xxh64
from chunkweave.functions.scalars import div_ceil, ordinal_id, ratio, sampled_ratio
from chunkweave.operators import chunking, dedup, segments, similarity, sketch, store
from chunkweave.params import ChunkParams, FrequencyParams, PackParams, SegmentParams, SparseParams, SyncParams
from chunkweave.plans import sync
from chunkweave.sources.files import files_of, parse_trace, spread, synthetic, trace_payload, transfer_totals
from chunkweave.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SIZE = 256
CDC = ChunkParams(min=256, avg=512, max=1024)
SEGMENT_CHUNKS = 16
PACK = PackParams(container_bytes=16_384, meta_bytes=56 * 40)
SKETCH = FrequencyParams(width=4096, top=64)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return files_of(spread(table(spark, sf_dir, "documents")), *keep)


def chunks(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Metadata of all chunks: payloads end at the fingerprint."""
    return chunking.fingerprinted(chunking.fixed_chunks(files(spark, sf_dir, *keep), SIZE)).select("file_id", "source", *keep, "pos", "offset", "size", "fp")


def two_clouds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("file_id % 2 = 0"), rows.where("file_id % 2 != 0")


FILES = "f AS (SELECT doc_id AS file_id, source, lang, encode(coalesce(text, '')) AS content, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"
CHUNKS = f"""{FILES}, p AS (SELECT *, unnest(range((n + {SIZE - 1}) // {SIZE}))::INTEGER AS pos FROM f),
c AS (SELECT file_id, source, lang, pos, (pos * {SIZE})::BIGINT AS "offset", least({SIZE}, n - pos * {SIZE})::INTEGER AS size,
  sha256(array_slice(content, pos * {SIZE} + 1, least((pos + 1) * {SIZE}, n))) AS fp FROM p)"""
CLOUDS = f"{CHUNKS}, src AS (SELECT * FROM c WHERE file_id % 2 = 0), dst AS (SELECT * FROM c WHERE file_id % 2 != 0)"
BYTE_SUM = "list_sum(list_transform(range(32), lambda i: ('0x' || substr(fp, 2 * i + 1, 2))::BIGINT))::BIGINT"
FIRST_BYTE = "('0x' || substr(fp, 1, 2))::BIGINT"
SEGMENTS = f"{CHUNKS}, s AS (SELECT *, pos // {SEGMENT_CHUNKS} AS segment FROM c)"
SUMS = "sum(bytes)::BIGINT AS logical_bytes, sum(n)::BIGINT AS logical_chunks, sum(size)::BIGINT AS unique_bytes, count(*) AS unique_chunks, round(sum(bytes)::DOUBLE / nullif(sum(size), 0)::DOUBLE, 6) AS dedup_ratio"


@query(f'WITH {CHUNKS} SELECT file_id, pos, "offset", size FROM c')
def chunk_fixed(spark, sf_dir):
    return chunking.fixed_chunks(files(spark, sf_dir), SIZE).select("file_id", "pos", "offset", "size")


@query(f"""WITH {FILES}, b AS (SELECT *, unnest(range((n + 999) // 1000)) AS blk FROM f),
p AS (SELECT *, unnest(range(blk * 1000, least(n, (blk + 1) * 1000), 300)) AS o FROM b)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY o) - 1)::INTEGER AS pos, o AS "offset", least(300, least(n, (blk + 1) * 1000) - o)::INTEGER AS size FROM p""")
def chunk_fixed_blocks(spark, sf_dir):
    return chunking.fixed_chunks(files(spark, sf_dir), 300, 1000).select("file_id", "pos", "offset", "size")


@query(f"WITH {CHUNKS} SELECT file_id, pos, size, fp FROM c")
def chunk_fp(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_id", "pos", "size", "fp")


@query("SELECT sha256(encode(coalesce(text, ''))) AS file_fp, count(*) AS n_files, min(doc_id) AS first_file_id, max(octet_length(encode(coalesce(text, ''))))::BIGINT AS file_size FROM documents GROUP BY 1")
def whole_file_dedup(spark, sf_dir):
    each = files(spark, sf_dir).select("file_id", "file_size", F.sha2("content", 256).alias("file_fp"))
    return each.groupBy("file_fp").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_file_id"), F.max("file_size").alias("file_size"))


@query(f"WITH {CHUNKS}, u AS (SELECT fp, sum(size) AS bytes, count(*) AS n, max(size) AS size FROM c GROUP BY fp) SELECT {SUMS} FROM u")
def dedup_stats(spark, sf_dir):
    return dedup.totals(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS}, u AS (SELECT source, fp, sum(size) AS bytes, count(*) AS n, max(size) AS size FROM c GROUP BY source, fp) SELECT source, {SUMS} FROM u GROUP BY source")
def dedup_stats_by_source(spark, sf_dir):
    return dedup.totals(chunks(spark, sf_dir), "source")


@query(f"""WITH {CHUNKS}, u AS (SELECT lang, source, fp, sum(size) AS bytes, count(*) AS n, max(size) AS size FROM c GROUP BY ROLLUP (lang, source), fp)
SELECT lang, source, {SUMS} FROM u GROUP BY lang, source""")
def dedup_ratio_rollup(spark, sf_dir):
    return dedup.totals_rollup(chunks(spark, sf_dir, "lang"), "lang", "source")


@query(f"WITH {CHUNKS} SELECT file_id, pos, fp, (row_number() OVER (PARTITION BY fp ORDER BY file_id, pos) = 1)::INTEGER AS is_first FROM c")
def dedup_first_occurrence(spark, sf_dir):
    return dedup.first_occurrence(chunks(spark, sf_dir)).select("file_id", "pos", "fp", "is_first")


@query(f"WITH {CHUNKS}, r AS (SELECT source, size, (row_number() OVER (PARTITION BY fp ORDER BY file_id, pos) = 1) AS is_first FROM c) SELECT source, count(*) FILTER (is_first) AS stored_chunks, coalesce(sum(size) FILTER (is_first), 0)::BIGINT AS stored_bytes FROM r GROUP BY source")
def exact_index_dedup(spark, sf_dir):
    kept = dedup.unique_chunks(chunks(spark, sf_dir), "in_enclave")
    return kept.groupBy("source").agg(F.sum("is_unique").alias("stored_chunks"), F.coalesce(F.sum(F.col("size") * F.col("is_unique")), F.lit(0)).cast("long").alias("stored_bytes"))


@query(f"WITH {CLOUDS}, i AS (SELECT fp, min(file_id) AS held_by FROM dst GROUP BY fp) SELECT file_id, pos, src.fp, held_by, CASE WHEN i.fp IS NULL THEN 'UNIQUE' ELSE 'DUPLICATE' END AS dedup_flag FROM src LEFT JOIN i ON src.fp = i.fp")
def dedup_probe_left(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return dedup.probe(source.select("file_id", "pos", "fp"), target.groupBy("fp").agg(F.min("file_id").alias("held_by")))


@query(f"WITH {CLOUDS}, i AS (SELECT fp, max(file_id) AS held_by FROM dst GROUP BY fp) SELECT file_id, pos, src.fp, held_by, (i.fp IS NOT NULL)::INTEGER AS exist_flag FROM src LEFT JOIN i ON src.fp = i.fp")
def address_lookup_flag(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return dedup.addresses(source.select("file_id", "pos", "fp"), target.groupBy("fp").agg(F.max("file_id").alias("held_by")))


@query(f"""WITH {CLOUDS}, near AS (SELECT DISTINCT fp FROM dst WHERE file_id % 10 = 1), far AS (SELECT DISTINCT fp FROM dst),
t AS (SELECT CASE WHEN near.fp IS NOT NULL THEN 'CACHE' WHEN far.fp IS NOT NULL THEN 'INDEX' ELSE 'NONE' END AS tier, size FROM src LEFT JOIN near ON near.fp = src.fp LEFT JOIN far ON far.fp = src.fp)
SELECT tier, count(*) AS n, sum(size)::BIGINT AS bytes FROM t GROUP BY tier""")
def locality_tiers(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    found = dedup.tiered_probe(source, target.where("file_id % 10 = 1"), target)
    return found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {CLOUDS} SELECT DISTINCT fp FROM src WHERE fp NOT IN (SELECT fp FROM dst)")
def recovered_not_requested(spark, sf_dir):
    return dedup.unexpected(*two_clouds(chunks(spark, sf_dir)))


@query(f"WITH {CLOUDS} SELECT file_id, pos, fp FROM src WHERE fp NOT IN (SELECT fp FROM dst)")
def missing_at_dest_anti(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return dedup.missing(source, target).select("file_id", "pos", "fp")


@query(f"WITH {CLOUDS} SELECT DISTINCT fp FROM src WHERE fp NOT IN (SELECT fp FROM dst)")
def missing_at_dest_distinct(spark, sf_dir):
    return dedup.missing(*two_clouds(chunks(spark, sf_dir)), distinct=True)


@query(f"WITH {CLOUDS} SELECT file_id, pos, fp FROM src WHERE fp IN (SELECT fp FROM dst)")
def shared_semi(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return dedup.shared(source, target).select("file_id", "pos", "fp")


@query(f"WITH {CLOUDS} SELECT fp FROM src INTERSECT SELECT fp FROM dst")
def shared_intersect(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return source.select("fp").intersect(target.select("fp"))


@query(f"WITH {CLOUDS} SELECT fp, count(*) AS n FROM (SELECT fp FROM src EXCEPT ALL SELECT fp FROM dst) GROUP BY fp")
def missing_except(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return source.select("fp").exceptAll(target.select("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLOUDS}, i AS (SELECT fp, min(file_id) AS file_id FROM dst GROUP BY fp)
SELECT fp, file_id FROM i UNION ALL SELECT fp, min(file_id) FROM src WHERE fp NOT IN (SELECT fp FROM i) GROUP BY fp""")
def index_upsert_first_wins(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir).select("fp", "file_id"))
    return dedup.insert_if_absent(target.groupBy("fp").agg(F.min("file_id").alias("file_id")), source, ("file_id",))


@query(f"""WITH {CLOUDS}, i AS (SELECT fp, min(file_id) AS file_id FROM dst GROUP BY fp), b AS (SELECT fp, max(file_id) AS file_id FROM src GROUP BY fp)
SELECT fp, file_id FROM b UNION ALL SELECT fp, file_id FROM i WHERE fp NOT IN (SELECT fp FROM b)""")
def index_last_wins(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir).select("fp", "file_id"))
    return dedup.overwrite(target.groupBy("fp").agg(F.min("file_id").alias("file_id")), source, ("file_id",))


@query(f"WITH {CHUNKS} SELECT fp, count(*) AS freq FROM c GROUP BY fp ORDER BY freq DESC, fp LIMIT 100")
def chunk_freq_topk(spark, sf_dir):
    return sketch.top(chunks(spark, sf_dir), 100)


@query(f"WITH {CHUNKS} SELECT file_id, pos, fp, count(*) OVER (PARTITION BY fp ORDER BY file_id, pos ROWS UNBOUNDED PRECEDING) AS freq FROM c")
def running_freq(spark, sf_dir):
    return sketch.running_frequency(chunks(spark, sf_dir)).select("file_id", "pos", "fp", "freq")


@query(f"""WITH {CHUNKS}, b AS (SELECT *, pos // 16 AS batch FROM c),
t AS (SELECT *, count(*) OVER (PARTITION BY fp ORDER BY file_id, batch) AS freq, row_number() OVER (PARTITION BY file_id, batch, fp ORDER BY pos) AS k FROM b)
SELECT source, CASE WHEN k > 1 THEN 'LOCAL' WHEN freq >= 3 THEN 'TOP' ELSE 'OUTSIDE' END AS tier, count(*) AS n, sum(size)::BIGINT AS bytes FROM t GROUP BY 1, 2""")
def freq_gate_tiers(spark, sf_dir):
    batched = chunking.batches(chunks(spark, sf_dir), 16)
    return sketch.tiers(batched, 3).groupBy("source", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _cell(i: int) -> str:
    return "('0x' || " + " || ".join(f"substr(fp, {8 * i + 1 + k}, 2)" for k in (6, 4, 2, 0)) + f")::UBIGINT % {SKETCH.width}"


CELLS = " UNION ALL ".join(f"SELECT fp, {i} AS r, {_cell(i)} AS cell FROM c" for i in range(4))


@query(f"WITH {CHUNKS}, l AS ({CELLS}), s AS (SELECT r, cell, count(*) AS n FROM l GROUP BY r, cell) SELECT l.fp, min(s.n)::BIGINT AS estimate FROM l JOIN s ON l.r = s.r AND l.cell = s.cell GROUP BY l.fp")
def cms_estimate(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return sketch.estimates(rows, sketch.sketch(rows, SKETCH), SKETCH)


@query(f"WITH {CHUNKS}, l AS ({CELLS}) SELECT r AS row, cell::BIGINT AS cell, count(*)::BIGINT AS count FROM l GROUP BY ALL")
def cms_table_merged(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    return sketch.merged(sketch.sketch(source, SKETCH), sketch.sketch(target, SKETCH))


@query(f"WITH {CHUNKS}, q AS (SELECT count(*) AS freq FROM c GROUP BY fp) SELECT round(sum(freq * ln(freq)) / sum(freq) - ln(sum(freq)) + ln(count(*)), 6) AS kld FROM q")
def frequency_leakage(spark, sf_dir):
    return sketch.leakage(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT DISTINCT fp, {BYTE_SUM} AS byte_sum FROM c")
def hash_byte_sum(spark, sf_dir):
    return chunks(spark, sf_dir).select("fp").distinct().withColumn("byte_sum", byte_sum(F.col("fp")))


@query(f"WITH {CHUNKS} SELECT file_id, pos, ({BYTE_SUM} % 640 = 1)::INTEGER AS starts FROM c")
def segment_boundary_pred(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_id", "pos", chunking.boundary(F.col("fp"), SegmentParams()).cast("int").alias("starts"))


def fixed_segments(spark, sf_dir):
    return chunking.fixed_segments(chunks(spark, sf_dir), SEGMENT_CHUNKS)


@query(f"""WITH {SEGMENTS}, v AS (SELECT *, {BYTE_SUM} AS v FROM s)
SELECT file_id, segment, count(*)::INTEGER AS n_chunks, sum(size)::BIGINT AS bytes, arg_min(fp, v * 1000000 + pos) AS min_fp, sha256(string_agg(size || ':' || fp, ',' ORDER BY pos)) AS segment_fp FROM v GROUP BY file_id, segment""")
def segment_minhash(spark, sf_dir):
    return segments.representatives(fixed_segments(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, v AS (SELECT *, {BYTE_SUM} AS v FROM s), m AS (SELECT file_id, segment, arg_min(fp, v * 1000000 + pos) AS min_fp FROM v GROUP BY file_id, segment),
r AS (SELECT s.*, (row_number() OVER (PARTITION BY min_fp, fp ORDER BY s.file_id, s.segment, pos) = 1) AS u FROM s JOIN m ON s.file_id = m.file_id AND s.segment = m.segment)
SELECT source, count(*) FILTER (u) AS stored_chunks, coalesce(sum(size) FILTER (u), 0)::BIGINT AS stored_bytes FROM r GROUP BY source""")
def extreme_binning_dedup(spark, sf_dir):
    kept = segments.extreme_binning(fixed_segments(spark, sf_dir))
    return kept.groupBy("source").agg(F.sum("is_unique").alias("stored_chunks"), F.coalesce(F.sum(F.col("size") * F.col("is_unique")), F.lit(0)).cast("long").alias("stored_bytes"))


@query(f"WITH {SEGMENTS} SELECT DISTINCT file_id, segment, fp AS hook_fp FROM s WHERE {FIRST_BYTE} < 4")
def hook_sample(spark, sf_dir):
    return segments.hooks(fixed_segments(spark, sf_dir))


HOOKS = f"{SEGMENTS}, h AS (SELECT DISTINCT file_id, segment, fp AS hook_fp FROM s WHERE {FIRST_BYTE} < 16)"
PAIRS = f"""{HOOKS}, pairs AS (SELECT a.file_id, a.segment, b.file_id AS old_file, b.segment AS old_segment, count(*) AS score
  FROM h a JOIN h b ON a.hook_fp = b.hook_fp AND (b.file_id < a.file_id OR b.file_id = a.file_id AND b.segment < a.segment) GROUP BY ALL)"""


@query(f"WITH {HOOKS}, n AS (SELECT *, row_number() OVER (PARTITION BY hook_fp ORDER BY file_id DESC, segment DESC) AS age FROM h) SELECT hook_fp, file_id, segment, age::INTEGER AS age FROM n WHERE age <= 10")
def hook_newest10(spark, sf_dir):
    return segments.newest_manifests(segments.hooks(fixed_segments(spark, sf_dir), SparseParams(sample_bits=4)), 10).select("hook_fp", "file_id", "segment", "age")


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def candidate_segments(spark, sf_dir):
    hooks = segments.hooks(fixed_segments(spark, sf_dir), SparseParams(sample_bits=4))
    return segments.candidates(hooks, hooks)


@query(f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment ORDER BY score DESC, old_file DESC, old_segment DESC) AS place FROM pairs) SELECT file_id, segment, old_file, old_segment, score, place::INTEGER AS place FROM n WHERE place <= 10")
def champion_segments(spark, sf_dir):
    return segments.champions(candidate_segments(spark, sf_dir), 10)


@query()
def sparse_index_dedup(spark, sf_dir):
    kept = segments.sparse_indexing(fixed_segments(spark, sf_dir), "source", SparseParams(sample_bits=4))
    return kept.groupBy("source").agg(F.sum("is_unique").alias("stored_chunks"), F.sum(F.col("size") * F.col("is_unique")).alias("stored_bytes"))


@query()
def frequency_index_replay(spark, sf_dir):
    rows = sketch.replay(chunks(spark, sf_dir), "source", SKETCH)
    return rows.groupBy("source", "tier").agg(F.count(F.lit(1)).alias("n"), F.max("freq").alias("most"))


STREAM = SegmentParams(min_bytes=2048, max_bytes=8192, max_chunks=64, divisor=8, pattern=1)
STREAM_CUT = f"n >= {STREAM.max_chunks} OR total + o.size > {STREAM.max_bytes} OR total >= {STREAM.min_bytes} AND cut"


@query(f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT file_id, pos, size, {BYTE_SUM} % {STREAM.divisor} = {STREAM.pattern} AS cut FROM c),
r AS (SELECT file_id, pos, size, 0 AS segment, 1 AS n, size::BIGINT AS total FROM o WHERE pos = 0
UNION ALL SELECT o.file_id, o.pos, o.size, CASE WHEN {STREAM_CUT} THEN segment + 1 ELSE segment END, CASE WHEN {STREAM_CUT} THEN 1 ELSE n + 1 END, CASE WHEN {STREAM_CUT} THEN 0 ELSE total END + o.size
  FROM r JOIN o ON o.file_id = r.file_id AND o.pos = r.pos + 1)
SELECT file_id, segment, min(pos) AS first_pos, count(*) AS n_chunks, sum(size)::BIGINT AS bytes FROM r GROUP BY file_id, segment""")
def segment_chunk_stream(spark, sf_dir):
    cut = chunking.segment(chunks(spark, sf_dir), STREAM)
    return cut.groupBy("file_id", "segment").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("bytes"))


@query(f"WITH {CHUNKS} SELECT file_id, pos, coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS file_offset FROM c")
def chunk_offsets(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_id", "pos", dedup.before(F.col("size"), "file_id", "pos").alias("file_offset"))


@query(f"WITH {CHUNKS} SELECT file_id, (pos // 16)::INTEGER AS batch, count(*) AS n FROM c GROUP BY ALL")
def recipe_batches(spark, sf_dir):
    return chunking.batches(chunks(spark, sf_dir), 16).groupBy("file_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS} SELECT file_id, pos, coalesce(sum(size + 16) OVER (PARTITION BY file_id, pos // 15 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS container_offset FROM c")
def container_offsets(spark, sf_dir):
    fixed = PackParams(container_bytes=1 << 40, meta_bytes=56 * 15 + 1)
    return store.packed(chunks(spark, sf_dir), "file_id", ("pos",), fixed).select("file_id", "pos", "container_offset")


@query(f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY file_id, pos) AS k FROM c),
r AS (SELECT source, k, file_id, pos, size, 0::BIGINT AS container, 0::BIGINT AS container_offset, size + 16 AS body, 56 AS meta FROM o WHERE k = 1
UNION ALL SELECT o.source, o.k, o.file_id, o.pos, o.size,
  CASE WHEN 16 + o.size + body + 56 + meta < {PACK.container_bytes} AND 56 + meta < {PACK.meta_bytes} THEN container ELSE container + 1 END,
  CASE WHEN 16 + o.size + body + 56 + meta < {PACK.container_bytes} AND 56 + meta < {PACK.meta_bytes} THEN body ELSE 0 END,
  CASE WHEN 16 + o.size + body + 56 + meta < {PACK.container_bytes} AND 56 + meta < {PACK.meta_bytes} THEN body ELSE 0 END + o.size + 16,
  CASE WHEN 16 + o.size + body + 56 + meta < {PACK.container_bytes} AND 56 + meta < {PACK.meta_bytes} THEN meta ELSE 0 END + 56
  FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
SELECT source, file_id, pos, container, container_offset FROM r""")
def container_pack_seq(spark, sf_dir):
    return store.packed(chunks(spark, sf_dir), "source", ("file_id", "pos"), PACK).select("source", "file_id", "pos", "container", "container_offset")


@query(f"WITH {FILES} SELECT file_id, sha256(content) AS content_fp, n::BIGINT AS file_size, ((n + {SIZE - 1}) // {SIZE})::INTEGER AS n_chunks FROM f")
def restore_check(spark, sf_dir):
    every = files(spark, sf_dir)
    cut = chunking.fingerprinted(chunking.fixed_chunks(every, SIZE))
    meta = cut.select("file_id", "source", "pos", "size", "fp")
    unique = meta.where("true").groupBy("fp").agg(F.min(F.struct("source", "file_id", "pos", "size")).alias("v")).select("fp", "v.*")
    placed = store.container_ids(store.packed(unique, "source", ("file_id", "pos"), PACK), "source").withColumn("offset", F.col("container_offset"))
    recipe = store.recipes(meta, placed.withColumn("length", F.col("size")))
    data = placed.select("fp", "container_id", "offset", "file_id", "pos").join(cut.select("file_id", "pos", "data"), ["file_id", "pos"])
    return store.restored(recipe, data, store.file_heads(every, meta)).select("file_id", F.sha2("content", 256).alias("content_fp"), F.octet_length("content").cast("long").alias("file_size"), "n_chunks")


@query(f"""WITH {CHUNKS}, k AS (SELECT fp, min(file_id) AS file_id FROM c GROUP BY fp),
g AS (SELECT fp, file_id, unnest([0, 1, 2]) AS place, substr(fp, 1 + 2 * unnest([0, 1, 2]), 2) AS feature FROM k),
i AS (SELECT feature, arg_max(fp, lpad(file_id::VARCHAR, 12, '0') || fp) AS base_fp FROM g WHERE file_id % 2 != 0 GROUP BY feature),
v AS (SELECT g.fp, base_fp, count(*) AS n, min(place) AS lead FROM g JOIN i USING (feature) WHERE g.file_id % 2 = 0 AND g.fp != base_fp GROUP BY g.fp, base_fp)
SELECT fp, arg_max(base_fp, n * 10 - lead) AS base_fp, max(n)::BIGINT AS n_votes FROM v GROUP BY fp""")
def base_vote(spark, sf_dir):
    """Votes over three stand-in features of a chunk, the first bytes of its fingerprint."""
    first = chunks(spark, sf_dir).groupBy("fp").agg(F.min("file_id").alias("file_id"))
    meta = first.withColumn("features", F.array(*[F.substring("fp", 1 + 2 * i, 2) for i in range(3)]))
    source, target = two_clouds(meta)
    return similarity.votes(source, similarity.feature_index(target, "file_id"))


SYNC_SQL = f"""{CLOUDS}, m AS (SELECT fp, max(size) AS size FROM src WHERE fp NOT IN (SELECT fp FROM dst) GROUP BY fp)"""


@query(f"WITH {SYNC_SQL} SELECT 1 AS phase, count(*) AS rows, count(*) * 32 AS bytes FROM src UNION ALL SELECT 2, count(*), count(*) * 32 FROM m UNION ALL SELECT 3, count(*), count(*) * 56 FROM m UNION ALL SELECT 5, count(*), coalesce(sum(size), 0)::BIGINT FROM m")
def sync_traffic_by_phase(spark, sf_dir):
    """What the metadata phases send, and the missing bytes before encoding."""
    source, target = two_clouds(chunks(spark, sf_dir))
    gone = dedup.missing(source, target).groupBy("fp").agg(F.max("size").alias("size"))
    asked = source.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(1).alias("phase"), "rows", store.message_bytes("rows", "fp").alias("bytes"))
    sums = gone.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    sent = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), b.alias("bytes")) for p, b in ((2, store.message_bytes("rows", "fp")), (3, store.message_bytes("rows", "feature")), (5, F.col("size")))]))
    return asked.unionByName(sums.select("rows", sent.alias("s")).select("s.phase", "rows", "s.bytes"))


@query(f"""WITH {CLOUDS}, i AS (SELECT DISTINCT fp FROM dst)
SELECT count(*) AS requested, count(*) FILTER (i.fp IS NOT NULL) AS duplicates, count(*) FILTER (i.fp IS NULL) AS missing, count(DISTINCT src.fp) FILTER (i.fp IS NULL) AS missing_distinct, coalesce(sum(size) FILTER (i.fp IS NULL), 0)::BIGINT AS missing_bytes FROM src LEFT JOIN i ON src.fp = i.fp""")
def sync_summary(spark, sf_dir):
    source, target = two_clouds(chunks(spark, sf_dir))
    flagged = dedup.probe(source.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), target.select("fp").distinct())
    new = F.col("dedup_flag") == dedup.UNIQUE
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return flagged.agg(total(F.col("n")).alias("requested"), total(F.when(~new, F.col("n"))).alias("duplicates"), total(F.when(new, F.col("n"))).alias("missing"), F.count(F.when(new, 1)).alias("missing_distinct"), total(F.when(new, F.col("bytes"))).alias("missing_bytes"))


@query()
def fastcdc_chunks(spark, sf_dir):
    return chunking.content_chunks(files(spark, sf_dir), CDC).select("file_id", "pos", "offset", "size", F.sha2("data", 256).alias("fp"))


@query()
def two_level_chunks(spark, sf_dir):
    return chunking.two_level_chunks(files(spark, sf_dir), ChunkParams(min=2048, avg=4096, max=8192), CDC).select("file_id", "segment", "pos", "offset", "size")


@query()
def hmac_fingerprints(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", hmac_sha3(F.col("content")).alias("fp"), xxh64(F.col("content")).alias("xxh64"), murmur3(F.encode("source", "UTF-8")).alias("murmur3"))


@query(f"WITH {CHUNKS} SELECT DISTINCT fp, sha256('k' || ':' || fp) AS token, ({FIRST_BYTE} < 4) AS hook FROM c")
def index_tokens(spark, sf_dir):
    return chunks(spark, sf_dir).select("fp").distinct().select("fp", token(F.col("fp"), F.lit("k")).alias("token"), is_hook(F.col("fp")).alias("hook"))


@query()
def superfeatures(spark, sf_dir):
    cut = chunking.content_chunks(files(spark, sf_dir), CDC)
    return cut.select("file_id", "pos", features(F.col("data")).alias("f")).select("file_id", "pos", *[F.col("f")[i].alias(f"feature{i}") for i in range(3)])


@query()
def chunk_compression(spark, sf_dir):
    cut = chunking.fixed_chunks(files(spark, sf_dir), 4096).withColumn("c", compressed(F.col("data")))
    sums = cut.groupBy("c.codec").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("plain_bytes"), F.sum(F.octet_length("c.bytes")).alias("stored_bytes"))
    return sums.withColumn("compression_ratio", ratio(F.col("plain_bytes"), F.col("stored_bytes")))


def _synchronised(spark, sf_dir) -> sync.Sync:
    params = SyncParams(chunks=CDC, pack=PACK)
    source, target = two_clouds(files(spark, sf_dir))
    return sync.synchronise(sync.upload(source, params, name="a").persisted(), sync.upload(target, params, name="b").persisted(), params)


FIXED = SyncParams(chunks=ChunkParams(method="fixed", avg=SIZE), pack=PACK, segments=SegmentParams(min_bytes=0, max_bytes=1 << 40, max_chunks=SEGMENT_CHUNKS, divisor=1, pattern=1))
STORED = "count(*) AS stored_chunks, coalesce(sum(size), 0)::BIGINT AS stored_bytes"


def _stored(cloud: sync.Cloud) -> DataFrame:
    return cloud.stored().agg(F.count(F.lit(1)).alias("stored_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("stored_bytes"))


@query(f"""WITH {CLOUDS}, a AS (SELECT fp, max(size) AS size FROM src GROUP BY fp), b AS (SELECT fp, max(size) AS size FROM c GROUP BY fp)
SELECT 1 AS upload, (SELECT count(*) FROM src) AS logical_chunks, {STORED} FROM a UNION ALL SELECT 2, (SELECT count(*) FROM c) + 0, {STORED} FROM b UNION ALL SELECT 3, (SELECT count(*) FROM c) + (SELECT count(*) FROM src), {STORED} FROM b""")
def upload_twice(spark, sf_dir):
    """Three uploads into one store: the source's files, the target's, and the source's again under other ids, which store nothing."""
    source, target = two_clouds(files(spark, sf_dir))
    clouds = [sync.upload(source, FIXED, name="a").persisted()]
    clouds.append(sync.upload(target, FIXED, name="b", into=clouds[0]).persisted())
    clouds.append(sync.upload(source.withColumn("file_id", F.col("file_id") + (1 << 40)), FIXED, name="c", into=clouds[1]))
    out = [c.recipes.agg(F.count(F.lit(1)).alias("logical_chunks")).crossJoin(_stored(c)).select(F.lit(k).alias("upload"), "*") for k, c in enumerate(clouds, 1)]  # one row each
    return out[0].unionByName(out[1]).unionByName(out[2])


BINNED = f"""{SEGMENTS}, m AS (SELECT file_id, segment, arg_min(fp, ({BYTE_SUM}) * 100000 + pos) AS min_fp FROM s GROUP BY file_id, segment),
x AS (SELECT s.*, min_fp, row_number() OVER (PARTITION BY min_fp, fp ORDER BY s.file_id, s.segment, pos) AS k FROM s JOIN m ON m.file_id = s.file_id AND m.segment = s.segment)"""


@query(f"WITH {BINNED} SELECT {STORED} FROM x WHERE k = 1")
def upload_mode_2(spark, sf_dir):
    """Stored copies of an upload by Extreme Binning; a chunk may be stored under several bins."""
    return _stored(sync.upload(files(spark, sf_dir), FIXED, mode=2))


@query(f"""WITH {BINNED}, a AS (SELECT DISTINCT min_fp, fp FROM x WHERE file_id % 2 = 0),
y AS (SELECT x.*, row_number() OVER (PARTITION BY x.min_fp, x.fp ORDER BY file_id, segment, pos) AS j FROM x LEFT JOIN a ON a.min_fp = x.min_fp AND a.fp = x.fp WHERE file_id % 2 != 0 AND a.fp IS NULL),
z AS (SELECT size FROM (SELECT *, row_number() OVER (PARTITION BY min_fp, fp ORDER BY file_id, segment, pos) AS i FROM x WHERE file_id % 2 = 0) WHERE i = 1 UNION ALL SELECT size FROM y WHERE j = 1)
SELECT {STORED} FROM z""")
def upload_mode_2_again(spark, sf_dir):
    """The same in two uploads, the second going on from the first one's bins."""
    source, target = two_clouds(files(spark, sf_dir))
    first = sync.upload(source, FIXED, name="a", mode=2).persisted()
    return _stored(sync.upload(target, FIXED, name="b", into=first, mode=2))


@query()
def upload_mode_3(spark, sf_dir):
    """Stored copies of an upload by Sparse Indexing, whose streams are the sources."""
    return _stored(sync.upload(files(spark, sf_dir), FIXED, mode=3))


@query(f"WITH {CHUNKS}, b AS (SELECT fp, max(size) AS size FROM c GROUP BY fp) SELECT {STORED} FROM b")
def upload_mode_4(spark, sf_dir):
    return _stored(sync.upload(files(spark, sf_dir), FIXED, mode=4))


@query(f"WITH {FILES} SELECT file_id, sha256(content) AS content_fp FROM f")
def restore_sealed(spark, sf_dir):
    """Files restored from chunks that were compressed with LZ4 and encrypted, and from near-exact copies."""
    cloud = sync.upload(files(spark, sf_dir), FIXED, mode=2)
    key = F.lit("0123456789abcdef0123456789abcdef")
    kept = dataclasses.replace(cloud, data=sync.opened(sync.sealed(cloud.data, "lz4", key), key))
    return sync.restore(kept).select("file_id", F.sha2("content", 256).alias("content_fp"))


@query()
def delta_sizes(spark, sf_dir):
    sent = _synchronised(spark, sf_dir).payload
    return sent.groupBy("kind", "codec").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query()
def sync_statistics(spark, sf_dir):
    return sync.statistics(_synchronised(spark, sf_dir))


@query(f"WITH {FILES} SELECT file_id, sha256(content) AS content_fp FROM f")
def sync_e2e(spark, sf_dir):
    """Files restored from the target after synchronisation: its own and the source's."""
    return sync.restore(_synchronised(spark, sf_dir).target.persisted()).select("file_id", F.sha2("content", 256).alias("content_fp"))


@query(f"""WITH {CHUNKS}, a AS (SELECT source, substr(fp, 1, 2) AS key, row_number() OVER (PARTITION BY source ORDER BY file_id, pos) AS i FROM c),
b AS (SELECT *, lag(i) OVER w AS last, coalesce(lead(i) OVER w, 1::BIGINT << 60) AS next FROM a WINDOW w AS (PARTITION BY source, key ORDER BY i)),
h AS (SELECT b.source, b.i, count(d.i) AS others FROM b LEFT JOIN b d ON d.source IS NOT DISTINCT FROM b.source AND d.i > b.last AND d.i < b.i AND d.next > b.i WHERE b.last IS NOT NULL GROUP BY b.source, b.i)
SELECT b.source, count(*) AS accesses, count(*) FILTER (others < 32) AS hits FROM b LEFT JOIN h ON h.source IS NOT DISTINCT FROM b.source AND h.i = b.i GROUP BY b.source""")
def cache_hits(spark, sf_dir):
    """A key is at hand if fewer than 32 others were used since it was last; the SQL counts these."""
    hit = store.lru_hits(chunks(spark, sf_dir).withColumn("key", F.substring("fp", 1, 2)), "source", "key", ("file_id", "pos"), 32)
    return hit.groupBy("source").agg(F.count(F.lit(1)).alias("accesses"), F.sum("hit").alias("hits"))


TRACE = f"{CHUNKS}, t AS (SELECT fp, size, substr(fp, 1, 12) AS short FROM c)"


@query(f"WITH {TRACE} SELECT short AS fp, least(size, 200)::INTEGER AS size, count(*) AS n FROM t GROUP BY ALL")
def trace_fsl(spark, sf_dir):
    """Chunks written as lines of a trace and parsed again; sizes over 200 are cut."""
    fp = F.array_join(F.array(*[F.substring("fp", 1 + 2 * i, 2) for i in range(6)]), ":")
    lines = chunks(spark, sf_dir).select(F.concat(fp, F.lit("\t"), F.col("size").cast("string")).alias("value"))
    return parse_trace(lines, 6, 200).groupBy("fp", "size").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACE} SELECT substr(fp, 1, 10) AS fp, size, count(*) AS n, sum(size)::BIGINT AS payload_bytes FROM t GROUP BY ALL")
def trace_ms(spark, sf_dir):
    fp = F.array_join(F.array(*[F.substring("fp", 1 + 2 * i, 2) for i in range(5)]), ":")
    lines = chunks(spark, sf_dir).select(F.concat(fp, F.lit("  "), F.col("size").cast("string")).alias("value"))
    parsed = parse_trace(lines, 5, 16384).withColumn("data", trace_payload(F.col("fp"), F.col("size")))
    return parsed.groupBy("fp", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("payload_bytes"))


@query()
def trace_ratios(spark, sf_dir):
    fps = chunks(spark, sf_dir).select("fp").distinct()
    return fps.groupBy(sampled_ratio(F.col("fp")).alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sum(length(text))::BIGINT AS sent_bytes, sum(length(text) * 3)::BIGINT AS total_bytes, round(sum(length(text) * 3)::DOUBLE / sum(length(text)), 6) AS saving FROM documents")
def transfer_log_totals(spark, sf_dir):
    n = F.char_length("text")
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("sent "), F.format_number(n, 0), F.lit(" bytes  received 1 bytes\ntotal size is "), F.format_number(n * 3, 0), F.lit("  speedup")).alias("value"))
    return transfer_totals(lines)


@query()
def synthetic_ratio(spark, sf_dir):
    cut = chunking.fixed_chunks(synthetic(spark, 4_000_000, 2.0), 16384).withColumn("c", compressed(F.col("data")))
    return cut.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("plain_bytes"), F.sum(F.octet_length("c.bytes")).alias("stored_bytes"))


BASE36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + (file_id // {36**k}) % 36, 1)" for k in range(7, -1, -1))


@query(f"WITH {FILES} SELECT file_id, ((n + 4095) // 4096)::BIGINT AS blocks, {BASE36} AS short_id FROM f")
def ordinal_ids(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", div_ceil(F.col("file_size"), 4096).alias("blocks"), ordinal_id(F.col("file_id")).alias("short_id"))


# Companion queries over the star schema and the events; no operator of the storage engine.


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), "5 minutes")


@query("WITH e AS (SELECT time_bucket(INTERVAL '5 minutes', ts) - unnest([INTERVAL '0 minutes', INTERVAL '5 minutes']) AS window_start FROM events) SELECT window_start, count(*) AS n FROM e GROUP BY ALL")
def events_sliding(spark, sf_dir):
    return ingest.sliding(table(spark, sf_dir, "events"), "10 minutes", "5 minutes")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q1_like(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order")
    )


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def tpch_q3_like(spark, sf_dir):
    day = F.lit("1995-03-15").cast("timestamp")
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", "o_orderdate")
