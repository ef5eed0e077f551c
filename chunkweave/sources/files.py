"""Where files, traces, tables and logs come from, and where they go."""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.hashing import decrypt, encrypt, name_key

FILES = ["file_id", "source", "content", "file_size"]


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer splits than the cluster has cores, and so is small, is dealt out over them; any other stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Longest name of a file that a client may send, as in the stored formats.
NAME_BYTES = 255


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Regular files as (file_id, source, modified, content, file_size); a file's id is a hash of its path.

    Files without bytes are there too: Spark's reader leaves them out, so they are found by name. A file whose name has more than
    NAME_BYTES bytes is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", F.col("modificationTime").alias("modified"), "content", F.col("length").alias("file_size"))
    named = spark.createDataFrame([(unquote(n.replace("file:///", "file:/", 1)),) for n in found.inputFiles()], "path string")
    empty = named.join(found.select("path"), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("modified"), F.lit(b"").alias("content"), F.lit(0).cast("long").alias("file_size"))
    long = F.octet_length(F.substring_index("path", "/", -1)) > NAME_BYTES
    checked = F.when(long, F.raise_error(F.concat(F.lit("name is too long: "), F.col("path")))).otherwise(F.col("path"))
    return rows.unionByName(empty).select(F.xxhash64("path").alias("file_id"), checked.alias("source"), "modified", "content", "file_size")


def scan_directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and times of the files below a path, oldest first; contents are not read."""
    return read_files(spark, path, pattern).select("source", "modified", "file_size").orderBy("modified", "source")


def files_of(documents: DataFrame, *keep: str) -> DataFrame:
    """Text documents as files of their UTF-8 bytes; a null text is an empty file."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select(F.col("doc_id").alias("file_id"), "source", *keep, content.alias("content")).withColumn("file_size", F.octet_length("content").cast("long"))


def _line(fp_bytes: int) -> str:
    return rf"^\s*((?:[0-9a-fA-F]{{2}}:){{{fp_bytes - 1}}}[0-9a-fA-F]{{2}})\s+(\d{{1,18}})"


def malformed(lines: DataFrame, fp_bytes: int, column: str = "value") -> DataFrame:
    """The lines of a trace that parse_trace() leaves out, nulls and empty ones too."""
    return lines.where(~F.coalesce(F.col(column), F.lit("")).rlike(_line(fp_bytes)))


def parse_trace(lines: DataFrame, fp_bytes: int, largest: int, column: str = "value") -> DataFrame:
    """(fp, size) of trace lines: `fp_bytes` hex bytes with colons, white space, size. Sizes over the largest are cut to it.

    Lines of another form are left out; malformed() has them.
    """
    pattern = _line(fp_bytes)
    fp = F.lower(F.replace(F.regexp_extract(column, pattern, 1), F.lit(":"), F.lit("")))
    size = F.regexp_extract(column, pattern, 2)
    return lines.where(F.col(column).rlike(pattern)).withColumns({"fp": fp, "size": F.least(size.cast("long"), F.lit(largest)).cast("int")}).drop(column)


def read_fsl_trace(spark: SparkSession, path: str, largest: int = 16384) -> DataFrame:
    return parse_trace(spark.read.text(path), 6, largest)


def read_ms_trace(spark: SparkSession, path: str, largest: int = 16384) -> DataFrame:
    return parse_trace(spark.read.text(path), 5, largest)


def trace_payload(fp: Column, size: Column) -> Column:
    """Bytes that stand for a trace's chunk: its fingerprint over and over."""
    raw = F.unhex(fp)
    whole = F.unhex(F.repeat(F.hex(raw), F.ceil(size / F.octet_length(raw)).cast("int")))
    return F.substring(whole, 1, size)


def with_candidates(trace: DataFrame, candidates: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Trace rows with payload, the candidate (bucket, payload) of their compression ratio in tenths, from 10 to 30.

    There are 21 buckets at most, so the candidates are broadcast.
    """
    bucket = F.least(F.greatest(F.round(F.col(ratio) * 10).cast("int"), F.lit(10)), F.lit(30))
    few = candidates.where(F.col("bucket").between(10, 30)).dropDuplicates(["bucket"]).select("bucket", "payload")
    return trace.withColumn("bucket", bucket).join(F.broadcast(few), "bucket", "left").drop("bucket")


#: Of synthetic data: lengths of literal runs and matches, and the exponents of their power distributions and of literal bytes.
LEAST_MATCH, MOST_MATCH, LENGTH_POWER, LITERAL_POWER = 3, 34, 3.0, 3.0


def _compressible(r: np.random.Generator, n: int, ratio: float) -> bytes:
    """n bytes of literals and matches. A match repeats the run of bytes made last; matches come as often as the ratio asks."""
    out, last = bytearray(), b""
    while len(out) < n:
        length = LEAST_MATCH + int((MOST_MATCH - LEAST_MATCH + 1) * r.random() ** LENGTH_POWER)
        if last and r.random() >= 1 / ratio:
            out += (last * (length // len(last) + 1))[:length]
        else:
            last = (256 * r.random(length) ** LITERAL_POWER).astype(np.uint8).tobytes()
            out += last
    return bytes(out[:n])


def synthetic(spark: SparkSession, n_bytes: int, ratio: float = 2.0, seed: int = 1, block: int = 16384) -> DataFrame:
    """(file_id, source, content, file_size) in blocks of literals and matches that compress by about the ratio; the same for a seed."""

    def fill(batches):
        for batch in batches:
            import pyarrow as pa

            out = [_compressible(np.random.default_rng((seed, i)), n, ratio) for i, n in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "content"])

    blocks = spark.range(-(-n_bytes // block)).withColumn("n", F.least(F.lit(block), F.lit(n_bytes) - F.col("id") * block).cast("int"))
    made = blocks.mapInArrow(fill, "id bigint, content binary")
    return made.select(F.col("id").alias("file_id"), F.lit("synthetic").alias("source"), "content", F.octet_length("content").cast("long").alias("file_size"))


#: Folders of a table of recipes or containers; which one a row is in follows from its id.
BUCKETS = 256


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write_bucketed(rows: DataFrame, key: str, order: str, path: str) -> None:
    """A fixed number of folders, sorted inside, so that one id's rows are found by folder and by the files' statistics."""
    placed = rows.withColumn("bucket", _bucket(key))
    placed.repartition("bucket").sortWithinPartitions("bucket", key, order).write.mode("append").partitionBy("bucket").parquet(path)


def sealed_recipes(recipes: DataFrame, key: Column, mode: str = "GCM") -> DataFrame:
    """(file_id, pos, entry): what a recipe says of each chunk, encrypted."""
    rest = [c for c in recipes.columns if c not in ("file_id", "pos")]
    return recipes.select("file_id", "pos", encrypt(F.to_json(F.struct(*rest)).cast("binary"), key, mode).alias("entry"))


def opened_recipes(sealed: DataFrame, key: Column, schema: str, mode: str = "GCM") -> DataFrame:
    """The recipes again; schema: that of the columns that were encrypted."""
    return sealed.select("file_id", "pos", F.from_json(decrypt(F.col("entry"), key, mode).cast("string"), schema).alias("v")).select("file_id", "pos", "v.*")


def write_recipes(recipes: DataFrame, path: str) -> None:
    """Recipes in folders by a hash of the file id."""
    _write_bucketed(recipes, "file_id", "pos", path)


def read_recipes(spark: SparkSession, path: str, *file_ids: int) -> DataFrame:
    """All recipes, or those of some files; then other folders are not read."""
    found = spark.read.parquet(path)
    if file_ids:
        kind = found.schema["file_id"].dataType
        buckets = {r[0] for r in spark.createDataFrame([(i,) for i in file_ids], f"file_id {kind.simpleString()}").select(_bucket("file_id")).collect()}
        found = found.where(F.col("bucket").isin(*buckets) & F.col("file_id").isin(*file_ids))
    return found.drop("bucket")


def find_recipe(recipes: DataFrame, name: str, client: str) -> DataFrame:
    """A client's recipe of a file name; recipes have name_key."""
    return recipes.where(F.col("name_key") == name_key(F.lit(name), F.lit(client)))


def write_containers(chunks: DataFrame, path: str) -> None:
    """Chunk rows (container_id, offset, fp, size, data, features) in folders by a hash of the container."""
    _write_bucketed(chunks, "container_id", "offset", path)


def read_containers(spark: SparkSession, path: str, *container_ids: str) -> DataFrame:
    """All containers, or some; then other folders are not read."""
    found = spark.read.parquet(path)
    if container_ids:
        buckets = {r[0] for r in spark.createDataFrame([(i,) for i in container_ids], "container_id string").select(_bucket("container_id")).collect()}
        found = found.where(F.col("bucket").isin(*buckets) & F.col("container_id").isin(*container_ids))
    return found.drop("bucket")


def save_state(table: DataFrame, path: str) -> None:
    """A snapshot of an index, sketch or heap table."""
    table.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_files(restored: DataFrame, path: str) -> None:
    """Restored files as rows (file_id, content); one folder for all."""
    restored.select("file_id", "content").write.mode("overwrite").parquet(path)


CLIENT_LOG = "input string, opt string, logical_bytes long, chunks long, seconds double, mib_per_second double"
SERVER_LOG = "logical_bytes long, chunks long, unique_bytes long, unique_chunks long, compressed_bytes long, seconds double, mib_per_second double"


DEST_LOG = (
    "enclave_duplicates long, enclave_unique long, global_duplicates long, global_unique long, enclave_similar long, batch_similar long, non_similar long, recv_bytes long, write_bytes long, only_comp_bytes long, "
    "comp_delta_bytes long, uncomp_delta_bytes long, uncomp_similar_bytes long, comp_similar_bytes long, phase2_seconds double, phase4_seconds double, phase6_seconds double, total_seconds double"
)
SRC_LOG = (
    "file string, chunk_bytes long, chunks long, unique_bytes long, unique_chunks long, similar_bytes long, similar_chunks long, base_bytes long, delta_bytes long, comp_delta_bytes long, "
    "phase1_seconds double, phase3_seconds double, phase5_seconds double"
)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def transfer_totals(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sums over the summary lines of file transfer tools: bytes sent, total size, and their ratio."""
    number = lambda p: F.replace(F.regexp_extract(column, p, 1), F.lit(","), F.lit(""))
    parsed = lines.select(F.nullif(number(r"sent ([\d,]+) bytes"), F.lit("")).cast("long").alias("sent"), F.nullif(number(r"total size is ([\d,]+)"), F.lit("")).cast("long").alias("total"))
    sums = parsed.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent_bytes"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_bytes"))
    return sums.withColumn("saving", F.round(F.col("total_bytes") / F.nullif(F.col("sent_bytes"), F.lit(0)), 6))
