"""Upload, restore, synchronisation, streams, sources, and every named query."""

import builtins
import importlib
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chunkweave.params import ChunkParams, PackParams, SyncParams
from chunkweave.plans import catalog, sync
from chunkweave.sources import files as sources
from chunkweave.streaming import ingest

PARAMS = SyncParams(chunks=ChunkParams(min=256, avg=512, max=1024), pack=PackParams(container_bytes=16_384, meta_bytes=2240), lanes=4)


@pytest.fixture(scope="module")
def clouds(spark, sf):
    documents = sources.files_of(spark.read.parquet(f"{sf}/documents.parquet"))
    a, b = documents.where("file_id % 2 = 0"), documents.where("file_id % 2 != 0")
    return documents.cache(), sync.upload(a, PARAMS, name="a").persisted(), sync.upload(b, PARAMS, name="b").persisted()


def contents(df):
    return {r.file_id: bytes(r.content) for r in df.collect()}


def test_upload_restores(clouds):
    documents, a, _ = clouds
    assert contents(sync.restore(a)) == contents(documents.where("file_id % 2 = 0"))
    assert a.meta.groupBy("fp").count().where("count > 1").isEmpty()


def test_synchronise(clouds):
    documents, a, b = clouds
    done = sync.synchronise(a, b, PARAMS)
    assert contents(sync.restore(done.target.persisted())) == contents(documents)
    lacking = {r.fp for r in a.meta.collect()} - {r.fp for r in b.meta.collect()}
    assert {r.fp for r in done.payload.collect()} == lacking
    whole = {r.fp for r in done.payload.where("kind = 'COMP_ONLY'").collect()} | {r.fp for r in b.meta.collect()}
    assert all(r.base_fp in whole for r in done.payload.where("kind != 'COMP_ONLY'").collect())
    numbers = {r.metric: r.value for r in sync.statistics(done).collect()}
    assert numbers["missing"] == len(lacking) and sum(v for k, v in numbers.items() if k.startswith("tag:")) == len(lacking)
    sent = {r.phase: r.bytes for r in sync.traffic(done).collect()}
    assert sent[2] == 32 * len(lacking) and sent[3] == 56 * len(lacking)


def test_again_sends_nothing(clouds):
    _, a, _ = clouds
    assert sync.synchronise(a, a, PARAMS).payload.isEmpty()


def test_incremental_snapshots(spark, sf, tmp_path):
    documents = sources.files_of(spark.read.parquet(f"{sf}/documents.parquet"))
    one, base = ingest.ingest(spark, str(tmp_path), PARAMS.chunks), str(tmp_path)
    parts = [documents.where(f"file_id % 3 = {k}") for k in range(3)]
    for k, part in enumerate(parts):
        one(part, k)
    one(parts[2], 2)  # a batch that runs again
    index = ingest.read_index(spark, base)
    assert index.groupBy("fp").count().where("count > 1").isEmpty()
    assert {r.fp for r in index.collect()} == {r.fp for r in sync.upload(documents, PARAMS).meta.collect()}


def test_stream(spark, sf, tmp_path):
    documents = sources.files_of(spark.read.parquet(f"{sf}/documents.parquet"))
    documents.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest.ingest_stream(stream, f"{tmp_path}/out", PARAMS.chunks).trigger(availableNow=True).start()
    query.awaitTermination(120)
    index = ingest.read_index(spark, f"{tmp_path}/out")
    assert index.select("batch").distinct().count() == 3 and index.groupBy("fp").count().where("count > 1").isEmpty()


def test_late_events(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = ingest.tumbling(events, "5 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"d")
    found = sources.read_files(spark, f"{tmp_path}/in", "*.bin")
    assert [bytes(r.content) for r in found.collect()] == [b"abc"] and sources.scan_directory(spark, f"{tmp_path}/in").count() == 2
    cloud = sync.upload(found, SyncParams(chunks=ChunkParams(method="fixed", avg=2)))
    chunks = cloud.meta.join(cloud.data, "fp")
    sources.write_containers(chunks, f"{tmp_path}/containers")
    assert sources.read_containers(spark, f"{tmp_path}/containers").count() == 2
    recipe = cloud.recipes.withColumn("name_key", F.lit("k"))
    sources.write_recipes(recipe, f"{tmp_path}/recipes")
    one = found.first().file_id
    assert sources.read_recipes(spark, f"{tmp_path}/recipes", one).count() == 2 and sources.read_recipes(spark, f"{tmp_path}/recipes", one + 1).count() == 0
    assert sources.find_recipe(recipe, "name", "me").isEmpty()
    sources.save_state(cloud.meta, f"{tmp_path}/state")
    assert sources.load_state(spark, f"{tmp_path}/state").count() == 2
    sources.write_files(sync.restore(cloud), f"{tmp_path}/restored")
    assert bytes(spark.read.parquet(f"{tmp_path}/restored").first().content) == b"abc"


def test_traces_and_logs(spark, tmp_path):
    (tmp_path / "t").write_text("aa:bb:cc:dd:ee:FF\t20000\nbroken\n00:01:02:03:04:05   7\n")
    rows = sources.read_fsl_trace(spark, f"{tmp_path}/t").orderBy("fp").collect()
    assert [(r.fp, r["size"]) for r in rows] == [("000102030405", 7), ("aabbccddeeff", 16384)]
    assert bytes(spark.createDataFrame(rows).select(sources.trace_payload(F.col("fp"), F.col("size"))).first()[0]) == bytes.fromhex("00010203040500")
    (tmp_path / "m").write_text("aa:bb:cc:dd:ee 5\n")
    assert sources.read_ms_trace(spark, f"{tmp_path}/m").first().fp == "aabbccddee"
    log = spark.createDataFrame([("f", "u", 10, 2, 0.5, 1.5)], sources.CLIENT_LOG)
    sources.write_log(log, f"{tmp_path}/log")
    assert sources.read_log(spark, f"{tmp_path}/log", sources.CLIENT_LOG).collect() == log.collect()
    trace = spark.createDataFrame([(0.2,), (1.5,), (9.0,)], "ratio double")
    sets = spark.createDataFrame([(10, "a"), (15, "b"), (30, "c"), (31, "d")], "bucket int, payload string")
    assert [r.payload for r in sources.with_candidates(trace, sets).orderBy("ratio").collect()] == ["a", "b", "c"]
    assert sources.synthetic(spark, 40_000, seed=3).agg(F.sum("file_size")).first()[0] == 40_000


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("how", ["absent", "broken"])
def test_library_works_without_the_pipeline(monkeypatch, how):
    names = [n for n in sys.modules if n.startswith("chunkweave.llm") or n == "corpus_pipeline"]
    for n in names:
        monkeypatch.delitem(sys.modules, n)
    real = builtins.__import__
    at = "chunkweave.llm" if how == "absent" else "public_tokenizers"

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(at) or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(catalog.QUERIES) and set(bare.oracle_sql()) == set(catalog.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
