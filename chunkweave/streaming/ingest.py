"""Snapshots that arrive over time, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chunkweave.operators import chunking
from chunkweave.params import ChunkParams

INDEX = "fp string, file_id long, pos int, size int, batch long"


def index_path(base: str, batch: int) -> str:
    return f"{base}/batch={batch}"


def ingest(spark: SparkSession, base: str, params: ChunkParams, kind: str = "sha256") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that dedups a micro-batch of files against all before it.

    The index is a folder for each batch; a batch that runs again overwrites its own folder and reads those before it, so
    each snapshot counts once. Recipes go beside it in the same way.
    """

    def one(files: DataFrame, batch: int) -> None:
        chunks = chunking.fingerprinted(chunking.chunk(files, params), kind).select("file_id", "pos", "size", "fp")
        chunks.write.mode("overwrite").parquet(index_path(f"{base}/recipes", batch))
        new = spark.read.parquet(index_path(f"{base}/recipes", batch)).groupBy("fp").agg(F.min(F.struct("file_id", "pos", "size")).alias("v")).select("fp", "v.*")
        if batch:
            known = read_index(spark, base).where(F.col("batch") < batch).select("fp")
            new = new.join(known, "fp", "left_anti")
        new.write.mode("overwrite").parquet(index_path(f"{base}/index", batch))

    return one


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """The index of all batches so far; empty before the first."""
    return spark.read.schema(INDEX).option("basePath", f"{base}/index").parquet(f"{base}/index")


def ingest_stream(files: DataFrame, base: str, params: ChunkParams) -> DataStreamWriter:
    """Dedups a stream of files (file_id, source, content, file_size) into a base folder."""
    return files.writeStream.foreachBatch(ingest(files.sparkSession, base, params)).option("checkpointLocation", f"{base}/progress")


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events and their values by window and type; with a watermark if events may be late."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    grouped = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's runs of events with no longer gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("user_id", "first_ts", "last_ts", "n")
