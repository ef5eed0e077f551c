"""What the operators share: names that cannot clash, row batches, checkpoints, running totals."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REST = "__rest"


def with_rest(df: DataFrame, *keep: str) -> DataFrame:
    """The columns named, and all others in one struct: an operator's own names can't clash with them."""
    others = [c for c in df.columns if c not in keep]
    rest = F.struct(*[df[f"`{c}`"] for c in others]) if others else F.struct(F.lit(0).alias("__none"))
    return df.select(*[df[f"`{c}`"] for c in keep], rest.alias(REST))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark then removes the shuffle files of an action at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder. The shuffle files behind it are removed at once.

    They are those of `df` itself, so `df` should be used no more.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under that setting
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def released(df: DataFrame) -> None:
    """Deletes the files of a table that checkpointed() has returned, and that is read no more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def trimmed(task: Callable) -> Callable:
    """The task, which gives the memory that it has freed back to the system at its end, as Python workers go on to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def batches_by_weight(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices a batch so that each slice holds about `most` bytes of the column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def grouped_tables(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """From batches sorted by the keys: tables that end where a key ends, so no group is cut.

    Holds one batch and the last group of the batches before it.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = _last_change(batch, keys)
        if last is None:
            if held and not _same_key(held[-1], batch, keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        if held and not _same_key(held[-1], batch, keys):
            yield pa.Table.from_batches(held)
            held = []
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _key(batch: pa.RecordBatch, row: int, keys: tuple[str, ...]) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _same_key(before: pa.RecordBatch, batch: pa.RecordBatch, keys: tuple[str, ...]) -> bool:
    return _key(before, before.num_rows - 1, keys) == _key(batch, 0, keys)


def _last_change(batch: pa.RecordBatch, keys: tuple[str, ...]) -> int | None:
    """The row where the last group of the batch starts; None if it is all one group."""
    last = _key(batch, batch.num_rows - 1, keys)
    low, high = 0, batch.num_rows - 1
    while low < high:  # rows are sorted, so those of the last group are at the end
        middle = (low + high) // 2
        if _key(batch, middle, keys) == last:
            high = middle
        else:
            low = middle + 1
    return low or None


#: An even number of 60 bits from the text of a key, the same in any engine that has md5; below it as a part of 1.
BITS = 60


def even_bits(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, BITS // 4), 16, 10).cast("long")


def running(df: DataFrame, group: str, order: list[str], total: Column, name: str, slices: int, of_group: DataFrame | None = None, summed: DataFrame | None = None) -> DataFrame:
    """Adds the sum of `total` over the rows before this one in its group, in the order given; at ties any order holds.

    A group, which is not null, may be any share of the table: order[0] is a whole number spread evenly over BITS bits. It cuts a group
    into `slices`, whose sums are added up as a small table; only rows of one slice meet in one task. of_group: a table
    with one row for each `group`, whose other columns are added too. summed: a table with the same rows, group, order
    and total, which is cheaper to add up.
    """
    slice_of = F.shiftright(F.shiftright(order[0], BITS - 40) * F.lit(slices), 40).cast("int")
    sliced = df.withColumn("__slice", slice_of).withColumn("__total", total)
    sums = (sliced if summed is None else summed.withColumn("__slice", slice_of).withColumn("__total", total)).groupBy(group, "__slice").agg(F.sum("__total").alias("__sum"))
    before = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("__group"), F.col("__slice").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    if of_group is not None:
        offsets = offsets.join(of_group.withColumnRenamed(group, "__same"), F.col("__group") == F.col("__same")).drop("__same")
    inside = Window.partitionBy(group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("__inside", F.coalesce(F.sum("__total").over(inside), F.lit(0)))
        .join(offsets, (F.col(group) == F.col("__group")) & (F.col("__slice") == F.col("__of")))
        .withColumn(name, F.col("__offset") + F.col("__inside"))
        .drop("__slice", "__total", "__inside", "__group", "__of", "__offset")
    )
