"""python -m chunkweave upload|restore|sync|stats|synth: a store is a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.params import SyncParams, from_json
from chunkweave.plans import sync
from chunkweave.sources.files import read_files, synthetic, write_files

#: The last two are there for near-exact modes only.
TABLES = ("recipes", "meta", "data", "files", "copies", "bins")


def save(cloud: sync.Cloud, path: str, codec: str = "zstd") -> None:
    """A store: the tables of a cloud, chunks compressed."""
    for name in TABLES:
        table = getattr(cloud, name)
        if table is not None:
            (sync.sealed(table, codec) if name == "data" else table).write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> sync.Cloud:
    def table(name: str) -> DataFrame | None:
        try:
            found = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if name in TABLES[:4]:
                raise
            return None
        return sync.opened(found) if name == "data" else found

    return sync.Cloud(*map(table, TABLES))


def statistics(cloud: sync.Cloud) -> DataFrame:
    return sync.totals(cloud)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("chunkweave", description=__doc__)
    p.add_argument("--params", default="{}", help="SyncParams as a JSON object")
    sub = p.add_subparsers(dest="what", required=True)
    for name, names in {"upload": ("input", "store"), "restore": ("store", "output"), "sync": ("source", "target", "result"), "stats": ("store",)}.items():
        one = sub.add_parser(name)
        for n in names:
            one.add_argument(n)
        if name == "upload":
            one.add_argument("-m", "--mode", type=int, choices=range(len(sync.MODES)), default=0, help=", ".join(f"{k} {m}" for k, m in enumerate(sync.MODES)))
            one.add_argument("--into", help="a store that the files are added to; the result is a new store")
            one.add_argument("--name", default="up", help="what ids of new containers start with")
    one = sub.add_parser("synth")
    one.add_argument("output")
    one.add_argument("--bytes", type=int, required=True)
    one.add_argument("--ratio", type=float, default=2.0)
    one.add_argument("--seed", type=int, default=1)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark, params = spark or SparkSession.builder.appName("chunkweave").getOrCreate(), from_json(SyncParams, args.params)
    if args.what == "upload":
        into = load(spark, args.into) if args.into else None
        save(sync.upload(read_files(spark, args.input), params, name=args.name, into=into, mode=args.mode), args.store, params.codec)
    elif args.what == "restore":
        write_files(sync.restore(load(spark, args.store)), args.output)
    elif args.what == "sync":
        done = sync.synchronise(load(spark, args.source), load(spark, args.target), params)
        save(done.target, args.result, params.codec)
        sync.statistics(done).orderBy("metric").show(50, truncate=False)
        sync.traffic(done).orderBy("phase").show(truncate=False)
    elif args.what == "stats":
        statistics(load(spark, args.store)).show(truncate=False)
    else:
        made = synthetic(spark, args.bytes, args.ratio, args.seed)
        made.select("file_id", F.col("content")).write.parquet(args.output)


if __name__ == "__main__":
    main()
