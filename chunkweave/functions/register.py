"""The engine's functions under names for SQL."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.codecs import compress, decompress, delta, undelta
from chunkweave.functions.features import super_features
from chunkweave.functions.hashing import ZERO_KEY, murmur3_32, signed
from chunkweave.operators.chunking import cut_points
from chunkweave.params import ChunkParams


def _raw(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _each(kind: str, f, n: int = 1):
    """A function of n columns of bytes or text, row by row over Arrow batches; null if one of them is."""
    if n == 1:

        def of(a: pd.Series) -> pd.Series:
            return a.map(lambda x: None if x is None else f(_raw(x)))
    else:

        def of(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x if isinstance(x, str) else bytes(x), _raw(y)) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(of, kind)


def udtf(params: ChunkParams):
    """content_chunks(content): pos, offset, size, fp of each content-defined chunk."""

    @F.udtf(returnType="pos int, offset long, size int, fp string")
    class ContentChunks:
        def eval(self, content: bytes):
            ends = cut_points(bytes(content or b""), params)
            for pos, (a, b) in enumerate(zip([0, *ends], ends)):
                yield pos, a, b - a, hashlib.sha256(content[a:b]).hexdigest()

    return ContentChunks


def register(spark: SparkSession, prefix: str = "cw_", params: ChunkParams = ChunkParams()) -> list[str]:
    """Registers the functions with a session and returns their names; the table function is among them."""
    functions = {
        "hmac_sha3": _each("string", lambda x: hmac.new(ZERO_KEY, x, hashlib.sha3_256).hexdigest()),
        "xxh64": _each("long", lambda x: signed(xxhash.xxh64_intdigest(x))),
        "murmur3": _each("long", murmur3_32),
        "features": _each("array<long>", lambda x: [signed(f) for f in super_features([x])[0]]),
        "zstd": _each("binary", lambda x: compress(x, "zstd")[1]),
        "lz4": _each("binary", lambda x: compress(x, "lz4")[1]),
        "codec": _each("string", lambda x: compress(x, "zstd")[0]),
        "unpack": _each("binary", decompress, 2),
        "delta": _each("binary", delta, 2),
        "undelta": _each("binary", undelta, 2),
    }
    for name, f in functions.items():
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "content_chunks", udtf(params))
    return [prefix + n for n in (*functions, "content_chunks")]
