"""Rabin fingerprints and super-features of chunks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.functions.hashing import signed

#: The irreducible polynomial, the window in bytes, features a chunk, and how they are grouped.
POLYNOMIAL, WINDOW, FEATURES, GROUPS = 0xBFE6B8A5BF378D83, 48, 12, 4
PER_GROUP = FEATURES // GROUPS
DEGREE = POLYNOMIAL.bit_length() - 1
#: Chunks whose parts are gone through at once.
TOGETHER = 256


def times_power(x: int, bits: int) -> int:
    """x times a power of the variable, modulo the polynomial, over two-element numbers."""
    for _ in range(bits):
        x <<= 1
        if x >> DEGREE & 1:
            x ^= POLYNOMIAL
    return x


@lru_cache(maxsize=4)
def shift_tables(bits: int) -> np.ndarray:
    """For each of a number's eight bytes: what it becomes when the number is multiplied by a power of the variable."""
    powers = [times_power(1, bits + i) for i in range(64)]
    table = np.zeros((8, 256), np.uint64)
    for place in range(8):
        for byte in range(256):
            for b in range(8):
                if byte >> b & 1:
                    table[place, byte] ^= np.uint64(powers[8 * place + b])
    return table


def shifted(x: np.ndarray, bits: int) -> np.ndarray:
    parts = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)  # little-endian
    tables = shift_tables(bits)
    out = tables[0][parts[:, 0]]
    for k in range(1, 8):
        out ^= tables[k][parts[:, k]]
    return out


def rolling(raw: np.ndarray) -> np.ndarray:
    """The fingerprint after each byte of the window that ends there; bytes before the first are zero.

    The fingerprint is linear in the window's bytes, so that of a window twice as wide is that of its second half and, moved
    up, that of its first. Up to eight bytes a move is a shift; 48 bytes are 32 and 16.
    """
    f = raw.astype(np.uint64)
    for width in (1, 2, 4):
        longer = f.copy()
        longer[width:] ^= f[:-width] << np.uint64(8 * width)
        f = longer
    f ^= np.where(f >> np.uint64(DEGREE) != 0, np.uint64(POLYNOMIAL), np.uint64(0))
    eight, sixteen = f, f.copy()
    sixteen[8:] ^= shifted(eight[:-8], 64)
    longest = sixteen.copy()
    longest[16:] ^= shifted(sixteen[:-16], 128)
    last = longest.copy()
    last[32:] ^= shifted(sixteen[:-32], 256)
    return last


def super_features(chunks: list[bytes]) -> list[list[int]]:
    """Three 64-bit features of each chunk that survive small edits.

    A chunk is cut into twelve parts, the last with the rest. Of each part the largest fingerprint counts. Four groups of
    three in a row are sorted downwards; the first, second and third of all groups are hashed together. All parts of all
    chunks lie in one array, with room for a window of zeros before each.
    """
    lengths = np.array([len(c) for c in chunks], np.int64)
    part = lengths // FEATURES
    sizes = np.repeat(part, FEATURES)
    sizes[FEATURES - 1 :: FEATURES] += lengths - part * FEATURES
    starts = np.cumsum(sizes + WINDOW) - sizes
    room = np.zeros(int((sizes + WINDOW).sum()) + WINDOW, np.uint8)
    data = np.frombuffer(b"".join(chunks), np.uint8)
    room[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))] = data
    bounds = np.stack([starts, starts + sizes], axis=1).ravel()
    most = np.maximum.reduceat(rolling(room), bounds)[::2] if len(bounds) else np.empty(0, np.uint64)
    most[sizes == 0] = 0
    groups = np.sort(most.reshape(-1, GROUPS, PER_GROUP), axis=2)[:, :, ::-1]
    rows = np.ascontiguousarray(groups.transpose(0, 2, 1)).astype("<u8")
    return [[xxhash.xxh64_intdigest(x.tobytes(), 0) for x in row] for row in rows]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _features(values: pd.Series) -> pd.Series:
    out: list[list[int] | None] = [None] * len(values)
    has = [i for i, v in enumerate(values) if v is not None]
    for i in range(0, len(has), TOGETHER):
        part = has[i : i + TOGETHER]
        for k, row in zip(part, super_features([bytes(values.iloc[k]) for k in part])):
            out[k] = [signed(x) for x in row]
    return pd.Series(out, dtype=object)


def features(data: Column) -> Column:
    """super_features() of binary data, as signed longs of the same bits."""
    return _features(data)
