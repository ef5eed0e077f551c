"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITY = ("NON_SIMILAR", "SIMILAR", "BATCH_SIMILAR")
PAYLOADS = ("COMP_ONLY", "DELTA_ONLY", "DELTA_COMP")


def div_ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ordinal_id(n: Column, width: int = 8) -> Column:
    """An id of letters and digits that follows the ordinal, so results can be made again."""
    return F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), width, "0")


def mib_per_second(n_bytes: Column, seconds: Column) -> Column:
    return n_bytes / F.lit(1024.0 * 1024.0) / seconds


def ratio(logical: Column, stored: Column) -> Column:
    """Logical over stored, six digits; null if nothing is stored."""
    return F.round(logical.cast("double") / F.nullif(stored, F.lit(0)).cast("double"), 6)


def sampled_ratio(fp: Column, mean: float = 2.0, deviation: float = 0.25, low: float = 1.0) -> Column:
    """A compression ratio for a chunk known by fingerprint only: normal, drawn by the fingerprint; to one digit."""
    part = lambda k: (F.pmod(F.xxhash64(fp, F.lit(k)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    normal = F.sqrt(-2 * F.log(part(1))) * F.cos(2 * F.pi() * part(2))
    drawn = F.lit(mean) + F.lit(deviation) * normal
    return F.round(F.when(drawn <= low, drawn + 1).otherwise(drawn), 1)
