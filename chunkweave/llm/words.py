"""Words of a text and their 64-bit names, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of a 64-bit finaliser, and those that keep the two names of a pair apart.
MULTIPLY = np.array([0xD6E8FEB86659FD93, 0x9FB21C651E98DF25], dtype=np.uint64)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HALF = np.uint64(32)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D, which is where bytes.split() cuts; none for a null."""
    return text.split() if text else []


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> HALF)
    x *= MULTIPLY[0]
    x ^= x >> HALF
    x *= MULTIPLY[1]
    x ^= x >> HALF
    return x


def pair_names(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A name for each pair (a, b) of names; the same pair has the same name wherever and whenever it is made."""
    return mixed(a * LEFT + b * RIGHT + np.uint64(level))


def span_names(words: np.ndarray, width: int) -> np.ndarray:
    """Names of all spans of `width` words, built by doubling; as many as there are spans."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, have, built, done = words, 1, None, 0
    while True:
        if width & have:
            built = power[:n] if built is None else pair_names(built, power[done : done + n], 64 + done)
            done += have
        if have * 2 > width:
            return built
        power, have = pair_names(power[: len(power) - have], power[have:], have), have * 2
