"""Fingerprints and what is computed from them. Fingerprints are lower-case hex strings."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_KEY = bytes(32)
PLAIN = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}


def fingerprint(data: Column, kind: str = "sha256") -> Column:
    """sha256, sha1 and md5 are built in; hmac_sha3 is the keyed one, under a key of zeros."""
    return hmac_sha3(data) if kind == "hmac_sha3" else PLAIN[kind](data)


def hmac_sha3(data: Column, key: bytes = ZERO_KEY) -> Column:
    """HMAC over SHA3-256, which Spark lacks."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, bytes(v), hashlib.sha3_256).hexdigest())

    return of(data)


def xxh64(data: Column, seed: int = 0) -> Column:
    """XXH64 as a signed long of the same bits; F.xxhash64 has another seed and hashes types, not bytes."""

    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else signed(xxhash.xxh64_intdigest(bytes(v), seed)))

    return of(data)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 for x86, 32 bits; the constants are the published ones."""
    c1, c2, mask, h = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF, seed
    words = len(data) // 4
    for i in range(words + 1):
        k = int.from_bytes(data[4 * i : 4 * i + 4], "little")
        k = k * c1 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * c2 & mask
        if i < words:
            h = (h << 13 | h >> 19) & mask
            h = (h * 5 + 0xE6546B64) & mask
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & mask
    return h ^ h >> 16


def murmur3_x64_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 for x64, 128 bits, as two halves; the constants are the published ones."""
    c1, c2, mask = 0x87C37B91114253D5, 0x4CF5AD432745937F, (1 << 64) - 1
    rotated = lambda x, n: (x << n | x >> (64 - n)) & mask
    mixed = lambda k, a, n, b: rotated(k * a & mask, n) * b & mask
    h = [seed, seed]
    for at in range(0, len(data) - 15, 16):
        low, high = (int.from_bytes(data[at + o : at + o + 8], "little") for o in (0, 8))
        h[0] = ((rotated(h[0] ^ mixed(low, c1, 31, c2), 27) + h[1]) * 5 + 0x52DCE729) & mask
        h[1] = ((rotated(h[1] ^ mixed(high, c2, 33, c1), 31) + h[0]) * 5 + 0x38495AB5) & mask
    tail = data[len(data) // 16 * 16 :]
    h[1] ^= mixed(int.from_bytes(tail[8:], "little"), c2, 33, c1)
    h[0] ^= mixed(int.from_bytes(tail[:8], "little"), c1, 31, c2)
    a, b = h[0] ^ len(data), h[1] ^ len(data)
    a = (a + b) & mask
    b = (a + b) & mask

    def final(k: int) -> int:
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ k >> 33) * by & mask
        return k ^ k >> 33

    a, b = final(a), final(b)
    a = (a + b) & mask
    return a, (a + b) & mask


def murmur3_x86_128(data: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    """MurmurHash3 for x86, 128 bits, as four words; the constants are the published ones."""
    mask = 0xFFFFFFFF
    multiply = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    turns, after, adds = (15, 16, 17, 18), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
    rotated = lambda x, n: (x << n | x >> (32 - n)) & mask
    mixed = lambda k, i: rotated(k * multiply[i] & mask, turns[i]) * multiply[(i + 1) % 4] & mask
    h = [seed] * 4
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        for i in range(4):
            h[i] ^= mixed(int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little"), i)
            h[i] = ((rotated(h[i], after[i]) + h[(i + 1) % 4]) * 5 + adds[i]) & mask
    for i in range(4):
        h[i] ^= mixed(int.from_bytes(data[whole + 4 * i : whole + 4 * i + 4], "little"), i)
    h = [x ^ len(data) for x in h]

    def spread(h: list[int]) -> list[int]:
        first = sum(h) & mask
        return [first, *((x + first) & mask for x in h[1:])]

    def final(k: int) -> int:
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            k = (k ^ k >> shift) * by & mask
        return k ^ k >> 16

    return tuple(spread([final(x) for x in spread(h)]))


def murmur3(data: Column, seed: int = 0) -> Column:
    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else murmur3_32(bytes(v), seed))

    return of(data)


def _hex_number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def byte_sum(fp: Column) -> Column:
    """The sum of a fingerprint's bytes."""
    at = F.sequence(F.lit(1), F.char_length(fp) - 1, F.lit(2))
    return F.aggregate(F.transform(at, lambda i: _hex_number(F.substr(fp, i, F.lit(2)))), F.lit(0).cast("long"), lambda a, x: a + x)


def is_hook(fp: Column, bits: int = 6) -> Column:
    """Whether the fingerprint's first bits, at most 8, are all zero."""
    return _hex_number(F.substring(fp, 1, 2)) < 1 << (8 - bits)


def little_u32(fp: Column, word: int) -> Column:
    """A fingerprint's bytes 4 word .. 4 word + 3 as a little-endian number."""
    start = 8 * word + 1
    return _hex_number(F.concat(*[F.substring(fp, start + k, 2) for k in (6, 4, 2, 0)]))


def token(fp: Column, key: Column) -> Column:
    """A keyed token: equal fingerprints have equal tokens, so tokens can be joined and looked up."""
    return F.sha2(F.concat(key, F.lit(":"), fp), 256)


def name_key(name: Column, client: Column) -> Column:
    """The key under which a client's recipe of a file name is kept."""
    return hmac_sha3(F.concat(name, F.lit("\x00"), client).cast("binary"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(digits: Column) -> Column:
    return F.unhex(digits)


def to_base64(data: Column) -> Column:
    return F.base64(data)


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def swapped(data: Column) -> Column:
    """The bytes in the other order."""
    digits = F.hex(data)
    at = F.sequence(F.char_length(digits) - 1, F.lit(1), F.lit(-2))
    whole = F.unhex(F.array_join(F.transform(at, lambda i: F.substr(digits, i, F.lit(2))), ""))
    return F.when(F.octet_length(data) == 0, data).otherwise(whole)


def little_u64(data: Column, at: int = 0) -> Column:
    """Eight bytes from `at` on as a little-endian number, a signed long of the same bits."""
    digits = F.hex(swapped(F.substring(data, at + 1, 8)))
    high, low = _hex_number(F.substring(digits, 1, 8)), _hex_number(F.substring(digits, 9, 8))
    return F.shiftleft(high, 32).bitwiseOR(low)


#: Ways to use AES; the length of the key, 16 or 32 bytes, makes it 128 or 256.
CIPHERS = ("GCM", "CBC", "CFB")
BLOCK = 16


def encrypt(data: Column, key: Column, mode: str = "GCM") -> Column:
    """AES; the nonce or first block is drawn at random and goes with the result. CFB is made of single blocks, as Spark lacks it."""
    if mode == "CFB":
        nonce = F.unhex(F.substring(F.md5(F.concat(F.uuid(), F.lit(""))), 1, 2 * BLOCK))
        return _cfb(data, key, nonce)
    return F.aes_encrypt(data, key, F.lit(_known(mode)), F.lit("DEFAULT"))


def decrypt(data: Column, key: Column, mode: str = "GCM") -> Column:
    if mode == "CFB":
        return _cfb_back(data, key)
    return F.aes_decrypt(data, key, F.lit(_known(mode)), F.lit("DEFAULT"))


def _known(mode: str) -> str:
    if mode not in CIPHERS:
        raise ValueError(f"no cipher mode is called {mode}")
    return mode


def _xor(a: Column, b: Column) -> Column:
    """Hex digits of two blocks of up to 16 bytes, of the length of a."""
    out = []
    for i in range(0, 2 * BLOCK, 8):
        x, y = (_hex_number(F.rpad(F.substring(v, i + 1, 8), 8, "0")) for v in (a, b))
        out.append(F.lpad(F.hex(x.bitwiseXOR(y)), 8, "0"))
    return F.substr(F.concat(*out), F.lit(1), F.char_length(a))


def _pad(block: Column, key: Column) -> Column:
    """The cipher of one block, as hex digits."""
    return F.substring(F.hex(F.aes_encrypt(F.unhex(block), key, F.lit("ECB"), F.lit("PKCS"))), 1, 2 * BLOCK)


def _blocks(data: Column) -> Column:
    digits = F.hex(data)
    starts = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.char_length(digits), F.lit(2 * BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(digits, i, F.lit(2 * BLOCK)))


def _cfb(data: Column, key: Column, nonce: Column) -> Column:
    start = F.struct(F.hex(nonce).alias("last"), F.hex(nonce).alias("all"))

    def step(state: Column, block: Column) -> Column:
        made = _xor(block, _pad(state["last"], key))
        return F.struct(made.alias("last"), F.concat(state["all"], made).alias("all"))

    return F.unhex(F.aggregate(_blocks(data), start, step)["all"])


def _cfb_back(data: Column, key: Column) -> Column:
    blocks = _blocks(data)
    plain = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b, i: _xor(b, _pad(F.element_at(blocks, i + 1), key)))
    return F.unhex(F.array_join(plain, ""))
