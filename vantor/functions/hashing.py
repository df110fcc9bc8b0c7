"""Hashes, checksums and text encodings of bytes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.functions.distance import _column

_FULL = (1 << 64) - 1
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

# The secret and the multiplier of the 128-bit hash.
_SECRET = bytes.fromhex("""
b8fe6c3923a44bbe7c01812cf721ad1c ded46de9839097db7240a4a4b7b3671f cb79e64eccc0e578825ad07dccff7221
b8084674f743248ee03590e6813a264c 3c2852bb91c300cb88d0658b1b532ea3 71644897a20df94e3819ef46a9deacd8
a8fa763fe39c343ff9dcbbc7c70b4f1d 8a51e04bcdb45931c89f7ec9d9787364 eac5ac8334d3ebc3c581a0fffa1363eb
170ddd51b7f0da49d316552629d4689e 2b16be587d47a1fc8ff8b8d17ad031ce 45cb3a8f95160428afd7fbcabb4b407e
""")
_SPREAD = 0x165667919E3779F9


def _unxorshift(h: int, n: int) -> int:
    out = h
    for _ in range(64 // n):
        out = h ^ (out >> n)
    return out


def _reseed(seed: int) -> int:
    """The long whose hash under Spark's seed 42 is `seed`: XXH64 of eight bytes run backwards."""
    h = _unxorshift(seed & _FULL, 32)
    h = _unxorshift(h * pow(_P3, -1, 1 << 64) & _FULL, 29)
    h = _unxorshift(h * pow(_P2, -1, 1 << 64) & _FULL, 33)
    h = (h - _P4) * pow(_P1, -1, 1 << 64) & _FULL
    h = (h >> 27 | h << 37) & _FULL
    h ^= 42 + _P5 + 8 & _FULL
    h = h * pow(_P1, -1, 1 << 64) & _FULL
    h = (h >> 31 | h << 33) & _FULL
    h = h * pow(_P2, -1, 1 << 64) & _FULL
    return h - (1 << 64) if h >> 63 else h


def xxhash64(data: Column | str, seed: int = 0) -> Column:
    """Standard XXH64 of a string's or binary's bytes, or of a long's eight little-endian ones, as a signed long.

    Spark's function always starts from seed 42 but hands each argument's hash to the next as its seed, so a first
    argument that hashes to the wanted seed sets it; no Python is involved.
    """
    data = _column(data)
    return F.when(data.isNotNull(), F.xxhash64(F.lit(_reseed(seed)).cast("long"), data))


def shard(key: Column | str, shards: int) -> Column:
    """XXH64 of the id, unsigned, modulo the number of shards."""
    h = xxhash64(_column(key).cast("long"))
    return ((F.pmod(h, F.lit(shards)) + F.when(h < 0, (1 << 64) % shards).otherwise(0)) % shards).cast("int")


def sha256(data: Column | str) -> Column:
    return F.sha2(_column(data).cast("binary"), 256)


def base64url(data: Column | str) -> Column:
    """URL alphabet, no padding."""
    return F.translate(F.base64(_column(data).cast("binary")), "+/=\r\n", "-_")


def unbase64url(text: Column | str) -> Column:
    """Bytes; NULL for characters outside of the alphabet or an impossible length."""
    text = _column(text)
    rest = F.length(text) % 4
    sound = text.rlike("^[A-Za-z0-9_-]*$") & (rest != 1)
    return F.when(sound, F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), (4 - rest) % 4))))


def _crc_table() -> np.ndarray:
    """The Castagnoli polynomial, reflected."""
    return np.array([reduce(lambda c, _: c >> 1 ^ (0x82F63B78 if c & 1 else 0), range(8), i) for i in range(256)], np.uint32)


_CRC = _crc_table()


def crc32c_bytes(data: list[bytes], start: np.ndarray | None = None) -> np.ndarray:
    """Checksums of many byte strings at once: a step of the loop takes one byte of each that is still that long."""
    sizes = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, first = np.frombuffer(b"".join(data[i] for i in order), np.uint8), np.cumsum(sizes[order]) - sizes[order]
    crc = ~(np.zeros(len(data), np.uint32) if start is None else start.astype(np.uint32)[order])
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes[order], -i, side="left"))
        crc[:n] = crc[:n] >> np.uint32(8) ^ _CRC[(crc[:n] ^ flat[first[:n] + i]) & np.uint32(255)]
    out = np.empty(len(data), np.uint32)
    out[order] = ~crc
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of a binary column, unsigned."""
    known = data.notna()
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    if known.any():
        out[known] = crc32c_bytes([bytes(d) for d in data[known]]).astype(np.int64)
    return out


@F.pandas_udf(T.LongType())
def crc32c_combine(crc: pd.Series, data: pd.Series) -> pd.Series:
    """The checksum of what crc is of, followed by data."""
    known = data.notna() & crc.notna()
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    if known.any():
        out[known] = crc32c_bytes([bytes(d) for d in data[known]], crc[known].to_numpy(np.int64)).astype(np.int64)
    return out


def _word(data: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(data[at : at + size], "little")


def _spread(h: int) -> int:
    h ^= h >> 37
    h = h * _SPREAD & _FULL
    return h ^ h >> 32


def _fold(a: int, b: int) -> int:
    product = a * b
    return (product >> 64 ^ product) & _FULL


def _pair(k: int, size: int = 8) -> int:
    """Two neighbouring words of the secret, from word k on, exclusive-or."""
    return _word(_SECRET, size * k, size) ^ _word(_SECRET, size * (k + 1), size)


def hash128_bytes(data: bytes, seed: int = 0) -> tuple[int, int]:
    """(low, high) of the two-lane 128-bit hash; not the standard XXH3, though its secret is the same kind."""
    n = len(data)
    plus, minus = (lambda v: v + seed & _FULL), (lambda v: v - seed & _FULL)
    swapped = lambda v: int.from_bytes(v.to_bytes(8, "little"), "big")
    if n > 16:
        lanes = [seed ^ _word(_SECRET, 0), seed ^ _word(_SECRET, 8)]
        # whole stripes with a running part of the secret, then the last sixteen bytes with its first
        for at, part in [(16 * i, i % 22) for i in range(n // 16)] + [(n - 16, 0)]:
            x, y = _word(data, at) ^ _word(_SECRET, 8 * part), _word(data, at + 8) ^ _word(_SECRET, 8 * part + 8)
            lanes = [lanes[0] + _fold(x, y ^ _P1) & _FULL, lanes[1] + _fold(y, x ^ _P2) & _FULL]
        return _spread(lanes[0] + n & _FULL), _spread(lanes[1] - n & _FULL)
    if n > 8:
        x, y, one, two = _word(data, 0), _word(data, n - 8), _pair(6), _pair(8)
        return tuple(_spread(_fold(x ^ plus(p), y ^ minus(q)) ^ n) for p, q in ((one, two), (two, one)))
    if n > 3:
        x = _word(data, 0, 4) | _word(data, n - 4, 4) << 32
        return _spread(minus(_pair(0)) ^ swapped(x) ^ n), _spread(plus(_pair(2)) ^ x ^ n)
    if n:
        x = data[0] | data[n // 2] << 8 | data[-1] << 16 | n << 24
        return _spread(plus(_pair(0, 4)) + swapped(x) & _FULL), _spread(minus(_pair(2, 4)) ^ x)
    return (_spread(seed ^ _pair(8)),) * 2


def hash128(data: Column | str, seed: int = 0) -> Column:
    """Thirty-two hexadecimal digits, high half first."""

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else "{1:016x}{0:016x}".format(*hash128_bytes(bytes(d), seed)))

    return run(_column(data).cast("binary"))
