"""Sets of ids as tables, their algebra, runs and compact bitmaps, and a byte format for 32-bit id sets."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ids(rows: DataFrame, column: str = "value") -> DataFrame:
    """The distinct values of a column, as a set (value)."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("value")).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "value", "left_anti")


def members(a: DataFrame, candidates: DataFrame) -> DataFrame:
    """(value, member) for each candidate."""
    return candidates.join(a.withColumn("__in", F.lit(True)), "value", "left").select("value", F.coalesce("__in", F.lit(False)).alias("member"))


def cardinality(a: DataFrame) -> DataFrame:
    """(cardinality), one row, by bitmaps: values are marked in blocks of bits, so only one small row for a block is shuffled."""
    blocks = a.groupBy(F.bitmap_bucket_number("value").alias("block")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("value"))).alias("n"))
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cardinality"))


def runs(a: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(start, length) of each longest run of consecutive values.

    Runs are found within parts of the range of values, each a window of its own, then parts' first and last runs are
    joined up, of which there are few.
    """
    # whole numbers throughout: a division in doubles is wrong from 2**53 on
    parts = a.withColumn("at", F.pmod("value", F.lit(part).cast("long"))).withColumn("part", F.try_subtract("value", "at"))
    within = Window.partitionBy("part").orderBy("value")
    short = parts.withColumn("island", F.col("at") - F.row_number().over(within)).groupBy("part", "island").agg(F.min("value").alias("start"), F.max("value").alias("end"))
    edge = (F.pmod("start", F.lit(part).cast("long")) == 0) | (F.pmod("end", F.lit(part).cast("long")) == part - 1)
    across = Window.orderBy("start")
    joined = short.where(edge).withColumn("new", F.coalesce((F.lag("end").over(across) + 1 != F.col("start")).cast("int"), F.lit(1)))
    joined = joined.withColumn("run", F.sum("new").over(across)).groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return short.where(~edge).select("start", "end").unionByName(joined.select("start", "end")).select("start", (F.col("end") - F.col("start") + 1).alias("length"))


def ascending(a: DataFrame) -> DataFrame:
    """The set's values in order: ranges of values are sorted by themselves, so no task has them all."""
    return a.orderBy("value")


def bits_of(places: DataFrame, size: int, column: str = "value") -> DataFrame:
    """(bitmap), one row: a set of `size` bits, 0 up to size - 1, those of places set; the lowest bit of the first byte is 0."""
    if not 0 <= size <= 1 << 31:
        raise ValueError("a bitset has 0 to 2**31 bits")
    outside = ~F.col(column).between(0, size - 1)
    kept = places.where(F.col(column).isNotNull()).select(F.when(outside, F.raise_error(F.lit("a bit outside of the set")).cast("long")).otherwise(F.col(column).cast("long")).alias("v"))
    bytes_ = kept.groupBy(F.shiftright("v", 3).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("v") % 8).cast("int"))).alias("b"))
    return bytes_.agg(F.collect_list(F.struct("at", "b")).alias("held")).select(_bytes("held", (size + 7) // 8).alias("bitmap"))


def _bytes(held: str, n: int) -> Column:
    """A binary of n bytes from (at, b) pairs; bytes without one are 0."""
    at = F.map_from_entries(held)
    if not n:
        return F.lit(b"")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(at, i), F.lit(0))), 2, "0")), ""))


def with_bit(bitmap: Column | str, place: Column | int, on: bool = True) -> Column:
    """The binary column with a bit set or cleared; past the end it stays as it is."""
    bitmap, place = F.col(bitmap) if isinstance(bitmap, str) else bitmap, place if isinstance(place, Column) else F.lit(place)
    at = F.shiftright(place.cast("long"), 3).cast("int")
    old = F.conv(F.hex(F.substring(bitmap, at + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))
    new = old.bitwiseOR(mask) if on else old.bitwiseAND(F.bitwise_not(mask))
    end = F.octet_length(bitmap) - at - 1
    whole = F.concat(F.substring(bitmap, F.lit(1), at), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(bitmap, at + 2, F.greatest(end, F.lit(0))))
    return F.when((place < 0) | (end < 0), bitmap).otherwise(whole)


def cleared(bitmap: Column | str) -> Column:
    """The binary column with no bit set."""
    bitmap = F.col(bitmap) if isinstance(bitmap, str) else bitmap
    return F.unhex(F.repeat(F.lit("00"), F.octet_length(bitmap)))


def bits_set(bitmap: Column | str) -> Column:
    """The places of set bits, ascending, as an array."""
    bitmap = F.col(bitmap) if isinstance(bitmap, str) else bitmap
    all_bits = F.when(F.octet_length(bitmap) > 0, F.sequence(F.lit(0), 8 * F.octet_length(bitmap) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_bits, lambda i: bit(bitmap, i))


def bit(bitmap: Column | str, place: Column | int) -> Column:
    """Whether a bit of a binary column is set; the lowest bit of the first byte is 0, and past the end none is."""
    bitmap, place = F.col(bitmap) if isinstance(bitmap, str) else bitmap, place if isinstance(place, Column) else F.lit(place)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


# Fixed values of the byte format: kinds of chunks, and the most values that a list holds.
LIST, BITS, RUNS, LONGEST_LIST = 0, 1, 2, 4096


def to_bytes(values: np.ndarray | list[int], *, optimise: bool = False) -> bytes:
    """A set of unsigned 32-bit values: chunk count (u32), then for each upper half (u16) that occurs a kind (u8) and its lower halves.

    List: count (u32), values (u16). Bits: 8192 bytes. Runs: count (u32), then start and length less one (u16 each);
    with optimise, a chunk is runs where that is shorter. Little-endian throughout.
    """
    v = np.unique(np.asarray(values, np.uint32))
    out = []
    for high in np.unique(v >> 16):
        low = (v[v >> 16 == high] & 0xFFFF).astype("<u2")
        start = low[np.r_[True, np.diff(low.astype(int)) != 1]]
        end = low[np.r_[np.diff(low.astype(int)) != 1, True]]
        plain = 4 + 2 * len(low) if len(low) <= LONGEST_LIST else 8192
        out.append(struct.pack("<H", high))
        if optimise and 4 + 4 * len(start) < plain:
            out.append(struct.pack("<BI", RUNS, len(start)) + np.stack((start, end - start), axis=1).astype("<u2").tobytes())
        elif len(low) <= LONGEST_LIST:
            out.append(struct.pack("<BI", LIST, len(low)) + low.tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            out.append(bytes([BITS]) + np.packbits(bits, bitorder="little").tobytes())
    return struct.pack("<I", len(out) // 2) + b"".join(out)


def from_bytes(data: bytes) -> np.ndarray | None:
    """The values, ascending; None for bytes that aren't a whole set."""
    try:
        out, at = [np.zeros(0, np.uint32)], 4
        for _ in range(struct.unpack_from("<I", data)[0]):
            high, kind = struct.unpack_from("<HB", data, at)
            at += 3
            if kind == BITS:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            elif kind in (LIST, RUNS):
                n = struct.unpack_from("<I", data, at)[0]
                held = np.frombuffer(data, "<u2", n * (1 + (kind == RUNS)), at + 4).astype(np.int64)
                at += 4 + 2 * len(held)
                low = held if kind == LIST else np.concatenate([np.arange(s, s + n + 1) for s, n in held.reshape(-1, 2)] or [held])
            else:
                return None
            out.append((low.astype(np.int64) + (high << 16)).astype(np.uint32))
        return np.concatenate(out)
    except (struct.error, ValueError):
        return None


def encoded(a: DataFrame, *, optimise: bool = False) -> DataFrame:
    """(high, bytes): the set in the byte format, one row for each 65,536 ids; values outside of 32 bits fail."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"high": [int(pdf["value"].iloc[0]) >> 16], "bytes": [to_bytes(pdf["value"].to_numpy(np.int64), optimise=optimise)]})

    sound = F.when(F.col("value").between(0, (1 << 32) - 1), F.col("value")).otherwise(F.raise_error(F.lit("an id outside of 32 bits")).cast("long"))
    return a.select(sound.alias("value")).withColumn("h", F.shiftright("value", 16)).groupBy("h").applyInPandas(pack, "high long, bytes binary")


def decoded(rows: DataFrame, column: str = "bytes") -> DataFrame:
    """(value) of sets in the byte format; bytes that aren't a set give nothing."""
    @F.pandas_udf("array<long>")
    def values(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None or (v := from_bytes(bytes(d))) is None else v.astype(np.int64))

    return rows.select(F.explode(values(column)).alias("value")).distinct()
