"""Media columns: lossless WebP in and out of binary columns.

The decoder takes any VP8L stream: prefix codes in groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. The encoder writes a palette where an image has few colours,
back-references to the last place with the same pixels, a colour cache where that is shorter, and prefix codes from
histograms. Images too small to gain from codes of their own get eight-bit ones, which are read as whole arrays; all
others are read symbol by symbol.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import chunks, small_batches

# Fixed values of the WebP lossless bitstream specification.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
CACHE_FACTOR, SIGNATURE, SIDE, LONGEST_CODE = 0x1E35A7BD, 0x2F, 1 << 14, 15

#: Pixels in a row of the images that hold payloads, and bytes of such a row.
ROW = 64
ROW_BYTES = 3 * ROW


class Bits:
    """Reads from the lowest bit of each byte on; past the end there are zeros, and over() tells."""

    def __init__(self, data: bytes) -> None:
        self.value, self.size, self.at, self.data = 0, 0, 0, data

    def peek(self, n: int) -> int:
        if self.size < n:
            self.value |= int.from_bytes(self.data[self.at : self.at + 64], "little") << self.size
            self.at += 64
            self.size += 512
        return self.value & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.value >>= n
        self.size -= n
        return out

    def place(self) -> int:
        """Bits read so far."""
        return 8 * self.at - self.size

    def go(self, place: int) -> None:
        """Reads on from a place."""
        self.value, self.size, self.at = 0, 0, place >> 3
        self.read(place & 7)

    def over(self) -> bool:
        return self.place() > 8 * len(self.data)


@lru_cache(maxsize=16)
def mirrored(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


@lru_cache(maxsize=16)
def mirrored_list(n: int) -> list[int]:
    return mirrored(n).tolist()


#: Codes of at most so many symbols and bits are made without arrays, which only gain on longer ones.
FEW, SHORT = 24, 8


class Code:
    """A canonical prefix code; codes come highest bit first in a stream that is read lowest bit first.

    used: the symbols that have a code, in ascending order; sizes: their lengths. array and table hold
    symbol * 16 + length for each value of the next `most` bits.
    """

    def __init__(self, used: list[int], sizes: list[int]) -> None:
        if not used:
            raise ValueError("a prefix code without symbols")
        self.flat = len(used) == 256 and used[-1] == 255 and min(sizes) == max(sizes) == 8  # each byte is its own code
        self.most = max(sizes) if len(used) > 1 else 0
        if not self.most:
            self.natural = [used[0] << 4]
            return
        most = self.most
        if most > LONGEST_CODE or sum([1 << (most - n) for n in sizes]) != 1 << most:
            raise ValueError("a prefix code that isn't complete")
        if len(used) <= FEW and most <= SHORT:
            self.natural = []
            for n, s in sorted(zip(sizes, used, strict=True)):
                self.natural += [s << 4 | n] * (1 << (most - n))
            return
        symbols, lengths = np.array(used, np.int64), np.array(sizes, np.int64)
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        self.natural = np.repeat(symbols[order] << 4 | lengths, 1 << (most - lengths))

    @cached_property
    def array(self) -> np.ndarray:
        return np.asarray(self.natural, np.int64)[mirrored(self.most)]

    @cached_property
    def table(self) -> list[int]:
        return [self.natural[i] for i in mirrored_list(self.most)] if isinstance(self.natural, list) else self.array.tolist()

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek(self.most)]
        if found & 15:
            bits.read(found & 15)
        return found >> 4


REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8), bitorder="little"))
REVERSED_LIST = REVERSED.tolist()


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size or len(set(symbols)) < len(symbols):
            raise ValueError("a symbol outside of its alphabet, or twice")
        return Code(sorted(symbols), [1] * len(symbols))
    n = 4 + bits.read(4)
    packed = bits.read(3 * n)
    own = sorted([(LENGTH_ORDER[i], x) for i in range(n) if (x := packed >> 3 * i & 7)])
    code = Code([s for s, _ in own], [x for _, x in own])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table = code.table
    if not code.most and table[0] >> 4 < 16:  # one length for all
        n = min(left, size) if table[0] >> 4 else 0
        return Code(list(range(n)), [table[0] >> 4] * n)
    used, sizes, at, last, mask, data, place, value, have = [], [], 0, 8, (1 << code.most) - 1, bits.data, bits.place(), 0, 0
    for _ in range(left):
        if at >= size:
            break
        if have < 14:  # a symbol takes up to seven bits and as many extra ones
            value, have = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7), 57
        s = table[value & mask]
        n = s & 15
        s >>= 4
        if s < 16:
            if s:
                used.append(at)
                sizes.append(s)
                last = s
            at += 1
        else:
            rest = value >> n
            run, extra = (3 + (rest & 3), 2) if s == 16 else (3 + (rest & 7), 3) if s == 17 else (11 + (rest & 127), 7)
            n += extra
            if at + run > size:
                raise ValueError("code lengths beyond their alphabet")
            if s == 16:
                used.extend(range(at, at + run))
                sizes.extend([last] * run)
            at += run
        place += n
        value >>= n
        have -= n
    bits.go(place)
    return Code(used, sizes)


def prefixed(bits: Bits, code: int) -> int:
    """A length or distance from its prefix code."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    """How far back a copy begins, in pixels."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, *, main: bool) -> np.ndarray:
    """Pixels as 32-bit ARGB, before transforms are inverted."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups, size_bits, choice = 1, 0, None
    if main and bits.read(1):
        size_bits = bits.read(3) + 2
        choice = ((read_image(bits, -(-width >> size_bits), -(-height >> size_bits), main=False) >> 8) & 0xFFFF).tolist()
        groups = max(choice) + 1
    codes = [[read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache and all(c.flat for c in codes[0][:3]) and not codes[0][3].most:
        return flat_pixels(bits, total, codes[0][3].table[0] >> 4)
    if groups == 1 and not codes[0][3].most:
        place = bits.place()
        if (px := read_pixels(bits, codes[0], total, width, cache_bits)) is not None:
            return px
        bits.go(place)
    out, at, per_row = [0] * total, 0, -(-width >> size_bits)
    shift = 32 - cache_bits
    while at < total:
        if bits.over():
            raise ValueError("the stream ends before the image")
        g, r, b, a, d = codes[choice[(at // width >> size_bits) * per_row + (at % width >> size_bits)] if choice else 0]
        s = g.read(bits)
        if s < 256:
            red, blue, alpha = r.read(bits), b.read(bits), a.read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n, far = prefixed(bits, s - 256), distance(prefixed(bits, d.read(bits)), width)
            if far > at or at + n > total:
                raise ValueError("a back-reference outside of the image")
            piece = out[at - far : at] if far < n else out[at - far : at - far + n]
            new = (piece * (n // len(piece) + 1))[:n]
        else:
            new = [cache[s - 280]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    if bits.over():
        raise ValueError("the stream ends before the image")
    return np.array(out, np.uint32)


#: Bytes of a stream that are looked at together, and the places of their bits and of a few more.
STREAM_BLOCK = 4096
PLACES = np.arange(8 * STREAM_BLOCK + 64)
#: A symbol's length that leads out of any block.
OUT = 1 << 32


def read_pixels(bits: Bits, codes: list[Code], total: int, width: int, cache_bits: int) -> np.ndarray | None:
    """Pixels of an image with one group of codes and one alpha value; None if it reads empty entries of the cache.

    For each bit of a block of the stream, arrays hold where the next symbol would begin if a green, red or blue one
    began there; chained, they hold where the next operation would begin. Following these places from the first one
    gives the operations that there are, and only theirs are looked up.
    """
    most = max(c.most for c in codes[:3])
    green, red, blue = (np.tile(c.array, 1 << (most - c.most)) for c in codes[:3])
    opaque = np.uint32(codes[3].table[0] >> 4 << 24)
    place, ends = bits.place(), 8 * len(bits.data)
    if not most and not 4096 <= green[0] < 4480:  # a symbol that takes no bits: one pixel throughout, or the empty cache's
        colour = opaque | np.uint32((red[0] >> 4) << 16 | (green[0] >> 4) << 8 | blue[0] >> 4)
        return np.full(total, colour if green[0] < 4096 else 0, np.uint32)
    steps = green & 15
    steps[(green >= 4096) & (green < 4480)] = OUT  # copies
    red_steps, blue_steps = red & 15, blue & 15
    cached = green >= 4480 if cache_bits else None
    data = np.frombuffer(bits.data + bytes(STREAM_BLOCK + 16), np.uint8)
    colours, symbols, copies, singles, free = [], [], [], 0, total  # copies: (single pixels before it, size, distance)
    while free:
        first = place >> 3
        size = min(STREAM_BLOCK, len(bits.data) - first + 1)
        if size < 1:
            raise ValueError("the stream ends before the image")
        raw = data[first : first + size + 10].astype(np.int64)
        raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        window = np.empty((len(raw), 8), np.int64)
        np.right_shift(raw[:, None], PLACES[:8], out=window)
        window &= (1 << most) - 1
        window = window.ravel()
        limit = 8 * size
        n = len(window)
        # entries of the cache have no red and blue: their steps lead to a second range of places, and that back to the first
        after_green = (steps + n * cached if cache_bits else steps).take(window[:limit])
        after_green += PLACES[:limit]
        after_red, after_blue = (np.empty(2 * n if cache_bits else n, np.int64) for _ in range(2))
        np.add(red_steps.take(window), PLACES[:n], out=after_red[:n])
        np.add(blue_steps.take(window), PLACES[:n], out=after_blue[:n])
        if cache_bits:
            np.add(PLACES[:n], n, out=after_red[n:])
            after_blue[n:] = PLACES[:n]
        after_red[-1], after_blue[-1] = OUT, -1  # where a copy's step leads; symbols that begin in the block end before
        ends_at = after_blue.take(after_red.take(after_green, mode="clip"), mode="clip")
        following = memoryview(ends_at)
        found, here = [], place - 8 * first
        while here < limit:
            while 0 <= here < limit:
                found.append(here)
                here = following[here]
            if len(found) - (here < 0) >= free:  # what follows the last pixel isn't of the image
                here = found[free] if len(found) > free else here
                break
            if here < 0:
                copy = found.pop()
                symbol = int(green[window[copy]])
                bits.go(8 * first + copy + (symbol & 15))
                size, far = prefixed(bits, (symbol >> 4) - 256), distance(prefixed(bits, codes[4].read(bits)), width)
                here = bits.place() - 8 * first
                if far > total - free + len(found) or len(found) + size > free:
                    raise ValueError("a back-reference outside of the image")
                copies.append((singles + len(found), size, far))
                free -= size
                if len(found) == free:
                    break
        place = 8 * first + here
        some = np.array(found[:free], np.int64)
        g = green[window[some]]
        some += g & 15
        r = red[window[some]]
        some += r & 15
        b = blue[window[some]]
        entries = g >> 4
        symbols.append(entries)
        colours.append(opaque | ((r >> 4) << 16 | (entries & 255) << 8 | b >> 4).astype(np.uint32))
        singles += len(some)
        free -= len(some)
    if place > ends:
        raise ValueError("the stream ends before the image")
    bits.go(place)
    return resolved(np.concatenate(symbols), np.concatenate(colours), copies, total, cache_bits)


def resolved(symbols: np.ndarray, colours: np.ndarray, copies: list[tuple[int, int, int]], total: int, cache_bits: int) -> np.ndarray | None:
    """Pixels, of the symbols and colours of single ones and of copies (single pixels before it, size, distance).

    None if an entry is empty: its pixel then goes to another entry than it came from.

    Each pixel that has no colour of its own has that of an earlier one: a copy's of the one so far back, an entry's of
    the last one with its key, be that single or copied. Following these to their ends needs as many rounds as the
    logarithm of the longest chain.
    """
    hit = symbols >= 280
    if not copies and not hit.any():
        return colours
    before, size, far = np.array(copies, np.int64).reshape(-1, 3).T
    at = before + np.cumsum(size) - size
    edges = np.zeros(total + 1, np.int64)
    edges[at] += 1
    edges[at + size] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    single, copied = np.flatnonzero(~covered), np.flatnonzero(covered)
    values, source = np.zeros(total, np.uint32), np.arange(total)
    values[single] = colours
    source[copied] = copied - np.repeat(far, size)
    if hit.any():
        keys = np.zeros(total, np.uint16)
        keys[single] = np.where(hit, symbols - 280, colours * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits))
        hits = single[hit]
        last = last_equal(keys[followed(source)] if copies else keys)[hits]
        if (last < 0).any():
            return None
        source[hits] = last
    return values[followed(source)]


def followed(source: np.ndarray) -> np.ndarray:
    """For each place the last one that its source, the source of that, and so on lead to."""
    while True:
        source, before = source[source], source
        if np.array_equal(source, before):
            return source


def flat_pixels(bits: Bits, total: int, alpha: int) -> np.ndarray:
    """Pixels of three eight-bit codes each."""
    start, shift = divmod(bits.place(), 8)
    raw = np.frombuffer(bits.data, np.uint8, min(3 * total + 1, len(bits.data) - start), start)
    if 8 * len(raw) < 24 * total + shift:
        raise ValueError("the stream ends before the image")
    if shift:
        raw = raw[:-1] >> shift | raw[1:] << (8 - shift)
    px = REVERSED[raw[: 3 * total]].reshape(total, 3).astype(np.uint32)
    bits.value = bits.size = 0
    bits.at = start + 3 * total
    return np.uint32(alpha << 24) | px[:, 1] << 16 | px[:, 0] << 8 | px[:, 2]


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) signed values in the order alpha, red, green, blue."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def joined(parts: np.ndarray) -> np.ndarray:
    p = (parts & 0xFF).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predicted(mode: int, left, top, corner, right) -> list[int]:
    """A pixel's prediction by channels; right: the pixel above and to the right."""
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 5:
        return mean(mean(left, right), top)
    if mode < 10:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]


def inverse_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, size_bits: int) -> np.ndarray:
    rest, per_row = channels(argb).tolist(), -(-width >> size_bits)
    modes, out = ((modes >> 8) & 0xF).tolist(), []
    for at, add in enumerate(rest):
        y, x = divmod(at, width)
        if at == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = out[at - 1]
        elif x == 0:
            p = out[at - width]
        else:
            p = predicted(modes[(y >> size_bits) * per_row + (x >> size_bits)], out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
        out.append([(v + w) & 0xFF for v, w in zip(p, add, strict=True)])
    return joined(np.array(out, np.int32).reshape(-1, 4))


def inverse_cross_colour(argb: np.ndarray, width: int, height: int, factors: np.ndarray, size_bits: int) -> np.ndarray:
    at = np.arange(width * height)
    f = channels(factors)[(at // width >> size_bits) * (-(-width >> size_bits)) + (at % width >> size_bits)].astype(np.int8).astype(np.int32)
    p = channels(argb)
    signed = lambda v: (v & 0xFF).astype(np.int8).astype(np.int32)
    p[:, 1] += f[:, 3] * signed(p[:, 2]) >> 5
    p[:, 3] += (f[:, 2] * signed(p[:, 2]) >> 5) + (f[:, 1] * signed(p[:, 1]) >> 5)
    return joined(p)


def inverse_palette(argb: np.ndarray, width: int, height: int, table: np.ndarray, width_bits: int) -> np.ndarray:
    index = (argb >> 8 & 0xFF).reshape(height, -1)
    if width_bits:
        depth = 8 >> width_bits
        x = np.arange(width)
        index = index[:, x >> width_bits] >> ((x & ((1 << width_bits) - 1)) * depth).astype(np.uint32) & ((1 << depth) - 1)
    full = np.zeros(256, np.uint32)  # indices beyond the table are transparent black
    full[: len(table)] = table
    return full[index].ravel()


@dataclass
class Image:
    width: int
    height: int
    argb: np.ndarray

    def rgb(self) -> np.ndarray:
        """Samples (height, width, 3)."""
        return np.ascontiguousarray(self.argb.astype("<u4", copy=False).view(np.uint8).reshape(self.height, self.width, 4)[:, :, 2::-1])


def decode(data: bytes) -> Image:
    """A whole file: RIFF container with one VP8L chunk. Anything else is a ValueError."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen, wide = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            n = bits.read(3) + 2
            undo.append((inverse_cross_colour if kind else inverse_predictor, wide, read_image(bits, -(-wide >> n), -(-height >> n), main=False), n))
        elif kind == 2:
            undo.append((None, wide, None, 0))
        else:
            n = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_image(bits, n, 1, main=False)), axis=0))
            n = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((inverse_palette, wide, table, n))
            wide = -(-wide >> n)
    argb = read_image(bits, wide, height, main=True)
    for f, w, extra, n in reversed(undo):
        if f:
            argb = f(argb, w, height, extra, n)
        else:
            p = channels(argb)
            p[:, 1] += p[:, 2]
            p[:, 3] += p[:, 2]
            argb = joined(p)
    return Image(width, height, argb)


def _head() -> tuple[int, int]:
    """Bits between the version and the pixels, and how many: no transform, cache or groups; three flat codes; alpha 255; distance 0."""
    value = size = 0

    def put(v: int, n: int) -> None:
        nonlocal value, size
        value, size = value | v << size, size + n

    put(0, 3)
    for part in ("green", "red", "blue"):
        put(0, 1)
        put(8, 4)  # twelve code lengths: all 0 but that of symbol 8, the last
        for s in LENGTH_ORDER[:12]:
            put(int(s == 8), 3)
        if part == "green":  # only its first 256 symbols are used
            put(1, 1)
            put(3, 3)
            put(254, 8)
        else:
            put(0, 1)
    put(0b101, 3)
    put(255, 8)
    put(0b0001, 4)
    return value, size


HEAD, HEAD_BITS = _head()


#: Images that are coded together at most, and their pixels unless one alone has more.
TOGETHER, PIXELS_TOGETHER = 64, 1 << 17


def encode(rgb: np.ndarray) -> bytes:
    """A whole file from samples (height, width, 3)."""
    return encode_many([rgb])[0]


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """A whole file for each image's samples (height, width, 3). Images are coded together but don't share codes."""
    out, plans, pixels = [], [], 0
    for i, rgb in enumerate(images):
        height, width, _ = rgb.shape
        if not (0 < width <= SIDE and 0 < height <= SIDE):
            raise ValueError("an image has 1 to 16384 pixels each way")
        parts = np.full((height * width, 4), 255, np.uint8)
        parts[:, 2::-1] = rgb.reshape(-1, 3)
        px = parts.view("<u4").ravel().astype(np.uint32, copy=False)
        plans.append(plan(px, width, height))
        pixels += len(px)
        if len(plans) == TOGETHER or pixels >= PIXELS_TOGETHER or i + 1 == len(images):
            coded = iter(write([p for p in plans if p]))
            group = images[i + 1 - len(plans) : i + 1]
            out += [riff(next(coded) if p else flat(x, x.shape[1], x.shape[0])) for p, x in zip(plans, group, strict=True)]
            plans, pixels = [], 0
    return out


def riff(data: bytes) -> bytes:
    """The container around a stream."""
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def flat(rgb: np.ndarray, width: int, height: int) -> bytes:
    """The image with eight-bit codes."""
    head = SIGNATURE | (width - 1) << 8 | (height - 1) << 22 | HEAD << 40
    size, shift = divmod(40 + HEAD_BITS, 8)
    raw = REVERSED[rgb.reshape(-1, 3)[:, [1, 0, 2]].ravel()]
    body = np.zeros(len(raw) + 1, np.uint8)
    body[:-1] = raw << shift
    if shift:
        body[1:] |= raw >> (8 - shift)
    first = head.to_bytes(size + 1, "little")
    body[0] |= first[-1]
    return first[:-1] + (body if shift else body[:-1]).tobytes()


class BitWriter:
    """Writes from the lowest bit of each byte on. Fields wait until they are many, and are then put into bytes at once."""

    def __init__(self) -> None:
        self.value, self.size, self.done, self.waiting, self.held, self.total = 0, 0, [], [], 0, 0

    def put(self, value: int, n: int) -> None:
        """A field of up to 63 bits."""
        if not (self.waiting and isinstance(self.waiting[-1][0], list)):
            self.waiting.append(([], []))
        values, sizes = self.waiting[-1]
        values.append(value)
        sizes.append(n)
        self.total += n

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Fields of up to 63 bits each, in order."""
        self.waiting.append((values, sizes))
        self.held += len(values)
        self.total += int(sizes.sum())
        if self.held >= OPERATIONS:
            self.flush()

    def align(self) -> int:
        """Zeros up to a whole byte; gives how many bytes there are."""
        if self.total % 8:
            self.put(0, -self.total % 8)
        return self.total // 8

    def flush(self) -> None:
        if not self.waiting:
            return
        values, sizes = (np.concatenate(x).astype(np.int64, copy=False) for x in zip(*self.waiting, strict=True))
        ends = np.cumsum(sizes) + self.size
        total = int(ends[-1])
        place = ends - sizes
        word, shift, values = place >> 6, (place & 63).astype(np.uint64), values.astype(np.uint64)
        edges = np.flatnonzero(word[1:] != word[:-1])  # each word but the last has a field that begins there
        first, last = np.concatenate(([0], edges + 1)), np.append(edges, len(word) - 1)
        words = np.zeros(total // 64 + 2, np.uint64)
        words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        words[word[last] + 1] |= values[last] >> np.uint64(1) >> (np.uint64(63) - shift[last])
        words[0] |= np.uint64(self.value)
        data = words.astype("<u8", copy=False).tobytes()
        self.done.append(data[: total // 8])
        self.value, self.size, self.waiting, self.held = data[total // 8] & ((1 << total % 8) - 1), total % 8, [], 0

    def bytes(self) -> bytes:
        self.flush()
        return b"".join(self.done) + self.value.to_bytes((self.size + 7) // 8, "little")


#: Lengths of codes that the encoder writes, of those for the pixels and of those for their own lengths.
MOST_BITS, MOST_OWN = 12, 7
LENGTH_PLACES, EXTRA_BITS = np.array(LENGTH_ORDER), np.array([0] * 16 + [2, 3, 7])
#: Pixels that a copy has at least and at most, how far back it lies at most, and operations written at a time.
LEAST_COPY, MOST_COPY, FARTHEST, OPERATIONS = 4, 4096, (1 << 20) - 120, 1 << 16


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code, none above `most`: each symbol's information rounded up, then shortened where that was most."""
    return lengths_of(counts, np.array([0, len(counts)]), most)


def lengths_of(counts: np.ndarray, borders: np.ndarray, most: int) -> np.ndarray:
    """code_lengths of each table of counts that ends at a border."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    held, ends = counts[used], np.searchsorted(used, borders)
    before = np.concatenate(([0], np.cumsum(held)))[ends]
    ideal = np.log2(np.repeat(np.diff(before), np.diff(ends)) / held)
    size = np.clip(np.ceil(ideal), 1, most).astype(np.int64)
    left = (1 << most) - np.diff(np.concatenate(([0], np.cumsum(1 << (most - size))))[ends])
    for t in np.flatnonzero((left != 0) & (np.diff(ends) > 1)).tolist():
        a, b = ends[t], ends[t + 1]
        size[a:b] = completed(ideal[a:b].tolist(), size[a:b].tolist(), held[a:b], int(left[t]), most)
    out[used] = size
    return out


def completed(ideal: list[float], size: list[int], held: np.ndarray, left: int, most: int) -> list[int]:
    """Lengths of a code whose shares leave `left` of a whole, or pass it, changed so that they make a whole."""
    if left < 0:  # too many at the longest length: the rarest of the others give way
        for i in np.argsort(held, kind="stable").tolist():
            while left < 0 and size[i] < most:
                size[i] += 1
                left += 1 << (most - size[i])
            if left >= 0:
                break
    order = sorted(range(len(size)), key=[x - n for x, n in zip(ideal, size, strict=True)].__getitem__) if left else ()
    while left:
        for i in order:
            if size[i] > 1 and (unit := 1 << (most - size[i])) <= left:
                size[i] -= 1
                left -= unit
                if not left:
                    break
    return size


def codes_of(lengths: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The canonical codes, as they stand in the stream, of some tables of code lengths, each of which ends at a border."""
    used = np.flatnonzero(lengths)
    ranks = 16 * (np.searchsorted(borders, used, "right") - 1) + lengths[used]
    used = used[np.argsort(ranks.astype(np.uint16 if 16 * len(borders) < 1 << 16 else np.int64), kind="stable")]
    share = 1 << (MOST_BITS - lengths[used])
    out = np.zeros(len(lengths), np.int64)
    # the shares of a complete code add up to a whole, so each code begins at zero again
    out[used] = mirrored(MOST_BITS)[(np.cumsum(share) - share) & ((1 << MOST_BITS) - 1)]
    return out


def runs_of(lengths: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, extra values, ends) of stretches of code lengths, each of which ends at a border, with runs as repeats; ends: where a stretch's symbols end."""
    breaks = lengths[1:] != lengths[:-1]
    breaks[borders[:-1] - 1] = True
    starts = np.concatenate(([0], np.flatnonzero(breaks) + 1))
    value = lengths[starts]
    zero = value == 0
    lead = (~zero).astype(np.int64)  # a length comes itself before its repeats, a zero doesn't
    whole, rest = np.divmod(np.diff(starts, append=len(lengths)) - lead, np.where(zero, 138, 6))
    part, long = rest >= 3, zero & (rest >= 11)
    counts = np.stack((lead, whole, part, np.where(part, 0, rest)), axis=1)
    none = np.zeros(len(starts), np.int64)
    symbols = np.stack((value, np.where(zero, 18, 16), np.where(long, 18, 16 + zero), value), axis=1)
    extras = np.stack((none, np.where(zero, 127, 3), rest - np.where(long, 11, 3), none), axis=1)
    symbols, extras = (np.repeat(x.ravel(), counts.ravel()) for x in (symbols, extras))
    return symbols, extras, np.cumsum(counts.sum(axis=1))[np.searchsorted(starts, borders) - 1]


@dataclass
class Codes:
    """Prefix codes of some tables of counts one after another: the codes and their lengths, table t from borders[t] on;
    values and sizes are the fields that state them in the stream, those of table t from places[t] on."""

    borders: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    places: np.ndarray


def codes_for(tables: list[np.ndarray]) -> Codes:
    """Codes for symbols that occur so often."""
    counts, borders = np.concatenate(tables), np.cumsum([0] + [len(t) for t in tables])
    used = np.flatnonzero(counts)
    ends = np.searchsorted(used, borders)
    n = np.diff(ends)
    first = np.where(n > 0, used[np.minimum(ends[:-1], len(used) - 1)] - borders[:-1], 0)
    only = (n < 2) & (first < 256)  # no code at all, or one of no bits, is stated by its symbol
    counts[borders[:-1][(n < 2) & ~only]] = 1  # one symbol past the bytes: a length of its own, with one that never comes
    lengths = lengths_of(counts, borders, MOST_BITS)
    own_table = np.repeat(~only, np.diff(borders))
    lengths[~own_table] = 0
    made = np.flatnonzero(~only)
    heads, head_sizes, follow = np.where(first > 1, 0b101, 0b001) | first << 3, np.where(first > 1, 11, 4), np.zeros(len(tables), np.int64)
    run_values = run_sizes = np.zeros(0, np.int64)
    if len(made):
        symbols, extras, run_ends = runs_of(lengths[own_table], np.cumsum(np.diff(borders)[made]))
        follow[made] = np.diff(run_ends, prepend=0)
        at = 19 * np.repeat(np.arange(len(made)), follow[made]) + symbols
        own_borders = 19 * np.arange(len(made) + 1)
        own = lengths_of(np.bincount(at, minlength=19 * len(made)), own_borders, MOST_OWN).reshape(-1, 19)
        ordered = own[:, LENGTH_PLACES]
        stated = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1))
        heads[made] = (stated - 4) << 1 | (ordered << (5 + 3 * np.arange(19))).sum(axis=1)
        head_sizes[made] = 5 + 3 * stated + 1
        # a table with one symbol takes no bits, and isn't a complete code
        own_sizes = np.where((own > 0).sum(axis=1, keepdims=True) > 1, own, 0).ravel()
        run_sizes = own_sizes[at]
        run_values = codes_of(own_sizes, own_borders)[at] | extras << run_sizes
        run_sizes = run_sizes + EXTRA_BITS[symbols]
    places = np.concatenate(([0], np.cumsum(1 + follow)))
    values, sizes = np.empty(places[-1], np.int64), np.empty(places[-1], np.int64)
    rest = np.ones(places[-1], bool)
    rest[places[:-1]] = False
    values[places[:-1]], sizes[places[:-1]], values[rest], sizes[rest] = heads, head_sizes, run_values, run_sizes
    return Codes(borders, codes_of(lengths, borders), lengths, values, sizes, places)


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra value, extra bits) of lengths or distances."""
    if not len(values):
        return values, values, values
    v = values - 1
    high = np.frexp(v.astype(float))[1] - 1  # the highest bit's place
    extra = np.maximum(high - 1, 0)
    large = v >= 4
    return np.where(large, 2 * high + (v >> extra & 1), v), np.where(large, v & ((1 << extra) - 1), 0), np.where(large, extra, 0)


def last_equal(keys: np.ndarray) -> np.ndarray:
    """The last place before with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    out, ordered = np.full(len(keys), -1, np.int64), keys[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    out[order[same + 1]] = order[same]
    return out


def copies_of(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, size, distance) of copies, left to right: each of the last place with the same LEAST_COPY pixels."""
    n = len(px) - LEAST_COPY + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(LEAST_COPY):
            key = (key ^ (key >> np.uint64(29))) * MIX + px[i : i + n]
    before = last_equal(key)
    out, free = [], 0
    places = np.flatnonzero((before >= 0) & (np.arange(n) - before <= FARTHEST))
    i = 0
    while i < len(places):
        at = int(places[i])
        source = int(before[at])
        size, step, most = 0, 32, min(MOST_COPY, len(px) - at)
        while size < most:  # pieces that grow, up to the first pixel that differs
            end = min(size + step, most)
            differ = np.flatnonzero(px[at + size : at + end] != px[source + size : source + end])
            if len(differ):
                size += int(differ[0])
                break
            size, step = end, 4 * step
        if size >= LEAST_COPY:
            out.append((at, size, at - source))
            free = at + size
            i = int(np.searchsorted(places, free))
        else:  # keys that only look alike
            i += 1
    return out


def cost(*counts: np.ndarray) -> float:
    """Bits that symbols take, and about five for each in the code's own table."""
    sums = np.array([c.sum() for c in counts], float)
    held = np.concatenate(counts)
    held = held[held > 0]
    sums = sums[sums > 0]
    return float((sums * np.log2(sums)).sum() - (held * np.log2(held)).sum()) + 5 * len(held)


@dataclass
class Part:
    """An entropy-coded image that is to be written: fields before it, counts of its five codes' symbols, its operations.

    single: places of pixels that no copy makes, symbol: what stands for each, left: those not from the cache; copies
    are at their places, with (prefix symbol, extra value, extra bits) of sizes and distances.
    """

    head: list[tuple[int, int]]
    total: int
    counts: list[np.ndarray]
    single: np.ndarray
    symbol: np.ndarray
    left: np.ndarray
    value: np.ndarray
    at: np.ndarray
    size: tuple[np.ndarray, np.ndarray, np.ndarray]
    far: tuple[np.ndarray, np.ndarray, np.ndarray]


def part_of(px: np.ndarray, width: int, head: list[tuple[int, int]], *, main: bool, below: float = float("inf")) -> Part | None:
    """Pixels as copies, cache entries and colours; nothing if that would take `below` bits."""
    copies = copies_of(px)
    at, size, far = (np.array(c, np.int64) for c in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3
    covered = np.zeros(len(px) + 1, np.int64)
    covered[at] += 1
    covered[at + size] -= 1
    single = np.flatnonzero(np.cumsum(covered)[:-1] == 0)  # pixels that no copy makes
    sizes, fars = prefix_of(size), prefix_of(near_codes(far, width))
    value = px[single].astype(np.int64)
    parts = green, red, blue, alpha = [value >> n & 255 for n in (8, 16, 0, 24)]
    of_copies = np.bincount(256 + sizes[0], minlength=280)
    far_counts = np.bincount(fars[0], minlength=40)

    def histograms(cache_bits: int) -> list[np.ndarray]:
        greens = np.bincount(symbol, minlength=280 + (1 << cache_bits if cache_bits else 0))
        greens[:280] += of_copies
        return [greens, *(np.bincount(c if left is None else c[left], minlength=256) for c in parts[1:]), far_counts]

    symbol, left, cache_bits = green, None, 0
    counts = histograms(0)
    best = cost(*counts)
    if main and len(px) >= 64:
        tried = min(10, len(px).bit_length() - 3)
        keys = (px * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - tried)
        last = last_equal(keys.astype(np.uint16))  # of ten bits at most
        hits = ((last >= 0) & (px[last] == px))[single]
        if hits.any():
            symbol, left = np.where(hits, 280 + keys[single].astype(np.int64), green), np.flatnonzero(~hits)
            other = histograms(tried)
            if (price := cost(*other)) < best:
                best, counts, cache_bits = price, other, tried
            else:
                symbol, left = green, None
    if best + int(sizes[2].sum() + fars[2].sum()) >= below:
        return None
    head = [*head, (1 | cache_bits << 1, 5) if cache_bits else (0, 1), *([(0, 1)] if main else [])]
    left = np.arange(len(single)) if left is None else left
    return Part(head, len(px), counts, single, symbol, left, value[left], at, sizes, fars)


def write(plans: list[list[Part]]) -> list[bytes]:
    """Streams of images, each of one or more parts. All parts' codes are made together, and all their operations."""
    if not plans:
        return []
    parts = [p for plan in plans for p in plan]
    made = codes_for([c for p in parts for c in p.counts])
    starts = made.borders[:-1].reshape(-1, 5)
    whole = lambda arrays: np.concatenate(list(arrays))
    firsts = np.cumsum([0] + [p.total for p in parts])[:-1]
    n_single, n_left, n_copies = (np.array([len(x) for x in column]) for column in zip(*((p.single, p.left, p.at) for p in parts), strict=True))
    # an operation has up to four fields, 63 bits at most; they are put as one, in order of their places
    symbol = whole(p.symbol for p in parts) + np.repeat(starts[:, 0], n_single)
    values, sizes = made.codes[symbol], made.lengths[symbol]
    left = whole(p.left for p in parts) + np.repeat(np.cumsum(n_single) - n_single, n_left)
    colour = whole(p.value for p in parts)
    left_values, left_sizes = values[left], sizes[left]
    for i, shift in ((1, 16), (2, 0), (3, 24)):
        at = (colour >> shift & 255) + np.repeat(starts[:, i], n_left)
        left_values |= made.codes[at] << left_sizes
        left_sizes += made.lengths[at]
    values[left], sizes[left] = left_values, left_sizes
    (size_symbol, size_extra, size_bits), (far_symbol, far_extra, far_bits) = ([whole(x) for x in zip(*column, strict=True)] for column in zip(*((p.size, p.far) for p in parts), strict=True))
    at, far_at = 256 + size_symbol + np.repeat(starts[:, 0], n_copies), far_symbol + np.repeat(starts[:, 4], n_copies)
    copy_values, copy_sizes = made.codes[at], made.lengths[at]
    for field, bits in ((size_extra, size_bits), (made.codes[far_at], made.lengths[far_at]), (far_extra, far_bits)):
        copy_values |= field << copy_sizes
        copy_sizes += bits
    places = np.concatenate((whole(p.single for p in parts) + np.repeat(firsts, n_single), whole(p.at for p in parts) + np.repeat(firsts, n_copies)))
    order = np.argsort(places, kind="stable")
    values, sizes = np.concatenate((values, copy_values))[order], np.concatenate((sizes, copy_sizes))[order]
    out, ends, done, t = BitWriter(), [0], 0, 0
    for plan in plans:
        for p in plan:
            for field in p.head:
                out.put(*field)
            a, b = made.places[t], made.places[t + 5]
            out.put_many(made.values[a:b], made.sizes[a:b])
            n = len(p.single) + len(p.at)
            for i in range(done, done + n, OPERATIONS):
                out.put_many(values[i : min(i + OPERATIONS, done + n)], sizes[i : min(i + OPERATIONS, done + n)])
            done, t = done + n, t + 5
        ends.append(out.align())
    data = out.bytes()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=64)
def near_places(width: int) -> dict[int, int]:
    """The codes of near distances."""
    out = {}
    for i, (x, y) in enumerate(NEAR, 1):
        if x + y * width >= 1:
            out.setdefault(x + y * width, i)
    return out


def near_codes(far: np.ndarray, width: int) -> np.ndarray:
    """The codes of distances in pixels: near places have some of their own."""
    near = near_places(width)
    return np.array([near.get(f, f + len(NEAR)) for f in far.tolist()], np.int64)


def plan(px: np.ndarray, width: int, height: int) -> list[Part] | None:
    """A palette and indices, or pixels; None if eight-bit codes are shorter."""
    below = 24 * len(px) + HEAD_BITS
    head, parts = [(SIGNATURE | (width - 1) << 8 | (height - 1) << 22, 40)], []
    ordered = np.sort(px)
    colours = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
    if len(colours) <= 256 and 2 * len(colours) <= len(px):
        index = np.searchsorted(colours, px)
        steps = channels(colours)
        steps[1:] -= channels(colours)[:-1]
        parts.append(part_of(joined(steps), len(colours), [*head, (0b111, 3), (len(colours) - 1, 8)], main=False))
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide, depth = -(-width >> bits), 8 >> bits
        packed = np.zeros((height, wide << bits), np.uint32)
        packed[:, :width] = index.reshape(height, width)
        packed = packed.reshape(height, wide, 1 << bits)
        packed = (packed << (np.arange(1 << bits, dtype=np.uint32) * depth)).sum(axis=2, dtype=np.uint32)
        px, width = (np.uint32(255 << 24) | packed.ravel() << 8), wide
        below, head = float("inf"), []
    parts.append(part_of(px, width, [*head, (0, 1)], main=True, below=below))
    return parts if parts[-1] else None


def store(payload: bytes) -> bytes:
    """Files of ROW pixels a row and at most SIDE rows, one after another; payload: a multiple of ROW_BYTES."""
    return store_many([payload])[0]


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload stored."""
    samples = [np.frombuffer(p, np.uint8).reshape(-1, ROW, 3) for p in payloads]
    files = iter(encode_many([x[i : i + SIDE] for x in samples for i in range(0, len(x), SIDE)]))
    return [b"".join([next(files) for _ in range(0, len(x), SIDE)]) for x in samples]


def load(media: bytes) -> list[Image]:
    """The images of files one after another."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(decode(media[at : at + size]))
        at += size
    return out


#: Texts whose rows a task remembers, some hundred bytes each.
MOST_KNOWN = 20_000


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def feature(samples: np.ndarray) -> str:
    """Size, rounded-down channel means in thousandths, and how many samples differ from their left neighbour."""
    means = ",".join(str(int(v) * 1000 // (samples.shape[0] * samples.shape[1])) for v in samples.sum(axis=0, dtype=np.int64).sum(axis=0))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={means};edges={int((samples[:, 1:] != samples[:, :-1]).sum())}"


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded with spaces to a positive multiple of 192, as lossless WebP.

    One narrow pass. A null text is empty; null and repeated ids stay rows of their own; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sizes, payloads = zip(*map(padded, batch.column("text").to_pylist()), strict=True)
            out = list(zip(sizes, store_many(payloads), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, samples, error) of a column of lossless WebP files: RGB samples by rows.

    Rows of several files give several rows. Null media and files that can't be read give nulls and, for the
    latter, the reason in error; no row fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            out = []
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    out += [(key, x.width, x.height, x.rgb().tobytes(), None) for x in load(data)] if data else [(key, None, None, None, None if data is None else "no data")]
                except (ValueError, IndexError, struct.error) as e:
                    out.append((key, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "width", "height", "samples", "error"])

    small_batches(media.sparkSession)
    kept = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return kept.mapInArrow(run, "doc_id long, width long, height long, samples binary, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, from samples that are decoded from the stored bytes; encoder and decoder share one pass.

    Null and empty texts are 192 spaces; null and repeated ids stay rows of their own; other columns are left out.
    """

    def row(n: int, media: bytes) -> tuple:
        samples = np.concatenate([x.rgb() for x in load(media)])
        back = samples.tobytes()
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # equal texts of a task are coded once
        for batch in chunks(batches, "text"):
            if len(known) > MOST_KNOWN:
                known.clear()
            texts = [padded(x) for x in batch.column("text").to_pylist()]
            keys = [hashlib.sha256(p[:n]).digest() for n, p in texts]
            new = {k: x for k, x in zip(keys, texts, strict=True) if k not in known}
            for k, (n, _), media in zip(new, new.values(), store_many([p for _, p in new.values()]), strict=True):
                known[k] = row(n, media)
            out = [known[k] for k in keys]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    small_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
