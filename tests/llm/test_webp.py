"""The decoder against streams that an independent test encoder makes: every transform, codes, references and caches."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantor.llm import webp


class Out:
    def __init__(self):
        self.value = self.size = 0

    def put(self, v, n):
        assert 0 <= v < 1 << n
        self.value |= v << self.size
        self.size += n

    def file(self):
        data = self.value.to_bytes((self.size + 7) // 8, "little")
        size = len(data).to_bytes(4, "little")
        data += b"\0" * (len(data) % 2)
        return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + size + data


def code_lengths(counts):
    """Some complete code over the symbols that occur: lengths as even as can be, longer ones for rarer symbols."""
    used = sorted((s for s, c in enumerate(counts) if c), key=lambda s: -counts[s]) or [0]
    n = len(used)
    low = max(0, n.bit_length() - 1)
    short = (1 << (low + 1)) - n
    out = [0] * len(counts)
    for i, s in enumerate(used):
        out[s] = low if i < short else low + 1
    return out


def codes_of(lengths):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return {s: (0, 0) for s in used or [next(iter([0]))]}
    out, code, before = {}, 0, 0
    for s in sorted(used, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = int(f"{code:0{before}b}"[::-1], 2), before
        code += 1
    return out


def put_code(out, counts):
    used = [s for s, c in enumerate(counts) if c] or [0]
    if len(used) <= 2 and max(used) < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    lengths = code_lengths(counts)
    # run lengths: zeros by 17 and 18, repeats by 16
    tokens, i, last = [], 0, 8
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        if lengths[i] == 0 and n >= 11:
            n = min(n, 138)
            tokens.append((18, n - 11, 7))
        elif lengths[i] == 0 and n >= 3:
            n = min(n, 10)
            tokens.append((17, n - 3, 3))
        elif lengths[i] and lengths[i] == last and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((lengths[i], 0, 0))
            last = lengths[i] or last
        i += n
    counts2 = [0] * 19
    for s, _, _ in tokens:
        counts2[s] += 1
    own = code_lengths(counts2)
    if sum(1 for n in counts2 if n) == 1:
        own[next(s for s, n in enumerate(counts2) if n)] = 1
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.LENGTH_ORDER:
        out.put(own[s], 3)
    out.put(0, 1)
    table = codes_of(own)
    for s, extra, n in tokens:
        out.put(*table[s])
        out.put(extra, n)
    return codes_of(lengths)


def prefix(value):
    """(code, extra bits, how many) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def put_image(out, px, width, *, main, cache_bits=0, groups=None, rng=None, references=True):
    """px: 32-bit values by rows. groups: (size_bits, group of each block) or None."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(groups is not None, 1)
        if groups is not None:
            out.put(groups[0] - 2, 3)
            put_image(out, [g << 8 for g in groups[1]], -(-width >> groups[0]), main=False)
    cache, seen, ops, at = {}, {}, [], 0
    key = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
    while at < len(px):
        best = (0, 0)
        if references and at >= 1:
            for far in {1, width, seen.get(px[at]) is not None and at - seen[px[at]] or 1}:
                n = 0
                while far <= at and at + n < len(px) and n < 4096 and px[at + n] == px[at + n - far]:
                    n += 1
                best = max(best, (n, far))
        if best[0] >= 3:
            ops.append((at, "copy", *best))
            step = best[0]
        elif cache_bits and cache.get(key(px[at])) == px[at]:
            ops.append((at, "cache", key(px[at]), 0))
            step = 1
        else:
            ops.append((at, "pixel", px[at], 0))
            step = 1
        for p in px[at : at + step]:
            seen[p] = at
            if cache_bits:
                cache[key(p)] = p
        at += step
    group = lambda i: groups[1][(i // width >> groups[0]) * -(-width >> groups[0]) + (i % width >> groups[0])] if groups else 0
    near = {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(webp.NEAR))) if x + y * width >= 1}
    plan = {g: [[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for g in range(max(groups[1]) + 1 if groups else 1)}
    steps = []
    for i, kind, a, far in ops:
        g = group(i)
        if kind == "pixel":
            s = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
        elif kind == "cache":
            s = [(0, 280 + a)]
        else:
            (c, e, n), (d, f, m) = prefix(a), prefix(near.get(far, far + 120))
            s = [(0, 256 + c), ("raw", e, n), (4, d), ("raw", f, m)]
        steps.append((g, s))
        for x in s:
            if x[0] != "raw":
                plan[g][x[0]][x[1]] += 1
    tables = {g: [put_code(out, c) for c in plan[g]] for g in plan}
    for g, s in steps:
        for x in s:
            out.put(*(x[1:] if x[0] == "raw" else tables[g][x[0]][x[1]]))


def head(width, height):
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def parts(p):
    return [p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255]


def whole(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def picture(rng, width, height, colours=None):
    palette = [rng.getrandbits(32) for _ in range(colours or 6)]
    px = []
    for i in range(width * height):
        px.append(px[-1] if px and rng.random() < 0.5 else px[i - width] if i >= width and rng.random() < 0.5 else rng.choice(palette) if colours or rng.random() < 0.6 else rng.getrandbits(32))
    return px


@pytest.mark.parametrize("seed", range(12))
def test_plain_streams(seed):
    rng = random.Random(seed)
    width, height = rng.randint(1, 40), rng.randint(1, 30)
    px = picture(rng, width, height)
    out = head(width, height)
    out.put(0, 1)
    bits = rng.randint(2, 4)
    blocks = -(-width >> bits) * -(-height >> bits)
    groups = (bits, [rng.randrange(3) for _ in range(blocks - 1)] + [2]) if seed % 3 == 0 else None
    put_image(out, px, width, main=True, cache_bits=rng.choice((0, 1, 5, 11)), groups=groups)
    assert webp.decode(out.file()).argb.tolist() == px


def test_predictors():
    rng = random.Random(5)
    clamp = lambda v: max(0, min(255, v))
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]

    def guess(mode, l, t, tl, tr):  # noqa: E741
        if mode == 11:
            near = [sum(abs(t[i] - tl[i]) for i in range(4)), sum(abs(l[i] - tl[i]) for i in range(4))]
            return l if near[0] < near[1] else t
        return {
            0: [255, 0, 0, 0], 1: l, 2: t, 3: tr, 4: tl, 5: half(half(l, tr), t), 6: half(l, tl), 7: half(l, t), 8: half(tl, t), 9: half(t, tr), 10: half(half(l, tl), half(t, tr)),
            12: [clamp(l[i] + t[i] - tl[i]) for i in range(4)], 13: [clamp(a + int((a - tl[i]) / 2)) for i, a in enumerate(half(l, t))],
        }[mode]

    width, height = 24, 28
    px = picture(rng, width, height)
    modes = [rng.randrange(14) for _ in range(6 * 7)]
    modes[:14] = range(14)
    rest = []
    for i, p in enumerate(map(parts, px)):
        y, x = divmod(i, width)
        at = lambda k: parts(px[k])
        g = [255, 0, 0, 0] if i == 0 else at(i - 1) if y == 0 else at(i - width) if x == 0 else guess(modes[(y >> 2) * 6 + (x >> 2)], at(i - 1), at(i - width), at(i - width - 1), at(i - width + 1))
        rest.append(whole([a - b for a, b in zip(p, g, strict=True)]))
    out = head(width, height)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    put_image(out, [m << 8 for m in modes], 6, main=False)
    out.put(0, 1)
    put_image(out, rest, width, main=True, cache_bits=4)
    assert webp.decode(out.file()).argb.tolist() == px


def test_cross_colour_and_green():
    rng = random.Random(6)
    width, height = 17, 9
    px = picture(rng, width, height)
    factors = [rng.getrandbits(24) | 255 << 24 for _ in range(5 * 3)]
    signed = lambda v: (v & 255) - 256 * (v >> 7 & 1)
    delta = lambda f, c: signed(f) * signed(c) >> 5
    rest = []
    for i, (a, r, g, b) in enumerate(map(parts, px)):
        f = parts(factors[(i // width >> 2) * 5 + (i % width >> 2)])
        b = b - delta(f[2], g) - delta(f[1], r)  # noqa: PLW2901
        r = r - delta(f[3], g)  # noqa: PLW2901
        rest.append([a, r & 255, g, b & 255])
    rest = [whole([a, r - g, g, b - g]) for a, r, g, b in rest]
    out = head(width, height)
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    put_image(out, factors, 5, main=False)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    put_image(out, rest, width, main=True)
    assert webp.decode(out.file()).argb.tolist() == px


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    rng = random.Random(colours)
    width, height = 21, 13
    px = picture(rng, width, height, colours)
    table = sorted(set(px))
    n = len(table)
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    out = head(width, height)
    out.put(1, 1)
    out.put(3, 2)
    out.put(n - 1, 8)
    before, deltas = [0] * 4, []
    for p in map(parts, table):
        deltas.append(whole([a - b for a, b in zip(p, before, strict=True)]))
        before = p
    put_image(out, deltas, n, main=False)
    out.put(0, 1)
    wide, depth, rows = -(-width >> bits), 8 >> bits, []
    for y in range(height):
        line = [0] * wide
        for x in range(width):
            line[x >> bits] |= table.index(px[y * width + x]) << (x & ((1 << bits) - 1)) * depth
        rows += [255 << 24 | v << 8 for v in line]
    put_image(out, rows, wide, main=True)
    assert webp.decode(out.file()).argb.tolist() == px


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_payloads_come_back(data):
    data += b" " * (-len(data) % webp.ROW_BYTES)
    media = webp.store(data)
    assert b"".join(x.rgb().tobytes() for x in webp.load(media)) == data
    # symbol by symbol gives the same as whole arrays
    flat, webp.Code.flat_pixels = webp.flat_pixels, None
    try:
        webp.flat_pixels = lambda bits, total, alpha: np.array([alpha << 24 | (g := webp.REVERSED_LIST[bits.read(8)]) << 8 | webp.REVERSED_LIST[bits.read(8)] << 16 | webp.REVERSED_LIST[bits.read(8)] for _ in range(total)], np.uint32)
        assert b"".join(x.rgb().tobytes() for x in webp.load(media)) == data
    finally:
        webp.flat_pixels = flat
        del webp.Code.flat_pixels


def test_bad_files():
    good = webp.store(b"x" * 192)
    for bad in (b"", b"RIFF", good[:-10], good[:16] + b"\0\0\0\0", b"RIFF" + good[4:20] + b"\0" + good[21:], good[:30] + b"\xff" * 40):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media_columns(spark):
    import hashlib
    import zlib

    texts = ["", None, "é" * 100, "a" * 192, "b" * 193, "long " * 700_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "n", "x")], "doc_id long, text string, media string")
    got = webp.media_digests(docs).collect()
    for r, t in zip(got, [*texts, "n"], strict=True):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    stored = webp.text_media(docs)
    back = webp.decoded(stored.unionByName(spark.createDataFrame([(50, 0, None), (51, 0, b"junk"), (52, 0, b"")], stored.schema)))
    rows = {}
    for r in back.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert b"".join(r.samples for r in rows[5]) == (texts[5] + " " * (-len(texts[5]) % 192)).encode() and len(rows[5]) == 2
    assert rows[50][0].error is None and rows[51][0].error and rows[52][0].error and rows[51][0].samples is None
    assert webp.media_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["prose", "few", "copies", "noise", "one", "long copies"])
def test_encoder_forms(kind):
    """Streams of each form come back; prose is shorter than its bytes and isn't read by the flat path."""
    rng = random.Random(kind)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = {
        "prose": lambda: " ".join(rng.choice(words) for _ in range(3000)), "few": lambda: "".join(rng.choice(("abc", "bca", "cab")) for _ in range(3000)), "one": lambda: "z" * 5000,
        "copies": lambda: " ".join(rng.choice(words) for _ in range(200)) * 30, "noise": lambda: "".join(chr(rng.randrange(256, 2000)) for _ in range(50)), "long copies": lambda: ("".join(rng.choice(words) for _ in range(9000)) + "   ") * 3,
    }[kind]()
    _, payload = webp.padded(text)
    media, flat, before = webp.store(payload), [], webp.flat_pixels
    webp.flat_pixels = lambda *a: flat.append(1) or before(*a)
    try:
        assert b"".join(x.rgb().tobytes() for x in webp.load(media)) == payload
    finally:
        webp.flat_pixels = before
    if kind != "noise":
        assert len(media) < 0.6 * len(payload) and not flat


def test_code_lengths():
    rng = random.Random(1)
    for most in (7, 12):
        for n in (2, 3, 19, 100):
            counts = np.array([int(rng.random() ** 6 * 10**6) for _ in range(n)])
            lengths = webp.code_lengths(counts, most)
            used = lengths[counts > 0]
            assert (lengths[counts == 0] == 0).all() and used.max(initial=0) <= most
            assert len(used) < 2 or sum(2.0 ** -used) == 1


def test_images_together():
    """Files made together are those made alone, whatever their sizes; entries and copies come back in any mixture."""
    rng = np.random.default_rng(5)
    colours = rng.integers(0, 256, (400, 3), np.uint8)
    images = []
    for n in (1, 2, 64, 700, 5000, 1, 30_000, 90):
        image = colours[np.minimum(rng.geometric(0.02, n), 399)]
        for _ in range(n // 50):
            at, far, size = rng.integers(0, n), rng.integers(1, n), rng.integers(1, 40)
            for i in range(at, min(n, at + size)):
                if i >= far:
                    image[i] = image[i - far]
        images.append(image.reshape(n, 1, 3) if n < 64 else image.reshape(1, n, 3) if n <= webp.SIDE else image.reshape(-1, 100, 3))
    images += [rng.integers(0, 256, (20, 30, 3), np.uint8) for _ in range(3)] + [images[3]] * 70
    files = webp.encode_many(images)
    assert files == [webp.encode(x) for x in images]
    assert all((webp.decode(f).rgb() == x).all() for f, x in zip(files, images, strict=True))
    assert webp.encode_many([]) == [] and webp.store_many([]) == []


def test_empty_cache_entries():
    """A pixel read from an empty entry is transparent black, and takes that colour's own entry."""
    rng = random.Random(3)
    for _ in range(40):
        out = webp.BitWriter()
        total, cache_bits = 30, 3
        out.put(webp.SIGNATURE | (total - 1) << 8, 40)
        out.put(0, 1)
        out.put(1 | cache_bits << 1, 5)
        out.put(0, 1)
        symbols = [rng.choice([7, 9, 200, *range(280, 288)]) for _ in range(total)]
        counts = [np.bincount([*symbols, 7, 9, 200, *range(280, 288)], minlength=288), *(np.bincount([v], minlength=n) for v, n in ((0, 256), (0, 256), (0, 256), (0, 40)))]
        made = webp.codes_for(counts)
        out.put_many(made.values, made.sizes)
        for s in symbols:
            out.put(int(made.codes[s]), int(made.lengths[s]))
        out.align()
        want, cache = [], [0] * 8
        for s in symbols:
            want.append(s << 8 if s < 256 else cache[s - 280])
            cache[(webp.CACHE_FACTOR * want[-1] & 0xFFFFFFFF) >> (32 - cache_bits)] = want[-1]
        assert webp.decode(webp.riff(out.bytes())).argb.tolist() == want
