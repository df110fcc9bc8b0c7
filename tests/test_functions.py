import hashlib
import json

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantor.functions import hashing as H
from vantor.functions import payload as V
from vantor.functions import sparse as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(indices, values, dimension=None):
    return S.sparse(F.lit(indices) if indices else F.array(), F.lit([float(v) for v in values]) if values else F.array(), dimension)


def test_sparse(spark):
    a = vec([2, 3, 8, 20], [4, -1, 0.5, 7])
    assert value(spark, S.length(a)) == 4 and value(spark, S.dimension(a)) == 21
    none = vec([], [])
    assert value(spark, F.struct(S.is_empty(none), S.dimension(none), S.norm(none), S.normalize(none).isNull())) == (True, 0, 0.0, True)
    assert value(spark, S.dot(vec([0, 4, 9], [2, 0.25, -3]), vec([4, 6, 9], [8, 5, 2]))) == -4
    assert value(spark, S.dot(vec([7, 9], [2, 2]), vec([1, 8, 30], [3, 3, 3]))) == 0
    assert value(spark, S.norm(vec([1, 6, 7], [2, -3, 6]))) == 7
    assert value(spark, S.norm(S.normalize(vec([1, 6, 7], [2, -3, 6], 9)))) == pytest.approx(1)
    assert [value(spark, S.validate(v)) is None for v in (vec([4, 9], [2, 2]), vec([4, 4], [2, 3]), vec([9, 4, 11], [2, 2, 2]), vec([4, 9, 12], [2, 2]), vec([], []))] == [True, False, False, False, True]
    d = value(spark, S.from_dense(F.lit([2.5, 0.0, 0.0, -1.0, 0.0])))
    assert (d.indices, d.values, d.dimension) == ([0, 3], [2.5, -1.0], 5)
    assert value(spark, S.to_dense(vec([0, 2], [3, 6], 4))) == [3, 0, 6, 0]
    assert value(spark, S.equal(vec([1], [1], 5), vec([1], [1], 9)))


def test_sparse_against_dense(spark):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((12, 30)) < 0.4, rng.integers(-8, 9, (12, 30)) / 4, 0.0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "id long, v array<double>").select("id", S.from_dense("v").alias("s"))
    got = {(r.a, r.b): r.dot for r in S.batch_dot(rows.where("id < 5"), rows).collect()}
    want = {(i, j): float(dense[i] @ dense[j]) for i in range(5) for j in range(12) if ((dense[i] != 0) & (dense[j] != 0)).any()}
    assert got == pytest.approx(want)
    assert [r.n for r in rows.select("id", S.norm(F.col("s")).alias("n")).orderBy("id").collect()] == pytest.approx(np.linalg.norm(dense, axis=1).tolist())


def by_hand(a, b):
    """Products of (id, {index: value}) by id, of pairs that share an index."""
    out = {}
    for i, x in a:
        for j, y in b:
            for k in x.keys() & y.keys():
                out[i, j] = out.get((i, j), 0.0) + x[k] * y[k]
    return out


def sparse_rows(spark, rows, kind="long"):
    return spark.createDataFrame([(i, {"indices": sorted(v), "values": [v[k] for k in sorted(v)], "dimension": None}) for i, v in rows], f"id {kind}, s {S.TYPE}")


def test_batch_dot_by_tiles(spark, monkeypatch):
    """Pairs are neither joined nor shuffled, over several passes, tasks, blocks and tiles, dense and sparse ones."""
    rng = np.random.default_rng(7)
    narrow = [(i, {int(k): float(rng.integers(-8, 9)) / 4 for k in rng.choice(40, 9, replace=False)}) for i in range(70)]
    wide = [(i, {int(k): float(rng.integers(-8, 9)) / 4 for k in rng.choice(1_000_000, 2) // 20_000 * 20_000}) for i in range(70, 90)]
    odd = [(90, {}), (91, {3: float("inf"), 5: 1.0}), (92, {3: 0.0, 7: 2.0}), (93, {3: float("nan")}), (94, {3: 1.0, 5: -1.0}), (95, {2**31 - 1: 2.0}), (None, {5: 1.5}), (None, {5: 1.0, 6: 4.0}), (3, {1: 1.0, 39: -2.0}), (3, {1: -1.0}), (96, {5: 1.0, 7: 1.0})]
    rows = narrow + wide + odd
    want = by_hand(rows[::2] + odd, rows)
    a, b = (sparse_rows(spark, x) for x in (rows[::2] + odd, rows))
    for sizes in ({}, {"SENT_BYTES": 3000, "TASK_PAIRS": 500, "BLOCK": 4, "CELLS": 24, "OUT_ROWS": 5}, {"MEET": 16, "DENSE": 0}):
        for name, v in sizes.items():
            monkeypatch.setattr(S, name, v)
        met = S.batch_dot(a, b)
        got = met.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.dot for r in got} == pytest.approx(want, nan_ok=True)
        assert "Join" not in (plan := met._jdf.queryExecution().toString()) and "Cartesian" not in plan
        monkeypatch.undo()
    texts = S.batch_dot(sparse_rows(spark, [("é", {1: 2.0}), ("b", {2: 1.0})], "string"), sparse_rows(spark, [(1, {1: 3.0})])).collect()
    assert [tuple(r) for r in texts] == [("é", 1, 6.0)]
    assert S.batch_dot(a.where("id < 0"), b).collect() == S.batch_dot(a, b.where("id < 0")).collect() == []


def test_tile():
    """Dense and sparse tiles have the same pairs and products, pairs whose products cancel among them."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for wide, fill in ((6, 0.7), (64, 0.25), (900, 0.01), (3000, 0.002)):
        held = rng.random((2, 50, wide)) < fill
        a, b = np.where(held, rng.integers(-2, 3, held.shape) / 2, 0.0)
        (la, ia), (lb, ib) = np.nonzero(held[0]), np.nonzero(held[1])
        block = S.Block(pa.array(range(50)), np.searchsorted(la, np.arange(51)), ia, a[la, ia])
        want = held[1].astype(int) @ held[0].T.astype(int) > 0
        at = np.searchsorted(block.indices, ib)
        known = np.isin(ib, block.indices)
        met = block.starts[at[known] + 1] - block.starts[at[known]]
        for row, line, dot in (S.tile(block, 50, lb, ib, b[lb, ib]), S.sparse_tile(block, 50, lb[known], at[known], b[lb, ib][known], met)):
            assert sorted(zip(row.tolist(), line.tolist(), strict=True)) == list(map(tuple, np.argwhere(want).tolist()))
            assert dot == pytest.approx((b @ a.T)[row, line])


def test_xxhash(spark):
    rows = spark.createDataFrame([(s,) for s in ("", "abc", "x" * 54, "é" * 40, None)], "s string")
    for seed in (0, 1, 2**63 + 5):
        got = [r.h for r in rows.select(H.xxhash64("s", seed).alias("h")).collect()]
        want = [None if r.s is None else np.uint64(xxhash.xxh64_intdigest(r.s.encode(), seed)).astype(np.int64) for r in rows.collect()]
        assert got == want
    got = [r.s for r in spark.range(50).select(H.shard("id", 7).alias("s")).collect()]
    assert got == [xxhash.xxh64_intdigest(i.to_bytes(8, "little")) % 7 for i in range(50)]


def test_checksums(spark):
    data = [bytes(32), b"\xff" * 32, bytes(range(32)), b"", b"split here somewhere"]
    assert H.crc32c_bytes(data[:4]).tolist() == [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0]
    rows = spark.createDataFrame([(d[:20], d[20:], d) for d in data] + [(None, None, None)], "a binary, b binary, c binary")
    got = rows.select(H.crc32c_combine(H.crc32c("a"), "b").alias("x"), H.crc32c("c").alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[-1].y is None
    assert value(spark, H.sha256(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()


def test_hash128():
    low, high = H.hash128_bytes(b"")
    assert low == high
    seen = {H.hash128_bytes(bytes(range(n)), seed) for n in (0, 1, 3, 4, 8, 9, 16, 17, 32, 100) for seed in (0, 7)}
    assert len(seen) == 20


def test_base64url(spark):
    rows = spark.createDataFrame([(b"Man",), (b"\xfb\xff",), (bytes(range(256)),), (b"",)], "d binary")
    got = rows.select("d", H.base64url("d").alias("e"), H.unbase64url(H.base64url("d")).alias("b")).collect()
    assert got[0].e == "TWFu" and all(not set(r.e) & set("+/=\r\n") and r.d == r.b for r in got)
    assert [value(spark, H.unbase64url(F.lit(s))) for s in ("AB==", "A!", "A")] == [None] * 3


def test_payload(spark):
    p = V.parse(F.lit('{"i": 10, "f": 20.0, "s": "10", "b": true, "l": [1], "g": {"lat": 37, "lon": -122}, "h": {"lat": 37.0, "lon": -121.5, "x": 1}, "o": {"a": 1}, "e": 1.5e0}'))
    get = lambda k: V.get(p, k)
    assert [value(spark, V.kind(get(k))) for k in "ifsblghoez"] == ["int", "float", "str", "bool", "list", "geo", "geo", "object", "float", None]
    assert value(spark, V.as_int(get("s"))) is None and value(spark, V.as_int(get("f"))) is None and value(spark, V.as_float(get("i"))) is None
    assert [value(spark, V.compare(get(a), get(b))) for a, b in ("if", "fi", "is", "ll", "gh", "hg", "bb")] == [-1, 1, None, None, -1, 1, 0]
    assert value(spark, V.contains_key(p, "i")) and not value(spark, V.contains_key(p, "q"))
    one = lambda t: F.parse_json(F.lit(t))
    assert value(spark, V.compare(one("1"), one("1.0"))) == 0 and not value(spark, V.equal(one("1"), one("1.0")))
    assert value(spark, V.parse(F.lit("{"))) is None and json.loads(value(spark, F.to_json(V.empty()))) == {}


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_bitmap_bytes(values, optimise):
    from vantor.operators.sets import from_bytes, to_bytes

    data = to_bytes(values, optimise=optimise)
    assert from_bytes(data).tolist() == sorted(set(values))
    assert from_bytes(data[:-1]) is None


def test_bitmap_kinds():
    from vantor.operators.sets import from_bytes, to_bytes

    many = np.arange(0, 60000, 2)
    assert len(to_bytes(many)) == 4 + 3 + 8192 and len(to_bytes(np.arange(60000), optimise=True)) == 4 + 3 + 4 + 4
    for v in (many, np.arange(60000), np.array([0, 65535, 65536, 131071, 2**32 - 1])):
        assert from_bytes(to_bytes(v, optimise=True)).tolist() == v.tolist()
    assert from_bytes(b"") is None and from_bytes(b"\x01\0\0\0\0\0\x07") is None


def test_document_checksums(spark, tmp_path):
    import xxhash

    from vantor.queries import queries

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rows = [(1, None), (2, ""), (3, "é中🙂 ½"), (4, "long text " * 3000), (5, "a"), (6, "x" * 33)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for key, text in rows:
        data = None if text is None else text.encode()
        want[key] = (None, None) if data is None else ((h := xxhash.xxh64_intdigest(data)) - (h >> 63 << 64), crc(data))
    assert {r.doc_id: (r.xxhash64, r.crc32c) for r in queries()["document_checksums"](spark, str(tmp_path)).collect()} == want
