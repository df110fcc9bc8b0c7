import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantor.operators import changes, sets, topk
from vantor.operators.collection import Collection, SearchParams
from vantor.operators.errors import CollectionNotFound, DimensionMismatch, InvalidSchema, NotFound
from vantor.operators.search import batch_knn, by_function, knn
from vantor.plans.catalog import Aliases, Catalog
from vantor.plans.schema import CollectionConfig, DistanceMetric, IndexKind, Quantization, ScalarField, ScalarKind, VectorField
from vantor.sources import records

ROWS = [(0, [0.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (3, [3.0, 4.0], "b"), (4, [math.nan, 0.0], "a"), (5, [-1.0, 0.0], None)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, embedding array<float>, payload string")


def pairs(df):
    return [(r.id, r.score) for r in df.collect()]


def test_knn(rows):
    got = pairs(knn(rows, [0, 0], 10))
    assert got[:5] == [(0, 0.0), (1, 1.0), (2, 1.0), (5, 1.0), (3, 5.0)] and got[5][0] == 4 and math.isnan(got[5][1])
    assert pairs(knn(rows, [0, 0], 2)) == [(0, 0.0), (1, 1.0)]
    assert pairs(knn(rows, [0, 0], 0)) == [] and pairs(knn(rows, [0, 0, 0], 3, dimension=2)) == []
    assert pairs(knn(rows, [0, 0], 2, where=F.col("payload") == "b")) == [(1, 1.0), (3, 5.0)]
    assert pairs(knn(rows, [0, 0], 1, where=by_function(lambda i, p: p == "b" and i > 1, "id", "payload"))) == [(3, 5.0)]
    assert pairs(knn(rows.limit(0), [0, 0], 3)) == []
    plan = knn(rows, [0, 0], 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot", "hamming"])
def test_batch_equals_single(spark, rows, metric):
    rows = rows.where("id <> 4")
    queries = spark.createDataFrame([(7, [0.5, 0.5]), (8, [-1.0, 2.0]), (9, [1.0])], "query_id long, query array<float>")
    got = batch_knn(rows, queries, 3, metric=metric).collect()
    for key, q in ((7, [0.5, 0.5]), (8, [-1.0, 2.0])):
        mine = sorted((r.rank, r.id, round(r.score, 9)) for r in got if r.query_id == key)
        assert mine == [(i + 1, a, round(s, 9)) for i, (a, s) in enumerate(pairs(knn(rows, q, 3, metric=metric)))]
    assert not [r for r in got if r.query_id == 9] and batch_knn(rows, queries, 0).count() == 0


def test_collection(spark, rows):
    c = Collection.over(rows.where("id <> 4"), 2, payload=F.col("payload"))
    assert c.count() == 5 and not c.is_empty()
    d = c.delete([0])
    assert pairs(d.search([0, 0], 1)) == [(1, 1.0)] and pairs(c.search([0, 0], 1)) == [(0, 0.0)]
    with pytest.raises(NotFound):
        d.delete([0])
    one = lambda i, v: spark.createDataFrame([(i, v, "new")], "id long, embedding array<float>, payload string")
    u = d.update(one(3, [0.1, 0.0])).update(one(3, [0.2, 0.0])).delete([3])
    assert 3 not in [i for i, _ in pairs(u.search([0, 0], 10))]
    back = u.insert(one(3, [0.0, 0.0]))
    assert pairs(back.search_with([0, 0], SearchParams(1).increased()))[0] == (3, 0.0)
    s = back.stats().first()
    assert (s.stored, s.deleted, s.live) == (8, 4, 4) and s.size_bytes == 8 * 16
    with pytest.raises(Exception, match="dimension mismatch"):
        c.insert(one(9, [1.0])).search([0, 0], 9).collect()
    assert c.insert(one(9, [1.0]), fail=False).count() == 5
    assert c.get(3).first().payload == "b" and pairs(c.search([0.0], 3)) == []
    with pytest.raises(DimensionMismatch):
        c.checked_query([1.0])


def test_deletes_spread_over_many_rows(spark):
    rows = spark.range(20000).select("id", F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    kept = changes.without(rows, rows.where("id % 3 <> 1").select("id"))
    assert [i for i, _ in pairs(knn(kept, [10000.0, 0.0], 4))] == [10000, 9997, 10003, 9994]


def test_sets(spark):
    mk = lambda v: spark.createDataFrame([(x,) for x in v], "value long")
    get = lambda df: sorted(r.value for r in df.collect())
    assert get(sets.union(mk([1, 2]), mk([2, 3]))) == [1, 2, 3]
    assert get(sets.intersection(mk([1, 2, 3]), mk([2, 3, 4]))) == [2, 3]
    assert get(sets.difference(mk([1, 2, 3]), mk([2]))) == [1, 3]
    assert {r.value: r.member for r in sets.members(mk([1, 2]), mk([2, 9])).collect()} == {2: True, 9: False}
    v = [0, 65535, 65536, 131071, 2**32 - 1]
    assert sets.cardinality(mk(v)).first()[0] == 5 and sets.cardinality(mk([])).first()[0] == 0
    assert get(sets.decoded(sets.encoded(mk(v)))) == v
    runs = [1, 2, 3, 7, 8, 9, 10, 11, 12, 20, 23, 24]
    assert sorted((r.start, r.length) for r in sets.runs(mk(runs), part=4).collect()) == [(1, 3), (7, 6), (20, 1), (23, 2)]
    bit = spark.range(12).select(sets.bit(F.lit(bytearray(b"\x05\x01")), F.col("id")).alias("b"))
    assert [i for i, r in enumerate(bit.collect()) if r.b] == [0, 2, 8]



def test_topk(spark):
    df = spark.createDataFrame([(v, v % 2) for v in (5, 1, 4, 2, 3)], "v int, g int")
    assert [r.v for r in topk.smallest(df, 3, "v").collect()] == [1, 2, 3]
    assert [r.v for r in topk.largest(df, 2, "v").collect()] == [5, 4] and topk.smallest(df, 0, "v").count() == 0
    assert sorted((r.g, r.v, r["rank"]) for r in topk.smallest_of_each(df, 2, "g", "v").collect()) == [(0, 2, 1), (0, 4, 2), (1, 1, 1), (1, 3, 2)]


def test_schema():
    config = CollectionConfig("c")
    assert config.problem() == "Collection must have at least one vector field"
    v = VectorField("v", 3)
    assert (str(v.index_type), str(v.quantization)) == ("hnsw", "none") and not ScalarField("s", ScalarKind.INT).indexed
    assert "Duplicate vector" in config.with_vector(v, v).problem() and "dimension 0" in config.with_vector(VectorField("w", 0)).problem()
    s = ScalarField("s", ScalarKind.STR)
    assert "Duplicate scalar" in config.with_vector(v).with_scalar(s, s).problem()
    with pytest.raises(InvalidSchema):
        config.validate()
    ok = config.with_vector(v, VectorField("w", 5, DistanceMetric.DOT)).with_scalar(s).validate()
    assert ok.total_dimensions == 8 and ok.vector().name == "v" and ok.vector("w").dimension == 5 and ok.vector("x") is None and ok.scalar("s") == s
    assert CollectionConfig.from_json(ok.to_json()) == ok and ok.struct()["v"].metadata["dimension"] == 3
    assert DistanceMetric.parse("dot_product") is DistanceMetric.DOT and IndexKind.parse("ivf_p_q") is IndexKind.IVF_PQ and Quantization.parse("p_q").compression_ratio == 4
    assert IndexKind.HNSW.supports_quantization and not IndexKind.FLAT.supports_quantization


def test_catalog(spark, rows):
    a = Aliases()
    with pytest.raises(ValueError):
        a.set("", "x")
    assert a.set("live", "v1") is None and a.swap("live", "v2") == "v1" and a.get("live") == "v2" and "live" in a and len(a) == 1
    assert str(a) == "live -> v2" and a.remove("live") == "v2" and a.get("live") is None
    catalog = Catalog(spark)
    catalog.create("v1", rows)
    catalog.aliases.set("live", "v1")
    assert catalog.table("live").count() == len(ROWS)
    with pytest.raises(CollectionNotFound):
        catalog.table("none")


def test_records(spark, rows, tmp_path):
    made = records.records(rows, {"v": F.col("embedding")}, F.lit("{}"), F.lit(5))
    records.write(made, str(tmp_path / "r"), fmt="json")
    back = records.read(spark, str(tmp_path / "r"), fmt="json", schema=records.SCHEMA)
    assert back.where("id = 3").select(records.vector("v").alias("v")).first().v == [3.0, 4.0]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"0123456789")
    assert bytes(records.files(spark, str(tmp_path / "f"), offset=2, length=3).first().content) == b"234"


def test_change_stream(spark, tmp_path):
    from vantor.streaming.changelog import append_changes, change_stream, live_rows

    log = spark.createDataFrame([(1, "insert", 1, [1.0]), (2, "insert", 2, [2.0]), (3, "delete", 1, None)], "seq long, op string, id long, embedding array<float>")
    log.where("seq < 3").write.parquet(str(tmp_path / "in"))
    run = lambda: append_changes(change_stream(spark, str(tmp_path / "in"), log.schema), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert {r.id for r in live_rows(spark, str(tmp_path / "log")).collect()} == {1, 2}
    log.where("seq = 3").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.id for r in live_rows(spark, str(tmp_path / "log")).collect()} == {2}


def test_set_queries_take_all_ids(spark):
    from vantor.queries import queries

    sf = "/root/testdata/sf0.001"
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    got = {r.value: r.member for r in queries()["set_members_all"](spark, sf).collect()}
    assert len(got) > 100 and got == {k: v == 1 for k, v in labels.items()}
    assert sum(r.length for r in queries()["set_runs_all"](spark, sf).collect()) == sum(v != 1 for v in labels.values())


def test_runs_of_large_ids(spark):
    """Across the borders of parts, where doubles can't tell neighbours."""
    import random

    rng = random.Random(8)
    values = {c + d for c in ((1 << 62) - 5, -(1 << 62) + 3, (1 << 53) + (3 << 20), (1 << 63) - 40, -(1 << 63)) for d in rng.sample(range(40), 25)}
    for part in (8, 1 << 20):
        got = {(r.start, r.length) for r in sets.runs(spark.createDataFrame([(v,) for v in values], "value long"), part).collect()}
        want = {(v, next(n for n in range(1, 100) if v + n not in values)) for v in values if v - 1 not in values}
        assert got == want


def test_bits_change(spark):
    rng = np.random.default_rng(3)
    places = sorted(set(rng.integers(0, 70, 20).tolist()))
    row = sets.bits_of(spark.createDataFrame([(p,) for p in places], "value long"), 70)
    assert row.select(sets.bits_set("bitmap").alias("b")).first().b == places and len(row.first().bitmap) == 9
    for p in (0, 1, 8, 69, 71, 72, -1):
        r = row.select(sets.bits_set(sets.with_bit("bitmap", p)).alias("on"), sets.bits_set(sets.with_bit("bitmap", p, on=False)).alias("off")).first()
        assert r.on == (sorted({*places, p}) if 0 <= p < 72 else places) and r.off == [x for x in places if x != p]
    none = sets.bits_of(spark.createDataFrame([], "value long"), 0)
    assert bytes(none.first().bitmap) == b"" and none.select(sets.bits_set("bitmap").alias("b")).first().b == []


def test_batch_of_queries_scans_once(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (3000, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(f"r{i:04}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<float>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:1100])], "query_id int, query array<float>")
    for metric in ("l2", "cosine", "dot"):
        found = batch_knn(rows, queries, 7, metric=metric)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
        got = {}
        for r in found.where("query_id in (0, 600, 1099)").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 5) + 0.0))
        for q in (0, 600, 1099):
            if metric == "cosine" and not v[q].any():
                continue
            assert got[q] == [(r.id, round(r.score, 5) + 0.0) for r in knn(rows, v[q].tolist(), 7, metric=metric).collect()], (metric, q)
    with pytest.raises(TypeError):
        batch_knn(rows, queries.selectExpr("cast(query_id as double) query_id", "query"), 3)


def test_live_sorts_no_vectors(spark):
    log = spark.createDataFrame([(i % 5, "delete" if i % 7 == 0 else "update", i % 9, [float(i)]) for i in range(5)], "seq long, op string, id long, embedding array<float>")
    plan = changes.live(log)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
