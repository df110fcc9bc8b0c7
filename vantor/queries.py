"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor import queries_api
from vantor.functions import distance as D
from vantor.functions import hashing as H
from vantor.functions import packed as P
from vantor.functions import payload as V
from vantor.functions import sparse as S
from vantor.operators import changes, sets, topk
from vantor.operators.collection import Collection
from vantor.operators.search import batch_knn, knn
from vantor.plans.schema import CollectionConfig, DistanceMetric, IndexKind, Quantization, ScalarField, ScalarKind, VectorField
from vantor.sources import records

Query = Callable[[SparkSession, str], DataFrame]

#: Results are rounded to so many places, which both engines reach whatever order they sum in.
PLACES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, key: int = 0) -> list[float]:
    """One row's vector, found by a pushed-down filter."""
    return vectors(spark, sf_dir).where(F.col("id") == key).select("embedding").first()[0]


def rounded(c: Column) -> Column:
    return F.round(c, PLACES) + F.lit(0.0)


# Distances of all vectors to the first, and searches. {d} stands for a distance in the SQL.

_SQL_DISTANCE = {
    "l2": "list_distance(e, q)",
    "cosine": "1 - list_cosine_similarity(e, q)",
    "dot": "-list_inner_product(e, q)",
    "manhattan": "list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))",
    "hamming": "list_sum(list_transform(list_zip(e, q), lambda p: case when (p[1] > 0) <> (p[2] > 0) then 1.0 else 0.0 end))",
}
_SQL_PAIRS = "with r as (select vec_id as id, label, embedding::double[] as e, (select embedding::double[] from embeddings where vec_id = 0) as q from embeddings)"


def _all_distances(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", rounded(D.distance(metric)("embedding", q)).alias("score"))


def _knn(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, metric=metric).select("id", rounded(F.col("score")).alias("score"))


def _knn_where(where: Column, spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, where=where).select("id", rounded(F.col("score")).alias("score"))


def knn_no_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = 0, and a query of another dimension."""
    q, rows = query_vector(spark, sf_dir), vectors(spark, sf_dir)
    return knn(rows, q, 0).unionByName(knn(rows, q[:10], 5, dimension=64))


def knn_k_over_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 1_000_000, where=F.col("label") == 3).select("id", rounded(F.col("score")).alias("score"))


def batch_knn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of each vector of label 0."""
    rows = vectors(spark, sf_dir)
    queries = rows.where("label = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return batch_knn(rows, queries, 5).select("query_id", "id", "rank", rounded(F.col("score")).alias("score"))


def l2_squared_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", rounded(D.l2_squared("embedding", q)).alias("score"))


def similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", rounded(D.cosine_similarity("embedding", q)).alias("cosine_similarity"), rounded(D.dot("embedding", q)).alias("dot"), rounded(D.norm("embedding")).alias("norm"))


def hamming_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that differ in their bits."""
    q = query_vector(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", D.hamming_bits("embedding", F.lit(q).cast("array<float>")).alias("score"))


def safe_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector loses an element, every fifth all: what is wrong with the pair, or the distance."""
    q = query_vector(spark, sf_dir)
    size = F.when(F.col("id") % 5 == 0, 0).when(F.col("id") % 3 == 0, 63).otherwise(64)
    cut = vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", F.lit(1), size))
    return cut.select("id", D.l2_safe("embedding", q).alias("r")).select("id", rounded(F.col("r.value")).alias("value"), F.col("r.error").alias("error"))


# Changes: every seventh vector is deleted, every eleventh gets the first vector; an update outlives a delete.


def _changed(spark: SparkSession, sf_dir: str) -> Collection:
    rows = vectors(spark, sf_dir).select("id", "embedding", F.col("label").cast("string").alias("payload"))
    one = F.lit(query_vector(spark, sf_dir)).cast("array<float>")
    log = rows.where("id % 7 = 0").select(F.lit(1).cast("long").alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("payload"))
    log = log.unionByName(rows.where("id % 11 = 0").select(F.lit(2).cast("long").alias("seq"), F.lit("update").alias("op"), "id", one.alias("embedding"), "payload"))
    return Collection(rows, 64, log=log)


_SQL_LIVE = """with v as (select vec_id as id, label, case when vec_id % 11 = 0 then (select embedding from embeddings where vec_id = 0) else embedding end::double[] as e,
  (select embedding::double[] from embeddings where vec_id = 0) as q from embeddings where vec_id % 7 <> 0 or vec_id % 11 = 0)"""


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).live().select("id", "payload", rounded(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))).alias("total"))


def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).stats()


def live_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).search(query_vector(spark, sf_dir), 20, where=F.col("payload") != "3").select("id", rounded(F.col("score")).alias("score"))


def tombstone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return changes.without(rows, rows.where("label in (2, 5)").select("id")).select("id", "label")


# Payloads: the JSON of events.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("payload", V.parse("props"))


def payload_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = V.get("payload", "k")
    return _events(spark, sf_dir).select("event_id", V.kind(k).alias("kind"), V.as_int(k).alias("k"), V.as_str(k).alias("k_text"), V.contains_key("payload", "k").alias("has_k"), V.contains_key("payload", "z").alias("has_z"))


def payload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field put in, one replaced, one taken out."""
    p = V.put(V.put("payload", "n", F.parse_json(F.lit("1"))), "k", F.parse_json(F.lit('"new"')))
    return _events(spark, sf_dir).select("event_id", V.length(p).alias("fields"), V.as_str(V.get(p, "k")).alias("k"), F.to_json(V.remove(p, "k")).alias("rest"))


def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(V.as_int(V.get("payload", "k")).between(10, 19)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def payload_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole against fractional numbers, and numbers against text."""
    k = V.get("payload", "k")
    return _events(spark, sf_dir).select("event_id", V.compare(k, F.parse_json(F.lit("50.0"))).alias("to_fifty"), V.compare(k, F.parse_json(F.lit('"50"'))).alias("to_text"), V.equal(k, F.parse_json(F.lit("50"))).alias("is_fifty"))


def payload_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "payload")
    return V.entries(rows).select("event_id", "key", F.to_json("value").alias("value"))


# Sparse vectors: elements below 0.1 in size become 0.


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x))
    return vectors(spark, sf_dir).select("id", S.from_dense(small).alias("s"))


_SQL_SPARSE = "with s as (select vec_id as id, list_transform(embedding::double[], lambda x: case when abs(x) < 0.1::float then 0 else x end) as v, (select list_transform(embedding::double[], lambda x: case when abs(x) < 0.1::float then 0 else x end) from embeddings where vec_id = 0) as q from embeddings)"


def sparse_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sparse(spark, sf_dir)
    first = rows.where("id = 0").select(F.col("s").alias("q"))
    s = F.col("s")
    return rows.crossJoin(F.broadcast(first)).select("id", S.length(s).alias("entries"), S.dimension(s).alias("dimension"), rounded(S.norm(s)).alias("norm"), rounded(S.dot(s, F.col("q"))).alias("dot"), S.validate(s).isNull().alias("sound"), S.is_empty(s).alias("empty"))


def sparse_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("id", F.round(S.norm(S.normalize(F.col("s"))), 5).alias("norm"))


# Packed bits: a bit for each element above 0.


def packed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [sum(1 << i for i, x in enumerate(query_vector(spark, sf_dir)[at : at + 8]) if x > 0) for at in range(0, 64, 8)]
    bits, other = P.pack_signs("embedding"), F.lit(q)
    return vectors(spark, sf_dir).select("id", P.hamming(bits, other).alias("bits"), P.hamming_bytes(bits, other).alias("bytes"), rounded(P.jaccard(bits, other)).alias("jaccard"), rounded(P.jaccard_distance(bits, other)).alias("jaccard_distance"))



# Hashes and encodings of documents.


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256("text").alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", H.base64url("text").alias("encoded"), H.unbase64url(H.base64url("text")).cast("string").alias("decoded"), H.unbase64url(F.concat(H.base64url("text"), F.lit("!"))).isNull().alias("rejects"))


def xxhash_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published values of XXH64."""
    rows = spark.createDataFrame([("",), ("abc",)], "data string")
    return rows.select("data", F.hex(H.xxhash64("data")).alias("seed_0"))


def crc32c_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published values of CRC-32C."""
    rows = spark.createDataFrame([("zeros", bytes(32)), ("ones", b"\xff" * 32), ("rising", bytes(range(32))), ("empty", b"")], "name string, data binary")
    return rows.select("name", H.crc32c("data").alias("crc"))


def document_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH64 and CRC-32C of all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", H.xxhash64("text").alias("xxhash64"), H.crc32c(F.col("text").cast("binary")).alias("crc32c"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard by a hash of the id."""
    return vectors(spark, sf_dir).groupBy(H.shard("id", 8).alias("shard")).agg(F.count("*").alias("n"))


def hash128_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.hash128("text").alias("hash128"))


# Id sets.


def _set(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return sets.ids(vectors(spark, sf_dir).where(where), "id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.ids(table(spark, sf_dir, "documents"), "doc_id")


def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(_set(spark, sf_dir, "label = 1"), _documents(spark, sf_dir))


def set_intersection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(_set(spark, sf_dir, "label = 1"), _documents(spark, sf_dir))


def set_difference_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(_set(spark, sf_dir, "label = 1"), _documents(spark, sf_dir))


def set_members_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids are candidates."""
    return sets.members(_set(spark, sf_dir, "label = 1"), sets.ids(vectors(spark, sf_dir), "id"))


def set_runs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.runs(_set(spark, sf_dir, "label <> 1"))


def set_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.cardinality(sets.ids(table(spark, sf_dir, "lineitem"), "l_orderkey"))


def set_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the byte format and back."""
    return sets.decoded(sets.encoded(sets.ids(table(spark, sf_dir, "orders"), "o_orderkey"), optimise=True))


# Top-k, records, schema.


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    low, high = topk.smallest(rows, 5, "value", "event_id"), topk.largest(rows, 5, "value", "event_id")
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


def top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.smallest_of_each(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 3, "event_type", "value", "event_id")


def record_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two named vectors, through JSON and back."""
    rows = records.records(vectors(spark, sf_dir), {"full": F.col("embedding"), "head": F.slice("embedding", 1, 8)}, F.to_json(F.struct("label")), F.lit(0))
    back = records.from_json(records.to_json(rows))
    return back.select("id", records.num_vectors().alias("num_vectors"), records.total_dimension().alias("total_dimension"), F.size(records.vector("head")).alias("head"), records.vector("none").isNull().alias("no_such"), "version", "payload")


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = CollectionConfig("docs").with_vector(VectorField("embedding", 64, DistanceMetric.COSINE), VectorField("small", 8, DistanceMetric.DOT, IndexKind.FLAT, Quantization.SQ8)).with_scalar(ScalarField("lang", ScalarKind.STR), ScalarField("n_chars", ScalarKind.INT, indexed=True))
    return config.validate().describe(spark)


def enum_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("quantization", str(q), q.compression_ratio, None) for q in Quantization] + [("index", str(i), None, i.supports_quantization) for i in IndexKind]
    return spark.createDataFrame(rows, "kind string, name string, compression_ratio double, supports_quantization boolean")


_WHERE = {
    "knn_label": (F.col, "label = 4"),
    "knn_id_range": (F.col, "id between 100 and 300"),
    "knn_label_in": (F.col, "label in (1, 2)"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for metric in _SQL_DISTANCE:
        out[f"distance_{metric}"] = partial(_all_distances, metric)
        if metric != "manhattan":
            out[f"knn_{metric}"] = partial(_knn, metric)
    for name, (_, condition) in _WHERE.items():
        out[name] = lambda spark, sf_dir, condition=condition: _knn_where(F.expr(condition), spark, sf_dir)
    for f in (knn_no_rows, knn_k_over_n, batch_knn_label, l2_squared_all, similarity_all, hamming_unequal, safe_distance, live_rows, live_counts, live_knn, tombstone_anti_join, payload_getters, payload_changes, payload_filter, payload_compare, payload_entries, sparse_measures, sparse_normalized, packed_distances, digests, base64_round_trip, xxhash_known, crc32c_known, document_checksums, shards, hash128_documents, set_union_all, set_intersection_all, set_difference_all, set_members_all, set_runs_all, set_cardinality, set_bytes, top_values, top_of_each, record_measures, schema_fields, enum_facts):
        out[f.__name__] = f
    return out | queries_api.queries()


def oracle_sql() -> dict[str, str]:
    r = f"round(({{}})::double, {PLACES}) + 0.0"
    near = lambda d, where="true", k=10: f"{_SQL_PAIRS} select id, {r.format('s')} as score from (select id, {d} as s from r where {where} order by s, id limit {k})"
    out = {}
    for metric, d in _SQL_DISTANCE.items():
        out[f"distance_{metric}"] = f"{_SQL_PAIRS} select id, {r.format(d)} as score from r"
        if metric != "manhattan":
            out[f"knn_{metric}"] = near(d)
    for name, (_, condition) in _WHERE.items():
        out[name] = near(_SQL_DISTANCE["l2"], condition)
    picked = "select vec_id from embeddings where label = 1"
    return out | queries_api.oracle_sql() | {
        "knn_no_rows": "select vec_id as id, 0.0::double as score from embeddings limit 0",
        "knn_k_over_n": near(_SQL_DISTANCE["l2"], "label = 3", 1_000_000),
        "batch_knn_label": f"""with p as (select a.vec_id as query_id, b.vec_id as id, list_distance(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.label = 0)
          select query_id, id, rank::int as rank, {r.format('s')} as score from (select *, row_number() over (partition by query_id order by s, id) as rank from p) where rank <= 5""",
        "l2_squared_all": f"{_SQL_PAIRS} select id, {r.format('list_distance(e, q) * list_distance(e, q)')} as score from r",
        "similarity_all": f"{_SQL_PAIRS} select id, {r.format('list_cosine_similarity(e, q)')} as cosine_similarity, {r.format('list_inner_product(e, q)')} as dot, {r.format('sqrt(list_inner_product(e, e))')} as norm from r",
        "hamming_unequal": f"{_SQL_PAIRS} select id, list_sum(list_transform(list_zip(e, q), lambda p: case when p[1] <> p[2] then 1.0 else 0.0 end))::double as score from r",
        "safe_distance": f"""{_SQL_PAIRS} select id, case when id % 5 <> 0 and id % 3 <> 0 then {r.format('list_distance(e, q)')} end as value,
          case when id % 5 = 0 then 'length mismatch: expected 0, actual 64' when id % 3 = 0 then 'length mismatch: expected 63, actual 64' end as error from r""",
        "live_rows": f"{_SQL_LIVE} select id, label::varchar as payload, {r.format('list_sum(e)')} as total from v",
        "live_counts": """select 'l2' as metric, 64 as dimension, (count(*) + count(*) filter (vec_id % 11 = 0))::bigint as stored,
          (count(*) + count(*) filter (vec_id % 11 = 0) - count(*) filter (vec_id % 7 <> 0 or vec_id % 11 = 0))::bigint as deleted,
          count(*) filter (vec_id % 7 <> 0 or vec_id % 11 = 0)::bigint as live, ((count(*) + count(*) filter (vec_id % 11 = 0)) * 264)::bigint as size_bytes from embeddings""",
        "live_knn": f"{_SQL_LIVE} select id, {r.format('s')} as score from (select id, list_distance(e, q) as s from v where label <> 3 order by s, id limit 20)",
        "tombstone_anti_join": "select vec_id as id, label from embeddings where label not in (2, 5)",
        "payload_getters": "select event_id, 'int' as kind, json_extract(props, '$.k')::bigint as k, null::varchar as k_text, json_exists(props, '$.k') as has_k, json_exists(props, '$.z') as has_z from events",
        "payload_changes": "select event_id, 2 as fields, 'new' as k, '{\"n\":1}' as rest from events",
        "payload_filter": "select event_type, count(*) as n, round(sum(value), 4) as total from events where json_extract(props, '$.k')::bigint between 10 and 19 group by event_type",
        "payload_compare": "select event_id, sign(json_extract(props, '$.k')::bigint - 50)::int as to_fifty, null::int as to_text, json_extract(props, '$.k')::bigint = 50 as is_fifty from events",
        "payload_entries": "select event_id, e.key as key, e.value::varchar as value from events, json_each(props) e",
        "sparse_measures": f"""{_SQL_SPARSE} select id, len(list_filter(v, lambda x: x <> 0))::int as entries, 64 as dimension, {r.format('sqrt(list_inner_product(v, v))')} as norm,
          {r.format('list_inner_product(v, q)')} as dot, true as sound, len(list_filter(v, lambda x: x <> 0)) = 0 as empty from s""",
        "sparse_normalized": f"{_SQL_SPARSE} select id, case when list_inner_product(v, v) > 0 then 1.0::double end as norm from s",
        "packed_distances": f"""{_SQL_PAIRS}, b as (select id, list_transform(list_zip(e, q), lambda p: (p[1] > 0)::int) as x, list_transform(list_zip(e, q), lambda p: (p[2] > 0)::int) as y from r),
          c as (select id, list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) as bits, list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])) as common,
            list_sum(list_transform(list_zip(x, y), lambda p: greatest(p[1], p[2]))) as total, list_sum(list_transform(range(8), lambda i: (x[i * 8 + 1:i * 8 + 8] <> y[i * 8 + 1:i * 8 + 8])::int)) as bytes from b)
          select id, bits::double as bits, bytes::double as bytes, {r.format('common / total')} as jaccard, {r.format('1 - common / total')} as jaccard_distance from c""",
        "digests": "select doc_id, sha256(text) as sha256, strlen(text)::bigint as n_bytes from documents",
        "base64_round_trip": "select item_id, replace(replace(replace(base64(encode(text)), '=', ''), '+', '-'), '/', '_') as encoded, text as decoded, true as rejects from benchmark",
        "xxhash_known": "select * from (values ('', 'EF46DB3751D8E999'), ('abc', '44BC2CF5AD770999')) t(data, seed_0)",
        "crc32c_known": "select name, crc::bigint as crc from (values ('zeros', 2324772522), ('ones', 1655221059), ('rising', 1188919630), ('empty', 0)) t(name, crc)",
        "set_union_all": f"select vec_id as value from ({picked} union select doc_id from documents)",
        "set_intersection_all": f"select vec_id as value from ({picked} intersect select doc_id from documents)",
        "set_difference_all": f"select vec_id as value from ({picked} except select doc_id from documents)",
        "set_members_all": "select vec_id as value, label = 1 as member from embeddings",
        "set_runs_all": "select min(v) as start, count(*) as length from (select vec_id as v, vec_id - row_number() over (order by vec_id) as g from embeddings where label <> 1) group by g",
        "set_cardinality": "select count(distinct l_orderkey) as cardinality from lineitem",
        "set_bytes": "select distinct o_orderkey as value from orders",
        "top_values": "select * from (select event_id, value, 'low' as side from events order by value, event_id limit 5) union all select * from (select event_id, value, 'high' as side from events order by value desc, event_id limit 5)",
        "top_of_each": "select event_id, event_type, value, rank::int as rank from (select event_id, event_type, value, row_number() over (partition by event_type order by value, event_id) as rank from events) where rank <= 3",
        "record_measures": "select vec_id as id, 2 as num_vectors, 72 as total_dimension, 8 as head, true as no_such, 1::bigint as version, '{\"label\":' || label || '}' as payload from embeddings",
        "schema_fields": """select * from (values ('docs', 'embedding', 'vector', 'array<float>', 64, 'cosine', 'hnsw', 'none'), ('docs', 'small', 'vector', 'array<float>', 8, 'dot', 'flat', 'sq8'),
          ('docs', 'lang', 'scalar', 'str', null, null, null, null), ('docs', 'n_chars', 'scalar', 'int', null, null, 'auto', null)) t(collection, field, kind, data_type, dimension, metric, index_type, quantization)""",
        "enum_facts": """select kind, name, ratio::double as compression_ratio, supports as supports_quantization from (values ('quantization', 'none', 1, null), ('quantization', 'sq8', 4, null), ('quantization', 'sq4', 8, null), ('quantization', 'binary', 32, null), ('quantization', 'pq', 4, null),
          ('index', 'flat', null, false), ('index', 'hnsw', null, true), ('index', 'ivf', null, true), ('index', 'ivf_pq', null, true), ('index', 'vamana', null, true), ('index', 'paged', null, false)) t(kind, name, ratio, supports)""",
    }
