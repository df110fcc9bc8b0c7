"""Registered queries of the object interface, validated forms, payload kinds, sparse batches, bits and declarations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.functions import distance as D
from vantor.functions import hashing as H
from vantor.functions import packed as P
from vantor.functions import payload as V
from vantor.functions import sparse as S
from vantor.operators import sets
from vantor.operators.collection import Collection, SearchParams
from vantor.operators.errors import DimensionMismatch, InvalidSchema, NotFound, VantorError
from vantor.operators.search import by_function, knn
from vantor.plans.catalog import Catalog
from vantor.plans.schema import CollectionConfig, DistanceMetric, IndexKind, Quantization, ScalarField, ScalarKind, VectorField

PLACES = 6


def rounded(c):
    return F.round(c, PLACES) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return vectors(spark, sf_dir).where("id = 0").select("embedding").first()[0]


# Changes through the object: label 3 is deleted, then comes back with the first vector under label 7's ids too.


def _collection(spark: SparkSession, sf_dir: str) -> Collection:
    rows = vectors(spark, sf_dir)
    first = F.lit(query_vector(spark, sf_dir)).cast("array<float>")
    held = Collection.over(rows, 64, payload=F.col("label").cast("string"))
    held = held.delete(rows.where("label = 3").select("id"))
    again = rows.where("label in (3, 7)").select("id", first.alias("embedding"), F.lit("again").alias("payload"))
    held = held.insert(again.where("payload = 'again'"))
    held = held.update(rows.where("label = 5").select("id", F.reverse("embedding").alias("embedding"), F.lit("turned").alias("payload")))
    return held.delete([0] if rows.where("id = 0").first().label not in (3, 7) else [1])


_SQL_LIVE = """with f as (select embedding::double[] as q, case when label in (3, 7) then 1 else 0 end as gone from embeddings where vec_id = 0),
  v as (select vec_id as id, case when label in (3, 7) then q when label = 5 then list_reverse(embedding::double[]) else embedding::double[] end as e,
    case when label in (3, 7) then 'again' when label = 5 then 'turned' else label::varchar end as payload, q from embeddings, f where vec_id <> gone)"""


def collection_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return _collection(spark, sf_dir).live().select("id", "payload", F.round(total, 4).alias("total"))


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With parameters and a filter; parameters asked for twice as many."""
    held, q = _collection(spark, sf_dir), query_vector(spark, sf_dir)
    out = held.search_with(q, SearchParams(10).increased(), where=F.col("payload") != "again")
    return out.select("id", rounded("score").alias("score"))


def collection_search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, q = _collection(spark, sf_dir), query_vector(spark, sf_dir)
    return held.search_with(q, SearchParams(15)).select("id", rounded("score").alias("score"))


def collection_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional fetch of a changed row, a deleted one, and one that never was."""
    held = _collection(spark, sf_dir)
    out = held.get(0)
    for key in (1, 2, 3, 10**9):
        out = out.unionByName(held.get(key))
    return out.select("id", "payload")


def collection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    held = _collection(spark, sf_dir)
    empty = Collection.over(rows.limit(0), 64)
    gone = Collection.over(rows, 64).delete(rows.select("id"))
    facts = [("held", held.is_empty(), held.count()), ("empty", empty.is_empty(), empty.count()), ("gone", gone.is_empty(), gone.count())]
    return spark.createDataFrame(facts, "name string, is_empty boolean, n long")


def collection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrong calls raise."""
    held = Collection.over(vectors(spark, sf_dir), 64)

    def said(call: Callable) -> str:
        try:
            call()
        except VantorError as e:
            return type(e).__name__
        return "nothing"

    cases = {
        "unknown id": (lambda: held.delete([10**12]), NotFound),
        "short query": (lambda: held.checked_query([1.0]), DimensionMismatch),
        "sound query": (lambda: held.checked_query([0.0] * 64), None),
        "no vector field": (lambda: CollectionConfig("c").validate(), InvalidSchema),
        "dimension 0": (lambda: CollectionConfig("c").with_vector(VectorField("v", 0)).validate(), InvalidSchema),
        "field twice": (lambda: CollectionConfig("c").with_vector(VectorField("v", 1), VectorField("v", 2)).validate(), InvalidSchema),
        "scalar twice": (lambda: CollectionConfig("c").with_vector(VectorField("v", 1)).with_scalar(ScalarField("s", ScalarKind.INT), ScalarField("s", ScalarKind.STR)).validate(), InvalidSchema),
        "unknown metric": (lambda: DistanceMetric.parse("cubic"), None),
        "unknown index": (lambda: IndexKind.parse("tree"), None),
        "unknown quantization": (lambda: Quantization.parse("sq3"), None),
        "no such collection": (lambda: Catalog(spark).table("none"), None),
    }
    return spark.createDataFrame([(name, said(call)) for name, (call, _) in cases.items()], "name string, error string")


def knn_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that only Python has."""
    rows = vectors(spark, sf_dir)
    return knn(rows, query_vector(spark, sf_dir), 10, where=by_function(lambda key, label: (key + label) % 4 == 1, "id", "label")).select("id", rounded("score").alias("score"))


# Validated forms: one pair in five is unequal, one empty, one has NaN.


def safe_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    size = F.when(F.col("label") == 1, 63).when(F.col("label") == 2, 0).otherwise(64)
    v = F.slice("embedding", F.lit(1), size)
    v = F.when(F.col("label") == 4, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).otherwise(v)
    other = F.slice(D.vector(q), F.lit(1), F.when(F.col("label") == 2, 0).otherwise(64))
    rows = vectors(spark, sf_dir).withColumn("v", v).withColumn("q", other)
    forms = {"l2": D.l2_safe, "cosine": D.cosine_similarity_safe, "dot": D.dot_safe, "manhattan": D.manhattan_safe}
    out = rows.select("id", *(f("v", "q").alias(n) for n, f in forms.items()))
    value = lambda n: F.when(~F.isnan(f"{n}.value"), rounded(F.col(f"{n}.value")))
    return out.select("id", *(c for n in forms for c in (value(n).alias(n), F.col(f"{n}.error").alias(f"{n}_error"))))


def safe_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bits: every other pair is of unequal length."""
    bits = P.pack_signs("embedding")
    cut = F.when(F.col("id") % 2 == 0, bits).otherwise(F.slice(bits, 1, 7))
    r = P.hamming_safe(cut, P.pack_signs(F.lit(query_vector(spark, sf_dir))))
    return vectors(spark, sf_dir).select("id", r.alias("r")).select("id", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


# Payloads of all kinds, made of events.


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = F.struct((F.col("event_id") % 90).alias("lat"), (F.col("event_id") % 7 + 0.5).alias("lon"))
    parts = {"f": F.col("event_id") + 0.25, "b": F.col("event_id") % 2 == 0, "l": F.array(F.col("event_id"), F.lit(5)), "place": place, "s": F.col("event_type"), "n": F.lit(None).cast("string")}
    text = F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "false"})
    return events.select("event_id", V.parse(text).alias("payload"))


def payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed getter on its own kind, and on another one."""
    f, b, items, place, s = (V.get("payload", k) for k in ("f", "b", "l", "place", "s"))
    geo = V.as_geo(place)
    return _payloads(spark, sf_dir).select(
        "event_id", V.kind(f).alias("f_kind"), V.as_float(f).alias("f"), V.as_int(f).alias("f_as_int"), V.kind(b).alias("b_kind"), V.as_bool(b).alias("b"), V.as_bool(s).alias("s_as_bool"),
        V.kind(items).alias("l_kind"), F.size(V.as_list(items)).alias("l_size"), V.as_list(s).isNull().alias("s_no_list"), V.kind(place).alias("place_kind"), geo["lat"].alias("lat"), geo["lon"].alias("lon"),
        V.as_geo(items).isNull().alias("l_no_geo"), V.number(f).alias("number"), V.as_str(s).alias("s"),
    )


def payload_geo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By latitude, then longitude; lists can't be compared."""
    place, items = V.get("payload", "place"), V.get("payload", "l")
    fixed = F.parse_json(F.lit('{"lat": 45, "lon": 3.5}'))
    return _payloads(spark, sf_dir).select("event_id", V.compare(place, fixed).alias("to_fixed"), V.compare(items, items).alias("lists"), V.comparable(place, items).alias("mixed"), V.equal(items, items).alias("same"))


def payload_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a map, and their entries one by one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    built = V.put(V.put(V.empty(), "id", F.col("event_id").cast("variant")), "type", F.col("event_type").cast("variant"))
    return V.entries(events.select("event_id", built.alias("payload"))).select("event_id", "key", F.to_json("value").alias("value"))


# Sparse vectors.


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.15, F.lit(0.0).cast("float")).otherwise(x))
    return vectors(spark, sf_dir).select("id", "label", S.from_dense(small).alias("s"))


def sparse_batch_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each vector of label 0 with all vectors that share an index."""
    rows = _sparse(spark, sf_dir)
    scaled = F.col("dot") * 10.0**PLACES
    # as rounded(), but by doubles: F.round goes through decimals, which take longer than all else here
    near = F.when(F.abs(scaled) < 2.0**52, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**PLACES).otherwise(rounded("dot"))
    return S.batch_dot(rows.where("label = 0"), rows).select("a", "b", (near + 0.0).alias("dot"))


_SQL_SPARSE = """with d as (select vec_id as id, label, unnest(range(64)) as i, unnest(embedding::double[]) as x, unnest(embedding) as y from embeddings),
  s as (select id, label, i, x from d where abs(y) >= 0.15)"""


def sparse_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that break a rule, and equality, for which the dimension doesn't count."""
    last = F.struct(F.reverse("s.indices").alias("indices"), F.col("s.values").alias("values"), F.lit(64).alias("dimension"))
    twice = F.struct(F.transform("s.indices", lambda i: F.lit(4)).alias("indices"), F.col("s.values").alias("values"), F.lit(64).alias("dimension"))
    short = F.struct(F.col("s.indices").alias("indices"), F.slice("s.values", 2, 64).alias("values"), F.lit(64).alias("dimension"))
    wide = F.struct(F.col("s.indices").alias("indices"), F.col("s.values").alias("values"), F.lit(99).alias("dimension"))
    rows = _sparse(spark, sf_dir).where(S.length(F.col("s")) >= 2)
    s = F.col("s")
    return rows.select("id", S.validate(s).isNull().alias("sound"), S.validate(last).isNotNull().alias("falling"), S.validate(twice).isNotNull().alias("twice"), S.validate(short).isNotNull().alias("short"), S.equal(s, wide).alias("same"), S.equal(s, last).alias("same_turned"), F.size(S.to_dense(s)).alias("dense"))


# Hashes, sets, bits, declarations.


def crc32c_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of a text's two parts, one after the other, is that of the whole."""
    data = F.col("text").cast("binary")
    head, tail = F.substring(data, F.lit(1), F.lit(20)), F.substring(data, F.lit(21), F.lit((1 << 31) - 1))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return rows.select("doc_id", (H.crc32c_combine(H.crc32c(head), tail) == H.crc32c(data)).alias("same"))


def shards_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the first ids, by XXH64 of their eight bytes."""
    return spark.range(10).select("id", H.shard("id", 16).alias("shard"))


def set_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set without members: how many it has, its runs, and what is left of others."""
    none, some = sets.ids(vectors(spark, sf_dir).where("label < 0"), "id"), sets.ids(vectors(spark, sf_dir), "id")
    facts = [("members", sets.cardinality(none)), ("union", sets.cardinality(sets.union(some, none))), ("common", sets.cardinality(sets.intersection(some, none))), ("runs", sets.runs(none).agg(F.count("*").alias("cardinality")))]
    out = None
    for name, df in facts:
        row = df.select(F.lit(name).alias("name"), F.col("cardinality").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def set_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set's values in order."""
    return sets.ascending(sets.ids(vectors(spark, sf_dir).where("label <> 6"), "id"))


def set_large_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ids near both ends of 64 bits, across the borders of parts."""
    at = [(1 << 62) - 3, -(1 << 62) - 2, (1 << 53) + 3 * (1 << 20) - 3]
    rows = spark.range(5).select(F.explode(F.array(*(F.lit(a) + F.col("id") for a in at))).alias("value"))
    return sets.runs(rows)


def bitset_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits set from a column, one more set, one cleared, all cleared; which are set, and how many."""
    bits = sets.bits_of(vectors(spark, sf_dir).where("label = 2").select((F.col("id") % 256).alias("place")), 256, "place")
    more = sets.with_bit(sets.with_bit("bitmap", 9), 250)
    less = sets.with_bit(more, 9, on=False)
    out = bits.select(F.posexplode(F.array("bitmap", more, less, sets.cleared("bitmap"), sets.with_bit("bitmap", 256))).alias("step", "b"))
    return out.select("step", sets.bits_set("b").alias("held"), sets.bit(F.col("b"), 9).alias("nine"), F.octet_length("b").alias("n_bytes")).select("step", F.size("held").cast("long").alias("n"), F.array_join("held", ",").alias("held"), "nine", "n_bytes")


def schema_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = CollectionConfig("two").with_vector(VectorField("a", 64), VectorField("b", 8)).with_scalar(ScalarField("lang", ScalarKind.STR))
    again = CollectionConfig.from_json(two.to_json())
    rows = [(c.name, c.total_dimensions, len(c.scalar_fields), c.problem() is None) for c in (two, again, CollectionConfig("none"))]
    return spark.createDataFrame(rows, "name string, total_dimensions long, n_scalars long, sound boolean")


def alias_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names moved from one collection to another; what each change gave back, and rows by an alias."""
    catalog = Catalog(spark)
    rows = vectors(spark, sf_dir)
    catalog.create("vantor_old", rows.where("label < 5"), replace=True)
    catalog.create("vantor_new", rows.where("label >= 5"), replace=True)
    steps = [("first", catalog.aliases.set("now", "vantor_old")), ("swap", catalog.aliases.swap("now", "vantor_new")), ("other", catalog.aliases.set("then", "vantor_old"))]
    n = catalog.table("now").count()
    steps += [("target", catalog.aliases.get("now")), ("removed", catalog.aliases.remove("then")), ("gone", catalog.aliases.get("then")), ("rows", str(n)), ("left", str(catalog.aliases))]
    return spark.createDataFrame(steps, "step string, value string")


QUERIES = (
    collection_live, collection_search, collection_search_plain, collection_get, collection_facts, collection_errors, knn_by_function, safe_forms, safe_bits, payload_kinds, payload_geo_order,
    payload_built, sparse_batch_dot, sparse_bad, crc32c_chained, shards_known, set_empty, set_ascending, set_large_runs, bitset_ops, schema_totals, alias_moves,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    r = f"round(({{}})::double, {PLACES}) + 0.0"
    near = lambda where, k: f"{_SQL_LIVE} select id, {r.format('s')} as score from (select id, list_distance(e, q) as s from v where {where} order by s, id limit {k})"
    bad = "case when label = 1 then 'length mismatch: expected 63, actual 64' when label = 2 then 'empty vector'"
    safe = lambda d: f"case when label not in (1, 2, 4) then {r.format(d)} end"
    bits = "select distinct vec_id % 256 as i from embeddings where label = 2"
    steps = {0: bits, 1: f"{bits} union select 9 union select 250", 2: f"select i from ({bits} union select 250) where i <> 9", 3: f"select i from ({bits}) where false", 4: bits}
    return {
        "collection_live": f"{_SQL_LIVE} select id, payload, round(list_sum(list_transform(list_zip(e, range(1, 65)), lambda p: p[1] * p[2])), 4) as total from v",
        "collection_search": near("payload <> 'again'", 20),
        "collection_search_plain": near("true", 15),
        "collection_get": f"{_SQL_LIVE} select id, payload from v where id in (0, 1, 2, 3)",
        "collection_facts": "select 'held' as name, false as is_empty, count(*) - 1 as n from embeddings union all select 'empty', true, 0 union all select 'gone', true, 0",
        "collection_errors": """select * from (values ('unknown id', 'NotFound'), ('short query', 'DimensionMismatch'), ('sound query', 'nothing'), ('no vector field', 'InvalidSchema'), ('dimension 0', 'InvalidSchema'), ('field twice', 'InvalidSchema'),
          ('scalar twice', 'InvalidSchema'), ('unknown metric', 'InvalidMetric'), ('unknown index', 'InvalidIndexKind'), ('unknown quantization', 'InvalidQuantization'), ('no such collection', 'CollectionNotFound')) t(name, error)""",
        "knn_by_function": f"""with v as (select vec_id as id, list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from embeddings where (vec_id + label) % 4 = 1)
          select id, {r.format('s')} as score from (select * from v order by s, id limit 10)""",
        "safe_forms": f"""with v as (select vec_id as id, label, embedding::double[] as e, (select embedding::double[] from embeddings where vec_id = 0) as q from embeddings)
          select id, {safe('list_distance(e, q)')} as l2, {bad} when label = 4 then 'NaN in vector' end as l2_error, {safe('list_cosine_similarity(e, q)')} as cosine, {bad} end as cosine_error,
            {safe('list_inner_product(e, q)')} as dot, {bad} end as dot_error, {safe('list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))')} as manhattan, {bad} end as manhattan_error from v""",
        "safe_bits": """with v as (select vec_id as id, embedding as e, (select embedding from embeddings where vec_id = 0) as q from embeddings)
          select id, case when id % 2 = 0 then list_sum(list_transform(list_zip(e, q), lambda p: ((p[1] > 0) <> (p[2] > 0))::int))::double end as value, case when id % 2 = 1 then 'length mismatch: expected 7, actual 8' end as error from v""",
        "payload_kinds": """select event_id, 'float' as f_kind, event_id + 0.25::double as f, null::bigint as f_as_int, 'bool' as b_kind, event_id % 2 = 0 as b, null::boolean as s_as_bool, 'list' as l_kind, 2 as l_size, true as s_no_list,
          'geo' as place_kind, (event_id % 90)::double as lat, (event_id % 7 + 0.5)::double as lon, true as l_no_geo, event_id + 0.25::double as number, event_type as s from events""",
        "payload_geo_order": """select event_id, case when event_id % 90 <> 45 then sign(event_id % 90 - 45)::int else sign(event_id % 7 + 0.5 - 3.5)::int end as to_fixed, null::int as lists, false as mixed, true as same from events""",
        "payload_built": "select event_id, 'id' as key, event_id::varchar as value from events union all select event_id, 'type', '\"' || event_type || '\"' from events",
        "sparse_batch_dot": f"{_SQL_SPARSE} select s.id as a, t.id as b, {r.format('sum(s.x * t.x)')} as dot from s join s t on s.i = t.i where s.label = 0 group by 1, 2",
        "sparse_bad": f"{_SQL_SPARSE} select id, true as sound, true as falling, true as twice, true as short, true as same, false as same_turned, 64 as dense from s group by id having count(*) >= 2",
        "crc32c_chained": "select doc_id, true as same from documents where text is not null",
        "shards_known": f"select * from (values {', '.join(f'({i}, {s})' for i, s in enumerate(SHARDS))}) t(id, shard)",
        "set_empty": "select 'members' as name, 0 as n union all select 'union', count(*) from embeddings union all select 'common', 0 union all select 'runs', 0",
        "set_ascending": "select vec_id as value from embeddings where label <> 6",
        "set_large_runs": "select * from (values (4611686018427387901, 5), (-4611686018427387906, 5), (9007199257886717, 5)) t(start, length)",
        "bitset_ops": " union all ".join(f"select {i} as step, count(*) as n, coalesce(string_agg(i, ',' order by i), '') as held, coalesce(bool_or(i = 9), false) as nine, 32 as n_bytes from ({s})" for i, s in steps.items()),
        "schema_totals": "select * from (values ('two', 72, 1, true), ('two', 72, 1, true), ('none', 0, 0, false)) t(name, total_dimensions, n_scalars, sound)",
        "alias_moves": "select step, value from (values ('first', null), ('swap', 'vantor_old'), ('other', null), ('target', 'vantor_new'), ('removed', 'vantor_old'), ('gone', null), ('left', 'now -> vantor_new')) t(step, value) union all select 'rows', count(*)::varchar from embeddings where label >= 5",
    }


# XXH64 of the numbers 0 to 9 as eight little-endian bytes, modulo 16.
SHARDS = (11, 5, 0, 1, 11, 13, 3, 5, 14, 12)
