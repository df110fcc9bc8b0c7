"""Schemaless payloads: VARIANT columns that hold a JSON object, with strictly typed getters and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.functions.distance import _column

# What schema_of_variant calls the kinds.
_FLOAT = r"^(DECIMAL.*|DOUBLE|FLOAT)$"


def parse(text: Column | str) -> Column:
    """JSON text as a payload; NULL if it isn't JSON."""
    return F.try_parse_json(_column(text))


def empty() -> Column:
    return F.parse_json(F.lit("{}"))


def get(payload: Column | str, key: str) -> Column:
    """The field's value, as VARIANT; NULL without it."""
    return F.try_variant_get(_column(payload), _path(key), "variant")


def _path(key: str) -> str:
    if "'" in key or "\\" in key:
        raise ValueError("a payload key can't hold quotes or backslashes here")
    return f"$['{key}']"


def contains_key(payload: Column | str, key: str) -> Column:
    return get(payload, key).isNotNull()


def kind(value: Column) -> Column:
    """int, float, str, bool, list, geo, object, or NULL for nothing."""
    name = F.schema_of_variant(value)
    number = lambda path: F.regexp_like(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"))
    return (
        F.when(name == "BIGINT", "int")
        .when(name.rlike(_FLOAT), "float")
        .when(name == "STRING", "str")
        .when(name == "BOOLEAN", "bool")
        .when(name.startswith("ARRAY"), "list")
        .when(name.startswith("OBJECT") & number("$.lat") & number("$.lon"), "geo")
        .when(name.startswith("OBJECT"), "object")
    )


def _typed(value: Column, wanted: str, cast: str) -> Column:
    return F.when(kind(value) == wanted, F.try_variant_get(value, "$", cast))


def as_int(value: Column) -> Column:
    """Only whole numbers; nothing is converted."""
    return _typed(value, "int", "bigint")


def as_float(value: Column) -> Column:
    return _typed(value, "float", "double")


def as_str(value: Column) -> Column:
    return _typed(value, "str", "string")


def as_bool(value: Column) -> Column:
    return _typed(value, "bool", "boolean")


def as_list(value: Column) -> Column:
    return _typed(value, "list", "array<variant>")


def as_geo(value: Column) -> Column:
    """struct(lat, lon), which Spark orders by latitude, then longitude."""
    return F.when(kind(value) == "geo", F.struct(F.try_variant_get(value, "$.lat", "double").alias("lat"), F.try_variant_get(value, "$.lon", "double").alias("lon")))


def number(value: Column) -> Column:
    """Whole and fractional numbers as doubles."""
    return F.coalesce(as_int(value).cast("double"), as_float(value))


def comparable(a: Column, b: Column) -> Column:
    """Same kind, or both numbers; lists never are."""
    x, y = kind(a), kind(b)
    return F.coalesce(((x == y) & ~x.isin("list", "object")) | (x.isin("int", "float") & y.isin("int", "float")), F.lit(False))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NULL for what can't be compared, so that filters drop the row."""
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    whole = order(as_int(a), as_int(b))
    return F.when(comparable(a, b), F.coalesce(whole, order(number(a), number(b)), order(as_str(a), as_str(b)), order(as_bool(a), as_bool(b)), order(as_geo(a), as_geo(b))))


def equal(a: Column, b: Column) -> Column:
    """Same kind and value: the whole number 1 isn't the fraction 1.0, though neither is less."""
    return F.coalesce((kind(a) == kind(b)) & (F.to_json(a) == F.to_json(b)), F.lit(False))


def fields(payload: Column | str) -> Column:
    """The payload as a map of VARIANTs; NULL for what isn't an object."""
    return F.from_json(F.to_json(_column(payload)), "map<string, variant>")


def entries(rows: DataFrame, column: str = "payload") -> DataFrame:
    """The rows once for each field of their payload, with (pos, key, value); none for payloads without fields."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer()))


def from_map(values: Column) -> Column:
    """A payload of a map's entries."""
    return F.to_variant_object(values)


def length(payload: Column | str) -> Column:
    return F.size(F.map_keys(fields(payload)))


def remove(payload: Column | str, key: str) -> Column:
    return from_map(F.map_filter(fields(payload), lambda k, _: k != key))


def put(payload: Column | str, key: str, value: Column) -> Column:
    """With the field set to a VARIANT, in place of what it was."""
    rest = F.map_filter(fields(payload), lambda k, _: k != key)
    return from_map(F.map_concat(rest, F.create_map(F.lit(key), value)))
