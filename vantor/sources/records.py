"""Vector records: (id, vectors, payload, version, created_at, updated_at), read and written as Parquet or JSON lines, and raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, vectors map<string, array<float>>, payload string, version long, created_at long, updated_at long"


def records(rows: DataFrame, vectors: dict[str, Column], payload: Column | None = None, now: Column | None = None) -> DataFrame:
    """Records of version 1 from rows with an id; payload is JSON text."""
    now = F.unix_timestamp() if now is None else now
    pairs = [x for name, v in vectors.items() for x in (F.lit(name), v.cast("array<float>"))]
    return rows.select(F.col("id").cast("long").alias("id"), F.create_map(*pairs).alias("vectors"), (F.lit("{}") if payload is None else payload).alias("payload"), F.lit(1).cast("long").alias("version"), now.cast("long").alias("created_at"), now.cast("long").alias("updated_at"))


def vector(name: str) -> Column:
    """A named vector of a record; NULL without it."""
    return F.try_element_at("vectors", F.lit(name))


def num_vectors() -> Column:
    return F.size("vectors")


def total_dimension() -> Column:
    return F.aggregate(F.map_values("vectors"), F.lit(0), lambda n, v: n + F.size(v))


def to_json(rows: DataFrame) -> DataFrame:
    """(value): each row as one line of JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def from_json(lines: DataFrame, schema: str = SCHEMA, column: str = "value") -> DataFrame:
    """Rows of lines of JSON; a line that isn't a record gives NULLs."""
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def write(rows: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "append") -> None:
    rows.write.mode(mode).format(fmt).save(path)


def read(spark: SparkSession, path: str, *, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def files(spark: SparkSession, path: str, *, offset: int = 0, length: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, size, content) of whole files, or of a part of each: what mapping a file gives, without the mapping."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    part = F.col("content") if not offset and length is None else F.substring("content", F.lit(offset + 1), F.lit((1 << 31) - 1 - offset if length is None else length))
    return rows.select("path", F.col("length").alias("size"), part.alias("content"))
