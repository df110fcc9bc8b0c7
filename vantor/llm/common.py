"""Shared pieces of the training-data operators: tables, scratch space, links between rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python workers hand back batches of about this many bytes of text.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir. Unset, it is a folder of our own for a session on one machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = Path(tempfile.gettempdir(), "vantor-shared").as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


#: Rows go to Python in Arrow batches of about so many bytes, so that long texts bound them and not only their count.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables and files under the shared folder that live as long as one operator call."""

    def __init__(self, spark: SparkSession) -> None:
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/vantor-{uuid.uuid4().hex}", 0

    def folder(self, name: str) -> str:
        """An existing folder, as a URI."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at := f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return at

    def table(self, df: DataFrame) -> DataFrame:
        """df written as Parquet and read back: its lineage ends here and survives lost executors."""
        self.n += 1
        df.write.parquet(at := f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame | None = None) -> None:
        """Deletes a table that table() returned, or everything."""
        for at in [self.root] if df is None else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Scratch space that is deleted at the end; results that leave it must be checkpointed first."""
    space = Scratch(spark)
    try:
        yield space
    finally:
        space.drop()


def give_back() -> None:
    """What Arrow and the C library hold of freed memory goes back to the system, where the executor's JVM needs it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _trim():
    with contextlib.suppress(OSError, AttributeError):
        return ctypes.CDLL(None).malloc_trim


_TRIM = _trim()


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A name for a column beside df's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that each holds about CHUNK_BYTES of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * CHUNK_BYTES / max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        give_back()


def components(space: Scratch, links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for each node that has a link.

    Alternates the large-star and small-star steps of Kiveris et al., so the number of rounds grows with the
    logarithm of a component's size; each round is written out. Only a checksum row is collected.
    """
    edges = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = space.table(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest one of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = space.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        space.drop(edges)
        edges = new
        if before == (before := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b")))).first()):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Sets of ids of at most so many rows (16 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """ids, marked for a broadcast if a count shows that they are few; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def with_value(docs: DataFrame, text_col: str, work_out: Callable[[list[str | None]], list], kind: pa.DataType, ddl: str) -> DataFrame:
    """(row, value): each whole row as a struct, whatever its columns are called, and what work_out has for its text. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "row"):
            text = batch.column("row").field(text_col)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(work_out(text.to_pylist()), kind)], ["row", "value"])

    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    return packed.mapInArrow(run, T.StructType([packed.schema[0], T.StructField("value", T.DataType.fromDDL(ddl))]))


_HOLDER: list = []


def claim(name: str, release: Callable[[], None]) -> None:
    """Makes `name` the one operator that keeps tables in this Python worker; the one before gives its memory back.

    Workers outlive their tasks and serve all operators of a job, whose memories would add up otherwise.
    """
    if _HOLDER and _HOLDER[0] == name:
        return
    if _HOLDER:
        _HOLDER[1]()
        gc.collect()
        give_back()
    _HOLDER[:] = [name, release]
