"""A collection: vectors with ids and payloads, searched and changed through one object."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.functions.distance import Metric
from vantor.operators import changes
from vantor.operators.errors import DimensionMismatch, NotFound
from vantor.operators.search import batch_knn, knn


@dataclass(frozen=True)
class SearchParams:
    """How many neighbours a search is for."""

    k: int

    def increased(self) -> SearchParams:
        return SearchParams(2 * self.k)


@dataclass(frozen=True)
class Collection:
    """An immutable view: rows as they were loaded, and a log of what changed since. Changes give a new collection.

    base has the columns (id, embedding, payload), each id once; log also (seq, op), for changes after base. payload
    may be of any type. Nothing runs before an action but the counts that decide on a broadcast. last is the number
    of the log's last change, if known. Rows of one change have different ids; of two equal ones both are live.
    """

    base: DataFrame
    dimension: int
    metric: Metric = Metric.L2
    log: DataFrame | None = None
    last: int | None = None

    @classmethod
    def over(cls, rows: DataFrame, dimension: int, metric: Metric | str = Metric.L2, *, id_col: str = "id", vector_col: str = "embedding", payload: Column | None = None) -> Collection:
        """A collection of rows without changes."""
        kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), (F.lit(None).cast("string") if payload is None else payload).alias("payload"))
        return cls(kept, dimension, Metric.parse(str(metric)))

    def live(self) -> DataFrame:
        """The rows as they are now: those of base that no change touches, which stay where they are while changed ids are few, and the log's live ones."""
        if self.log is None:
            return self.base
        return changes.without(self.base, self.log).unionByName(changes.live(self.log))

    def history(self) -> DataFrame:
        """All changes, base's rows being the first inserts."""
        first = self.base.select(F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), "*")
        return first if self.log is None else first.unionByName(self.log)

    def search(self, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """(id, score), nearest first. A query of another dimension finds nothing."""
        return knn(self.live(), query, k, metric=self.metric, dimension=self.dimension, where=where)

    def search_with(self, query: Sequence[float], params: SearchParams, where: Column | None = None) -> DataFrame:
        return self.search(query, params.k, where)

    def search_many(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        return batch_knn(self.live(), queries, k, metric=self.metric, where=where)

    def get(self, key: int) -> DataFrame:
        return self.live().where(F.col("id") == key)

    def insert(self, rows: DataFrame, *, fail: bool = True) -> Collection:
        """Appends rows (id, embedding, payload). With fail, a vector of another dimension fails the query that reads it."""
        wrong = F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension
        if fail:
            message = F.concat(F.lit(f"dimension mismatch: expected {self.dimension}, actual "), F.coalesce(F.size("embedding"), F.lit(-1)).cast("string"))
            rows = rows.withColumn("embedding", F.when(wrong, F.raise_error(message).cast(rows.schema["embedding"].dataType)).otherwise(F.col("embedding")))
        else:
            rows = rows.where(~wrong)
        return self._with(rows, "insert")

    def update(self, rows: DataFrame) -> Collection:
        """New versions of rows, checked before the old ones go."""
        return self.insert(rows)

    def delete(self, ids: Sequence[int] | DataFrame) -> Collection:
        """Tombstones. Of ids given as a list, one that isn't live is an error; of a table's, it is nothing."""
        spark = self.base.sparkSession
        if not isinstance(ids, DataFrame):
            wanted = {int(i) for i in ids}
            if not wanted:
                return self
            found = {r.id for r in self.live().where(F.col("id").isin(list(wanted))).select("id").collect()}
            if wanted - found:
                raise NotFound(f"no live row has id {min(wanted - found)}")
            ids = spark.createDataFrame([(i,) for i in sorted(wanted)], "id long")
        gone = ids.select("id", *(F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in ("embedding", "payload")))
        return self._with(gone, "delete")

    def _with(self, rows: DataFrame, op: str) -> Collection:
        # a log given from outside is asked once; after that the number goes along
        at = 1 if self.log is None else self.last + 1 if self.last is not None else (self.log.agg(F.max("seq")).first()[0] or 0) + 1
        kinds = {c: self.base.schema[c].dataType for c in ("embedding", "payload")}
        new = rows.select(F.lit(at).cast("long").alias("seq"), F.lit(op).alias("op"), F.col("id").cast("long").alias("id"), F.col("embedding").cast(kinds["embedding"]).alias("embedding"), F.col("payload") if "payload" in rows.columns else F.lit(None).cast(kinds["payload"]).alias("payload"))
        return replace(self, log=new if self.log is None else self.log.unionByName(new), last=at)

    def checked_query(self, query: Sequence[float]) -> Sequence[float]:
        """The query, or an error if its dimension is another one."""
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        return query

    def count(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def stats(self) -> DataFrame:
        """(metric, dimension, stored, deleted, live, size_bytes): four bytes for an element, eight for an id, of stored rows."""
        sums = changes.counts(self.history())
        return sums.select(F.lit(str(self.metric)).alias("metric"), F.lit(self.dimension).alias("dimension"), "*", (F.col("stored") * (4 * self.dimension + 8)).alias("size_bytes"))
