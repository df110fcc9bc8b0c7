"""A change log: rows (seq, op, id, embedding, payload); the last write of an id wins, and deletes end it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Operations that a log may hold.
OPS = ("insert", "update", "delete")


def live(log: DataFrame, *, order: str = "seq", op: str = "op", id_col: str = "id") -> DataFrame:
    """The live rows: each id's last change, unless that is a delete. Without seq and op.

    Only ids, numbers and operations are aggregated, in hash tables with partial results, so a hot id is combined where
    it is read and no vector is sorted; the last change of an id then picks its row by a join. A log must not hold two
    changes of an id under one number.
    """
    last = log.groupBy(F.col(id_col).alias("__id")).agg(F.max(order).alias("__last")).hint("shuffle_hash")
    kept = log.where(F.col(op) != "delete").join(last, (F.col(id_col) == F.col("__id")) & (F.col(order) == F.col("__last")))
    return kept.select(*(F.col(_quoted(c)) for c in log.columns if c not in (order, op)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Sets of ids of at most so many rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, tombstones: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id has no tombstone. A count decides whether tombstones are sent to the rows or both are shuffled."""
    ids = tombstones.select(id_col).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, id_col, "left_anti").select(*(F.col(_quoted(c)) for c in rows.columns))


def counts(log: DataFrame, *, order: str = "seq", op: str = "op", id_col: str = "id") -> DataFrame:
    """(stored, deleted, live), one row: stored rows are the inserts and updates ever made."""
    alive = F.col(op) != "delete"  # the last write is alive if it has a higher number than the last delete
    per_id = log.groupBy(id_col).agg(F.sum(alive.cast("long")).alias("stored"), F.max(F.when(alive, F.col(order))).alias("on"), F.max(F.when(~alive, F.col(order))).alias("off"))
    live_ = F.coalesce(F.col("on") > F.col("off"), F.col("on").isNotNull())
    total = per_id.agg(F.coalesce(F.sum("stored"), F.lit(0)).cast("long").alias("stored"), F.coalesce(F.sum(live_.cast("long")), F.lit(0)).cast("long").alias("live"))
    return total.select("stored", (F.col("stored") - F.col("live")).alias("deleted"), "live")
