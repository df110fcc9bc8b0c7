"""Exact nearest neighbours: one query or many, with a predicate before the distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.distance import Metric, distance

#: Queries that are scored together, rows of them with which, and bytes of scores held for that.
QUERY_BLOCK, ROW_BLOCK = 512, 2048
#: Bytes of query vectors that may be sent to all tasks; beyond that, queries go in as few passes as keep it.
QUERY_BYTES = 256 << 20
KEYS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def knn(rows: DataFrame, query: Sequence[float], k: int, *, metric: Metric | str = Metric.L2, dimension: int | None = None, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score), nearest first, ties by id, NaN last; at most k rows.

    The predicate stands below the distance, so it reaches the scan and k survivors are found if there are as many.
    The plan is scan, filter, project, TakeOrderedAndProject: each task keeps k rows. A query of another length than
    `dimension`, or k = 0, finds nothing.
    """
    if where is not None:
        rows = rows.where(where)
    size = len(query) if dimension is None else dimension
    if k <= 0 or size != len(query) or not size:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    scored = rows.where(F.size(vector_col) == size).select(F.col(id_col).alias("id"), distance(metric)(F.col(vector_col), query).alias("score"))
    return scored.orderBy(F.col("score").asc_nulls_last(), "id").limit(k)


def batch_knn(rows: DataFrame, queries: DataFrame, k: int, *, metric: Metric | str = Metric.L2, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_id, id, rank, score): the k nearest rows of each query, nearest first, ties by id, NaN last.

    One scan of the rows serves all queries, up to QUERY_BYTES of their vectors: they are sent to every task, which
    scores tiles of ROW_BLOCK rows by QUERY_BLOCK queries with one matrix product each and keeps k rows of each query,
    so only those are shuffled. Rows and queries of different lengths don't meet; null vectors or ids find nothing.
    Ids of both sides are whole numbers or text.
    """
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, query_id), (rows, id_col))]
    if not set(kinds) <= KEYS.keys():
        raise TypeError(f"ids must be of {', '.join(KEYS)}, not {kinds}")
    if k <= 0:
        return queries.limit(0).select(F.col(query_id).alias("query_id"), F.lit(None).cast(kinds[1]).alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    if where is not None:
        rows = rows.where(where)
    metric = Metric.parse(str(metric))
    whole = lambda c: f"{c} is not null and not exists({c}, x -> x is null)"
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(f"id is not null and {whole('v')}")
    held = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).where(f"query_id is not null and {whole('q')}")
    size = held.agg(F.sum(8 * F.size("q") + 64)).first()[0] or 0
    out, parts = None, max(1, -(-size // QUERY_BYTES))
    for p in range(parts):
        by_size: dict[int, tuple[list, list]] = {}
        for r in held.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toLocalIterator():
            ids, vectors = by_size.setdefault(len(r.q), ([], []))
            ids.append(r.query_id)
            vectors.append(np.array(r.q, float))
        sent = rows.sparkSession.sparkContext.broadcast({n: (ids, np.array(v, float).reshape(len(ids), n)) for n, (ids, v) in by_size.items()})
        found = plain.mapInArrow(partial(nearest, sent=sent, k=k, metric=metric, kinds=kinds), f"query_id {kinds[0]}, id {kinds[1]}, score double")
        out = found if out is None else out.unionByName(found)
    near = Window.partitionBy("query_id").orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def smallest(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least scores of each line with their names, ties by name."""
    if scores.shape[1] > 4 * k:  # all that is below the k-th score, and what ties with it, without sorting the rest
        edge = np.partition(scores, k - 1, axis=1)[:, k - 1 : k]
        near = (scores <= edge) | np.isnan(edge)
        most = int(near.sum(axis=1).max())
        order = np.argsort(~near, axis=1, kind="stable")[:, :most]
        scores, names, near = (np.take_along_axis(x, order, 1) for x in (scores, names, near))
        scores = np.where(near, scores, np.inf)  # those of lines with fewer come last, past the k-th
    order = np.lexsort((names, scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def nearest(batches: Iterator[pa.RecordBatch], *, sent, k: int, metric: Metric, kinds: list[str]) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): the k nearest of a task's rows for each query that was sent."""
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # by length and first query of a block
    for batch in batches:
        sizes, flat = batch.column("v").value_lengths().to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False)
        ids, starts = batch.column("id").to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        ids = ids.astype(str) if kinds[1] == "string" else ids
        for n, (_, q) in sent.value.items():
            at = np.flatnonzero(sizes == n)
            for i in range(0, len(at), ROW_BLOCK):
                some = at[i : i + ROW_BLOCK]
                v = flat[starts[some][:, None] + np.arange(n)[None, :]].reshape(len(some), n)
                for j in range(0, len(q), QUERY_BLOCK):
                    scores = pairwise(metric, q[j : j + QUERY_BLOCK], v)
                    scores, names = smallest(scores, np.broadcast_to(ids[some], scores.shape), k)
                    if (n, j) in best:
                        scores, names = smallest(np.concatenate((best[n, j][0], scores), axis=1), np.concatenate((best[n, j][1], names), axis=1), k)
                    best[n, j] = scores, names
    schema = pa.schema([("query_id", KEYS[kinds[0]]), ("id", KEYS[kinds[1]]), ("score", pa.float64())])
    for (n, j), (scores, names) in best.items():
        keys = [x for x in sent.value[n][0][j : j + QUERY_BLOCK] for _ in range(names.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(names.ravel().tolist(), schema[1].type), pa.array(scores.ravel())], schema=schema)


def pairwise(metric: Metric, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) in double precision, as the column builders have them."""
    if metric is Metric.DOT:
        return 0.0 - q @ v.T
    if metric is Metric.COSINE:
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        return 1 - np.where(size == 0, 0, q @ v.T / np.where(size == 0, 1, size))
    if metric is Metric.HAMMING:
        a, b = (q > 0).astype(float), (v > 0).astype(float)
        return a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * a @ b.T
    # differences rather than |q|^2 + |v|^2 - 2qv, which loses the digits of near pairs
    out = np.empty((len(q), len(v)))
    for i, x in enumerate(q):
        d = v - x
        out[i] = np.abs(d).sum(axis=1) if metric is Metric.MANHATTAN else np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def by_function(accept: Callable[[int, object], bool], *columns: str) -> Column:
    """A predicate from a Python function of some columns, for what columns can't say; it can't be pushed to the scan."""
    @F.pandas_udf("boolean")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([bool(accept(*values)) for values in zip(*series, strict=True)])

    return run(*columns)
