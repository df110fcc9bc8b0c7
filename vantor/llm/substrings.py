"""Repeated passages: words under a window that also starts in a document with a smaller id.

Method: a sparse De Bruijn graph. Its nodes are the K-word mers that closed syncmers select: mers whose first or last
S-word part has the least hash of all their parts. Whether a mer is selected depends on its own words alone, so equal
windows have equal nodes, and any 2K - S - 1 words, hence any window, hold one. Nodes of two documents are kept; a
Spark aggregation finds those and a join brings back their source coordinates. Next nodes in a document that touch
or overlap are an edge, and an edge that is both ends' only one, at every occurrence, is unary: joining documents
with the degrees of nodes compacts runs of unary edges to paths. All occurrences of a path have the same words, so
its least document decides for all windows inside it. The other windows, those at a path's ends or across branches
and without a node of one document only, are compared by 128-bit digests of their words at their coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import Scratch, bounded, chunks

K, S = 25, 3
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio


def mer_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    count = len(w) - n + 1
    with np.errstate(over="ignore"):
        h = w[:count].copy()
        for i in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * MIX + w[i : i + count]
        return (h ^ (h >> np.uint64(32))) * MIX


def nodes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a document's closed syncmers."""
    if len(words) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = mer_hashes(w, S)
    span = K - S + 1
    low = parts
    width = 1
    while width < span:  # running minimum by doubling
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = np.flatnonzero((parts[: len(low)] == low) | (parts[span - 1 :] == low))
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(K):
            h = (h ^ (h >> np.uint64(29))) * MIX + w[at + i]
        h = (h ^ (h >> np.uint64(32))) * MIX
    return h.view(np.int64), at.astype(np.int32)


def split(text: str | None) -> list[bytes]:
    """Words: what ASCII white space separates."""
    return text.encode().split() if text else []


def read_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, digest, whole, nodes, at): digest of the word sequence, SHA-256 of the words joined by one space, nodes of texts of a window at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in chunks(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                words = split(text)
                joined = b" ".join(words)
                nodes, at = nodes_of(words) if len(words) >= window else (None, None)
                out.append((len(words), xxhash.xxh3_128_digest(joined), sha256(joined).hexdigest(), nodes, at))
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_words", "digest", "whole", "nodes", "at"])

    return docs.mapInArrow(run, "doc_id long, n_words long, digest binary, whole string, nodes array<long>, at array<int>")


def windows_of(texts: DataFrame, window: int) -> DataFrame:
    """(kind, digest, doc, mark, start, words) from texts with their repeated nodes.

    kind 0: words from start on that a path covers; 1: a window to look up; 2: one to look up in; 3: both.
    """

    def one(doc: int, text: str, nodes: list[dict]) -> Iterator[tuple[int, bytes | None, int, int]]:
        words = split(text)
        n = len(words) - window + 1
        _, every = nodes_of(words)
        at = np.array([x["at"] for x in nodes], np.int64)
        low, high = (np.array([x[c] for x in nodes], np.int64) for c in ("low", "high"))
        on = np.array([x["on"] for x in nodes], bool)  # joined to the next by a unary edge
        starts = np.arange(n)

        def inside(marks: np.ndarray) -> np.ndarray:
            """Whether a mer that begins at a mark lies in the window, for each start."""
            total = np.zeros(len(words) + 1, np.int64)
            total[1:] = np.cumsum(np.bincount(marks, minlength=len(words)))
            return total[starts + window - K + 1] - total[starts] > 0

        wanted = ~inside(np.setdiff1d(every, at))
        first = np.flatnonzero(np.r_[True, ~on[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        for a, b in zip(first, last, strict=True):
            begin, size = int(at[a]), int(at[b] + K - at[a])
            if size >= window:
                wanted[begin : begin + size - window + 1] = False
                if low[a] < doc:
                    yield 0, None, begin, size
        look, source = wanted & ~inside(at[low >= doc]), wanted & ~inside(at[high <= doc])
        picked = np.flatnonzero(look | source)
        if len(picked):
            ends = np.cumsum([len(w) + 1 for w in words])
            joined = b" ".join(words)
            for i in picked.tolist():
                mark = xxhash.xxh3_128_digest(joined[int(ends[i - 1]) if i else 0 : int(ends[i + window - 1]) - 1])
                yield int(look[i]) + 2 * int(source[i]), mark, i, window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for digest, doc, text, nodes in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc", "text", "nodes")), strict=True):
                if found := list(one(doc, text, nodes)):
                    kind, mark, start, size = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([digest] * len(kind), pa.binary()), pa.array([doc] * len(kind), pa.int64()), pa.array(mark, pa.binary()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["kind", "digest", "doc", "mark", "start", "words"])

    return texts.select("digest", "doc", "text", "nodes").mapInArrow(run, "kind int, digest binary, doc long, mark binary, start int, words int")


def without_spans(texts: DataFrame) -> DataFrame:
    """(digest, n_removed, kept): the words outside of the spans (start, words), joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = split(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [x["start"] for x in spans], 1)
                np.add.at(edge, [x["start"] + x["words"] for x in spans], -1)
                left = np.cumsum(edge)[:-1] == 0
                out.append((int(len(words) - left.sum()), b" ".join([w for w, x in zip(words, left.tolist(), strict=True) if x]).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["digest", "n_removed", "kept"])

    return texts.select("digest", "text", "spans").mapInArrow(run, "digest binary, n_removed long, kept string")


def repeated_spans(space: Scratch, docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, whole) for each row.

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id; windows are
    judged on the input. kept holds the words left, joined by one space, where any went, and is null where none did;
    whole is the SHA-256 of all words so joined. Null and empty texts have no words; of a row with a null id nothing
    goes, and it is nobody's source. Rows of one id don't count as each other's source. Other columns are left out.
    """
    if window < 2 * K - S - 1:
        raise ValueError(f"a window needs {2 * K - S - 1} words at least")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = space.table(read_words(plain, window))
    ided = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # texts of one word sequence are one class: its smallest document decides, the others go whole
    classes = space.table(ided.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("nodes").alias("nodes"), F.first("at").alias("at")))
    repeated = space.table(classes.select("doc", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high"))
    places = classes.select("digest", "doc", F.explode(F.arrays_zip(F.col("nodes").alias("node"), "at")).alias("x")).select("digest", "doc", "x.node", "x.at")
    places = places.join(bounded(repeated), "node").groupBy("digest", "doc").agg(F.array_sort(F.collect_list(F.struct("at", "node", "low", "high"))).alias("nodes"))
    places = space.table(places)
    # edges to the next node that touches or overlaps; 0 stands for none
    step = F.when(F.col("b.at") - F.col("a.at") <= K, F.xxhash64("a.node", "b.node", F.col("b.at") - F.col("a.at"))).otherwise(F.lit(0))
    pairs = places.select("digest", "doc", F.posexplode("nodes").alias("i", "a"), "nodes").select("digest", "doc", "i", "a", F.try_element_at("nodes", F.col("i") + 2).alias("b"), F.when(F.col("i") > 0, F.try_element_at("nodes", F.col("i"))).alias("z"))
    forth, back = F.coalesce(step, F.lit(0)), F.coalesce(F.when(F.col("a.at") - F.col("z.at") <= K, F.xxhash64("z.node", "a.node", F.col("a.at") - F.col("z.at"))), F.lit(0))
    pairs = space.table(pairs.select("digest", "doc", "a", forth.alias("forth"), back.alias("back")))
    degrees = pairs.groupBy(F.col("a.node").alias("node")).agg((F.min("forth") == F.max("forth")).alias("one_on"), (F.min("back") == F.max("back")).alias("one_back"))
    graph = pairs.join(degrees, F.col("a.node") == F.col("node")).groupBy("digest", "doc").agg(F.array_sort(F.collect_list(F.struct("a.at", "a.low", "a.high", "one_on", "one_back", "forth"))).alias("g"))
    following = F.transform("g", lambda x, i: F.struct(x["at"].alias("at"), x["low"].alias("low"), x["high"].alias("high"), (x["one_on"] & (x["forth"] != 0) & F.coalesce(F.try_element_at(F.col("g"), i + 2)["one_back"], F.lit(False))).alias("on")))
    graph = graph.select("digest", "doc", following.alias("nodes"))
    # texts of those documents, once
    found = space.table(plain.join(bounded(places.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi"))
    texts = space.table(with_digest(found).join(graph.withColumnRenamed("digest", "key"), F.col("digest") == F.col("key")).where("doc_id = doc").drop("key"))
    windows = space.table(windows_of(texts, window))
    # written out, so that the join below has two plain shuffles and Spark splits a mark that many documents share
    sources = space.table(windows.where("kind >= 2").groupBy("mark").agg(F.min("doc").alias("source")))
    hits = windows.where("kind in (1, 3)").join(sources, "mark").where("source < doc").select("digest", "start", "words")
    spans = hits.unionByName(windows.where("kind = 0").select("digest", "start", "words")).groupBy("digest").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    changed = space.table(without_spans(texts.select("digest", "text").join(spans, "digest"))).dropDuplicates(["digest"])
    fate = classes.select("digest", "doc").join(changed, "digest", "left")
    out = base.select("doc_id", "n_words", "digest", "whole").join(fate, "digest", "left")
    copy = F.col("doc") < F.col("doc_id")
    return out.select("doc_id", "n_words", F.coalesce(F.when(copy, F.col("n_words")).when(F.col("doc_id").isNotNull(), F.col("n_removed")), F.lit(0)).alias("n_removed"), F.when(copy, F.lit("")).when(F.col("doc_id").isNotNull(), F.col("kept")).alias("kept"), "whole")


def with_digest(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, text) with the digest of their word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            digests = [xxhash.xxh3_128_digest(b" ".join(split(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])

    return texts.mapInArrow(run, "doc_id long, text string, digest binary")


def repeated_span_digests(space: Scratch, docs: DataFrame) -> DataFrame:
    """The digest columns of the query; null and empty texts have no words, and nothing goes from a row with a null id."""
    return repeated_spans(space, docs).select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("whole")).alias("kept_sha256"))
