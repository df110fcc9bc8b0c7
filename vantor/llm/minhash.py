"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full sets, connected components.

Two permutations make all coordinates (C-MinHash, Li & Li 2022): the first, sigma, scatters the hashed shingles over
a circle of slots, the second, pi, is shifted by one slot for each coordinate. With pi laid out in memory, the values
of one shingle in all coordinates are the run of pi that starts at its slot, so a signature is the minimum of runs.

Texts with equal sets are one class from the start. Members of a band's bucket are never all paired. Each is compared
with the bucket's hub, its most central member (that with the fullest buckets), on full sets. Members that link with
the hub are in one component. For the others, let x differ from hub p by D(x), the shingles that one of the two lacks,
and weigh the a shingles lacking in x by 100 and the b lacking in p by t, the threshold in per cent: w(x) = 100 a + t b.
Then x and y link exactly if (100 + t) |D(x) & D(y)| >= w(x) + w(y) - (100 - t) |p|. So where a hub's members are in
several components, their short lists of differences decide the rest: members are dealt to blocks by weight, blocks
whose weights can't meet the need are never brought together, each two others meet in one small group that counts
common differences by a matrix product, and only links that join two components leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import Scratch, bounded, chunks, claim, components

#: Slots of the circle; sets much larger than this only get more candidates, never fewer.
SLOTS = 1 << 21
#: Rows of a band. Bands are as many as keep the chance to miss a pair at the threshold below MISS.
ROWS, MISS = 4, 1e-7
#: Members of a salted part of one hub's comparisons, and of a block of members that one hub keeps apart.
PART, BLOCK = 256, 256
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


class CirculantMinHash:
    def __init__(self, coordinates: int, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sigma = rng.permutation(SLOTS).astype(np.uint32)
        pi = rng.permutation(SLOTS).astype(np.uint32)
        self.runs = sliding_window_view(np.concatenate((pi, pi[: coordinates - 1])), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = self.sigma[(shingles >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)]
        return np.minimum.reduce([self.runs[slots[i : i + 2048]].min(axis=0) for i in range(0, len(slots), 2048)])


@lru_cache(maxsize=1)
def _hasher(coordinates: int) -> CirculantMinHash:
    """One for each Python worker."""
    return CirculantMinHash(coordinates)


def hasher(coordinates: int) -> CirculantMinHash:
    claim("minhash", _hasher.cache_clear)
    return _hasher(coordinates)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `width` words; ASCII letters are lower-cased, ASCII white space separates.

    With fewer words, the whole sequence is the one shingle; without words the set is empty.
    """
    words = text.encode().lower().split() if text else []
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - width + 1
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for i in range(1, width):
            h = (h ^ (h >> np.uint64(29))) * MIX + w[i : i + n]
        h = (h ^ (h >> np.uint64(32))) * MIX
    return np.unique(h)


def compared(own: np.ndarray, hub: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """Weight of own's differences from the hub, and these; the two link if the weight is at most (100 - percent) |hub|."""
    both = hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own
    missing = hub[own[np.minimum(np.searchsorted(own, hub), len(own) - 1)] != hub]
    rest = own[~both]
    return 100 * len(missing) + percent * len(rest), np.concatenate((rest, missing)).view(np.int64)


def joining(rep: list[int], component: list[int], weight: np.ndarray, slack: int, differences: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among a few members of one hub that join their components: a spanning forest of all such links."""
    row = np.repeat(np.arange(len(rep)), [len(d) for d in differences])
    _, column, count = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    row, column = row[count[column] > 1], rank[column[count[column] > 1]]
    common = np.zeros((len(rep), len(rep)), np.float32)
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        here = (column >= start) & (column < start + 4096)
        m = np.zeros((len(rep), 4096), np.float32)
        m[row[here], column[here] - start] = 1
        common += m @ m.T
    link = np.triu((100 + percent) * common.astype(np.int64) >= weight[:, None] + weight[None, :] - slack, 1)
    top = {c: c for c in component}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
        a, b = find(component[i]), find(component[j])
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((rep[i], rep[j]))
    return out


def signatures(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): set size, 128-bit digest of the set, bucket of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, salt = hasher(bands * ROWS), np.arange(bands, dtype=np.uint64) * MIX
        for batch in chunks(batches, "text"):
            sizes, digests, buckets = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not len(s):
                    buckets.append(None)
                    continue
                sig = minhash.signature(s)
                with np.errstate(over="ignore"):
                    h = salt.copy()
                    for column in sig.reshape(bands, ROWS).T:
                        h = (h ^ (h >> np.uint64(31))) * MIX + column
                    h = (h ^ (h >> np.uint64(32))) * MIX
                buckets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def comparisons(space: Scratch, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, hub, nth, slack, weight, differences) for each pair (a, hub) and text of the hub, from full sets; those with weight <= slack link.

    A hub's comparisons are dealt to parts of about PART members, and its text goes to each part once; rows arrive
    sorted, the hub first, so a task holds one hub's set and one batch.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    member = dealt.join(texts, dealt.a == texts.doc_id).select("hub", "part", F.lit(1).alias("kind"), F.col("a").alias("id"), "text")
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.join(texts, heads.hub == texts.doc_id).select("hub", "part", F.lit(0).alias("kind"), F.col("hub").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            found = []
            for hub, part, kind, at, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "kind", "id", "text")), strict=True):
                if (hub, part) != now:
                    now, sets = (hub, part), []
                s = shingle_set(text, width)
                if not kind:
                    sets += [s] if len(s) else []
                elif len(s):
                    found += [(at, hub, i, (100 - percent) * len(x), *compared(s, x, percent)) for i, x in enumerate(sets)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["a", "hub", "nth", "slack", "weight", "differences"])

    rows = member.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return space.table(rows.mapInArrow(run, "a long, hub long, nth int, slack long, weight long, differences array<long>"))


def past_hubs(space: Scratch, done: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members of one hub that are in different components.

    Members of large hubs are dealt to blocks of about BLOCK by classes of weight that grow by a quarter; classes
    whose least need is above their most differences, or that link with the hub on both sides, don't meet.
    """
    done = done.where("nth = 0")  # an id with several texts is compared as its first one past this point
    member = done.join(component, done.a == component.node, "left").withColumn("component", F.coalesce("component", "a")).drop("node")
    mixed = member.groupBy("hub", "slack").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("hub", "slack", "n")
    member = space.table(member.join(mixed, ["hub", "slack"]).withColumn("class", F.when(F.col("n") > BLOCK, F.floor(F.log(1.25, F.col("weight") + 1))).otherwise(0).cast("int")))
    classes = member.groupBy("hub", "slack", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.max(F.size("differences")).alias("most"))
    other = classes.select("hub", "slack", *(F.col(c).alias(f"{c}_2") for c in ("class", "blocks", "low", "high", "most")))
    meet = classes.join(other, ["hub", "slack"]).where(((F.col("low") + F.col("low_2") - F.col("slack")) <= (100 + percent) * F.least("most", "most_2")) & ~((F.col("high") <= F.col("slack")) & (F.col("high_2") <= F.col("slack"))))
    meet = meet.groupBy("hub", "slack", "class", "blocks").agg(F.collect_list(F.struct("class_2", "blocks_2")).alias("others"))
    place = lambda c, b: c.cast("long") * (1 << 32) + b
    dealt = member.join(meet, ["hub", "slack", "class"]).withColumn("own", place(F.col("class"), F.pmod(F.xxhash64("a"), F.col("blocks"))))
    dealt = dealt.withColumn("with", F.explode(F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["blocks_2"] - 1), lambda k: place(o["class_2"], k))))))
    dealt = dealt.select("hub", "slack", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "a", "component", "weight", "differences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def ended() -> list[tuple[int, int]]:
            if len({r[1] for r in rows}) < 2:
                return []
            reps, comps, weights, lists = zip(*rows, strict=True)
            return joining(list(reps), list(comps), np.array(weights, np.int64), now[1], list(lists), percent)

        for batch in batches:
            found = []
            lists = batch.column("differences")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(lists.value_lengths().to_pylist())]).tolist()
            for i, (*key, a, component, weight) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "slack", "x", "y", "a", "component", "weight")), strict=True)):
                if key != now:
                    found += ended()
                    now, rows = key, []
                rows.append((a, component, weight, values[ends[i] : ends[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = ended()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return space.table(dealt.repartition("hub", "slack", "x", "y").sortWithinPartitions("hub", "slack", "x", "y").mapInArrow(run, "a long, b long"))


def with_hubs(groups: DataFrame) -> DataFrame:
    """Distinct (a, hub) for each member of groups (key, rep, weight) and its group's most central member."""
    middle = groups.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("hub"))
    return groups.join(middle, "key").where("rep <> hub").select(F.col("rep").alias("a"), "hub").distinct()


def near_duplicates(space: Scratch, docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Two documents are linked if 100 x intersection >= percent x union of their sets of `width`-word shingles;
    component_id is the smallest doc_id that links lead to, itself included, and kept marks the row that has it.
    Null or empty texts have an empty set and no link. A null id is linked with nothing: its component is null and
    it is kept. Rows that share an id are one node with several texts. Other columns are left out.
    """
    bands = bands_for(percent / 100)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = space.table(signatures(plain, width, bands))
    classes = space.table(base.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    places = space.table(placed.join(shared, "bucket"))
    weight = space.table(places.groupBy("rep").agg(F.sum("n").alias("weight")))
    pairs = space.table(with_hubs(places.join(weight, "rep").select(F.col("bucket").alias("key"), "rep", "weight")))
    texts = space.table(plain.join(bounded(weight.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi"))
    done = comparisons(space, pairs, texts, width, percent)
    links = done.where("weight <= slack").select("a", F.col("hub").alias("b"))
    component = components(space, links)
    component = components(space, links.unionByName(past_hubs(space, done, component, percent)))
    ends = classes.join(component, classes.rep == component.node, "left").select("digest", "rep", F.coalesce("component", "rep").alias("end"))
    out = base.select("doc_id", "n_shingles", "digest").join(ends.select("digest", "end"), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("end", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

