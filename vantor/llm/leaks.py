"""Benchmark decontamination: pigeonhole pieces, exact piece hits, and Myers' bit-parallel edit distance over words.

An item of n words may differ from a passage by a budget of n // ERROR_WORDS words put in, left out or changed. Cut to
one piece more than that, it has a piece without an error in every such passage, so pieces are looked up exactly, each
by its whole length, and only the passages around hits are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import claim, quoted, unused, with_value

ERROR_WORDS = 6
#: Words that an item needs unless a caller takes shorter ones too.
PIECE = 5
#: Items of so many at a time are sent to the tasks.
BLOCK_ITEMS = 20_000
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def budget(n: int) -> int:
    """Errors allowed to an item of n words: a sixth."""
    return n // ERROR_WORDS


def pieces(n: int) -> list[tuple[int, int]]:
    """Where each of the budget-plus-one pieces of n words begins and ends."""
    parts = budget(n) + 1
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def hashes(words: list[str], sizes: Iterable[int]) -> dict[int, np.ndarray]:
    """For each of some sizes, ascending, a hash of each so many words in a row."""
    out, done = {}, 1
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = w
    with np.errstate(over="ignore"):
        for size in sizes:
            if size > len(w):
                break
            for i in range(done, size):
                h = (h[: len(w) - i] ^ (h[: len(w) - i] >> np.uint64(29))) * MIX + w[i:]
            done = size
            out[size] = (h ^ (h >> np.uint64(32))) * MIX
    return out


def masks_of(item: list[str]) -> dict[str, int]:
    """For each word of the pattern, the places where it stands."""
    out: dict[str, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def best_distance(masks: dict[str, int], size: int, text: list[str]) -> int:
    """Least edit distance of the pattern to any run of words in text, by Myers' bit vectors (1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, size
    for w in text:
        eq = masks.get(w, 0)
        across = eq | minus
        eq |= (((eq & plus) + plus) ^ plus) & full
        up, down = minus | (full & ~(eq | plus)), plus & eq
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(across | up)), up & across
    return best


class Items:
    """Items by the hashes of their pieces."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], min_words: int = PIECE) -> None:
        self.items = [(key, w, masks_of(w)) for key, text in items if len(w := words_of(text)) >= max(1, min_words)]
        places: dict[int, list[tuple[int, int, int]]] = {}
        for i, (_, w, _) in enumerate(self.items):
            cut = pieces(len(w))
            of_size = hashes(w, sorted({end - start for start, end in cut}))
            for start, end in cut:
                places.setdefault(end - start, []).append((int(of_size[end - start][start]), i, start))
        #: For each length of pieces, their hashes in order and the item and start of each.
        self.pieces = {n: (np.array([p[0] for p in some], np.uint64), [p[1:] for p in some]) for n, some in sorted((n, sorted(s)) for n, s in places.items())}

    def hits(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place in words, item, place in the item) of each piece that the words hold."""
        for n, h in hashes(words, self.pieces).items():
            known, places = self.pieces[n]
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            for at in np.flatnonzero(high > low).tolist():
                for i, start in places[low[at] : high[at]]:
                    yield at, i, start

    def found(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item, least distance) of each item that a passage of the text holds within its budget, in order."""
        words = words_of(text)
        best: dict[int, int] = {}
        seen = set()
        for at, i, start in self.hits(words):
            key, item, masks = self.items[i]
            errors = budget(len(item))
            first = max(0, at - start - errors)
            if best.get(i) == 0 or (i, first) in seen:
                continue
            seen.add((i, first))
            distance = best_distance(masks, len(item), words[first : at - start + len(item) + errors])
            if distance <= errors:
                best[i] = min(distance, best.get(i, distance))
        return sorted(((self.items[i][0], d) for i, d in best.items()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = PIECE) -> DataFrame:
    """(row, leaks): each row as a struct, and the (item_id, distance) of each item that its text holds.

    Words are runs of word characters, lower-cased. Items of fewer than min_words words match nothing; short ones that
    are let in match exactly, as a sixth of their words is none. Null and empty texts hold nothing. Rows aren't shuffled: items go to the tasks in blocks of
    about BLOCK_ITEMS, each block passing over the rows, so benchmarks of any size do with bounded memory.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = -(-items.count() // BLOCK_ITEMS) or 1
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))
    held = unused(docs, "leaks")
    out = docs.withColumn(held, F.array().cast("array<struct<item_id: long, distance: long>>")) if blocks > 1 else docs
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work_out(texts: list[str | None], sent=sent) -> list:
            table = _items(sent, min_words)
            return [[{"item_id": i, "distance": d} for i, d in table.found(t)] for t in texts]

        found = with_value(out, text_col, work_out, kind, "array<struct<item_id: long, distance: long>>")
        if blocks == 1:
            return found.select("row", F.col("value").alias("leaks"))
        out = found.select(*(F.col(f"row.{quoted(c)}") for c in docs.columns), F.concat(F.col(f"row.{quoted(held)}"), "value").alias(held))
    return out.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(held)).alias("leaks"))


_HELD: dict[tuple[int, int], tuple[list, Items]] = {}


def _items(sent, min_words: int) -> Items:
    """The tables of a block, made once for each Python worker and block."""
    claim("leaks", _HELD.clear)
    block = sent.value
    key = id(block), min_words
    if key not in _HELD or _HELD[key][0] is not block:
        if len(_HELD) > 1:
            _HELD.clear()
        _HELD[key] = block, Items(block, min_words)
    return _HELD[key][1]


def leak_report(docs: DataFrame, benchmark: DataFrame, *, min_words: int = PIECE) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, least_distance) of each row; null and empty texts hold nothing, and nor does an empty benchmark's."""
    found = leaks(docs.select("doc_id", "text"), benchmark, min_words=min_words)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.col("leaks.item_id").alias("item_ids"), F.array_min(F.col("leaks.distance")).alias("least_distance"))
