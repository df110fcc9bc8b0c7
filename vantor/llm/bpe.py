"""Byte-level BPE encoding by a trie of distinct words, and decoding.

Distinct pre-tokens are visited in sorted order, which is the depth-first order of their trie: the states of the
prefix that a word shares with the one before it are kept and each trie edge is worked out once. The state at a
node is the last token of the encoding of the node's prefix. Exactly one token that ends the prefix may follow the
state at the place where it starts, namely the one that merging leaves next to it; following the states from a
word's end back to the root gives its ids.
"""

from __future__ import annotations

import gc
import json
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import chunks, claim, small_batches
from vantor.llm.units import LONGEST_UNIT, UnitMemory, joinable, shared_prefix, stretches


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Distinct units whose ids a Python worker remembers between batches, and three fifths as many pre-tokens.
MOST_UNITS = 700_000
#: Units that are split in one call.
SPLIT_AT_ONCE = 256


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TrieBpe:
    """A byte-level BPE vocabulary in the tokenizers library's file format."""

    #: Pairs of tokens that are known to stand next to each other or not to.
    MOST_PAIRS = 400_000

    def __init__(self, path: str, most: int = MOST_UNITS) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.reach: dict[str, int] = {}  # by four letters: the longest token that ends with them
        for t in self.ids:
            if len(t) >= 4:
                self.reach[t[-4:]] = max(self.reach.get(t[-4:], 0), len(t))
        self.alone: dict[int, bool] = {}
        self.follows: dict[int, bool] = {}  # by first * 2**32 + second
        self.most, self.memory = most, UnitMemory(self.encode_units, most)
        self.words: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of lowest rank is merged, left to right, until none is left."""
        rank, none = self.ranks.get, (1 << 60, 0)
        while len(ids) > 1:
            found = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
            best = min(found)
            if best is none:
                break
            out, i = [], 0
            while i < len(ids):
                if i < len(found) and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def stands_alone(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merged([self.ids[c] for c in self.tokens[token]]) == [token]
        return self.alone[token]

    def may_follow(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        if pair not in self.follows:
            if len(self.follows) > self.MOST_PAIRS:
                self.follows.clear()
            self.follows[pair] = self.merged([self.ids[c] for c in self.tokens[a] + self.tokens[b]]) == [a, b]
        return self.follows[pair]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, given in byte letters."""
        out, before, last = {}, "", [-1]  # last[i]: last token of the encoding of the first i letters
        find, size, reach, known = self.ids.get, self.sizes, self.reach.get, self.follows.get
        for word in sorted(set(words)):
            del last[shared_prefix(before, word) + 1 :]
            for end in range(len(last), len(word) + 1):
                most = reach(word[end - 4 : end], 3) if end > 3 else end
                for start in range(max(0, end - most), end):
                    token = find(word[start:end])
                    if token is not None:
                        fits = known(last[start] << 32 | token) if start else self.stands_alone(token)
                        if fits or fits is None and self.may_follow(last[start], token):
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no token may end {word[:end][-40:]!r}: the vocabulary lacks a byte")
            before, at, ids = word, len(word), []
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            out[word] = ids[::-1]
        return out

    def pre_tokens(self, units: list[str]) -> list[list[str]]:
        """Pre-tokens of each unit. Units that may stand one behind the other are split as one text."""
        split, out = self.splitter.pre_tokenize_str, [[] for _ in units]
        spaced, lines, words, rest = joinable(units)
        for places, gap in ((spaced, 0), (lines, 0), (words, 1)):
            for i in range(0, len(places), SPLIT_AT_ONCE):
                some = places[i : i + SPLIT_AT_ONCE]
                text = "\n" * gap + ("\n" * gap).join([units[j] for j in some])
                ends, found = zip(some, accumulate([len(units[j]) + gap for j in some]), strict=True), []
                at, end = next(ends)
                for word, (_, to) in split(text):
                    found.append(word)
                    if to == end:
                        out[at] = found[gap:]
                        (at, end), found = next(ends, (-1, -1)), []
        for at in rest:
            out[at] = [w for w, _ in split(units[at])]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = self.pre_tokens(units)
        if len(self.words) > self.most * 3 // 5:
            self.words.clear()
        known = self.words
        known |= {w: little(ids) for w, ids in self.encode_words({w for words in cut for w in words} - known.keys()).items()}
        out = [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in cut]
        for w in {w for words in cut for w in words if len(w) > LONGEST_UNIT}:
            del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an added token's own text gives that token, as the library has it."""
        special = [any(a in t for a in self.added) for t in texts]
        out = self.memory.joined([t for t, s in zip(texts, special, strict=True) if not s])
        if any(special):
            rest = iter(out)
            out = [self._with_added(t) if s else next(rest) for t, s in zip(texts, special, strict=True)]
        return out

    def _with_added(self, text: str) -> bytes:
        for content, token in self.added.items():
            if content in text:
                return little([token]).join(self._with_added(part) if part else b"" for part in text.split(content))
        return self.memory.joined([text])[0]

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens in order of their ids, and where each token's start; one more place is their end."""
        back = {c: b for b, c in byte_letters().items()}
        found = {i: bytes(back[c] for c in t) for i, t in self.tokens.items()} | {i: c.encode() for c, i in self.added.items()}
        parts = [found.get(i, b"") for i in range(max(found) + 1)]
        return np.frombuffer(b"".join(parts), np.uint8), np.array([0, *accumulate(map(len, parts))])

    def decode(self, ids: bytes) -> str:
        letters, places = self.token_bytes
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = places[tokens]
        return letters[stretches(starts, places[tokens + 1] - starts)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _vocabulary(path: str, most: int) -> TrieBpe:
    """One for each Python worker."""
    return TrieBpe(path, most)


def vocabulary(path: str, most: int = MOST_UNITS) -> TrieBpe:
    claim("bpe", _vocabulary.cache_clear)
    return _vocabulary(path, most)


def bpe_round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_UNITS) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): each whole text's ids as little-endian unsigned 32-bit integers, and their text.

    One narrow pass without a shuffle; a worker remembers `most` distinct units. Null or empty texts have no
    ids and decode to "". Rows are kept one by one: null and repeated ids too. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, most)
        for batch in chunks(batches, "text"):
            gc.disable()  # no cycles are made, and looking for some among the memories takes a while
            try:
                ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def bpe_digests(docs: DataFrame, path: str, most: int = MOST_UNITS) -> DataFrame:
    """The digest columns of the query, worked out by Spark from the operator's ids and texts; null and empty texts have none."""
    return bpe_round_trip(docs, path, most=most).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
