"""Token counts under a unigram model, by dynamic programming along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import chunks, claim, small_batches
from vantor.llm.units import shared_prefix

#: Stands for the white space before a word in the vocabulary's pieces.
WORD_START = "▁"


class TrieUnigram:
    """Pieces of a sentencepiece vocabulary with integer costs: a million times ln(rank + 2), so sums are exact.

    A character that no piece has falls back to its UTF-8 bytes, each at BYTE_COST, as one step of so many tokens.
    """

    BYTE_COST = 20_000_000

    def __init__(self, path: str, most: int = 400_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.costs = {model.id_to_piece(i): round(1e6 * math.log(rank + 2)) for rank, i in enumerate(plain)}
        self.longest = max(map(len, self.costs))
        self.most, self.known = most, {}

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of the cheapest segmentation of each distinct word; of equal costs, the fewest tokens.

        Words are visited in sorted order, the depth-first order of their trie; the forward scores of a shared
        prefix are kept, and a word's count is read at its terminal node.
        """
        out, before, best = {}, "", [(0, 0)]  # best[i]: cost and tokens of the first i characters
        find = self.costs.get
        for word in sorted(set(words)):
            del best[shared_prefix(before, word) + 1 :]
            for end in range(len(best), len(word) + 1):
                size = len(word[end - 1].encode())
                low = (best[end - 1][0] + size * self.BYTE_COST, best[end - 1][1] + size)
                for n in range(1, min(end, self.longest) + 1):
                    cost = find(word[end - n : end])
                    if cost is not None:
                        at = best[end - n]
                        low = min(low, (at[0] + cost, at[1] + 1))
                best.append(low)
            before, out[word] = word, best[-1][1]
        return out

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text; words are what ASCII white space separates."""
        cut = [t.encode().split() for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = {w: WORD_START + w.decode() for w in set().union(*cut) - self.known.keys()}
        found = self.count_words(new.values())
        large = {w: found[x] for w, x in new.items() if len(w) > 64}
        self.known |= {w: found[x] for w, x in new.items() if len(w) <= 64}
        if not large:
            return [(len(ws), sum(map(self.known.__getitem__, ws))) for ws in cut]
        return [(len(ws), sum(self.known[w] if w in self.known else large[w] for w in ws)) for ws in cut]


@lru_cache(maxsize=1)
def _model(path: str) -> TrieUnigram:
    """One for each Python worker."""
    return TrieUnigram(path)


def model(path: str) -> TrieUnigram:
    claim("unigram", _model.cache_clear)
    return _model(path)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row's whole text, in one narrow pass.

    Null and empty texts have no tokens. Null and repeated ids stay rows of their own; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model(path)
        for batch in chunks(batches, "text"):
            counts = counter.counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
