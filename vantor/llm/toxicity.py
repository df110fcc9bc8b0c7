"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

What is scored is a unit: a word, or a run of single characters with white space between them taken as one word.
A sentence's score is that of its worst unit, a text's that of its worst sentence. The kernel counts common
subsequences of ORDER characters, each weighed by DECAY to the power of the lengths that it spans in both strings
(Lodhi et al. 2002); it is normalised and put through a radial function, so inserted and gapped characters lower it
somewhat and unrelated words have next to none.

Training is multiple-instance: a sentence of a toxic text is toxic for some unit of it. Witnesses are the units of
those sentences for which, over all labelled texts, the share of toxic texts is surely above a half. Landmarks are
witnesses that aren't alike, and the clean units most similar to them. The machine is trained on kernel features of
the witnesses against clean units, the most similar first; logistic regression makes its margin a probability.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import claim, give_back, with_value

ORDER, DECAY = 3, np.float32(0.7)
DECAY2 = DECAY * DECAY
#: Units are compared by windows of so many characters, half overlapping, so that all of a long one counts.
WINDOW = 16
#: Bound of the training sample: labelled texts of each class, picked by a hash of their ids, and their sentences.
SAMPLE, SENTENCES = 2000, 60_000
#: Longer sentences come to the driver in several pieces, each of which counts as a sentence.
PIECE = 4000
#: Words whose similarities are held at once.
STEP = 8192
#: Landmarks among the witnesses and among clean units.
#: SHARP: the kernel's fall with dissimilarity.
LANDMARKS, NEGATIVE, SHARP = 48, 16, 4.0
#: A witness is in so many different toxic texts, and its share is so many standard deviations above a half.
WITNESS_TEXTS, SURE = 5, 3.0

#: Characters that training puts into witnesses.
FOREIGN = "x1"

SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
#: Marks between letters: the word counts without them too.
GAP = re.compile(r"[^\W_][\W_]+[^\W_]")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def units(text: str) -> set[str]:
    """Distinct units of a text, lower-cased."""
    text = text.lower()
    words = set(text.split())
    if SPACED.search(text):
        words |= {re.sub(r"\s", "", m[0]) for m in SPACED.finditer(text)}
    return words


def windows(unit: str) -> list[str]:
    """What of a unit is compared: it without marks at its ends, and without any where they stand between letters, cut to windows."""
    unit = EDGE.sub("", unit)
    forms = [unit, re.sub(r"[\W_]+", "", unit)] if GAP.search(unit) else [unit]
    out = []
    for form in forms:
        if len(form) > WINDOW:
            out += [form[i : i + WINDOW] for i in range(0, len(form) - WINDOW // 2, WINDOW // 2)]
        elif len(form) >= ORDER:
            out.append(form)
    return out


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.int32)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and character codes, one row for each character, of the words of each length, some thousand at a time."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            yield some, np.ascontiguousarray(codes("".join([words[k] for k in some])).reshape(len(some), n).T)


def kernel(a: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of words (characters, words) with one word, or one for each, by Lodhi's recursion over the characters of both."""
    m, n, size = len(a), a.shape[1], len(word)
    equal = [[(a[i] == word[j]) for j in range(size)] for i in range(m)]
    below = None  # K' of the order before; K'_0 is 1 throughout
    for _ in range(1, ORDER):
        here = [[None] * (size + 1) for _ in range(m + 1)]
        for i in range(m):
            run = None
            for j in range(size):
                add = equal[i][j] * DECAY2 if below is None else below[i][j] if below[i][j] is None else equal[i][j] * below[i][j] * DECAY2
                run = run * DECAY if run is not None and add is None else add if run is None else run * DECAY + add
                up = here[i][j + 1]
                here[i + 1][j + 1] = run if up is None else up * DECAY if run is None else up * DECAY + run
        below = here
    out = np.zeros(n, np.float32)
    for i in range(m):
        for j in range(size):
            if below[i][j] is not None:
                out += equal[i][j] * below[i][j]
    return out * DECAY2


def own_kernel(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself."""
    out = np.empty(len(words))
    for at, a in by_length(words):
        out[at] = kernel(a, a)
    return out


#: Letters that a table of landmarks tells apart at most, and landmarks in it.
LETTERS, TABLE = 128, 64


@lru_cache(maxsize=4)
def tables(landmarks: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some landmarks at a time, in order: their letters, the row of each ORDER letters, and rows of their weights in each landmark."""
    letters = sorted(set("".join(landmarks)))
    if len(landmarks) > 1 and (len(landmarks) > TABLE or len(letters) > LETTERS):
        half = len(landmarks) // 2
        return [t for part in (landmarks[:half], landmarks[half:]) for t in tables.__wrapped__(part)]
    number, base = {c: i + 1 for i, c in enumerate(letters)}, len(letters) + 1
    weights: dict[int, np.ndarray] = {}
    for k, mark in enumerate(landmarks):
        for at in combinations(range(len(mark)), ORDER):
            code = 0
            for i in at:
                code = code * base + number[mark[i]]
            weights.setdefault(code, np.zeros(len(landmarks), np.float32))[k] += DECAY ** (at[-1] - at[0] + 1)
    row = np.full(base**ORDER, -1, np.int32)
    row[list(weights)] = np.arange(len(weights))
    return [(codes("".join(letters)), row, np.array(list(weights.values()), np.float32).reshape(len(weights), len(landmarks)))]


def kernels(a: np.ndarray, landmarks: tuple[str, ...]) -> np.ndarray:
    """The kernel of words (characters, words) with each landmark, by looking their subsequences up: no other ones count."""
    out = []
    for letters, row, weights in tables(landmarks):
        place = np.minimum(np.searchsorted(letters, a), len(letters) - 1)
        number, base = np.where(letters[place] == a, place + 1, 0), len(letters) + 1
        sums = np.zeros((a.shape[1], weights.shape[1]), np.float32)
        for at in combinations(range(len(a)), ORDER):
            code = number[at[0]]
            for i in at[1:]:
                code = code * base + number[i]
            found = row[code]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                sums[hit] += weights[found[hit]] * DECAY ** (at[-1] - at[0] + 1)
        out.append(sums)
    return np.hstack(out)


@dataclass
class Model:
    landmarks: list[str]
    norms: list[float]
    weights: list[float]
    bias: float
    slope: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def similarities(self, words: list[str]) -> np.ndarray:
        """Similarity of words with the landmarks: a radial function of their distance in the kernel's space."""
        out, own = np.empty((len(words), len(self.landmarks))), np.array(self.norms)
        marks = tuple(self.landmarks)
        for at, a in by_length(words):
            self_kernel = kernel(a, a).astype(np.float64)
            out[at] = kernels(a, marks) / np.sqrt(np.maximum(self_kernel[:, None] * own, 1e-30))
        np.minimum(out, 1, out=out)
        out -= 1
        out *= SHARP
        return np.exp(out, out=out)

    def nearest(self, words: list[str]) -> np.ndarray:
        """Each word's similarity with the landmark most like it."""
        return np.concatenate([self.similarities(words[i : i + STEP]).max(axis=1) for i in range(0, max(1, len(words)), STEP)])

    def margins(self, words: list[str]) -> np.ndarray:
        weights = np.array(self.weights)
        return np.concatenate([self.similarities(words[i : i + STEP]) @ weights for i in range(0, len(words), STEP)]) + self.bias

    def worth(self, units: list[str]) -> list[float]:
        """The largest margin of each unit's windows; minus infinity without any."""
        parts = [windows(u) for u in units]
        flat = sorted({w for p in parts for w in p})
        margin = dict(zip(flat, self.margins(flat).tolist(), strict=True)) if flat else {}
        return [max((margin[w] for w in p), default=-math.inf) for p in parts]

    def best(self, texts: list[str], most: int = 600_000) -> list[float]:
        """The largest margin of each text's units; minus infinity without any."""
        cut = [units(t) for t in texts]
        if len(self.known) > most:
            self.known.clear()
        new = sorted(set().union(*cut) - self.known.keys())
        values = dict(zip(new, self.worth(new), strict=True))
        large = {u: v for u, v in values.items() if len(u) > 64}
        self.known |= {u: v for u, v in values.items() if len(u) <= 64}
        if large:
            return [max((self.known[u] if u in self.known else large[u] for u in c), default=-math.inf) for c in cut]
        get = self.known.__getitem__
        return [max(map(get, c), default=-math.inf) for c in cut]

    def scores(self, texts: list[str], most: int = 600_000) -> list[float]:
        return [1 / (1 + math.exp(min(700, -self.slope * max(m, -10)))) for m in self.best(texts, most)]

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k != "known"})


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost times squared hinge, by Newton steps that are halved until they help."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float((ridge * w * w).sum() / 2 + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge * w - 2 * x[on].T @ (cost[on] * y[on] * gap[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * (x[on] * cost[on, None]).T @ x[on], grad)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now - 1e-4 * size * float(grad @ step):
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * max(1, now):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def train(rows: Iterable[tuple[int, str, int]], totals: dict[int, int]) -> Model | None:
    """A model from (text's id, sentence, label of its text), and how many texts of each label there are in all.

    None without two classes or without any unit that marks one. Texts are held as numbers of their words, each word
    once: the driver's memory has to do for Spark too.
    """
    number: dict[str, int] = {}
    sets: dict[tuple[int, int], array] = {}
    marks: dict[tuple[int, int], int] = {}
    for doc, sentence, label in rows:
        key, plain = (doc, label), sentence.lower().split()
        sets.setdefault(key, array("i")).extend({number.setdefault(w, len(number)) for u in units(sentence) for w in windows(u)})
        # copies and near copies share the least hash of their runs of three words, and count as one text
        runs = [xxhash.xxh3_64_intdigest(" ".join(plain[i : i + 3])) for i in range(max(1, len(plain) - 2))]
        marks[key] = min(marks.get(key, 1 << 64), *runs)
    sample = Counter(label for _, label in sets)
    if not sample[0] or not sample[1]:
        return None
    docs = {key: np.unique(np.array(sets.pop(key), np.int32)) for key in list(sets)}
    words, copies = list(number), defaultdict(list)
    seen = {label: np.zeros(len(words), np.int64) for label in (0, 1)}
    for key, own in docs.items():
        copies[key[1], marks[key]].append(own)
    for (label, _), alike in copies.items():
        seen[label][np.unique(np.concatenate(alike))] += 1
    scale = {label: totals[label] / sample[label] for label in (0, 1)}

    def share(w: str) -> float:
        """Lower bound of the share of toxic texts among all that have the unit, SURE standard deviations down."""
        toxic, other = (int(seen[label][number[w]]) for label in (1, 0))
        a, b = scale[1] * toxic, scale[0] * (other + 0.5)
        return a / (a + b) - SURE * math.sqrt(a * b / (a + b) ** 2 / (toxic + other + 1))

    often = [words[i] for i in np.flatnonzero(seen[1] >= WITNESS_TEXTS).tolist()]
    marked = sorted((w for w in often if share(w) > 0.5), key=lambda w: (-seen[1][number[w]], w))[: 20 * LANDMARKS]
    if not marked:
        return None
    like = Model(marked, own_kernel(marked).tolist(), [], 0.0, 1.0).similarities(marked)
    tables.cache_clear()
    count, near, picked = np.array([seen[1][number[w]] for w in marked], float), np.zeros(len(marked)), []
    while len(picked) < min(LANDMARKS, len(marked)):  # frequent ones that no landmark is like yet
        picked.append(int(np.argmax(count * (1 - near))))
        near = np.maximum(near, like[:, picked[-1]])
    landmarks = [marked[i] for i in picked]
    model = Model(landmarks, own_kernel(landmarks).tolist(), [], 0.0, 1.0)
    in_clean = {words[i] for i in np.flatnonzero(seen[0]).tolist()}
    clean = sorted(in_clean - set(marked))
    order = np.argsort(-model.nearest(clean), kind="stable")
    model.landmarks = landmarks + [clean[i] for i in order[:NEGATIVE]]
    model.norms = own_kernel(model.landmarks).tolist()
    # Nystroem: features K(x, landmarks) K(landmarks, landmarks)^(-1/2)
    between = model.similarities(model.landmarks)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    # the marked units of toxic sentences against the nearest clean ones and an even choice of the others
    # and, as these may be disguised, each sure witness with one foreign character put in, unless a clean unit has that form
    disguised = sorted({w[:i] + x + w[i:] for w in marked if share(w) > 0.9 for i in range(2, len(w) - 1) for x in FOREIGN} - in_clean)
    taught = marked + disguised + [clean[i] for i in order[:2000]] + [clean[i] for i in order[2000 :: max(1, len(order) // 2000)]]
    toxic = len(marked) + len(disguised)
    y = np.array([1.0] * toxic + [-1.0] * (len(taught) - toxic))
    w, model.bias = linear_svm(model.similarities(taught) @ half, y, np.full(len(y), 20.0))
    model.weights = (half @ w).tolist()
    worth = np.array(model.worth(words))
    margin = np.array([worth[own].max(initial=-math.inf) for own in docs.values()])
    label = np.array([z for _, z in docs])
    model.bias -= border(margin, label, scale)
    model.slope = logistic(margin - border(margin, label, scale), label.astype(float))
    return model


class Sentences:
    """(id, sentence, label) of each row of an Arrow table, some thousand rows at a time: all as Python's objects take far more room."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table

    def __iter__(self) -> Iterator[tuple[int, str, int]]:
        for batch in self.table.to_batches(max_chunksize=4096):
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sentence", "toxic")), strict=True)


def border(margin: np.ndarray, label: np.ndarray, scale: dict[int, float]) -> float:
    """The margin at which calling texts toxic errs least over all labelled texts: midway to the next lower margin."""
    order = np.argsort(-margin, kind="stable")
    m, toxic = margin[order], label[order] == 1
    gain = np.cumsum(np.where(toxic, scale[1], -scale[0]))
    gain[:-1][m[:-1] == m[1:]] = -np.inf  # equal margins are on one side
    best = int(np.argmax(gain))
    low = m[best + 1] if best + 1 < len(m) else m[best] - 1
    return float(m[best] + max(low, m[best] - 1)) / 2


def logistic(margin: np.ndarray, label: np.ndarray) -> float:
    """Slope of the probability of a toxic text by its margin; it is half at margin 0, the machine's own border."""
    m, slope = np.clip(margin, -2, 2), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-slope * m))
        step = (((p - label) * m).sum() + 1e-3 * slope) / ((p * (1 - p) * m * m).sum() + 1e-3)
        slope -= step
        if abs(step) < 1e-8:
            break
    return min(max(float(slope), 1.0), 20.0)


def training_sentences(docs: DataFrame, labels: DataFrame, *, hold_out: int | None = 5) -> tuple[Sentences, dict[int, int]]:
    """(id, sentence, label) of a bounded sample of labelled texts, SAMPLE of each class at most, and the classes' sizes.

    Labels are sampled first, by a hash of the id, so only a few ids are joined with the texts; texts are cut to
    sentences, long ones at white space to pieces, and those of one text after another, up to SENTENCES of each class, come to the driver: whole texts, so
    that a common sentence isn't taken from one class only. With hold_out,
    ids whose crc32 modulo it is 0 are never seen.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if hold_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_out != 0)
    totals = {r.toxic: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    cut = texts.select("doc_id", "toxic", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("at", "sentence")).where("trim(sentence) <> ''")
    # long sentences come in pieces of PIECE characters at most, longer words whole
    cut = cut.select("doc_id", "toxic", "at", F.posexplode(F.regexp_extract_all("sentence", F.lit(rf"(?s)\S(?:.{{0,{PIECE - 2}}}\S)?(?!\S)|\S+"), F.lit(0))).alias("part", "sentence"))
    picked = [cut.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "at", "part").limit(SENTENCES) for c in (0, 1)]
    return Sentences(picked[0].unionByName(picked[1]).select("doc_id", "sentence", "toxic").toArrow()), totals


@lru_cache(maxsize=1)
def _loaded(data: str) -> Model:
    """One for each Python worker."""
    return Model(**json.loads(data))


def loaded(data: str) -> Model:
    claim("toxicity", _loaded.cache_clear)
    return _loaded(data)


def toxic_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 600_000) -> DataFrame:
    """(row, score, predicted): each row as a struct, scored by its whole text with a model that is trained here on labels.

    The score only depends on the text. Null and empty texts score as texts without any unit, and all texts score 0
    if the labels teach nothing. Rows are kept one by one and don't move. A worker remembers `most` distinct units.
    """
    model = train(*training_sentences(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels))
    data = model.to_json() if model else None
    tables.cache_clear()
    give_back()  # what training took on the driver

    def work_out(texts: list[str | None]) -> list[float]:
        return loaded(data).scores([t or "" for t in texts], most) if data else [0.0] * len(texts)

    return with_value(docs, text_col, work_out, pa.float64(), "double").select("row", F.col("value").alias("score"), (F.col("value") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    return toxic_rows(docs.select("doc_id", "text"), labels).select(F.col("row.doc_id").cast("long").alias("doc_id"), "score", "predicted")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a row is never learnt from; null ids are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
