"""Near copies and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from vantor.llm import minhash, substrings
from vantor.llm.common import components, scratch


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, width, percent):
    top = {d: d for d, _ in rows if d is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: find(d) for d in top}


def family(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(int(rng.random() ** 2 * edits)):
            w[rng.randrange(len(w))] = rng.choice(("the", "of", "x", "y"))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, width, percent):
    rng = random.Random(width)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    for n in (200, 40, 5):
        texts += family(rng, [word() for _ in range(120)], n, 30)
    texts += texts[:10] + ["One two", "one TWO", "a", "", None, " \n\t", "B\x0bC d", "b c D", "word " * 30000, "word " * 30001]
    rng.shuffle(texts)
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, texts[1]), (7, texts[1])]
    docs = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, text string, n_shingles int, component_id string")
    minhash.BLOCK, before = 16, minhash.BLOCK  # several blocks for the large family
    with scratch(spark) as space:
        got = minhash.near_duplicates(space, docs, width=width, percent=percent).collect()
        none = minhash.near_duplicates(space, docs.limit(0), width=width, percent=percent).count()
    minhash.BLOCK = before
    want = brute_components(rows, width, percent)
    assert none == 0 and len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    sizes = {}
    for d, t in rows:
        sizes.setdefault(d, set()).add(len(shingles(t, width)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got) and len(set(want.values())) < len(want)


def test_circulant_coordinates():
    """Two permutations make all coordinates: shifting the slots by one moves each value to the next coordinate."""
    m = minhash.CirculantMinHash(8)
    assert (m.runs[5][1:] == m.runs[6][:-1]).all() and sorted(m.sigma.tolist()) == list(range(minhash.SLOTS))
    rng = np.random.default_rng(1)
    big = minhash.CirculantMinHash(512)
    for share in (0.5, 0.85):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        same = int(2000 * share / (1 + share))
        b = np.concatenate((a[:same], rng.integers(0, 2**63, 1000 - same).astype(np.uint64)))
        true = same / (2000 - same)
        assert abs((big.signature(a) == big.signature(b)).mean() - true) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (200, 300), (5, 5)]
    with scratch(spark) as space:
        got = {(r.node, r.component) for r in components(space, spark.createDataFrame(edges, "a long, b long")).collect()}
        assert components(space, spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (200, 100), (300, 100)}


def brute_spans(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 200, 400)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 50))
            p = p[a : a + rng.randint(45, 300)]
            if rng.random() < 0.3 and len(p) > 60:
                p = [*p[:55], word(), *p[55:]]
            w[rng.randint(0, len(w)) : 0] = p
        rows.append((rng.randrange(10**6), " \n".join(w)))
    rows += [(3, rows[0][1]), (4, "  " + rows[0][1].replace(" \n", "\t")), (5, None), (6, ""), (None, rows[1][1]), (8, "x " * 3000), (9, "x " * 49), (10, "x " * 120), (11, "a b " * 2000), rows[5], rows[5], (12, " ".join(passages[5] * 20))]
    docs = spark.createDataFrame([(*r, 0, None) for r in rows], "doc_id long, text string, n_words int, digest string")
    with scratch(spark) as space:
        got = sorted((tuple(r) for r in substrings.repeated_span_digests(space, docs).collect()), key=repr)
        assert substrings.repeated_spans(space, docs.limit(0)).count() == 0
    assert got == brute_spans(rows, 50)


def test_every_window_has_a_node():
    rng = random.Random(1)
    for words in ([rng.choice("ab").encode() for _ in range(500)], [str(rng.random()).encode() for _ in range(500)], [b"x"] * 200):
        _, at = substrings.nodes_of(words)
        reach = 2 * substrings.K - substrings.S - 1
        assert all(((at >= i) & (at + substrings.K <= i + reach)).any() for i in range(len(words) - reach + 1))
