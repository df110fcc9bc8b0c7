"""Tokens, packed ids, token counts, toxicity and decontamination against libraries and brute force."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vantor.llm import leaks, pfor, toxicity, unigram, units
from vantor.llm.bpe import TrieBpe, bpe_digests, bpe_round_trip
from vantor.llm.common import scratch

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  \n a  b\n\n", "plain words, and more.", "<|endoftext|>x<|endoftext|>", "é中文🙂 ½Ⅷ² x́", "a" * 5000, " ".join(["word"] * 3000), "\x1c \x85　", "it's I'll we've 123,456"]
LETTERS = st.text(st.sampled_from("aabetion .,'\n\t09é中🙂½\x1c_<|"), max_size=60)


@pytest.fixture(scope="module")
def bpe():
    return TrieBpe(BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture
def odd(spark):
    """Texts of all kinds, a repeated row, a null id, and columns that operators use names of."""
    rows = [(i, t, "x", i, "y") for i, t in enumerate(ODD)] + [(4, ODD[4], "x", 4, "y"), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, score long, keys string")


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=4))
def test_encodings_are_the_librarys(bpe, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in pfor.encoder(BPE).encode(texts)] == want
    assert [bpe.decode(x) for x in bpe.encode(texts)] == [library.decode(ids, skip_special_tokens=False) for ids in want]


SPACED = st.text(st.sampled_from("ab.,!' \n\t\r\x1c\x85\xa0\u1680\u2003\u2019\u3000éÃ×÷中0"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(SPACED, min_size=1, max_size=5))
def test_units(bpe, library, texts):
    """Units make up their texts, hold whole pre-tokens, and are the same alone."""
    distinct, codes, firsts = units.cut(texts)
    for i, text in enumerate(texts):
        found = [distinct[c] for c in codes[firsts[i] : firsts[i + 1]]]
        assert "".join(found) == text
        assert [w for u in found for w, _ in bpe.splitter.pre_tokenize_str(u)] == [w for w, _ in bpe.splitter.pre_tokenize_str(text)]
    assert bpe.pre_tokens(distinct) == [[w for w, _ in bpe.splitter.pre_tokenize_str(u)] for u in distinct]


def test_units_are_encoded_once(library):
    """A word counts as one unit whatever marks or lines stand behind it, and long units are forgotten."""
    encoder, seen = pfor.LibraryEncoder(BPE), []
    encoder.memory.work_out = lambda new: seen.extend(new) or encoder.encode_units(new)
    texts = ["a word, a word. a word!\na word", "é, é" + "x" * 100, " a word;"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sorted(seen) == sorted(["a", " word", ",", " a", ".", "!", "\na", "é", ";"] + 2 * [" é" + "x" * 100])
    encoder.memory.most = 3
    assert encoder.encode(texts) == encoder.encode(texts[:2]) + encoder.encode(texts[2:])


def test_mixed_units_are_split_together(bpe, library):
    """Units of each kind are split in calls of many, whatever order they come in; tokens of any bytes decode as the library has it."""
    new, calls = TrieBpe(BPE), []
    split = new.splitter.pre_tokenize_str
    new.splitter = SimpleNamespace(pre_tokenize_str=lambda text: calls.append(text) or split(text))
    mixed = [f"{lead}{word}{i % 7}" for i in range(70) for lead, word in ((" ", "wörd'"), ("\n", "line."), ("", "(x"))]
    assert new.pre_tokens(mixed) == [[w for w, _ in split(u)] for u in mixed]
    assert len(calls) == 3
    ids = [*range(0, 50257, 7), 50256, 128, 50256]
    assert bpe.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_frame(spark, odd, library):
    got = bpe_digests(odd, BPE).collect()
    for r, (key, text) in zip(got, odd.select("doc_id", "text").collect(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_round_trip(odd.limit(0), BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(0, 32))
def test_blocks(values, width):
    v = np.array(values, np.uint32)
    assert pfor.read_block(pfor.write_block(v)).tolist() == values
    low = v & np.uint32((1 << width) - 1)
    assert pfor.unpack(pfor.pack(low, width), len(low), width).tolist() == low.tolist()


def test_token_files(spark, odd, library):
    with scratch(spark) as space:
        got = pfor.token_file_digests(space, odd, BPE).collect()
        empty = pfor.token_file_digests(space, odd.limit(0), BPE).count()
    start = 0
    for r, (key, text) in zip(sorted(got, key=lambda r: r.start), odd.select("doc_id", "text").orderBy("doc_id", "text").collect(), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert empty == 0


def brute_count(model, word):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * model.BYTE_COST, best[end - 1][1] + size)]
        options += [(best[s][0] + model.costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in model.costs]
        best.append(min(options))
    return best[-1][1]


def test_token_counts(spark, odd):
    model = unigram.TrieUnigram(PIECES)
    for r, text in zip(unigram.token_counts(odd, PIECES).collect(), [r.text for r in odd.collect()], strict=True):
        words = (text or "").encode().split()
        if len(text or "") < 1000:
            assert (r.n_pretokens, r.n_tokens) == (len(words), sum(brute_count(model, "▁" + w.decode()) for w in words))
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("abcdeinrstöß") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    assert model.count_words(words) == {w: brute_count(model, w) for w in words}
    assert unigram.token_counts(odd.limit(0), PIECES).count() == 0


def test_string_kernel():
    d = float(toxicity.DECAY)

    def brute(a, b):
        places = lambda w: [(tuple(w[k] for k in i), i[-1] - i[0] + 1) for i in itertools.combinations(range(len(w)), toxicity.ORDER)]
        return sum(d ** (m + n) for s, m in places(a) for t, n in places(b) if s == t)

    for a, b in (("idiot", "idxiot"), ("trash", "trasch"), ("aaaa", "aaa"), ("abc", "xyz"), ("ab", "abc"), ("öäü", "öxäyü")):
        got = next(toxicity.by_length([a]))[1]
        assert toxicity.kernel(got, toxicity.codes(b))[0] == pytest.approx(brute(a, b), rel=1e-5)
        assert toxicity.own_kernel([a])[0] == pytest.approx(brute(a, a), rel=1e-5)


def test_toxicity_learns(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice(("ta", "no", "ri", "el", "mu", "so")) for _ in range(rng.randint(2, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(("blockhead", "nitwit", "dunce"))
        rows.append((i, " ".join(words) + ".", i))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "mu so n i t w i t ri", 0), (1001, "ta block-head no", 0), (1002, "riel blockxhead", 0), (1003, None, 0), (1004, "", 0), (None, "dunce", 0), (1005, "sori " * 20000 + "nitwit", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value long")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).withColumn("held_out", toxicity.held_out()).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if i is not None and got[i].held_out and i < 400) == held
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == got[1002].predicted == got[None].predicted == got[1005].predicted == 1
    assert got[1003].predicted == got[1004].predicted == 0 and not got[None].held_out
    assert {r.predicted for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0}
    assert toxicity.toxic_rows(docs.limit(0), known).count() == 0


def test_myers():
    rng = random.Random(3)
    for _ in range(400):
        p, t = [rng.choice("abcd") for _ in range(rng.randint(1, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert leaks.best_distance(leaks.masks_of(p), len(p), t) == min(row)


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(30)] + [(90, "two words"), (91, None), (92, ""), (93, items_long := " ".join(word() for _ in range(300)))]
    texts = [(i, " ".join(word() for _ in range(80))) for i in range(40)]
    for i in range(20):
        w = items[i][1].split()
        errors = rng.randint(0, leaks.budget(len(w)) + 1)
        for _ in range(errors):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [word()], [w[at], word()]))
        t = texts[i][1].split()
        texts[i] = (i, " ".join([*t[:40], *w, *t[40:]]).upper())
    texts += [(100, None), (101, ""), (None, items[3][1]), (102, items_long), (102, items_long), (103, "two words " * 50)]
    docs = spark.createDataFrame([(*t, [1]) for t in texts], "doc_id long, text string, leaks array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        found = {}
        words = leaks.words_of(text)
        for key, item in items:
            p = leaks.words_of(item)
            if len(p) >= leaks.PIECE and (d := leaks.best_distance(leaks.masks_of(p), len(p), words)) <= leaks.budget(len(p)):
                found[key] = d
        return found

    for blocks in (20_000, 7):
        leaks.BLOCK_ITEMS = blocks
        got = leaks.leaks(docs, bench).collect()
        assert [{x.item_id: x.distance for x in sorted(r.leaks)} for r in got] == [brute(t) for _, t in texts]
    leaks.BLOCK_ITEMS = 20_000
    report = {r.doc_id: r for r in leaks.leak_report(docs, bench).collect()}
    assert report[102].contaminated and report[102].item_ids == [93] and report[102].least_distance == 0 and not report[103].contaminated
    assert leaks.leak_report(docs.limit(0), bench).count() == 0 and not any(r.contaminated for r in leaks.leak_report(docs, bench.limit(0)).collect())


def test_leaks_of_a_sixth():
    """Each item size against brute force, with the budget written out here."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(n, [word() for _ in range(n)]) for n in range(1, 45)]
    held = leaks.Items([(n, " ".join(w)) for n, w in items], min_words=1)
    for n, item in items:
        for errors in (n // 6, n // 6 + 1):
            w = list(item)
            for k in range(errors):  # one in each piece but the last, if there are as few
                w[n * k // (n // 6 + 1)] = word()
            words = [word() for _ in range(30)] + w + [word() for _ in range(30)]
            want = [(m, d) for m, p in items if (d := leaks.best_distance(leaks.masks_of(p), m, words)) <= m // 6]
            assert held.found(" ".join(words)) == want
            assert ((n, errors) in want) == (errors == n // 6)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "some Two words here"), (2, "two other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(90, "two words"), (91, "")], "item_id long, text string")
    assert [r.item_ids for r in leaks.leak_report(docs, bench, min_words=1).collect()] == [[90], []]


def test_kernel_tables():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdeéö中") for _ in range(n))
    marks = tuple(word(rng.randint(3, 16)) for _ in range(150)) + ("".join(map(chr, range(1000, 1016))), "".join(map(chr, range(2000, 2016))))
    for n in (3, 7, 16):
        a = next(toxicity.by_length([word(n) for _ in range(20)]))[1]
        want = np.stack([toxicity.kernel(a, toxicity.codes(m)) for m in marks], axis=1)
        assert toxicity.kernels(a, marks) == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_many_insults():
    """More kinds of insults than 32, in texts that weren't learnt from."""
    rng = random.Random(7)
    insults = ["".join(chr(k) for k in rng.sample(range(0x61, 0x17F), 8)).lower() for _ in range(44)]
    plain = ["".join(rng.choice(("ta", "no", "ri", "el", "mu", "so")) for _ in range(rng.randint(2, 4))) for _ in range(200)]
    text = lambda *extra: " ".join([*(rng.choice(plain) for _ in range(20)), *extra])
    toxic = [text(w) for w in insults for _ in range(16)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(10_000 + i, text(), 0) for i in range(700)]
    model = toxicity.train(rows, {0: 700, 1: len(toxic)})
    assert sum(s >= 0.5 for s in model.scores([text(w) for w in insults])) >= 42
    assert not any(s >= 0.5 for s in model.scores([text() for _ in range(100)]))


def test_long_sentences_are_learnt_whole(spark):
    rows = [(1, "word " * 3000 + "nitwit\tend"), (2, "plain"), (3, "x" * 9000 + " é")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got, _ = toxicity.training_sentences(spark.createDataFrame(rows, "doc_id long, text string"), labels, hold_out=None)
    for key, text in rows:
        mine = [s for k, s, _ in got if k == key]
        assert sorted(" ".join(mine).split()) == sorted(text.split()) and all(len(s) <= 4000 or " " not in s for s in mine)


def test_training_holds_each_word_once():
    """Texts of the same words add little to the driver's memory, which it shares with Spark."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(9)) for _ in range(800)]
    rows = [(i, " ".join([*rng.sample(plain, 300), *["nitwit"] * (i % 2)]), i % 2) for i in range(500)]
    tracemalloc.start()
    try:
        model = toxicity.train(iter(rows), {0: 250, 1: 250})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.scores(["a nitwit"])[0] >= 0.5
    assert peak < 10e6, peak
