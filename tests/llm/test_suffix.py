"""Suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import suffix


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(r), int(gone.sum()), spans, suffix.digest(np.frombuffer(r, dtype=np.uint8)[~gone].tobytes())))
    return out


def corpus(rng, length):
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(length // 3) for _ in range(4)]
    texts = [None, "", "x", "a" * (3 * length), "ab" * length, "y" * (length - 1), "z" * length]
    for _ in range(40):
        parts = [prose(rng.randrange(1, 40))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 3)
            parts += [s[a : len(s) - rng.randrange(len(s) // 3)], prose(rng.randrange(0, 20))]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11], texts[12] + " tail", prose(300)]
    return texts


@pytest.mark.parametrize(("length", "gram", "block", "seed"), [(60, 16, 1024, 1), (40, 8, 2, 2), (100, 48, 5, 3)])
def test_equals_brute_force(spark, length, gram, block, seed):
    texts = corpus(random.Random(seed), length)
    docs = spark.createDataFrame([(i, t, "u", 3) for i, t in enumerate(texts)], "doc_id long, text string, anchor string, hits int")
    want = plain(texts, length)
    got = suffix.report(docs.repartition(3), length=length, gram=gram, block=block, piece=(1_000_000, 150, 120)[seed - 1]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id] and r.has_repeats == (r.n_removed > 0), (r.doc_id, texts[r.doc_id])


def test_defined_cases(spark):
    schema = "doc_id long, text string"
    assert suffix.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "q" * 10 + "abcdefghij" * 50), (1, "q" * 10 + "abcdefghij" * 50), (None, "short"), (None, None)]
    got = sorted(map(tuple, suffix.report(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert [r[:4] for r in got] == [(1, 510, 510, 1), (1, 510, 510, 1), (None, 0, 0, 0), (None, 5, 0, 0)]


def test_suffix_sort_equals_sorted():
    rng = np.random.default_rng(3)
    for _ in range(20):
        data = rng.integers(97, 99, 300, dtype=np.uint8)
        starts, group = rng.permutation(270)[:150], rng.integers(0, 4, 150)
        order, equal = suffix.suffix_sort(data, starts, group, 30)
        key = [(group[i], data[starts[i] : starts[i] + 30].tobytes()) for i in order]
        assert key == sorted(key)
        assert equal.tolist() == [i > 0 and key[i] == key[i - 1] for i in range(len(key))]


def test_collisions_are_caught(monkeypatch):
    monkeypatch.setattr(suffix.Hashed, "of", lambda self, start, size: np.zeros(np.shape(start), dtype=np.uint64))
    data = np.frombuffer(b"abcabd", dtype=np.uint8)
    assert suffix.repeated(data, np.array([0, 3, 1]), np.zeros(3, dtype=np.int64), 2).tolist() == [True, True, False]
    assert suffix.repeated(data, np.array([0, 1]), np.zeros(2, dtype=np.int64), 2).tolist() == [False, False]


def test_every_string_holds_an_anchor_at_the_same_place():
    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(500)).encode() + b"a" * 120, dtype=np.uint8)
    at = suffix.anchors(data, suffix.Hashed(data), 50, 8)
    bits = np.uint64(len(data).bit_length())
    grams = suffix.mix(suffix.Hashed(data).of(np.arange(len(data) - 7), 8)) >> bits
    want = {i + int(np.argmin(grams[i : i + 43])) for i in range(len(data) - 49)}
    assert set(at.tolist()) == want


def test_the_sort_decides(monkeypatch):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 300, dtype=np.uint8)] * 2)
    starts, group = np.arange(len(data) - 40, dtype=np.int32), np.zeros(len(data) - 40, dtype=np.int32)
    strings = [data[s : s + 40].tobytes() for s in starts]
    want = np.array([strings.count(x) > 1 for x in strings])
    assert want.any() and (suffix.repeated(data, starts, group, 40) == want).all()
    real = suffix.suffix_sort

    def unsorted(*args):
        order, equal = real(*args)
        wrong = np.concatenate([order[::2], order[1::2]])  # equal strings are no longer side by side
        return wrong, np.concatenate([[False], [strings[pairs[wrong[i]]] == strings[pairs[wrong[i - 1]]] for i in range(1, len(wrong))]])

    pairs = None

    def spy(data, at, group, length, hashed=None):
        nonlocal pairs
        pairs = at
        return unsorted(data, at, group, length, hashed)

    monkeypatch.setattr(suffix, "suffix_sort", spy)
    assert not (suffix.repeated(data, starts, group, 40) == want).all()
