"""Near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from codeloom.llm import minhash
from codeloom.llm.common import stored


def plain(texts, size):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(rng):
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    texts = [None, "", " \n", "One", "one", "two words", "Two  WORDS", "a a a a a"]
    for size, copies in ((60, 40), (30, 12), (200, 6), (9, 5)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                new[rng.randrange(size)] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(50)]
    for _ in range(15):  # neighbours are linked, the ends are not
        texts.append(" ".join(chain))
        at = rng.randrange(50)
        chain[at] = word()
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (5, 2)])
def test_groups_equal_brute_force(spark, size, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "BLOCK_QUERIES", 3)
    texts = corpus(random.Random(seed))
    docs = spark.createDataFrame([(i, t, b"x", 5) for i, t in enumerate(texts)], "doc_id long, text string, node binary, n_shingles int")
    want = plain(texts, size)
    for r in minhash.near_duplicates(docs.repartition(3), shingle_words=size).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], texts[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_defined_cases(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (1, ""), (None, "z"), (9, "q r"), (9, "s t")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, schema), shingle_words=2).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 0, 2, True), (1, 0, 1, True), (None, 1, None, True), (9, 1, 9, True), (9, 1, 9, True)], key=str)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 700):
        e = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        s = minhash.sketch(e)
        assert len(s) == 128 and (s == minhash.sketch(e[::-1].copy())).all()
    errors = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = minhash.sketch(pool[:800]), minhash.sketch(pool[100:])
        errors.append((a == b).mean() - 700 / len(pool))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_a_long_chain(spark, monkeypatch):
    n, written = 20_000, []
    monkeypatch.setattr(minhash, "stored", lambda df, *old: written.append(1) or stored(df, *old))
    at = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame([(f"{a:06d}", f"{b:06d}") for a, b in zip(at, at[1:], strict=False)] + [("x1", "x2")], "a string, b string")
    found = minhash.components(edges).groupBy("label").count().collect()
    assert sorted((r["label"], r["count"]) for r in found) == [("000000", n), ("x1", 2)]
    assert len(written) < 25
