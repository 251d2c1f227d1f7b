"""Passages of many words that stand in several documents, against brute force."""

import random
from collections import defaultdict

import pytest

from codeloom.llm import suffix
from codeloom.llm.common import alnum_words, row_key


def plain(texts, words):
    """Word flags of each text: within a window that another row of the table holds too."""
    rows = [alnum_words(t) for t in texts]
    where = defaultdict(set)
    for d, ws in enumerate(rows):
        for i in range(len(ws) - words + 1):
            where[tuple(ws[i : i + words])].add(d)
    out = []
    for ws in rows:
        hit = [False] * len(ws)
        for i in range(len(ws) - words + 1):
            if len(where[tuple(ws[i : i + words])]) > 1:
                hit[i : i + words] = [True] * words
        out.append([w for w, h in zip(ws, hit, strict=True) if h])
    return out


@pytest.mark.parametrize(("words", "gram", "piece", "seed"), [(6, 2, 1_000_000, 1), (9, 3, 60, 2), (20, 8, 400, 3), (5, 5, 90, 4)])
def test_equals_brute_force(spark, words, gram, piece, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉé7") for _ in range(rng.randrange(1, 4)))
    mark = lambda: rng.choice((" ", ", ", "\n", " - ", "."))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(3 * words) for _ in range(4)]
    texts = [None, "", "x", "a " * (4 * words), "! " * 200, "a " * words, "b " * 200 + "c"]
    for _ in range(40):
        parts = prose(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            s, a = rng.choice(shared), rng.randrange(2 * words)
            parts += [w.upper() if rng.random() < 0.2 else w for w in s[a : len(s) - rng.randrange(words)]] + prose(rng.randrange(9))
        texts.append("".join(w + mark() for w in parts))
    texts += [texts[10], texts[10], texts[11], texts[11] + " tail", " ".join(prose(4)) + " " + texts[10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in docs.select("*", *row_key()).join(suffix.passages(docs.repartition(3), words=words, gram=gram, block=3 * seed, piece=piece), ["k1", "k2"]).collect():
        assert not got[r.doc_id] and r.passages and all(a.stop < b.start for a, b in zip(r.passages, r.passages[1:], strict=False))
        for p in r.passages:
            got[r.doc_id] += alnum_words(r.text)[p.start : p.stop]
    want = plain(texts, words)
    assert sum(map(bool, want)) > 20
    assert [got[i] for i in range(len(texts))] == want


def test_passages_below_400_bytes_are_reported(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, short = prose(51), prose(50)
    texts = [f"{prose(30)} {shared} {prose(30)}", f"{prose(9)}\n{shared.upper()}. {prose(200)}", f"{prose(20)} {short} {prose(9)}", f"{short} {prose(80)}", prose(300)]
    assert len(shared) < 400
    got = {r.doc_id: r for r in suffix.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_passages for i in range(5)] == [1, 1, 0, 0, 0]
    assert [got[i].passage_bytes for i in range(5)] == [len(shared), len(shared), 0, 0, 0]
    assert all(r.n_removed == 0 and r.kept_sha256 == suffix.digest(texts[i].encode()) for i, r in got.items())


def test_equal_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert suffix.passages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "w " * 60), (1, "w " * 60), (2, "v " * 60), (None, None)]
    got = sorted((r.doc_id or 0, r.n_passages, r.passage_bytes) for r in suffix.report(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0), (1, 1, 119), (1, 1, 119), (2, 0, 0)]
