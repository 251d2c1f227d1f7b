"""The filter audit against running all orders one document at a time."""

import random
from itertools import permutations

import numpy as np

from codeloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, quality string, mask int"


def fails(text, smaller):
    ws = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    ws = [w for w in ws if w]
    out = [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), smaller]
    return {x for x, f in zip("ABCDE", out, strict=True) if f}


def plain(docs, labels):
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    good, bad = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    rows = [(i, s or "", fails(t or "", i is not None and min(ids[t or ""]) < i)) for i, t, s in docs]
    out = {}
    for part in {s for _, s, _ in rows}:
        mine = [r for r in rows if r[1] == part]
        total = dict.fromkeys("ABCDE", 0)
        some = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[2]]
                left = [r for r in left if x not in r[2]]
                n_fail = sum(x in r[2] for r in mine)
                total[x] += len(gone)
                some[order, k + 1] = (len(left), len(gone), n_fail - len(gone), sum(r[2] == {x} for r in mine), sum(r[0] in good for r in gone), sum(r[0] in bad for r in gone))
        for (order, step), v in some.items():
            out[part, order, step] = (*v, total[order[step - 1]])
    return out


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_plain(spark):
    rng = random.Random(7)
    pool = ["", None, "a b", "A" * 30, " ".join(f"w{k}" for k in range(60)), " ".join(["x", "y"] * 40), "x\ty\n" * 30 + "#", " ".join(f"W{k}" for k in range(50)), "é " * 49 + "é|", "word " * 90_000]
    pool += [" ".join(rng.choice(["Ab", "cd", "e#", "f", "G"]) + str(rng.randrange(40)) for _ in range(rng.choice([49, 50, 80]))) for _ in range(8)]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["s", "t", "", None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(40)]
    df = spark.createDataFrame([(*d, "z", "1", 3) for d in docs], SCHEMA)
    ls = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert got(filter_audit.report(df, ls)) == plain(docs, labels)
    assert got(filter_audit.report(df.unionAll(df), ls)) == plain(docs + docs, labels)
    assert got(filter_audit.report(df, ls.limit(0))) == plain(docs, [])
    assert filter_audit.report(df.limit(0), ls).count() == 0


def test_polynomial():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, (3, 32))
    coef = filter_audit.coefficients(counts)
    for s in range(32):
        hit = [m for m in range(32) if m & s]
        assert (filter_audit.corner(coef, s) == counts[:, hit].sum(axis=1)).all()
    shares = [filter_audit.shapley(coef, i, 120) for i in range(5)]
    assert (sum(shares) == 120 * counts[:, 1:].sum(axis=1)).all()
