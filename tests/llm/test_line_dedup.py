"""Line dedup against brute force."""

import hashlib
import random

import pytest

from codeloom.llm import linedup


def plain(rows, size):
    docs = {}
    for d, t in rows:
        docs[(d is not None, d or 0, t or "")] = (t or "").split("\n")
    seen, out = set(), {}
    for key in sorted(docs):
        lines = docs[key]
        at = [p for p, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        gone = set()
        for i in range(len(at) - size + 1):
            run = tuple(lines[p] for p in at[i : i + size])
            if run in seen:
                gone |= set(at[i : i + size])
            seen.add(run)
        out[key] = (len(lines), len(gone), hashlib.sha256("\n".join(x for p, x in enumerate(lines) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (1, 3), (2, 4)])
def test_equals_brute_force(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    texts = [None, "", "\n\n", "one", "a\na\na\na\na\na\na", " \n x\n", "a\n\nb\n \nc\nd\ne"]
    texts += ["\n".join(rng.choice(["a", "b", "", "c c", "d"]) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    rows = list(enumerate(texts)) + [(3, "one"), (20, texts[20]), (None, "a\na\na\nz\na\nb")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, starts int, row string")
    want = plain(rows, gram + window - 1)
    got = linedup.dedup(docs, gram_lines=gram, window=window).select("row.doc_id", "row.text", "row.row", "n_lines", "n_removed", "text").collect()
    assert len(got) == len(rows)
    for doc_id, old, _, n, removed, new in got:
        assert want[(doc_id is not None, doc_id or 0, old or "")] == (n, removed, hashlib.sha256(new.encode()).hexdigest())
    assert linedup.report(docs.limit(0)).count() == 0
