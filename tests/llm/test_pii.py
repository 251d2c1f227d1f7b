"""Personal data: base spans against Python's re, held-out accuracy of the added ones."""

import hashlib
import random
import re

from codeloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x // 10 + x % 10 for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, f"{kind}:{m.start()}:{m.end()}"))
    return out


def test_base_spans_equal_plain(spark):
    rng = random.Random(6)
    texts = [None, "", "a@b.c@d.e", "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.2.3", "4485 2756-8237 1060", "4111111111111111 4111-1111-1111-1111", "+1 (743) 555-3824é+49 30 1234 56 78", "\U0001f600 \U0001f600 q@r.st +", "+1+2+33 44 55 66 7", "a" * 3000 + "@", "1 " * 2000, "a@b.c " * 600]
    texts += ["".join(rng.choice(["a", "@", ".", "1", "25", "6", " ", "-", "+", "(", ")", "é", "b_"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _ in want) for kind in pii.KINDS], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, s in want).encode()).hexdigest()
        assert {s for _, s in want} <= set(r.spans.split(",")) | {""}
    assert pii.report(docs.limit(0)).count() == 0


def test_added_spans_on_held_out_examples(spark):
    made = pii.examples(seed=99, n=600)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(made)], "doc_id long, text string")
    hit = {r.doc_id: bool(r.spans) for r in pii.report(docs).collect()}
    right = sum(hit[i] for i, (_, _, y) in enumerate(made) if y)
    wrong = sum(hit[i] for i, (_, _, y) in enumerate(made) if not y)
    assert right >= 0.85 * sum(y for _, _, y in made)
    assert wrong <= 0.05 * sum(1 - y for _, _, y in made)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.co or call me at (555) 123-4567 now"), (2, None), (3, "on 2021-03-04 the 3 of 5")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "Mail [EMAIL] or call me at [PHONE] now", 2: "", 3: "on 2021-03-04 the 3 of 5"}


def test_secrets_of_the_table(spark):
    """Labels by a rule of the test's own; no example of the training templates has this text around it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    wrong = missed = n = 0
    for r in pii.find(docs).select("doc_id", "text", "added_secret").collect():
        want = {(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
        got = {(s.start, s.stop) for s in r.added_secret}
        n, missed, wrong = n + len(want), missed + len(want - got), wrong + bool(got - want)
    assert n and missed <= 0.02 * n and wrong <= 2
