"""License chains: shorter templates within longer ones, repeated notices, templates without their phrase, brute-force matches."""

import random

from codeloom.llm import license
from codeloom.llm.common import alnum_words


def scanner(templates=license.TEMPLATES, min_match=license.MIN_MATCH, max_gap=license.MAX_GAP):
    return license.Scanner(dict(templates), min_match, max_gap)


def found(text, least=license.MIN_SCORE):
    s = scanner()
    return [(s.names[k], a, b) for score, k, a, b in s.chains(alnum_words(text)) if score >= least]


def test_short_template_within_a_longer_one():
    for tail in ('(the "License")', "The end"):
        text = f"Licensed under the Apache License, Version 2.0 {tail}"
        assert ("apache", "short") in [n for n, _, _ in found(text)]


def test_every_copy_of_a_notice():
    notice = license.TEMPLATES["isc", "grant"]
    n = len(alnum_words(notice))
    spans = [(a, b) for name, a, b in found(f"{notice} one two three {notice}") if name == ("isc", "grant")]
    assert sorted(spans) == [(0, n), (n + 3, 2 * n + 3)]


def test_template_without_its_phrase_gives_a_label(spark):
    text = "x " + license.TEMPLATES["mit", "grant"].replace("publish, ", "") + " y"
    docs = spark.createDataFrame([(1, text), (2, "nothing to see"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.base_labels, r.labels) for r in license.report(docs).collect()}
    assert got == {1: (0, "", "mit"), 2: (0, "", ""), 3: (0, "", "")}


def test_matches_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        words = lambda n: [rng.choice("abc") for _ in range(n)]
        templates = {("t", str(k)): " ".join(words(rng.randrange(3, 14))) for k in range(3)}
        text = [w.encode() for w in words(25)]
        own = [t.encode().split() for t in templates.values()]
        want = set()
        for k, t in enumerate(own):
            for s in range(len(text)):
                for e in range(s + 2, len(text) + 1):  # the longest match of the template that ends at e, if it can't go on
                    ends = [p for p in range(len(t)) if t[p : p + e - s] == text[s:e]]
                    longer = s > 0 and any(t[p : p + e - s + 1] == text[s - 1 : e] for p in range(len(t)))
                    onward = e < len(text) and any(t[p : p + e - s + 1] == text[s : e + 1] for p in range(len(t)))
                    if not longer and not onward:
                        want |= {(k, s, p, e - s) for p in ends}
        assert set(scanner(templates, 2, 3).matches(text)) == want
