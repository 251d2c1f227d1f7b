"""Entry paths with many calls between the same symbols, against brute force."""

import random

from codeloom.operators import graph


def plain(edges, changed, entries, max_depth):
    """The shortest paths step by step: the strongest, then the first by the order of the calls."""
    out = {}
    for c in changed:
        front, seen = {c: (3, (), ())}, {c}
        for depth in range(1, max_depth + 1):
            steps = {}
            for source, target, file, line, edge, seq in edges:
                if source and target in front and source not in seen:
                    strength, ord_, hops = front[target]
                    steps.setdefault(source, []).append((min(strength, edge), (*ord_, seq), ((source, target, file, line, edge), *hops)))
            front = {x: (max(s[0] for s in found), min(s[1] for s in found), min((s for s in found if s[0] == max(f[0] for f in found)), key=lambda s: s[1])[2]) for x, found in steps.items()}
            seen |= set(front)
            out.update({(c, x): (depth, f[0], f[2]) for x, f in front.items() if x in entries})
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    names = [f"s{i}" for i in range(30)]
    seqs = rng.sample(range(10**10, 10**10 + 5000), 260)
    edges = [(rng.choice([*names, None]), rng.choice(names[: 12 + i % 18]), f"f{i % 5}", i, rng.choice((1, 1, 2, 3)), seq) for i, seq in enumerate(seqs[:60])]
    edges += [(a, b, "g", i, rng.choice((1, 2, 3)), seq) for i, seq in enumerate(seqs[60:120]) for a, b, *_ in [rng.choice(edges[:60])]]
    changed, entries = names[:8], set(names[5:25])
    frame = spark.createDataFrame(edges, "source_id string, target_id string, call_file string, call_line int, strength int, seq long")
    ids = lambda x: spark.createDataFrame([(n,) for n in x], "id string")
    for depth in (1, 3, 4):
        want = plain(edges, changed, entries, depth)
        got = graph.entry_paths(frame, ids([*changed, changed[0]]), ids(entries), depth).collect()
        assert len(got) == len(want) and len(want) > 10
        assert {(r.changed_id, r.entry_id): (r.depth, r.strength, tuple(tuple(h) for h in r.hops)) for r in got} == want


def test_a_step_joins_pairs_and_not_calls(spark):
    many = [("a", "b", "f", i, 1, i) for i in range(500)] + [("b", "c", "f", i, 2, 1000 + i) for i in range(500)]
    frame = spark.createDataFrame(many, "source_id string, target_id string, call_file string, call_line int, strength int, seq long")
    one = lambda n: spark.createDataFrame([(n,)], "id string")
    rows, real = [], graph.kept
    try:
        graph.kept = lambda df: rows.append(real(df)) or rows[-1]
        got = graph.entry_paths(frame, one("c"), one("a")).collect()
    finally:
        graph.kept = real
    assert [(r.depth, r.strength, [h.line for h in r.hops]) for r in got] == [(2, 1, [0, 0])]
    assert rows[0].count() == 2
