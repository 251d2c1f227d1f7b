"""Distributed graph forms: every round takes about as long, and the results equal those of one group."""

import random
import time

import numpy as np

from codeloom.checkpoints import kept
from codeloom.operators import graph


def links(spark, pairs):
    return spark.createDataFrame([("r", f"n{a:06d}", f"n{b:06d}") for a, b in pairs], "root string, src string, dst string")


def sets(df):
    return sorted((r.root, tuple(r.members)) for r in df.collect())


def test_cycles_equal_those_of_one_group(spark):
    rng = random.Random(1)
    g = links(spark, {(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    assert sets(graph.import_cycles(g, worker_links=5)) == sets(graph.cycles(g))
    assert graph.cycles_distributed(g.limit(0)).count() == 0


def test_ring_takes_few_rounds(spark, monkeypatch):
    n = 150
    order = random.Random(2).sample(range(n), n)
    written = []
    monkeypatch.setattr(graph, "kept", lambda df, *old: written.append(1) or kept(df, *old))
    ring = links(spark, zip(order, [*order[1:], order[0]], strict=True))
    assert [len(m) for _, m in sets(graph.cycles_distributed(ring))] == [n]
    assert len(written) < 50


def test_rounds_of_pagerank_take_even_time(spark, monkeypatch):
    took, sizes = [], []

    def timed(df, *old):
        begun = time.time()
        out = kept(df, *old)
        took.append(time.time() - begun)
        sizes.append(len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(graph, "kept", timed)
    g = links(spark, [(k, (k + 1) % 6) for k in range(6)])
    nodes = spark.createDataFrame([("r", f"n{k:06d}", 1.0 + k) for k in range(6)], "root string, path string, weight double")
    got = {r.path: r.rank for r in graph.ranked(nodes, g, worker_links=3, tolerance=0.0, rounds=12).collect()}
    want = {r.path: r.rank for r in graph.ranked(nodes, g, tolerance=0.0, rounds=12).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert max(sizes) < 7, "a table's size is its own, not a product of earlier estimates"
    assert np.median(took[-4:]) < 3 * np.median(took[4:8]) + 0.5
