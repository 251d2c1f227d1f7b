"""What a Python worker holds: bounded while it sorts, little once its task has ended."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from codeloom.llm import bpe, suffix
from codeloom.llm.queries import RANKS


def sorter(spark, monkeypatch, **options):
    """The function that sorts op7's blocks, as it goes to the workers."""
    taken, kind = [], type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: taken.append(f) or real(self, f, *a, **k))
    monkeypatch.setattr(suffix, "stored", lambda df, *a: df)
    known = spark.createDataFrame([], "anchor long, context long, n long, contexts long, least long, k1 long, k2 long, first binary")
    suffix._edges(spark.createDataFrame([], "k1 long, k2 long, text string"), known, 400, 48, 2048, **options)
    return taken[-1]


def blocks(sizes):
    """Rows of contexts of 752 bytes that share passages around their anchor."""
    rng, rows = np.random.default_rng(5), []
    for anchor, size in enumerate(sizes):
        base = rng.integers(97, 123, 752, dtype=np.uint8)
        for context in range(size):
            data = rng.integers(97, 123, 752, dtype=np.uint8)
            a, b = rng.integers(0, 300), rng.integers(420, 752)
            data[a:b] = base[a:b]
            rows.append((anchor, context % -(-size // 2048), context, 1, size, 352, data.tobytes()))
    columns = zip(*sorted(rows), strict=True)
    return pa.record_batch([pa.array(c) for c in columns], names=["anchor", "block", "context", "n", "contexts", "left", "data"])


def strings_of(batches):
    settled, lone = {}, []
    for r in (r for b in batches for r in b.to_pylist()):
        if r["kind"] == 0:
            runs = np.frombuffer(r["packed"], dtype="<u2").reshape(-1, 2).tolist()
            settled.setdefault((r["anchor"], r["context"]), set()).update(x for a, b in runs for x in range(a, b + 1))
        else:
            lone += [(r["anchor"], r["part"], *x) for x in np.frombuffer(r["packed"], dtype=suffix._LONE).tolist()]
    return settled, sorted(lone)


def test_op7_sorts_a_block_in_bounded_parts(spark, monkeypatch):
    run, most, real = sorter(spark, monkeypatch), [], suffix.repeated
    monkeypatch.setattr(suffix, "repeated", lambda data, starts, *a: most.append(len(starts)) or real(data, starts, *a))
    settled, _ = strings_of(run(iter([blocks([2048])])))
    assert settled and sum(most) == 2048 * 353 and max(most) <= suffix.STRINGS


def test_op7_parts_give_what_whole_blocks_give(spark, monkeypatch):
    rows = blocks([2, 3, 40, 2200])
    whole = strings_of(sorter(spark, monkeypatch, strings=10**9)(iter([rows])))
    assert whole[0] and whole[1]
    assert strings_of(sorter(spark, monkeypatch, strings=20_000)(iter([rows.slice(0, 700), rows.slice(700)]))) == whole


def test_an_idle_worker_has_no_memo(spark):
    rank_file, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 500 + k}" for k in range(500))) for i in range(40)], "doc_id long, text string")
    assert bpe.encode(docs.repartition(8), rank_file, pattern).count() == 40
    probe = lambda batches: (pa.record_batch([pa.array([len(bpe.loaded(rank_file, pattern)._memo)])], names=["n"]) for b in batches if b.num_rows)
    held = [r.n for r in spark.range(0, 8, numPartitions=8).mapInArrow(probe, "n long").collect()]
    assert len(held) == 8 and max(held) == 0
