"""Conversation repair against a search over all edits, and against plain dynamic programming on whole tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from codeloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, pos int"
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation's rows after damage, in order."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    arcs = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, run):  # run: inserts in a row, two at most are of use
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if run < 2:
            for (p, c), q in arcs.items():
                if p == state and c != "s":
                    cost, audit, said = best(i, q, run + 1)
                    ways.append((cost + 5, "I" + audit, (("user:" if c == "u" else "assistant:"), *said)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, said = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                for (p, c), q in arcs.items():
                    if p == state:
                        cost, audit, said = best(i + 1, q, 0)
                        if role[:1] == c:
                            ways.append((cost + more, "K" + audit, (f"{role}:{text}", *said)))
                        if c != "s":
                            ways.append((cost + 1 + more, "R" + audit, (("user:" if c == "u" else "assistant:") + text, *said)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, said = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damaged(rows):
        convs[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {c: plain(sorted(v, key=order)) for c, v in convs.items()}


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def made(rng, convs, most):
    rows = []
    for c in convs:
        for t in range(rng.randrange(most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["a.", "b!", "c", " ", "", None, "d?\n", "é ü.", "x." + str(t), "y" + str(t)])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 8)


def test_equals_plain_search(spark):
    rows = made(random.Random(1), [*range(150), None], 9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(repair.report(df)) == expected(rows)
    again = rows + rows[::3]
    df = spark.createDataFrame([(*r, "x", 1) for r in again], SCHEMA).repartition(3)
    assert got(repair.report(df)) == expected(again)


def test_long_conversations_cross_blocks_and_partitions(spark, small_blocks):
    rng = random.Random(2)
    rows = made(rng, range(20), 9)
    rows += [(100, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a", "b."]) + str(t)) for t in range(300)]
    rows += [(101, t // 3, "user", "same.") for t in range(200)]  # ties and duplicates
    rows += [(102, None, rng.choice(["user", "assistant"]), f"w{t}.") for t in range(90)]
    rows += [(103, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], f"v{t}.") for t in range(100)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(repair.report(df)) == expected(rows)


def test_edits_give_valid_conversations(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 0, "user", "u" * 200_000 + "."), (2, 1, "assistant", "ok.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = repair.edits(df, df).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.edit, r.role) for r in out] == [(1, "R", "user"), (1, "K", "assistant"), (1, None, None), (2, "K", "user"), (2, "K", "assistant"), (2, None, None)]
    assert [(r.cost, r.n_edits) for r in out if r.edit is None] == [(1, 2), (0, 2)]
    assert out[3].text == "u" * 200_000 + "."


def test_empty_and_string_ids(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("a", 0, "user", "x."), ("a", 1, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert got(repair.report(df)) == expected([("a", 0, "user", "x."), ("a", 1, "assistant", "y.")])


def test_few_states():
    """The distance of two states' costs is bounded, so the number of states doesn't follow the texts."""
    rng = random.Random(3)
    table = repair.Table()
    for _ in range(200):
        table.scan([0, repair.NEVER, repair.NEVER, repair.NEVER], bytes(rng.randrange(9) for _ in range(200)))
    assert len(table.costs) < 100
