"""Line dedup of long passages that stand on fewer lines than a run."""

import random

from codeloom.llm import linedup


def plain(rows, size, long_words):
    """{doc_id: text} without later copies of runs of ``size`` lines, and of shorter runs of more than ``long_words`` words."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        at = [p for p, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        gone = set()
        for i in range(len(at)):
            for n in range(1, size + 1):
                run = tuple(lines[p] for p in at[i : i + n])
                if len(run) == n and (n == size or sum(len(x.split()) for x in run) > long_words):
                    if run in seen:
                        gone |= set(at[i : i + n])
                    seen.add(run)
        out[d] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def new_texts(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.row.doc_id: r.text for r in linedup.dedup(docs, **options).collect()}


def test_long_line_and_pair_between_different_lines_go(spark):
    words = [f"w{k}" for k in range(60)]
    one, pair, short = " ".join(words[:51]), " ".join(words[:30]) + "\n" + " ".join(words[30:]), " ".join(words[:50])
    rows = [(1, f"a\n{one}\nb"), (2, f"c\n{one}\nd"), (3, f"e\n{pair}\nf"), (4, f"g\n{pair}\nh"), (5, f"i\n{short}\nj"), (6, f"k\n{short}\nl"), (7, one)]
    assert new_texts(spark, rows) == {1: rows[0][1], 2: "c\nd", 3: rows[2][1], 4: "g\nh", 5: rows[4][1], 6: rows[5][1], 7: ""}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    lines = ["a", "b c", "", "d  e\tf g h", "i j k l", " m n o p q r "]
    rows = [(d, "\n".join(rng.choice([*lines, f"u{rng.randrange(9)}", f"x y z{rng.randrange(5)}"]) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    for gram, window in ((2, 2), (2, 4)):
        assert new_texts(spark, rows, gram_lines=gram, window=window, long_words=4) == plain(rows, gram + window - 1, 4)
