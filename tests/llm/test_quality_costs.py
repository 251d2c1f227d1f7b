"""The measured costs of the quality rules on tables without text."""

import pytest

from codeloom.llm import quality


@pytest.mark.parametrize("texts", [[], [None], ["", None, "x"]])
def test_costs_end_without_text(spark, monkeypatch, texts):
    made, real = [], quality.F.sequence
    monkeypatch.setattr(quality, "TIMED_CHARS", 40_000)

    def bounded(start, stop):
        made.append(start)
        assert len(made) < 200, "the repetitions don't end"
        return real(start, stop)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality.F, "sequence", bounded)
    costs = quality.seconds_a_row(docs, [lambda t, w: quality.F.size(w) < 5, lambda t, w: quality.F.length(t) > 3])
    monkeypatch.undo()
    assert len(costs) == 2 and all(c > 0 for c in costs)


def test_an_empty_table_is_kept_and_judged(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.keep(docs).count() == quality.judge(docs).count() == 0
    assert sorted(r.name for r in quality.ordered(docs)) == sorted(r.name for r in quality.RULES)
