"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean expression over the text that says "reject". The cascade estimates each rule's cost (seconds a row)
and selectivity (share of rows that it rejects) on a bounded sample, orders the rules by rejection per cost, and
evaluates them as one nested CASE: a text that one rule rejects is not read by the later, dearer ones. A document is kept
if no rule rejects it, so the order changes the time and never the verdict. The sample is spread over the whole table. A
rule's cost is its time over the sample, repeated within one job until the rule outweighs what such a job takes without it.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words (and are rejected as too short). Repeated rows are
judged one by one. Three-word windows are compared within their document by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import id_text

_SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows of the sample on which the cascade estimates cost and selectivity; they decide the order of evaluation only.
SAMPLE_ROWS = 256
#: A rule is timed on at most so many characters; the job without it takes less than a third of the job with it, or so much text.
TIMED_CHARS = 2_000_000
ROW_CHARS = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    spaced = F.trim(F.translate(text, _SPACES, " " * len(_SPACES)))
    some = F.when(F.contains(spaced, F.lit("  ")), F.split(spaced, " +")).otherwise(F.split(spaced, " "))  # the plain split is the faster one
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(some)


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _SPACES, "")).cast("long")


def n_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(_SPACES)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(listed: Column) -> Column:
    """Of listed words, how many stand in a three-word window found twice or more."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(3), s - acc["at"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def repeats(hashes: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))
        same = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(placed, lambda s: covered(F.sort_array(F.transform(same(s), lambda x: x["i"]))))

    def of(w: Column) -> Column:
        n = F.size(w) - 2
        three = F.arrays_zip(*[F.slice(w, F.lit(k + 1), n).alias(c) for k, c in enumerate("abc")])
        hashes = F.transform(three, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeats(h)))
        return F.when(F.size(w) < 4, 0).otherwise(some)

    return let(listed, of).cast("long")


@dataclass(frozen=True)
class Rule:
    """reject: from the measured features (as columns by name) to a Boolean that is true for a text to reject."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


#: Features of a text and of the list of its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: word_chars(t),
    "n_symbols": lambda t, w: n_of(t, SYMBOLS),
    "n_exclaims": lambda t, w: n_of(t, "!"),
    "n_lines": lambda t, w: let(lines_with_words(t), lambda x: F.size(x).cast("long")),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}
BASE_RULES = [
    Rule("too_few_words", lambda f: f("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("exclaims", lambda f: f("n_exclaims") > f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > 20 * f("n_words")),
    Rule("short_words", lambda f: f("word_chars") < 2 * f("n_words")),
    Rule("repeated_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
]


def over(text: Column, listed: Column) -> Callable[[str], Column]:
    return lambda name: FEATURES[name](text, listed)


def spread(docs: DataFrame, rows: int) -> list[str | None]:
    """About so many texts (never more than twice) from all over the table."""
    n = docs.count()
    some = id_text(docs).select("text").sample(min(1.0, rows / max(1, n)), seed=11)
    return [r.text for r in some.limit(2 * rows).collect()]


def seconds_a_row(docs: DataFrame, rejects: list[Callable[[Column, Column], Column]]) -> list[float]:
    """What each rule takes for a row of docs (a bounded sample): from text and listed words to its verdict.

    A job over the sample, repeated, is timed with and without the rule; both split the words. The repetitions double
    until the job with the rule takes three times as long, or TIMED_CHARS are read, where a row counts as ROW_CHARS at least.
    Without rows all rules cost the same.
    """
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.length("text"), F.lit(ROW_CHARS))), F.lit(0))).first()
    if not n:
        return [1e-9] * len(rejects)

    def timed(times: int, reject: Callable[[Column, Column], Column]) -> float:
        repeated = docs.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_"))
        plan = repeated.agg(F.count_if(let(words(text_of()), lambda w: reject(text_of(), w))))
        began = time.perf_counter()
        plan.first()
        return time.perf_counter() - began

    idle = lambda t, w: F.size(w) < 0
    without: dict[int, float] = {}
    out = []
    for reject in rejects:
        times = 1
        timed(times, reject)  # compiles
        while True:
            if times not in without:
                timed(times, idle)
                without[times] = timed(times, idle)
            took = timed(times, reject)
            if took > 3 * without[times] or 4 * times * chars > TIMED_CHARS:
                break
            times *= 4
        out.append(max((took - without[times]) / max(1, n * times), 1e-9))
    return out


def ordered(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, highest first, estimated on a sample of about sample_rows rows."""
    spark = docs.sparkSession
    sample = spark.createDataFrame([(t,) for t in spread(docs, sample_rows)], "text string").coalesce(1)

    def verdict(r: Rule) -> Callable[[Column, Column], Column]:
        return lambda t, w: r.reject(over(t, w))

    verdicts = [verdict(r) for r in rules]
    listed = sample.withColumn("listed", words(text_of()))
    shares = listed.agg(F.count("*").alias("n"), *[F.count_if(v(text_of(), F.col("listed"))).alias(f"r{k}") for k, v in enumerate(verdicts)]).first()
    costs = seconds_a_row(sample, verdicts)
    rate = [shares[f"r{k}"] / max(1, shares["n"]) / c for k, c in enumerate(costs)]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate[k], costs[k]))]


def rejected_by(rules: list[Rule], feature: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated for that row."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.coalesce(r.reject(feature), F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The result of op6 for every row of docs: the base counts, base_failed and kept."""
    rules = rules or ordered(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    feature = over(F.col("text"), F.col("listed"))
    listed = id_text(docs).select("doc_id", text_of().alias("text")).withColumn("listed", words(F.col("text")))
    counted = listed.select("doc_id", "text", "listed", *[feature(n).alias(n) for n in names])
    known = lambda n: F.col(n) if n in names else feature(n)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("doc_id", *names, base.alias("base_failed"), (~base & rejected_by(rules, known).isNull()).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects. The words of a text are split once."""
    rules = rules or ordered(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return rows.where(let(words(text_of()), lambda w: rejected_by(rules, over(text_of(), w)).isNull())).select("row.*")


JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') IF x <> ''] AS ws FROM d),
l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ \t\n\x0B\f\r]')] AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR n_exclaims > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
