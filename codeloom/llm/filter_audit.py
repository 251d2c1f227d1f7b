"""Filter interaction audit: what each filter removes, alone, in every order, and its Shapley share of all removals.

Method: multilinear-extension Shapley. A document's mask has a bit for each filter that it fails; the counts of masks say
all that orders can show. The documents that a random set of filters removes, where filter i is in it with probability
x_i, are a polynomial, sum over masks of n * (1 - product over the mask of (1 - x_i)): ``coefficients`` expands it into
one coefficient for each set of filters. At a corner (a set of filters applied) it's the number removed; what survives a
step of an order is the rest. The integral of its partial derivative along the diagonal is a sum of coefficients over
``Fraction(1, size of the set)``: a filter's mean removals over all orders; times the number of orders (120) it's the sum over
them, exactly.

Filters, on whole texts (null: empty; words: maximal ``[^\\x20\\x09-\\x0D]+``): A under 50 words; B distinct words under 65
of 100; C more than 5 of 100 code points ``[A-Z]``; D any of ``[#$%&*|]``; E equal to the text of any smaller doc_id.

Defined cases: an empty text fails A, not B to D, and E if a smaller id's text is empty or null too. A null doc_id doesn't
fail E, makes no other row fail it, and has no labels. Equal doc_ids aren't smaller than each other. Repeated rows count
each. A document has a label if any row of ``labels`` for its id says so. A null part is the empty string. An empty table
gives no rows. Other columns are ignored.

Scale: masks and the text's SHA-256 are made in the scan; rows of about 70 bytes are shuffled by id for the labels, equal
rows collapsed, and counted by text before they meet under it, so a group of copies has a row for each part at most.
What reaches the polynomials is at most 32 counts a part, in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.quality import let

LETTERS = "ABCDE"
MIN_WORDS = 50
#: Null ids are spread over so many keys when labels are looked up.
NULL_KEYS = 1024
#: Parts that are expanded into rows at once; each gives 600.
PARTS_AT_ONCE = 64


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    listed = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sizes = let(listed, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    of_words = let(sizes, lambda c: F.when(c["n"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * c["d"] < 65 * c["n"], 2).otherwise(0))
    rare = F.regexp_replace(text, r"[^A-Z#$%&*|]+", "")  # what C and D look for
    capitals = F.length(F.regexp_replace(rare, "[^A-Z]+", ""))
    of_rare = let(F.struct(capitals.alias("c"), F.length(rare).alias("n")), lambda x: F.when(100 * x["c"] > 5 * F.length(text), 4).otherwise(0) + F.when(x["n"] > x["c"], 8).otherwise(0))
    return of_words + of_rare


def mask_counts(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_KEYS))).otherwise(F.lit(0).cast("long"))
    rows = docs.select("doc_id", key.alias("salt"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    some = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where("doc_id is not null").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(some("quality"), some("toxic")).withColumn("salt", F.lit(0).cast("long"))
    joined = rows.join(known, ["doc_id", "salt"], "left").withColumns({"good": F.coalesce("quality", F.lit(False)), "bad": F.coalesce("toxic", F.lit(False))})
    kinds = ["digest", "part", "mask", "good", "bad"]
    ids = joined.groupBy("doc_id", "salt", *kinds).agg(F.count("*").alias("k"))
    # of the rows of one text, part and label: all, those without id, the least id and the rows that have it
    copies = ids.groupBy(*kinds).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("k")).otherwise(0)).alias("nulls"), F.min("doc_id").alias("low"), F.min_by("k", "doc_id").alias("at_low"))
    twice = copies.withColumn("least", F.min("low").over(Window.partitionBy("digest")))
    first = F.col("nulls") + F.when(F.col("least").isNull() | (F.col("low") == F.col("least")), F.coalesce("at_low", F.lit(0).cast("long"))).otherwise(0)
    split = twice.withColumn("first", first).select("part", "good", "bad", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("m"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("m.n")).otherwise(0)).alias("toxic" if c == "bad" else c)
    return split.where("m.n > 0").groupBy("part", F.col("m.mask").cast("int").alias("mask")).agg(F.sum("m.n").alias("n"), of("good"), of("bad"))


def coefficients(counts: np.ndarray) -> np.ndarray:
    """Of the removal polynomial: (..., 2^k) counts by mask to (..., 2^k) coefficients by set of variables."""
    sums = counts.astype(np.int64).copy()
    size = sums.shape[-1]
    bit = 1
    while bit < size:  # of every set, the documents that fail all of it
        has = np.arange(size) & bit == 0
        sums[..., has] += sums[..., ~has]
        bit *= 2
    sign = np.array([0 if s == 0 else 1 if s.bit_count() % 2 else -1 for s in range(size)], dtype=np.int64)
    return sums * sign


def corner(coef: np.ndarray, applied: int) -> np.ndarray:
    """The polynomial where the variables of a set are 1 and the others 0: the documents that the set removes."""
    inside = [s for s in range(coef.shape[-1]) if s & ~applied == 0]
    return coef[..., inside].sum(axis=-1)


def shapley(coef: np.ndarray, i: int, scale: int) -> np.ndarray:
    """scale times the integral over t of the partial derivative by x_i at (t, ..., t); scale is a multiple of every set's size."""
    total = np.zeros(coef.shape[:-1], dtype=np.int64)
    for s in range(coef.shape[-1]):
        if s >> i & 1:  # the derivative's term is coef * t^(size - 1)
            weight = scale * Fraction(1, s.bit_count())
            if weight.denominator != 1:
                raise ValueError("the scale doesn't make the integral whole")
            total += coef[..., s] * int(weight)
    return total


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters, and step. counts: as ``mask_counts`` gives them."""
    size, scale = 1 << len(letters), factorial(len(letters))
    pick = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(size)]).alias(c)
    parts = counts.groupBy("part").agg(pick("n"), pick("good"), pick("toxic"))
    orders = ["".join(p) for p in permutations(letters)]
    steps = [(o, k + 1, sum(1 << letters.index(x) for x in o[:k]), letters.index(o[k])) for o in orders for k in range(len(letters))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                n, good, toxic = (np.array(some.column(c).to_pylist(), dtype=np.int64).reshape(some.num_rows, size) for c in ("n", "good", "toxic"))
                coef, coef_good, coef_toxic = map(coefficients, (n, good, toxic))
                removed = {s: [corner(c, s) for c in (coef, coef_good, coef_toxic)] for s in range(size)}
                share = [shapley(coef, i, scale) for i in range(len(letters))]
                fails = [corner(coef, 1 << i) for i in range(len(letters))]
                alone = [n[:, 1 << i] for i in range(len(letters))]
                all_docs = n.sum(axis=1)
                cols: dict[str, list[np.ndarray]] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
                for _, _, before, i in steps:
                    after = before | 1 << i
                    here = [x - y for x, y in zip(removed[after], removed[before], strict=True)]
                    values = (all_docs - removed[after][0], here[0], fails[i] - here[0], alone[i], here[1], here[2], share[i])
                    for c, v in zip(cols, values, strict=True):
                        cols[c].append(v)
                k = some.num_rows
                names = some.column("part").to_pylist()
                first = [pa.array(names * len(steps), type=pa.string()), pa.array([o for o, *_ in steps for _ in range(k)], type=pa.string()), pa.array([s for _, s, *_ in steps for _ in range(k)], type=pa.int32())]
                yield pa.record_batch([*first, *[pa.array(np.concatenate(v)) for v in cols.values()]], names=["part", "filter_order", "step", *cols])

    return parts.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def report(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """The result of op12."""
    return audit(mask_counts(docs, labels, part=part))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x FOR x IN string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') IF x <> ''] AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), FALSE)] AS fails, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string([substr('ABCDE', y, 1) FOR y IN [a, b, c, d, e]], '') AS filter_order, step, [a, b, c, d, e][step] AS i, [a, b, c, d, e][1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (SELECT *, fails[i] AS fail, len([1 FOR y IN before IF fails[y]]) > 0 AS gone, len([1 FOR y IN fails IF y]) AS k FROM c, s),
r AS (SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND fail), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fail AND k = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fail), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE NOT gone AND fail), 0) AS toxic_lost FROM t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
"""
