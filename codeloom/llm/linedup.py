"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document's sequence holds its lines that have a word (a character other than space, tab, VT, FF and CR), as they stand.
Every run of ``gram_lines`` lines has a fingerprint; of each ``window`` fingerprints in a row the least is selected, so every
run of ``T = window + gram_lines - 1`` lines holds a selected fingerprint, the same one wherever that run stands. Only positions
whose fingerprint stands elsewhere too are joined. From each such position the match is extended both ways to all
T-line runs that contain it, and a run is deleted if an equal one stands earlier, in the order of ``doc_id`` and line.
Lines of overlapping deleted runs go once; the first place of a run stays.

A passage may stand on fewer than T lines. So every run of 1 .. T - 1 lines that has more than ``long_words`` words (words are
parted by the characters above) is a fingerprint of its own, not subject to selection, and is deleted by the same rule.

The texts are read once for all fingerprints, which are kept as a compact table. Fingerprints and runs are counted by partial
aggregation and joined by key; the keys of the counts are packed, so that the adaptive skew join can split both sides where a
third of all documents share a line, and nothing is gathered per key. What is gathered per document is bounded by its lines.
Lines are compared by 64-bit hashes of single lines within fingerprints and by 128 bits for runs.

Defined cases: a null text is an empty one; runs of fewer than T lines with ``long_words`` words or fewer stay as they are, also
where they are the whole document; lines without a word are kept; rows that repeat an id and text count as one document and get the same result; a null id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import row_key, stored
from codeloom.llm.quality import let, text_of

GRAM_LINES = 2
WINDOW = 2
LONG_WORDS = 50  # runs of fewer lines than T go too if they have more words than this
_SPACES = " \t\x0b\f\r"


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(_SPACES)) != ""


def _n_words(line: Column, odd: Column) -> Column:
    """odd: whether another blank than the space may stand in the line."""
    number = lambda x: F.size(F.array_remove(F.split(x, " ", -1), ""))
    return F.when(odd, number(F.translate(line, _SPACES, " " * len(_SPACES)))).otherwise(number(line))


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _selected(f: Column, window: int) -> Column:
    """Positions of window minima in the fingerprints f; ties count, all of them."""

    def of(i: Column) -> Column:
        out = F.lit(False)
        for d in range(window):
            others = [F.get(f, i - d + k) for k in range(window) if k != d]
            least = F.get(f, i) <= (F.least(*others) if len(others) > 1 else others[0]) if others else F.lit(True)
            out = out | ((i >= d) & (i - d + window <= F.size(f)) & least)
        return out

    return F.filter(_range(F.size(f)), of)


def deleted_runs(docs: DataFrame, *, gram_lines: int = GRAM_LINES, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``k1, k2, gone``: for documents with deleted runs, their first and last places in the sequence of lines with words."""
    size = window + gram_lines - 1
    seen = stored(_anchors(docs, gram_lines, window, long_words))
    shared = seen.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("print").alias("key"))
    places = seen.join(shared, F.struct(seen["print"]) == shared["key"], "left_semi").select("k1", "k2", F.struct("doc_id", "k1", "k2").alias("doc"), F.explode("runs").alias("run"))
    places = stored(places.select("doc", "run.start", "run.stop", F.struct("run.h1", "run.h2").alias("h")), seen)
    ends = places.groupBy("h.h1", "h.h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).where("first < last")
    later = places.join(ends.select(F.struct("h1", "h2").alias("h"), "first"), "h").where(F.struct("doc", "start") > F.col("first"))
    return later.groupBy("doc.k1", "doc.k2").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))


def _anchors(docs: DataFrame, gram_lines: int, window: int, long_words: int) -> DataFrame:
    """``doc_id, k1, k2, print, runs``: the fingerprints of every document and the runs that each stands for."""
    size = window + gram_lines - 1

    def of(lines: Column) -> Column:
        mixed = lambda i, n, c: F.xxhash64(*[F.get(lines, i + k)[c] for k in range(n)], F.lit(n))
        run = lambda s, n: F.struct(s.alias("start"), (s + (n - 1)).alias("stop"), mixed(s, n, "a").alias("h1"), mixed(s, n, "b").alias("h2"))
        first = lambda i: F.greatest(F.lit(0), i - (size - gram_lines))
        last = lambda i: F.least(i, F.size(lines) - size)
        prints = F.transform(_range(F.size(lines) - (gram_lines - 1)), lambda i: mixed(i, gram_lines, "a"))

        def picked(p: Column) -> Column:
            runs = lambda i: F.transform(F.sequence(first(i), last(i)), lambda s: run(s, size))
            return F.transform(_selected(p, window), lambda i: F.struct(F.get(p, i).alias("print"), runs(i).alias("runs")))

        def long(n: int) -> Column:
            words = lambda i: sum((F.get(lines, i + k)["w"] for k in range(n)), F.lit(0))
            at = F.filter(_range(F.size(lines) - (n - 1)), lambda i: words(i) > long_words)
            return F.transform(at, lambda i: F.struct(mixed(i, n, "a").alias("print"), F.array(run(i, n)).alias("runs")))

        return F.concat(let(prints, picked), *[long(n) for n in range(1, size)])

    rows = docs.select("doc_id", "text", text_of().rlike(f"[{_SPACES[1:]}]").alias("odd"))
    hashes = F.transform(F.filter(F.split(text_of(), "\n", -1), _has_word), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), _n_words(x, F.col("odd")).alias("w")))
    return rows.select("doc_id", *row_key(), F.explode(let(hashes, of)).alias("x")).select("doc_id", "k1", "k2", "x.print", "x.runs")


def dedup(docs: DataFrame, *, gram_lines: int = GRAM_LINES, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """docs as ``row`` (a struct of all columns), ``n_lines``, ``n_removed``, and ``text`` without the deleted runs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(), text_of().alias("text"))
    joined = rows.join(deleted_runs(docs, gram_lines=gram_lines, window=window, long_words=long_words), ["k1", "k2"], "left")
    lines = F.split("text", "\n", -1)

    def kept(all_lines: Column) -> Column:
        worded = F.filter(_range(F.size(all_lines)), lambda p: _has_word(F.get(all_lines, p)))
        gone = F.array_distinct(F.flatten(F.transform("gone", lambda r: F.sequence(r["start"], r["stop"]))))
        places = let(worded, lambda w: F.transform(gone, lambda g: F.get(w, g)))
        left = F.array_except(_range(F.size(all_lines)), places)
        return F.struct(F.size(gone).cast("long").alias("n"), F.array_join(F.transform(left, lambda p: F.get(all_lines, p)), "\n").alias("text"))

    full = joined.select("row", "text", F.when(F.col("gone").isNotNull(), let(lines, kept)).alias("new"), F.size(lines).cast("long").alias("n_lines"))
    return full.select("row", "n_lines", F.coalesce("new.n", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new.text", "text").alias("text"))


def report(docs: DataFrame, **options) -> DataFrame:
    """The result of op8: ``doc_id, n_lines, n_removed, kept_sha256`` for every row of docs."""
    return dedup(docs.select("doc_id", "text"), **options).select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE regexp_matches(line, '[^ \t\x0B\f\r]')),
c AS (SELECT doc_id, i, line, lead(line) OVER s AS b, lead(line, 2) OVER s AS c, len([x FOR x IN regexp_split_to_array(line, '[ \t\x0B\f\r]+') IF x <> '']) AS n FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY i) AS m FROM c),
r AS (SELECT doc_id, i, 3 AS size, line || chr(10) || b || chr(10) || c AS run FROM d WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, line || chr(10) || b FROM d WHERE n + m > 50
  UNION ALL SELECT doc_id, i, 1, line FROM d WHERE n > 50),
later AS (SELECT doc_id, i, size FROM (SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, i) AS n FROM r) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k) WHERE k < size),
k AS (SELECT l.doc_id, l.p, l.line, g.i IS NOT NULL AS cut FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.p = w.p LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
