"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items (questions and answers) are normalised alike: A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, joined by single spaces. The patterns are an item's windows of eight words, or the
whole item if it has fewer. The automaton reads each normalised text once; every occurrence, overlapping ones too, is
mapped back to word numbers and to character offsets of the original text.

The automaton is built from windows of at most ``shard_bytes``. A benchmark beyond that is dealt to several automata by
item, each read in a pass of its own, and the passes are merged per document; so what is sent to the executors at once
never exceeds a fixed size. An item longer than the limit by itself is still one shard.

Defined cases: a null text or item has no words; items without words match nothing; items with a null id are ignored;
several items of one id count as one; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import sliced
from codeloom.llm.common import alnum_words, id_text, id_type, row_key, tidy

WINDOW_WORDS = 8
SHARD_BYTES = 8_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OUT = "n_words long, hits array<struct<first: long, last: long, start: long, stop: long>>, items array<string>"
_HIT = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")]))


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def automaton(items: list[tuple[str, str | None]], size: int = WINDOW_WORDS):
    """Of (id, text) pairs; None if no item has words. Values are (number of words, length, ids)."""
    import ahocorasick

    of: dict[bytes, set[str]] = {}
    for name, text in items:
        for w in windows(alnum_words(text), size):
            of.setdefault(w, set()).add(name)
    if not of:
        return None
    made = ahocorasick.Automaton()
    for w, names in of.items():
        made.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 2, tuple(names)))
    made.make_automaton()
    return made


def scan(made, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs of hit words (first, end exclusive) and the ids of the items that occur."""
    text = " " + b" ".join(words).decode("latin-1") + " "
    found = list(made.iter(text)) if made is not None and words else []
    if not found:
        return [], set()
    starts = np.zeros(len(words) + 1, dtype=np.int64)  # of the space before each word
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    at = np.searchsorted(starts, np.array([e + 1 - v[1] for e, v in found]))
    runs: list[list[int]] = []
    names: set[str] = set()
    for a, b, ids in sorted((int(s), int(s) + v[0], v[2]) for s, (_, v) in zip(at, found, strict=True)):
        names.update(ids)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs], names


def find(docs: DataFrame, benchmark: DataFrame, *, window_words: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every row of docs, and ``text`` if asked for.

    hits: maximal runs of hit words as word numbers (first, last inclusive) and character offsets of the original text
    (start, stop exclusive). items: the distinct ids of the items that occur, sorted as strings.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("name is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total * (window_words + 1) // shard_bytes))
    rows, kind, carried = id_text(docs), id_type(docs), "text string, " * with_text

    def one(shard: int) -> DataFrame:
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard)
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # of a size checked above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(sent.value, window_words)
            for batch in batches:
                for part in sliced(batch):
                    counts, hits, names = [], [], []
                    for text in part.column("text").to_pylist():
                        words = alnum_words(text)
                        runs, ids = scan(made, words)
                        spans = [m.span() for m in _WORD.finditer(text)] if runs else []
                        counts.append(len(words))
                        hits.append([(a, b - 1, spans[a][0], spans[b - 1][1]) for a, b in runs])
                        names.append(sorted(ids))
                    passed = [c for c in part.schema.names if c != "text"]
                    others = [part.column(c) for c in passed] + [part.column("text")] * with_text
                    yield pa.record_batch([*others, pa.array(counts, type=pa.int64()), pa.array([[dict(zip(("first", "last", "start", "stop"), h, strict=True)) for h in x] for x in hits], type=_HIT), pa.array(names, type=pa.list_(pa.string()))], names=[*passed, *["text"] * with_text, "n_words", "hits", "items"])

        if shards == 1:
            return rows.mapInArrow(tidy(run), f"doc_id {kind}, {carried}{_OUT}")
        return rows.select("doc_id", *row_key(), "text").mapInArrow(tidy(run), f"doc_id {kind}, k1 long, k2 long, {carried}{_OUT}")

    if shards == 1:
        return one(0)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_hits = []
            for hits in batch.column("hits").to_pylist():
                runs: list[dict] = []
                for h in sorted((h for x in hits for h in x), key=lambda h: (h["first"], h["last"])):
                    if runs and h["first"] <= runs[-1]["last"] + 1:
                        if h["last"] > runs[-1]["last"]:
                            runs[-1] |= {"last": h["last"], "stop": h["stop"]}
                    else:
                        runs.append(dict(h))
                all_hits.append(runs)
            names = [sorted({i for x in lists for i in x}) for lists in batch.column("items").to_pylist()]
            same = ["doc_id", *["text"] * with_text, "n_words"]
            out = [*(batch.column(c) for c in same), pa.array(all_hits, type=_HIT), pa.array(names, type=pa.list_(pa.string()))]
            take = [i for i, n in enumerate(batch.column("copies").to_pylist()) for _ in range(n)]
            yield pa.record_batch(out, names=[*same, "hits", "items"]).take(pa.array(take, type=pa.int64()))

    passes = one(0)
    for k in range(1, shards):
        passes = passes.unionAll(one(k))
    # A group has one row for each pass and copy of one row.
    text = [F.first("text").alias("text")] * with_text
    grouped = passes.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), *text, F.max("n_words").alias("n_words"), F.collect_set("hits").alias("hits"), F.collect_set("items").alias("items"), (F.count("*") / shards).cast("int").alias("copies"))
    return grouped.select("doc_id", *["text"] * with_text, "n_words", "hits", "items", "copies").mapInArrow(merged, f"doc_id {kind}, {carried}{_OUT}")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The result of op2: counts of words, hit words and items, a digest of the items, and the verdict."""
    return find(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the benchmark: rows with two items or more go; where one item occurs, its hit words are cut out.

    Returns the columns of docs; ``text`` is changed in the rows with one item. Nothing is joined: the other columns pass
    through the scan as they are, and the text goes through it once.
    """
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc_id"), "text")
    found = find(keyed, benchmark, with_text=True, **options).where(F.size("items") < 2).select(F.col("doc_id").alias("row"), "text", "hits")
    text = F.col("text")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, h: F.struct(h["stop"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (h["start"] - acc["at"]).cast("int"))).alias("out"))
    rest = F.aggregate("hits", first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("hits") > 0, rest).otherwise(text)
    return found.select(*[(new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def items_digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
