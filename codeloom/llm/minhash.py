"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. Its sketch is filled in rounds: in each of the first ``t`` rounds every
element is hashed to a bin and a value, in each of the last ``t`` rounds the elements all go to one bin, so that no
coordinate stays empty; a bin keeps the least value of the first round that reached it. Bands of the sketch propose
candidates, and every link is confirmed on the full sets of the two texts.

How it scales:

* Documents with equal sets form one node, so copies are sketched into one row per node by partial aggregation.
* A bucket never turns into all its pairs. First all members are compared with one pivot, which connects most of a
  group of copies. Then only members of different components are left to compare: those outside a bucket's largest
  component are queries against all its members, in blocks of bounded size. So every candidate pair is compared or
  already connected, however large the bucket is: there is no cap.
* Links, labels and fingerprints stay in the cluster; only counts reach the driver. Rounds are cut by tables in the shared folder.

With 32 bands of 4 coordinates a pair of similarity 0.8 is missed by all bands with probability (1 - 0.8^4)^32 < 1e-7.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing (also not with its like). A null
``doc_id`` takes part and gets its component's smallest id, null if there is none. Rows that repeat an id and text share
their component; ``kept`` compares ids null-safely, so they are kept together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import sliced
from codeloom.llm.common import id_text, id_type, row_key, space_words, stored, tidy

SHINGLE_WORDS = 5
BINS = 128
BANDS = 32
#: Similarity as a fraction; a link needs den * intersection >= num * union.
SIMILARITY = (80, 100)
#: Rows and queries that meet in one block of a bucket, and their shingles (8 bytes each), on average: the lesser rules.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256
BLOCK_SHINGLES = 1_000_000
#: Partners that are compared with one copy of a text.
PARTNERS = 64
_VALUE = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(elements: np.ndarray, t: int = BINS) -> np.ndarray:
    """Fast similarity sketch (t a power of two) of a non-empty array of distinct 64-bit elements."""
    bits = np.uint64(64 - int(t).bit_length() + 1)
    best = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    per = max(1, 2048 // len(elements))
    for r in range(0, 2 * t, per):
        rounds = np.arange(r, min(2 * t, r + per), dtype=np.uint64)
        h = mix(elements[None, :] + mix(rounds + np.uint64(1))[:, None])
        bins = np.where(rounds[:, None] < t, h >> bits, rounds[:, None] - np.uint64(t)).astype(np.int64)
        np.minimum.at(best, bins.ravel(), ((rounds[:, None] << _VALUE) | (h & _MASK)).ravel())
        if best.max() != np.iinfo(np.uint64).max:
            break
    return mix(best)


def bands_of(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket for each band."""
    rows = coordinates.reshape(bands, -1)
    out = mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(rows.shape[1]):
        out = mix(out + rows[:, k])
    return out.view(np.int64)


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The set itself: distinct shingles, the whole sequence if it is shorter, nothing without words."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(size)], strict=False))


class Hasher:
    """64-bit hashes of shingles, with a bounded memo of words."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def _all(self, words: list[bytes]) -> np.ndarray:
        memo, n = self.memo, min(len(words), self.size)
        if len(memo) > 500_000:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([memo[w] for w in words], dtype=np.uint64)
        m = len(words) - n + 1
        out = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            out = mix(out + h[k : k + m])
        return out

    def elements(self, words: list[bytes]) -> np.ndarray:
        return np.unique(self._all(words)) if words else np.zeros(0, dtype=np.uint64)

    def profile(self, words: list[bytes]) -> tuple[int, np.ndarray, bytes | None]:
        """(size of the set, hashes of its shingles, digest of the shingles themselves)."""
        if not words:
            return 0, np.zeros(0, dtype=np.uint64), None
        hashes, at = np.unique(self._all(words), return_index=True)
        full = shingles(words, self.size)
        said = sorted(b" ".join(x) for x in full) if len(full) != len(hashes) else [b" ".join(words[i : i + self.size]) for i in at.tolist()]
        return len(full), hashes, hashlib.blake2b(b"\n".join(said), digest_size=16).digest()


def profiles(docs: DataFrame, shingle_words: int, bins: int = BANDS * 4, bands: int = BANDS) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, node, buckets``: node is a 128-bit digest of the set, null if it is empty."""
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle_words)
        for batch in batches:
            for part in sliced(batch):
                sizes, nodes, buckets = [], [], []
                for text in part.column("text").to_pylist():
                    n, e, node = hasher.profile(space_words(text))
                    sizes.append(n)
                    nodes.append(node)
                    buckets.append(bands_of(sketch(e, bins), bands) if len(e) else None)
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes, type=pa.int64()), pa.array(nodes, type=pa.binary()), pa.array(buckets, type=pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "n_shingles", "node", "buckets"])

    return id_text(docs).select("doc_id", *row_key(), "text").mapInArrow(tidy(run), f"doc_id {kind}, k1 long, k2 long, n_shingles long, node binary, buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. pairs has to be stored: it is read twice.

    A text a travels once for each ``PARTNERS`` partners, and a task holds the sets of one pair at a time.
    """
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, set] = (b"", set())
        for batch in batches:
            for part in sliced(batch):
                found: list[tuple[bytes, bytes]] = []
                for a, b, text in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                    mine = shingles(space_words(text), shingle_words)
                    if b is None:
                        held = (a, mine)
                        continue
                    both = len(held[1] & mine) if held[0] == a else -1
                    if both < 0:
                        raise RuntimeError("a pair came without its first text")
                    if den * both >= num * (len(held[1]) + len(mine) - both):
                        found.append((a, b))
                yield pa.record_batch([pa.array([x[k] for x in found], type=pa.binary()) for k in (0, 1)], names=["a", "b"])

    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    firsts = degree.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("binary").alias("b"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    packed = degree.select(F.struct("a").alias("key"), "chunks")  # another key than the count's, so that a join of many rows of one text can be split
    dealt = pairs.join(packed, F.struct(pairs["a"]) == F.col("key")).select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"))
    seconds = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "text", "chunk")
    ready = firsts.unionByName(seconds).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return ready.select("a", "b", "text").mapInArrow(tidy(run), "a binary, b binary")


def across(members: DataFrame, texts: DataFrame, shingle_words: int, similarity: tuple[int, int]) -> DataFrame:
    """Similar pairs (a, b) between different labels of a bucket, one for each node and other label.

    members: ``bucket, node, label, blocks, chunks, main``; main is the bucket's largest label. The members of other labels
    are the queries, in so many chunks; they meet all members, in so many blocks of bounded size.
    """
    num, den = similarity

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle_words)
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array([hasher.elements(space_words(t)).tobytes() for t in batch.column("text").to_pylist()], type=pa.binary())], names=["node", "elements"])

    def compare(group: pa.Table) -> pa.Table:
        role, node, label, sets = (group.column(c).to_pylist() for c in ("query", "node", "label", "elements"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in sets]
        rows = [i for i, q in enumerate(role) if not q]
        if not rows:  # blocks are dealt by hash, so one may get queries only
            return pa.table([pa.array([], type=pa.binary())] * 2, names=["a", "b"])
        values, flat = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
        sizes = np.array([len(sets[i]) for i in rows])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        names = [label[i] for i in rows]
        out = []
        for i, q in enumerate(role):
            if q:
                at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
                mark = np.zeros(len(values), dtype=np.int32)
                mark[at[values[at] == sets[i]]] = 1
                both = np.add.reduceat(mark[flat], starts)
                best: dict[bytes, int] = {}
                for k in np.flatnonzero(den * both >= num * (len(sets[i]) + sizes - both)):
                    if names[k] != label[i] and (names[k] not in best or (both[k], node[rows[k]]) > (both[best[names[k]]], node[rows[best[names[k]]]])):
                        best[names[k]] = k
                out += [(node[i], node[rows[k]]) for k in best.values()]
        return pa.table([pa.array([min(x) for x in out], type=pa.binary()), pa.array([max(x) for x in out], type=pa.binary())], names=["a", "b"])

    sets = texts.join(members.select("node").distinct(), "node").select("node", "text").mapInArrow(tidy(hashed), "node binary, elements binary")
    full = members.join(sets, "node")
    some = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = full.where("label <> main").select("bucket", F.lit(True).alias("query"), "node", "label", "elements", some("chunks", 1).alias("chunk"), every("blocks").alias("block"))
    rows = full.select("bucket", F.lit(False).alias("query"), "node", "label", "elements", some("blocks", 2).alias("block"), every("chunks").alias("chunk"))
    return queries.unionByName(rows).groupBy("bucket", "chunk", "block").applyInArrow(compare, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each node's component, for the nodes of edges (a, b).

    Every node points to a lesser one of its component. In each round it, and the node that it points to, take the least
    pointer's pointer that its neighbours have, until none changes; so trees of pointers join at their roots, and the
    number of rounds grows with the logarithm of the number of nodes. A round is a few shuffles of the edges, and written.
    """
    kind = dict(edges.dtypes)["a"]
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        at = labels.select("node", "label").join(up, "label")
        heard = both.join(at.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("heard"))
        near = at.join(heard, "node")
        told = near.select("node", F.least("up", "heard").alias("now"), F.col("label").alias("was")).unionAll(near.select("label", "heard", F.lit(None).cast(kind)))
        new = stored(told.groupBy("node").agg(F.min("now").alias("label"), F.max("was").alias("was")), labels)
        labels = new
        if not new.where("label <> was").limit(1).count():
            return new.select("node", "label")


def groups(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, component_id, group, kept`` for every row of docs; group is the component's own key."""
    rows = stored(profiles(docs, shingle_words))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("key"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n"))
    members = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot <> top")
    # Each bucket's first pivot is done after this; the others stay as members.
    members = stored(members.join(shared.select("bucket", "pivot"), "bucket").where("node <> pivot"))
    found = members.select("pivot").unionAll(members.select("node")).distinct().withColumnRenamed("pivot", "node")
    keys = nodes.select("node", "key.k1", "key.k2").join(found, "node")
    source = id_text(docs).select(*row_key(), "text")
    texts = stored(source.join(keys, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text"))

    pairs = stored(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    edges = stored(verified(pairs, texts, shingle_words, similarity))
    labels = components(edges)
    # What one bucket still holds in different components is compared in blocks; after that nothing is left open.
    named = members.select("bucket", "node", "n").join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    total = [F.sum(c).alias(c) for c in ("rows", "n")]
    mixed = parts.groupBy("bucket").agg(*total, F.max(F.struct("rows", "n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    dealt = lambda rows, n, most: F.ceil(F.greatest(rows / most, n / BLOCK_SHINGLES))
    outer = [F.col(c) - F.col(f"main.{c}") for c in ("rows", "n")]
    mixed = mixed.select("bucket", dealt(F.col("rows"), F.col("n"), BLOCK_ROWS).alias("blocks"), dealt(*outer, BLOCK_QUERIES).alias("chunks"), F.col("main.label").alias("main"))
    # Stored before it is read more than once: which of several equal partners a block names may differ between runs.
    proposed = stored(across(stored(named.drop("n").join(mixed, "bucket")), texts, shingle_words, similarity))
    more = stored(verified(proposed, texts, shingle_words, similarity))
    if more.limit(1).count():
        labels = components(edges.unionAll(more))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    label = least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    ids = label.groupBy("label").agg(F.min("least").alias("component"))
    of_node = label.join(ids, "label").select("node", "component", "label")
    full = rows.select("doc_id", "k1", "k2", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return full.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"), F.coalesce("label", F.encode(F.concat_ws(",", "k1", "k2"), "UTF-8")).alias("group")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The result of op1: ``doc_id, n_shingles, component_id, kept`` for every row of docs."""
    return groups(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each group: the one with the least id (null last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    chosen = groups(docs, **options).groupBy("group").agg(first).select("first.k1", "first.k2")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    return rows.join(chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
