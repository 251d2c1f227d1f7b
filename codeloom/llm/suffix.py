"""Removal of long repeated byte strings by hash-compared suffix sorting.

A byte of a text (as UTF-8) is removed if a string of ``length`` bytes covers it that also starts anywhere else, in the same
document or another; strings are judged on the input and never cross documents.

How the sort is spread over a cluster. Every string of ``length`` bytes contains an *anchor*: the least hash of an
``ANCHOR``-byte gram among the length - ANCHOR + 1 grams it holds (the leftmost, on ties), and equal strings have it at the
same place. So equal strings meet under their anchor's hash. An anchor's *context*, the bytes that strings around it can
reach, settles most of the work without being moved: where an equal context stands twice, all its strings repeat, and
where an anchor's hash stands once, none does. Counts of (anchor, context) hashes are aggregated partially, in each task
first, so copies and very common passages shrink before the shuffle. Only the rest, the edges of repeated passages, send
their context bytes, one row for each distinct context.

The suffixes of the contexts under one anchor are sorted by mergesort. Two suffixes are compared by the longest common
extension of their prefixes, found by binary search over prefix polynomial hashes, so a comparison takes O(log length)
steps. Neighbours in the sorted order that agree in ``length`` bytes are repeated strings, and only they are; strings with
equal hashes send two of them into the sort. The claims on sorted strings are verified on the bytes, and a block with a hash
collision is settled by its bytes instead. A context that stands twice is known by two 64-bit hashes (its anchor's and its own). Anchors with more contexts than ``BLOCK`` are
sorted in blocks; strings that are alone in their block meet those of the other blocks by ranges of another 64-bit hash, packed.
Strings that start at different distances before their anchor can't be equal, so a block is sorted in ranges of that distance,
of about ``STRINGS`` strings: a task's memory doesn't grow with the strings of a block.

Repeats are also told by words: ``passages`` finds those of ``WORDS`` words and more that another row holds too, of which many are
shorter than ``length`` bytes. They are reported beside the removed bytes, and change nothing about these.

Nothing is capped or sampled. A null text is empty; rows that repeat an id and text are separate places, so their strings
of ``length`` bytes repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.bpe import sliced
from codeloom.llm.common import _ALNUM, give_back, id_text, id_type, release, row_key, stored, tidy
from codeloom.llm.minhash import mix

LENGTH = 400
ANCHOR = 48
#: Contexts of one anchor that are sorted together: a few MB of text.
BLOCK = 2048
#: Bytes of text that are hashed at once.
PIECE = 1_000_000
#: Bytes of short texts that are scanned at once: arrays of eight bytes for each of them stay in a core's cache.
SCAN = 128_000
#: Strings of a block that are sorted at once, about: those that start equally far before their anchors stay together.
STRINGS = 50_000
#: Words of the shortest passage, and of the grams that passages meet by.
WORDS = 51
WORD_GRAM = 8
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=_U))
_BYTE2 = mix(np.arange(1001, 1257, dtype=_U))
_FOLD = np.frombuffer(_ALNUM, dtype=np.uint8)


#: Powers that are kept, for each base.
_POWERS = 1 << 20
_kept: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    n = max(1, n)
    if n <= len(kept := _kept.get(int(base), ())):
        return kept[:n]
    out = np.full(min(max(n, _POWERS // 4), _POWERS) if n <= _POWERS else n, base, dtype=_U)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= _POWERS:
        _kept[int(base)] = out
    return out[:n]


class Hashed:
    """Prefix polynomial hashes (mod 2^64) of a byte array: of(start, size) in O(1), for arrays of starts and sizes."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=_U)
        np.cumsum(table[data] * powers(_BASE, n), out=self.prefix[1:])
        self.shift = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.shift[start]


def _sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """better (minimum or maximum) over every window of width values, in two passes over blocks."""
    n = len(values)
    pad = -n % width
    low = better is np.minimum
    block = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max if low else 0, dtype=values.dtype)]).reshape(-1, width)
    ahead = better.accumulate(block, axis=1).ravel()
    behind = better.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return better(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, hashed: Hashed, length: int, gram: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions of the leftmost least gram of every string of length bytes (of those whose starts are valid).

    The place in the array takes the low bits of a gram's hash, so a plain minimum finds the leftmost one.
    """
    least = _least(len(data), hashed, length, gram)
    if valid is not None:
        least = least[valid[: len(least)]]
    picked = np.zeros(len(data) - gram + 1, dtype=bool)
    picked[least] = True
    return np.flatnonzero(picked)


def _least(n: int, hashed: Hashed, length: int, gram: int) -> np.ndarray:
    """Position of the anchor of each of the n - length + 1 strings."""
    bits = _U(max(1, n.bit_length()))
    grams = mix(hashed.of(np.arange(n - gram + 1), gram))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=_U)
    return (_sliding(keys, length - gram + 1, np.minimum) & ((_U(1) << bits) - _U(1))).astype(np.int64)


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, hashed: Hashed | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the length-byte suffixes at starts (by group, then bytes), and whether each equals the one before it.

    A bottom-up mergesort over all groups at once. An element's place in a merge is its rank in the other run, found by
    binary search with hash-compared suffixes.
    """
    hashed = hashed or Hashed(data)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), length, dtype=np.int64)
        same = hashed.of(a, length) == hashed.of(b, length)
        low[same] = length
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            eq = hashed.of(a[open_], mid) == hashed.of(b[open_], mid)
            low[open_[eq]] = mid[eq]
            high[open_[~eq]] = mid[~eq] - 1
        return low

    def less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """suffix a < suffix b (or <=), for arrays of indexes into starts, within one group."""
        n = extension(starts[a], starts[b])
        done = n >= length
        out = np.full(len(a), or_equal)
        open_ = np.flatnonzero(~done)
        out[open_] = data[starts[a][open_] + n[open_]] < data[starts[b][open_] + n[open_]]
        return out

    order = np.argsort(group, kind="stable")
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))) if len(order) else np.zeros(0, dtype=np.int64)
    first = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes, sizes)  # of each slot's group
    size = np.repeat(sizes, sizes)
    slot = np.arange(len(order))
    run = 1
    while len(sizes) and run < sizes.max():
        inside = slot - first
        mine, is_right = inside // run, (inside // run) % 2 == 1
        other_low = np.where(is_right, first + (mine - 1) * run, first + (mine + 1) * run)
        other_high = np.minimum(other_low + run, first + size)
        low, high = np.minimum(other_low, other_high), other_high.copy()
        base = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            # the rank in the other run counts smaller ones, and for a right element equal ones too (stable)
            up = np.where(is_right[open_], ~less(order[slot[open_]], order[mid], False), less(order[mid], order[slot[open_]], False))
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        pair = first + (mine // 2) * 2 * run
        new = np.empty_like(order)
        new[pair + (slot - (first + mine * run)) + (low - base)] = order
        order, run = new, 2 * run
    equal = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(group[a] == group[b])
        equal[near + 1] = hashed.of(starts[a[near]], length) == hashed.of(starts[b[near]], length)
    return order, equal


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, hashed: Hashed | None = None) -> np.ndarray:
    """Which of the length-byte strings at starts equal another of their group; verified on the bytes.

    Strings of one group with equal hashes are represented by two of them in the sort. Those that the sort puts side by side
    and finds equal are repeated; the others of their hash are compared with the first by their bytes.
    """
    out = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return out
    hashed = hashed or Hashed(data)
    key = mix(hashed.of(starts, length) + mix(group.astype(_U)))
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    name = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order))) > 1
    pair = np.sort(np.concatenate([order[first[many]], order[first[many] + 1]]))
    sorted_, equal = suffix_sort(data, starts[pair], group[pair], length, hashed)
    name_of = np.empty(len(starts), dtype=np.int64)
    name_of[order] = name
    found = np.zeros(len(first), dtype=bool)
    at = np.flatnonzero(equal)
    found[name_of[pair[sorted_[at]]]] = found[name_of[pair[sorted_[at - 1]]]] = True
    mine = np.flatnonzero(many[name])
    least = np.minimum.reduceat(starts[order], first)[name[mine]]  # the first of each string's equals
    own = starts[order[mine]]
    by = np.argsort(own)
    own, least = own[by], least[by]
    # where both move on by one byte, all but the last byte has been compared
    on = np.concatenate([[False], (np.diff(own) == 1) & (np.diff(least) == 1)]) if len(own) else np.zeros(0, dtype=bool)
    ok = bool((data[own[on] + length - 1] == data[least[on] + length - 1]).all())
    heads = np.flatnonzero(~on)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for part in np.array_split(heads, len(heads) // 8192 + 1):
        ok = ok and bool((view[own[part]] == view[least[part]]).all())
    if ok:
        out[order[found[name]]] = True
        return out
    names: dict[tuple[int, bytes], list[int]] = {}  # a hash collision: settle the block by the bytes themselves
    for i, s in enumerate(starts):
        names.setdefault((int(group[i]), data[s : s + length].tobytes()), []).append(i)
    for same in names.values():
        out[same] = len(same) > 1
    return out


#: A string that stands alone in its block: its hash, its context (0 if settled), how far it starts before the anchor.
_LONE = np.dtype([("hash", "<u8"), ("context", "<i8"), ("back", "<u2"), ("settled", "u1")])


def _as_runs(backs: np.ndarray) -> bytes:
    """Numbers as packed runs (first, last) of consecutive ones."""
    v = np.sort(backs)
    cuts = np.flatnonzero(np.diff(v) != 1)
    return np.stack([v[np.concatenate([[0], cuts + 1])], v[np.concatenate([cuts, [len(v) - 1]])]], axis=1).astype("<u2").tobytes()


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Flags of the entries that differ from the one before in any of the keys."""
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _scan(pieces: list[tuple[int, int, np.ndarray, int, int]], length: int, gram: int, skip: np.ndarray | None = None):
    """Anchors of pieces (document, offset in it, bytes, first and last+1 start of their strings within the piece).

    Returns document, position in it, and the hashes of anchor and context, one entry for each anchor.
    """
    sizes = np.array([len(p[2]) for p in pieces])
    low = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.concatenate([p[2] for p in pieces])
    valid = np.zeros(len(data), dtype=bool)
    for at, p in zip(low, pieces, strict=True):
        valid[at + p[3] : at + p[4]] = True
    hashed = Hashed(data)
    at = anchors(data, hashed, length, gram, valid)
    piece = np.searchsorted(low, at, side="right") - 1
    doc, base = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece]
    place = at - low[piece] + base
    if skip is not None:
        keep = ~np.isin(place, skip)
        at, piece, doc, place = at[keep], piece[keep], doc[keep], place[keep]
    start, stop = np.maximum(at - (length - gram), low[piece]), np.minimum(at + length, low[piece] + sizes[piece])
    # where in its context an anchor stands belongs to the context
    shape = (at - start).astype(_U) * _U(1_000_003) + (stop - at).astype(_U)
    return doc, place, mix(hashed.of(at, gram)), mix(hashed.of(start, stop - start) + shape)


def _places(docs: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """``k1, k2, anchor, context, at, n``: the anchors of every text; equal ones of a text in one row, with packed positions."""
    names = ["k1", "k2", "anchor", "context", "at", "n"]

    def rows(k1: np.ndarray, k2: np.ndarray, doc, place, anchor, context) -> pa.RecordBatch:
        order = np.lexsort((place, context, anchor, doc))
        keys = np.stack([doc[order].astype(_U), anchor[order], context[order]])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(order))[: len(cuts)]
        offsets = (np.append(cuts, len(order)) * 8).astype(np.int32)
        at = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place[order].astype("<i8").tobytes())])
        who = doc[order][cuts]
        return pa.record_batch([pa.array(k1[who]), pa.array(k2[who]), *(pa.array(np.ascontiguousarray(k[cuts]).view(np.int64)) for k in keys[1:]), at, pa.array(ends - cuts)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, min(SCAN, piece)):
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                small: list[tuple[int, int, np.ndarray, int, int]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    if length <= len(data) <= 2 * piece:
                        small.append((i, 0, data, 0, len(data) - length + 1))
                    elif len(data) > 2 * piece:  # a very long text goes in pieces that overlap
                        before = np.zeros(0, dtype=np.int64)
                        for s in range(0, len(data) - length + 1, piece):
                            a, b = max(0, s - length), min(len(data), s + piece + 2 * length)
                            found = _scan([(i, a, data[a:b], s - a, min(s + piece, len(data) - length + 1) - a)], length, gram, before)
                            before = found[1][found[1] >= s + piece]
                            yield rows(k1, k2, *found)
                if small:
                    yield rows(k1, k2, *_scan(small, length, gram))

    return docs.mapInArrow(tidy(run), "k1 long, k2 long, anchor long, context long, at binary, n long")


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = ANCHOR, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``k1, k2, starts``: for texts with repeated strings, packed arrays of runs (first, last) of their starts."""
    rows = id_text(docs).select(*row_key(), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    places = _shared_places(rows, length, gram, piece)
    release(docs.sparkSession)
    known = _known(places)
    release(docs.sparkSession)
    found = _edges(rows, known, length, gram, block)
    release(docs.sparkSession)
    # contexts that stand twice: all strings around their anchor repeat
    whole = known.where("n > 1").select("anchor", "context").withColumn("backs", F.lit(None).cast("binary"))
    backs = found.where("kind = 0").unionAll(_crossed(found)).select("anchor", "context", F.col("packed").alias("backs"))
    hits = places.join(whole.unionByName(backs), ["anchor", "context"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "backs")).alias("hits"))
    return stored(hits, places, known, found)


def _shared_places(rows: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """The places whose anchor stands twice in the corpus; the others settle their strings. Usually a small part."""
    every = stored(_places(rows, length, gram, piece))
    shared = every.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    return stored(every.join(shared, "anchor"), every)


def _known(places: DataFrame) -> DataFrame:
    """``anchor, context, n, contexts, least, k1, k2, first``: how often a context stands, how many its anchor has, one place."""
    contexts = places.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", F.expr("substring(at, 1, 8)").alias("first"))).alias("one"))
    totals = places.groupBy("anchor", "context").agg(F.sum("n").alias("n")).groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
    return stored(contexts.join(totals, "anchor").select("anchor", "context", "n", "contexts", "least", "one.k1", "one.k2", "one.first"))


_FOUND = "anchor long, context long, kind int, part long, packed binary"


def _edges(rows: DataFrame, known: DataFrame, length: int, gram: int, block: int, strings: int = STRINGS) -> DataFrame:
    """For anchors with several contexts: which strings of a context that stands once repeat in another one.

    Rows of kind 0 are settled; rows of kind 1 carry packed strings that have to meet other blocks of their anchor.
    """
    reach = length - gram
    several = known.where("contexts > 1 and least = 1").select("anchor", "context", "n", "contexts", "k1", "k2", "first")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ("anchor", "context", "n", "contexts")
        for batch in batches:
            for part in sliced(batch, PIECE):
                left, data = [], []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        at = int.from_bytes(w["first"], "little")
                        left.append((*(w[k] for k in keep), min(at, reach)))
                        data.append(raw[max(0, at - reach) : at + length])
                cols = list(zip(*left, strict=True)) or [[]] * 5
                yield pa.record_batch([*(pa.array(c, type=pa.int64()) for c in cols), pa.array(data, type=pa.binary())], names=[*keep, "left", "data"])

    wanted = several.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "context", "n", "contexts", "first")).alias("wanted"))
    sent = rows.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(tidy(fetch), "anchor long, context long, n long, contexts long, left long, data binary")
    part = F.pmod(F.xxhash64("context"), F.ceil(F.col("contexts") / block))
    sent = sent.withColumn("block", part)

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of rows sorted by (anchor, block): settle each block; a batch's last block waits for the next batch."""
        held: pa.Table | None = None

        def settle(table: pa.Table) -> pa.RecordBatch:
            both = np.stack([table.column(c).to_numpy() for c in ("anchor", "context")])
            table = table.filter(pa.array(np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])))  # a context comes once for each copy of its row
            anchor, block_no, context, n, many, left = (table.column(c).to_numpy() for c in ("anchor", "block", "context", "n", "contexts", "left"))
            pieces = [np.frombuffer(x, dtype=np.uint8) for x in table.column("data").to_pylist()]
            sizes = np.array([len(p) for p in pieces])
            data = np.concatenate(pieces)
            offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)  # 32 bits: a block has a few MB
            hashed, other = Hashed(data), None
            counts = np.minimum(left + 1, np.maximum(0, sizes - length + 1))  # strings that hold the anchor
            _, group = np.unique(np.stack([anchor, block_no]), axis=1, return_inverse=True)
            group = group.ravel().astype(np.int32)
            out: list[list] = [[] for _ in range(5)]
            runs = [(np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype="<u2"))]
            wide = max(1, strings // len(sizes))
            for low in range(0, reach + 1, wide):  # a string that starts back before the anchor equals only ones that do so too
                near, far = np.maximum(low, left - counts + 1), np.minimum(low + wide - 1, left)
                many_of = np.maximum(0, far - near + 1)
                ends = np.cumsum(many_of)
                row = np.repeat(np.arange(len(sizes), dtype=np.int32), many_of)
                if not len(row):
                    continue
                back = (far.astype(np.int32)[row] - (np.arange(len(row)) - (ends - many_of)[row])).astype(np.int32)
                starts = (offset + left.astype(np.int32))[row] - back
                hit = repeated(data, starts, group[row] * np.int32(reach + 1) + back, length, hashed)
                mine = np.flatnonzero(hit & (n[row] == 1))
                new = np.flatnonzero(_heads(mine - np.arange(len(mine)), row[mine]))
                stop = np.append(new[1:], len(mine))[: len(new)] - 1
                runs.append((row[mine[new]], np.stack([back[mine[stop]], back[mine[new]]], axis=1).astype("<u2")))
                # strings alone in their block may stand in another block of the anchor
                spread = np.flatnonzero(many[row] > block)
                if len(spread):
                    other = other or Hashed(data, _BYTE2)
                    hashes = mix(other.of(starts[spread], length) + back[spread].astype(_U))
                    settled = hit[spread] | (n[row[spread]] > 1)  # of these one of each is enough
                    where = np.flatnonzero(settled)
                    _, one = np.unique(mix(hashes[where] + mix(anchor[row[spread[where]]].view(_U))), return_index=True)
                    use = np.concatenate([np.flatnonzero(~settled), where[one]])
                    spread, hashes, settled = spread[use], hashes[use], settled[use]
                    own = row[spread]
                    share = (hashes >> _U(20)) % np.ceil(many[own] / block).astype(_U)
                    order = np.lexsort((own, share, anchor[own]))
                    key = np.stack([anchor[own][order], share[order].astype(np.int64)])
                    cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
                    packed = np.zeros(len(order), dtype=_LONE)
                    packed["hash"], packed["back"], packed["settled"] = hashes[order], back[spread[order]], settled[order]
                    packed["context"] = np.where(settled[order], 0, context[own[order]])
                    for x, y in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                        for c, v in zip(out, (key[0, x], 0, 1, key[1, x], packed[x:y].tobytes()), strict=True):
                            c.append(v)
            of, spans = (np.concatenate(x) for x in zip(*runs, strict=True))
            order = np.argsort(of, kind="stable")
            of, spans = of[order], spans[order]
            cuts = np.flatnonzero(_heads(of))
            for x, y in zip(cuts, np.append(cuts[1:], len(of)), strict=False):
                for c, v in zip(out, (anchor[of[x]], context[of[x]], 0, 0, spans[x:y].tobytes()), strict=True):
                    c.append(v)
            return pa.record_batch([*(pa.array([int(v) for v in c], type=t) for c, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.array(out[4], type=pa.binary())], names=["anchor", "context", "kind", "part", "packed"])

        def key(t: pa.Table, i: int):
            return t.column("anchor")[i].as_py(), t.column("block")[i].as_py()

        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                table = pa.Table.from_batches([batch.slice(s, 1024)])
                table = pa.concat_tables([held, table]) if held is not None else table
                last, at = key(table, table.num_rows - 1), table.num_rows
                while at and key(table, at - 1) == last:
                    at -= 1
                if at:
                    yield settle(table.slice(0, at).combine_chunks())
                held = table.slice(at)
            give_back()
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    ready = sent.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "context")
    return stored(ready.select("anchor", "block", "context", "n", "contexts", "left", "data").mapInArrow(tidy(sort_blocks), _FOUND))


def _crossed(found: DataFrame) -> DataFrame:
    """The strings that stand alone in their block and meet an equal one of another block; in bounded hash ranges."""

    def meet(group: pa.Table) -> pa.Table:
        lone = np.concatenate([np.frombuffer(x, dtype=_LONE) for x in group.column("packed").to_pylist()])
        _, name, count = np.unique(lone["hash"], return_inverse=True, return_counts=True)
        hit = lone[(count[name] > 1) & (lone["settled"] == 0)]
        contexts_, own = np.unique(hit["context"], return_inverse=True)
        anchor = group.column("anchor")[0].as_py()
        out = [(anchor, int(c), 0, 0, _as_runs(hit["back"][own == k].astype(np.int64))) for k, c in enumerate(contexts_)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "context", "kind", "part", "packed"])

    return found.where("kind = 1").groupBy("anchor", "part").applyInArrow(meet, _FOUND)


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """The texts' bytes side by side, with A-Z lower-cased and 32 between words; start and stop of every word; words of each text."""
    raws = [x.encode("utf-8", "surrogatepass") for x in texts]
    low = np.cumsum([1, *(len(r) + 1 for r in raws)])
    data = _FOLD[np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)]
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    return data, begin, end, np.diff(np.searchsorted(begin, low))


def _word_windows(texts: tuple[np.ndarray, ...], words: int, gram: int, piece: int) -> Iterator[tuple]:
    """Windows of consecutive words of texts (from ``_words``): text and number of each word, hash, hashes of ranges, anchors of the windows.

    Long texts go in chunks of words that overlap, so a window comes once. Windows that cross texts are included.
    """
    data, begin, end, counts = texts
    doc = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
    most = max(words, piece // 4)
    for s in range(0, len(begin) - words + 1, most):
        part = slice(s, s + most + words - 1)
        b, e = begin[part], end[part]
        values = mix(Hashed(data[b[0] : e[-1]]).of(b - b[0], e - b) + (e - b).astype(_U))
        hashed = Hashed(np.arange(len(values)), values)
        yield doc[part], number[part], values, hashed, _least(len(values), hashed, words, gram)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The eight bytes of each value, as one binary for each range between cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def passages(docs: DataFrame, *, words: int = WORDS, gram: int = WORD_GRAM, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``k1, k2, passages``: for texts with such, the passages that another row of docs holds too, as spans of word numbers.

    A passage: words or more consecutive words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, whatever stands between
    them; those that overlap or touch are one span. Texts that stand twice are told by a 64-bit hash, and are one passage. Of the
    other ones, only windows whose anchor (the least hash of a gram of words) stands in two texts are compared, by the 64-bit
    hashes of anchor and window; packed, one row for each place of an anchor. Windows at different distances from their anchor
    can't be equal, so an anchor of more texts than ``block`` is dealt out by that distance.
    """
    rows = id_text(docs).where(F.octet_length("text") >= 2 * words - 1).select(*row_key(), F.xxhash64("text").alias("t"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, min(SCAN, piece))):
            texts = _words(batch.column("text").to_pylist())
            who, anchor = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=_U)]
            for doc, _, _, hashed, least in _word_windows(texts, words, gram, piece):
                at = least[doc[: len(least)] == doc[words - 1 :]]
                at = at[_heads(at)]
                who.append(doc[at])
                anchor.append(mix(hashed.of(at, gram)))
            who, anchor = np.concatenate(who), np.concatenate(anchor)
            order = np.lexsort((anchor, who))
            who, anchor = who[order], anchor[order]
            new = _heads(who, anchor)
            who, anchor = who[new], anchor[new]
            mine = who[_heads(who)]
            offsets = np.append(np.searchsorted(who, mine), len(who)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor.view(np.int64)))
            yield pa.record_batch([*(batch.column(c).take(pa.array(mine)) for c in ("k1", "k2", "t")), pa.array(texts[3][mine]), lists], names=["k1", "k2", "t", "words", "anchors"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, min(SCAN, piece))):
            wanted = batch.column("wanted").flatten()
            known, at = np.unique(wanted.field("anchor").to_numpy().view(_U), return_index=True)
            parts = np.minimum(-(-wanted.field("texts").to_numpy()[at] // block), words - gram + 1)
            wide = -(-(words - gram + 1) // parts)  # distances from the anchor that stay together
            t, single = batch.column("t").to_numpy(), batch.column("single").to_numpy(zero_copy_only=False)
            for doc, number, _, hashed, least in _word_windows(_words(batch.column("text").to_pylist()), words, gram, piece):
                head = _heads(least)
                anchor = mix(hashed.of(least[head], gram))
                name = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                of = np.cumsum(head) - 1
                i = np.flatnonzero((known[name] == anchor)[of] & (doc[: len(least)] == doc[words - 1 :]))
                part = (least[i] - i) // wide[name[of[i]]]
                cuts = np.flatnonzero(_heads(least[i], part, doc[i]))
                sizes, windows = np.diff(np.append(cuts, len(i))), hashed.of(i, words)
                own = i[cuts]
                # equal runs of a text share a row: runs of a size whose first and last windows are equal, as these overlap
                keys = (doc[own], anchor[of[own]], sizes, windows[cuts], windows[cuts + sizes - 1])
                order = np.lexsort(keys)
                heads = np.flatnonzero(_heads(*(k[order] for k in keys)))
                one = order[heads]
                at = np.repeat(cuts[one] - (np.cumsum(sizes[one]) - sizes[one]), sizes[one]) + np.arange(sizes[one].sum())
                own = own[one]
                cols = (anchor[of[own]].view(np.int64), part[cuts[one]], t[doc[own]], single[doc[own]])
                packed = (_binary(number[i[cuts[order]]], np.append(heads, len(order))), _binary(windows[at], np.append(0, np.cumsum(sizes[one]))))
                yield pa.record_batch([*(pa.array(c) for c in cols), *packed], names=["anchor", "part", "t", "single", "first", "windows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of rows sorted by (anchor, part); a batch's last group waits for the next batch."""

        def settle(table: pa.Table) -> pa.RecordBatch:
            anchor, part, t, single = (table.column(c).to_numpy() for c in ("anchor", "part", "t", "single"))
            packed, first = (table.column(c).to_pylist() for c in ("windows", "first"))
            sizes = np.array([len(x) for x in packed]) // 8
            hashes = np.frombuffer(b"".join(packed), dtype="<u8")
            row = np.repeat(np.arange(len(sizes)), sizes)
            group = np.cumsum(_heads(anchor, part))[row]
            order = np.lexsort((hashes, group))
            new = _heads(group[order], hashes[order])
            name, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            text = t[row[order]]
            hit = np.empty(len(row), dtype=bool)
            hit[order] = np.logical_or.reduceat(text != text[heads][name], heads)[name]
            i = np.flatnonzero(hit & single[row])
            new = np.concatenate([[True], (np.diff(i) != 1) | (row[i[1:]] != row[i[:-1]])])[: len(i)]
            a, b = i[new], i[np.append(np.flatnonzero(new)[1:], len(i)) - 1] if len(i) else i
            low = np.cumsum(sizes) - sizes
            places = np.array([len(x) for x in first]) // 8  # of each row's run in its text
            number, of = np.frombuffer(b"".join(first), dtype="<i8"), row[a]
            many = places[of]
            at = np.repeat((np.cumsum(places) - places)[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            start, stop = (number[at] + np.repeat(x - low[of], many) for x in (a, b + words))
            return pa.record_batch([pa.array(np.repeat(t[of], many)), pa.array(start), pa.array(stop)], names=["t", "start", "stop"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in (b for b in batches if b.num_rows):
            anchor, part = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
            at = int(other[-1]) + 1 if len(other) else 0
            if held and (at or last != (anchor[-1], part[-1])):
                yield settle(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield settle(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
            last = (anchor[-1], part[-1])
        if held:
            yield settle(pa.Table.from_batches(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, piece)):
            found = batch.column("found")
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            start, stop = (found.flatten().field(c).to_numpy() for c in ("start", "stop"))
            order = np.lexsort((start, row))  # a run of windows that starts later stops later too
            row, start, stop = row[order], start[order], stop[order]
            new = _heads(row)
            new[1:] |= start[1:] > stop[:-1]
            new = np.flatnonzero(new)
            spans = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(stop[np.append(new[1:], len(row)) - 1])], names=["start", "stop"])
            offsets = np.append(np.searchsorted(row[new], np.arange(batch.num_rows)), len(new)).astype(np.int32)
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["k1", "k2", "passages"])

    every = stored(rows.mapInArrow(tidy(scan), "k1 long, k2 long, t long, words long, anchors array<long>"))
    texts = stored(every.groupBy("t").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("one"), F.first("anchors").alias("anchors")).select("t", "n", "one.k1", "one.k2", "anchors"))
    total = F.count("*").over(Window.partitionBy("anchor"))
    shared = texts.select("t", F.explode("anchors").alias("anchor")).withColumn("texts", total).where("texts > 1")
    wanted = shared.groupBy("t").agg(F.collect_list(F.struct("anchor", "texts")).alias("wanted")).join(texts.select("t", "k1", "k2", (F.col("n") == 1).alias("single")), "t").drop("t")
    sent = rows.join(wanted, ["k1", "k2"]).select("t", "single", "text", "wanted").mapInArrow(tidy(fetch), "anchor long, part long, t long, single boolean, first binary, windows binary")
    found = sent.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(tidy(meet), "t long, start long, stop long")
    found = found.groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    spans = "array<struct<start: long, stop: long>>"
    parts = texts.select("t", "k1", "k2").join(found, "t").select("k1", "k2", "found").mapInArrow(tidy(merge), f"k1 long, k2 long, passages {spans}")
    copies = every.join(texts.where("n > 1").select("t"), "t").dropDuplicates(["k1", "k2"])
    copies = copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("stop"))).cast(spans).alias("passages"))
    return stored(parts.unionByName(copies), texts, every)


def _strings(hits: list[dict], size: int, length: int, gram: int) -> np.ndarray:
    """Flags of the starts of repeated strings in a text of size bytes."""
    flags = np.zeros(size - length + 2, dtype=np.int32)
    for h in hits:
        at = np.frombuffer(h["at"], dtype="<i8")
        if h["backs"] is None:  # every string that holds the anchor
            low, high = np.maximum(at - (length - gram), 0), np.minimum(at, size - length) + 1
        else:
            runs = np.frombuffer(h["backs"], dtype="<u2").astype(np.int64).reshape(-1, 2)
            low = (at[:, None] - runs[None, :, 1]).ravel()
            high = (at[:, None] - runs[None, :, 0]).ravel() + 1
        ok = low < high
        np.add.at(flags, low[ok], 1)
        np.add.at(flags, high[ok], -1)
    return np.cumsum(flags)[:-1] > 0


def remove(docs: DataFrame, *, length: int = LENGTH, gram: int = ANCHOR, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, passages`` for every row of docs.

    spans: the removed byte spans (start, stop); kept: the bytes that stay; passages: the bytes of those that ``passages`` finds,
    which stay unless spans cover them.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and below length")
    kind = id_type(docs)
    long = passages(docs, block=block, piece=piece)
    release(docs.sparkSession)
    hits = repeats(docs, length=length, gram=gram, block=block, piece=piece).join(long, ["k1", "k2"], "full")
    rows = id_text(docs).select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text")).join(hits, ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, PIECE)):
            n, spans, kept, shared = [], [], [], []
            for text, found, numbers in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "passages")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                _, begin, end, _ = _words([text]) if numbers else (None,) * 4
                shared.append([{"start": int(begin[p["start"]]) - 1, "stop": int(end[p["stop"] - 1]) - 1} for p in numbers or ()])
                gone: list[tuple[int, int]] = []
                if found:
                    covered = np.zeros(len(raw) + 1, dtype=np.int32)
                    for a, b in zip(*_runs(_strings(found, len(raw), length, gram)), strict=True):
                        covered[a] += 1
                        covered[b - 1 + length] -= 1
                    flags = np.cumsum(covered)[:-1] > 0
                    gone = [(int(a), int(b)) for a, b in zip(*_runs(flags), strict=True)]
                    raw = np.frombuffer(raw, dtype=np.uint8)[~flags].tobytes()
                n.append(len(text.encode("utf-8", "surrogatepass")))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(raw)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(spans, type=span), pa.array(kept, type=pa.binary()), pa.array(shared, type=span)], names=["doc_id", "n_bytes", "spans", "kept", "passages"])

    return rows.select("doc_id", "text", "hits", "passages").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, passages array<struct<start: long, stop: long>>")


def report(docs: DataFrame, **options) -> DataFrame:
    """The result of op7: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, n_passages, passage_bytes`` for every row of docs."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return remove(docs, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"), F.size("passages").cast("long").alias("n_passages"), F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]).alias("passage_bytes"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
