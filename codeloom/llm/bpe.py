"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. The pre-token boundaries of every chunk are found on its own, in parallel.
From any true boundary on, the split of a text doesn't depend on what came before, so two neighbouring chunks agree
from the first boundary that both have in their overlap: there they are stitched. The stitched pieces are then merged
by rank. Decoding concatenates the raw bytes of the ids.

Texts of at most ``chunk_chars`` are one chunk and never leave their task. Longer ones are dealt out by chunk, so one
very long text doesn't hold up a task, and come together again as boundaries and text of one document only.
Where an overlap has no common boundary (one pre-token longer than the overlap), the neighbours are read as one chunk.

Null texts give no ids. Repeated rows give repeated results; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import id_text, id_type, int_lists, row_key, tidy

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Bytes of text that are encoded at once.
PIECE = 2_000_000
#: Entries of the per-worker memo from pre-token to ids.
MEMO_PIECES = 200_000


class ByteBPE:
    """A rank file and a pre-token pattern, as loaded by one worker."""

    def __init__(self, rank_file: str, pattern: str):
        import regex
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {b: a for a, b in ranks.items()}
        self._find = regex.compile(pattern)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._merge = library._core_bpe.encode_single_piece
        #: The library's own encoding of a whole text, for operators that need ids and no chunks.
        self.encode_ordinary = library.encode_ordinary
        self._memo: dict[str, list[int]] = {}

    def ends(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of a text, which they cover without gaps."""
        return np.fromiter((m.end() for m in self._find.finditer(text)), dtype=np.int64)

    def merge(self, pieces) -> list[int]:
        """Ids of pre-tokens, each merged by rank."""
        memo, out = self._memo, []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = self._merge(piece.encode("utf-8"))
                if len(piece) < 64:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def forget(self) -> None:
        """Empty the memo: it can be the larger part of a worker's memory."""
        self._memo.clear()

    def encode(self, text: str) -> list[int]:
        return self.merge(self._find.findall(text))

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=4)
def loaded(rank_file: str, pattern: str) -> ByteBPE:
    return ByteBPE(rank_file, pattern)


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the overlapping chunks of a text of n characters: each starts ``overlap`` before the last one's end."""
    step = chunk - overlap
    return [(s, min(n, s + chunk)) for s in range(0, max(1, n - overlap), step)]


def stitch(spans: list[tuple[int, int]], ends: list[np.ndarray], retry) -> list[int]:
    """True pre-token ends of a text from the ends of its chunks (absolute positions, ascending chunks).

    A chunk's last end isn't trusted unless it is the text's, as more text could lengthen that pre-token.
    ``retry(start, stop)`` gives the ends for a span that has to be read as one chunk.
    """
    last = spans[-1][1]
    known = list(ends[0] if spans[0][1] == last else ends[0][:-1])
    start = 0  # where the true split is known to hold from, for a retry
    for (s, e), own in zip(spans[1:], ends[1:], strict=True):
        own = own if e == last else own[:-1]
        both = np.intersect1d(np.asarray(known[-4 * (OVERLAP_CHARS + 1) :], dtype=np.int64), own)
        both = both[both > s]
        if len(both):
            at = int(both[0])
            while known and known[-1] > at:
                known.pop()
            known.extend(own[own > at].tolist())
        else:
            start = known[-1] if known else 0
            more = retry(start, e)
            known.extend((more if e == last else more[:-1]).tolist())
    return [int(x) for x in known]


def encode_chunked(bpe: ByteBPE, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of one text by overlapping chunks, in one process."""
    spans = chunk_spans(len(text), chunk, overlap)
    ends = stitch(spans, [s + bpe.ends(text[s:e]) for s, e in spans], lambda s, e: s + bpe.ends(text[s:e]))
    return bpe.merge([text[a:b] for a, b in zip([0, *ends], ends)])


def encode(docs: DataFrame, rank_file: str, pattern: str, *, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` for every row of docs, as the tiktoken library would encode it."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be positive and below chunk_chars")
    kind = id_type(docs)
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    out = f"doc_id {kind}, ids array<int>, decoded binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_file, pattern)
        for batch in batches:
            for part in sliced(batch, PIECE):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), int_lists(ids), pa.array([bpe.decode(x) for x in ids], type=pa.binary())], names=["doc_id", "ids", "decoded"])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_file, pattern)
        for batch in batches:
            ends = [s + bpe.ends(t) for s, t in zip(batch.column("at").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "k1", "k2", "at", "part")), pa.array([x.astype(np.int64).tobytes() for x in ends], type=pa.binary())], names=["doc_id", "k1", "k2", "at", "part", "ends"])

    def joined(group: pa.Table) -> pa.Table:
        bpe = loaded(rank_file, pattern)
        group = group.sort_by("at")
        at, parts, ends = (group.column(c).to_pylist() for c in ("at", "part", "ends"))
        copies = at.count(0)  # repeated rows share their key
        at, parts, ends = at[::copies], parts[::copies], ends[::copies]
        text = parts[0] + "".join(p[overlap_chars:] for p in parts[1:])
        spans = [(s, s + len(p)) for s, p in zip(at, parts, strict=True)]
        true = stitch(spans, [np.frombuffer(x, dtype=np.int64) for x in ends], lambda s, e: s + bpe.ends(text[s:e]))
        ids = bpe.merge([text[a:b] for a, b in zip([0, *true], true)])
        return pa.table([group.column("doc_id").slice(0, copies), int_lists([ids] * copies), pa.array([bpe.decode(ids)] * copies, type=pa.binary())], names=["doc_id", "ids", "decoded"])

    length = F.length("text")
    short = rows.where(length <= chunk_chars).mapInArrow(tidy(whole, lambda: loaded(rank_file, pattern).forget()), out)
    step = chunk_chars - overlap_chars
    long = rows.where(length > chunk_chars).select("doc_id", *row_key(), "text", F.explode(F.sequence(F.lit(0), length - overlap_chars - 1, F.lit(step))).alias("at"))
    long = long.select("doc_id", "k1", "k2", F.col("at").cast("long").alias("at"), F.expr(f"substring(text, at + 1, {chunk_chars})").alias("part"))
    chunks = long.repartition("k1", "k2", "at").mapInArrow(tidy(boundaries), f"doc_id {kind}, k1 long, k2 long, at long, part string, ends binary")
    return short.unionAll(chunks.groupBy("k1", "k2").applyInArrow(joined, out))


def sliced(batch: pa.RecordBatch, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, so what is made from each stays small; a row is never split."""
    n = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
    step = -(-batch.num_rows // n)
    for s in range(0, batch.num_rows, max(1, step)):
        yield batch.slice(s, step)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The result of op4: token counts and digests of ids and decoded bytes."""
    return encode(docs, rank_file, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
