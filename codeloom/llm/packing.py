"""Token-ID and binary output: best-fit-decreasing packing with segment-tree capacity search.

Documents are encoded, those longer than a row are split losslessly into pieces, and the pieces are packed into rows of
``length`` ids: longest first, each into the open row with the least room that still fits it. A segment tree over the
capacities finds that row in O(log length). Every row carries its ids, its cumulative segment lengths and its positions,
which start again at 0 in every segment, so attention and positions never cross documents.

Rows are packed block by block: documents are dealt by their content key to as many blocks as the corpus has
``block_chars`` of text, so a block's size, and the memory and time of its task, don't grow with the corpus. A block is
read in a fixed order, so a repeated task packs the same rows. A block's waste is at most what its last open rows leave.

Null and empty texts have no ids and give no segment. Repeated rows are packed as often as they occur. With a null
``doc_id`` a segment's id is null. No tokens are dropped; the padding of a row follows ``n_tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import loaded, sliced
from codeloom.llm.common import id_text, id_type, put_file, row_key

ROW_TOKENS = 2048
BLOCK_CHARS = 8_000_000
PAD_ID = 0


class CapacityTree:
    """Segment tree over capacities 0..n: how many open rows have which room."""

    def __init__(self, n: int):
        self.leaves = 1 << (n).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, d: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += d
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least size."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of indexes of sizes (each 1..length), by best fit in decreasing order; ties in the given order."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room, row = tree.take(sizes[i]) or (length, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], row)
    return rows


def pack(docs: DataFrame, rank_file: str, pattern: str, *, length: int = ROW_TOKENS, block_chars: int = BLOCK_CHARS, pad_id: int = PAD_ID) -> DataFrame:
    """Packed rows: ``pack_id, doc_ids, pieces, n_tokens, cu_seqlens, input_ids, position_ids``.

    pieces: the number of each segment's piece within its document. cu_seqlens: 0 and the end of every segment.
    input_ids and position_ids: ``length`` little-endian 32-bit integers each, padded with pad_id and 0.
    """
    rows, kind = id_text(docs).where("text <> ''"), id_type(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = rows.select("doc_id", *row_key(), "text").repartition(blocks, "k1", "k2").sortWithinPartitions("k1", "k2").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, block = loaded(rank_file, pattern), TaskContext.get().partitionId()
        parts, owner, piece = [], [], []
        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for some in sliced(batch):
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = np.array(bpe.encode_ordinary(text), dtype=np.int32)
                    for k in range(0, len(ids), length):
                        parts.append(ids[k : k + length])
                        owner.append(doc)
                        piece.append(k // length)
        packed = best_fit_decreasing([len(p) for p in parts], length)
        for s in range(0, len(packed), 256):
            cols: list[list] = [[] for _ in range(7)]
            for k, row in enumerate(packed[s : s + 256], s):
                ends = np.cumsum([0, *(len(parts[i]) for i in row)])
                ids, positions = np.full(length, pad_id, dtype="<i4"), np.zeros(length, dtype="<i4")
                ids[: ends[-1]] = np.concatenate([parts[i] for i in row])
                for a, b in zip(ends, ends[1:]):
                    positions[a:b] = np.arange(b - a)
                for c, v in zip(cols, (block << 32 | k, [owner[i] for i in row], [piece[i] for i in row], int(ends[-1]), ends.tolist(), ids.tobytes(), positions.tobytes()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.list_(id_kind), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["pack_id", "doc_ids", "pieces", "n_tokens", "cu_seqlens", "input_ids", "position_ids"])

    return dealt.mapInArrow(run, f"pack_id long, doc_ids array<{kind}>, pieces array<int>, n_tokens long, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write(packs: DataFrame, folder: str) -> DataFrame:
    """Write the id and position matrices of every partition as raw little-endian files; returns their manifest.

    The files of one partition share a stem: ``.ids.bin`` and ``.pos.bin`` (rows of 32-bit integers) and ``.cu.bin``
    (the cumulative segment lengths of all rows, one after another). Only files in the manifest count; a repeated task
    attempt writes under another stem.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            stem = uuid.uuid4().hex
            put_file(folder, f"{stem}.ids.bin", b"".join(batch.column("input_ids").to_pylist()))
            put_file(folder, f"{stem}.pos.bin", b"".join(batch.column("position_ids").to_pylist()))
            put_file(folder, f"{stem}.cu.bin", np.array([x for r in batch.column("cu_seqlens").to_pylist() for x in r], dtype="<i4").tobytes())
            yield pa.record_batch([[stem], [batch.column("pack_id").to_pylist()]], names=["stem", "pack_ids"])

    return packs.mapInArrow(run, "stem string, pack_ids array<long>")
