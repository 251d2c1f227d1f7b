"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, with an audit.

A valid conversation is empty, or an optional system row and then pairs of user and assistant: ``(s?(ua)+)?`` over the
roles' initials. Edits of a row: keep (0), rerole to user or assistant (1), delete (2; required for blank rows and
duplicates); rows with an empty text of role user or assistant may be inserted anywhere (5 each); a truncated row that
isn't deleted adds 5. The audit is the edits' initials in order, K R D I; of the cheapest ones the least in ASCII order.

Method: lazy weighted determinisation. The grammar's automaton has four states; the costs to be in each of them after a
row, less the least of them, are a state of a deterministic automaton, which is made when it's first met and kept in a
table with its transitions (``Table``). Costs that no continuation can make good are struck out, so there are few states.
A scan of the table gives the cost. The arcs that keep to the least costs (tight arcs) are traced backwards from the end;
the letters of the audit are then picked forwards among what the trace has marked.

A row's first fault counts: blank (no character outside space and U+0009 to U+000D), duplicate (role and text seen
earlier in the conversation), truncated (its last such character is none of ``.!?``).

Defined cases: nulls in role or text read as one space, so a null text is blank; null turns come first; a null conv_id is a
conversation of its own; rows that tie in the turn are ordered by role and text; repeated rows are duplicates; an
original conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table gives an
empty result. Roles other than system, user and assistant go by their first letter; an empty role fits nowhere. Other
columns are ignored.

Scale: rows are dealt out by ranges of (conversation, turn, ...), so a conversation may span many partitions, and are written
once. Duplicates are found by grouping digests. Blocks of ``BLOCK`` consecutive rows, without texts, are scanned as
groups; a conversation inside a block is done there. The others are pieces of which each gives the least costs between
every two states of the grammar: costs up to a piece and from its end on follow from a stream over pieces, after which the
pieces are traced independently, for each state that they may begin in, and a second stream picks the one. Texts and edits
meet in a stream by conversation: the digest of a text has to be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import sliced
from codeloom.llm.common import stored, tidy
from codeloom.llm.turns import by_conversation, in_order

_SPACES = " \t\n\x0b\f\r"
#: Rows of a block; a power of two.
BLOCK = 4096

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
STATES = range(4)
ARCS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEVER = 1 << 40
#: Cost of the rows to insert at the end.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: What (p, q) says: whatever completes a conversation from q completes it from p for so much more at most.
_INSTEAD = {(3, 1): 0, (0, 1): 0, (3, 0): DELETE, (0, 3): 0}
INITIALS = "sua"
OTHER = 3


def symbol(initial: int, must_go: bool, truncated: bool) -> int:
    """A row's class: all rows that must be deleted are one."""
    return 8 if must_go else 2 * initial + truncated


def row_arcs(sym: int) -> list[tuple[int, str, int, int]]:
    """(from, letter, to, cost) of a row's edits."""
    arcs = [(p, "D", p, DELETE) for p in STATES]
    if sym != 8:
        more = TRUNCATED * (sym % 2)
        for (p, c), q in ARCS.items():
            if sym // 2 < OTHER and c == INITIALS[sym // 2]:
                arcs.append((p, "K", q, more))
            if c != "s":
                arcs.append((p, "R", q, RENAME + more))
    return arcs


INSERTS = [(p, q) for (p, c), q in ARCS.items() if c != "s"]


class Table:
    """The deterministic automaton, as far as it has been met."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.next: dict[int, tuple[int, int]] = {}  # by 16 * state + symbol: state, cost
        self.tight: dict[int, list[tuple[int, str, int]]] = {}  # by 16 * state + symbol
        self.inserts: list[list[tuple[int, int]]] = []  # by state

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector of costs, and what is common to them."""
        costs = list(costs)
        for _ in range(2):  # two inserted rows at most lead to another state
            for p, q in INSERTS:
                costs[q] = min(costs[q], costs[p] + INSERT)
        kept = [NEVER if any(costs[p] + more < costs[q] for (p, to), more in _INSTEAD.items() if to == q) else costs[q] for q in STATES]
        least = min(kept)
        vector = tuple(min(NEVER, c - least) if c < NEVER else NEVER for c in kept)
        if vector not in self.ids:
            self.ids[vector] = len(self.costs)
            self.costs.append(vector)
            self.inserts.append([(p, q) for p, q in INSERTS if vector[p] < NEVER and vector[p] + INSERT == vector[q]])
        return self.ids[vector], least

    def step(self, at: int, sym: int) -> tuple[int, int]:
        key = 16 * at + sym
        if key not in self.next:
            old, new = self.costs[at], [NEVER] * 4
            for p, _, q, cost in row_arcs(sym):
                new[q] = min(new[q], old[p] + cost)
            to, cost = self.next[key] = self.state(new)
            self.tight[key] = [(p, letter, q) for p, letter, q, c in row_arcs(sym) if old[p] < NEVER and self.costs[to][q] < NEVER and old[p] + c == self.costs[to][q] + cost]
        return self.next[key]

    def scan(self, costs: tuple[int, ...] | list[int], symbols: bytes) -> tuple[list[int], int]:
        """The state before each row and at the end, and the cost common to the last one."""
        at, total = self.state(costs)
        path, known = [at], self.next
        for sym in symbols:
            at, cost = known.get(16 * at + sym) or self.step(at, sym)
            total += cost
            path.append(at)
        return path, total

    def between(self, symbols: bytes) -> list[int]:
        """The least cost from each state to each other over the rows, row by row; -1 where another way is never dearer."""
        out = []
        for p in STATES:
            path, total = self.scan([0 if q == p else NEVER for q in STATES], symbols)
            out += [-1 if c >= NEVER else c + total for c in self.costs[path[-1]]]
        return out

    def trace(self, path: list[int], symbols: bytes, rest: tuple[int, ...] | list[int]) -> tuple[int, dict[int, tuple[str, int]]]:
        """The least cost (beside the scan's common one), and the least letters and last state from each first state on a cheapest way.

        rest: costs from each state at the end on. Rows to insert after the last row aren't among the letters.
        """
        last = [min(NEVER, c + r) for c, r in zip(self.costs[path[-1]], rest, strict=True)]
        least = min(last)
        marks = [0] * len(path)
        marks[-1] = sum(1 << q for q in STATES if last[q] == least)
        for i in range(len(symbols) - 1, -1, -1):
            after, mark = marks[i + 1], 0
            for p, _, q in self.tight[16 * path[i] + symbols[i]]:
                if after >> q & 1:
                    mark |= 1 << p
            for _ in range(2):
                for p, q in self.inserts[path[i]]:
                    if mark >> q & 1:
                        mark |= 1 << p
            marks[i] = mark
        found = {}
        for p in STATES:
            if marks[0] >> p & 1:
                at, letters = p, []
                for i, sym in enumerate(symbols):
                    letter = ""
                    while letter in ("", "I"):
                        ways = [("I", q) for a, q in self.inserts[path[i]] if a == at and marks[i] >> q & 1]
                        ways += [(x, q) for a, x, q in self.tight[16 * path[i] + sym] if a == at and marks[i + 1] >> q & 1]
                        letter, at = min(ways)
                        letters.append(letter)
                found[p] = ("".join(letters), at)
        return least, found


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, told by crc32 of ``conv_id:turn``: rows dropped, emptied, stripped of their marks, doubled, or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    rows = conversations.select("conv_id", "turn", space("role").alias("as"), space("text").alias("said"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("as")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _flags(role: Column, text: Column) -> Column:
    """Initial (two bits), blank (4), truncated (8)."""
    said = F.rtrim(text, F.lit(_SPACES))
    initial = F.coalesce(F.create_map(*[x for i, c in enumerate(INITIALS) for x in (F.lit(c), F.lit(i))])[F.left(role, F.lit(1))], F.lit(OTHER))
    return (initial + F.when(said == "", 4).otherwise(0) + F.when(F.right(said, F.lit(1)).isin(".", "!", "?"), 0).otherwise(8)).cast("int")


_FAULTS = ("blank", "duplicate", "truncated", "illegal")
_PIECE = ["first", "n", "symbols", "whole", *_FAULTS, "from_initial", "to_initial", "turns", "least_turn", "most_turn", "from_turn", "to_turn", "cost", "audit", "costs"]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _pieces(id_type: str):
    """From the rows of a block and the positions that aren't duplicates to pieces of conversations."""
    schema = f"conv_id {id_type}, first long, n int, symbols binary, whole boolean, blank long, duplicate long, truncated long, illegal long, from_initial int, to_initial int, turns long, least_turn long, most_turn long, from_turn long, to_turn long, cost long, audit string, costs array<long>"
    table = Table()

    def run(block: pa.Table) -> pa.Table:
        # a block's positions are consecutive; the rows' own records have flags, the records of first ones don't
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("pos", "flags", "conv_id", "turn")), strict=True), key=lambda r: (r[0], r[1] is None))
        new = {r[0] for r in rows if r[1] is None}
        rows = [r for r in rows if r[1] is not None]
        out: list[dict] = []
        starts = [i for i in range(len(rows)) if i == 0 or rows[i][2] != rows[i - 1][2]] + [len(rows)]
        for a, b in zip(starts, starts[1:], strict=False):
            some = rows[a:b]
            faults = dict.fromkeys(_FAULTS, 0)
            symbols, turns = bytearray(), [t for _, _, _, t in some if t is not None]
            initials = [f & 3 for _, f, _, _ in some]
            for pos, flags, _, _ in some:
                blank, copy, short = flags & 4 > 0, pos not in new, flags & 8 > 0
                fault = "blank" if blank else "duplicate" if copy else "truncated" if short else None
                if fault:
                    faults[fault] += 1
                symbols.append(symbol(flags & 3, blank or copy, short))
            faults["illegal"] = sum((x, y) not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))
            piece = {"conv_id": some[0][2], "first": some[0][0], "n": b - a, "symbols": bytes(symbols), "whole": a > 0 and b < len(rows), **faults, "from_initial": initials[0], "to_initial": initials[-1]}
            piece |= {"turns": len(set(turns)), "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "from_turn": turns[0] if turns else None, "to_turn": turns[-1] if turns else None}
            if piece["whole"]:
                path, total = table.scan([0, NEVER, NEVER, NEVER], piece["symbols"])
                least, found = table.trace(path, piece["symbols"], AT_END)
                letters, last = found[0]
                piece |= {"cost": total + least, "audit": letters + "I" * (AT_END[last] // INSERT), "costs": None}
            else:
                piece |= {"cost": None, "audit": None, "costs": table.between(piece["symbols"])}
            out.append(piece)
        kinds = {"first": pa.int64(), "n": pa.int32(), "symbols": pa.binary(), "whole": pa.bool_(), "from_initial": pa.int32(), "to_initial": pa.int32(), "audit": pa.string(), "costs": pa.list_(pa.int64())}
        types = {"conv_id": block.schema.field("conv_id").type} | {c: kinds.get(c, pa.int64()) for c in _PIECE}
        return pa.table({c: pa.array([p[c] for p in out], type=t) for c, t in types.items()})

    return run, schema


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.DataType, tuple, bool]]:
    """Rows of the batches, and whether a row begins another conversation than the one before."""
    before, begun = None, False
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for some in sliced(batch):
            for row in zip(*(some.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True):
                yield kind, row, not begun or row[0] != before
                before, begun = row[0], True


def _in_batches(rows: Iterator[tuple[pa.DataType, tuple]], fields: list[tuple[str, pa.DataType]], most: int = 2_000, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that begin with the conversation's id."""
    held: list[tuple] = []
    chars = 0
    kind = None

    def out() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        made = pa.record_batch([pa.array(c, type=t) for c, (_, t) in zip(cols, [("conv_id", kind), *fields], strict=True)], names=["conv_id", *[n for n, _ in fields]])
        held.clear()
        return made

    for kind, row in rows:  # noqa: B007
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or chars >= most_chars:
            yield out()
            chars = 0
    if held:
        yield out()


def _join_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order, with costs between states, to the costs up to each piece and from its end on."""

    def rows() -> Iterator[tuple[pa.DataType, tuple]]:
        held: list[tuple[int, list[int]]] = []
        now: tuple = (None, None)

        def done() -> Iterator[tuple[pa.DataType, tuple]]:
            before, offset = [[0, NEVER, NEVER, NEVER]], 0
            for _, costs in held:
                new = [min((before[-1][p] + costs[4 * p + q] for p in STATES if costs[4 * p + q] >= 0), default=NEVER) for q in STATES]
                least = min(new)
                offset += least
                before.append([min(NEVER, c - least) for c in new])
            rest, total = [list(AT_END)], offset + min(c + r for c, r in zip(before[-1], AT_END, strict=True))
            for _, costs in reversed(held):
                new = [min((costs[4 * p + q] + rest[-1][q] for q in STATES if costs[4 * p + q] >= 0), default=NEVER) for p in STATES]
                rest.append([min(NEVER, c - min(new)) for c in new])
            for k, (first, _) in enumerate(held):
                yield now[1], (now[0], first, before[k], rest[len(held) - k - 1], total if k == len(held) - 1 else 0, k == len(held) - 1)

        for kind, (conv_id, first, costs), new in _groups(batches, ["first", "costs"]):
            if new:
                yield from done() if held else ()
                held, now = [], (conv_id, kind)
            held.append((first, costs))
        yield from done() if held else ()

    longs = pa.list_(pa.int64())
    return _in_batches(rows(), [("first", pa.int64()), ("before", longs), ("rest", longs), ("cost", pa.int64()), ("is_last", pa.bool_())])


def _trace_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each piece from each state that it may begin in."""
    table = Table()

    def rows() -> Iterator[tuple[pa.DataType, tuple]]:
        for batch in batches:
            for row in batch.to_pylist():
                path, _ = table.scan(row["before"], row["symbols"])
                _, found = table.trace(path, row["symbols"], row["rest"])
                yield batch.schema.field("conv_id").type, (row["conv_id"], row["first"], [found[p][0] if p in found else None for p in STATES], [found[p][1] if p in found else None for p in STATES])

    return _in_batches(rows(), [("first", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each piece, in order, from the state that the piece before ends in."""

    def rows() -> Iterator[tuple[pa.DataType, tuple]]:
        at = 0
        for kind, (conv_id, first, audits, ends, is_last), new in _groups(batches, ["first", "audits", "ends", "is_last"]):
            at = 0 if new else at
            letters, start, at = audits[at], at, ends[at]
            yield kind, (conv_id, first, start, letters + "I" * (AT_END[at] // INSERT) * is_last)

    return _in_batches(rows(), [("first", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's pieces and rows in order to its edited rows, then its faults."""

    def rows() -> Iterator[tuple[pa.DataType, tuple]]:
        now: dict | None = None
        kind = None
        none = (None,) * 4

        def inserts() -> Iterator[tuple]:
            while now["letters"][now["next"] : now["next"] + 1] == "I":
                now["next"] += 1
                yield from edited("I", None, "")

        def edited(letter: str, role: str | None, text: str) -> Iterator[tuple]:
            if letter == "D":
                role = text = None
            else:
                if letter != "K":
                    role = "assistant" if now["state"] == 2 else "user"
                now["state"] = ARCS[now["state"], role[:1]]
            now["at"] += 1
            yield (now["id"], now["at"], letter, role, text, *(None,) * 7)

        def done() -> Iterator[tuple]:
            yield from inserts()
            s = now["sums"]
            gaps = s["most"] - s["least"] + 1 - s["turns"] if s["least"] is not None else 0
            yield (now["id"], now["at"] + 1, *none[:3], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], now["at"])

        for kind, row, new in _groups(batches, ["kind", "role", "text", "piece"]):
            conv_id, what, role, text, piece = row
            if new:
                if now is not None:
                    yield from ((kind, r) for r in done())
                now = {"id": conv_id, "at": 0, "state": 0, "letters": "", "next": 0, "sums": {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "least": None, "most": None, "to_turn": None, "to_initial": None}}
            if what == 1:
                yield from ((kind, r) for r in inserts())  # of the piece before
                s = now["sums"]
                now |= {"letters": piece["audit"], "next": 0}
                for c in (*_FAULTS, "cost", "turns"):
                    s[c] += piece[c] or 0
                s["illegal"] += s["to_initial"] is not None and (s["to_initial"], piece["from_initial"]) not in _LEGAL
                s["to_initial"] = piece["to_initial"]
                if piece["least_turn"] is not None:
                    s["turns"] -= s["to_turn"] is not None and s["to_turn"] == piece["from_turn"]
                    s["least"] = piece["least_turn"] if s["least"] is None else min(s["least"], piece["least_turn"])
                    s["most"] = piece["most_turn"] if s["most"] is None else max(s["most"], piece["most_turn"])
                    s["to_turn"] = piece["to_turn"]
            elif what == 2:
                yield from ((kind, r) for r in inserts())
                letter = now["letters"][now["next"]]
                now["next"] += 1
                yield from ((kind, r) for r in edited(letter, role, text))
        if now is not None:
            yield from ((kind, r) for r in done())

    long = pa.int64()
    return _in_batches(rows(), [("at", long), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), *[(c, long) for c in ("gaps", *_FAULTS, "cost", "n_edits")]])


def edits(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, at, edit, role, text``, a row for each edit, in order; then one with the faults of the conversation and a null edit.

    role and text are those of the repaired row, null where it is deleted. Faults: gaps (turns missing between the first and
    the last), blank, duplicate, truncated, illegal (neighbours that can't follow each other), cost, n_edits.
    conversations: has a conv_id for each conversation that must have a result, also one without rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed = stored(in_order(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")), ["turn", "role", "text"]))
    block = F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")
    role, text = F.col("role"), F.col("text")
    slim = placed.select(block, "pos", _flags(role, text).alias("flags"), "conv_id", "turn")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    firsts = placed.select("conv_id", digest.alias("digest"), "pos").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos"))
    firsts = firsts.select(block, "pos", F.lit(None).cast("int").alias("flags"), F.lit(None).cast(kind).alias("conv_id"), F.lit(None).cast("long").alias("turn"))
    run, schema = _pieces(kind)
    pieces = stored(slim.unionByName(firsts).groupBy("block").applyInArrow(run, schema))

    cut = pieces.where("not whole")
    costs = by_conversation(cut.select("conv_id", "first", "costs"), "first").mapInArrow(_join_costs, f"conv_id {kind}, first long, before array<long>, rest array<long>, cost long, is_last boolean")
    costs = stored(costs)
    ways = cut.select("conv_id", "first", "symbols").join(costs.select("first", "before", "rest"), "first").select("conv_id", "first", "symbols", "before", "rest")
    ways = ways.mapInArrow(tidy(_trace_pieces), f"conv_id {kind}, first long, audits array<string>, ends array<int>")
    picked = by_conversation(ways.join(costs.select("first", "is_last"), "first").select("conv_id", "first", "audits", "ends", "is_last"), "first").mapInArrow(_pick, f"conv_id {kind}, first long, start int, audit string")
    slim_piece = [*_FAULTS, "from_initial", "to_initial", "turns", "least_turn", "most_turn", "from_turn", "to_turn"]
    joined = cut.select("conv_id", "first", *slim_piece).join(costs.select("first", "cost"), "first").join(picked.select("first", "audit"), "first")
    all_pieces = pieces.where("whole").select("conv_id", "first", *slim_piece, "cost", "audit").unionByName(joined.select("conv_id", "first", *slim_piece, "cost", "audit"))

    piece = F.struct(*slim_piece, "cost", "audit")
    none = lambda t: F.lit(None).cast(t)
    shape = dict(all_pieces.select(piece.alias("p")).dtypes)["p"]
    of_rows = placed.select("conv_id", "pos", F.lit(2).alias("kind"), "role", "text", none(shape).alias("piece"))
    of_pieces = all_pieces.select("conv_id", F.col("first").alias("pos"), F.lit(1).alias("kind"), none("string").alias("role"), none("string").alias("text"), piece.alias("piece"))
    parts = of_rows.unionByName(of_pieces)
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast(kind).alias("conv_id")).distinct()
        parts = parts.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), none("string").alias("role"), none("string").alias("text"), none(shape).alias("piece")))
    longs = ", ".join(f"{c} long" for c in ("gaps", *_FAULTS, "cost", "n_edits"))
    return by_conversation(parts, "pos", "kind").mapInArrow(tidy(_edit), f"conv_id {kind}, at long, edit string, role string, text string, {longs}")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    faults = ["gaps", *_FAULTS, "cost"]

    def rows() -> Iterator[tuple[pa.DataType, tuple]]:
        letters: list[str] = []
        said, lines = hashlib.sha256(), 0
        for kind, (conv_id, edit, role, text, *sums), new in _groups(batches, ["edit", "role", "text", *faults]):
            if new:
                letters, said, lines = [], hashlib.sha256(), 0
            if edit is None:
                yield kind, (conv_id, *sums, "".join(letters), said.hexdigest())
                continue
            letters.append(edit)
            if edit != "D":
                said.update(("\n" * (lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1

    return _in_batches(rows(), [*[(c, pa.int64()) for c in faults], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def report(conversations: DataFrame) -> DataFrame:
    """The result of op13: the conversations, damaged by the contract's rule, and their repair."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("gaps", *_FAULTS, "cost"))
    made = edits(damage(conversations.select("conv_id", "turn", "role", "text")), conversations)
    return made.mapInArrow(_digest, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
