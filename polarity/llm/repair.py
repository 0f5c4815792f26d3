"""Conversation structure repair: the cheapest edits that give every conversation a legal order of turns.

The rows of a conversation go by turn (null first), then role, then text.  A row's first fault
counts: blank, duplicate (role and text seen earlier in the conversation), truncated (its last
character is no sentence end).  Edits are Keep, Rerole to user or assistant, Delete (the only one for blank and
duplicate rows) and Insert of an empty turn; the role initials left must read ``(s?(ua)+)?``.  Of the
cheapest edit sequences the one whose audit (initials of the edits in order) is least in ASCII is taken.

Prefix-doubling path ranking: a node is a place between rows and one of four states (nothing yet, after
system, after user, after assistant).  A row is a 4 x 4 table of costs, inserts in front of it included;
costs to go are its (min, +) suffix products, by doubling.  The arcs that keep to the least cost lead from
each node by at most one arc of each letter, so 2**k letters lead from a node to one node: nodes are
ranked by their least audits of 1, 2, 4, ... letters, each rank from the pair of ranks of the halves; the
ranks choose every node's arc, and the audit is read at all its places at once through the doubled pointers.

A conversation is never collected: rows are dealt by range of (conversation, turn, role, text), a long
one over many partitions.  Two small jobs send, for each partition's first and last conversation, its
table of costs and the states it leads to; from these the driver tells each piece its cost to go and its
first state (two short rows a partition, whatever the data).  Only a conversation's report (its audit and digest are one
value each, and a digest takes text in order) reads all its rows in one task, as a stream.

Defined results: null role and text count as one space; a null conversation id is a conversation; tied turns
go by role and text; repeated rows are duplicates; very long texts and conversations are whole; an empty table has an empty
result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import ship_by_value
from polarity.session import write_table

ship_by_value(__name__)

SPACES = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1                                  # added for a truncated row that stays
_LETTERS = np.frombuffer(b"-DIKR", np.uint8)   # codes 0 (end) to 4, in the order of ASCII
_D, _I, _K, _R = 1, 2, 3, 4
_FAR = 1 << 29
_NEXT = np.array([2, 2, 3, 2])                 # state behind a user or assistant turn put after each state
_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])   # by class s, u, a, other, and state
_END = np.array([0, 4, 2, 0])                  # cost to go behind the last row


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of tables [..., 4, 4]."""
    out = a[..., :, 0:1] + b[..., 0:1, :]
    for k in range(1, 4):
        np.minimum(out, a[..., :, k:k + 1] + b[..., k:k + 1, :], out=out)
    return np.minimum(out, _FAR)


def _row_tables() -> np.ndarray:
    """[class, kind, state, state]: cost of a row with the inserts in front of it; kind 0 sound, 1 to be deleted, 2 truncated."""
    step = np.full((4, 4), _FAR)
    np.fill_diagonal(step, 0)
    step[np.arange(4), _NEXT] = COST["I"]
    inserts = _times(step, step)
    out = np.full((4, 3, 4, 4), _FAR)
    for cls in range(4):
        for kind in range(3):
            for q in range(4):
                out[cls, kind, q, q] = COST["D"]
                if kind != 1:
                    more = TRUNCATED * (kind == 2)
                    out[cls, kind, q, _NEXT[q]] = min(out[cls, kind, q, _NEXT[q]], COST["R"] + more)
                    if _KEEP[cls, q] >= 0:
                        out[cls, kind, q, _KEEP[cls, q]] = min(out[cls, kind, q, _KEEP[cls, q]], COST["K"] + more)
    return _times(inserts, out)


_TABLES = _row_tables()


def suffix_tables(cls: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Table of each row and all behind it in its piece; ``size``: rows of each piece."""
    end = np.repeat(np.cumsum(size), size)
    s, at, step = _TABLES[cls, kind], np.arange(len(cls)), 1
    while step < size.max(initial=0):
        ok = np.flatnonzero(at + step < end)
        s[ok] = _times(s[ok], s[ok + step])
        step *= 2
    return s


class Paths:
    """The least optimal paths of pieces of conversations, from every node on.

    ``to_go``: cost to go behind each piece from each state; ``last``: whether the conversation ends there."""

    def __init__(self, cls: np.ndarray, kind: np.ndarray, size: np.ndarray, to_go: np.ndarray, last: np.ndarray):
        n, pieces = len(cls), len(size)
        place = np.arange(n) + np.repeat(np.arange(pieces), size)           # of each row; a piece has one place more
        ends = np.cumsum(size) + np.arange(pieces)
        self.first = ends - size
        go = np.empty((n + pieces, 4), np.int64)
        go[place] = (suffix_tables(cls, kind, size) + np.repeat(to_go, size, axis=0)[:, None, :]).min(axis=2)
        go[ends] = to_go
        self.go = go
        node = np.arange(4 * (n + pieces), dtype=np.int64).reshape(-1, 4)
        row_cls, row_kind = np.full(n + pieces, 3), np.ones(n + pieces, np.int64)
        row_cls[place], row_kind[place] = cls, kind
        has_row = np.zeros(n + pieces, bool)
        has_row[place] = True
        may_insert = has_row.copy()
        may_insert[ends[last]] = True
        more, free = TRUNCATED * (row_kind == 2)[:, None], (has_row & (row_kind != 1))[:, None]
        keep = _KEEP[row_cls]
        after = np.minimum(np.arange(n + pieces) + 1, n + pieces - 1)[:, None]
        flat = go.ravel()
        arcs = []                                                           # (letter, target, whether optimal)
        for letter, target, cost, ok in (
                (_D, after * 4 + np.arange(4), COST["D"], has_row[:, None]),
                (_I, node // 4 * 4 + _NEXT, COST["I"], may_insert[:, None]),
                (_K, after * 4 + np.maximum(keep, 0), COST["K"] + more, free & (keep >= 0)),
                (_R, after * 4 + _NEXT, COST["R"] + more, free)):
            best = ok & (cost + flat[target] == go)
            arcs.append((letter, target.ravel().astype(np.int32), best.ravel()))
        rank = np.zeros(node.size, np.int64)
        step = np.arange(node.size, dtype=np.int32)
        for letter, target, best in reversed(arcs):
            rank[best], step[best] = letter, target[best]
        ranks, far = rank, step
        while True:                                                         # audits of 1, 2, 4, ... letters
            both = ranks * (ranks.max(initial=0) + 1) + ranks[far]
            ranks, far, before = np.unique(both, return_inverse=True)[1], far[far], far
            if (far == before).all():
                break
        # the ranks choose the arc: least letter, then least rank behind it
        key = np.full(node.size, np.iinfo(np.int64).max)
        letter_of, step = np.zeros(node.size, np.int8), np.arange(node.size, dtype=np.int32)
        for letter, target, best in arcs:
            k = letter * (ranks.max(initial=0) + 1) + ranks[target]
            better = best & (k < key)
            key[better], letter_of[better], step[better] = k[better], letter, target[better]
        self.letter, self.jumps = letter_of, [step]
        while (self.jumps[-1] != (twice := self.jumps[-1][self.jumps[-1]])).any():
            self.jumps.append(twice)

    def exits(self) -> np.ndarray:
        """[piece, state]: the state behind each piece by the state before it."""
        return self.jumps[-1][self.first[:, None] * 4 + np.arange(4)] % 4

    def read(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, letter, piece) of every edit, from the state ``entry`` of each piece."""
        start = self.first * 4 + entry
        count, length = (self.letter > 0).astype(np.int64), None
        for jump in self.jumps:
            count = count + count[jump]
        length = count[start]
        piece = np.repeat(np.arange(len(start)), length)
        j = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = start[piece]
        for k, jump in enumerate(self.jumps):
            on = (j >> k & 1).astype(bool)
            at[on] = jump[at[on]]
        return at, self.letter[at], piece


def _pieces(rows: pa.Table):
    """A partition's rows in order, with (class, kind, rows of each piece, conversation of each piece)."""
    rows = rows.take(pa.array(np.argsort(rows["pos"].to_numpy(), kind="stable")))
    conv = rows["conv"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    size = np.diff(np.append(starts, len(conv)))
    return rows, rows["cls"].to_numpy(), rows["kind"].to_numpy(), size, rows["conv"].take(pa.array(starts)).to_pylist()


def _edge_tables(rows: pa.Table) -> list[tuple]:
    """(conversation, whether the partition's last, table) of its first and last piece."""
    _, cls, kind, size, conv = _pieces(rows)
    tables = suffix_tables(cls, kind, size)[np.cumsum(size) - size]
    return [(conv[i], i == len(size) - 1, tables[i].ravel().tolist()) for i in sorted({0, len(size) - 1})]


class _Bounds:
    """What every partition must know of its neighbours: by (partition, whether its last piece) the cost to go behind
    the piece, whether the conversation ends with it, and the first state."""

    def __init__(self, edges: list):
        self.edges = sorted(edges, key=lambda e: (e.part, e.last))
        more = [a.part != b.part and a.last and a.conv == b.conv for a, b in zip(self.edges, self.edges[1:])] + [False]
        self.goes_on = {(e.part, e.last): m for e, m in zip(self.edges, more)}
        self.to_go, behind = {}, _END
        for e, m in zip(reversed(self.edges), reversed(more)):
            self.to_go[e.part, e.last] = here = behind if m else _END
            behind = (np.array(e.info).reshape(4, 4) + here).min(axis=1)
        self.entry: dict = {}
        self.split = any(more)

    def enter(self, exits: list) -> None:
        by = {(e.part, e.last): e.info for e in exits}
        state = 0
        for e in self.edges:
            at = (e.part, e.last)
            self.entry[at] = state
            state = by[at][state] if self.goes_on[at] else 0

    def of(self, part: int, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost to go, ends here, first state) of a partition's pieces."""
        to_go, last, entry = np.tile(_END, (pieces, 1)), np.ones(pieces, bool), np.zeros(pieces, np.int64)
        # a partition's only piece is its last
        for i, flag in ((0, pieces == 1), (pieces - 1, True)):
            to_go[i], last[i], entry[i] = self.to_go[part, flag], not self.goes_on[part, flag], self.entry.get((part, flag), 0)
        return to_go, last, entry


def _edits(rows: pa.Table, bounds: _Bounds) -> pa.Table:
    """(pos, edit, made): of each row the letters of its edits, inserts in front of it first (and behind the
    last row last), and the role initials that inserts and reroles give."""
    rows, cls, kind, size, _ = _pieces(rows)
    to_go, last, entry = bounds.of(rows["part"][0].as_py(), len(size))
    at, letter, piece = Paths(cls, kind, size, to_go, last).read(entry)
    row = np.minimum(at // 4 - piece, (np.cumsum(size) - 1)[piece])
    offsets = np.searchsorted(row, np.arange(len(cls) + 1)).astype(np.int32)
    made = np.where((letter == _I) | (letter == _R), np.where(_NEXT[at % 4] == 2, ord("u"), ord("a")), ord("-")).astype(np.uint8)

    def strings(codes):
        return pa.StringArray.from_buffers(len(cls), pa.py_buffer(offsets), pa.py_buffer(codes.tobytes()))

    return pa.table({"pos": rows["pos"], "edit": strings(_LETTERS[letter]), "made": strings(made)})


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row: conv, pos (order of all rows), turn, role, text, fault (none, blank, duplicate or
    truncated), edit (letters), turns array<struct<role, text>> that the row gives after repair."""
    placed = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    # ranges are cut at short keys; rows of one key share a partition, so the whole order holds
    ordered = write_table(placed.repartitionByRange("conv", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)))
                          .sortWithinPartitions("conv", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id()), "repair-rows")
    seen = ordered.groupBy("conv", "role", F.md5("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (F.when(F.length(trimmed) == 0, "blank").when(F.col("new").isNull(), "duplicate")
             .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none"))
    marks = write_table(ordered.join(seen, "pos", "left").select(
        "pos", "conv", F.shiftright("pos", 33).alias("part"),
        F.when(F.left("role", F.lit(1)) == "s", 0).when(F.left("role", F.lit(1)) == "u", 1).when(F.left("role", F.lit(1)) == "a", 2).otherwise(3).alias("cls"),
        fault.alias("fault")), "repair-marks")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    parts = marks.select("pos", "conv", "part", "cls", kind.alias("kind")).groupBy("part")
    told = f"part bigint, conv {placed.schema['conv'].dataType.simpleString()}, last boolean, info array<bigint>"
    conv_type = pa.schema([("part", pa.int64())])

    def sent(found, t: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([t["part"][0].as_py()] * len(found), conv_type.field(0).type), "conv": pa.array([x[0] for x in found], t["conv"].type),
                         "last": pa.array([x[1] for x in found], pa.bool_()), "info": pa.array([x[2] for x in found], pa.list_(pa.int64()))})

    bounds = _Bounds(parts.applyInArrow(lambda t: sent(_edge_tables(t), t), told).collect())         # two rows a partition
    if bounds.split:
        def leads(t: pa.Table) -> pa.Table:
            _, cls, kinds, size, names = _pieces(t)
            to_go, last, _ = bounds.of(t["part"][0].as_py(), len(size))
            exits = Paths(cls, kinds, size, to_go, last).exits()
            return sent([(names[i], i == len(size) - 1, exits[i].tolist()) for i in sorted({0, len(size) - 1})], t)

        exits = parts.applyInArrow(leads, told).collect()                                             # two rows a partition
        bounds.enter(exits)
    edits = write_table(parts.applyInArrow(lambda t: _edits(t, bounds), "pos bigint, edit string, made string"), "repair-edits")

    def given(row_role, row_text):
        def one(k):
            letter, made = F.substring("edit", k, 1), F.substring("made", k, 1)
            new = F.when(made == "u", "user").otherwise("assistant")
            return F.struct(F.when(letter == "K", row_role).otherwise(new).alias("role"), F.when(letter == "I", "").otherwise(row_text).alias("text"))
        stay = F.filter(F.sequence(F.lit(1), F.length("edit")), lambda k: F.substring("edit", k, 1) != "D")
        return F.transform(stay, one)

    return (ordered.join(marks.select("pos", "fault"), "pos").join(edits, "pos")
            .select("conv", "pos", "turn", "role", "text", "fault", "edit", given(F.col("role"), F.col("text")).alias("turns")))


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations as rows: ``conv``, pos and part (their order), role, text."""
    return (repair(rows, conv, turn, role, text).select("conv", "pos", F.posexplode("turns").alias("part", "t"))
            .select(F.col("conv").alias(conv), "pos", "part", "t.role", "t.text"))


class _Report:
    def __init__(self, conv):
        self.conv, self.counts, self.cost, self.illegal = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.audit, self.digest, self.lines = [], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn, role, fault, edit, turns):
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault != "none":
            self.counts[fault] += 1
        self.cost += sum(COST[x] for x in edit) + TRUNCATED * (fault == "truncated" and "D" not in edit)
        self.audit.append(edit)
        for t in turns:
            self.digest.update(("\n" * (self.lines > 0) + t["role"] + ":" + t["text"]).encode())
            self.lines += 1

    def row(self):
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


REPORT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows: conv, gaps (turn numbers missing), blank, duplicate, truncated,
    illegal (adjacent role initials out of order), cost, audit, repaired_sha256 (repaired ``role:text``, newline-joined).
    A conversation's rows are read as a stream; its audit alone is held."""
    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out(done, like):
            columns = list(zip(*done))
            types = [like, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=REPORT)

        like = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, done = batch.slice(start, 1000), []
                like = part.column(0).type
                for conv, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if now is None or now.conv != conv:
                        if now is not None:
                            done.append(now.row())
                        now = _Report(conv)
                    now.add(*row)
                if done:
                    yield out(done, like)
        if now is not None:
            yield out([now.row()], like)

    rows = repaired.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "turn", "role", "fault", "edit", "turns")
    return rows.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} bigint" for c in REPORT[1:7]) + ", audit string, repaired_sha256 string")
