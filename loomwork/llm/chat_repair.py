r"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by A* on the edit lattice.

A conversation's rows are ordered by (turn, role, text), nulls first. Each row's first fault counts: *blank* (nothing but white space),
*duplicate* (role and text seen earlier in the conversation), *truncated* (the last character that isn't white space is none of `.!?`).
Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an empty user or assistant turn 5; a truncated row that
stays adds 5. A node of the lattice is (rows read, state of the role grammar). The heuristic is a suffix sum: 2 for each row still to be read that must go or
is truncated, as the cheapest way past either costs 2; it never exceeds the true cost and never falls by more than a step costs. The queue is ordered by (cost plus heuristic, audit), the audit being the
initials of the edits so far, so the first goal has the least cost, and of those with it the ASCII-least audit. As an audit fixes the path, paths form a trie: audits are compared by jump pointers to where they part, in logarithmic time, and
never copied.

In Spark: two windows find places and duplicates, without a conversation in memory; a character for each row says what the search has to know, so it gathers a few
bytes a row; and rows are rendered in a stream behind their audit. Texts are never gathered, however long a conversation is; the search takes memory in proportion to its rows.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; null turns come first; a role
whose first character is none of s, u, a (an empty one too) can't be kept; repeated rows are duplicates and go; a conversation without rows costs 0; an empty table
gives no rows; very long texts pass one row at a time; columns are picked by exact name.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pick, stage

REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: States: start, after system, after user, after assistant. What comes next if it isn't a system turn at the start, and the state that follows.
NEXT, AFTER, NAMES = "uuau", {"s": 1, "u": 2, "a": 3}, {"u": "user", "a": "assistant"}
FINAL = (0, 3)
BLANK = r"[^\x20\x09-\x0D]"


class _Path:
    """Edits so far: the last one, the path before it, and a path further up, for quick comparison."""

    __slots__ = ("cost", "at", "state", "edit", "before", "jump", "depth")

    def __init__(self, cost: int, at: int, state: int, edit: str = "", before: _Path | None = None):
        self.cost, self.at, self.state, self.edit = cost, at, state, edit
        self.before = before or self
        self.depth = before.depth + 1 if before else 0
        if not before:
            self.jump = self
        else:
            far = before.jump
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def up(self, depth: int) -> _Path:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.before
        return x

    def __lt__(self, other: _Path) -> bool:
        """Whether this audit is less; one that another goes on from is less than it."""
        least = min(self.depth, other.depth)
        x, y = self.up(least), other.up(least)
        if x is y:
            return self.depth < other.depth
        while x.before is not y.before:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.before, y.before)
        return x.edit < y.edit

    def audit(self) -> str:
        out, x = [], self
        while x.depth:
            out.append(x.edit)
            x = x.before
        return "".join(reversed(out))


def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits. rows: a character for each row: s, u, a or ? for its role, upper case (or !) if truncated, x if it must go."""
    n = len(rows)
    rest = array("q", bytes(8 * (n + 1)))
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] in "xSUA!" else 0)
    start = _Path(0, 0, 0)
    queue, done = [(rest[0], start)], bytearray(4 * (n + 1))
    while True:
        _, p = heapq.heappop(queue)
        i, state = p.at, p.state
        if done[4 * i + state]:
            continue
        done[4 * i + state] = 1
        if i == n and state in FINAL:
            return p.cost, p.audit()
        to = NEXT[state]
        moves = [("I", INSERT, i, AFTER[to])]
        if i < n:
            moves.append(("D", DELETE, i + 1, state))
            if (row := rows[i]) != "x":
                role, more = row.lower(), UNFINISHED if row in "SUA!" else 0
                if role == to or role == "s" and not state:
                    moves.append(("K", more, i + 1, AFTER[role]))
                if role != to:
                    moves.append(("R", REROLE + more, i + 1, AFTER[to]))
        for edit, cost, at, new in moves:
            if not done[4 * at + new]:
                heapq.heappush(queue, (p.cost + cost + rest[at], _Path(p.cost + cost, at, new, edit, p)))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in 20 each dropped, emptied, without stops, repeated, or made the user's, by a checksum of its key."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    rows = pick(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), which.alias("which"))
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("which <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("which") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("which") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, fault, illegal, new_turn): rows in order, with what is wrong with each; fault is null for a sound row.

    illegal: the initials of the row before and this one are none of su, ua, au. new_turn: a turn that no row before had.
    """
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = pick(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", spaced("role"), spaced("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.left(F.col("role"), F.lit(1))
    before, turn_before = F.lag(initial).over(order), F.lag("turn").over(order)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "illegal": before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"),
            "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn_before),
        }
    )
    # rows of one conversation with one text are dealt out by their role and text, so the second window follows the first's partitions
    copies = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(copies > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "place", "turn", "role", "text", fault.alias("fault"), "illegal", "new_turn")


def _sign(role: Column, fault: Column) -> Column:
    """What `cheapest` has to know of a row."""
    initial = F.left(role, F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    cut = F.when(known == "?", "!").otherwise(F.upper(known))
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", cut).otherwise(known)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of each conversation in `faults`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int | None, int, str]] = []
        now, signs = (), bytearray()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "cost", "audit"])
        for batch in batches:
            for conv, sign in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (conv,) != now:
                    if now:
                        made.append((*now, *cheapest(signs.decode())))
                        if len(made) >= 4096:
                            yield rows()
                            made = []
                    now, signs = (conv,), bytearray()
                signs += sign.encode()
        if now:
            made.append((*now, *cheapest(signs.decode())))
            yield rows()

    signed = rows.select("conv_id", "place", _sign(F.col("role"), F.col("fault")).alias("sign"))
    return _in_order(signed).select("conv_id", "sign").mapInArrow(run, "conv_id long, cost long, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of repaired conversations. rows: of `faults`; found: of `plans`.

    All rows of a conversation are in one partition, by place. An audit comes before its conversation's rows in the stream, so none is held but the row at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out: list[tuple] = []
        now, audit, at, state, place = None, "", 0, 0, 0

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place, state
            place, state = place + 1, AFTER[role[0]]
            out.append((now, place, role, text, edit))

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put(NAMES[NEXT[state]], "", "I")

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                for conv, row, role, text in zip(*[c.to_pylist() for c in batch.slice(first, 1000).columns], strict=True):
                    if not row:  # a conversation's audit, which is ahead of its rows
                        inserted()
                        now, audit, at, state, place = conv, text, 0, 0, 0
                        continue
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        put(role if edit == "K" else NAMES[NEXT[state]], text, edit)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ahead = found.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return _in_order(rows.select("conv_id", "place", "role", "text").unionByName(ahead)).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `repaired`'s rows, `role:text` joined by line ends: conversations must be whole and in order in their partitions, as they come from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int | None, str]] = []
        now, sha = (), None
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made])], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (conv,) != now:
                    if now:
                        made.append((*now, sha.hexdigest()))
                    now, sha = (conv,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if made:
                yield rows()
                made.clear()
        if now:
            made.append((*now, sha.hexdigest()))
            yield rows()

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    turns: conv_id, turn, role, text. conversations: ids (conv_id) that get a row though they have no turns.
    """
    rows = stage(faults(turns), "faults")
    found = stage(plans(rows), "plans")
    of = lambda fault: F.count_if(F.col("fault") == fault)
    facts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        of("blank").alias("blank"),
        of("duplicate").alias("duplicate"),
        of("truncated").alias("truncated"),
        F.count_if("illegal").alias("illegal"),
    )
    parts = [facts, found, digests(repaired(rows, found))] + ([pick(conversations, "conv_id").distinct()] if conversations is not None else [])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    # a row for each part of a conversation; a join would lose null ids
    whole = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in every.columns if c != "conv_id"])
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
