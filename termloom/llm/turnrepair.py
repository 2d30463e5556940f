"""Repair of conversations by the cheapest edits.

A conversation's rows must spell, by their roles' initials, ``(s?(ua)+)?``. The edits span a lattice of (turn index,
state of the grammar) that is never built: Dijkstra's search pops nodes by (cost, audit) and makes a node's edges when it
is popped; the first accepting end node that is popped has the cheapest edits, and of those the least audit.

Two audits of one node and one cost are never one the beginning of the other (they would differ by inserts, which cost),
so the order of beginnings is the order of the whole, and a conversation may be searched in segments: from every state
that is alive at a segment's beginning to every state at its end. Texts pass by once; what a repaired text hashes to is
kept as the state of the hash for each state that is alive. So a task holds a segment, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workers import task

#: States: nothing yet, a system row, a user row last, an assistant row last; where an initial leads; where it may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What a state's next user or assistant row is called.
NAMES = {"u": "user", "a": "assistant"}
#: Faults of a row.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, UNDELETED = 0, 3, 4, 3, 3
#: Rows and bytes of a segment; one row may be larger.
SEGMENT_ROWS, SEGMENT_BYTES = 256, 4 << 20

_BLANK = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, present) of ``conversations``, some rows damaged by the crc32 of ``conv_id:turn``.

    Remainders of 20: 0 drops the row (it stays, not ``present``, so that its conversation is known), 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes its role user. A null role or text is one space, and a null id or turn is
    one in what is hashed.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind != 0).alias("present"))


def in_order() -> tuple[Column, ...]:
    """The order of a conversation's rows: rows of one turn by role and text."""
    return F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` with the first fault of each. Rows meet those of their own conversation, role and text only, so that a long
    conversation is dealt to many tasks."""
    text = F.col("text")
    seen = F.row_number().over(Window.partitionBy("present", "conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(~text.rlike(f"[^{_BLANK}]"), BLANK).when(seen, DUPLICATE).when(~text.rlike(rf"[.!?][{_BLANK}]*\z"), TRUNCATED).otherwise(NONE)
    return rows.withColumn("fault", fault)


def search(rows: list[tuple[str, int]], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest way from ``start`` through all ``rows(initial, fault)`` to every state at their end; to
    the first accepting state alone that is popped there, if these are the ``last`` rows."""
    found: dict[int, tuple[int, str]] = {}
    heap, done = [(0, "", 0, start)], set()
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if not last:
                found[state] = (cost, audit)
                if len(found) == len(NEXT):
                    return found
            elif state in ENDS:
                return {state: (cost, audit)}
        for letter, to in NEXT[state].items():
            if letter in NAMES:
                heappush(heap, (cost + INSERT, audit + "I", at, to))
        if at < len(rows):
            initial, fault = rows[at]
            heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = UNDELETED if fault == TRUNCATED else 0
                if initial in NEXT[state]:
                    heappush(heap, (cost + KEEP + more, audit + "K", at + 1, NEXT[state][initial]))
                for letter, to in NEXT[state].items():
                    if letter in NAMES:
                        heappush(heap, (cost + REROLE + more, audit + "R", at + 1, to))
    return found


class _Conversation:
    """What is known of a conversation whose rows pass by in order."""

    def __init__(self, name: int | None) -> None:
        self.name, self.rows, self.texts, self.n_bytes = name, [], [], 0
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.first = self.turn = None
        self.turns = 0
        #: state: (cost, audit behind the part that all states share, hash of the repaired text)
        self.alive, self.shared = {0: (0, "", hashlib.sha256())}, []

    def add(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.rows.append((initial, fault))
        self.texts.append((role.encode(), text))
        self.n_bytes += len(text)
        if len(self.rows) >= SEGMENT_ROWS or self.n_bytes >= SEGMENT_BYTES:
            self.advance(last=False)

    def advance(self, last: bool) -> None:
        best: dict[int, tuple[int, str, int, str]] = {}
        for state, (cost, audit, _) in self.alive.items():
            for to, (more, own) in search(self.rows, state, last).items():
                way = (cost + more, audit + own, state, own)
                if to not in best or way < best[to]:
                    best[to] = way
        if last:  # of the accepting ends that were popped first from each state, the first of all
            to = min(best, key=lambda x: best[x][:2])
            best = {to: best[to]}
        alive = {to: (cost, audit, self.hashed(self.alive[state][2].copy(), state, own)) for to, (cost, audit, state, own) in best.items()}
        same = len(commonprefix([audit for _, audit, _ in alive.values()]))
        self.shared.append(next(iter(alive.values()))[1][:same])
        self.alive = {to: (cost, audit[same:], h) for to, (cost, audit, h) in alive.items()}
        self.rows, self.texts, self.n_bytes = [], [], 0

    def hashed(self, h, state: int, audit: str):
        """The hash after this segment's rows, edited; a row that is not the first has a line break before it."""
        at = 0
        for edit in audit:
            role, text = (b"", b"") if edit == "I" else self.texts[at]
            at += edit != "I"
            if edit == "D":
                continue
            letter = role[:1].decode() if edit == "K" else next(x for x in NEXT[state] if x in NAMES)
            h.update((b"\n" if state else b"") + (role if edit == "K" else NAMES[letter].encode()) + b":")
            h.update(text)
            state = NEXT[state][letter]
        return h

    def report(self) -> tuple:
        self.advance(last=True)
        ((cost, audit, h),) = self.alive.values()
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.name, min(gaps, (1 << 63) - 1), *self.counts[1:], self.illegal, cost, "".join(self.shared) + audit, h.hexdigest())


REPORT = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


@task()
def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order: a report of each conversation."""
    now, out, held = None, [], 0

    def reports() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), REPORT)], schema=REPORT)

    for batch in batches:
        convs, turns, roles, present, faults = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
        texts = batch.column(3).cast(pa.large_binary() if pa.types.is_large_string(batch.column(3).type) else pa.binary())
        for i, conv in enumerate(convs):
            if now is None or conv != now.name:
                if now is not None:
                    out.append(now.report())
                    held += len(out[-1][7])
                now = _Conversation(conv)
                if len(out) >= 4096 or held >= SEGMENT_BYTES:
                    yield reports()
                    out, held = [], 0
            if present[i]:
                now.add(turns[i], roles[i], texts[i].as_py(), faults[i])
    if now is not None:
        out.append(now.report())
        yield reports()


def repair(rows: DataFrame) -> DataFrame:
    """A report of every conversation of ``rows(conv_id, turn, role, text, copy, present)``: its faults, and its cheapest edits.

    Rows stand by turn, null turns first, rows of one turn by role, text and copy. A null id is a conversation like others.
    An empty role has no initial: its row can't be kept as it is. A conversation whose rows aren't ``present`` has an empty
    audit. One conversation's repaired text has one SHA-256, so its rows pass through one task; they are never gathered.
    """
    dealt = faulty(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *in_order())
    return dealt.select("conv_id", "turn", "role", "text", "present", "fault").mapInArrow(_repair, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of every repaired conversation, by the audits of its report."""
    edits = reports.select("conv_id", F.posexplode(F.filter(F.split("audit", ""), lambda x: x != "")).alias("step", "edit"))
    by = Window.partitionBy("conv_id").orderBy("step")
    edits = edits.withColumn("nth", F.count(F.when(F.col("edit") != "I", 1)).over(by))
    edits = edits.withColumn("nth", F.when(F.col("edit") != "I", F.col("nth")))
    own = rows.where("present").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*in_order())).cast("long"))
    own = own.select(F.col("conv_id").alias("c"), F.col("nth").alias("k"), "role", "text")
    left = edits.join(own, edits["conv_id"].eqNullSafe(own["c"]) & (edits["nth"] == own["k"]), "left").where("edit <> 'D'")
    left = left.withColumn("place", F.row_number().over(by))
    first = (F.col("place") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")
    system = F.max(first.cast("int")).over(Window.partitionBy("conv_id"))
    name = F.when((F.col("place") - system) % 2 == 1, F.lit(NAMES["u"])).otherwise(F.lit(NAMES["a"]))
    return left.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(name).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
