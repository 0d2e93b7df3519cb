"""Conversation structure repair: the cheapest edits after which the role initials read (s?(ua)+)?, by branch and bound.

`numbered` orders a conversation's rows and names each row's first fault. `edit_log` finds the edits: a depth-first search
over nodes (rows used, last role) with an explicit stack. A prefix is left when its cost and a lower bound of the rows behind
it exceed the incumbent, or when the table of its node holds a smaller (cost, audit). The search ends when the stack is empty,
so what is left is proved best.

Conversations pass through a task row by row. A search covers WINDOW rows; of what lies before, only the best prefix per last
role is kept (four at most, one character a row each), which is the dominance table of the border nodes. Rows are joined with
their edits by sorting, so texts are never gathered.

Costs: Keep 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; a truncated row that
stays costs 1 more; blank and duplicate rows must go. Equal costs: the least audit, the edits' initials in order.

Defined results: null ids are one conversation; a null role or text is one space; rows are ordered by turn (null first),
role, text; a role's initial is its first character, whatever the role; rows that repeat are duplicates; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of one search. A search grows faster than its rows where many repairs cost the same; most conversations fit in one.
WINDOW = 24
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, ASSISTANT = range(4)
_LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Which role may follow which state, and the states in which a conversation may end.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_LAST = (START, ASSISTANT)
_INITIAL = {USER: "u", ASSISTANT: "a"}
#: A prefix that costs this much more than another of the same rows cannot win: the other can take any plan over by an
#: insert before it and one behind it, or by deleting the system row that only the first could keep.
_SLACK = 5


class Row(NamedTuple):
    """What the search knows of a row."""

    initial: str
    fault: str

    @property
    def must_go(self) -> bool:
        return self.fault in ("blank", "duplicate")

    @property
    def extra(self) -> int:
        return 1 if self.fault == "truncated" else 0


def suffix_bounds(rows: list[Row]) -> list[int]:
    """A cost that no repair of rows[i:] goes below, for every i.

    Each row costs at least its own least edit. Besides, two neighbours among the rows that may stay unedited, with nothing
    but deleted rows between them, need an edit if the second cannot follow the first; an edit costs 2 beyond that least
    and mends two such places at most, so each place counts 1."""
    bounds, later = [0] * (len(rows) + 1), None
    for i in range(len(rows) - 1, -1, -1):
        row, own = rows[i], 0
        if row.must_go:
            own = 3
        else:
            state = _LETTER.get(row.initial)
            own = row.extra + (0 if state else 2)
            if state and later and later not in _NEXT[state]:
                own += 1
            later = state
        bounds[i] = bounds[i + 1] + own
    return bounds


def search(rows: list[Row], entries: dict[int, tuple[int, str]], final: bool) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) for every state after all rows, from entries of the same kind: state -> (cost, audit so far).

    Inserts come before a row, and behind the last one only if the conversation ends here. Audits of one node that cost the
    same are never prefixes of one another, as they use the same rows and an insert costs; so a smaller prefix stays
    smaller whatever follows."""
    n, bounds = len(rows), suffix_bounds(rows)
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    found: dict[int, tuple[int, str]] = {}
    best = (1 << 62, "")
    slack = 0 if final else _SLACK
    stack: list[tuple[int, str, int, int, bool]] = []
    for state, (cost, audit) in sorted(entries.items(), key=lambda e: e[1], reverse=True):
        stack.append((cost, audit, 0, state, False))
    while stack:
        cost, audit, i, state, inserted = stack.pop()
        known = table[i].get(state)
        if known is not None and known < (cost, audit):
            continue
        bound = cost + bounds[i]
        if bound > best[0] + slack or (final and bound == best[0] and audit > best[1][: len(audit)]):
            continue
        table[i][state] = (cost, audit)
        if i == n:
            if not inserted or final:
                if state not in found or (cost, audit) < found[state]:
                    found[state] = (cost, audit)
                if (not final or state in _LAST) and (cost, audit) < best:
                    best = (cost, audit)
            if not final:
                continue
        branches: list[tuple[int, str, int, int, bool]] = []
        follow = _NEXT[state]
        for to in follow:
            if to != SYSTEM:
                branches.append((cost + 2, audit + INSERT, i, to, True))
        if i < n:
            row = rows[i]
            branches.append((cost + 3, audit + DELETE, i + 1, state, False))
            if not row.must_go:
                own = _LETTER.get(row.initial)
                if own in follow:
                    branches.append((cost + row.extra, audit + KEEP, i + 1, own, False))
                for to in follow:
                    if to != SYSTEM:
                        branches.append((cost + row.extra + 2, audit + REROLE, i + 1, to, False))
        kept = []
        for branch in branches:
            there = table[branch[2]].get(branch[3])
            if there is None or branch[:2] < there:
                kept.append(branch)
        kept.sort(key=lambda b: (b[0] + bounds[b[2]], b[1]), reverse=True)
        stack += kept
    return found


def _pruned(lanes: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    least = min(cost for cost, _ in lanes.values())
    return {state: lane for state, lane in lanes.items() if lane[0] <= least + _SLACK}


class Repair:
    """The edits of one conversation, fed row by row."""

    def __init__(self, window: int = WINDOW) -> None:
        self._window = window
        self._rows: list[Row] = []
        #: Per state the cost, and the audit as a chain of pieces (earlier pieces, piece).
        self._lanes: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
        self._order: list[int] = [START]

    def _step(self, final: bool) -> None:
        # Lanes differ before their ends, so one character for each, in their order, stands for all that lies before.
        entries = {state: (self._lanes[state][0], chr(rank)) for rank, state in enumerate(self._order)}
        found = search(self._rows, entries, final)
        found = {s: v for s, v in found.items() if s in _LAST} if final else _pruned(found)
        lanes = {}
        for state, (cost, audit) in found.items():
            lanes[state] = (cost, (self._lanes[self._order[ord(audit[0])]][1], audit[1:]))
        self._order = sorted(found, key=lambda s: found[s][1])
        self._lanes, self._rows = lanes, []

    def add(self, row: Row) -> None:
        if len(self._rows) == self._window:
            self._step(False)
        self._rows.append(row)

    def audit(self) -> tuple[int, str]:
        """Cost and edits of the whole conversation."""
        self._step(True)
        state = min(self._order, key=lambda s: (self._lanes[s][0], self._order.index(s)))
        cost, chain = self._lanes[state]
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


def repaired_audit(rows: Iterable[Row], window: int = WINDOW) -> tuple[int, str]:
    """Cost and audit of one conversation."""
    repair = Repair(window)
    for row in rows:
        repair.add(row)
    return repair.audit()


def apply(initials: Iterable[str], audit: str) -> Iterator[tuple[str, bool, str]]:
    """(edit, whether it uses a row, new role or "") of every edit; the grammar leaves one role for each."""
    state, rows = START, iter(initials)
    for edit in audit:
        if edit == INSERT:
            state = ASSISTANT if state == USER else USER
            yield edit, False, ROLES[_INITIAL[state]]
            continue
        initial = next(rows)
        if edit == KEEP:
            state = _LETTER[initial]
            yield edit, True, ""
        elif edit == REROLE:
            state = ASSISTANT if state == USER else USER
            yield edit, True, ROLES[_INITIAL[state]]
        else:
            yield edit, True, ""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a fixed share of them would be after careless handling: dropped, emptied, without sentence ends, doubled, or
    given to the user; which one follows crc32 of `conv_id:turn`, null being one space everywhere."""
    space = F.lit(" ")
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id",)], F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
                                text.alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def _first_fault() -> Column:
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    return (F.when(body == "", "blank").when(F.col("seen") > 1, "duplicate")
            .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, fault ("", blank, duplicate or truncated) of every row."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    by_text = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "seen")
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(by_text))
    rows = rows.withColumn("place", F.row_number().over(in_order).cast("bigint") - 1)
    return rows.select("conv_id", "place", "turn", "role", "text", _first_fault().alias("fault"))


EDITS = "conv_id bigint, place bigint, edit string, new_role string"


def edits(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The cheapest edits of every conversation, one row each. An insert has the place of the row it comes before; of one
    place, inserts come first. Takes what numbered() gives; texts are not read."""
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, repair, initials = object(), None, []
        out: list[list] = [[], [], [], []]

        def close() -> None:
            place = 0
            for edit, uses, role in apply(initials, repair.audit()[1]):
                for column, value in zip(out, (current, place, edit, role)):
                    column.append(value)
                place += uses

        def taken() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["conv_id", "place", "edit", "new_role"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for conv_id, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))):
                if conv_id != current:
                    if repair:
                        close()
                    current, repair, initials = conv_id, Repair(window), []
                repair.add(Row(initial, fault))
                initials.append(initial)
            if len(out[0]) > 10_000:
                yield taken()
        if repair:
            close()
        yield taken()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", F.left("role", F.lit(1)).alias("initial"), "fault").mapInArrow(decide, EDITS)


LOG = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string, old_role string, fault string"


def edit_log(conversations: DataFrame, window: int = WINDOW) -> DataFrame:
    """The edits with what they make, in order within each partition, a conversation in one: conv_id, place, edit, turn, role
    and text after the edit (of a deleted row: as it was), old_role (null: inserted), fault. Without the rows of edit D this
    is the repaired conversation."""
    rows = numbered(conversations)
    found = edits(rows, window)
    plain = rows.select("conv_id", "place", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("new_role"),
                        "turn", "role", "text", "fault")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("edit") == INSERT, 0).otherwise(2)
    marks = found.select("conv_id", "place", kind.alias("kind"), "edit", "new_role", F.lit(None).cast("bigint").alias("turn"),
                         none.alias("role"), none.alias("text"), none.alias("fault"))
    both = plain.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind", "new_role")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for conv_id, place, kind, edit, new_role, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    out.append((conv_id, place, edit, None, new_role, "", None, ""))
                elif kind == 1:
                    waiting = (turn, role, text, fault)
                else:
                    turn, role, text, fault = waiting
                    out.append((conv_id, place, edit, turn, new_role or role, text, role, fault))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            names = [c.split()[0] for c in LOG.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    return both.mapInArrow(merge, LOG)


SUMMARY = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string")


class _Sum:
    """One conversation's figures, row by row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.first = self.turn = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, role: str, text: str, old_role: str | None, fault: str) -> None:
        self.audit.append(edit)
        self.cost += {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}[edit]
        if old_role is not None:
            if fault:
                self.faults[fault] += 1
            self.cost += fault == "truncated" and edit != DELETE
            if self.before is not None:
                self.illegal += self.before + old_role[:1] not in ("su", "ua", "au")
            self.before = old_role[:1]
            if turn is not None and turn != self.turn:
                self.first = turn if self.first is None else self.first
                self.turn, self.turns = turn, self.turns + 1
        if edit != DELETE:
            self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def summed_up(log: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of an edit log, in its order."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 7, pa.string(), pa.string())
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        current = None
        for batch in batches:
            done = []
            for conv_id, edit, turn, role, text, old_role, fault in zip(*(batch.column(c).to_pylist() for c in
                                                                          ("conv_id", "edit", "turn", "role", "text", "old_role", "fault"))):
                if current is None or current.conv_id != conv_id:
                    done += [current.row()] if current else []
                    current = _Sum(conv_id)
                current.add(edit, turn, role, text, old_role, fault)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(current.row(), kinds)], names)

    return log.mapInArrow(total, SUMMARY)


def repaired(conversations: DataFrame, rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The summary of `rows` for every conv_id of `conversations`; one without rows has zeros."""
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    sums = summed_up(edit_log(rows, window)).withColumnRenamed("conv_id", "__id")
    joined = ids.join(sums, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in sums.columns[1:]])
