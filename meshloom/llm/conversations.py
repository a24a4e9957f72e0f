"""Repairs the structure of conversations by a Viterbi search that emits edits as soon as its survivors agree.

A repaired conversation's roles have initials ``(s?(ua)+)?``: nothing, or a system
turn at most and then user and assistant in turn. Four states tell where a
conversation stands. For each, the cheapest way there survives; ways share their
beginnings in a tree of back-pointers. A node that no survivor leads back to is
dropped, and as soon as all survivors have an ancestor in common, the edits up to
it are final and emitted. So a task holds the edits that are still open, not a
conversation: rows are streamed in order and never gathered.

Of equally cheap ways the one whose letters come first in ASCII order wins. Two
ways that have read the same rows are compared in full, but not letter by letter:
they differ only in inserts at their ends, or else at a place where the comparison
is settled for good. So survivors carry the rank of what they were up to their
last row, and the number of inserts since; both suffice to compare whole suffixes
after every further row.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small

#: Characters that a text may consist of and still be blank; a text that ends in one of ENDS isn't truncated.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of the edits, and of a truncated turn that isn't deleted.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: States by the last initial put out: none, system, user, assistant; those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: By state, the state after the one initial that an edit may put there, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
#: Edits that a task gathers before it hands them on.
EMIT_ROWS = 2000
FAULTS = ("blank", "duplicate", "truncated")


class Node:
    """An edit on a way, with the nodes that continue it and the number of survivors that end here; with neither it goes."""

    __slots__ = ("held", "kids", "letter", "parent", "row")

    def __init__(self, parent: Node | None, letter: str, row: object):
        self.parent, self.letter, self.row, self.kids, self.held = parent, letter, row, [], 1
        if parent is not None:
            parent.kids.append(self)


@dataclass(slots=True)
class Survivor:
    cost: int
    #: rank of the way up to its last row among the survivors, and inserts since then
    rank: int
    inserts: int
    node: Node

    def key(self) -> tuple[int, int, int]:
        return self.cost, self.rank, self.inserts


class Repair:
    """The search over one conversation: ``read`` takes a row, both ``read`` and ``close`` return the edits that became final."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.survivors: list[Survivor | None] = [Survivor(0, 0, 0, self.root), None, None, None]
        #: the state after the edits that were emitted
        self.state = START
        self.open = self.most_open = 0
        self._insert()

    def _new(self, parent: Node, letter: str, row: object) -> Node:
        self.open += 1
        return Node(parent, letter, row)

    def _drop(self, node: Node) -> None:
        """A survivor leaves ``node``: it goes if nothing else refers to it, and so do those before it that only led here."""
        node.held -= 1
        while not node.held and not node.kids and node is not self.root:
            self.open -= 1
            node.parent.kids.remove(node)
            node = node.parent

    def _insert(self) -> None:
        """Inserts before the next row, two at most: a third would lead back to a state already reached."""
        for _ in range(2):
            for state, s in enumerate(self.survivors):
                if s is None or s.inserts == 2:
                    continue
                to = NEXT[state]
                new = (s.cost + COST[INSERT], s.rank, s.inserts + 1)
                old = self.survivors[to]
                if old is None or new < old.key():
                    self.survivors[to] = Survivor(*new, self._new(s.node, INSERT, None))
                    if old is not None:
                        self._drop(old.node)

    def read(self, row: object, initial: str, must_go: bool, truncated: bool) -> list[tuple[str, object, int]]:
        """Takes a row whose role has this initial (empty, if it has none)."""
        best: list[tuple | None] = [None] * 4
        extra = TRUNCATED_COST if truncated else 0

        def offer(to: int | None, s: Survivor, letter: str, cost: int) -> None:
            if to is not None:
                # the letters since the ranked part: inserts, then this one
                new = (s.cost + cost, s.rank, INSERT * s.inserts + letter, s)
                if best[to] is None or new[:3] < best[to][:3]:
                    best[to] = new

        for state, s in enumerate(self.survivors):
            if s is None:
                continue
            offer(state, s, DELETE, COST[DELETE])
            if not must_go:
                offer(AFTER.get((state, initial)), s, KEEP, extra)
                offer(NEXT[state], s, REROLE, COST[REROLE] + extra)
        order = {key: i for i, key in enumerate(sorted({b[1:3] for b in best if b}))}
        before = self.survivors
        self.survivors = [None] * 4
        for state, b in enumerate(best):
            if b:
                self.survivors[state] = Survivor(b[0], order[b[1:3]], 0, self._new(b[3].node, b[2][-1], row))
        for s in before:
            if s is not None:
                self._drop(s.node)
        self.most_open = max(self.most_open, self.open)
        self._insert()
        self._give_up()
        return self._settled()

    def _give_up(self) -> None:
        """Drops the states that only deleting everything so far keeps alive, once they can't be on a cheapest way.

        What follows the start or a system turn can follow an assistant's turn as well, but for keeping a system
        turn, which can be deleted instead. So a way to the assistant that is cheaper by more than that wins whatever
        comes.
        """
        best = self.survivors[ASSISTANT]
        for state, more in ((START, COST[DELETE]), (SYSTEM, 0)):
            s = self.survivors[state]
            if best is not None and s is not None and best.cost + more < s.cost:
                self.survivors[state] = None
                self._drop(s.node)

    def _settled(self) -> list[tuple[str, object, int]]:
        """Moves the root to the youngest ancestor that all survivors share; returns the edits on the way there."""
        edits = []
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.open -= 1
            edits.append(self._emit(self.root))
        return edits

    def _emit(self, node: Node) -> tuple[str, object, int]:
        if node.letter == KEEP:
            self.state = AFTER[self.state, self.initial_of(node.row)]
        elif node.letter != DELETE:
            self.state = NEXT[self.state]
        return node.letter, node.row, self.state

    @staticmethod
    def initial_of(row: object) -> str:
        return row[1][:1]

    def close(self) -> list[tuple[str, object, int]]:
        """The rest of the cheapest way; the search can't go on after this."""
        last = min((self.survivors[s] for s in FINAL if self.survivors[s] is not None), key=Survivor.key)
        way, node = [], last.node
        while node is not self.root:
            way.append(node)
            node = node.parent
        return [self._emit(n) for n in reversed(way)]


def damage(turns: DataFrame, folds: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the crc32 of ``conv_id:turn`` modulo ``folds``.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats the
    row, 4 makes it the user's. A null role, text, or part of ``conv_id:turn`` counts
    as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % folds
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _end(text: Column) -> Column:
    """The last character that isn't blank; empty, if there is none."""
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def marked(turns: DataFrame) -> DataFrame:
    """``turns`` with ``end`` (the last character of the text that isn't blank) and ``seen_at``.

    ``seen_at`` is the first turn with the same role and text, if that is an earlier
    one than the row's own; repeats within a turn stand next to each other when rows
    are sorted, so they aren't marked here. Only keys that several turns have are
    joined back: the hashes of roles and texts are counted where they are, and few
    are left.
    """
    rows = turns.withColumns({"end": _end(F.col("text")), "said": F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))})
    first = rows.where("end != ''").groupBy("conv_id", "said").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("without"))
    again = first.where("least < most or (without and most is not null)").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "least", "without")
    joined = rows.join(again, rows["conv_id"].eqNullSafe(again["_conv"]) & (rows["said"] == again["_said"]), "left")
    return joined.select("conv_id", "turn", "role", "text", "end", F.coalesce((F.col("turn") > F.col("least")) | (F.col("without") & F.col("turn").isNotNull()), F.lit(False)).alias("seen"))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation roles of ``(s?(ua)+)?``, a row an edit.

    ``turns`` has ``conv_id, turn, role, text``. Keeping a turn costs 0, giving it the
    role user or assistant 1, deleting it 2, inserting an empty turn of user or
    assistant 5; a truncated turn that isn't deleted costs 5 more. Blank turns and
    duplicates must be deleted. Of equally cheap repairs the one whose letters (K, R, D,
    I) come first in ASCII order is taken.

    Returns ``conv_id, step`` (from 0), ``edit, fault`` (blank, duplicate, truncated or
    null), ``cost, turn, old_role, role, text``: ``role`` and ``text`` are what is left
    of the row, null for a deleted one; an insert has no turn, fault or old role.

    Rows are taken by turn, nulls first; of one turn, by role and text in code point
    order. A null role or text counts as one space, so such a text is blank; a role
    without characters has no initial and can't be kept. A null ``conv_id`` is a
    conversation of its own; repeated rows are duplicates; an empty table gives an empty
    one. Other columns are ignored, whatever their names.

    All rows of a conversation meet in one task, sorted on disk if need be, and pass
    through it one by one: it holds the edits that are open (tests: ``Repair.most_open``),
    not the conversation, however many rows that has. The texts are shuffled once, or
    twice where texts recur in other turns and are too many to be broadcast.
    """
    ship(turns.sparkSession)
    full = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    kind = full.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "step", "edit", "fault", "cost", "turn", "old_role", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, search, step, last, id_type = None, None, 0, None, pa.int64()
        out: list[list] = [[] for _ in names]

        def put(edits: list[tuple[str, tuple, int]]) -> None:
            nonlocal step
            for letter, row, state in edits:
                turn, old, text, fault = row or (None, None, "", None)
                cost = COST[letter] + (TRUNCATED_COST if fault == "truncated" and letter != DELETE else 0)
                role = None if letter == DELETE else old if letter == KEEP else ROLE[state]
                for column, value in zip(out, (conv, step, letter, fault, cost, turn, old, role, None if letter == DELETE else text), strict=True):
                    column.append(value)
                step += 1

        def made() -> pa.RecordBatch:
            nonlocal out
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            out = [[] for _ in names]
            return batch

        for batch in small(batches):
            id_type = batch.schema.field(0).type
            for own, turn, role, text, end, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if search is None or own != conv:
                    if search is not None:
                        put(search.close())
                    conv, search, step, last = own, Repair(), 0, None
                fault = "blank" if not end else "duplicate" if seen or last == (turn, role, text) else None if end in ENDS else "truncated"
                last = (turn, role, text)
                put(search.read((turn, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                if len(out[0]) >= EMIT_ROWS:
                    yield made()
        if search is not None:
            put(search.close())
        yield made()

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    dealt = marked(full).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind}, step long, edit string, fault string, cost long, turn long, old_role string, role string, text string")


def repair_digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair_conversations``: counts of its faults, the cost, the letters, a hash of what is left.

    ``edits`` must come as the repair returns them: a conversation's rows one after
    another, in order; then this is a narrow map over the same tasks, which hashes as
    it reads. Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` (of ``role:text`` of the turns left, joined by newlines).
    """
    ship(edits.sparkSession)
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, letters, digest, id_type = None, None, io.StringIO(), None, pa.int64()
        first = last = before = None
        distinct = 0
        rows: list[tuple] = []

        def close() -> None:
            gaps = last - first + 1 - distinct if distinct else 0
            rows.append((conv, gaps, *(counts[f] for f in FAULTS), counts["illegal"], counts["cost"], letters.getvalue(), digest.hexdigest()))

        def made() -> pa.RecordBatch:
            nonlocal rows
            types = (id_type, *[pa.int64()] * 6, pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in small(batches):
            id_type = batch.schema.field(0).type
            for own, step, edit, fault, cost, turn, old, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not step:
                    if counts is not None:
                        close()
                    conv, counts, letters, digest = own, dict.fromkeys((*FAULTS, "illegal", "cost"), 0), io.StringIO(), hashlib.sha256()
                    first = last = before = None
                    distinct, empty = 0, True
                counts["cost"] += cost
                letters.write(edit)
                if fault:
                    counts[fault] += 1
                if edit != INSERT:
                    if before is not None:
                        counts["illegal"] += before + old[:1] not in LEGAL_PAIRS
                    before = old[:1]
                    if turn is not None and turn != last:
                        first = turn if first is None else first
                        last, distinct = turn, distinct + 1
                if edit != DELETE:
                    digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
                    empty = False
            yield made()
        if counts is not None:
            close()
        yield made()

    columns = ["conv_id", "step", "edit", "fault", "cost", "turn", "old_role", "role", "text"]
    return edits.select(*columns).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-2]) + ", audit string, repaired_sha256 string")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """Every ``conv_id`` of ``turns`` with the digests of its repair after ``damage``; zeros where no row is left.

    Nulls, ties, repeats and empty tables are handled as ``damage`` and
    ``repair_conversations`` state. SHA-256 reads a conversation from its start to its end,
    so one task reads it, whatever its size; it holds the open edits and the letters.
    """
    found = repair_digests(repair_conversations(damage(turns)))
    ids = turns.select(F.col("conv_id").alias("_conv")).distinct()
    joined = ids.join(found, ids["_conv"].eqNullSafe(found["conv_id"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return joined.select(F.col("_conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
