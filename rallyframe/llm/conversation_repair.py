"""Conversation structure repair: the cheapest edits that give each conversation its form, by a secondary-sorted stream.

A repaired conversation is empty, or is at most one system turn and then user and assistant in turn, ending with the
assistant. Rows are dealt by conversation and sorted by turn; a task walks them in that order and carries the state of a
shortest-path search from batch to batch: for each of four places in the form the least cost so far and how the edits that
lead there rank among one another. Relative costs are bounded, so these states are few; a state and a row's kind give the
next state by a look-up, and what a row leaves behind is the number of that step: four bytes, kept in a scratch file of the
task when a conversation gets long. From the best end the numbers lead back to the edits.

Each conversation's rows come twice, first without their texts for the search, then with them for the edits: the sort puts
one before the other, so texts are shuffled once and none is held. A conversation's rows are one task's work, as the search goes
through them in order; its memory is a byte a row (the edits, which are a value of the result).
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import bounded_batches

SPACES = " \t\n\x0b\f\r"
#: Costs of the edits; a turn that is cut short costs CUT_SHORT more unless deleted.
DELETE, RENAME, INSERT, CUT_SHORT = 3, 2, 2, 1
#: Kinds of rows: initial of the role, and fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Places in the form: nothing yet, after the system turn, after a user's, after an assistant's.
AT_START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
EXPECTED = {AT_START: USER, AFTER_SYSTEM: USER, AFTER_USER: ASSISTANT, AFTER_ASSISTANT: USER}
NEXT = {USER: AFTER_USER, ASSISTANT: AFTER_ASSISTANT, SYSTEM: AFTER_SYSTEM}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What may be done about a row: up to two insertions, then the edit of the row itself.
WORDS = [before + edit for before in ("", "I", "II") for edit in "DKR"]
#: A place that is dearer than the best by more than this leads to no best end: from any place any other is reached for less.
HOPELESS = 6
#: So many steps of a conversation are held in memory.
HELD = 1 << 20


def inserted(place: int, n: int) -> int:
    for _ in range(n):
        place = NEXT[EXPECTED[place]]
    return place


class Search:
    """All steps of the search met so far. A state is, by place, (cost above the least, rank) or None."""

    def __init__(self) -> None:
        self.states: list[tuple] = [((0, 0), None, None, None)]
        self.number = {self.states[0]: 0}
        self.known: dict[tuple[int, int, int], int] = {}
        #: By step: the next state, the rise of the least cost, and by place where it came from and by which word.
        self.steps: list[tuple[int, int, dict[int, tuple[int, int]]]] = []

    def step(self, state: int, initial: int, fault: int) -> int:
        key = (state, initial, fault)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append(self._worked_out(*key))
        return self.known[key]

    def _worked_out(self, state: int, initial: int, fault: int) -> tuple[int, int, dict[int, tuple[int, int]]]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, reached in enumerate(self.states[state]):
            if reached is None:
                continue
            for word in WORDS:
                place, edit = inserted(start, len(word) - 1), word[-1]
                cost = reached[0] + INSERT * (len(word) - 1)
                if edit == "D":
                    cost += DELETE
                elif fault in (BLANK, DUPLICATE):
                    continue
                else:
                    role = initial if edit == "K" else EXPECTED[place]
                    if role != EXPECTED[place] and (role, place) != (SYSTEM, AT_START):
                        continue
                    place = NEXT[role]
                    cost += RENAME * (edit == "R") + CUT_SHORT * (fault == TRUNCATED)
                # Words that take the same rows are never the beginning of one another, so ranks order all that follows.
                best[place] = min(best.get(place, (1 << 60, 0, "", 0)), (cost, reached[1], word, start))
        least = min(b[0] for b in best.values())
        open_ = {place: b for place, b in best.items() if b[0] - least <= HOPELESS}
        ranks = {place: k for k, place in enumerate(sorted(open_, key=lambda p: open_[p][1:3]))}
        after = tuple((open_[p][0] - least, ranks[p]) if p in open_ else None for p in range(4))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], least, {p: (b[3], WORDS.index(b[2])) for p, b in open_.items()}

    def end(self, state: int) -> tuple[int, int, int]:
        """(cost above the least, insertions, place before them) of the best end."""
        found = []
        for place, reached in enumerate(self.states[state]):
            for n in range(3):
                if reached is not None and inserted(place, n) in (AT_START, AFTER_ASSISTANT) and (n == 0 or place != AFTER_ASSISTANT):
                    found.append((reached[0] + INSERT * n, reached[1], n, place))
        cost, _, n, place = min(found)
        return cost, n, place


SEARCH = Search()


class Steps:
    """Numbers of steps, appended and read from the last to the first; long ones lie in a file without a name."""

    def __init__(self, held: int = HELD):
        self.held, self.open, self.file, self.n = held, array("I"), None, 0

    def append(self, step: int) -> None:
        self.open.append(step)
        self.n += 1
        if len(self.open) == self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.open.tofile(self.file)
            self.open = array("I")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.open)
        for block in range(self.n // self.held - 1, -1, -1):
            self.file.seek(block * self.held * self.open.itemsize)
            part = array("I")
            part.fromfile(self.file, self.held)
            yield from reversed(part)


class Conversation:
    """One conversation on its way through a task."""

    def __init__(self, key: Any):
        self.key, self.state, self.cost, self.steps = key, 0, 0, Steps()
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.before: int | None = None
        self.edits: bytearray | None = None
        self.closing = self.at = self.made = 0
        self.place = AT_START
        self.hash = hashlib.sha256()

    def look(self, turn: int | None, initial: int, fault: int) -> None:
        """A row of the search."""
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        step = SEARCH.step(self.state, initial, fault)
        self.state, rise, _ = SEARCH.steps[step]
        self.cost += rise
        self.steps.append(step)

    def decide(self) -> None:
        """Back from the best end to the edit of each row."""
        if self.edits is not None:
            return
        rise, self.closing, place = SEARCH.end(self.state)
        self.cost += rise
        self.edits = bytearray(self.steps.n)
        for k, step in enumerate(self.steps.backwards(), 1):
            place, self.edits[-k] = SEARCH.steps[step][2][place]
        self.steps = Steps()

    def _emit(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        line = f"{role}:{text}".encode()
        self.hash.update(b"\n" + line if self.made else line)
        self.made += 1
        return (self.made - 1, edit, turn, role, text)

    def _insert(self, n: int) -> Iterator[tuple]:
        for _ in range(n):
            role = EXPECTED[self.place]
            self.place = NEXT[role]
            yield self._emit("I", None, NAMES[role], "")

    def edit(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """Repaired turns (place, edit, turn, role, text) before and for the next row."""
        self.decide()
        word = WORDS[self.edits[self.at]]
        self.at += 1
        yield from self._insert(len(word) - 1)
        if word[-1] != "D":
            expected = EXPECTED[self.place]
            name = NAMES[expected] if word[-1] == "R" else role
            self.place = AFTER_SYSTEM if word[-1] == "K" and role[:1] == "s" else NEXT[expected]
            yield self._emit(word[-1], turn, name, text)

    def close(self) -> Iterator[tuple]:
        """Repaired turns after the last row."""
        self.decide()
        yield from self._insert(self.closing)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        audit = "".join(map(WORDS.__getitem__, self.edits)) + "I" * self.closing
        return (min(gaps, (1 << 63) - 1), *self.faults[1:], self.illegal, self.cost, audit, self.hash.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, turn {turn}, role string, text string"


def faults_of(turns: DataFrame) -> tuple[Column, Column]:
    """Initial and fault of a row (without duplicates), as numbers."""
    rest = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(rest == "", BLANK).when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return initial.cast("byte"), fault.cast("byte")


def sorted_rows(turns: DataFrame) -> DataFrame:
    """Each conversation's rows, first (part 0) with initial and fault, then (part 1) with role and text, in order of turn; in
    part -1 one that stands for the conversation itself."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present")
    initial, fault = faults_of(rows)
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    here = rows.where("present").withColumn("tie", same)
    again = F.row_number().over(Window.partitionBy("conv_id", "tie").orderBy(F.col("turn").asc_nulls_first())) > 1
    none = lambda kind: F.lit(None).cast(kind)
    searched = here.select("conv_id", "turn", "tie", initial.alias("initial"), fault.alias("fault"))
    searched = searched.select("conv_id", F.lit(0).cast("byte").alias("part"), "turn", "tie", "initial", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")).cast("byte").alias("fault"), none("string").alias("role"), none("string").alias("text"))
    texts = here.select("conv_id", F.lit(1).cast("byte").alias("part"), "turn", "tie", none("byte").alias("initial"), none("byte").alias("fault"), "role", "text")
    kind = dict(rows.dtypes)["turn"]
    ids = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("byte").alias("part"), none(kind).alias("turn"), none("binary").alias("tie"), none("byte").alias("initial"), none("byte").alias("fault"), none("string").alias("role"), none("string").alias("text"))
    together = ids.unionByName(searched).unionByName(texts).repartition("conv_id")
    return together.sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "tie").drop("tie")


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[tuple], bool]]:
    """(conversation, the repaired turns that a row gave, whether it is over)."""
    now: Conversation | None = None
    for batch in batches:
        for key, part, turn, initial, fault, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "initial", "fault", "role", "text")), strict=True):
            if part == -1:
                if now is not None:
                    yield now, list(now.close()), True
                now = Conversation(key)
            elif part == 0:
                now.look(turn, initial, fault)
            else:
                yield now, list(now.edit(turn, role, text)), False
    if now is not None:
        yield now, list(now.close()), True


def _stream(turns: DataFrame, present: str | None, schema: str, make) -> DataFrame:
    kinds = dict(turns.dtypes)
    turns = turns.select("conv_id", "turn", "role", "text", (F.col(present) if present else F.lit(True)).alias("present"))
    full = f"conv_id {kinds['conv_id']}, {schema.format(turn=kinds['turn'])}"
    names, fields = zip(*((f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(full)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*held, strict=True), fields, strict=True)], names)

        for conversation, repaired, over in walk(batches):
            for row in make(conversation, repaired, over):
                held.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, str))
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return bounded_batches(sorted_rows(turns)).mapInArrow(run, full)


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """One row for each conversation of `turns` (conv_id, turn, role, text; further columns are not looked at): conv_id and REPORT.

    `present`: a boolean column, if there is one; rows where it is not true only stand for their conversation. Null role or text counts as one
    space; a null turn comes before all others and in no gap; rows without conv_id are one conversation. Turns of one number
    are ordered by a digest of role and text, so reruns agree; of equal rows the first is none's duplicate. A role is known by
    its first letter; one without letters fits nowhere. Texts of any length; an empty table gives no rows; a conversation
    without rows has zeros, an empty audit and the digest of an empty text. Gaps beyond the longs stop at their end."""
    return _stream(turns, present, REPORT, lambda c, _, over: [(c.key, *c.report())] if over else [])


def repaired_turns(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K kept, R role changed, I inserted), turn (null where
    inserted), role, text. Cases as in `repair`; a conversation that is deleted altogether gives no rows."""
    return _stream(turns, present, TURNS, lambda c, repaired, _: [(c.key, *row) for row in repaired])


def damage(turns: DataFrame) -> DataFrame:
    """Faults by crc32(`conv_id:turn`) % 20: 0 drops a row (`present` is false), 1 empties its text, 2 takes out `.!?`, 3 repeats the
    row, 4 makes it the user's. Nulls count as one space; conv_id and turn stay as they are."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20
    text = shown("text")
    damaged = turns.select("conv_id", "turn", F.when(case == 4, "user").otherwise(shown("role")).alias("role"), F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (case != 0).alias("present"), F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return damaged.withColumn("copy", F.explode("copies")).drop("copies", "copy")
