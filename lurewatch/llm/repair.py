"""Repair of the structure of conversations by iterative-deepening A*.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Its rows may be
kept, given another role, deleted, and empty turns may be inserted; the cheapest sequence of edits
is looked for, among equally cheap ones that whose initials come first in ASCII.

The search goes depth first in the order of the initials D, I, K, R, within a bound of cost that
grows by the least amount any cut-off path was over it.  A lower bound of what the remaining rows
cost cuts paths early: rows that must go, rows that end in mid-sentence, rows of other roles, and
disjoint pairs of neighbours with the same role.  A table of failed states remembers with how much
left a (row, state) came to nothing.  The first path that is accepted is the answer.

Conversations of more than ``SEGMENT`` rows are searched segment by segment: what the rest costs
after each state at a segment's end is exact, so the joined answers are the answer of the whole.
Every insertion belongs to the row before which it is made, and of two different paths neither is
the beginning of the other, so the order of initials is decided within a segment as well.

Rows meet by conversation.  Only one byte of each row is held for the search; texts stream through
a task for the digest over them, which is sequential by its definition, so one conversation is one
task's work there.  The answer to a skeleton is remembered by a worker.

Null roles and texts count as one space.  Null turns come first; equal turns are ordered by role
and text, repeated rows are rows of their own.  Rows without a conversation id form one
conversation without an id.  Other columns are not looked at.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import arrow_schema
from lurewatch.session import stage

SEGMENT = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
# States: nothing written, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPTING = (True, False, False, True)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# What is missing at the end after each state.
CLOSING = (0, 2 * INSERT, INSERT, 0)
# A row as one byte: the initial of its role (U, A, S or another) and its fault.
OTHER, PLAIN, CUT, GONE = 0, 0, 4, 8
Costs = tuple[int, int, int, int]


def kept_state(code: int, state: int) -> int | None:
    """The state after a row that is kept, if it may be."""
    initial = code & 3
    if initial == USER:
        return USER if state != USER else None
    if initial == ASSISTANT:
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == SYSTEM and state == START else None


def lower_bounds(codes: bytes, rest: int) -> list[int]:
    """What the rows from each place on cost at least, and ``rest`` after them."""
    own, out = rest, [rest]
    # Most disjoint pairs from the next row on that need not go, and from the one behind it on.
    pairs, pairs_behind, following = 0, 0, OTHER
    for code in reversed(codes):
        if code & GONE:
            own += DELETE
        else:
            initial = code & 3
            own += (TRUNCATED if code & CUT else 0) + (REROLE if initial == OTHER else 0)
            found = pairs
            if initial in (USER, ASSISTANT) and initial == following:
                found = max(pairs, 1 + pairs_behind)  # one of the two changes, or a turn is put between
            pairs, pairs_behind, following = found, pairs, initial
        out.append(own + INSERT * pairs)
    return out[::-1]


@lru_cache(maxsize=200_000)
def deepen(codes: bytes, entry: int, after: Costs | None) -> tuple[str, int, int]:
    """Edits of one segment, the state behind it and their cost.

    ``after`` is what the rest costs after each state; ``None`` stands for the end.
    """
    n = len(codes)
    least = lower_bounds(codes, min(after) if after else 0)
    failed: dict[int, int] = {}
    path: list[str] = []
    beyond = 0

    def visit(i: int, state: int, left: int) -> int | None:
        """The state at the end of the first path that costs at most ``left``."""
        nonlocal beyond
        if least[i] > left:
            beyond = min(beyond, least[i] - left)
            return None
        if i == n and after is not None:
            if after[state] <= left:
                return state
            beyond = min(beyond, after[state] - left)
            return None
        if i == n and ACCEPTING[state]:
            return state
        key = 4 * i + state
        if failed.get(key, -1) >= left:
            return None
        for edit, to_row, to_state, cost in moves(i, state):
            path.append(edit)
            end = visit(to_row, to_state, left - cost)
            if end is not None:
                return end
            path.pop()
        failed[key] = left
        return None

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i == n:
            yield "I", i, NEXT[state], INSERT
            return
        code = codes[i]
        cut = TRUNCATED if code & CUT else 0
        yield "D", i + 1, state, DELETE
        yield "I", i, NEXT[state], INSERT
        if not code & GONE:
            kept = kept_state(code, state)
            if kept is not None:
                yield "K", i + 1, kept, KEEP + cut
            yield "R", i + 1, NEXT[state], REROLE + cut

    bound = least[0]
    while True:
        beyond = 1 << 60
        end = visit(0, entry, bound)
        if end is not None:
            edits = "".join(path)
            return edits, end, _cost(edits, codes)
        bound += beyond


def _cost(edits: str, codes: bytes) -> int:
    total, row = 0, 0
    for edit in edits:
        if edit == "I":
            total += INSERT
            continue
        total += {"D": DELETE, "K": KEEP, "R": REROLE}[edit]
        total += TRUNCATED if edit != "D" and codes[row] & CUT else 0
        row += 1
    return total


def costs_after(codes: bytes) -> list[Costs]:
    """What the rest costs after each state at the end of every segment but the last."""
    rest, out = CLOSING, []
    for i in range(len(codes) - 1, SEGMENT - 1, -1):
        code = codes[i]
        cut = TRUNCATED if code & CUT else 0
        without = []
        for state in range(4):
            options = [DELETE + rest[state]]
            if not code & GONE:
                kept = kept_state(code, state)
                options += [REROLE + cut + rest[NEXT[state]]] + ([KEEP + cut + rest[kept]] if kept is not None else [])
            without.append(min(options))
        for _ in range(2):  # one or two turns may be inserted before the row
            without = [min(without[s], INSERT + without[NEXT[s]]) for s in range(4)]
        rest = tuple(without)
        if i % SEGMENT == 0:  # only differences matter there, and small numbers come up again
            out.append(tuple(cost - min(rest) for cost in rest))
    return out[::-1]


def repair(codes: bytes) -> Iterator[tuple[int, str, int]]:
    """First row, edits and their cost of each segment."""
    after, state = [*costs_after(codes), None], START
    for number, first in enumerate(range(0, len(codes), SEGMENT)):
        edits, state, cost = deepen(codes[first : first + SEGMENT], state, after[number])
        yield first, edits, cost


class Rewriter:
    """Rows of one conversation after their edits, as a digest."""

    def __init__(self):
        self.state, self.digest, self.empty = START, hashlib.sha256(), True
        self.edits: list[str] = []  # of all segments so far
        self.ahead: list[str] = []  # still to be applied, the next one last
        self.cost = 0

    def plan(self, edits: str, cost: int) -> None:
        self.edits.append(edits)
        self.cost += cost
        self.ahead = [*edits[::-1], *self.ahead]

    def _write(self, state: int, role: str, text: str) -> None:
        self.state = state
        line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.empty = False

    def _insert(self) -> None:
        while self.ahead and self.ahead[-1] == "I":
            self.ahead.pop()
            self._write(NEXT[self.state], ROLE[NEXT[self.state]], "")

    def row(self, code: int, role: str, text: str) -> None:
        self._insert()
        edit = self.ahead.pop()
        if edit == "K":
            self._write(kept_state(code, self.state), role, text)
        elif edit == "R":
            self._write(NEXT[self.state], ROLE[NEXT[self.state]], text)

    def result(self) -> tuple[int, str, str]:
        self._insert()
        return self.cost, "".join(self.edits), self.digest.hexdigest()


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, role, text, fault, illegal, code`` of every row, in the order of turns."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    initial = F.substr("role", F.lit(1), F.lit(1))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    pair = F.concat(F.lag(initial).over(place), initial)
    rows = rows.withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    rows = rows.withColumn("pos", F.row_number().over(place).cast("long") - 1)
    # The same exchange serves: rows of a conversation are together already.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    )
    rows = rows.withColumn("seen", seen).withColumn("fault", fault).drop("seen")
    kind = F.when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "s", SYSTEM).otherwise(OTHER)
    flaw = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(PLAIN)
    return rows.withColumn("code", (kind + flaw).cast("int"))


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def edits(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, edits, cost``: the edits of each segment of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, codes, out = None, bytearray(), []

        def answer():
            for first, found, cost in repair(bytes(codes)):
                out.append((current, first, found, cost))
                if len(out) == 10_000:
                    yield batch_of()
                    out.clear()

        def batch_of():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, code in zip(batch.column("conv_id").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if codes and conv != current:
                    yield from answer()
                    codes.clear()
                current = conv
                codes.append(code)
        yield from answer()
        if out:
            yield batch_of()

    shape = rows.select("conv_id", "pos", F.lit("").alias("edits"), F.lit(0).cast("long").alias("cost"))
    schema = arrow_schema(shape)
    return _by_conversation(rows.select("conv_id", "pos", "code"), "pos").mapInArrow(run, shape.schema)


def rewritten(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, repaired_sha256`` of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, writer = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                conv, code, role, text, found, cost = row
                if writer is None or conv != current:
                    if writer is not None:
                        out.append((current, *writer.result()))
                    current, writer = conv, Rewriter()
                if found is not None:
                    writer.plan(found, cost)
                else:
                    writer.row(code, role, text)
            if out:
                yield batch_of(out)
        if writer is not None:
            yield batch_of([(current, *writer.result())])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    columns = ["conv_id", "code", "role", "text", "edits", "cost"]
    shape = plan.select("conv_id", "cost", F.lit("").alias("audit"), F.lit("").alias("repaired_sha256"))
    schema = arrow_schema(shape)
    both = rows.select("conv_id", "pos", "code", "role", "text").unionByName(plan, allowMissingColumns=True)
    # The edits of a segment come before its first row.
    sent = _by_conversation(both, "pos", F.asc_nulls_first("code")).select(columns)
    return sent.mapInArrow(run, shape.schema)


def repaired(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and the initials of its cheapest repair and a
    digest of the repaired rows.  ``conversations`` are the ids to report; those without rows have
    no faults and nothing to repair."""
    rows = stage(faults(turns), "repair-rows")

    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = rows.groupBy("conv_id").agg(
        span.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("illegal")).alias("illegal"),
    )
    found = rewritten(rows, stage(edits(rows), "repair-edits"))
    ids = (rows if conversations is None else conversations).select("conv_id").distinct()
    out = ids
    for table in (stats, found):
        own = table.withColumnRenamed("conv_id", "_conv")
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows that have met one of five kinds of damage, or none, by a hash of their place."""

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    role, text = text_of("role"), text_of("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")
    ).drop("_copy")


def repaired_after_damage(turns: DataFrame) -> DataFrame:
    """Damages all conversations and repairs them: one row for every original id."""
    return repaired(damaged(turns), turns)
