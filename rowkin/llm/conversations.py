"""Structure of conversations: faults of turns, and the cheapest edits that make roles alternate.

Role initials must read ``(s?(ua)+)?``, an automaton of four states. A turn is a 4 x 4 matrix over (cost, audit): entry
(i, j) is the cheapest way from state i to state j by editing this turn and inserting turns after it. Sums are minima,
products add costs and join audits; two audits of the same turns that cost the same never begin one with the other, for
the longer would hold more insertions, so minima by (cost, audit) pass through products and the product is associative.
Turns are multiplied in a balanced way within a task, tasks' products in a tree, so a conversation may span any number
of tasks. A second pass replays the audits over the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm.common import forget, small_batches, stored

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
DUE = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
FANIN = 16

Cell = tuple[int, str] | None
Matrix = tuple[Cell, ...]  # by rows


# -- the semiring ---------------------------------------------------------------------------------------------------


def better(a: Cell, b: Cell) -> Cell:
    return b if a is None else a if b is None else min(a, b)


def times(x: Matrix, y: Matrix) -> Matrix:
    out: list[Cell] = []
    for i in range(0, STATES * STATES, STATES):
        for j in range(STATES):
            best: Cell = None
            for k in range(STATES):
                a, b = x[i + k], y[k * STATES + j]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                        best = (cost, a[1] + b[1])
            out.append(best)
    return tuple(out)


def plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(map(better, x, y))


IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(STATES) for j in range(STATES))


def moves(letters: str, edit: Cell) -> Matrix:
    """The matrix of one edit that appends a turn with one of these role initials."""
    to = {(i, j) for (i, c), j in STEP.items() if c in letters}
    return tuple(edit if (i, j) in to else None for i in range(STATES) for j in range(STATES))


@lru_cache(1)
def closure() -> Matrix:
    """Any number of insertions."""
    step, out = moves("ua", (INSERT, "I")), IDENTITY
    while (more := plus(IDENTITY, times(out, step))) != out:
        out = more
    return out


@lru_cache(64)
def turn(initial: str, deleted: bool, truncated: bool) -> Matrix:
    """One turn with the insertions after it; ``deleted``: it has to go."""
    own: Matrix = tuple((DELETE, "D") if c else None for c in IDENTITY)
    if not deleted:
        extra = TRUNCATED if truncated else 0
        own = plus(own, plus(moves(initial, (extra, "K")) if initial in ("s", "u", "a") else own, moves("ua", (REROLE + extra, "R"))))
    return times(own, closure())


def cheapest(product: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation; insertions before its first turn come in here."""
    whole = times(closure(), product)
    return min(cell for j in ENDS if (cell := whole[j]) is not None)


# -- segments of conversations --------------------------------------------------------------------------------------

COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
ELEMENT = {**{c: ("long", pa.int64()) for c in COUNTS}, "first": ("string", pa.string()), "last": ("string", pa.string()), "low": ("long", pa.int64()), "high": ("long", pa.int64())}
CELLS = ("array<struct<cost:bigint,audit:string>>", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))


@dataclass
class Segment:
    """What is known of a run of turns in order; ``parts`` are products of 2 ** k turns, so a run of n turns holds about log2(n)."""

    n: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    parts: list[tuple[int, Matrix]] | None = None

    def push(self, at: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        duplicate = duplicate and not blank
        truncated = truncated and not (blank or duplicate)
        self.append(Segment(1, int(blank), int(duplicate), int(truncated), 0, int(at is not None), initial, initial, at, at, [(0, turn(initial, blank or duplicate, truncated))]))

    def append(self, other: Segment) -> None:
        """The run of both, ``other`` after this."""
        if not other.n:
            return
        if self.n:
            self.illegal += self.last + other.first not in LEGAL
            if self.high is not None and self.high == other.low:
                self.turns -= 1
        for c in COUNTS:
            setattr(self, c, getattr(self, c) + getattr(other, c))
        self.first = other.first if self.first is None else self.first
        self.last = other.last
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.parts = self.parts or []
        for part in other.parts or ():
            self.parts.append(part)
            while len(self.parts) > 1 and self.parts[-2][0] <= self.parts[-1][0]:
                (k, a), (_, b) = self.parts[-2:]
                self.parts[-2:] = [(max(k, self.parts[-1][0]) + 1, times(a, b))]

    def product(self) -> Matrix:
        out = IDENTITY
        for _, part in reversed(self.parts or []):
            out = times(part, out)
        return out

    def row(self) -> tuple:
        return (*(getattr(self, c) for c in ELEMENT), [c and {"cost": c[0], "audit": c[1]} for c in self.product()])

    @classmethod
    def of(cls, row: dict) -> Segment:
        cells = tuple(c and (c["cost"], c["audit"]) for c in row["cells"])
        return cls(**{c: row[c] for c in ELEMENT}, parts=[(max(row["n"], 1).bit_length(), cells)])


# -- turns ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows after faults drawn by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``dropped``, so that its conversation stays known), 1 empties its text, 2 removes its ``.!?``, 3
    repeats it, 4 makes its role user. A null conv_id or turn is one space in that key, a null role or text one space.
    """
    words = [F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(words[3], ".!?", "")).otherwise(words[3])
    rows = conversations.select("conv_id", conversations["turn"].cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(words[2]).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), fault.alias("_fault"))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


def as_turns(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of ``damaged``; a null role or text is one space."""
    words = [F.coalesce(conversations[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", conversations["turn"].cast("long").alias("turn"), *words, F.lit(False).alias("dropped"))


def text_digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def faults(turns: DataFrame) -> tuple[DataFrame, str]:
    """conv_id, turn, role, digest, row, dropped, blank, truncated, duplicate, without texts; and the path of a staged table to delete afterwards.

    A duplicate has the role and text of an earlier row of its conversation: the first row of each (conversation, role,
    text) that comes again is a minimum, combined before it is shuffled, and joined back.
    """
    rest = F.rtrim("text", F.lit(BLANKS))
    own = turns.select("conv_id", "turn", "role", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row"), "dropped", (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    own, path = stored(own, "turns")
    again = own.where("not dropped and not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("_first.row").alias("_first"))
    met = own.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    return met.withColumn("duplicate", F.coalesce(F.col("row") != F.col("_first"), F.lit(False))).drop("_c", "_r", "_d", "_first"), path


def conv_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def segments(flagged: DataFrame) -> DataFrame:
    """A row a conversation and range of (conv_id, turn, role, digest, row): its element, the range, and whether it may go on in another range."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "row")]
    slim = flagged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "dropped", "blank", "duplicate", "truncated")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, own, ids = TaskContext.get().partitionId(), None, None, None
        held: list[tuple] = []
        edge = True

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [ids, pa.int32(), pa.bool_(), *(k for _, k in ELEMENT.values()), CELLS[1]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["conv_id", "seg", "edge", *ELEMENT, "cells"])

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, at, initial, dropped, *flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found is None or conv != own:
                    if found is not None:
                        held.append((own, part, edge, *found.row()))
                        edge = False
                        if len(held) >= 1024:
                            yield batch_of(held)
                            held = []
                    own, found = conv, Segment()
                if not dropped:
                    found.push(at, initial, *flags)
        if found is not None:
            held.append((own, part, True, *found.row()))
            yield batch_of(held)

    element = ", ".join(f"{c} {sql}" for c, (sql, _) in ELEMENT.items())
    return slim.mapInArrow(reduce, f"conv_id {conv_type(flagged)}, seg int, edge boolean, {element}, cells {CELLS[0]}")


def merged(table: pa.Table) -> pa.Table:
    """The segments of a group, at most FANIN, as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    whole = Segment()
    for row in rows:
        whole.append(Segment.of(row))
    values = dict(zip((*ELEMENT, "cells"), whole.row(), strict=True)) | {c: rows[0][c] for c in ("conv_id", "edge")} | {"seg": rows[0]["seg"] // FANIN}
    return pa.Table.from_pylist([values], schema=table.schema.remove(table.schema.get_field_index("_group")))


def elements(turns: DataFrame) -> DataFrame:
    """A row a conversation, its dropped rows only included: conv_id, the fields of a segment, and the cells of its matrix."""
    spark = turns.sparkSession
    flagged, path = faults(turns)
    segs, _ = stored(segments(flagged), "segments")
    forget(spark, path)
    edges = segs.where("edge")  # at most two a range
    while edges.groupBy("conv_id").count().where("count > 1").limit(1).count():
        group = edges.withColumn("_group", F.floor(F.col("seg") / FANIN))
        edges, _ = stored(group.groupBy("conv_id", "_group").applyInArrow(merged, edges.schema), "segments")
    return segs.where("not edge").unionByName(edges).drop("seg", "edge")


# -- repair ---------------------------------------------------------------------------------------------------------


def replayed(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns."""
    state, at = 0, 0

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            role = DUE[state]
            state, at = STEP[state, role[0]], at + 1
            yield role, ""

    for role, text in rows:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit != "D":
            role = DUE[state] if edit == "R" else role
            state = STEP[state, role[:1]]
            yield role, text
    yield from inserted()


def _replay(turns: DataFrame, whole: DataFrame, schema: dict[str, tuple[str, pa.DataType]], emit) -> DataFrame:
    """``emit(conv_id, element, rows)`` yields the result rows of a conversation; ``rows`` streams its turns in order."""
    kind = conv_type(turns)
    texts = turns.where("not dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", text_digest().alias("digest"), "text", *(F.lit(None).cast(sql).alias(c) for c, (sql, _) in ELEMENT.items()), F.lit(None).cast(CELLS[0]).alias("cells"))
    heads = whole.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), *ELEMENT, "cells")
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*keys).drop("turn", "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.DataType] = []

        def lines() -> Iterator[dict]:
            for batch in batches:
                ids[:] = [batch.schema.field("conv_id").type]
                for start in range(0, batch.num_rows, 256):
                    yield from batch.slice(start, 256).to_pylist()

        every = lines()
        head = next(every, None)
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [ids[0], *(k for _, k in schema.values())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *schema])

        while head is not None:
            following: list[dict] = []

            def rows() -> Iterator[tuple[str, str]]:
                for line in every:
                    if not line["kind"]:
                        following.append(line)
                        return
                    yield line["role"], line["text"]

            size = 0
            for row in emit(head, rows()):
                held.append((head["conv_id"], *row))
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(held) >= 1024 or size > 1 << 20:
                    yield out(held)
                    held, size = [], 0
            head = following[0] if following else None
        if held:
            yield out(held)

    return dealt.mapInArrow(walk, f"conv_id {kind}, " + ", ".join(f"{c} {sql}" for c, (sql, _) in schema.items()))


LONG, TEXT = ("long", pa.int64()), ("string", pa.string())


def audits(turns: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text, dropped (see ``damaged``, ``as_turns``). Rows go by turn, nulls first, ties
    by role, then by the SHA-256 of the text; equal rows follow each other. Counts are of first faults. A conversation
    whose rows are all dropped has zeros, an empty audit and the hash of nothing; one of any length is read as a stream,
    except for its audit, a letter a turn. A null conv_id is a conversation. The hash of one conversation is a chain,
    so the texts of one pass one task, in constant memory.
    """

    def emit(head: dict, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        cost, audit = cheapest(tuple(c and (c["cost"], c["audit"]) for c in head["cells"]))
        own, sep = hashlib.sha256(), b""
        for role, text in replayed(audit, rows):
            own.update(sep + role.encode() + b":")
            own.update(text.encode())
            sep = b"\n"
        gaps = head["high"] - head["low"] + 1 - head["turns"] if head["turns"] else 0
        yield (gaps, head["blank"], head["duplicate"], head["truncated"], head["illegal"], cost, audit, own.hexdigest())

    columns = {"gaps": LONG, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "cost": LONG, "audit": TEXT, "repaired_sha256": TEXT}
    with small_batches(turns.sparkSession):
        return _replay(turns, elements(turns), columns, emit)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. Those that end up empty have no rows."""

    def emit(head: dict, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        _, audit = cheapest(tuple(c and (c["cost"], c["audit"]) for c in head["cells"]))
        for place, (role, text) in enumerate(replayed(audit, rows)):
            yield place, role, text

    return _replay(turns, elements(turns), {"place": LONG, "role": TEXT, "text": TEXT}, emit)
