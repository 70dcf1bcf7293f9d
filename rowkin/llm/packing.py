"""Best-fit packing: documents into as few fixed-length token sequences as possible, by bin completion.

How many pieces there are of each length decides a packing, and there are at most ``size`` lengths. So Spark counts
lengths, the driver completes bins over that bounded table (a *pattern* is a multiset of lengths, used as often as the
counts allow), and Spark gives every piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm.common import give_back, stored
from rowkin.llm.tokens import END_ID, default_vocabulary, encoded

SIZE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only if they exceed ``size``; the first piece takes what is over."""
    end = int(END_ID).to_bytes(4, "little")

    def cut(batches):
        give_back()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), vocabulary, added_tokens), strict=True):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % size + 1
                a = 0
                for k, b in enumerate(range(first, n + 1, size)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class Plan(NamedTuple):
    """Patterns (length: how many) and how often each is used; sequences, a lower bound on them, and whether none can do with fewer."""

    patterns: list[tuple[dict[int, int], int]]
    sequences: int
    lower: int
    proven: bool


def lower_bound(histogram: dict[int, int], size: int = SIZE) -> int:
    """Sequences that any packing needs (the bound L2 of Martello and Toth): pieces above a half take one each, and others only fill what these leave."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    counts = [histogram[int(x)] for x in lengths]
    best = -(-sum(int(x) * n for x, n in zip(lengths, counts, strict=True)) // size)
    for k in sorted({0, *(int(x) for x in lengths if 2 * x <= size)}):
        big = middle = room = small = 0
        for x, n in zip(lengths.tolist(), counts, strict=True):
            if x > size - k:
                big += n
            elif 2 * x > size:
                middle, room = middle + n, room + n * (size - x)
            elif x >= k:
                small += n * x
        best = max(best, big + middle + max(0, -(-(small - room) // size)))
    return best


def best_fit(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts of lengths: sequences that are alike are handled together, so the work follows the lengths, not the pieces."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room left
    for x in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        n = histogram[x]
        while n:
            room = min((r for r in open_ if r >= x), default=None)
            pattern, times = open_[room].pop() if room is not None else ({}, -(-n // (size // x)))
            if room is not None and not open_[room]:
                del open_[room]
            room = size if room is None else room
            each = room // x
            full = min(times, n // each)
            for m, k in ((full, each), (min(1, times - full), n - full * each if full < times else 0), (times - full - 1, 0)):
                if m > 0:
                    open_.setdefault(room - k * x, []).append((pattern | {x: k} if k else pattern, m))
                    n -= m * k
    return [p for group in open_.values() for p in group]


class _Left:
    """Counts of the lengths that are left, and their ascending array."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = np.array(sorted(self.counts), dtype=np.int64)

    def take(self, pattern: dict[int, int], times: int) -> None:
        for x, m in pattern.items():
            self.counts[x] = self.counts.get(x, 0) - times * m
            if not self.counts[x]:
                del self.counts[x]
        if len(self.counts) != len(self.lengths) or times < 0:
            self.lengths = np.array(sorted(self.counts), dtype=np.int64)


def fillings(room: int, lengths: np.ndarray, counts: dict[int, int], waste: list[int], nodes: int | None) -> Iterator[tuple[int, list[int]]]:
    """Fillings of ``room`` from the lengths that are left, largest first, with a waste below ``waste[0]`` (which the caller may lower), until ``nodes`` steps are spent."""
    taken: list[int] = []
    used: dict[int, int] = {}
    left = room
    reach = np.cumsum([int(x) * counts[int(x)] for x in lengths]) if len(lengths) else np.zeros(0, dtype=np.int64)

    def fitting(most: int) -> int:
        """Index of the largest length up to ``most`` that fits and of which one is left; -1 if none, or if all from there on cannot fill enough."""
        i = int(np.searchsorted(lengths, min(left, most), "right")) - 1
        while i >= 0 and counts[int(lengths[i])] <= used.get(int(lengths[i]), 0):
            i -= 1
        return i if i >= 0 and left - min(left, int(reach[i])) < waste[0] else -1

    i = fitting(room)
    while i >= 0 or taken:
        if nodes is not None:
            nodes -= 1
            if nodes < 0:
                return
        if i >= 0:
            x = int(lengths[i])
            used[x] = used.get(x, 0) + 1
            taken.append(x)
            left -= x
            i = fitting(x)
            if i < 0 and left < waste[0]:
                yield left, list(taken)
        else:
            x = taken.pop()
            used[x] -= 1
            left += x
            i = fitting(x - 1)


def dominated(waste: int, items: list[int], lengths: np.ndarray, counts: dict[int, int]) -> bool:
    """Whether a length that is left fits in besides, or in place of one or two of the items that are together no longer: another filling then is at least as good."""
    own: dict[int, int] = {}
    for x in items:
        own[x] = own.get(x, 0) + 1
    distinct = sorted(own)
    swaps = [0, *distinct, *(x + y for k, x in enumerate(distinct) for y in distinct[k:] if x != y or own[x] > 1)]
    for y in swaps:
        low, high = np.searchsorted(lengths, [y + (y in own or not y), y + waste + 1])
        for x in lengths[low:high].tolist():
            if counts[x] > own.get(x, 0):
                return True
    return False


def plan(histogram: dict[int, int], size: int = SIZE, nodes: int | None = 4000, turns: int | None = 200) -> Plan:
    """Bin completion by branch and bound.

    The sequence of the largest length left is completed by an undominated filling, the least waste first, and used as
    often as the counts allow; then the next one, until nothing is left. The best-fit packing is the first incumbent.
    A branch ends when its sequences and what the rest fills at least reach the incumbent's number, the search when the
    incumbent meets the lower bound. ``nodes`` bounds the steps for one filling, ``turns`` how often the search turns back;
    beyond them the incumbent stands, and ``proven`` says whether it is known to be best. None: no bound, which is exact
    and takes exponential time.
    """
    lower = lower_bound(histogram, size)
    best = best_fit(histogram, size)
    least = sum(t for _, t in best)
    left = _Left(histogram)
    total = sum(x * n for x, n in left.counts.items())
    used, done = 0, False

    def children() -> Iterator[tuple[dict[int, int], int]]:
        top = int(left.lengths[-1])
        counts = left.counts | {top: left.counts[top] - 1}
        lengths, room = left.lengths, size - top

        def pattern(items: list[int]) -> tuple[dict[int, int], int]:
            out: dict[int, int] = {}
            for x in (top, *items):
                out[x] = out.get(x, 0) + 1
            return out, min(left.counts[x] // m for x, m in out.items())

        first: list[int] = []
        waste = [room + 1]
        for now, items in fillings(room, lengths, counts, waste, nodes):
            first, waste[0] = items, now
            if not now:
                break
        head, times = pattern(first)
        yield head, times
        for t in range(times - 1, 0, -1):
            yield head, t
        for now, items in fillings(room, lengths, counts, [room + 1], nodes):
            if items != first and not dominated(now, items, lengths, counts):
                other, times = pattern(items)
                for t in range(times, 0, -1):
                    yield other, t

    trail: list[tuple[dict[int, int], int]] = []
    stack = [children()] if left.counts and least > lower else []
    while stack and not done:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if trail:
                pattern, times = trail.pop()
                left.take(pattern, -times)
                used, total = used - times, total + times * sum(x * m for x, m in pattern.items())
                if turns is not None:
                    turns -= 1
                    done = turns < 0
            continue
        pattern, times = step
        left.take(pattern, times)
        trail.append(step)
        used, total = used + times, total - times * sum(x * m for x, m in pattern.items())
        if not left.counts:
            if used < least:
                best, least = list(trail), used
                done = least <= lower
            stack.append(iter(()))
        elif used + -(-total // size) >= least:
            stack.append(iter(()))
        else:
            stack.append(children())
    return Plan(best, least, lower, least <= lower or (not stack and nodes is None and turns is None))


def ranked(pieces: DataFrame, chunks: int) -> DataFrame:
    """Adds ``rank``, the number of pieces of the same length before it; a common length is ranked in hashed chunks."""
    own = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    within = own.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = own.groupBy("length", "_chunk").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(before.select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_chunk"]).withColumn("rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_chunk", "_rank", "_before")


def place(pieces: DataFrame, size: int = SIZE, nodes: int | None = 4000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``size``."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    chunks = max(512, max(histogram.values(), default=0) // 65536)  # so that a chunk of a length stays small
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, times in plan(histogram, size, nodes).patterns:
        offset = 0
        for x, m in sorted(pattern.items(), reverse=True):
            rows.setdefault(x, []).append((used[x], sequence, m, offset))
            used[x] += times * m
            offset += x * m
        sequence += times
    slots = {x: np.array(v, dtype=np.int64) for x, v in rows.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # bounded by the patterns, which the lengths bound

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            seq, off = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    table = shared.value[int(length[group[0]])]
                    at = table[np.searchsorted(table[:, 0], rank[group], "right") - 1]
                    k = rank[group] - at[:, 0]
                    seq[group] = at[:, 1] + k // at[:, 2]
                    off[group] = at[:, 3] + (k % at[:, 2]) * length[group]
            yield frame.drop(columns=["rank"]).assign(sequence_id=seq, offset=off)

    order = [f for f in pieces.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked(pieces, chunks).select(*order, "rank").mapInPandas(put, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """Packs every document: one row a piece with its sequence and its place there.

    A null or empty text is the end id alone. Equal rows are packed each on its own; a null id stays null. An empty
    table gives no rows. Only ``id_col`` and ``text_col`` are read, other columns do not matter.
    """
    pieces, _ = stored(token_pieces(docs, vocabulary or default_vocabulary(), size, id_col, text_col, added_tokens), "pieces")
    return place(pieces, size)
