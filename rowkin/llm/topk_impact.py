"""Exact top-k search over integer impacts, score at a time: segments of falling impact, stop on proof, rescore the rest.

A component x of a vector is the impact floor(256 x) of its dimension. A block of candidates is indexed in segments:
segment l holds, for each dimension, the postings (candidate, impact) whose magnitude is in [2**l, 2**(l + 1)). All
queries of a tile take the segments from the largest magnitudes down. What a candidate has not shown yet adds at most the
query's norm times the norm of its remaining impacts (Cauchy and Schwarz), and at most the query's sum of magnitudes
times the largest impact that may remain. So each candidate has bounds on its score; those whose upper bound is below the
k-th best lower bound are proved out, and the search ends when few are left, or no segment. These are rescored exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.blocks import best_of, search_tiles, usable

K = 5
EVERY = 50
#: Components of a block of queries, and of a block of candidates.
QUERY_CELLS, CANDIDATE_CELLS = 1 << 18, 1 << 20
#: Queries whose bounds are held at once.
STRIP = 128
#: A strip's search ends when a query has at most this many possible members on average (or k); they are rescored exactly.
FEW = 64
#: Candidates of which one lower bound is kept to find the k-th best.
GROUP = 32
#: Bounds are computed once the norms of what is open are on average below this share of the candidates' norms.
LOOK = 0.5
LONG = 1 << 63


def impacts(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles that hold it exactly."""
    return np.floor(256 * x) if np.abs(x).max(initial=0.0) < 2.0**1000 else np.where(np.abs(x) < 2.0**1000, np.floor(256 * np.where(np.abs(x) < 2.0**1000, x, 0)), x)


def exact(x: float) -> int:
    """floor(256 x) as a Python integer, however large."""
    return math.floor(256 * x) if abs(x) < 2.0**1000 else 256 * int(x)


class ImpactIndex:
    """Segments of a block (candidates x dimensions, doubles) by falling magnitude, with the norms of what they leave."""

    def __init__(self, block: np.ndarray, exact_type: type):
        self.segments: list[tuple[np.ndarray, np.ndarray, float]] = []  # postings by dimension, remaining norms, largest remaining magnitude
        level = np.frexp(block)[1]
        left = np.square(block).sum(axis=1)
        self.norm = float(np.sqrt(left).mean()) if len(block) else 0.0
        for now in sorted(np.unique(level[block != 0]).tolist(), reverse=True):
            own = np.where((level == now) & (block != 0), block, 0.0)
            left = np.maximum(0.0, left - np.square(own).sum(axis=1))
            self.segments.append((np.ascontiguousarray(own.T.astype(exact_type)), np.sqrt(left), 2.0 ** (now - 1)))
        if self.segments:  # rounding must not leave a rest where there is none
            postings, norms, _ = self.segments[-1]
            self.segments[-1] = (postings, np.zeros_like(norms), 0.0)


def possible_members(q: np.ndarray, index: ImpactIndex, n: int, same: np.ndarray, k: int, error: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of all that may be among the ``k`` best of a query (a superset, never without one).

    ``same``: pairs that must not meet. ``error``: what rounding may take from or add to a score.
    """
    open_ = ~same
    if n <= max(FEW, k) or not index.segments:
        return np.nonzero(open_)
    score = np.zeros((len(q), n), dtype=index.segments[0][0].dtype)
    queries = q.astype(score.dtype)
    wider = 1 + 1e-5  # slack may not come out too small by rounding
    norm, total = (wider * np.linalg.norm(q, axis=1)).astype(score.dtype), wider * np.abs(q).sum(axis=1)
    kth = np.full(len(q), -np.inf, dtype=score.dtype)
    for nth, (postings, rest, largest) in enumerate(index.segments):
        score += queries @ postings
        over = nth + 1 == len(index.segments)
        if not over and rest.mean() > LOOK * index.norm:
            continue  # too much is open to prove anything
        slack = norm[:, None] * rest.astype(score.dtype)[None, :]
        if (total * largest < norm * rest.max()).any():
            np.minimum(slack, (total * largest).astype(score.dtype)[:, None], out=slack)
        if error is not None:
            slack += error
        low = score - slack
        low[same] = -np.inf
        pad = -n % GROUP
        grouped = (np.pad(low, ((0, 0), (0, pad)), constant_values=-np.inf) if pad else low).reshape(len(q), -1, GROUP).max(axis=2)
        if grouped.shape[1] < 4 * k:
            grouped = low
        if grouped.shape[1] > k:
            kth = np.maximum(kth, np.partition(grouped, grouped.shape[1] - k, axis=1)[:, grouped.shape[1] - k])
        stay = np.add(score, slack, out=slack) >= kth[:, None]
        stay &= open_
        if over or np.count_nonzero(stay) <= max(FEW, 2 * k) * len(q):
            return np.nonzero(stay)
    raise AssertionError("unreachable")


def best_in_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` candidates of highest integer score for each query of a tile."""
    queries, block = impacts(q), impacts(c)
    top = float(np.abs(queries).max(initial=0.0)), float(np.abs(block).max(initial=0.0))
    scale = tuple(2.0 ** -np.frexp(t)[1] if t > 2.0**400 else 1.0 for t in top)  # else squares would overflow
    most = top[0] * scale[0] * top[1] * scale[1] * q.shape[1]
    small = scale == (1.0, 1.0) and most < 2.0**24  # sums are exact in single precision, or in double
    plain = scale == (1.0, 1.0) and most < 2.0**53
    index = ImpactIndex(block * scale[1], np.float32 if small else np.float64)
    norms = np.linalg.norm(block * scale[1], axis=1)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), STRIP):
        own = queries[at : at + STRIP] * scale[0]
        error = None if plain else 1e-12 * q.shape[1] * np.linalg.norm(own, axis=1)[:, None] * norms[None, :]
        rows, columns = possible_members(own, index, len(c), q_ids[at : at + STRIP, None] == c_ids[None, :], k, error)
        if plain:
            score = np.concatenate([np.einsum("ij,ij->i", own[rows[i : i + 16384]], block[columns[i : i + 16384]]) for i in range(0, len(rows), 16384)] or [np.zeros(0)]).astype(np.int64)
            best = best_of(rows, c_ids[columns], score, k)
        else:
            wide = [sum(exact(x) * exact(y) for x, y in zip(q[at + i].tolist(), c[j].tolist(), strict=True)) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
            order = sorted(range(len(wide)), key=lambda x: (rows[x], -wide[x], c_ids[columns[x]]))
            firsts = {}
            best = np.array([x for x in order if firsts.setdefault(int(rows[x]), []) is not None and (firsts[int(rows[x])].append(x) or len(firsts[int(rows[x])]) <= k)], dtype=np.int64)
            score = np.array([min(LONG - 1, max(-LONG, s)) for s in wide], dtype=np.int64)
        out[0].append(q_ids[at + rows[best]])
        out[1].append(c_ids[columns[best]])
        out[2].append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the ``k`` rows of highest integer score.

    Takes no part: a null id, a vector that is null, empty, or has a null or non-finite component; zero vectors do.
    Ties go to the smaller id; fewer candidates give fewer rows; an empty table gives none. Scores are exact whatever the
    components; one beyond the range of a long is shown, and ranked between blocks, as the nearest long. Vectors meet
    those of their own dimension. Rows that repeat an id are candidates each, never of that id. Other columns are not
    read.
    """
    rows = usable(vectors, id_col, vec_col, allow_zero=True)
    return search_tiles(rows, F.col("id") % every == 0, lambda q, qi, c, ci: best_in_tile(q, qi, c, ci, k), k, "long", QUERY_CELLS, CANDIDATE_CELLS)
