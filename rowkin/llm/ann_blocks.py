"""Nearest neighbours by inner product: a block matrix join on int8 tiles with error bounds, survivors redone in doubles."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.blocks import search_tiles, usable

K = 20
EVERY = 20
#: Components of a block of queries, and of a block of candidates.
QUERY_CELLS, CANDIDATE_CELLS = 1 << 18, 1 << 19
#: Queries whose products with a candidate block are held at once.
STRIP = 256


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as float32, whose products of up to 1,024 components stay exact), scales, norms of what they stand for, norms of their errors."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # a row of numbers too small to scale: all of it counts as error
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    shown = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(shown, axis=1), np.linalg.norm(x - shown, axis=1)


def products(a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    """Exact products of int8 rows."""
    out = a[:, :step] @ b[:, :step].T
    if a.shape[1] > step:
        out = out.astype(np.float64)
        for d in range(step, a.shape[1], step):
            out += a[:, d : d + step] @ b[:, d : d + step].T
    return out


def nearest_in_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` candidates of largest inner product for each query of a tile.

    An int8 product, scaled, is off by at most |error of q| |c| + |q as shown| |error of c|. Candidates whose upper
    bound is below the k-th largest lower bound cannot be among the best; the others are computed in doubles.
    """
    qi, qs, qn, qe = quantise(q)
    ci, cs, _, ce = quantise(c)
    cn = np.linalg.norm(c, axis=1)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), STRIP):
        own = slice(at, at + STRIP)
        near = products(qi[own], ci) * qs[own, None] * cs[None, :]
        slack = qe[own, None] * cn[None, :] + qn[own, None] * ce[None, :]
        slack += 1e-9 * (1 + np.abs(near))
        same = q_ids[own, None] == c_ids[None, :]
        low = near - slack
        low[same] = -np.inf
        kth = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(low), -np.inf)
        rows, columns = np.nonzero((near + slack >= kth[:, None]) & ~same)
        score = np.concatenate([np.add.accumulate(q[own][rows[i : i + 16384]] * c[columns[i : i + 16384]], axis=1)[:, -1] for i in range(0, len(rows), 16384)] or [np.zeros(0)])  # summed in order
        ends = np.searchsorted(rows, np.arange(len(low) + 1))
        for r in range(len(low)):  # a bounded heap a query
            mine = slice(ends[r], ends[r + 1])
            for s, v in heapq.nsmallest(k, zip((-score[mine]).tolist(), c_ids[columns[mine]].tolist(), strict=True)):
                out[0].append(q_ids[at + r])
                out[1].append(v)
                out[2].append(-s)
    return tuple(np.array(x) for x in out)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the ``k`` rows of largest inner product.

    Takes no part: a null id, a vector that is null, empty, all zero, or has a null or non-finite component. Ties go to
    the smaller id; fewer candidates give fewer rows; rows that repeat an id are candidates each, never of that id. An
    empty table gives no rows. Other columns are not read.
    """
    rows = usable(vectors, id_col, vec_col, allow_zero=False)
    return search_tiles(rows, F.col("id") % every == 0, lambda q, qi, c, ci: nearest_in_tile(q, qi, c, ci, k), k, "double", QUERY_CELLS, CANDIDATE_CELLS)
