"""String metrics that Spark has not, as Arrow UDFs for distinct pairs: Jaro-Winkler and token-set ratio."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@lru_cache(maxsize=65536)
def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro with a bonus of 0.1 for each of up to four common first letters, from 0.7 on; 0 for empty values."""
    a, b = a or "", b or ""
    score = jaro(a, b)
    if score < 0.7:
        return score
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return score + same * 0.1 * (1 - score)


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), the longest common subsequence by bit-parallel rows."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    row = every = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & every
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=65536)
def token_set(a: str | None, b: str | None) -> float:
    """Best indel ratio of common words, and common words with each side's other words; 1 if one side has no other."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and not (left and right):
        return 1.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    scores = [indel_ratio(one, two)]
    if common:
        scores += [indel_ratio(common, one), indel_ratio(common, two)]
    return max(scores)


def _each(metric, a: pa.Array, b: pa.Array) -> pa.Array:
    """The metric of each row; a pair that a batch repeats is computed once, and a row without both strings is 0."""
    both = pc.and_(a.is_valid(), b.is_valid())
    if not pc.any(both).as_py():
        return pa.array(np.zeros(len(a)))
    x, y = a.dictionary_encode(), b.dictionary_encode()
    pairs = pc.add(pc.multiply(x.indices.cast(pa.int64()), len(y.dictionary)), y.indices.cast(pa.int64())).dictionary_encode()
    left, right = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    values = pa.array([metric(left[k // len(right)], right[k % len(right)]) for k in pairs.dictionary.to_pylist()], pa.float64())
    return values.take(pairs.indices).fill_null(0.0)


@F.arrow_udf(DoubleType())
def jaro_winkler_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each(jaro_winkler, a, b)


@F.arrow_udf(DoubleType())
def token_set_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each(token_set, a, b)
