"""Words of texts as 64-bit hashes, their five-word shingles, and pairs within sorted groups, all on numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

from rowkin.llm.common import give_back, mix64

WORDS = 5
WORD = re.compile(r"\w+")
#: Words that a worker remembers with their hashes; beyond that it starts anew.
MEMORY = 100_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def forget_words() -> None:
    """Empties the worker's memory of words: workers outlive tasks, and the next one may need the room for something else."""
    _HASHES.clear()
    give_back()


def word_hashes(texts: list[str | None], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in a row, and where texts start (one entry more than texts).

    ``keep``: words are those of the text as it is. Only U+0130 makes a difference, whose lower case has a mark that ends a word.
    """
    found = [([w.lower() for w in WORD.findall(t)] if keep and "\u0130" in t else WORD.findall(t.lower())) if t else [] for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
    look = _HASHES.__getitem__
    return np.fromiter((look(w) for x in found for w in x), dtype=np.uint64, count=int(starts[-1])), starts


def rolled(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """A hash of each run of ``width`` words, for every place where one starts (the last ones wrap into what follows: cut them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix64(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of one to four words is one shingle, one without words has none."""
    words, starts = word_hashes(texts)
    runs = rolled(words)
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(rolled(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def pairs_within(keys: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a < b) of positions with equal keys, keys being sorted; some ``most`` pairs at a time."""
    n = len(keys)
    if n < 2:
        return
    last = np.searchsorted(keys, keys, "right")  # where a position's group ends
    partners = last - np.arange(n) - 1
    at = 0
    ends = np.cumsum(partners)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        own = partners[at:to]
        a = np.repeat(np.arange(at, to), own)
        b = np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + a + 1
        if len(a):
            yield a, b
        at = to


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the least position it is linked with, directly or not."""
    labels = np.arange(n)
    while len(a):
        new = labels.copy()
        np.minimum.at(new, a, labels[b])
        np.minimum.at(new, b, labels[a])
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    return labels
