"""Passages of which earlier texts quote shorter pieces: the copy has to find the original behind them."""

import numpy as np
import pytest

from rowkin.llm import passages
from rowkin.llm.shingles import rolled, word_hashes

RNG = np.random.default_rng(77)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(2000)]


def prose(n, seed):
    return np.random.default_rng(seed).choice(VOCABULARY, n).tolist()


def table(kinds, words, quote, starts, edits, seed):
    """(texts, ids of the copies): for each of ``kinds`` passages texts that quote ``quote`` words from each of ``starts``, then the original, then a copy with ``edits`` words changed."""
    rng, texts, copies = np.random.default_rng(seed), [], []
    for k in range(kinds):
        own = prose(words, seed * 1000 + k)
        for i, at in enumerate(starts):
            texts.append(" ".join([*prose(40, seed * 1000 + 100 + 10 * k + i), *own[at : at + quote], *prose(30, seed * 1000 + 300 + 10 * k + i)]))
        texts.append(" ".join([*prose(35, seed * 1000 + 500 + k), *own]))
        changed = list(own)
        for e, at in enumerate(rng.choice(words, edits, replace=False)):
            changed[at] = f"edit{e}"
        copies.append(len(texts))
        texts.append(" ".join([*prose(25, seed * 1000 + 600 + k), *changed, *prose(20, seed * 1000 + 700 + k)]))
    return texts, copies


def by_hand(texts, copies, passage=50):
    """The copies of which some window of ``passage`` words has a Jaccard of 0.8 or more with one of the text before it, the original."""
    width, found = passage - 4, set()
    for c in copies:
        own, other = ([frozenset(rolled(w)[k : k + width].tolist()) for k in range(len(w) - passage + 1)] for w in (word_hashes([texts[i]])[0] for i in (c, c - 1)))
        if any(len(a & b) >= 0.8 * len(a | b) for a in own for b in other):
            found.add(c)
    return found


@pytest.mark.parametrize("words,quote,starts,edits", [(120, 30, (0, 45, 88), 3), (120, 30, (0, 30, 60, 90), 3), (90, 30, (5, 35, 60), 2), (200, 40, (0, 40, 80, 120, 160), 5), (120, 30, (0, 45, 88), 0)])
def test_copies_behind_quotes(spark, words, quote, starts, edits):
    texts, copies = table(12, words, quote, starts, edits, words + edits + len(starts))
    wanted = by_hand(texts, copies)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in passages.repeated_passages(docs).collect() if r.n_removed}
    assert len(wanted) >= 9 and len(got & wanted) >= 0.9 * len(wanted), (sorted(wanted - got), len(wanted))
    assert got <= set(copies)
