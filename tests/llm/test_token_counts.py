"""Token counts against the libraries, text by text."""

import numpy as np
import pytest

from rowkin.llm import token_counts as T
from rowkin.llm import tokens

SCHEMA = "doc_id long, text string, pieces int, counts string, n_bytes string, g int"
RNG = np.random.default_rng(9)
WORDS = ["".join(RNG.choice(list("abcdefgh'éß1.!?"), RNG.integers(1, 9))) for _ in range(400)]
TEXTS = [
    None,
    "",
    " ",
    "   ",
    "Hello world, it's fine.",
    "two  blanks   three \n\n line\tends  ",
    "a\x00b \x00 c",
    "<|endoftext|>",
    "before <|endoftext|> after<|endoftext|><|endoftext|>  x",
    "emoji 😀 and 漢字 und Größe  nbsp   em \x85 \x1c z",
    "x" * 5000,
    "word " * 30_000,
    " ".join(RNG.choice(WORDS, 3000)),
    *(" ".join(RNG.choice(WORDS, 40)) for _ in range(20)),
    *("".join(RNG.choice(list(" \n\t aA1'. é"), 60)) for _ in range(200)),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", 3) for i, t in enumerate(texts)], SCHEMA)


def library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return path, lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return path, lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path, plain = library(name)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(frame(spark, TEXTS), path).collect()}
    want = {i: (len((t or "").encode()), plain(t or "")) for i, t in enumerate(TEXTS)}
    assert got == {i: (b, n, n > 1024) for i, (b, n) in want.items()}


def test_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in T.token_counts(rows).select("n_tokens", "n_bytes").collect()) == [(1, 1), (2, 3), (2, 3)]
    assert T.token_counts(rows.limit(0)).count() == 0


def test_cache_bounds_do_not_change_counts(monkeypatch):
    path, plain = library("byte_bpe_50k.json")
    own = T.Lengths({" the": 1}, path, cache=10)
    for text in TEXTS:
        if text and "<|endoftext|>" not in text:
            assert own.of(text) == plain(text)
    assert len(own.young) + len(own.old) <= 10 and len(own) == 1


def test_frequent_pieces_of_all_tasks(spark):
    """Heavy hitters survive summaries and merges of any shape."""
    texts = [" ".join(["common"] * 5 + [f"rare{i}x{k}" for k in range(20)]) for i in range(300)]
    docs = frame(spark, texts).repartition(40)
    found = T.frequent(docs, size=50, summary=30)
    assert " common" in found[:2] and "common" in found[:2] and len(found) <= 50


def test_misra_gries_keeps_what_is_frequent():
    counts = T.Counter({"a": 50, "b": 30, "c": 5, "d": 5, "e": 1})
    kept = T.reduced(counts, 2)
    assert set(kept) == {"a", "b"} and T.reduced(counts, 9) == counts


def test_white_space_after_a_blank(spark):
    """A blank before white space may belong to what stands before it, in counts and in ids."""
    path, plain = library("byte_bpe_50k.json")
    own, encoder = T.TokenCounter(path, {" a": 1}), tokens.Encoder(path)
    for text in ("a\n \n b", "a \xa0 \xa0 b", "x\t ", " \n", "a \n", "é \u2003 \u2003b"):
        assert own.count(text) == plain(text) == len(encoder.encode(text)) // 4
    assert all(not tokens.together(p) for p in T.frequent(frame(spark, ["a\n \n b"] * 9)))
