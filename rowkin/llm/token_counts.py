"""Token counts of whole texts by a lookup in two tiers, on the map side only: no piece of a text is ever shuffled.

Byte-level BPE never joins across a blank that follows a printable character, so a text is cut there and the lengths of
its pieces add up. The first tier is a broadcast hash table with the lengths of the most frequent pieces of all
documents; misses go to the worker's own cache and from there to the library. A pass before fills the table: each task
keeps the heavy hitters of its texts in a summary of fixed size (Misra-Gries), summaries are merged in a tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import tokens
from rowkin.llm.common import give_back, small_batches, stored

LIMIT = 1024
#: Entries of the broadcast table and of a task's summary, and the longest piece in them: at most 64 K pieces of 32 letters, 8 MB.
FREQUENT, LONGEST = 65_536, 32
SUMMARY = 16_384
FANIN = 32
CACHE = 400_000
#: A text is cut before a blank that follows a printable ASCII character: whatever the pattern does with white space, a piece ends there.
CUT = re.compile(r"(?<=[!-~])(?= )")


def blanks(text: str) -> list[str]:
    """A text cut before all its blanks."""
    return text.replace(" ", "\x00 ").split("\x00")


# -- the first tier -------------------------------------------------------------------------------------------------


def reduced(counts: Counter, size: int) -> Counter:
    """At most ``size`` entries: the count of the next one is taken off all (Misra-Gries), so none that makes up more than 1 / size of all pieces goes."""
    if len(counts) <= size:
        return counts
    floor = sorted(counts.values(), reverse=True)[size]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def _packed(counts: Counter) -> pa.RecordBatch:
    rows = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in rows]]), pa.array([[v for _, v in rows]], pa.list_(pa.int64()))], names=["pieces", "counts"])


_SUMMARY = "pieces array<string>, counts array<long>"


def heavy(texts: DataFrame, size: int = SUMMARY) -> DataFrame:
    """A row a task with its heavy hitters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.update(p for p in blanks(text or "") if len(p) <= LONGEST)
                if len(own) > 8 * size:
                    own = reduced(own, size)
        if own:
            yield _packed(reduced(own, size))
        own.clear()
        give_back()

    return texts.mapInArrow(count, _SUMMARY)


def frequent(docs: DataFrame, text_col: str = "text", size: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent pieces of all documents, at most ``size``, the most frequent first. No more than ``FANIN`` summaries meet in a task."""

    def merge(table: pa.Table) -> pa.Table:
        own: Counter = Counter()
        for names, counts in zip(table.column("pieces"), table.column("counts"), strict=True):
            own.update(dict(zip(names.as_py(), counts.as_py(), strict=True)))  # a summary at a time
            own = reduced(own, size)
        return pa.Table.from_batches([_packed(own)])

    found, _ = stored(heavy(docs.select(text_col), summary), "pieces")
    n = found.count()  # summaries, one a task
    while n > 1:
        group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // FANIN)))
        found, _ = stored(found.withColumn("g", group).groupBy("g").applyInArrow(merge, _SUMMARY), "pieces")
        n = found.count()
    row = found.head()
    return [p for p in row.pieces[:size] if not tokens.together(p)] if row else []


# -- counting -------------------------------------------------------------------------------------------------------


class Lengths(dict):
    """Token counts of pieces: as a dict the broadcast table; what it lacks comes from two generations of a cache of at most ``cache`` pieces, then from the library."""

    def __init__(self, table: dict[str, int], vocabulary: str, cache: int = CACHE):
        super().__init__(table)
        self.encoder = tokens.Encoder(vocabulary, added_tokens=True, cache_pieces=0)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.half = cache // 2

    def __missing__(self, piece: str) -> int:
        if tokens.together(piece):
            raise tokens.Together(piece)
        return self.length(piece)

    def length(self, piece: str) -> int:
        """Tokens of a piece that nothing around it reaches into."""
        n = self.get(piece)
        if n is None:
            n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece)
            if n is None:
                n = len(self.encoder.piece(piece)) // 4
            if len(piece) <= 4 * LONGEST:
                if len(self.young) >= self.half:
                    self.young, self.old = {}, self.young
                self.young[piece] = n
        return n

    def of(self, text: str) -> int:
        """Tokens of a text without added tokens. Where white space follows a blank, the text is cut after printable characters only."""
        if not text:
            return 0
        if "  " not in text and "\x00" not in text:
            try:
                return sum(map(self.__getitem__, blanks(text)))
            except tokens.Together:
                pass
        return sum(map(self.length, CUT.split(text)))


class TokenCounter:
    """Counts tokens as the library of the vocabulary file does by default: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, vocabulary: str, table: dict[str, int] | None = None):
        self.lengths = None
        if vocabulary.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=vocabulary)
            self.whole = lambda text: len(model.encode(text, num_threads=1))
            return
        own = Lengths(table or {}, vocabulary)
        model = own.encoder.tokenizer
        model.no_truncation()
        model.no_padding()
        self.whole = lambda text: len(model.encode(text, add_special_tokens=False))
        added = model.get_added_tokens_decoder().values()
        if own.encoder.plain and not any(t.single_word or t.lstrip or t.rstrip for t in added):
            self.lengths = own
            self.added = own.encoder.added

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.lengths is None:
            return self.whole(text)
        if self.added is None or not self.added.search(text):
            return self.lengths.of(text)
        between = self.added.split(text)  # the library cuts added tokens out first
        return sum(map(self.lengths.of, between)) + len(between) - 1


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def counted(texts: Iterable[str | None], vocabulary: str, table: dict[str, int], key: int) -> list[int]:
    """Counts by the worker's own counter for this vocabulary and table; another table takes the place of the last."""
    if (vocabulary, key) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary, key] = TokenCounter(vocabulary, table)
    return list(map(_COUNTERS[vocabulary, key].count, texts))


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the vocabulary's library counts it.

    A null text is empty: no bytes, no tokens. Rows stay apart whatever ids they share. Texts of any length are cut into
    pieces, each at most as long as the longest stretch without a blank. Vocabularies that are not byte-level BPE are
    counted whole by their library, without the lookup.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    lookup = TokenCounter(vocabulary).lengths is not None
    with small_batches(spark):
        names = frequent(docs, text_col, size) if lookup else []
    own = TokenCounter(vocabulary) if lookup else None
    table = {name: own.lengths.of(name) for name in names}
    shared = spark.sparkContext.broadcast(table)  # at most FREQUENT pieces of LONGEST letters
    key = id(shared)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for start in range(0, batch.num_rows, 64):
                found += counted(batch.column(2).slice(start, 64).to_pylist(), vocabulary, shared.value, key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
