"""Substring dedup: repeated passages, exact or edited, are found by MinHash bands of paragraphs, verified exactly, and removed but once.

Every run of PASSAGE words of a text is a paragraph, so a passage is found wherever it stands. A paragraph has FUNCTIONS
MinHash values over its five-word shingles, each a band of one row: paragraphs whose Jaccard similarity is 0.8 share at
least one with probability 1 - 0.2**3 = 0.992, equal ones always. A least shingle is the shared value of all paragraphs
around it, so a text sends about one band for eight words, with the place where it stands (an anchor).

Documents that collide in a band are joined with its first document if they agree with it on the HALF shingles before or
after the anchor, else with the first document of those that agree with them there. CONTEXT shingles on each side of the
two anchors are aligned, and every window of PASSAGE words or more whose exact Jaccard (shingles counted by place, in the
order of both texts) is at least THRESHOLD is a repeat. Anchors that find none stand on words that many texts share, such
as quotes that are shorter than a passage. They go on with keys of two anchors NEAR to FAR words apart, which only
documents with a long stretch in common share, and are joined with the first document of each; then with the exact runs
of RUN words around them: any exact repeat of PASSAGE words around an anchor holds one of these in every document that
has it. Removals link documents; components of links are classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.common import forget, mix64, stored
from rowkin.llm.components import components
from rowkin.llm.shingles import WORD, WORDS, forget_words, rolled, word_hashes
from rowkin.llm.tokens import forget_pieces, slices

PASSAGE = 50
THRESHOLD = 0.8
#: MinHash values of a paragraph, each a band.
FUNCTIONS = 3
#: Words of an exact run, and the places of its start before an anchor: any common run of PASSAGE words that holds the anchor holds one of these.
RUN = 43
GRID = (0, 8, 16, 24, 32, 38)
#: Shingles before or after an anchor that two documents must have alike to be aligned there.
HALF = 6
#: Shingles on each side of an anchor that are aligned. Of the anchors of two documents on one diagonal, one in each STRIDE words is aligned, so contexts overlap.
CONTEXT = 96
STRIDE = 64
#: Words between two anchors whose keys tell a long common stretch from a quote.
NEAR, FAR = 24, 72
#: Words in which a shingle is an anchor once.
SPACE = 32
#: Words by which edits may shift an alignment.
DRIFT = 24
#: Alignments that a worker does at once.
ALIGNED = 4096
#: Order of a null id: after all others.
LAST = (1 << 63) - 1
LOW = 0xFFFFFFFF
_SALTS = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(starts: np.ndarray, shingles: np.ndarray, passage: int = PASSAGE, functions: int = FUNCTIONS) -> np.ndarray:
    """Places of shingles that are the least of some paragraph of their text under some function. ``starts``: of texts, in words."""
    width = passage - WORDS + 1
    if len(shingles) < width:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(shingles) - width + 1)
    text = np.searchsorted(starts, place, "right") - 1
    whole = place + passage <= starts[text + 1]  # not across two texts
    fence = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.zeros(len(shingles), dtype=bool)
    for salt in _SALTS[:functions]:
        values = mix64(shingles ^ salt) if salt else shingles
        values = np.maximum(values, np.uint64(1))
        least = np.where(whole, _sliding(values, width, np.minimum), 0)
        chosen |= _sliding(np.concatenate([fence, least, fence]), width, np.maximum) == values
    return _spaced(np.flatnonzero(chosen), shingles)


def _spaced(at: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Of places with equal shingles in short succession (the same words again and again) the first in each SPACE words."""
    order = np.argsort(shingles[at], kind="stable")
    own, keys = at[order], shingles[at[order]]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (np.diff(own) >= SPACE)]) if len(own) else np.zeros(0, dtype=bool)
    step = (own - own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]) // SPACE if len(own) else own
    new[1:] |= step[1:] != step[:-1]
    return np.sort(own[new])


def numbered(docs: DataFrame, id_col: str, text_col: str, label: str) -> tuple[DataFrame, str]:
    """A written table with a row for each of ``docs``: its number ``row``, ``ord`` (its id, null last), ``digest`` of its text, and ``doc``, its columns."""
    marks = (F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("digest"))
    return stored(docs.select(*marks, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), label, "zstd")


def sides(shingles: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """32-bit hashes of the HALF shingles before and after each place, packed in 64 bits; 0 where the text, from ``low`` to ``high``, has fewer."""
    out = np.zeros(len(at), dtype=np.uint64)
    for shift, begin, fits in ((32, -HALF, at - HALF >= low), (0, 1, at + HALF < high)):
        own = at[fits]
        key = np.full(len(own), shift + 1, dtype=np.uint64)
        for k in range(HALF):
            key = key * np.uint64(0x9E3779B97F4A7C15) + shingles[own + (begin + k)]
        out[fits] |= np.maximum(mix64(key) >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
    return out


def band_rows(named: DataFrame) -> DataFrame:
    """(band, ord, row, place, sides): every anchor of every text. ``named``: row, ord, text."""
    names = ["band", "ord", "row", "place", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for batch in batches:
            rows, orders, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for x, y in slices(texts):
                words, starts = word_hashes(texts[x:y], keep=True)
                shingles = rolled(words)
                at = anchors(starts, shingles)
                text = np.searchsorted(starts, at, "right") - 1
                near = sides(shingles, at, starts[text], starts[text + 1] - WORDS + 1)
                columns = (shingles[at].view(np.int64), orders[x:y][text], rows[x:y][text], (at - starts[text]).astype(np.int32), near.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        forget_words()

    return named.select("row", "ord", "text").mapInArrow(run, "band long, ord long, row long, place int, sides long")


def context_rows(named: DataFrame, seeds: DataFrame) -> DataFrame:
    """32-bit shingles around each place of ``seeds`` (row, place, from, there): (row, place, from, there, at, context) for each seed, and the same with null row and place for each (from, there) once. The place is at position ``at``."""
    names = ["row", "place", "from", "there", "at", "context"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for x, y in slices(texts):
                words, starts = word_hashes(texts[x:y], keep=True)
                shingles = np.maximum((rolled(words) >> np.uint64(32)).astype("<u4"), 2)  # 0 and 1 stand for no word
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i in range(x, y):  # a text may be asked for many contexts: they leave as they come
                    own = shingles[int(starts[i - x]) : int(starts[i - x + 1]) - WORDS + 1]
                    for place, source, there in zip(*(f.to_pylist() for f in asked[i].values.flatten()), strict=True):
                        low = max(0, place - CONTEXT)
                        key = (None, None, rows[i], place) if source is None else (rows[i], place, source, there)
                        for column, value in zip(out, (*key, place - low, own[low : place + CONTEXT + 1].tobytes()), strict=True):
                            column.append(value)
                        if len(out[0]) == ALIGNED:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                            out = ([], [], [], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
        forget_words()

    others = seeds.select(F.col("from").alias("row"), F.col("there").alias("place")).distinct()
    both = seeds.select("row", "place", "from", "there").unionByName(others.withColumns({"from": F.lit(None).cast("long"), "there": F.lit(None).cast("int")}))
    lists = both.groupBy("row").agg(F.collect_list(F.struct("place", "from", "there")).alias("asked"))  # bounded by the words of a document
    return named.join(lists, "row").select("row", "text", "asked").mapInArrow(run, "row long, place int, from long, there int, at int, context binary")


def _grid(contexts: list[bytes], at: np.ndarray, blank: int) -> np.ndarray:
    """Contexts as rows of 2 * CONTEXT + 1 shingles, the anchor in the middle."""
    flat = np.frombuffer(b"".join(contexts), "<u4")
    sizes = np.array([len(c) // 4 for c in contexts], dtype=np.int64)
    out = np.full((len(contexts), 2 * CONTEXT + 1), blank, dtype=np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + CONTEXT - at[row]] = flat
    return out


def matched(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each shingle of ``here`` the place of an equal one in ``there``, -1 if none: ascending from left to right, at most DRIFT off.

    Rows are pairs of contexts that agree in the middle. From there outwards the nearest diagonal is taken; off the
    middle diagonal, two shingles in a row must agree.
    """
    n, width = here.shape
    places = np.arange(width, dtype=np.int32)
    to = np.where(here == there, places, np.int32(-1))
    poor = np.flatnonzero((to < 0).any(axis=1))
    if len(poor):
        a, b, own = here[poor], there[poor], to[poor]
        for s in sorted(range(-DRIFT, DRIFT + 1), key=abs)[1:]:
            left, right = max(0, -s), width - max(0, s)
            same = a[:, left:right] == b[:, left + s : right + s]
            two = same[:, 1:] & same[:, :-1]
            run = np.zeros_like(same)
            run[:, 1:] |= two
            run[:, :-1] |= two
            part = own[:, left:right]
            np.copyto(part, places[left + s : right + s], where=run & (part < 0))
        right = own[:, CONTEXT:]
        before = np.maximum.accumulate(right, axis=1)
        right[:, 1:][right[:, 1:] <= before[:, :-1]] = -1
        left = np.where(own[:, CONTEXT::-1] < 0, width, own[:, CONTEXT::-1])
        after = np.minimum.accumulate(left, axis=1)
        drop = left[:, 1:] >= after[:, :-1]
        own[:, CONTEXT - 1 :: -1][drop] = -1
        to[poor] = own
    return to


def windows(to: np.ndarray, passage: int = PASSAGE, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(row, begin, end) in shingles of windows with an exact Jaccard of ``threshold`` or more; ``to``: what ``matched`` returns.

    Only windows that begin and end with a run of common shingles need a look: one that takes in more of a run is only
    more alike.
    """
    least = passage - WORDS + 1
    to = to[:, :].copy()
    to[(to >= 0).sum(axis=1) < threshold * least] = -1
    row, a = np.nonzero(to >= 0)
    if not len(row):
        return []
    b = to[row, a]
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(a) != 1) | (np.diff(b) != 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    out: list[tuple[int, int, int]] = []
    ends = np.append(np.flatnonzero(np.diff(row[first])) + 1, len(first))
    begin, runs = 0, list(zip(a[first].tolist(), a[last].tolist(), b[first].tolist(), b[last].tolist(), first.tolist(), last.tolist(), strict=True))
    for end in ends.tolist():
        own, r = runs[begin:end], int(row[first[begin]])
        for i, (a0, _, b0, _, f, _) in enumerate(own):
            for _, a1, _, b1, _, g in reversed(own[i:]):
                long, wide, common = a1 - a0 + 1, b1 - b0 + 1, g - f + 1
                if max(long, wide) < least or min(long, wide) < least - 1:
                    break
                if common >= threshold * (long + wide - common):
                    out.append((r, a0, a1 + 1))
                    break
        begin = end
    return out


def verified_spans(contexts: DataFrame) -> DataFrame:
    """(row, place, from, begin, end) of the seeds in ``contexts`` (what ``context_rows`` returns): windows found around them, in words; one row with null begin and end if none."""
    here = contexts.filter("row is not null")
    there = contexts.filter("row is null").select("from", "there", F.col("at").alias("at2"), F.col("context").alias("context2"))
    names = ["row", "place", "from", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in range(0, whole.num_rows, ALIGNED):
                batch = whole.slice(x, ALIGNED)
                row, place, source, at, at2 = (batch.column(k).to_numpy() for k in range(5))
                found = windows(matched(_grid(batch.column(5).to_pylist(), at, 0), _grid(batch.column(6).to_pylist(), at2, 1)))
                i = np.array([f[0] for f in found], dtype=np.int64)
                begin, end = (np.array([f[k] for f in found], dtype=np.int64) + place[i] - CONTEXT for k in (1, 2))
                none = np.setdiff1d(np.arange(len(row)), i)
                i = np.concatenate([i, none])
                gap = [None] * len(none)
                yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(place[i]), pa.array(source[i]), pa.array(begin.tolist() + gap, pa.int32()), pa.array((end + WORDS - 1).tolist() + gap, pa.int32())], names=names)

    pairs = here.join(there, ["from", "there"])
    return pairs.select("row", "place", "from", "at", "at2", "context", "context2").mapInArrow(run, "row long, place int, from long, begin int, end int")


def exact_runs(contexts: DataFrame) -> DataFrame:
    """(band, row, place): hashes of the runs of RUN words around the anchors of ``contexts`` (row, place, at, context)."""
    size = RUN - WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, at = (batch.column(k).to_numpy() for k in range(3))
            grid = _grid(batch.column(3).to_pylist(), at, 0).astype(np.uint64)
            for k, before in enumerate(GRID):
                own = grid[:, CONTEXT - before : CONTEXT - before + size]
                full = (own > 0).all(axis=1)
                key = np.full(len(row), k + 1, dtype=np.uint64)
                for c in range(size):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + own[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.array(row[full]), pa.array(place[full])], names=["band", "row", "place"])

    return contexts.select("row", "place", "at", "context").mapInArrow(run, "band long, row long, place int")


def pair_keys(shared: DataFrame, asked: DataFrame) -> DataFrame:
    """(band, ord, row, place, sides): keys of an anchor whose band is ``asked`` for and each other one NEAR to FAR words before or after it, at the asked one's place. ``shared``: band, ord, row, place."""
    marked = shared.join(asked.select("band", F.lit(True).alias("open")), "band", "left")
    rows = marked.filter("open").select("row").distinct()
    own = marked.join(rows, "row", "left_semi").groupBy("row", "ord").agg(F.array_sort(F.collect_list(F.struct("place", "band", F.coalesce("open", F.lit(False)).alias("open")))).alias("own"))  # bounded by the words of a document
    names = ["band", "ord", "row", "place", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            place, band, asks = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            rows, orders = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = (text << 32) + place
            low, high = np.searchsorted(at, at + NEAR), np.searchsorted(at, at + FAR, "right")
            for x in range(0, len(at), 1 << 13):
                n = (high - low)[x : x + (1 << 13)]
                i = np.repeat(np.arange(x, x + len(n)), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
                both = mix64(mix64(band[i].view(np.uint64)) * np.uint64(3) + band[j].view(np.uint64))
                for which, k in ((1, i), (2, j)):
                    use = asks[k]
                    key = mix64(both[use] + np.uint64(which)).view(np.int64)
                    own = k[use]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(orders[text[own]]), pa.array(rows[text[own]]), pa.array(place[own].astype(np.int32)), pa.array(np.zeros(len(own), np.int64))], names=names)

    return own.select("row", "ord", "own").mapInArrow(run, "band long, ord long, row long, place int, sides long")


def starred(bands: DataFrame) -> tuple[DataFrame, str]:
    """Rows of ``bands`` (band, ord, row, place, sides) with the first document of their band, others than its own: adds from, there, sides2; and a path to forget."""
    one = bands.groupBy("band").agg(F.min(F.struct("ord", "row", "place", "sides")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts, path = stored(one.select("band", F.col("first.row").alias("from"), F.col("first.place").alias("there"), F.col("first.sides").alias("sides2")), "firsts")  # written, so that a common band's rows can be dealt to several tasks
    return bands.join(firsts, "band").filter("row <> from"), path


def thinned(found: DataFrame) -> DataFrame:
    """(row, place, from, there, ord): of the anchors that two documents share on one diagonal, the first in each STRIDE words."""
    own = found.select("row", "ord", "place", "from", (F.col("place") - F.col("there")).alias("shift"))
    thin = own.groupBy("row", "from", "shift", F.expr(f"place div {STRIDE}").alias("_step")).agg(F.min("place").alias("place"), F.first("ord").alias("ord"))
    return thin.select("row", "place", "from", (F.col("place") - F.col("shift")).alias("there"), "ord")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def removals(rows: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, list[str]]:
    """(row, spans, whole) of the rows that lose words, (row, root) of the rows that removals link, and paths to forget. ``rows``: what ``numbered`` writes.

    ``whole``: the text is a copy, character by character, of an earlier row's, and goes whole (its spans are null).
    """
    spark = rows.sparkSession
    named = rows.select("row", "ord", F.col("doc")[text_col].cast("string").alias("text"))
    digests = rows.filter("digest is not null").select("digest", "row", "ord")
    heads, heads_path = stored(digests.groupBy("digest").agg(F.min(F.struct("ord", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("from")), "heads")
    bands, bands_path = stored(band_rows(named), "bands")
    long = bands.select("row").distinct()  # texts of PASSAGE words or more
    copies, copies_path = stored(digests.join(heads, "digest").filter("row <> from").select("row", "from").join(long, "row", "left_semi"), "copies")

    repeated, repeated_path = stored(bands.groupBy("band").count().filter("count > 1").select("band"), "repeated")
    shared, shared_path = stored(bands.join(repeated, "band", "left_semi"), "shared")  # most bands occur once and go no further
    found, firsts_path = starred(shared)
    found, found_path = stored(found.join(copies.select("row"), "row", "left_anti"), "found")
    before, after = (lambda c: F.nullif(F.shiftrightunsigned(c, 32), F.lit(0))), (lambda c: F.nullif(F.col(c).bitwiseAND(F.lit(LOW)), F.lit(0)))
    alike = F.coalesce(before("sides") == before("sides2"), F.lit(False)) | F.coalesce(after("sides") == after("sides2"), F.lit(False))
    # the others, by their band and what stands before or after the anchor
    other = found.filter(~alike).drop("from", "there", "sides2")
    keys = F.explode(F.array_compact(F.array(*(F.when(x.isNotNull(), F.xxhash64("band", x, F.lit(k))) for k, x in enumerate((before("sides"), after("sides")))))))
    closer, closer_path = starred(other.withColumn("band", keys))
    seeds, seeds_path = stored(thinned(found.filter(alike).select("row", "ord", "place", "from", "there").unionByName(closer.select("row", "ord", "place", "from", "there"))), "seeds")
    for path in (bands_path, repeated_path, firsts_path, found_path, closer_path):
        forget(spark, path)
    contexts, contexts_path = stored(context_rows(named, seeds), "contexts")
    spans, spans_path = stored(verified_spans(contexts), "spans")
    nothing = lambda spans: spans.filter("begin is null").select("row", "place").join(spans.filter("begin is not null").select("row", "place"), ["row", "place"], "left_anti").distinct()

    asked, asked_path = stored(shared.join(nothing(spans), ["row", "place"], "left_semi").select("band").distinct(), "asked")
    pairs, pairs_path = stored(pair_keys(shared, asked), "pairs")
    far, far_path = starred(pairs)
    step = [F.col("row"), F.col("from"), (F.col("place") - F.col("there")).alias("_shift"), F.expr(f"place div {STRIDE}").alias("_step")]
    beyond = thinned(far.select("row", "ord", "place", "from", "there")).select("*", *step[2:]).join(seeds.select(*step), ["row", "from", "_shift", "_step"], "left_anti")  # less what was aligned before
    beyond, beyond_path = stored(beyond.select("row", "place", "from", "there", "ord"), "beyond")
    for path in (shared_path, asked_path, pairs_path, far_path):
        forget(spark, path)
    wider, wider_path = stored(context_rows(named, beyond), "contexts")
    met, met_path = stored(verified_spans(wider), "spans")

    left = nothing(spans.unionByName(met))
    lone, lone_path = stored(contexts.join(left, ["row", "place"], "left_semi").dropDuplicates(["row", "place"]).join(seeds.select("row", "ord").distinct(), "row"), "lone")
    runs, runs_path = stored(exact_runs(lone).join(lone.select("row", "place", "ord"), ["row", "place"]).withColumn("sides", F.lit(0).cast("long")), "runs")
    again, again_path = starred(runs)
    last, last_path = stored(thinned(again), "last")
    here = last.join(lone.select("row", "place", "at", "context"), ["row", "place"]).select("row", "place", "from", "there", "at", "context")
    there = last.select("from", "there").distinct().join(lone.select(F.col("row").alias("from"), F.col("place").alias("there"), "at", "context"), ["from", "there"])
    more, more_path = stored(verified_spans(here.unionByName(there.withColumns({"row": F.lit(None).cast("long"), "place": F.lit(None).cast("int")}))), "spans")
    for path in (heads_path, contexts_path, seeds_path, beyond_path, wider_path, lone_path, runs_path, again_path, last_path):
        forget(spark, path)

    every = spans.unionByName(met).unionByName(more).filter("begin is not null")
    links = every.select(F.col("row").alias("a"), F.col("from").alias("b")).unionByName(copies.select(F.col("row").alias("a"), F.col("from").alias("b")))
    groups, groups_path = components(links.distinct())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"begin": a, "end": b} for a, b in merged([(s["begin"], s["end"]) for s in own])] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], names=["row", "spans"])

    cut = every.select("row", F.struct("begin", "end").alias("span")).distinct().groupBy("row").agg(F.collect_list("span").alias("found")).mapInArrow(together, "row long, spans array<struct<begin: int, end: int>>")
    cut = cut.withColumn("whole", F.lit(False)).unionByName(copies.select("row", F.lit(None).cast("array<struct<begin: int, end: int>>").alias("spans"), F.lit(True).alias("whole")))
    return cut, groups.withColumnsRenamed({"node": "row"}), [spans_path, met_path, more_path, copies_path, groups_path]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``spans``, with what follows each up to the next word; spans beyond the text count as far as it goes."""
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = "", 0
    for begin, end in merged(spans):
        begin, end = max(0, begin), min(end, len(found))
        if begin >= end:
            continue
        b = found[end][0] if end < len(found) else len(text)
        out += text[at : found[begin][0]]
        if "\n" in text[found[end - 1][1] : b] and out and out[-1] != "\n":
            out = out.rstrip(" ") + "\n"
        at = b
    return out + text[at:]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_removed, spans for every row: word ranges that an earlier row has too.

    Words are runs of letters, digits and underscores, compared in lower case. Earlier: smaller id, null ids last, of
    equal ids the row that is read first. Removed are windows of PASSAGE words or more whose exact Jaccard with a window
    of an earlier row is at least THRESHOLD, within CONTEXT shingles of an anchor that both share; windows that meet are
    one. Copies, character by character, of an earlier text of PASSAGE words or more go whole. class_id is the least id
    of the rows that removals link (null if none of them has one); a row without any has its own. Null texts and texts
    of fewer than PASSAGE words lose nothing. Rows that share an id are rows each. An empty table gives no rows; other
    columns are not read.
    """

    @F.arrow_udf("int")
    def n_words(texts: pa.Array) -> pa.Array:
        return pa.array([len(WORD.findall(t)) for t in texts.to_pylist()], pa.int32())

    rows, _ = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", "rows")
    cut, groups, _ = removals(rows)
    own = rows.select("row", "ord", F.col("doc.id").alias("doc_id"))
    least, _ = stored(groups.join(own, "row").groupBy("root").agg(F.min("ord").alias("least")), "least")  # written, so that a large class can be dealt to several tasks
    classes = groups.join(least, "root").select("row", F.when(F.col("least") < LAST, F.col("least")).alias("class"), F.lit(True).alias("linked"))
    sizes = rows.join(cut.filter("whole").select("row"), "row", "left_semi").select("row", n_words(F.col("doc.text")).alias("size"))
    got = own.join(cut, "row", "left").join(classes, "row", "left").join(sizes, "row", "left")
    spans = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("begin"), F.col("size").alias("end")))).otherwise(F.col("spans"))
    got = got.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<begin: int, end: int>>")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["begin"]))
    return got.select("doc_id", F.when(F.col("linked"), F.col("class")).otherwise(F.col("doc_id")).alias("class_id"), removed.alias("n_removed"), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without repeated passages (see ``repeated_passages``); rows that lose all their words go.

    Null, empty and wordless texts stay as they are. ``chars_col``, if there, follows the text. Other columns pass.
    """
    rows, _ = numbered(docs, id_col, text_col, "rows")
    cut, _, _ = removals(rows, text_col)

    @F.arrow_udf("string")
    def less(texts: pa.Array, spans: pa.Array) -> pa.Array:
        left = (without(t, [(s["begin"], s["end"]) for s in own]) for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True))
        return pa.array([t if WORD.search(t) else None for t in left], pa.string())

    got = rows.join(cut, "row", "left")
    kept = got.filter("whole is null").select("doc.*")
    less_text = got.filter("not whole").withColumn("left", less(F.col("doc")[text_col].cast("string"), "spans")).filter("left is not null")
    changed = {text_col: F.col("left")}
    if chars_col in docs.columns:
        changed[chars_col] = F.length("left").cast(docs.schema[chars_col].dataType)
    return kept.unionByName(less_text.select(*(changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns)))
