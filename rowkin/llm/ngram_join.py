"""Jaccard join on word shingles with Bayesian pruning of candidates (after Satuluri and Parthasarathy 2012).

Texts with the same shingle set are one class, so copies are never compared. Classes that share a MinHash band are
candidates; MinHash values are compared some at a time, and a pair is dropped once the posterior probability of reaching
the threshold falls below a tolerance. What survives groups classes into small candidate components. Within these, tiles
of bounded size prune all pairs once more and verify the rest exactly on the shingle sets. A tile returns a row a class
(its links, and the least class it is linked with), never the pairs, so a group of thousands of near copies costs
comparisons but not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.common import forget, mix64, stored, whole_groups
from rowkin.llm.components import components
from rowkin.llm.shingles import forget_words, least_labels, pairs_within, shingle_sets
from rowkin.llm.tokens import forget_pieces, slices

THRESHOLD = 0.8
#: 20 bands of 4 values: a pair at 0.8 shares none with probability (1 - 0.8**4)**20 = 0.00003.
BANDS, ROWS = 20, 4
HASHES = 128
#: Values are compared STEP at a time; pairs less likely than this to reach the threshold are dropped.
STEP = 16
TOLERANCE = 1e-6
#: Classes on a side of a tile, and shingles of the texts there.
TILE, TILE_SHINGLES = 256, 4_000_000

_RNG = np.random.default_rng(20240611)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of non-empty sets: one byte of each of HASHES values, and a 64-bit key for each band."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(sets), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        low[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], starts)
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, b * ROWS + r])
        keys[:, b] = key
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8), keys.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After STEP, 2 STEP ... values: the least matches with which P(Jaccard >= threshold) is at least the tolerance.

    Prior: Jaccard uniform. One byte matches by chance too: a value matches with probability p = J + (1 - J) / 256.
    """
    p = np.linspace(1 / 256, 1, 20001)[1:-1]
    reach = p >= threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[reach].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(signature: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that incremental comparison leaves."""
    matches = np.zeros(len(a), dtype=np.int32)
    for k, need in enumerate(least):
        own = slice(k * STEP, (k + 1) * STEP)
        matches += (signature[a, own] == signature[b, own]).sum(axis=1, dtype=np.int32)
        stay = matches >= need
        if not stay.all():
            a, b, matches = a[stay], b[stay], matches[stay]
        if not len(a):
            break
    return a, b


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), HASHES)


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    used = np.unique(np.concatenate([a, b]))
    sizes = [len(sets[i]) for i in used]
    rows = np.repeat(np.arange(len(used)), sizes)
    _, ids, held = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = held[ids] > 1
    rows, ids = rows[shared], ids[shared]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)  # counts stay exact below 2**24
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
        x, y = np.searchsorted(ids, [low, low + 2048])
        held_by = np.zeros((len(used), 2048), dtype=np.float32)
        held_by[rows[x:y], ids[x:y] - low] = 1
        total += held_by @ held_by.T
    place = np.zeros(len(sets), dtype=np.int64)
    place[used] = np.arange(len(used))
    return total[place[a], place[b]].astype(np.int64)


def prepared(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """A written table with ``doc`` (the columns of ``docs``), a row number ``_j_row`` and, of each text, ``_j_h1``, ``_j_h2`` (its shingle set), ``_j_n`` (its size), ``_j_bands``, ``_j_signature``."""

    @F.arrow_udf("struct<_j_h1: bigint, _j_h2: bigint, _j_n: int, _j_bands: array<bigint>, _j_signature: binary>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_pieces()
        yield from map(sketched, batches)
        forget_words()

    def sketched(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        parts: tuple[list, ...] = ([], [], [], [], [])
        for x, y in slices(texts):
            sets = shingle_sets(texts[x:y])
            full = [s for s in sets if len(s)]
            none = [not len(s) for s in sets]
            at = np.cumsum([not e for e in none]) - 1
            if full:
                signature, keys = signatures(full)
                starts = np.cumsum([0, *map(len, full)])[:-1]
                flat = np.concatenate(full)
                sums = [np.add.reduceat(mix64(flat + np.uint64(salt)), starts).view(np.int64) for salt in (0x1B873593, 0xCC9E2D51)]
            for i, e in enumerate(none):
                row = (None, None, 0, None, None) if e else (int(sums[0][at[i]]), int(sums[1][at[i]]), len(sets[i]), keys[at[i]], signature[at[i]].tobytes())
                for column, value in zip(parts, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], names=["_j_h1", "_j_h2", "_j_n", "_j_bands", "_j_signature"])

    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), sketch(F.col(text_col).cast("string")).alias("_j"))
    return stored(own.select(F.monotonically_increasing_id().alias("_j_row"), "doc", "_j.*"), "sketches")


def _tiled(members: DataFrame, group: str, blocks: str, node: str) -> DataFrame:
    """Adds ``own``, a hashed block of the group, and a row for each tile (pair of blocks) that the block is in: ``tile``, ``alone`` (both blocks are the same)."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64(node), F.col(blocks)).cast("int"))
    dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return dealt.withColumn("tile", F.xxhash64(group, F.least("own", "_t"), F.greatest("own", "_t"))).withColumn("alone", F.col("own") == F.col("_t")).drop("_t", blocks)


def _grouped(frames: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    return whole_groups((b.to_pandas() for b in frames), key)


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Links (a, b) that join all classes which share a band and survive pruning: of each tile a forest of them."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    sized = keyed.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("m > 1")
    # bands with the same members say the same: one of them stays
    chosen = sized.groupBy("m", "who").agg(F.min("key").alias("key"))
    shared = keyed.join(chosen, "key").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int")).select("key", "node", "blocks")
    tiles = _tiled(shared, "key", "blocks", "node").select("tile", "node", "own", "alone").join(classes.select("node", "signature"), "node")
    least = least_matches(threshold, tolerance)

    def link(batches):
        for frame in _grouped(batches, "tile"):
            keys, own, alone, nodes = (frame[c].to_numpy() for c in ("tile", "own", "alone", "node"))
            signature = _matrix(frame["signature"])
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in pairs_within(keys):
                meet = alone[a] | (own[a] != own[b])
                kept.append(survivors(signature, a[meet], b[meet], least))
            if kept:
                labels = least_labels(len(frame), *(np.concatenate(x) for x in zip(*kept, strict=True)))
                moved = np.flatnonzero(labels != np.arange(len(frame)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], names=["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(link, "a long, b long")


def verified_links(rows: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text_col: str = "text") -> DataFrame:
    """(a, b, links) of the classes with links: per tile a class, the least class it is linked with, and how many rows its linked classes have."""
    sizes = groups.join(classes.select("node", "n", "copies"), "node")
    blocks = sizes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    texts = rows.select(F.col("_j_row").alias("node"), F.col("doc")[text_col].cast("string").alias("text"), F.col("_j_signature").alias("signature"))
    members = sizes.join(blocks, "root").select("node", "root", "copies", "blocks").join(texts, "node")
    tiles = _tiled(members, "root", "blocks", "node").select("tile", "node", "own", "alone", "copies", "signature", "text")
    least = least_matches(threshold, tolerance)

    def verify(batches):
        for whole in _grouped(batches, "tile"):
            keys = whole["tile"].to_numpy()
            cuts = [0]
            for at in [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]:  # some groups at a time, so that memory stays flat
                if at - cuts[-1] >= TILE or at == len(keys):
                    cuts.append(int(at))
            for x, y in zip(cuts, cuts[1:]):
                frame = whole.iloc[x:y]
                own, alone, nodes, copies = (frame[c].to_numpy() for c in ("own", "alone", "node", "copies"))
                signature = _matrix(frame["signature"])
                sets = shingle_sets(frame["text"].tolist())
                size = np.array([len(s) for s in sets])
                links = np.zeros(len(frame), dtype=np.int64)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b in pairs_within(keys[x:y]):
                    meet = (alone[a] | (own[a] != own[b])) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
                    a, b = survivors(signature, a[meet], b[meet], least)
                    if len(a):
                        both = common_counts(sets, a, b)
                        real = both >= threshold * (size[a] + size[b] - both)
                        a, b = a[real], b[real]
                        np.add.at(links, a, copies[b])
                        np.add.at(links, b, copies[a])
                        found.append((a, b))
                if found:
                    labels = least_labels(len(frame), *(np.concatenate(z) for z in zip(*found, strict=True)))
                    hit = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(nodes[labels[hit]]), pa.array(links[hit])], names=["a", "b", "links"])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(verify, "a long, b long, links long")


def _linked(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: ``doc`` (its columns), ``class`` (least id in its component), ``links``, ``kept``, ``n`` (shingles).

    A link joins two rows whose sets of five-word shingles (lower-case words; a text of one to four words is one shingle)
    have a Jaccard similarity of at least ``threshold``; exact copies are links too. Components of links are classes.
    ``kept`` holds for one row of each: the least id, null ids last, of equal ids the first row. Null texts and texts
    without words have no shingles: each such row is a class of its own, with class id null if its id is. Repeated rows
    are copies. An empty table gives no rows. Other columns pass, whatever their names.
    """
    rows, _ = prepared(docs, text_col)
    own_id = F.col("doc")[id_col].cast("long")
    order = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.col("_j_row").alias("row"))
    classes, _ = stored(
        rows.filter("_j_n > 0").groupBy("_j_h1", "_j_h2").agg(F.min("_j_row").alias("node"), F.count("*").alias("copies"), F.min(order).alias("head"), F.first("_j_n").alias("n"), F.first("_j_bands").alias("bands"), F.first("_j_signature").alias("signature")),
        "classes",
    )
    groups, links_path = components(candidate_links(classes, threshold, tolerance))
    found, _ = stored(verified_links(rows, classes, groups, threshold, tolerance, text_col), "verified")
    forget(docs.sparkSession, links_path)
    roots, _ = components(found.select("a", "b"))
    own = classes.select("_j_h1", "_j_h2", "node", "copies", "head").join(roots, "node", "left").join(found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    own = own.filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    heads = own.groupBy("root").agg(F.min("head").alias("first"))
    marks = own.join(heads, "root").select("_j_h1", "_j_h2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = rows.drop("_j_bands", "_j_signature").join(marks, ["_j_h1", "_j_h2"], "left")
    return joined.select(
        "doc",
        F.when(F.col("first").isNull(), own_id).otherwise(F.col("first.id")).alias("class"),
        F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("_j_row"))).alias("kept"),
        F.col("_j_n").alias("n"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles, kept: a row a document (see ``_linked``)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _linked(own, **options).select("doc.doc_id", F.col("class").alias("class_id"), F.col("links").alias("n_links"), F.col("n").alias("n_shingles"), "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, its columns as they are. Texts without words all stay."""
    return _linked(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
