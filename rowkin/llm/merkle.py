"""Merkle manifest of a dataset: a tree of sources over trees of documents, with a proof for every document.

Leaves of a tree are dealt to aligned blocks of ``FANOUT ** HEIGHT``, one row a block. A block's root comes from a
treehash stack; block roots are the leaves of the next round, until a tree has one. Back down, each block walks its
leaves in order: per level it holds the run that the authentication path goes through and a treehash that takes one
leaf of the run after it at each step, so that it is complete when the path gets there. A block's own path is followed
by the path of its root, which all its leaves share and which is joined once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm.common import crc_fold, stored

FANOUT = 16
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<at:int,siblings:string>>"


# -- leaves ---------------------------------------------------------------------------------------------------------


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The digest (binary) of a row: each column as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, presented: the digest of each row, and where ``tampered`` holds that of the row with A-Z of its text in lower case."""
    own = [docs[f] for f in fields]
    presented = F.lit(None).cast("binary")
    if tampered is not None:
        presented = F.when(tampered, leaf_hash([F.translate(c, UPPER, LOWER) if f == "text" else c for f, c in zip(fields, own, strict=True)]))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf_hash(own).alias("leaf"), presented.alias("presented"))


# -- nodes ----------------------------------------------------------------------------------------------------------


def digest(parts: Sequence[bytes]) -> bytes:
    """H of hex texts, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Treehash:
    """Takes leaves one by one and keeps, per level below ``level``, the nodes of the run that is not full yet; ``run`` is the run at ``level``."""

    def __init__(self, level: int, fanout: int):
        self.fanout = fanout
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def push(self, leaf: bytes) -> None:
        stack, k = self.stack, 0
        stack[0].append(leaf)
        while k + 1 < len(stack) and len(stack[k]) == self.fanout:
            stack[k + 1].append(digest(stack[k]))
            stack[k] = []
            k += 1

    def run(self) -> list[bytes]:
        """The run at the top level; runs below that have ended short become nodes."""
        for k, nodes in enumerate(self.stack[:-1]):
            if nodes:
                self.stack[k + 1].append(digest(nodes))
                self.stack[k] = []
        return self.stack[-1]


def height_of(block: int, n: int, fanout: int = FANOUT, height: int = HEIGHT) -> int:
    """Levels above the leaves of a block: only a first block that is not full stands alone and may be lower."""
    if block:
        return height
    low = 0
    while fanout**low < n:
        low += 1
    return low


def block_root(leaf: Sequence[bytes], levels: int, fanout: int = FANOUT) -> bytes:
    """The node ``levels`` above the leaves of a block."""
    tree = Treehash(levels, fanout)
    for x in leaf:
        tree.push(x)
    return tree.run()[0]


def traverse(leaf: Sequence[bytes], levels: int, fanout: int = FANOUT) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """For each leaf its place, and the siblings before and after, at every level from its own up.

    Holds per level the present run and the stack of the coming one: the coming run of level k has fanout ** (k + 1)
    leaves, as many as there are steps until the path enters it.
    """
    n = len(leaf)
    spans = [fanout ** (k + 1) for k in range(levels)]
    present, coming = [], []
    for k, span in enumerate(spans):
        first = Treehash(k, fanout)
        for x in leaf[:span]:
            first.push(x)
        present.append(first.run())
        coming.append(Treehash(k, fanout))
    path: list[tuple[int, bytes, bytes]] = [(0, b"", b"")] * levels
    for i in range(n):
        for k, span in enumerate(spans):
            if i and i % span == 0:
                present[k] = coming[k].run()
                coming[k] = Treehash(k, fanout)
            step = span // fanout
            if i % step == 0:
                at = i // step % fanout
                path[k] = (at, b"".join(present[k][:at]), b"".join(present[k][at + 1 :]))
        yield path
        for k, span in enumerate(spans):
            if i + span < n:
                coming[k].push(leaf[i + span])


# -- trees ----------------------------------------------------------------------------------------------------------


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (a written table with ``tree``, and ``row`` that tells rows apart) with ``rank``, their place in their tree, nulls first.

    Ranges of (tree, order, row) are sorted apart, so a tree of any size and any number of equal keys is split; what
    stands in earlier ranges is added from a table of at most a row a range, for only a range's first tree can go on.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row")]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = object(), 0
        for batch in batches:
            found = []
            for key in batch.column("tree").to_pylist():
                place = place + 1 if key == last else 0
                last = key
                found.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "_place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    placed = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).mapInArrow(places, f"{schema}, _part int, _place long")
    placed, _ = stored(placed, "ranks")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    runs = placed.groupBy("_part", "tree").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before > 0")
    runs = runs.select(F.col("_part").alias("_p"), F.col("tree").alias("_t"), "_before")
    joined = placed.join(F.broadcast(runs), (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t")), "left")  # at most a row a range
    return joined.withColumn("rank", F.col("_place") + F.coalesce("_before", F.lit(0))).select(*nodes.columns, "rank")


def hexed(values: Sequence[bytes]) -> list[bytes]:
    return [v.hex().encode() for v in values]


@dataclass
class Forest:
    """Trees by ``tree``: ``tables`` of blocks from the leaves up, one row a block of at most fanout ** height nodes, and ``roots`` (tree, digest)."""

    fanout: int
    height: int
    tables: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame, payload: Sequence[str] = (), fanout: int = FANOUT, height: int = HEIGHT) -> Forest:
    """The forest over nodes with tree, rank and digest; blocks of leaves carry ``payload`` along."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, digests in zip(batch.column("block").to_pylist(), batch.column("digests"), strict=True):
                leaf = hexed(digests.as_py())
                out.append(bytes.fromhex(block_root(leaf, height_of(block, len(leaf), fanout, height), fanout).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(out, pa.binary())], names=["tree", "rank", "digest"])

    tables: list[DataFrame] = []
    while True:
        rows = F.sort_array(F.collect_list(F.struct("rank", "digest", *(() if tables else payload))))  # at most a block
        table, _ = stored(nodes.groupBy("tree", F.floor(F.col("rank") / fanout**height).alias("block")).agg(rows.alias("rows")), "blocks")
        nodes, _ = stored(table.select("tree", "block", F.col("rows.digest").alias("digests")).mapInArrow(roots, "tree string, rank long, digest binary"), "roots")
        tables.append(table)
        if not nodes.where("rank > 0").limit(1).count():
            return Forest(fanout, height, tables, nodes.select("tree", "digest"))


#: A level of a path: the node's place in its run, and the run's other nodes as hex text.
Level = tuple[int, bytes, bytes]
_PATH = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))


def as_rows(path: Sequence[Level]) -> list[dict]:
    return [{"at": at, "siblings": (before + after).decode()} for at, before, after in path]


def as_levels(path: Sequence[dict]) -> list[Level]:
    return [(p["at"], p["siblings"][: 64 * p["at"]].encode(), p["siblings"][64 * p["at"] :].encode()) for p in path]


def walked(forest: Forest, k: int, upper: DataFrame | None, columns: dict[str, tuple[str, pa.DataType]], emit: Callable[[dict, dict, bytes, list[Level]], tuple]) -> DataFrame:
    """``emit(block, row, leaf, path)`` for each node of table ``k``. ``upper``: for each block as a node (tree, rank) its ``path`` and columns to hand down."""
    table, fanout, height = forest.tables[k], forest.fanout, forest.height
    if upper is not None:
        up = upper.withColumnsRenamed({"tree": "_t", "rank": "_b"})
        table = table.join(up, (F.col("block") == F.col("_b")) & F.col("tree").eqNullSafe(F.col("_t"))).drop("_t", "_b")
    arrow = pa.schema([(name, kind) for name, (_, kind) in columns.items()])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                leaf, shared = hexed([r["digest"] for r in block["rows"]]), as_levels(block.get("path") or ())
                paths = traverse(leaf, height_of(block["block"], len(leaf), fanout, height), fanout)
                for row, x, own in zip(block["rows"], leaf, paths, strict=True):
                    held.append(emit(block, row, x, own + shared))
                    if len(held) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

    return table.mapInArrow(walk, ", ".join(f"{name} {sql}" for name, (sql, _) in columns.items()))


NODE = {"tree": ("string", pa.string()), "rank": ("long", pa.int64()), "subroot": ("string", pa.string()), "path": (PATH, _PATH)}


def source_paths(sources: Forest) -> DataFrame:
    """tree (the source), rank 0, subroot, path: from each source's root to the root of all."""
    upper = None
    for k in range(len(sources.tables) - 1, 0, -1):
        upper = walked(sources, k, upper, NODE, lambda block, row, leaf, path: (block["tree"], row["rank"], None, as_rows(path)))
    return walked(sources, 0, upper and upper.drop("subroot"), NODE, lambda block, row, leaf, path: (row["source"], 0, leaf.decode(), as_rows(path)))


def fold(leaf: bytes, path: Sequence[Level]) -> bytes:
    """The root that a leaf and its siblings give."""
    for _, before, after in path:
        leaf = digest((before, leaf, after))
    return leaf


def proved(own: DataFrame, with_path: bool = False, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """For ``leaves()``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``with_path`` the path.

    Per source the leaves ascend by doc_id (nulls first, ties by digest; rows that are equal take the places there are),
    sources by UTF-8 bytes, null first. ``path`` has, per level up to the root, the place in the run and the other
    nodes of the run as hex text; proof_sha256 is the digest of all these; folded_root is recomputed from ``presented``
    (or else the leaf) and the path. No rows: no rows.
    """
    spark = own.sparkSession
    own, _ = stored(own.select("doc_id", F.col("source").alias("tree"), F.col("leaf").alias("digest"), "presented").withColumn("row", F.monotonically_increasing_id()), "leaves")
    forest = grown(ranked(own, ("doc_id", "digest")), ("doc_id", "presented"), fanout, height)
    tops = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", F.monotonically_increasing_id().alias("row"))
    sources = grown(ranked(tops, ("source",)), ("source",), fanout, height)
    top = sources.roots.select(F.lower(F.hex("digest"))).head()  # one row
    root = top[0] if top else ""
    upper, _ = stored(source_paths(sources), "paths")
    for k in range(len(forest.tables) - 1, 0, -1):
        upper, _ = stored(walked(forest, k, upper, NODE, lambda block, row, leaf, path: (block["tree"], row["rank"], block["subroot"], as_rows(path))), "paths")

    def emit(block: dict, row: dict, leaf: bytes, path: list[Level]) -> tuple:
        proof = digest([x for _, before, after in path for x in (before, after)]).decode()
        folded = fold(row["presented"].hex().encode() if row["presented"] is not None else leaf, path).decode()
        return (row["doc_id"], block["tree"], leaf.decode(), block["subroot"], root, proof, folded, folded == root, *([as_rows(path)] if with_path else []))

    text = ("string", pa.string())
    columns = {"doc_id": ("long", pa.int64()), "source": text, "leaf": text, "subroot": text, "root": text, "proof_sha256": text, "folded_root": text, "verified": ("boolean", pa.bool_())}
    return walked(forest, 0, upper, columns | ({"path": (PATH, _PATH)} if with_path else {}), emit)


# -- the manifest as a table ----------------------------------------------------------------------------------------


def write_manifest(docs: DataFrame, path: str, fields: Sequence[str] = FIELDS) -> None:
    """Writes doc_id, source, leaf, subroot, root and the authentication path of every row of ``docs`` as Parquet."""
    proved(leaves(docs, fields), with_path=True).select("doc_id", "source", "leaf", "subroot", "root", "path").write.parquet(path)


def verify(docs: DataFrame, manifest: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, source, status of every row of ``docs`` against a manifest, and of what it lacks.

    ``verified``: a path that the manifest holds for this doc_id and source leads from the row to the root;
    ``changed``: none does; ``unknown``: the manifest has no such row; ``missing``: ``docs`` has no such row. The fold
    runs as a Spark expression. Nulls equal nulls.
    """
    own = leaves(docs, fields).withColumn("row", F.monotonically_increasing_id())
    own, _ = stored(own.select("doc_id", "source", "leaf", "row"), "presented")
    told = manifest.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "path", "root")

    def up(node: Column, p: Column) -> Column:
        return F.sha2(F.concat(F.substr(p["siblings"], F.lit(1), p["at"] * 64), node, F.substr(p["siblings"], p["at"] * 64 + 1)).cast("binary"), 256)

    met = own.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "full")
    holds = F.aggregate("path", F.lower(F.hex("leaf")), up) == F.col("root")
    status = F.when(F.col("row").isNull(), "missing").when(F.col("root").isNull(), "unknown").when(holds, "verified").otherwise("changed")
    each = met.select(F.when(F.col("row").isNull(), F.col("_d")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("row").isNull(), F.col("_s")).otherwise(F.col("source")).alias("source"), "row", status.alias("status"))
    best = F.max(F.when(F.col("status") == "verified", "verified"))
    known = each.where("row is not null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.coalesce(best, F.max("status")).alias("status"))
    return known.drop("row").unionByName(each.where("row is null").drop("row"))


def tamper_proofs(docs: DataFrame) -> DataFrame:
    """The proofs of all documents, rows whose crc32 of the doc_id is divisible by 5 presented with their text's A-Z in lower case.

    Any column may be null (``-`` in the leaf); a null doc_id is never tampered with; an empty or caseless text stays as it is and verifies.
    """
    return proved(leaves(docs, tampered=crc_fold(docs["doc_id"]) == 0)).drop("source")
