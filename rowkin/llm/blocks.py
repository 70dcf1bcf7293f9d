"""Search of query rows against all rows, tile by tile: blocks of queries meet blocks of candidates, and tiles' bests are merged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """id, vec, dim of the rows that take part: an id, and a vector of finite components (and not all zero, unless allowed)."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.lit(True) if allow_zero else F.exists("vec", lambda x: x != 0)
    return own.filter((F.size("vec") > 0) & finite).filter(F.coalesce(nonzero, F.lit(False))).withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return np.asarray(pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else [], dtype=np.float64).reshape(-1, dim)


def search_tiles(rows: DataFrame, is_query: Column, kernel: Callable, k: int, score_type: str, query_cells: int, candidate_cells: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query, ties to the smaller id.

    Blocks are hashed so that they hold about so many components, whatever the dimension, which bounds a task's memory.
    kernel(query matrix, query ids, candidate matrix, candidate ids) returns arrays (query ids, candidate ids, scores)
    that hold the ``k`` best of the tile. Each query block meets each candidate block once; ids that are equal never
    meet. Vectors are compared with those of their own dimension. Of queries that share an id, the one with the least
    vector searches.
    """
    queries = rows.filter(is_query).groupBy("id", "dim").agg(F.min("vec").alias("vec"))
    cells = rows.agg(F.sum("dim"), F.sum(F.when(is_query, F.col("dim")))).first()
    n, m = (max(1, -(-(have or 0) // size)) for have, size in zip(cells, (candidate_cells, query_cells), strict=True))
    side = lambda df, own, other, blocks, others: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left, right = side(queries, "q", "c", m, n), side(rows, "c", "q", n, m)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score_type == "double" else pa.int64())])

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        dim = a.column("dim")[0].as_py()
        found = kernel(matrix(a.column("vec"), dim), a.column("id").to_numpy(), matrix(b.column("vec"), dim), b.column("id").to_numpy())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, schema.types, strict=True)], schema=schema)

    keys = ["dim", "q", "c"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, best first, ties to the smaller id. Scores: integers or doubles."""
    order = np.lexsort((ids, ~scores if scores.dtype.kind == "i" else -scores, query))
    own = query[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[place < k]
