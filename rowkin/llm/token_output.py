"""Token-id files: documents in ascending id order, their ids in patched frame-of-reference (PFOR) blocks.

A *chunk* holds whole documents: a table of ids per document, an index of block starts, and blocks of 1,024 values. A
block stores its minimum, the other values less that minimum packed at the width that covers ``share`` of them, and an
exception list (position, high bits) for the rest. Chunks are rows of a Parquet table, so any store Spark reaches holds them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkin.llm.common import shared_dir
from rowkin.llm.tokens import END_ID, default_vocabulary, encoded

BLOCK = 1024
CHUNK_IDS = 1 << 19
MAGIC = b"PFR1"
CHUNKS = "part int, seq int, part_start long, n_docs int, n_ids long, doc_ids binary, doc_lengths binary, payload binary"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as bits, low bit first: 32 values fill ``width`` words of 32 bits."""
    values = values.reshape(len(values), -1, 32)
    words = np.zeros((*values.shape[:2], width), dtype=np.uint32)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        words[:, :, word] |= values[:, :, k] << np.uint32(shift)
        if shift + width > 32:
            words[:, :, word + 1] |= values[:, :, k] >> np.uint32(32 - shift)
    return words.reshape(len(values), -1).astype("<u4", copy=False).view(np.uint8)


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view("<u4").reshape(len(raw), -1, width)
    out = np.zeros((*words.shape[:2], 32), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        out[:, :, k] = words[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, :, k] |= words[:, :, word + 1] << np.uint32(32 - shift)
        out[:, :, k] &= mask
    return out.reshape(len(raw), -1)


def pfor_encode(values: np.ndarray, share: float = 0.95, block: int = BLOCK) -> bytes:
    """uint32 values to bytes: magic, count, block size; then minima, widths, exception counts, block starts; then blocks."""
    values = np.asarray(values, dtype=np.uint32)
    n, blocks = len(values), -(-len(values) // block)
    grid = np.full(blocks * block, values[-1] if n else 0, dtype=np.uint32)
    grid[:n] = values
    grid = grid.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None] if blocks else grid
    at = min(block - 1, int(share * block))
    cover = np.partition(rest, at, axis=1)[:, at] if blocks else low
    widths = np.ceil(np.log2(cover.astype(np.float64) + 1)).astype(np.uint8)
    high = rest >> np.minimum(widths, 31)[:, None].astype(np.uint32) if blocks else rest
    high[widths == 32] = 0
    rows, places = np.nonzero(high)
    exceptions = np.bincount(rows, minlength=blocks).astype(np.uint16) if blocks else np.zeros(0, np.uint16)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            mask = np.uint32((1 << int(w)) - 1)
            for i, row in zip(own, _packed(rest[own] & mask, int(w)), strict=True):
                body[i] = row.tobytes()
    ends = np.cumsum(exceptions.astype(np.int64))
    for i in np.flatnonzero(exceptions):
        own = slice(ends[i] - exceptions[i], ends[i])
        body[i] += places[own].astype("<u2").tobytes() + high[rows[own], places[own]].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, body)]).astype("<u4")
    return b"".join([MAGIC, struct.pack("<QII", n, block, blocks), low.astype("<u4").tobytes(), widths.tobytes(), exceptions.astype("<u2").tobytes(), starts.tobytes(), *body])


def pfor_decode(data: bytes) -> np.ndarray:
    """The values that ``pfor_encode`` was given."""
    if data[:4] != MAGIC:
        raise ValueError("not a PFOR chunk")
    n, block, blocks = struct.unpack_from("<QII", data, 4)
    at = 20
    parts = []
    for kind, size in (("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u4", blocks + 1)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    low, widths, exceptions, starts = parts
    raw = np.frombuffer(data, np.uint8, offset=at)
    out = np.zeros((blocks, block), dtype=np.uint32)
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            size = block * int(w) // 8
            out[own] = _unpacked(raw[starts[own].astype(np.int64)[:, None] + np.arange(size)], int(w))
    for i in np.flatnonzero(exceptions):
        k, b = int(exceptions[i]), int(starts[i]) + block * int(widths[i]) // 8
        place = np.frombuffer(raw[b : b + 2 * k].tobytes(), "<u2")
        out[i, place] |= np.frombuffer(raw[b + 2 * k : b + 6 * k].tobytes(), "<u4") << np.uint32(widths[i])
    return (out + low[:, None]).reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_ids: int = CHUNK_IDS, added_tokens: bool = True) -> None:
    """Writes the ids of all documents (null text: the end id alone) under ``path``, ascending by id, null ids first.

    Rows that share an id follow each other, ordered by text. Other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = int(END_ID).to_bytes(4, "little")
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), "<u4")
            key = np.array([k is not None for k in keys], dtype=np.uint8).tobytes() + np.array([k or 0 for k in keys], dtype="<i8").tobytes()
            row = (part, seq, start, len(keys), len(values), zlib.compress(key, 1), pfor_encode(np.array([len(x) // 4 for x in ids])), pfor_encode(values))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for key, coded in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), vocabulary, added_tokens), strict=True):
                keys.append(key)
                ids.append(coded + end)
                held += len(ids[-1]) // 4
                if held >= chunk_ids:
                    yield chunk()
                    seq, start, keys, ids, held = seq + 1, start + held, [], [], 0
        if keys:
            yield chunk()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a file set: doc_id, start, n_tokens, ids_crc32, decoded from the blocks."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("_first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                key, n = zlib.decompress(row["doc_ids"]), row["n_docs"]
                lengths = pfor_decode(row["doc_lengths"]).astype(np.int64)
                ids = pfor_decode(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (b - m) : 4 * b]) for m, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
                null = np.frombuffer(key[:n], np.uint8) == 0
                columns = (pa.array(np.frombuffer(key[n:], "<i8"), mask=null), pa.array(ends - lengths + row["part_start"] + row["_first"]), pa.array(lengths), pa.array(crc, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), names=names)

    placed = chunks.join(F.broadcast(parts.select("part", "_first")), "part")  # a row a written partition
    return placed.select("part_start", "_first", "n_docs", "doc_ids", "doc_lengths", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None, added_tokens: bool = True) -> DataFrame:
    """Writes the documents' ids into the shared folder and returns what the files hold."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/rowkin-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary, added_tokens=added_tokens)
    return read_ids(spark, path)
