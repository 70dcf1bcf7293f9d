"""Helpers that the corpus operators share: stored tables, whole groups from sorted partitions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.storage import shared_dir


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs in this block send texts to Python in batches of at most ``size``, which bounds what both sides of a task hold."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes ``df`` once into the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowkin-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Returns the memory that this worker has freed to the system, where the C library can: idle workers count against an executor too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_groups(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups batches of a partition sorted by ``key`` so that no group is split between two frames."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        keys = frame[key].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 arrays (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
