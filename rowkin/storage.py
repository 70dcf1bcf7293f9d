"""Staged tables: written once into the folder that all executors share, and read back, which cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where that is unset. A cluster must name it: executors don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rowkin-stage-")
    return "file://" + _OWN[app]


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block leave no generated method uncompiled: HotSpot interprets those of more than 8,000 bytes, which takes many times as long as their operators one by one."""
    key, most = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(key, None)
    if before is not None and int(before) <= most:
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/rowkin-{label}-{uuid.uuid4().hex}"
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
