"""Streaming forms: counts by period, and records merged as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkin.operators import runs
from rowkin.sources.commits import Files, Store
from rowkin.storage import shared_dir


def volume(events: DataFrame, ts: str, width: str, late: str = "1 day") -> DataFrame:
    """Events by tumbling window; rows later than the watermark are left out once their window has gone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("period"), "n")


def caught_up(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregation over all that is there (AvailableNow) and reads its complete result back."""
    import uuid

    base = f"{shared_dir(stream.sparkSession)}/rowkin-{label}-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under a path, as they come; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def merging(root: str, key: list[str], content: list[str], order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch of records into the versions under ``root``, a whole table a batch (``v=<batch>``) for tables that stay small.

    Of rows that share a key in a batch the first by ``order`` counts (by content, if nothing is said). Each batch goes
    on from the newest one before it, whatever its number, so a repeated batch gives the same table.
    """

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        one = _one_a_key(df, key, content, order)
        version = F.lit(batch).cast("long")
        done = [int(n[2:]) for n in Files(spark, root).names("") if n.startswith("v=") and int(n[2:]) < batch]
        out = runs.merge_versions(spark.read.parquet(f"{root}/v={max(done)}"), one, key, content, version) if done else one.withColumn("is_current", F.lit(True)).withColumn("version", version)
        out.write.mode("overwrite").parquet(f"{root}/v={batch}")

    return merge


def _one_a_key(df: DataFrame, key: list[str], content: list[str], order: list[Column] | None) -> DataFrame:
    return runs.latest(df, key, [*(order or []), *(F.asc_nulls_first(c) for c in content)]).select(*key, *content)


def appending(root: str, key: list[str], content: list[str], order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds what is new or changed in a batch to the log of versions under ``root``; ``versions`` reads it.

    Of rows that share a key in a batch the first by ``order`` counts (by content, if nothing is said), so the choice is
    the same each time. A batch is a commit by its number: a repeated one adds nothing, one that broke off left nothing,
    and numbers may be skipped. Only rows of keys that the batch names are written; the log is read, not rewritten.
    """

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        store = Store(spark, root)
        if f"batch:{batch}" in store.tags():
            return
        one = _one_a_key(df, key, content, order)
        known = versions(spark, root, key)
        if known is not None:
            same = [one[c].eqNullSafe(F.col(f"_o.{c}")) for c in (*key, *content)]
            one = one.join(known.where("is_current").alias("_o"), reduce(lambda a, b: a & b, same), "left_anti")
        store.commit(f"batch:{batch}", append={"log": one.withColumn("version", F.lit(batch).cast("long"))})

    return merge


def versions(spark: SparkSession, root: str, key: list[str]) -> DataFrame | None:
    """All versions of all keys with ``is_current``; None before the first batch."""
    store = Store(spark, root)
    if "log" not in store.names():
        return None
    newest = F.max("version").over(Window.partitionBy(*key))
    return store.table("log").withColumn("is_current", F.col("version") == newest)
