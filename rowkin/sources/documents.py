"""JSON documents: the answer cache in files, configs, and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators.decide import Bundle
from rowkin.operators.learn import Model
from rowkin.schema import FIELDS
from rowkin.sources.commits import Files

#: Letters of a key that name its folder.
SHARD = 2


def file_cache(spark: SparkSession, root: str) -> DataFrame:
    """(cache_key, payload, readable) of a cache with a JSON file a key in folders of the key's first letters. A file cut off half-way is there, but not readable: whoever looks it up misses."""
    found = spark.read.option("wholetext", True).text(f"{root}/{'?' * SHARD}/*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("cache_key"), F.col("value").alias("payload"))
    return found.withColumn("readable", F.try_parse_json("payload").isNotNull())


def looked_up(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """``asked`` (cache_key) with payload and ``hit``."""
    good = cache.filter("readable").select("cache_key", "payload")
    return asked.join(good, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())


def _put(spark: SparkSession, path: str, value) -> None:
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder)
    draft = f".{name}.{uuid.uuid4().hex}"
    stream = files.fs.create(files._path(draft), True)
    stream.write(bytearray(json.dumps(value, sort_keys=True, indent=1, default=str).encode()))
    stream.close()
    files.delete(name)
    files.fs.rename(files._path(draft), files._path(name))


def write_config(spark: SparkSession, path: str, bundles: dict[str, Bundle], **more) -> None:
    """A config as JSON: tables by field, share, knots and cuts of each kind."""
    body = {k: {"m": dict(zip(FIELDS[k], b.model.m, strict=True)), "u": dict(zip(FIELDS[k], b.model.u, strict=True)), "share": b.model.share, "knots": b.knots, "accept": b.accept, "reject": b.reject} for k, b in bundles.items()}
    _put(spark, path, {"bundles": body, **more})


def read_config(spark: SparkSession, path: str) -> dict[str, Bundle]:
    """What ``write_config`` wrote; a kind whose tables lack a field, or have levels too few or too many, is refused."""
    folder, _, name = path.rpartition("/")
    out = {}
    for kind, b in json.loads(Files(spark, folder).read(name))["bundles"].items():
        for side in ("m", "u"):
            if {f: len(row) for f, row in b[side].items()} != {f: len(levels) for f, levels in FIELDS[kind].items()}:
                raise ValueError(f"the tables of {kind} in {path} do not fit the fields")
        tables = [[b[side][f] for f in FIELDS[kind]] for side in ("m", "u")]
        out[kind] = Bundle(Model(kind, *tables, b["share"]), [tuple(x) for x in b["knots"]], b["accept"], b["reject"])
    return out


def write_report(spark: SparkSession, path: str, most: int = 10_000, **parts: DataFrame | dict | list) -> None:
    """A JSON report of small tables and values; a table of more than ``most`` rows is refused rather than cut."""
    out = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = part.limit(most + 1).toJSON().collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows")
            part = [json.loads(r) for r in rows]
        out[name] = part
    _put(spark, path, out)
