"""Data sets with a manifest: ordered files, and digests of their content that a scan can check.

Digests are sums of row hashes in two lanes of 64 bits, so they depend neither on the order of rows nor on how many
files there are, and they are combined before anything is shuffled. The manifest holds no time, so equal rows give equal manifests but
for the list of files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators.runs import row_digest
from rowkin.sources.commits import Files

MANIFEST = "manifest.json"


class Changed(ValueError):
    """Files that are not what the manifest says; ``files`` names them."""

    def __init__(self, files: list[str]):
        super().__init__(f"changed, missing or unknown: {', '.join(files)}")
        self.files = files


def _lane(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 16), 16, 10).cast("decimal(20,0)")


def digests(df: DataFrame, by: list[Column], columns: list[str] | None = None) -> DataFrame:
    """(by..., n, digest): of each group the rows and 128 bits of their content, whatever their order."""
    d = row_digest(df, columns or df.columns)
    lanes = df.select(*by, _lane(d, 1).alias("_a"), _lane(d, 17).alias("_b"))
    names = [c for c in lanes.columns if c not in ("_a", "_b")]
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    word = lambda c: F.lpad(F.hex(F.conv((F.sum(c) % two64).cast("string"), 10, -10).cast("long")), 16, "0")
    return lanes.groupBy(*names).agg(F.count("*").alias("n"), F.lower(F.concat(word("_a"), word("_b"))).alias("digest"))


def _sum(found: list[tuple[int, str]]) -> list:
    lanes = [sum(int(d[k : k + 16], 16) for _, d in found) % 2**64 for k in (0, 16)]
    return [sum(n for n, _ in found), "".join(f"{x:016x}" for x in lanes)]


def _files(df: DataFrame) -> dict[str, list]:
    """File name, rows and digest of each file: what reaches the driver is a row a file, as the manifest has."""
    found = digests(df.withColumn("_file", F.col("_metadata.file_name")), [F.col("_file")], [c for c in df.columns])
    return {r["_file"]: [r["n"], r["digest"]] for r in found.collect()}


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark, path).read(MANIFEST))


def write_dataset(tables: dict[str, tuple[DataFrame, list[str]]], path: str, files: int | None = None) -> dict:
    """Writes each table ordered by its keys, a range of them a file (at most ``files``), and the manifest last; returns the manifest.

    tables: name, (rows, keys). A table's entry: schema, keys, n, digest, and n and digest of each file. Before the
    manifest is there, ``scan`` finds no data set, so a writer that was killed leaves none.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    at = Files(spark, path)
    own, manifest = uuid.uuid4().hex, {}
    for name, (df, keys) in tables.items():
        folder = f"{name}-{own}"
        df.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys).write.parquet(f"{path}/{folder}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        per = _files(spark.read.schema(ddl).parquet(f"{path}/{folder}"))
        n, digest = _sum([tuple(v) for v in per.values()])
        manifest[name] = {"folder": folder, "schema": ddl, "keys": keys, "n": n, "digest": digest, "files": per}
    at.delete(MANIFEST)
    draft = f".{MANIFEST}.{own}"
    stream = at.fs.create(at._path(draft), True)
    stream.write(bytearray(json.dumps({"tables": manifest}, sort_keys=True, indent=1).encode()))
    stream.close()
    at.fs.rename(at._path(draft), at._path(MANIFEST))
    return {"tables": manifest}


def scan(spark: SparkSession, path: str, name: str, verify: bool = True) -> DataFrame:
    """A table of a data set. ``verify`` reads it once beforehand and refuses files that were changed, went or came."""
    entry = read_manifest(spark, path)["tables"][name]
    df = spark.read.schema(entry["schema"]).parquet(f"{path}/{entry['folder']}")
    if verify:
        found = _files(df)
        off = sorted(f for f in found.keys() | entry["files"].keys() if found.get(f) != entry["files"].get(f))
        if off:
            raise Changed(off)
    return df


def same_content(a: dict, b: dict) -> bool:
    """Whether two manifests stand for the same rows, however they are dealt to files."""
    short = lambda m: {n: (t["schema"], t["n"], t["digest"]) for n, t in m["tables"].items()}
    return short(a) == short(b)
