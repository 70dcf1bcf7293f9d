"""Sources and sinks of the engine's tables, in their fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructType

from rowkin import schema


def cleaned(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a schema, whatever types the files have: blank texts and NaN are null, bad dates are null, absent columns are null."""
    have = dict(df.dtypes)

    def column(field) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType)
        c = F.col(field.name)
        if have[field.name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        if isinstance(field.dataType, StringType):
            return F.nullif(F.trim(c.cast("string")), F.lit(""))
        if isinstance(field.dataType, DateType) and have[field.name] == "string":
            return F.try_to_timestamp(F.left(F.trim(c), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
        return c.cast("double") if isinstance(field.dataType, DoubleType) else c.try_cast(field.dataType)

    return df.select(*(column(f).alias(f.name) for f in StructType.fromDDL(ddl)))


def providers(spark: SparkSession, path: str) -> DataFrame:
    """The master; organizations are flagged, and a missing status is ACTIVE."""
    df = cleaned(spark.read.parquet(path), schema.PROVIDERS)
    return df.fillna({"is_organization": False, "status": "ACTIVE"})


def sanctions(spark: SparkSession, path: str) -> DataFrame:
    return cleaned(spark.read.parquet(path), schema.SANCTIONS).fillna({"is_organization": False})


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected outcomes; the corruption profile is JSON, kept as a variant-free map of texts."""
    df = cleaned(spark.read.parquet(path), schema.TRUTH)
    return df.withColumn("corruption_profile", F.from_json("corruption_profile", "map<string,string>"))


def scoped(df: DataFrame, file_id: str | None = None) -> DataFrame:
    """Rows of one file, or the current rows of all."""
    return df.filter(F.col("file_id") == file_id) if file_id else df.filter("is_current")


def batch(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A window of rows in their stable order, full even where ordinals have gaps."""
    return df.orderBy("ordinal").offset(max(0, offset)).limit(limit)


def current(df: DataFrame) -> DataFrame:
    """Rows that no newer row supersedes."""
    return df.filter("superseded_by is null")


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Results of a run in a partition of its own: a retry replaces that partition alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def absent(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored, one a key: what insert-if-absent appends."""
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def audit_rows(df: DataFrame, action: str, entity: str, entity_id: Column, before: Column, after: Column, actor: str = "system") -> DataFrame:
    """Rows of the append-only audit log for a batch of changes."""
    return df.select(F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.lit(actor).alias("actor"), F.to_json(before).alias("before"), F.to_json(after).alias("after"))


def new_blobs(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """Uploaded files whose content (SHA-256) is not stored yet; of equal ones the first path stays."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    one = found.groupBy("sha256").agg(F.min_by("path", "path").alias("path"), F.min("length").alias("length"))
    return one.join(stored.select("sha256"), "sha256", "left_anti")
