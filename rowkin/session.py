"""Session helpers: a tuned local session for tests and benches, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rowkin")
    own = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in own.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver found it; once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="rowkin-zip-"), "rowkin.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def register_functions(spark: SparkSession) -> None:
    """The string metrics as SQL functions: jaro_winkler, token_set, sound_keys."""
    from rowkin.functions import metrics, phonetics

    ship_package(spark)
    for name, own in (("jaro_winkler", metrics.jaro_winkler_udf), ("token_set", metrics.token_set_udf), ("sound_keys", phonetics.sound_keys_udf)):
        spark.udf.register(name, own)
