"""Session settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def session(app: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; state stores of streams in RocksDB."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for a Spark application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_marketloom_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="marketloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "marketloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    before = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = before
    sc._marketloom_shipped = True
    return spark


def extended(schema: StructType, more: str) -> StructType:
    """A schema with further fields, as a new one."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
