"""A session with the settings that the operators expect, and the library's code for its workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "querypulse", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and the RocksDB state store for stateful streams; further settings by keyword with _ for dots."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import the library where it is installed by path only; once is enough, more do no harm."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = os.pathsep.join([env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
