"""What every operator that runs Python on executors needs: code on the workers' path, Arrow helpers, shared storage."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Keys of more than this share of all rows are joined by broadcast: so many at most.
MOST_HEAVY = 100_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is installed by path only (idempotent)."""
    env = spark.sparkContext.environment
    known = os.pathsep.join([env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]).split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares. Where it is unset, a scratch folder in local mode, as in tests; else an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/spark-{uuid.uuid4().hex[:10]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, few: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join; few has a row for each key and in weight its number of rows. Keys heavier than total / MOST_HEAVY, so MOST_HEAVY of them at most, are broadcast; the others are dealt out evenly."""
    bound = max(1000, total // MOST_HEAVY)
    heavy, light = F.broadcast(few.where(F.col(weight) > bound).drop(weight)), few.where(F.col(weight) <= bound).drop(weight)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on))


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]
