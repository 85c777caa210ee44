"""Streams in, topics out, and stored tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypulse.functions.columns import orderable
from querypulse.operators.traces import checkpointed
from querypulse.operators.validate import record_key, route_topic
from querypulse.schemas import KEEP_DAYS, SORT_KEYS, TIME_COLUMN, TOPICS, VERSIONED


def read_stream(spark: SparkSession, source: str, topics: tuple[str, ...] = TOPICS, kind: str = "kafka", **options: str) -> DataFrame:
    """Raw records (value: text, topic) of topics from the earliest on. source: brokers, or for kind "text" a folder of JSON lines."""
    if kind == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", source).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        return reader.options(**options).load().select(F.col("value").cast("string").alias("value"), "topic")
    return spark.readStream.format("text").options(**options).load(source).withColumn("topic", F.lit(",".join(topics)))


def to_topic(df: DataFrame, kind: str) -> DataFrame:
    """(key, value, topic) for a Kafka sink; failed events go to their own topic."""
    topic = route_topic() if kind == "events" else F.lit(kind)
    return df.select(record_key(kind).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), topic.alias("topic"))


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append to a table, by day and sorted by the table's key within files."""
    dated = df.withColumn("event_date", F.to_date(TIME_COLUMN[table]))
    dated.sortWithinPartitions("event_date", *SORT_KEYS[table]).write.mode(mode).partitionBy("event_date").parquet(f"{path}/{table}")


def stream_to_table(df: DataFrame, path: str, table: str, checkpoint: str):
    """Append each micro-batch; the checkpoint keeps the offsets. A batch that is run again after a failure replaces what it wrote: it has a partition of its own, by its number."""

    def put(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("event_date", F.to_date(TIME_COLUMN[table])).withColumn("batch", F.lit(number))
        rows = dated.sortWithinPartitions("event_date", *SORT_KEYS[table]).write.option("partitionOverwriteMode", "dynamic")
        rows.mode("overwrite").partitionBy("batch", "event_date").parquet(f"{path}/{table}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def stream_to_topics(df: DataFrame, kind: str, servers: str, checkpoint: str):
    """Publish a stream of records to their topics."""
    return to_topic(df, kind).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)


def read_table(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None, time_range: tuple[datetime, datetime] | None = None) -> DataFrame:
    """A table, its replaced rows left out. A time range also prunes days."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{path}/{table}")
    if time_range:
        column = F.col(TIME_COLUMN[table])
        df = df.where(F.col("event_date").between(F.to_date(F.lit(time_range[0])), F.to_date(F.lit(time_range[1]))) & column.between(F.lit(time_range[0]), F.lit(time_range[1])))
    return latest_by(df, *VERSIONED[table]) if table in VERSIONED else df


def stream_to_tables(df: DataFrame, path: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None):
    """One stream into several tables (and, by publish, topics), so that a reader sees a batch in all of them or in none.

    outputs: table -> what becomes of a micro-batch there. A batch has a partition of its own in each table; when all are written and published it is entered in a ledger, by which committed() reads.
    A batch that fails between two tables is run again after a restart and replaces what it wrote. Topics may get it twice: publish is told the batch's number.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for table, made in outputs.items():
                dated = made(batch).withColumn("event_date", F.to_date(TIME_COLUMN[table])).withColumn("batch", F.lit(number))
                rows = dated.sortWithinPartitions("event_date", *SORT_KEYS[table]).write.option("partitionOverwriteMode", "dynamic")
                rows.mode("overwrite").partitionBy("batch", "event_date").parquet(f"{path}/{table}")
            if publish:
                publish(batch, number)
            entry = batch.sparkSession.range(1).select(F.lit(number).alias("batch"), F.current_timestamp().alias("committed_at"))
            entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/_ledger/{number}")
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def committed(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A table that stream_to_tables writes, without batches that are not in its ledger. The ledger is a row for each batch."""
    ledger = spark.read.schema("batch int, committed_at timestamp").parquet(f"{path}/_ledger/*").select("batch").distinct()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{table}").join(ledger, "batch", "left_semi").drop("batch")


def expire(df: DataFrame, column: str, days: int, as_of: datetime) -> DataFrame:
    """Rows that are kept for another while."""
    return df.where(F.col(column) > F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def expire_table(df: DataFrame, table: str, as_of: datetime) -> DataFrame:
    return expire(df, TIME_COLUMN[table], KEEP_DAYS[table], as_of)


def expire_files(spark: SparkSession, path: str, table: str, as_of: datetime) -> list[str]:
    """Take out of a stored table what is older than its days: whole days by removing their partitions, of the day at the edge by writing what stays of it. The days removed.

    Days are found by listing; no file of a day that goes or stays as a whole is read.
    """
    column, edge = TIME_COLUMN[table], as_of - timedelta(days=KEEP_DAYS[table])
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for pattern in ("event_date=*", "batch=*/event_date=*"):
        for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or ():
            day, at = status.getPath().getName().partition("=")[2], status.getPath()
            if not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
                continue
            if day < f"{edge:%Y-%m-%d}":
                files.delete(at, True)
                gone.append(day)
            elif day == f"{edge:%Y-%m-%d}":
                # written beside it first: a table can't be overwritten with what is read from it
                kept = checkpointed(spark.read.parquet(at.toString()).where(F.col(column) > F.lit(edge)))
                kept.sortWithinPartitions(*SORT_KEYS[table]).write.mode("overwrite").parquet(at.toString())
    return sorted(set(gone))


def latest_by(df: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The row of the highest version for each key; of equal versions the largest by its other values."""
    others = orderable(df, *(c for c in df.columns if c not in (*keys, version)))
    by = Window.partitionBy(*keys).orderBy(F.desc(version), *(c.desc() for c in others))
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def write_keyed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int = 64, mode: str = "append") -> None:
    """Append to a table of the catalog whose rows lie in buckets of their key, sorted by it: latest_by, upsert and joins by that key then need no shuffle of it. A rewrite keeps the number of buckets."""
    df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)


def compact_keyed(spark: SparkSession, name: str, keys: tuple[str, ...], version: str, buckets: int = 64) -> None:
    """Leave only the newest version of each key in such a table. The new files are written before the name is passed on to them; readers meanwhile see the old table, but for the instant of the renaming."""
    new = f"{name}_{uuid.uuid4().hex[:12]}"
    write_keyed(latest_by(spark.table(name), keys, version), new, keys, buckets)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")


def upsert(target: DataFrame, source: DataFrame, key: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows of target, with those of source in their place; the columns in keep stay as target has them."""
    t = target.withColumn("_there", F.lit(True)).select(*key, "_there", *(F.col(c).alias(f"_t_{c}") for c in target.columns if c not in key))
    both = t.join(source.withColumn("_new", F.lit(True)), list(key), "full")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.lit(c in keep) & F.col("_there").isNotNull()), F.col(f"_t_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(c if c in key else pick(c) for c in target.columns))


def insert_if_absent(target: DataFrame, source: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return target.unionByName(source.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti"))


def replay_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("id") == F.lit(job_id))
