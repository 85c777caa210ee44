"""Tables that a stream writes, old days, counters of a stream, records with maps."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_telemetry import BASE, EVENT, at, events, plain

from querypulse.operators import replay, rollup, validate
from querypulse.sources import tables
from querypulse.streaming.streams import FaultCounts, observed_faults


def in_files(spark, tmp_path, rows, schema, parts=3):
    df = spark.createDataFrame(rows, schema)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_a_batch_is_in_all_tables_or_in_none(spark, tmp_path):
    """The second table fails once, in the second batch; after a restart both have every row once."""
    rows = [(f"e{k}", "ab"[k % 2], at(hours=7 * k), float(k), "ok", None, True) for k in range(12)]
    df, stream = in_files(spark, tmp_path, rows, EVENT)
    out, flag, published = str(tmp_path / "out"), tmp_path / "failed", []

    def rollups(batch):
        if not flag.exists() and (Path(out) / "_ledger/0").exists():
            flag.touch()
            raise OSError("the disk is full")
        return rollup.metric_rollup(batch, 3600).withColumn("inserted_at", F.lit(BASE))

    def run():
        outputs = {"events": lambda b: b.select("event_id", "service", F.col("event_id").alias("query_id"), "timestamp", "latency_ms"), "metric_rollups": rollups}
        q = tables.stream_to_tables(stream, out, outputs, str(tmp_path / "c"), lambda b, n: published.append((n, b.count()))).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="the disk is full"):
        run()
    # the batch that failed is in the first table's files, but not in its ledger
    assert spark.read.parquet(f"{out}/events").count() == 8 and tables.committed(spark, out, "events").count() == 4 == tables.committed(spark, out, "metric_rollups").count()
    run()
    for table, column in (("events", "event_id"), ("metric_rollups", "window_start")):
        got = tables.committed(spark, out, table)
        assert got.count() == got.select(column).distinct().count() == 12
    assert published == [(0, 4), (1, 4), (2, 4)]


def test_stream_to_table_after_a_failure(spark, tmp_path):
    rows = [(f"e{k}", "a", at(hours=7 * k), float(k), "ok", None, True) for k in range(9)]
    df, stream = in_files(spark, tmp_path, rows, EVENT)
    keyed = stream.withColumn("query_id", F.col("event_id"))
    for _ in range(2):  # the second time nothing is left, and nothing comes twice
        tables.stream_to_table(keyed, str(tmp_path / "out"), "events", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in tables.read_table(spark, str(tmp_path / "out"), "events").collect()) == sorted(r[0] for r in rows)
    again = spark.createDataFrame(rows[:3], EVENT).withColumn("query_id", F.col("event_id"))
    dated = again.withColumn("event_date", F.to_date("timestamp")).withColumn("batch", F.lit(0))
    dated.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "event_date").parquet(str(tmp_path / "out/events"))
    assert tables.read_table(spark, str(tmp_path / "out"), "events").count() >= 9


def test_old_days_go_without_being_read(spark, tmp_path):
    rows = [(f"e{k}", "a", at(hours=6 * k), float(k), "ok", None, True) for k in range(40)]  # ten days
    df = spark.createDataFrame(rows, EVENT).withColumn("query_id", F.col("event_id"))
    tables.write_table(df, str(tmp_path), "events")
    days = sorted(p.name for p in (tmp_path / "events").glob("event_date=*"))
    # a file that can't be read, in a day that goes and in one that stays
    for day in (days[0], days[-1]):
        (tmp_path / "events" / day / "part-bad.parquet").write_text("not parquet")
    as_of = at(days=93, hours=3)
    gone = tables.expire_files(spark, str(tmp_path), "events", as_of)
    assert gone == [d.partition("=")[2] for d in days[:3]]
    (tmp_path / "events" / days[-1] / "part-bad.parquet").unlink()
    left = spark.read.parquet(str(tmp_path / "events"))
    assert {r.event_id for r in left.collect()} == {r.event_id for r in tables.expire_table(df, "events", as_of).collect()} and left.count() == 27


def test_counters_of_a_stream(spark, tmp_path):
    good = dict(query_id="q-1", service="search-api", query="x", timestamp="2026-08-12T10:00:00Z", latency_ms=1.0, status="ok", event_id="e", result_count=3, relevance_score=0.82)
    faulty = [{}, {}, dict(latency_ms=-1.0), dict(latency_ms=-1.0, query_id=None), dict(status="error"), dict(timestamp="2026-08-12T10:00:00")]
    rows = [(json.dumps(good | x),) for x in faulty * 4]
    df, stream = in_files(spark, tmp_path, rows, "value string")
    decoded = validate.strip_strings(validate.decode_events(stream))
    rules = validate.event_rules(decoded.columns)
    counts = FaultCounts()
    spark.streams.addListener(counts)
    try:
        q = observed_faults(decoded, rules).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counts)
    bad = validate.validate_events(validate.decode_events(df))[1]
    by_rule = {r.v: r["count"] for r in bad.select(F.explode("violations").alias("v")).groupBy("v").count().collect()}
    assert counts.counts == {"rows": 24, "invalid": bad.count(), **by_rule} and bad.count() == 16 and len(by_rule) == 4


def test_records_with_maps(spark):
    """Of equal deliveries, and of events of equal time, the same one stays whatever the order of rows; maps stay as they are."""
    rows = [("e1", "q", at(seconds=1), "a", 5.0, {"b": "2", "a": "1"}), ("e1", "q", at(seconds=1), "a", 5.0, {"a": "0"}), ("e1", "q", at(seconds=1), "a", 5.0, None), ("e2", "q", at(seconds=0), "a", 9.0, {"z": "z"})]
    schema = "event_id string, query_id string, timestamp timestamp, service string, latency_ms double, metadata map<string,string>"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, schema).repartition(3)
        assert {(r.event_id, str(r.metadata)) for r in rollup.dedupe_events(df).collect()} == {("e1", "None"), ("e2", "{'z': 'z'}")}
        newest = replay.newest_events(df).collect()
        assert [(r.event_id, r.metadata) for r in newest] == [("e1", {"a": "1", "b": "2"})]
        assert tables.latest_by(df, ("query_id",), "timestamp").first().metadata == {"a": "1", "b": "2"}
    assert rollup.dedupe_events(events(spark, [(1, 2.0, "ok", None)]).select("event_id")).count() == 1 and plain(BASE) == BASE


def test_tables_kept_by_key_need_no_shuffle(spark):
    """Reading the newest versions, merging new rows of the same buckets and compaction: no exchange of the stored rows."""
    name = f"rollups_{uuid.uuid4().hex[:8]}"
    rows = [(f"s{k % 7}", at(minutes=k % 50), k) for k in range(400)]
    schema = "service string, window_start timestamp, v int"
    keys = ("service", "window_start")
    for part in (rows[:250], rows[250:]):
        tables.write_keyed(spark.createDataFrame(part, schema).withColumn("inserted_at", F.timestamp_seconds("v")), name, keys, 4)
    want = {}
    for s, t, v in rows:
        want[s, t.replace(tzinfo=None)] = max(v, want.get((s, t.replace(tzinfo=None)), -1))
    read = lambda: {(r.service, r.window_start.replace(tzinfo=None)): r.v for r in tables.latest_by(spark.table(name), keys, "inserted_at").collect()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert read() == want and "Exchange" not in plan(tables.latest_by(spark.table(name), keys, "inserted_at"))
    tables.compact_keyed(spark, name, keys, "inserted_at", 4)
    assert spark.table(name).count() == len(want) and read() == want
    other = f"{name}_new"
    tables.write_keyed(spark.createDataFrame([("s1", at(minutes=1), -5), ("new", BASE, 0)], schema).withColumn("inserted_at", F.timestamp_seconds("v")), other, keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = tables.upsert(spark.table(name), spark.table(other), keys)
        assert "Exchange" not in plan(merged) and {(r.service, r.v) for r in merged.where("v <= 0").collect()} >= {("s1", -5), ("new", 0)} and merged.count() == len(want) + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in (name, other):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
