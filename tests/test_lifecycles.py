"""Notifications of alert groups, changes of state of alerts and jobs, repaired windows: by hand, and streams against batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_telemetry import BASE, EVENT, at, plain

from querypulse.operators import lifecycles as life
from querypulse.operators import monitoring, rollup
from querypulse.sources import tables
from querypulse.streaming import keyed

ALERT = "ts timestamp, alertname string, service string, severity string, receiver string"


def told(spark, rows, **k):
    """(receiver, seconds after BASE, number firing, number resolved) of alerts (seconds, name, service, severity, receiver)."""
    df = spark.createDataFrame([(at(seconds=s), *r) for s, *r in rows], ALERT)
    got = life.group_alerts(df, **k).collect()
    return sorted((r.receiver, (plain(r.notified_at) - BASE).total_seconds(), len(r.firing), len(r.resolved)) for r in got)


def test_a_group_waits_and_repeats(spark):
    steady = [(30 * k, "Slow", "a", "warning", "chat") for k in range(1000)]  # 8 h 20 min
    got = told(spark, steady)
    # told after 30 s, every 4 h, at the look that follows: 14 400 is a multiple of 300; the last sample is at 29 970, so it ends at 30 270
    assert got == [("chat", 30, 1, 0), ("chat", 14_430, 1, 0), ("chat", 28_830, 1, 0), ("chat", 30_330, 0, 1)]
    paged = told(spark, [(30 * k, "Down", "a", "critical", "pager") for k in range(240)])
    assert paged == [("pager", 10, 1, 0), ("pager", 3610, 1, 0), ("pager", 7210, 1, 0), ("pager", 7510, 0, 1)]


def test_a_group_tells_what_is_new(spark):
    rows = [(30 * k, "Slow", "a", "warning", "chat") for k in range(40)] + [(30 * k, "Slow", "a", "info", "chat") for k in range(15, 20)]
    # the second alert comes at 450 and is told at 630, with the next look; its last sample is at 570, so it is gone at 870 and told at 930; the first ends at 1470
    assert told(spark, rows) == [("chat", 30, 1, 0), ("chat", 630, 2, 0), ("chat", 930, 1, 1), ("chat", 1530, 0, 1)]
    assert told(spark, [(0, "Slow", "a", "warning", "chat"), (5000, "Slow", "a", "warning", "chat")]) == [("chat", 30, 1, 0), ("chat", 330, 0, 1), ("chat", 5030, 1, 0), ("chat", 5330, 0, 1)]
    assert told(spark, [(0, "Slow", "a", "warning", "chat")], until=int(BASE.timestamp()) + 100) == [("chat", 30, 1, 0)]
    assert told(spark, []) == []


def test_routes(spark):
    df = spark.createDataFrame([("a", "critical", "x"), ("b", "warning", "slack-search-quality"), ("c", "warning", "slack"), ("d", None, None)], "alertname string, severity string, channel string")
    assert sorted((r.alertname, r.receiver) for r in monitoring.route_alerts(df).collect()) == [("a", "chat"), ("a", "pager"), ("b", "quality"), ("c", "chat"), ("d", "chat")]
    assert {r.receiver for r in monitoring.route_alerts(df.drop("channel")).where("alertname = 'b'").collect()} == {"chat"}


def through(spark, df, order, tmp_path, run, parts=5):
    """A stream of df's rows in files, in the order of a column; what run makes of it."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    numbered = df.withColumn("_k", F.ntile(parts).over(Window.orderBy(order))).cache()
    for k in range(1, parts + 1):
        numbered.where(F.col("_k") == k).drop("_k").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = run(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.read.schema(run(stream).schema).parquet(out)


def test_notifications_as_a_stream(spark, tmp_path):
    random.seed(9)
    rows = []
    for service in ("a", "b"):
        for severity in ("warning", "critical"):
            s = 0
            while s < 20_000:
                rows += [(at(seconds=s + 30 * k), "Slow", service, severity, "pager" if severity == "critical" else "chat") for k in range(random.randint(1, 60))]
                s += random.choice([400, 900, 2500, 6000]) + 1800
    end = [(at(days=2), "End", "z", "warning", "chat")]
    df = spark.createDataFrame(rows + end, ALERT)
    key = lambda d: sorted((r.receiver, r.alertname, r.service, plain(r.notified_at), tuple(r.firing), tuple(r.resolved)) for r in d.where("alertname <> 'End'").collect())
    batch = key(life.group_alerts(df))
    assert key(through(spark, df, "ts", tmp_path, lambda s: keyed.stream_group_alerts(s, grace="10 seconds"))) == batch and len(batch) > 30


FIRED = [("x", 0), ("x", 60), ("x", 90), ("x", 4000), ("y", 10), ("y", 3610), ("y", 3610), ("z", 5)]


def test_alert_lifecycle(spark, tmp_path):
    df = spark.createDataFrame([(s, at(seconds=t)) for s, t in FIRED], "signature string, window_end timestamp")
    rows = lambda d: sorted((r.signature, (plain(r["at"]) - BASE).total_seconds(), r.state, r.fire_count) for r in d.where("signature <> 'end'").collect())
    want = [
        ("x", 0, "firing", 1), ("x", 60, "active", 2), ("x", 3690, "resolved", 3), ("x", 4000, "firing", 1), ("x", 7600, "resolved", 1),
        ("y", 10, "firing", 1), ("y", 3610, "active", 2), ("y", 7210, "resolved", 3), ("z", 5, "firing", 1), ("z", 3605, "resolved", 1),
    ]
    assert rows(life.alert_lifecycle(df)) == want
    assert rows(life.alert_lifecycle(df, until=int(BASE.timestamp()) + 3700)) == [w for w in want if w[1] <= 3700]
    ends = df.unionByName(spark.createDataFrame([("end", at(days=1))], df.schema))
    assert rows(through(spark, ends, "window_end", tmp_path, keyed.stream_alert_lifecycle)) == want


STEPS = [
    ("good", 0, "requested", None), ("good", 5, "started", None), ("good", 9, "succeeded", None), ("good", 12, "failed", "too late"), ("bad", 1, "requested", None), ("bad", 2, "failed", "no recorded run"),
    ("stuck", 0, "requested", None), ("stuck", 7, "started", None), ("stuck", 9000, "succeeded", None), ("never", 3, "started", None), ("waits", 30, "requested", None), ("waits", 30, "requested", None),
]


def test_job_lifecycle(spark, tmp_path):
    df = spark.createDataFrame([(i, at(seconds=t), e, x) for i, t, e, x in STEPS], "id string, at timestamp, event string, error string")
    rows = lambda d: sorted((r.id, (plain(r["at"]) - BASE).total_seconds(), r.state, r.error) for r in d.where("id <> 'end'").collect())
    want = [
        ("bad", 1, "pending", None), ("bad", 2, "failed", "no recorded run"), ("good", 0, "pending", None), ("good", 5, "running", None), ("good", 9, "succeeded", None),
        ("stuck", 0, "pending", None), ("stuck", 7, "running", None), ("stuck", 3607, "failed", "timed out"), ("waits", 30, "pending", None), ("waits", 3630, "failed", "timed out"),
    ]
    assert rows(life.job_lifecycle(df)) == want
    assert rows(life.job_lifecycle(df, until=int(BASE.timestamp()) + 8)) == [w for w in want if w[1] <= 8]
    ends = df.unionByName(spark.createDataFrame([("end", at(days=1), "requested", None)], df.schema))
    assert rows(through(spark, ends, "at", tmp_path, keyed.stream_job_lifecycle)) == want


def test_late_events_repair_windows_in_the_stream(spark, tmp_path):
    random.seed(11)
    rows = []
    for k in range(600):
        late = random.choice([0, 0, 0, 40, 200, 900])  # seconds that it comes behind
        rows.append((k * 3, (f"e{k}", random.choice(["a", "b"]), at(seconds=max(0, 3 * k - late)), random.choice([None, float(k % 17), random.random()]), random.choice(["ok", "ok", "error"]), random.choice([None, 0.5, 0.25]), random.choice([True, False, None]))))
    df = spark.createDataFrame([(*e, comes) for comes, e in rows] + [("end", "end", at(hours=5), 1.0, "ok", None, None, 10_000)], EVENT + ", comes int")
    versions = through(spark, df, "comes", tmp_path, lambda s: keyed.stream_rollup_versions(s.drop("comes"), keep_seconds=3600), parts=6).where("service <> 'end'")
    newest = tables.latest_by(versions, ("window_start", "service"), "version")
    key = lambda d: sorted((plain(r.window_start), r.service, *(None if r[c] is None else round(r[c], 9) for c in rollup.COLUMNS)) for r in d.collect())
    assert key(newest) == key(rollup.metric_rollup(df.where("service <> 'end'"))) and versions.agg(F.max("version")).first()[0] > 1
    with pytest.raises(ValueError):
        keyed.stream_rollup_versions(df, grace_seconds=9, keep_seconds=5)
