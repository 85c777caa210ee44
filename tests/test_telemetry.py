"""Hand-computed cases of the telemetry operators, and streams against batches."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypulse.functions.columns import bucket, format_ms, time_range, window_start
from querypulse.operators import anomaly, dashboards, findings, monitoring, replay, rollup, traces, validate
from querypulse.schemas import SEARCH_EVENT, SPAN
from querypulse.sources import tables
from querypulse.streaming.streams import events_to_rollups, stream_anomalies

BASE = datetime(2026, 8, 12, 10, tzinfo=timezone.utc)
EVENT = "event_id string, service string, timestamp timestamp, latency_ms double, status string, relevance_score double, cache_hit boolean"


def at(**k):
    return BASE + timedelta(**k)


def plain(t):
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t


def events(spark, rows):
    """rows: (seconds after BASE, latency, status, relevance)."""
    return spark.createDataFrame([(f"e{k}", "search-api", at(seconds=s), x, st, r, k % 2 == 0) for k, (s, x, st, r) in enumerate(rows)], EVENT)


def test_rollup(spark):
    r = rollup.ordered_rollup(events(spark, [(k, 10.0 * (k + 1), "ok" if k % 4 else "timeout", None) for k in range(10)] + [(61, 7.0, "ok", 0.5)])).collect()
    assert [x.query_count for x in r] == [10, 1]
    assert (r[0].latency_p50, r[0].latency_p95, r[0].latency_avg, r[0].latency_max) == (50, 100, 55, 100)
    assert r[0].error_rate == 0.3 and r[0].relevance_avg is None and r[1].relevance_avg == r[1].relevance_p10 == 0.5 and r[0].cache_hit_rate == 0.5
    assert (r[0].window_end - r[0].window_start).total_seconds() == 60
    for n, q, want in ((5, 0.5, 3), (100, 0.95, 95), (100, 0.99, 99)):
        x = spark.range(1, n + 1).select(F.col("id").cast("double").alias("x"))
        assert x.agg(F.expr(f"percentile_disc({q}) within group (order by x)")).first()[0] == want
    with pytest.raises(ValueError):
        window_start(F.col("x"), 0)


def test_windows(spark):
    df = spark.createDataFrame([(at(seconds=37),), (at(seconds=59, microseconds=999_999),), (at(minutes=1),)], "t timestamp")
    assert [plain(r.w).minute for r in df.select(window_start(F.col("t"), 60).alias("w")).collect()] == [0, 0, 1]
    with pytest.raises(ValueError):
        bucket(F.col("t"), "2m")
    with pytest.raises(ValueError):
        time_range(start=BASE)
    assert time_range(5, as_of=BASE) == (BASE - timedelta(minutes=5), BASE)


def series(spark, values, counts=None):
    rows = [(at(minutes=k), at(minutes=k + 1), "search-api", c, float(v), float(v), 0.0) for k, (v, c) in enumerate(zip(values, counts or [100] * len(values), strict=True))]
    return spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, service string, query_count long, latency_p95 double, latency_p99 double, error_rate double")


HISTORY = [100, 105, 98, 102, 110, 95, 103, 99]


def test_anomalies(spark):
    found = lambda *a, **k: {(r.metric, r.severity) for r in anomaly.detect_anomalies(series(spark, *a), **k).collect()}
    assert found(HISTORY + [5000]) == {("latency_p95", "critical"), ("latency_p99", "critical")}
    assert found(HISTORY + [104]) == set() and found([1000]) == set() and found([100] * 10 + [100_000]) == set()
    assert found(HISTORY + [9000], [100] * 8 + [9]) == set()
    drop = anomaly.detect_anomalies(series(spark, [100] * 9, [100, 104, 98, 101, 99, 103, 97, 102, 10])).collect()
    assert [r.metric for r in drop] == ["query_count"] and drop[0].z_score < -3
    one = anomaly.detect_anomalies(series(spark, HISTORY + [900]))
    assert one.select(anomaly.explain_anomaly().alias("x")).first().x.endswith("above a baseline of 101.5 ± 4.3")
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(series(spark, [1]), threshold=0)


def test_validation(spark):
    good = dict(query_id="q-1", service="search-api", query="distributed tracing", timestamp="2026-08-12T10:00:00Z", latency_ms=42.5, status="ok", result_count=3, relevance_score=0.82, event_id="e")
    bad = [dict(latency_ms=-1.0), dict(latency_ms=1e9), dict(relevance_score=1.01), dict(query=" "), dict(query_id=None), dict(timestamp="2026-08-12T10:00:00"), dict(error_type="x"), dict(status="error"), dict(results=[{"rank": 1, "document_id": "a", "score": 0.1}] * 2), dict(result_count=0, results=[{"rank": 1, "document_id": "a", "score": 0.1}]), dict(odd=1)]
    raw = spark.createDataFrame([(json.dumps(good | x),) for x in [{}, *bad]] + [("{broken",)], "value string")
    ok, rejected = validate.validate_events(validate.decode_events(raw))
    assert ok.count() == 1 and rejected.count() == len(bad) + 1
    row = validate.event_rows(validate.enrich(ok, BASE, F.lit("t-9"))).first()
    assert row.trace_id == "t-9" and row.cache_hit == 0 and plain(row.received_at) == BASE
    shapes = validate.route_by_shape(spark.createDataFrame([('{"span_id": 1, "operation": 2}',), ('{"results": []}',), ('{"results": [], "latency_ms": 1}',), ("nope",)], "value string"))
    assert {k: v.count() for k, v in shapes.items()} == {"events": 1, "results": 1, "spans": 1, "invalid": 1}
    gate = spark.createDataFrame([("a",)] * 501 + [("b",)] * 500, "request_id string")
    assert {r.request_id for r in validate.batch_size_gate(gate).distinct().collect()} == {"b"}
    spans = spark.createDataFrame([("t", "s", "s", None, "a", "o", "2026-08-12T10:00:00Z", 1.0, "ok", None), ("t", "s", None, None, "a", "o", "2026-08-12T10:00:00Z", 1.0, "ok", None)], SPAN)
    assert [x.count() for x in validate.validate_spans(spans)] == [1, 1]


SPANS = "trace_id string, span_id string, parent_span_id string, query_id string, service string, operation string, start_time timestamp, duration_ms double, status string, attributes map<string,string>"


def span(i, parent=None, trace="t", ms=100.0, start=0, service="search-api", op="search", status="ok", **attributes):
    return (trace, i, parent, "q-1", service, op, at(milliseconds=start), ms, status, {k.replace("_", "."): v for k, v in attributes.items()})


def test_traces(spark):
    rows = [span("c", "b", start=2, ms=10.0), span("a", ms=1000.0), span("b", "a", start=1, ms=900.0, service="rank"), span("lost", "nowhere", start=5)]
    rows += [span("x", "y", trace="loop"), span("y", "x", trace="loop"), span("z", "y", trace="loop"), span("me", "me", trace="self")]
    rows += [span(f"d{k}", f"d{k - 1}" if k else None, trace="deep") for k in range(21)]
    tree = traces.assemble_traces(spark.createDataFrame(rows, SPANS))
    got = {(r.trace_id, r.span_id): r for r in tree.collect()}
    assert [got["t", i].depth for i in "abc"] == [0, 1, 2] and got["t", "a"].self_time_ms == 100 and got["t", "lost"].parent_state == "orphan" and got["t", "lost"].depth == 0
    assert got["deep", "d20"].depth == 20 and got["deep", "d20"].root == "d0" and [got["deep", f"d{k}"].preorder for k in range(21)] == list(range(21))
    assert all(got["loop", i].cyclic and got["loop", i].depth is None for i in "xyz") and got["self", "me"].cyclic and not got["t", "a"].cyclic
    assert [r.span_id for r in traces.critical_path(tree).where("trace_id = 't'").orderBy("depth").collect()] == ["a", "b", "c"]
    assert (traces.slowest_service(tree).where("trace_id = 't'").first().service, traces.trace_summary(tree).where("trace_id = 't'").first().orphan_count) == ("rank", 1)
    shown = {r.trace_id: json.loads(r.trace) for r in traces.trace_json(tree).collect()}
    nested = lambda x: (x["span_id"], [nested(c) for c in x["children"]])
    assert [nested(r) for r in shown["t"]["roots"]] == [("a", [("b", [("c", [])])]), ("lost", [])] and shown["t"]["span_count"] == 4 and set(shown) == {"t", "deep"}
    deep = shown["deep"]["roots"][0]
    for k in range(21):
        assert deep["span_id"] == f"d{k}" and deep["depth"] == k
        deep = deep["children"][0] if k < 20 else None


def test_findings(spark):
    rows = [span("r", ms=1000.0), *(span(f"k{k}", "r", ms=50.0, start=k, op="same" if k < 3 else f"o{k}") for k in range(8)), span("e", "r", ms=5.0, status="ERROR", start=9, error_message="boom", cache_hit="false")]
    tree = traces.assemble_traces(spark.createDataFrame(rows + [span("q", trace="calm", ms=10.0)], SPANS))
    baselines = spark.createDataFrame([("search-api", 400.0)], "service string, baseline_p95 double")
    ranked = findings.rank_findings(findings.findings(tree, baselines)).orderBy("rank").collect()
    assert [r.kind for r in ranked] == ["error_span", "baseline_breach", "slow_span", "retry_storm", "fan_out", "cache_miss"]
    assert (ranked[3].service, ranked[3].operation, ranked[3].span_id, ranked[3].evidence["parent_operation"]) == ("search-api", "same", "r", "search")
    assert ranked[0].evidence["message"] == "boom" and ranked[1].confidence == 0.68 and ranked[3].confidence == 0.7
    said = {r.trace_id: r.summary for r in findings.summarise(tree, findings.rank_findings(findings.findings(tree, baselines))).collect()}
    assert said["calm"] == findings.UNREMARKABLE and "failed" in said["t"]


def test_replay(spark):
    kind = "query_id string, latency_ms double, result_count int, status string, document_ids array<string>"
    base = ("x", 100.0, 3, "ok", ["d1", "d2", "d3"])
    cases = {"same": (base, base), "slow": (base, ("x", 150.0, *base[2:])), "other": (base, (*base[:4], ["d1", "d4"])), "order": (base, (*base[:4], ["d3", "d1", "d2"])), "healed": ((*base[:3], "error", []), base), "failing": ((*base[:3], "error", []), (*base[:3], "timeout", [])), "zero": (("x", 0.0, *base[2:]), base)}
    a, b = (spark.createDataFrame([(n, *c[k][1:]) for n, c in cases.items()], kind) for k in (0, 1))
    got = {r.query_id: r for r in replay.diff_runs(a, b).collect()}
    assert {n: r.verdict for n, r in got.items()} == {"same": "matches", "slow": "slower", "other": "different results", "order": "matches", "healed": "no longer reproducible", "failing": "still failing", "zero": "matches"}
    assert got["other"].added == ["d4"] and got["other"].removed == ["d2", "d3"]
    targets = replay.safe_replay_targets(spark.createDataFrame([("rank", "x"), ("", "rank"), ("Bad!", "rank"), ("evil", "rank")], "candidate string, recorded_service string"), spark.createDataFrame([("rank",)], "service string"))
    assert [r.target for r in targets.collect()] == ["rank", "rank"]


def test_tables(spark, tmp_path):
    rows = [("a", BASE, 1), ("a", BASE, 2), ("b", at(days=1), 1)]
    df = spark.createDataFrame(rows, "service string, window_start timestamp, v int").withColumn("inserted_at", F.timestamp_seconds("v"))
    tables.write_table(df, str(tmp_path), "metric_rollups")
    back = tables.read_table(spark, str(tmp_path), "metric_rollups")
    assert {(r.service, r.v) for r in back.collect()} == {("a", 2), ("b", 1)}
    assert tables.read_table(spark, str(tmp_path), "metric_rollups", time_range=(BASE, at(hours=1))).count() == 1
    assert tables.expire_table(back, "metric_rollups", at(days=365, hours=1)).count() == 1
    t, s = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, o string, v int"), spark.createDataFrame([(2, "x", 5), (3, "c", 5)], "k int, o string, v int")
    assert sorted(map(tuple, tables.upsert(t, s, ("k",), keep=("o",)).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 5)]
    assert sorted(map(tuple, tables.insert_if_absent(t, s, ("k",)).collect())) == [(1, "a", 1), (2, "b", 1), (3, "c", 5)]


def test_monitoring(spark):
    samples = spark.createDataFrame([("m", {"s": "a"}, at(minutes=k), v) for k, v in enumerate([10.0, 12.0, 3.0, 5.0])], "metric string, labels map<string,string>, ts timestamp, value double")
    assert [r.increase for r in monitoring.counter_increase(samples, 600).orderBy("ts").collect()] == [0, 2, 5, 7]
    states = lambda values: [r.state for r in monitoring.evaluate_alert(spark.createDataFrame([(at(minutes=k), float(v)) for k, v in enumerate(values)], "ts timestamp, value double"), F.col("value") > 0, 300).orderBy("ts").collect()]
    assert states([1, 1, 1, 1, 1, 0]) == ["pending"] * 5 + ["inactive"] and states([1] * 6)[-1] == "firing"
    days = [(timedelta(hours=5 * k), v) for k, v in enumerate([1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1])]
    got = monitoring.evaluate_alert(spark.createDataFrame([(BASE + d, float(v)) for d, v in days], "ts timestamp, value double"), F.col("value") > 0, 90_000).orderBy("ts").collect()
    since, want = None, []
    for d, v in days:
        since = (d if since is None else since) if v else None
        want.append("inactive" if since is None else "firing" if (d - since).total_seconds() >= 90_000 else "pending")
    assert [r.state for r in got] == want and "firing" in want
    le = spark.createDataFrame([(BASE, b, c) for b, c in ((10.0, 5.0), (20.0, 10.0), (float("inf"), 10.0))], "ts timestamp, le double, cumulative double")
    assert monitoring.histogram_quantile(le, 0.75).first().value == 15
    alerts = spark.createDataFrame([(BASE, "ServiceDown", "critical", "j", "a"), (BASE, "Slow", "warning", "j", "a"), (BASE, "Slow", "warning", "k", "a")], "ts timestamp, alertname string, severity string, job string, service string")
    assert {(r.alertname, r.job) for r in monitoring.inhibit(alerts).collect()} == {("ServiceDown", "j"), ("Slow", "k")}
    assert monitoring.route_alerts(alerts).count() == 4
    assert monitoring.resolve(alerts, 300, F.lit(at(minutes=6)), ("alertname", "job")).count() == 3
    empty = samples.where("false")
    assert monitoring.safe_ratio(empty, empty, samples).agg(F.sum("value")).first()[0] == 0


def test_formats(spark):
    df = spark.createDataFrame([(None,), (12.0,), (2348.0,)], "x double")
    assert [r.y for r in df.select(format_ms(F.col("x")).alias("y")).collect()] == ["—", "12 ms", "2.35 s"]
    page = dashboards.pivot_series(spark.createDataFrame([(BASE, "b", 1.0), (BASE, "a", 2.0), (at(minutes=1), "a", 3.0)], "bucket timestamp, service string, v double"), "v")
    assert page.columns == ["bucket", "a", "b"] and page.collect()[1].b is None


def test_streams_match_batches(spark, tmp_path):
    """Raw records in files, through decoding, validation, repeated deliveries and windows, to anomalies."""
    rows = []
    for w in range(12):
        for k in range(12):
            rows.append({"event_id": f"{w}-{k}", "query_id": "q", "service": "search-api", "query": "x", "timestamp": at(minutes=w, seconds=k).strftime("%Y-%m-%dT%H:%M:%SZ"), "latency_ms": 9000.0 if w == 10 else 100.0 + (k % 7) + w, "status": "ok", "result_count": 1})
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(3):
        part = rows[n * 48 : n * 48 + 48]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, [*part, part[-1], {"service": "broken"}])))
    raw = tables.read_stream(spark, str(source), kind="text", maxFilesPerTrigger="1")
    closed = events_to_rollups(raw)
    q = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(plain(r.window_start), r.query_count, r.latency_p95) for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame([(r["event_id"], r["service"], plain(datetime.fromisoformat(r["timestamp"].replace("Z", "+00:00"))), r["latency_ms"], "ok", None, None) for r in rows], EVENT)
    want = {(plain(r.window_start), r.query_count, r.latency_p95) for r in rollup.metric_rollup(whole).where(F.col("window_start") < F.lit(at(minutes=11))).collect()}
    assert got == want and len(got) == 11
    stored = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    q = stream_anomalies(stored).writeStream.format("parquet").option("path", out + "2").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    fired = {(r.metric, r.severity) for r in spark.read.parquet(out + "2").collect()}
    assert fired == {(r.metric, r.severity) for r in anomaly.detect_anomalies(rollup.metric_rollup(whole).where(F.col("window_start") < F.lit(at(minutes=11)))).collect()} and ("latency_p95", "critical") in fired


def test_registered_queries_and_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 40
    assert isinstance(SEARCH_EVENT, T.StructType)


def test_digits_of_the_product(spark):
    """257.8665 times 1000 is 257866.49999999997 and goes down, although its shortest decimal is a tie, as in DuckDB."""
    s = spark.createDataFrame([(257.8665,), (130.2325,), (1.2344,), (2.5,)], "x double").select(findings.digits(F.col("x"), 3).alias("x"))
    assert [r.x for r in s.collect()] == [257.866, 130.232, 1.234, 2.5]


def test_shallow_traces_are_dealt_out_once(spark):
    """Traces of roots and children are dealt out once; the same spans beside a deep trace give the same rows."""
    at = lambda k: datetime(2024, 1, 1, 0, 0, 0, 1000 * k)
    rows = [("a", "r", None, 0, 9.0), ("a", "c2", "r", 2, 3.0), ("a", "c1", "r", 1, 3.0), ("a", "o", "gone", 3, 2.0), ("b", "x", None, 0, 1.0), ("b", "y", "", 0, 1.0), ("b", "z", "y", 5, 1.0), ("b", "z", "y", 4, 1.0)]
    deep = [("d", "1", None, 0, 5.0), ("d", "2", "1", 1, 4.0), ("d", "3", "2", 2, 3.0), ("e", "1", "1", 0, 1.0), ("f", "1", "2", 0, 1.0), ("f", "2", "1", 0, 1.0)]

    def tree(listed):
        s = spark.createDataFrame([(t, i, p, "q", "svc", "op", at(k), d, "ok", {}) for t, i, p, k, d in listed], "trace_id string, span_id string, parent_span_id string, query_id string, service string, operation string, start_time timestamp, duration_ms double, status string, attributes map<string,string>")
        return traces.assemble_traces(s)

    shown = lambda t: sorted((r.trace_id, r.span_id, r.parent_state, r.up, r.depth, r.root, r.preorder, r.on_critical_path, r.self_time_ms, r.n_children, r.cyclic) for r in t.collect())
    alone, both = tree(rows), tree(rows + deep)
    assert shown(alone) == [
        ("a", "c1", "child", "r", 1, "r", 1, True, 3.0, 0, False), ("a", "c2", "child", "r", 1, "r", 2, False, 3.0, 0, False), ("a", "o", "orphan", None, 0, "o", 3, False, 2.0, 0, False), ("a", "r", "root", None, 0, "r", 0, True, 3.0, 2, False),
        ("b", "x", "root", None, 0, "x", 0, True, 1.0, 0, False), ("b", "y", "root", None, 0, "y", 1, False, 0.0, 1, False), ("b", "z", "child", "y", 1, "y", 2, False, 1.0, 0, False),
    ]
    assert [r for r in shown(both) if r[0] in "ab"] == shown(alone)
    assert [r[1:8] for r in shown(both) if r[0] == "d"] == [("1", "root", None, 0, "1", 0, True), ("2", "child", "1", 1, "1", 1, True), ("3", "child", "2", 2, "1", 2, True)]
    assert all(r[-1] and r[4] is None for r in shown(both) if r[0] in "ef")
    plan = alone._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(trace_id#") == 1


def bundle_rows(spark):
    """Events and spans of odd shapes: a trace of two queries, a query of two traces, a circle, an orphan, a deep trace, events without traces, spans without events or query."""
    kind = "trace_id string, span_id string, parent_span_id string, query_id string, service string, operation string, start_time timestamp, duration_ms double, status string, attributes map<string,string>"
    row = lambda t, i, p, q, k, d, svc="a", status="ok", **x: (t, i, p, q, svc, "op", at(milliseconds=k), d, status, {c.replace("_", "."): v for c, v in x.items()})
    rows = [row("t", "r", None, "q1", 0, 1000.0), *(row("t", f"k{k}", "r", "q1" if k < 6 else "q2", k, 50.0, "b") for k in range(8)), row("t", "e", "r", "q1", 9, 5.0, "b", "ERROR", error_message="boom", cache_hit="false")]
    rows += [row("u", "r", None, "q1", 0, 10.0), row("u", "lost", "gone", "q1", 1, 20.0, "c"), row("loop", "x", "y", "q3", 0, 5.0, status="error"), row("loop", "y", "x", "q3", 0, 7.0), row("calm", "s", None, None, 0, 1.0)]
    rows += [row("deep", f"d{k}", f"d{k - 1}" if k else None, "q4", 0, 9.0 - k) for k in range(5)]
    rows += [row("u", "r", None, "q9", -5, 10.0)]  # the earlier of two spans of one id does not count, nor does its query
    events = [(f"e{k}", q, "a", "ok", ms, at(milliseconds=k)) for k, (q, ms) in enumerate([("q1", 1.0), ("q1", 2.0), ("q3", 3.0), ("alone", 4.0), ("q9", 5.0)])]
    return spark.createDataFrame(events, "event_id string, query_id string, service string, status string, latency_ms double, timestamp timestamp"), spark.createDataFrame(rows, kind), spark.createDataFrame([("a", 400.0)], "service string, baseline_p95 double")


def test_debug_bundle_deals_out_no_text(spark):
    """A bundle's findings, hotspot and JSON are worked out where the spans of a trace lie: spans are dealt out once for them and once for the ids of queries."""
    events, spans, baselines = bundle_rows(spark)
    tree = traces.assemble_traces(spans)
    got = {(r.query_id, r.trace_id): r for r in findings.debug_bundle(events, tree, baselines).collect()}
    assert {k: (r.spans, r.latency_ms, r.cyclic, r.hotspot, r.hotspot_ms) for k, r in got.items()} == {
        ("q1", "t"): (8, 2.0, False, "a", 595.0), ("q2", "t"): (2, None, False, "a", 595.0), ("q1", "u"): (2, 2.0, False, "c", 20.0), ("q3", "loop"): (2, 3.0, True, "a", 2.0),
        ("q4", "deep"): (5, None, False, "a", 9.0), (None, "calm"): (1, None, False, "a", 1.0), ("alone", None): (None, 4.0, None, None, None), ("q9", None): (None, 5.0, None, None, None),
    }
    listed = findings.rank_findings(findings.findings(tree, baselines)).orderBy("trace_id", "rank").collect()
    for (_, t), r in got.items():
        wanted = [(f.rank, f.kind, f.service, f.span_id, f.confidence, f.summary, f.evidence) for f in listed if f.trace_id == t]
        assert [(f.rank, f.kind, f.service, f.span_id, f.confidence, f.said, {e.key: e.value for e in f.evidence}) for f in r.findings or []] == wanted and r.kinds == [f[1] for f in wanted]
        assert r.summary == (wanted[0][5] if wanted else findings.UNREMARKABLE)
    assert got["q1", "t"].kinds == ["error_span", "baseline_breach", "slow_span", "retry_storm", "fan_out", "cache_miss"] and got["q3", "loop"].kinds == [] and got["q1", "u"].kinds == ["missing_spans"]
    assert {r.trace_id: r.trace for r in got.values() if r.trace} == {r.trace_id: r.trace for r in traces.trace_json(tree).collect()} and got["q1", "t"].baseline_p95 == 400

    own = {r.trace_id: r for r in findings.debug_bundle(events, tree, baselines, "q2", retries=10).collect()}
    assert set(own) == {"t"} and (own["t"].spans, own["t"].hotspot, own["t"].hotspot_ms) == (2, "b", 100.0) and "retry_storm" not in own["t"].kinds and '"span_count":2,' in own["t"].trace
    assert findings.debug_bundle(events, tree, baselines, "none").isEmpty()

    flat = findings.debug_bundle(events, traces.assemble_traces(spans.where("trace_id in ('t', 'u')")), baselines)
    plan = flat._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("Exchange hashpartitioning(trace_id#") == 2


def test_debug_bundle_sorts_plain_traces_once(spark, monkeypatch):
    """Traces without repeated ids, of roots and children, are linked, judged and told in one sort; beside other traces they give the same rows. A task takes so many spans and no more."""
    events, spans, baselines = bundle_rows(spark)
    plain = spans.where("trace_id in ('t', 'u', 'calm') and (query_id is null or query_id <> 'q9')")
    plain = plain.unionByName(plain.where("trace_id = 't'").withColumns({"trace_id": F.lit("v"), "service": F.when(F.col("span_id") != "k1", F.col("service")), "duration_ms": F.when(F.col("span_id") != "k2", F.col("duration_ms")), "parent_span_id": F.when(F.col("span_id") == "r", "").otherwise(F.col("parent_span_id"))}))
    odd = spans.where("trace_id in ('loop', 'deep') or query_id = 'q9'")
    alone, beside = traces.assemble_traces(plain), traces.assemble_traces(plain.unionByName(odd))
    own = F.col("trace_id").isin("t", "u", "calm", "v")
    shown = lambda df: {tuple(r[k] for k in ("trace_id", "span_id", "query_id") if k in r): r.asDict(True) for r in df.select(*sorted(df.columns)).where(own).collect()}
    assert shown(alone) == shown(beside) and len(shown(alone)) == 23
    assert {(r.trace_id, r.n_alike): r.n for r in alone.where("one_alike").groupBy("trace_id", "n_alike").agg(F.count("*").alias("n")).collect()} == {("t", 9): 1, ("v", 8): 1, ("v", 1): 1}
    bundles = findings.debug_bundle(events, alone, baselines)
    assert shown(bundles) == shown(findings.debug_bundle(events, beside, baselines)) and len(shown(bundles)) == 6
    initial = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    plan = initial(bundles)
    assert plan.count("Sort [trace_id#") == 1 and plan.count("+- Window [") == 1 and "Generate explode" not in plan and "REPARTITION_BY_NUM" not in plan
    monkeypatch.setattr(traces, "MOST_SPANS", 2)
    assert ", 12), REPARTITION_BY_NUM" in initial(traces.assemble_traces(plain))


def test_most_spent(spark):
    rows = [(0, []), (1, [("a", 1), ("a", 2), ("b", 3)]), (2, [(None, 1), ("a", 5), ("b", 2)]), (3, [("a", None), ("b", 5), ("b", None)]), (4, [(None, 4), (None, 4), ("a", 7)])]
    df = spark.createDataFrame([(k, [(s, None if x is None else Decimal(x)) for s, x in v]) for k, v in rows], "k int, spent array<struct<service: string, ms: decimal(38,6)>>")
    got = {r.k: r.hot and (r.hot.service, r.hot.ms and int(r.hot.ms)) for r in df.select("k", findings.most_spent(F.col("spent")).alias("hot")).collect()}
    assert got == {0: None, 1: ("a", 3), 2: ("a", 5), 3: ("a", None), 4: (None, 8)}


def test_findings_work_out_only_what_is_asked_for(spark):
    _, spans, baselines = bundle_rows(spark)
    found = findings.findings(traces.assemble_traces(spans.where("trace_id in ('t', 'u')")), baselines)
    plan = found.groupBy("kind").count()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "format_string" not in plan and "error.message" not in plan and plan.count("Sort [trace_id#") == 4
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"error_span": 1, "baseline_breach": 1, "slow_span": 1, "retry_storm": 1, "fan_out": 1, "cache_miss": 1, "missing_spans": 1}
