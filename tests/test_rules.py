"""The rule table by hand: gauges that lose their samples, resets, series that go."""

from test_telemetry import BASE, at

from querypulse.operators import rules

SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double"


def states(spark, rows):
    df = spark.createDataFrame([(m, x, at(seconds=s), v) for m, x, s, v in rows], SAMPLES)
    out = {}
    for r in rules.alert_rows(df).collect():
        out.setdefault((r.alertname, r.labels), {})[int(r.ts.timestamp() - BASE.timestamp()) if r.ts.tzinfo else int((r.ts - BASE.replace(tzinfo=None)).total_seconds())] = r.state
    return out


def test_lag_and_down(spark):
    lag = {"consumergroup": "metrics-engine", "partition": "0"}
    rows = [("kafka_consumergroup_lag", lag, 0, 11_000.0), ("kafka_consumergroup_lag", lag, 300, 12_000.0), ("kafka_consumergroup_lag", lag, 600, 12_000.0), ("kafka_consumergroup_lag", {"consumergroup": "other"}, 0, 1e9)]
    rows += [("up", {"job": "api-gateway"}, s, 0.0 if s < 180 else 1.0) for s in range(0, 240, 30)] + [("up", {"job": "elsewhere"}, 0, 0.0)]
    got = states(spark, rows)
    behind = got["KafkaConsumerLagGrowing", "{}"]
    # a sample counts for 300 s: slots 0 to 270, 300 to 570, 600 to 870; fires 600 s after it began
    assert [s for s, x in sorted(behind.items()) if x == "firing"] == list(range(600, 900, 30)) and behind[570] == "pending"
    down = got["ServiceDown", '{"job":"api-gateway"}']
    assert [s for s, x in sorted(down.items()) if x == "firing"] == [120, 150] and down[180] == "inactive" and not any("elsewhere" in k[1] for k in got)


def test_growth(spark):
    kind, client = {"kind": "a"}, {"client": "c"}
    # 40 a sample, with a reset to 5: growth of 15 minutes passes 100 with the fourth sample
    values = [0.0, 40.0, 80.0, 120.0, 160.0, 5.0, 45.0]
    rows = [("engine_events_invalid_total", kind, 60 * k, v) for k, v in enumerate(values)]
    rows += [("collector_rate_limited_total", client, 30 * k, 400.0 * k) for k in range(40)]
    got = states(spark, rows)
    broken = got["ClickHouseWriteFailures", '{"kind":"a"}']
    assert broken[150] == "inactive" and broken[180] == "pending" and broken[480] == "firing" and broken[1050] == "firing" and broken[1080] == "inactive"
    limited = got["CollectorRateLimitingHeavily", '{"client":"c"}']
    # 13.3 a second, once eight samples of growth are within 300 s
    assert limited[210] == "inactive" and limited[240] == "pending" and limited[840] == "firing"


def test_records_of_nothing(spark):
    empty = spark.createDataFrame([], SAMPLES)
    assert rules.alert_rows(empty).count() == 0 and rules.recording_rows(empty).count() == 0
    odd = spark.createDataFrame([("other", None, BASE, 1.0), ("gateway_requests_total", {"endpoint": "/a", "status": "200"}, BASE, None)], SAMPLES)
    assert {r.value for r in rules.recording_rows(odd).collect()} <= {0.0, None}
