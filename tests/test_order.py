"""Percentiles from counts, preorder numbers of deep traces, long series in blocks."""

import random
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_telemetry import BASE, SPANS, at, events, series, span

from querypulse.operators import anomaly, monitoring, rollup, traces
from querypulse.operators.order_stats import nearest_ranks


def nearest(values, q):
    values = sorted(values, key=lambda x: (x != x, x))
    return values[max(1, min(len(values), int(-(-len(values) * q // 1)))) - 1] if values else None


def test_nearest_ranks(spark):
    """Ties, values far apart and close together, both infinities, NaN, nulls, null keys, a group without values."""
    random.seed(2)
    odd = [0.0, -0.0, 1e-300, -5.5, 1e300, float("inf"), float("-inf"), float("nan"), 7.0, 7.0, 7.0, 7.000000001]
    rows = [(random.choice(["a", "b", None]), random.choice([*odd, random.random(), random.gauss(0, 1e6), None]), random.choice([None, 1.0, 2.0])) for _ in range(900)] + [("one", 3.0, None), ("none", None, None)]
    wanted = {f"x{round(100 * q)}": ("x", q) for q in (0.01, 0.5, 0.95, 0.99, 1.0)} | {"y10": ("y", 0.1)}
    got = {r.k: r for r in nearest_ranks(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], wanted).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        for name, (c, q) in wanted.items():
            assert repr(r[name]).replace("-0.0", "0.0") == repr(nearest([x[1 if c == "x" else 2] for x in rows if x[0] == k and x[1 if c == "x" else 2] is not None], q)).replace("-0.0", "0.0"), (k, name)


def test_one_busy_service(spark):
    """A window whose values are all different; no aggregate gathers them."""
    n = 200_000
    df = spark.range(n).select(F.lit("busy").alias("service"), F.lit(BASE).alias("timestamp"), ((F.col("id") * 7919) % n + 1).cast("double").alias("latency_ms"), F.lit("ok").alias("status"), F.lit(None).cast("double").alias("relevance_score"), F.lit(True).alias("cache_hit"))
    rolled = rollup.metric_rollup(df)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    r = rolled.first()
    assert (r.query_count, r.latency_p50, r.latency_p95, r.latency_p99, r.relevance_p10) == (n, n * 0.5, n * 0.95, n * 0.99, None)


def test_rollup_of_nothing(spark):
    empty = rollup.metric_rollup(events(spark, []))
    assert empty.count() == 0 and empty.columns[:3] == ["window_start", "window_end", "service"]


def walk(rows):
    """{(trace, span): (preorder, depth)} by recursion."""
    found = {}
    for t in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == t}
        kids = {}
        for i, r in own.items():
            kids.setdefault(r[2] if r[2] in own else None, []).append((r[6], i))
        stack, n = [(i, 0) for _, i in sorted(kids.get(None, []), reverse=True)], 0
        while stack:
            i, d = stack.pop()
            found[t, i] = n, d
            n += 1
            stack += [(k, d + 1) for _, k in sorted(kids.get(i, []), reverse=True)]
    return found


def test_preorder(spark):
    random.seed(3)
    rows = []
    for t in range(30):
        for k in range(random.randint(1, 40)):
            parent = None if k == 0 or random.random() < 0.05 else "gone" if random.random() < 0.05 else f"s{random.randint(max(0, k - 4), k - 1):02}"
            rows.append(span(f"s{k:02}", parent, trace=f"t{t}", start=random.randint(0, 5)))
    tree = traces.assemble_traces(spark.createDataFrame(rows, SPANS))
    assert {(r.trace_id, r.span_id): (r.preorder, r.depth) for r in tree.collect()} == walk(rows)


def test_a_deep_chain(spark):
    """100 000 spans, each below the one before: their numbers, in rows of one size."""
    n = 100_000
    k = F.col("id")
    spans = spark.range(n).select(F.lit("t").alias("trace_id"), k.cast("string").alias("span_id"), F.when(k > 0, (k - 1).cast("string")).alias("parent_span_id"), F.lit("q").alias("query_id"), F.lit("s").alias("service"), F.lit("o").alias("operation"), F.timestamp_micros(k).alias("start_time"), F.lit(1.0).alias("duration_ms"), F.lit("ok").alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))
    tree = traces.assemble_traces(spans)
    assert not any(f.dataType.typeName() == "array" for f in tree.schema)
    r = tree.agg(F.count_if((F.col("depth") == F.col("span_id").cast("int")) & (F.col("preorder") == F.col("depth")) & (F.col("root") == "0") & F.col("on_critical_path")).alias("right"), F.max("depth").alias("deepest")).first()
    assert (r.right, r.deepest) == (n, n - 1)


def test_baselines_in_blocks(spark):
    random.seed(5)
    values = [random.random() * 100 for _ in range(400)]
    df = anomaly.unpivot_metrics(series(spark, values))
    df = df.where((F.unix_seconds("window_start") / 60).cast("long") % 7 != 3)  # with gaps
    plain = Window.partitionBy("service", "metric").orderBy("window_start").rowsBetween(-30, -1)
    want = df.withColumns({"baseline_mean": F.avg("observed").over(plain), "baseline_stddev": F.stddev_pop("observed").over(plain), "sample_count": F.count("observed").over(plain)})
    key = lambda d: sorted(tuple(r[c] for c in want.columns) for r in d.collect())
    for seconds in (60, 300, 3600, 604_800):
        assert str(key(anomaly.rolling_baseline(df, 30, seconds))) == str(key(want))


def test_counters_in_blocks(spark):
    random.seed(7)
    rows, value = [], 0.0
    for k in range(300):
        value = 0.0 if random.random() < 0.03 else value + random.randint(0, 5)
        rows.append(("m", {"s": "a"}, BASE + timedelta(minutes=37 * k + random.randint(0, 30)), value))
    got = {r.ts: r.increase for r in monitoring.counter_increase(spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double"), 7200).collect()}
    deltas = [(t, 0.0 if k == 0 else v if v < rows[k - 1][3] else v - rows[k - 1][3]) for k, (_, _, t, v) in enumerate(rows)]
    want = {t.replace(tzinfo=None): sum(d for u, d in deltas if timedelta(0) <= t - u < timedelta(hours=2)) for t, _ in deltas}
    assert got == want and at(minutes=0) is not None
