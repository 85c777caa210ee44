"""Registered queries of single records, stored tables and checks, and their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querypulse.functions.columns import format_percent, format_score, time_range
from querypulse.operators import dashboards, monitoring, replay, rollup, traces, validate
from querypulse.plans import views
from querypulse.plans.queries import AN, AS_OF, EV, LATENCIES, LINES, RANGE, RU, SIX_HOURS, SP, anomalies, events_with_results, query, r9, rollups, sec
from querypulse.sources import tables


@query(f"WITH {RU} SELECT ws AS window_start, service, {', '.join(f'round_even({c}, 3) AS {c}' for c in LATENCIES if c != 'latency_avg')}, {', '.join(f'round_even({c}, 6) AS {c}' for c in ('error_rate', 'relevance_avg', 'relevance_p10', 'cache_hit_rate'))} FROM ru")
def rollup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups as they are stored; their mean latency, whose last digit hangs on the order of a sum, is left out."""
    rows = rollup.rollup_rows(rollup.ordered_rollup(views.search_events(spark, sf_dir), SIX_HOURS))
    return rows.select(sec("window_start"), "service", *(c for c in LATENCIES if c != "latency_avg"), "error_rate", "relevance_avg", "relevance_p10", "cache_hit_rate")


@query(f"WITH {EV}, m AS (SELECT epoch(max(timestamp)) - 5 AS m FROM ev) SELECT epoch(time_bucket(INTERVAL '6 hours', timestamp))::BIGINT AS window_start, service, count(*) AS query_count, quantile_disc(latency_ms, 0.95) AS latency_p95 FROM ev, m WHERE epoch(time_bucket(INTERVAL '6 hours', timestamp)) + 21600 > m.m GROUP BY ALL")
def flush_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.flush_open(views.search_events(spark, sf_dir), SIX_HOURS).select(sec("window_start"), "service", "query_count", "latency_p95")


@query("SELECT 'e-' || event_id AS event_id, value AS latency_ms, 'a' AS kept FROM events")
def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event three times, with metadata that differ: the least by its columns stays, whole."""
    e = views.search_events(spark, sf_dir).select("event_id", "timestamp", "latency_ms")
    copies = [e.withColumn("metadata", F.create_map(F.lit("node"), F.lit(n))) for n in ("c", "a", "b")]
    return rollup.dedupe_events(copies[0].unionByName(copies[1]).unionByName(copies[2])).select("event_id", "latency_ms", F.col("metadata")["node"].alias("kept"))


@query("SELECT 'q-' || user_id AS query_id, floor(epoch(max(ts)))::BIGINT AS timestamp, 'm-' || arg_max(event_id, (ts, 'svc-' || (user_id % 4), value, 'm-' || event_id)) AS note FROM events GROUP BY user_id")
def event_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, taken for a query, with its metadata."""
    e = views.table(spark, sf_dir, "events").select(F.concat(F.lit("q-"), F.col("user_id").cast("string")).alias("query_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"), F.col("value").alias("latency_ms"), F.create_map(F.lit("note"), F.concat(F.lit("m-"), F.col("event_id").cast("string"))).alias("metadata"))
    return replay.newest_events(e).select("query_id", sec("timestamp"), F.col("metadata")["note"].alias("note"))


@query(f"WITH {LINES}, d AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT CASE WHEN rn = 3 THEN 2 ELSE rn END) AS ranks FROM ln GROUP BY 1) SELECT 'q-' || l_orderkey AS query_id, ranks = n AS unique_ranks, n <= 4 AS within_count FROM d")
def result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists whose third rank is given twice, and a count that is too low for lists of five and more."""
    e = validate.strip_strings(events_with_results(spark, sf_dir).withColumn("query_id", F.concat(F.lit("  "), "query_id", F.lit(" "))))
    twice = F.transform("results", lambda r: F.struct(r["document_id"].alias("document_id"), F.when(r["rank"] == 3, 2).otherwise(r["rank"]).alias("rank")))
    return e.select("query_id", validate.unique_ranks(twice).alias("unique_ranks"), validate.results_within_count(F.col("results"), F.least("result_count", F.lit(4))).alias("within_count"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'svc-1' ELSE 'svc-' || (o_custkey % 3) END AS target FROM orders WHERE o_orderkey % 4 IN (0, 1) AND NOT (o_orderkey % 4 = 1 AND o_custkey % 3 = 2)")
def safe_replay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a service that is allowed, for none (the recorded one counts), for an address and for an unknown one."""
    o = views.table(spark, sf_dir, "orders")
    asked = F.element_at(F.array(F.lit("svc-1"), F.lit("  "), F.lit("http://evil/"), F.lit("svc-9")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    requests = o.select(F.col("o_orderkey").alias("id"), asked.alias("candidate"), F.concat(F.lit("svc-"), (F.col("o_custkey") % 3).cast("string")).alias("recorded_service"))
    return replay.safe_replay_targets(requests, spark.createDataFrame([("svc-0",), ("svc-1",)], "service string")).select("id", "target")


@query("SELECT 'j-' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def replay_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id."""
    o = views.table(spark, sf_dir, "orders")
    jobs = o.select(F.concat(F.lit("j-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("status"))
    return tables.replay_job(jobs, f"j-{o.agg(F.max('o_orderkey')).first()[0]}")


@query(f"WITH {SP}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY us, span_id) AS i FROM sp WHERE trace_id = (SELECT 't-' || min(l_orderkey) FROM lineitem)) SELECT trace_id, span_id FROM r")
def spans_for_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = views.table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return traces.spans_for_trace(views.order_spans(spark, sf_dir), f"t-{first}").select("trace_id", "span_id")


@query("SELECT conv_id::VARCHAR AS trace_id, count(*) AS spans, conv_id % 3 = 0 AS cyclic, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE max(turn) END AS deepest, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE sum(turn) END AS preorders FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def trace_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains of spans, every third one closed to a circle; each span comes twice."""
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    # turns may be missing, so a span hangs below the turn before that there is
    order = c.join(last, "conv_id").selectExpr("conv_id", "turn", "last", "lag(turn) over (partition by conv_id order by turn) as before", "row_number() over (partition by conv_id order by turn) - 1 as n")
    up = F.when(F.col("before").isNotNull(), F.col("before")).when(F.col("conv_id") % 3 == 0, F.col("last"))
    one = order.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), up.cast("string").alias("parent_span_id"), F.lit("q").alias("query_id"), F.lit("s").alias("service"), F.lit("o").alias("operation"), F.timestamp_seconds("n").alias("start_time"), F.lit(1.0).alias("duration_ms"), F.lit("ok").alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))
    tree = traces.assemble_traces(one.unionByName(one))
    return tree.groupBy("trace_id").agg(F.count("*").alias("spans"), F.max("cyclic").alias("cyclic"), F.max("depth").cast("long").alias("deepest"), F.sum("preorder").alias("preorders"))


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, round(coalesce(sum(error_count) FILTER (service = 'svc-0') / nullif(sum(query_count) FILTER (service = 'svc-0'), 0)::DOUBLE, 0), 6) AS svc_0, 0.0::DOUBLE AS svc_9 FROM ru WHERE ws BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-20') GROUP BY 1")
def error_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate of each day as a chart shows it: 0 where a service has none."""
    s = dashboards.error_series(rollups(spark, sf_dir), RANGE, interval="1d")
    p = dashboards.pivot_series(s, "error_rate", ["svc-0", "svc-9"], missing=0.0)
    return p.select(sec("bucket"), F.col("`svc-0`").alias("svc_0"), F.col("`svc-9`").alias("svc_9"))


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, service, sum(query_count)::BIGINT AS query_count, format('{{:.2f}}%', 100.0 * sum(error_count) / sum(query_count)) AS shown, format('{{:.3f}}', floor(1000.0 * sum(error_count) / sum(query_count) + 0.5) / 1000) AS score FROM ru WHERE service = 'svc-2' AND ws BETWEEN epoch(TIMESTAMP '2024-01-13') AND epoch(TIMESTAMP '2024-01-20') GROUP BY ALL")
def one_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week back from an instant, of one service."""
    s = dashboards.error_series(rollups(spark, sf_dir), time_range(7 * 1440, as_of=AS_OF), service="svc-2", interval="1d")
    rate = F.col("error_count") / F.col("query_count")
    return s.select(sec("bucket"), "service", "query_count", format_percent(rate).alias("shown"), format_score(rate).alias("score"))


@query(f"""WITH {AN} SELECT 'events' AS table_name, (SELECT count(*) FROM events) AS row_count, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS newest UNION ALL SELECT 'query_results', (SELECT count(*) FROM lineitem), '2024-01-01 00:00:00'
  UNION ALL SELECT 'metric_rollups', count(*), strftime(make_timestamp(max(ws) * 1000000), '%Y-%m-%d %H:%M:%S') FROM ru UNION ALL SELECT 'anomalies', count(*), coalesce(strftime(make_timestamp(max(ws) * 1000000), '%Y-%m-%d %H:%M:%S'), '—') FROM an
  UNION ALL SELECT 'spans', (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) + (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0), (SELECT strftime(make_timestamp(max(us)), '%Y-%m-%d %H:%M:%S') FROM (SELECT epoch_us(o_orderdate) + 1000 * count(*) AS us FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate UNION ALL SELECT epoch_us(o_orderdate) FROM orders WHERE o_orderkey % 10 <> 0))""")
def telemetry_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five telemetry tables."""
    results = validate.result_rows(events_with_results(spark, sf_dir))
    found = {"events": (views.search_events(spark, sf_dir), "timestamp"), "query_results": (results, "timestamp"), "metric_rollups": (rollups(spark, sf_dir), "window_start"), "anomalies": (anomalies(spark, sf_dir), "window_start"), "spans": (views.order_spans(spark, sf_dir), "start_time")}
    return dashboards.table_freshness(found)


UP = f"""{RU}, up AS (SELECT ws AS ts, service AS job, CASE WHEN query_count < 15 THEN 0 ELSE 1 END AS value FROM ru)"""


def _up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups(spark, sf_dir).select(F.col("window_start").alias("ts"), F.col("service").alias("job"), F.when(F.col("query_count") < 15, 0.0).otherwise(1.0).alias("value"))


@query(f"WITH {UP}, r AS (SELECT *, sum(value) OVER (PARTITION BY job ORDER BY ts) AS run FROM up) SELECT job, ts, CASE WHEN value = 1 THEN 'inactive' WHEN ts - min(ts) OVER (PARTITION BY job, run, value) >= 21600 THEN 'firing' ELSE 'pending' END AS state FROM r")
def service_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services with few queries are taken to be down."""
    return monitoring.service_down(_up(spark, sf_dir), SIX_HOURS).select("job", sec("ts"), "state")


@query(f"WITH {UP} SELECT ts, sum(value)::DOUBLE AS value FROM up GROUP BY ts")
def services_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.services_up(_up(spark, sf_dir)).select(sec("ts"), "value")


@query(f"WITH {RU}, t AS (SELECT ws AS ts, sum(query_count) AS n, sum(error_count) AS e FROM ru GROUP BY ws), a AS (SELECT *, n > 60 AND e = 0 AS stalled, n > 85 AS behind FROM t), r AS (SELECT *, sum(CASE WHEN stalled THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS sr, sum(CASE WHEN behind THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS br FROM a) SELECT ts, CASE WHEN NOT stalled THEN 'inactive' WHEN ts - min(ts) OVER (PARTITION BY sr, stalled) >= 21600 THEN 'firing' ELSE 'pending' END AS stalled, CASE WHEN NOT behind THEN 'inactive' WHEN ts - min(ts) OVER (PARTITION BY br, behind) >= 43200 THEN 'firing' ELSE 'pending' END AS behind FROM r")
def engine_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules over sums: much comes in and none fails (in place of: none is processed), and more than 85 wait in all partitions together."""
    r = rollups(spark, sf_dir).select(F.col("window_start").alias("ts"), "service", F.col("query_count").cast("double").alias("n"), F.col("error_count").cast("double").alias("e"))
    total = r.groupBy("ts").agg((F.sum("n") / 60).alias("n"), F.sum("e").alias("e"))
    stalled = monitoring.engine_stalled(total.select("ts", F.col("n").alias("value")), total.select("ts", F.col("e").alias("value")), SIX_HOURS)
    behind = monitoring.consumer_lag_alert(r.select("ts", F.col("service").alias("partition"), F.col("n").alias("value")), 85, 2 * SIX_HOURS)
    return stalled.select("ts", F.col("state").alias("stalled")).join(behind.select("ts", F.col("state").alias("behind")), "ts").select(sec("ts"), "stalled", "behind")


@query(f"WITH {EV} SELECT event_id, floor(epoch(timestamp))::BIGINT AS timestamp FROM ev WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a table by day in the shared folder, and a range of them read back."""
    from querypulse.operators.traces import shared_folder

    folder = shared_folder(spark, "tables")
    tables.write_table(views.search_events(spark, sf_dir), folder, "events")
    return tables.read_table(spark, folder, "events", time_range=RANGE).select("event_id", sec("timestamp"))


@query("SELECT 'e-' || event_id AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-13'")
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day, and what is left once days of 90 days ago and more are gone."""
    from querypulse.operators.traces import shared_folder

    folder = shared_folder(spark, "tables")
    tables.write_table(views.search_events(spark, sf_dir), folder, "events")
    tables.expire_files(spark, folder, "events", datetime(2024, 4, 12, tzinfo=timezone.utc))
    return spark.read.parquet(f"{folder}/events").select("event_id")


