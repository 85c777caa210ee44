"""The registered queries of the library and their SQL. Times are epoch seconds, doubles rounded."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querypulse.functions.columns import confidence_band, error_tone, format_ms, label_matches, latency_tone
from querypulse.operators import anomaly, dashboards, findings, monitoring, replay, rollup, traces, validate
from querypulse.plans import views
from querypulse.sources import tables

SIX_HOURS = 21_600
AS_OF = datetime(2024, 1, 20, tzinfo=timezone.utc)
RANGE = (datetime(2024, 1, 5, tzinfo=timezone.utc), AS_OF)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The same views in SQL.
EV = """ev AS (SELECT 'e-' || event_id AS event_id, 'q-' || event_id AS query_id, 'svc-' || (user_id % 4) AS service, ts AS timestamp, value AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  event_type = 'view' AS cache_hit, CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS relevance_score FROM events)"""
RU = f"""{EV}, ru AS (SELECT epoch(time_bucket(INTERVAL '6 hours', timestamp))::BIGINT AS ws, service, count(*) AS query_count, count(*) FILTER (status <> 'ok') AS error_count, count(*) FILTER (status <> 'ok') / count(*)::DOUBLE AS error_rate,
  quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95, quantile_disc(latency_ms, 0.99) AS latency_p99, avg(latency_ms) AS latency_avg, max(latency_ms) AS latency_max, avg(relevance_score) AS relevance_avg,
  quantile_disc(relevance_score, 0.1) AS relevance_p10, count(*) FILTER (cache_hit) / count(*)::DOUBLE AS cache_hit_rate FROM ev GROUP BY ALL)"""
AN = f"""{RU}, un AS ({' UNION ALL '.join(f"SELECT service, ws, query_count AS samples, '{m}' AS metric, {m}::DOUBLE AS observed FROM ru" for m in ('latency_p95', 'latency_p99', 'error_rate', 'query_count'))}),
  bl AS (SELECT *, avg(observed) OVER w AS m, stddev_pop(observed) OVER w AS s, count(observed) OVER w AS n FROM un WINDOW w AS (PARTITION BY service, metric ORDER BY ws ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
  an AS (SELECT service, metric, ws, ws + 21600 AS we, observed, m, s, n, (observed - m) / s AS z, CASE WHEN abs((observed - m) / s) >= 6 THEN 'critical' ELSE 'warning' END AS severity FROM bl WHERE n >= 5 AND s > 0 AND samples >= 10 AND abs((observed - m) / s) >= 3)"""
IN_RANGE = "ws BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-20')"
SP = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
  sp AS (SELECT 't-' || o_orderkey AS trace_id, 'o-' || o_orderkey AS span_id, NULL AS parent, 'gateway' AS service, 'order' AS operation, epoch_us(o_orderdate) AS us, o_totalprice / 1000 AS ms, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, false AS miss FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT 't-' || l_orderkey, 'l-' || l_orderkey || '-' || rn, 'o-' || l_orderkey, l_returnflag, l_linestatus, epoch_us(o_orderdate) + 1000 * rn, l_extendedprice / 1000, 'ok', l_discount >= 0.09 FROM ln JOIN orders ON o_orderkey = l_orderkey),
  kids AS (SELECT trace_id, parent AS span_id, sum(ms) AS kid_ms, count(*) AS n FROM sp WHERE parent IS NOT NULL GROUP BY ALL),
  tr AS (SELECT sp.*, CASE WHEN sp.parent IS NULL THEN 'root' WHEN p.span_id IS NULL THEN 'orphan' ELSE 'child' END AS state, p.span_id AS up, coalesce(k.n, 0) AS n_children, greatest(0, sp.ms - coalesce(k.kid_ms, 0)) AS self_ms
    FROM sp LEFT JOIN sp p ON p.trace_id = sp.trace_id AND p.span_id = sp.parent LEFT JOIN kids k ON k.trace_id = sp.trace_id AND k.span_id = sp.span_id),
  sm AS (SELECT trace_id, count(*) AS span_count, count(*) FILTER (state = 'orphan') AS orphan_count, string_agg(DISTINCT service, ',' ORDER BY service) AS services, round(max(us / 1000.0 + ms) - min(us / 1000.0) + 1e-9, 3) AS total_ms FROM tr GROUP BY ALL)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def sec(column: str, name: str | None = None):
    return F.unix_seconds(F.col(column).cast("timestamp")).alias(name or column)


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.metric_rollup(views.search_events(spark, sf_dir), SIX_HOURS)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect_anomalies(rollups(spark, sf_dir))


LATENCIES = ("latency_p50", "latency_p95", "latency_p99", "latency_avg", "latency_max")
RATES = ("error_rate", "relevance_avg", "relevance_p10", "cache_hit_rate")


@query(f"WITH {RU} SELECT ws AS window_start, ws + 21600 AS window_end, service, query_count, error_count, {', '.join(f'round({c}, 9) AS {c}' for c in LATENCIES + RATES)} FROM ru")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups(spark, sf_dir).select(sec("window_start"), sec("window_end"), "service", "query_count", "error_count", *r9(*LATENCIES, *RATES))


@query(f"WITH {AN} SELECT service, metric, ws AS window_start, we AS window_end, round(observed, 9) AS observed, round(m, 9) AS baseline_mean, round(s, 9) AS baseline_stddev, n AS sample_count, round(z, 9) AS z_score, severity, service || ':' || metric || ':' || severity AS signature FROM an")
def detect_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).select("service", "metric", sec("window_start"), sec("window_end"), *r9("observed", "baseline_mean", "baseline_stddev"), "sample_count", *r9("z_score"), "severity", "signature")


@query(f"WITH {AN} SELECT service || ':' || metric || ':' || severity AS signature, min(we) AS first_fired, max(we) AS last_fired, count(*) AS fire_count FROM an GROUP BY ALL")
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.alert_state(anomalies(spark, sf_dir)).select("signature", sec("first_fired"), sec("last_fired"), "fire_count")


@query(f"WITH {AN}, g AS (SELECT *, service || ':' || metric || ':' || severity AS signature, we - lag(we) OVER (PARTITION BY service, metric, severity ORDER BY we) AS gap FROM an) SELECT signature, we AS window_end FROM g WHERE gap IS NULL OR gap > 86400")
def suppress_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.suppress_duplicates(anomalies(spark, sf_dir), 86_400).select("signature", sec("window_end"))


@query(f"WITH {AN} SELECT service, ws AS window_start, metric, format('{{}} is {{:.1f}}σ {{}} a baseline of {{:.1f}} ± {{:.1f}}', metric, abs(z), CASE WHEN z > 0 THEN 'above' ELSE 'below' END, m, s) AS explanation FROM an")
def explain_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).select("service", sec("window_start"), "metric", anomaly.explain_anomaly().alias("explanation"))


@query(f"WITH {AN} SELECT we - we % 86400 AS period, severity, count(*) AS anomalies FROM an GROUP BY ALL")
def anomaly_storm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.storm_counts(anomalies(spark, sf_dir), 86_400).select(sec("period"), "severity", "anomalies")


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, service, {', '.join(f'round(avg({c}) + 1e-9, 2) AS {c}' for c in LATENCIES[:4])}, round(max(latency_max), 2) AS latency_max, sum(query_count)::BIGINT AS query_count FROM ru WHERE {IN_RANGE} GROUP BY ALL")
def latency_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dashboards.latency_series(rollups(spark, sf_dir), RANGE, interval="1d")
    return s.select(sec("bucket"), *[c for c in s.columns if c != "bucket"])


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, service, round(avg(relevance_avg) + 1e-9, 4) AS relevance_avg, round(avg(relevance_p10) + 1e-9, 4) AS relevance_p10, sum(query_count)::BIGINT AS queries FROM ru WHERE {IN_RANGE} AND relevance_avg IS NOT NULL GROUP BY ALL")
def relevance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.relevance_series(rollups(spark, sf_dir), RANGE, interval="1d").select(sec("bucket"), "service", "relevance_avg", "relevance_p10", "queries")


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, service, sum(query_count)::BIGINT AS query_count, sum(error_count)::BIGINT AS error_count, round(sum(error_count) / nullif(sum(query_count), 0)::DOUBLE, 6) AS error_rate, CASE WHEN sum(error_count) / sum(query_count)::DOUBLE >= 0.05 THEN 'bad' WHEN sum(error_count) / sum(query_count)::DOUBLE >= 0.01 THEN 'warn' ELSE 'good' END AS tone FROM ru WHERE {IN_RANGE} GROUP BY ALL")
def error_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.error_series(rollups(spark, sf_dir), RANGE, interval="1d").select(sec("bucket"), "service", "query_count", "error_count", "error_rate", error_tone(F.col("error_count") / F.col("query_count")).alias("tone"))


@query(f"WITH {AN} SELECT sum(query_count)::BIGINT AS query_count, sum(error_count)::BIGINT AS error_count, round(sum(error_count) / sum(query_count)::DOUBLE, 6) AS error_rate, round(avg(latency_p50) + 1e-9, 2) AS latency_p50, round(avg(latency_p95) + 1e-9, 2) AS latency_p95, round(avg(latency_p99) + 1e-9, 2) AS latency_p99, round(avg(relevance_avg) + 1e-9, 4) AS relevance_avg, round(avg(cache_hit_rate) + 1e-9, 4) AS cache_hit_rate, count(DISTINCT service) AS services, (SELECT count(*) FROM an WHERE {IN_RANGE}) AS open_anomalies FROM ru WHERE {IN_RANGE}")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollups(spark, sf_dir)
    return dashboards.summary(r, anomaly.detect_anomalies(r), RANGE)


@query(f"WITH {RU} SELECT service, sum(query_count)::BIGINT AS query_count, round(avg(latency_p95) + 1e-9, 2) AS latency_p95, round(sum(error_count) / sum(query_count)::DOUBLE, 6) AS error_rate, CASE WHEN avg(latency_p95) >= 2000 THEN 'bad' WHEN avg(latency_p95) >= 1000 THEN 'warn' ELSE 'good' END AS tone FROM ru WHERE {IN_RANGE} GROUP BY service")
def service_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.service_table(rollups(spark, sf_dir), RANGE).withColumn("tone", latency_tone(F.col("latency_p95")))


@query(f"WITH {AN} SELECT service, metric, ws AS window_start, severity, round(z, 9) AS z_score FROM an WHERE {IN_RANGE} AND severity = 'warning' ORDER BY we DESC, service, metric LIMIT 10 OFFSET 2")
def anomaly_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.anomaly_page(anomalies(spark, sf_dir), RANGE, severity="warning", limit=10, offset=2).select("service", "metric", sec("window_start"), "severity", *r9("z_score"))


@query(f"WITH {EV} SELECT query_id, service, floor(epoch(timestamp))::BIGINT AS timestamp, latency_ms, status, format('{{:.0f}} ms', latency_ms) AS shown FROM ev WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ev.latency_ms DESC, query_id LIMIT 20")
def slowest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.slowest_queries(views.search_events(spark, sf_dir), RANGE).select("query_id", "service", sec("timestamp"), "latency_ms", "status", format_ms(F.col("latency_ms")).alias("shown"))


@query("SELECT 'events' AS table_name, count(*) AS row_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events UNION ALL SELECT 'orders', count(*), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders UNION ALL SELECT 'lineitem', count(*), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem")
def table_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: views.table(spark, sf_dir, n)
    return dashboards.table_freshness({"events": (t("events"), "ts"), "orders": (t("orders"), "o_orderdate"), "lineitem": (t("lineitem"), "l_shipdate")})


@query(f"WITH {EV} SELECT service, count(*) AS queries, round(avg(latency_ms) + 1e-9, 1) AS avg_ms, round(100.0 * count(*) FILTER (status <> 'ok') / count(*), 2) AS error_pct FROM ev WHERE timestamp > TIMESTAMP '2024-01-19' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY service")
def recent_service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.recent_service_stats(views.search_events(spark, sf_dir), AS_OF, minutes=1440)


@query(f"WITH {RU}, slo(service, p, e) AS (VALUES ('svc-0', 2000, 0.01), ('svc-1', 1500, 0.005), ('svc-2', 3000, 0.01), ('svc-3', 500, 0.02)) SELECT service, ws AS window_start, round(latency_p99, 9) AS latency_p99, round(error_rate, 9) AS error_rate, latency_p99 > p AS latency_breach, error_rate > e AS error_breach FROM ru JOIN slo USING (service) WHERE latency_p99 > p OR error_rate > e")
def slo_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.slo_breaches(rollups(spark, sf_dir), dashboards.services_dim(spark)).select("service", sec("window_start"), *r9("latency_p99", "error_rate"), "latency_breach", "error_breach")


@query(f"WITH {RU} SELECT ws - ws % 86400 AS bucket, {', '.join(f'''round(avg(latency_p95) FILTER (service = 'svc-{k}') + 1e-9, 2) AS svc_{k}''' for k in range(4))} FROM ru WHERE {IN_RANGE} GROUP BY 1")
def pivot_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"svc-{k}" for k in range(4)]
    p = dashboards.pivot_series(dashboards.latency_series(rollups(spark, sf_dir), RANGE, interval="1d"), "latency_p95", names)
    return p.select(sec("bucket"), *(F.col(f"`{n}`").alias(n.replace("-", "_")) for n in names))


@query(f"WITH {RU} SELECT service, round(avg(latency_p95), 9) AS baseline_p95 FROM ru WHERE ws > epoch(TIMESTAMP '2024-01-10') GROUP BY service")
def service_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.service_baselines(rollups(spark, sf_dir), AS_OF, minutes=14_400).select("service", *r9("baseline_p95"))


@query(f"WITH {EV} SELECT DISTINCT service FROM ev")
def known_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.known_services(views.search_events(spark, sf_dir))


@query(f"WITH {EV}, w AS (SELECT DISTINCT epoch(time_bucket(INTERVAL '6 hours', timestamp))::BIGINT AS ws, service FROM ev) SELECT ws AS window_start, service FROM w WHERE ws + 21600 > (SELECT epoch(max(timestamp)) - 5 FROM ev)")
def open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.open_windows(views.search_events(spark, sf_dir), SIX_HOURS).select(sec("window_start"), "service")


@query(f"WITH {RU} SELECT ws AS window_start, service, query_count, round(latency_p95, 9) AS latency_p95 FROM ru")
def repair_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of events come late: windows without them, repaired, are the whole windows."""
    e = views.search_events(spark, sf_dir)
    late = F.substring("event_id", 3, 20).cast("long") % 10 == 0
    first = rollup.metric_rollup(e.where(~late), SIX_HOURS).withColumn("inserted_at", F.lit(RANGE[0]))
    again = rollup.repair_late(e, e.where(late), SIX_HOURS, inserted_at=AS_OF)
    return tables.latest_by(first.unionByName(again), ("service", "window_start"), "inserted_at").select(sec("window_start"), "service", "query_count", *r9("latency_p95"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_by(views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ("o_custkey",), "o_orderkey")


@query("SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 0 ELSE 1 END AS v FROM customer")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = c.where("k % 2 <> 0 or k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, F.lit("changed")).otherwise(F.col("name")).alias("name"), F.lit(1).alias("v"))
    return tables.upsert(c.where("k % 2 = 0").withColumn("v", F.lit(0)), new, ("k",), keep=("name",))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM customer")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return tables.insert_if_absent(c.where("k % 2 = 0").withColumn("v", F.lit("old")), c.where("k % 2 <> 0 or k % 3 = 0").withColumn("v", F.lit("new")), ("k",))


@query("SELECT 'e-' || event_id AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-13'")
def expire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.expire(views.search_events(spark, sf_dir), "timestamp", 7, AS_OF).select("event_id")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search events as they come in, with faults: every 7th has a negative latency, every 11th no zone, every 13th no error type where it fails."""
    e = views.search_events(spark, sf_dir).withColumn("n", F.substring("event_id", 3, 20).cast("long"))
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("n") % 11 == 0, "").otherwise("Z"))
    return e.select("n", "event_id", "query_id", "service", F.lit("words").alias("query"), stamp.alias("timestamp"), F.when(F.col("n") % 7 == 0, -1.0).otherwise(F.col("latency_ms")).alias("latency_ms"), "status", "result_count", "relevance_score", F.when(F.col("n") % 13 != 0, F.col("error_type")).alias("error_type"), F.lit(None).cast("string").alias("error_message"), F.concat(F.lit("r-"), F.floor(F.col("n") / 100).cast("string")).alias("request_id"), (F.col("n") % 100).alias("index_in_batch"))


FAULTS = "concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'latency_ms: not within 0 and 600000' END, CASE WHEN event_id % 11 = 0 THEN 'timestamp: no time with a zone' END, CASE WHEN event_type = 'error' AND event_id % 13 = 0 THEN 'error_type: missing for a failure' END)"


@query(f"SELECT event_id AS n, {FAULTS} AS violations FROM events")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = validate.validate_events(raw_events(spark, sf_dir))
    return good.select("n", F.lit("").alias("violations")).unionByName(bad.select("n", F.array_join("violations", "; ").alias("violations")))


@query(f"WITH j AS (SELECT event_id // 100 AS r, event_id % 100 AS i, {FAULTS} AS f FROM events) SELECT 'r-' || r AS request_id, count(*) FILTER (f = '') AS accepted, count(*) FILTER (f <> '') AS rejected, coalesce(string_agg('event ' || i || ': ' || string_split(f, '; ')[1], ' | ' ORDER BY i) FILTER (f <> ''), '') AS errors FROM j GROUP BY r")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = validate.batch_size_gate(raw_events(spark, sf_dir))
    return validate.ingest_summary(validate.validate_events(raw)[1], raw).select("request_id", "accepted", "rejected", F.array_join("errors", " | ").alias("errors"))


@query("SELECT 'r-' || (event_id // 700) AS batch, count(*) AS entries FROM events GROUP BY 1 HAVING count(*) <= 500")
def batch_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 700 are refused whole, what is left over at the end passes."""
    e = views.table(spark, sf_dir, "events").select(F.concat(F.lit("r-"), F.floor(F.col("event_id") / 700).cast("string")).alias("batch"))
    return validate.batch_size_gate(e, by="batch").groupBy("batch").agg(F.count("*").alias("entries"))


@query(f"SELECT 'q-' || event_id AS key, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'events' END AS topic, 'e-' || event_id AS event_id FROM events")
def route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_topic(views.search_events(spark, sf_dir), "events").select("key", "topic", F.get_json_object("value", "$.event_id").alias("event_id"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'spans' WHEN 1 THEN 'results' WHEN 2 THEN 'events' ELSE 'invalid' END AS kind FROM events")
def route_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    shapes = F.when(n % 4 == 0, '{"span_id": "s", "operation": "o", "latency_ms": 1}').when(n % 4 == 1, '{"query_id": "q", "results": []}').when(n % 4 == 2, '{"query_id": "q", "results": [], "latency_ms": 2}').otherwise("{broken")
    routed = validate.route_by_shape(views.table(spark, sf_dir, "events").select("event_id", shapes.alias("value")))
    parts = [df.select("event_id", F.lit(k).alias("kind")) for k, df in routed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound events as they come in, received 250 ms after their time where their number is even, without metadata where it is odd."""
    e = views.search_events(spark, sf_dir).withColumn("n", F.substring("event_id", 3, 20).cast("long"))
    none = F.lit(None).cast("string")
    at = F.timestamp_micros(F.unix_micros(F.date_trunc("second", "timestamp")) + 250_000)
    metadata = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("received_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))
    return e.select("n", "event_id", "query_id", none.alias("trace_id"), none.alias("span_id"), "service", F.lit("words").alias("query"), none.alias("index"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "latency_ms", "status", "result_count", "relevance_score", "cache_hit", none.alias("user_id"), none.alias("session_id"), "error_type", none.alias("error_message"), metadata.alias("metadata"))


@query("SELECT 'e-' || event_id AS event_id, '' AS trace_id, '' AS index_name, epoch_ms(date_trunc('second', ts)) AS at_ms, epoch_ms(date_trunc('second', ts)) + CASE WHEN event_id % 2 = 0 THEN 250 ELSE 0 END AS received_ms, CASE WHEN event_id % 2 = 0 THEN 250 ELSE 0 END AS skew_ms, (event_type = 'view')::INT AS cache_hit, CASE WHEN event_type = 'error' THEN 'Upstream' ELSE '' END AS error_type FROM events")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.event_rows(stored_events(spark, sf_dir))
    return rows.select("event_id", "trace_id", "index_name", F.unix_millis("timestamp").alias("at_ms"), F.unix_millis("received_at").alias("received_ms"), validate.clock_skew_ms().cast("int").alias("skew_ms"), "cache_hit", "error_type")


@query("SELECT 'e-' || event_id AS event_id, CASE WHEN event_id % 2 = 0 THEN 't-' || event_id ELSE 'fallback' END AS trace_id, '2024-01-20T00:00:00.000Z' AS received_at FROM events")
def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored_events(spark, sf_dir).withColumn("trace_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("t-"), F.col("n").cast("string"))).otherwise(""))
    return validate.enrich(e, AS_OF, F.lit("fallback")).select("event_id", "trace_id", F.col("metadata")["received_at"].alias("received_at"))


@query("SELECT 'e-' || event_id AS event_id, 'svc-' || (user_id % 4) AS service, value AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 3 = 0 THEN 'surprise' ELSE '' END AS unknown_fields FROM events")
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to JSON and back; every third has a field that no schema knows."""
    e = stored_events(spark, sf_dir)
    plain = validate.encode_json(e.where("n % 3 <> 0").drop("n")).unionByName(validate.encode_json(e.where("n % 3 = 0").drop("n").withColumn("surprise", F.lit(1))))
    return validate.decode_events(plain).select("event_id", "service", "latency_ms", "status", F.array_join("unknown_fields", ",").alias("unknown_fields"))


def events_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events that list their lines as results; titles are missing."""
    found = views.query_results(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "document_id"))).alias("r"))
    results = F.transform("r", lambda x: F.struct(x["document_id"].alias("document_id"), x["rank"].alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("title")))
    return found.select("query_id", F.lit("gateway").alias("service"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), results.alias("results"), F.size("r").alias("result_count"))


LINES = "ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"


@query(f"WITH {LINES} SELECT 'q-' || l_orderkey AS query_id, l_partkey::VARCHAR AS document_id, rn::INT AS rank, 0.0::DOUBLE AS score, '' AS title, epoch(TIMESTAMP '2024-01-01')::BIGINT AS timestamp FROM ln")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.result_rows(events_with_results(spark, sf_dir)).select("query_id", "document_id", "rank", "score", "title", sec("timestamp"))


@query(f"WITH {LINES} SELECT 'q-' || l_orderkey AS key, count(*) AS results, max(l_partkey) FILTER (rn = 1)::VARCHAR AS first_document FROM ln GROUP BY l_orderkey")
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.result_records(events_with_results(spark, sf_dir))
    return rows.select("key", F.json_array_length(F.get_json_object("value", "$.results")).cast("long").alias("results"), F.get_json_object("value", "$.results[0].document_id").alias("first_document"))


@query(f"WITH {LINES}, d AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS ids FROM ln GROUP BY 1) SELECT 'q-' || l_orderkey AS query_id, ids AS document_ids FROM d")
def documents_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.documents_in_order(views.query_results(spark, sf_dir)).select("query_id", F.array_join("document_ids", ",").alias("document_ids"))


@query(f"WITH {SP} SELECT trace_id, span_id, coalesce(parent, '') AS parent_span_id, us AS start_us, ms AS duration_ms, status FROM sp")
def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as they come in, validated, in their storage form."""
    raw = views.order_spans(spark, sf_dir).withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows = validate.span_rows(validate.validate_spans(raw)[0])
    return rows.select("trace_id", "span_id", "parent_span_id", F.unix_micros("start_time").alias("start_us"), "duration_ms", "status")


@query(f"WITH {SP} SELECT trace_id, span_id, CASE WHEN span_id LIKE 'l-%-3' THEN 'duration_ms: not within 0 and 600000' ELSE 'start_time: no time with a zone' END AS violations FROM sp WHERE span_id LIKE 'l-%-3' OR span_id LIKE 'l-%-4'")
def validate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third line's span has a negative duration, each fourth's no zone."""
    s = views.order_spans(spark, sf_dir)
    zone = F.when(F.col("span_id").endswith("-4") & ~F.col("span_id").startswith("o-"), "").otherwise("Z")
    third = F.col("span_id").endswith("-3") & ~F.col("span_id").startswith("o-")
    raw = s.withColumns({"start_time": F.concat(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone), "duration_ms": F.when(third, -1.0).otherwise(F.col("duration_ms"))})
    return validate.validate_spans(raw)[1].select("trace_id", "span_id", F.array_join("violations", "; ").alias("violations"))


@query(f"WITH {AN} SELECT service, metric, strftime(make_timestamp(ws * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(make_timestamp(we * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, '2024-01-20 00:00:00.000' AS detected_at FROM an")
def anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate_anomalies(anomalies(spark, sf_dir))[0].withColumn("detected_at", F.lit(AS_OF))
    return validate.anomaly_rows(found).select("service", "metric", "window_start", "window_end", "detected_at")


@query(f"WITH {AN} SELECT service, metric, ws AS window_start, CASE (ws // 21600) % 3 WHEN 0 THEN 'service: missing' WHEN 1 THEN 'sample_count: missing or negative; severity: unknown' ELSE '' END AS violations FROM (SELECT CASE WHEN (ws // 21600) % 3 = 0 THEN '' ELSE service END AS service, metric, ws FROM an)")
def validate_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anomalies(spark, sf_dir).withColumn("k", F.floor(F.unix_seconds("window_start") / SIX_HOURS) % 3)
    a = a.withColumns({"service": F.when(F.col("k") == 0, "").otherwise(F.col("service")), "sample_count": F.when(F.col("k") != 1, F.col("sample_count")), "severity": F.when(F.col("k") == 1, "odd").otherwise(F.col("severity"))})
    good, bad = validate.validate_anomalies(a)
    return good.select("service", "metric", sec("window_start"), F.lit("").alias("violations")).unionByName(bad.select("service", "metric", sec("window_start"), F.array_join("violations", "; ").alias("violations")))


@query(f"WITH {RU} SELECT ws AS window_start, service, query_count, round(latency_p95, 9) AS latency_p95 FROM ru WHERE ws + 21600 > (SELECT epoch(max(timestamp)) - 5 FROM ev)")
def flush_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.flush_open(views.search_events(spark, sf_dir), SIX_HOURS).select(sec("window_start"), "service", "query_count", *r9("latency_p95"))


@query(f"WITH {EV} SELECT event_id, service, status FROM ev")
def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events delivered twice, the second time with another latency."""
    e = views.search_events(spark, sf_dir)
    return rollup.dedupe_events(e.unionByName(e.withColumn("latency_ms", F.col("latency_ms") + 1))).select("event_id", "service", "status")


@query(f"WITH {EV} SELECT query_id, latency_ms, status, result_count FROM (SELECT ev.*, CAST(json_extract_string(props, '$.k') AS INT) AS result_count FROM ev JOIN events ON 'e-' || events.event_id = ev.event_id)")
def original_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.original_runs(views.search_events(spark, sf_dir), views.query_results(spark, sf_dir)).select("query_id", "latency_ms", "status", "result_count")


@query(f"WITH {SP}, q AS (SELECT 'q-' || min(o_orderkey) AS id FROM orders WHERE o_orderkey % 10 <> 0) SELECT trace_id, span_id, us AS start_us FROM sp WHERE 'q-' || substr(trace_id, 3) = (SELECT id FROM q)")
def spans_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the first query that has a root, looked up among all."""
    first = views.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").agg(F.min("o_orderkey")).first()[0]
    return traces.spans_for_query(views.order_spans(spark, sf_dir), f"q-{first}").select("trace_id", "span_id", F.unix_micros("start_time").alias("start_us"))


@query(f"WITH {SP} SELECT trace_id, span_id, state AS parent_state, CASE WHEN state = 'child' THEN 1 ELSE 0 END AS depth, round(self_ms, 6) AS self_time_ms, n_children FROM tr")
def assemble_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.assemble_traces(views.order_spans(spark, sf_dir)).select("trace_id", "span_id", "parent_state", "depth", F.round("self_time_ms", 6).alias("self_time_ms"), "n_children")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth, turn AS root FROM conversations c WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, t.root FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id::VARCHAR AS trace_id, turn::VARCHAR AS span_id, depth, root::VARCHAR AS root FROM t""")
def deep_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.assemble_traces(views.conversation_spans(spark, sf_dir)).select("trace_id", "span_id", "depth", "root")


@query(f"WITH {SP} SELECT * FROM sm")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = traces.trace_summary(traces.assemble_traces(views.order_spans(spark, sf_dir)))
    return s.select("trace_id", "span_count", "orphan_count", F.array_join("services", ",").alias("services"), "total_ms")


@query(f"""WITH {SP}, tops AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ms DESC, us, span_id) AS r FROM tr WHERE up IS NULL), heavy AS (SELECT *, row_number() OVER (PARTITION BY trace_id, up ORDER BY ms DESC, us, span_id) AS r FROM tr WHERE up IS NOT NULL)
  SELECT trace_id, 0 AS depth, span_id FROM tops WHERE r = 1 UNION ALL SELECT h.trace_id, 1, h.span_id FROM heavy h JOIN tops t ON t.trace_id = h.trace_id AND t.span_id = h.up WHERE h.r = 1 AND t.r = 1""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.critical_path(traces.assemble_traces(views.order_spans(spark, sf_dir))).select("trace_id", "depth", "span_id")


@query(f"WITH {SP}, s AS (SELECT trace_id, service, sum(self_ms::DECIMAL(28, 6)) AS v FROM tr GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY v DESC, service) AS r FROM s) SELECT trace_id, service, round(v, 3)::DOUBLE AS self_time_ms FROM o WHERE r = 1")
def slowest_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.slowest_service(traces.assemble_traces(views.order_spans(spark, sf_dir)))


@query(f"WITH {SP} SELECT trace_id, sm.span_count AS spans, sm.orphan_count, string_agg(span_id, ',' ORDER BY CASE WHEN up IS NULL THEN us ELSE root_us END, CASE WHEN up IS NULL THEN span_id ELSE up END, up IS NOT NULL, us, span_id) AS preorder FROM (SELECT tr.*, r.us AS root_us FROM tr LEFT JOIN sp r ON r.trace_id = tr.trace_id AND r.span_id = tr.up) JOIN sm USING (trace_id) GROUP BY ALL")
def trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested traces as JSON; compared by their numbers and the order of their spans."""
    t = traces.trace_json(traces.assemble_traces(views.order_spans(spark, sf_dir)))
    kids = F.from_json("trace", "span_count bigint, orphan_count bigint, roots array<struct<span_id: string, children: array<struct<span_id: string>>>>")
    ids = F.flatten(F.transform(F.col("k.roots"), lambda r: F.concat(F.array(r["span_id"]), F.transform(r["children"], lambda c: c["span_id"]))))
    return t.select("trace_id", kids.alias("k")).select("trace_id", F.col("k.span_count").alias("spans"), F.col("k.orphan_count").alias("orphan_count"), F.array_join(ids, ",").alias("preorder"))


@query(f"WITH {SP}, b AS (SELECT trace_id, min(us / 1000.0) AS lo, greatest(1, max(us / 1000.0 + ms) - min(us / 1000.0)) AS total FROM tr GROUP BY ALL) SELECT trace_id, span_id, round((us / 1000.0 - lo) / total * 100, 2) AS offset_pct, round(greatest(0.5, ms / total * 100), 2) AS width_pct FROM tr JOIN b USING (trace_id)")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = traces.waterfall(traces.assemble_traces(views.order_spans(spark, sf_dir)))
    return w.select("trace_id", "span_id", F.round("offset_pct", 2).alias("offset_pct"), F.round("width_pct", 2).alias("width_pct"))


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Traces and the baselines of their services (mean 95th percentile of 30 days each, of all time)."""
    spans = traces.checkpointed(views.order_spans(spark, sf_dir))
    tree = traces.assemble_traces(spans)
    events = spans.select("service", F.col("start_time").alias("timestamp"), F.col("duration_ms").alias("latency_ms"), "status", F.lit(None).cast("double").alias("relevance_score"), F.lit(False).alias("cache_hit"))
    baselines = dashboards.service_baselines(rollup.metric_rollup(events, 2_592_000), datetime(2100, 1, 1, tzinfo=timezone.utc), minutes=100_000_000)
    return tree, baselines


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces, baselines and ranked findings; a breach is 1.3 times the baseline here, as 2 is never reached."""
    tree, baselines = _traces(spark, sf_dir)
    return tree, baselines, findings.rank_findings(findings.findings(tree, baselines, breach_ratio=1.3))


FOUND = f"""{SP}, base AS (SELECT service, avg(p) AS b FROM (SELECT service, quantile_disc(ms, 0.95) AS p FROM sp GROUP BY service, floor(us / 1000000.0 / 2592000)) GROUP BY service), up AS (SELECT trace_id, span_id, operation AS up_operation FROM tr), f AS (
  SELECT trace_id, 'error_span' AS kind, span_id, 0.95 AS confidence, service, operation, service || ' ' || operation || ' failed with status ' || status AS summary, round(ms, 3)::VARCHAR AS shown FROM tr WHERE status = 'error'
  UNION ALL SELECT trace_id, 'baseline_breach', span_id, least(0.95, 0.55 + ms / b / 20), service, operation, service || ' ' || operation || ' took # times its baseline', round(ms, 3)::VARCHAR FROM tr JOIN base USING (service) WHERE ms / b >= 1.3
  UNION ALL SELECT trace_id, 'slow_span', span_id, least(0.9, 0.5 + self_ms / total_ms), service, operation, service || ' ' || operation || ' spent # ms itself', round(self_ms / total_ms, 4)::VARCHAR FROM tr JOIN sm USING (trace_id) WHERE total_ms > 0 AND self_ms >= 100 AND self_ms / total_ms >= 0.35
  UNION ALL SELECT t.trace_id, 'retry_storm', t.up, least(0.85, 0.4 + 0.1 * count(*)), t.service, t.operation, t.service || ' ' || t.operation || ' ran ' || count(*) || ' times below one ' || max(up_operation), count(*)::VARCHAR FROM tr t JOIN up ON up.trace_id = t.trace_id AND up.span_id = t.up GROUP BY t.trace_id, t.up, t.service, t.operation HAVING count(*) >= 3
  UNION ALL SELECT trace_id, 'missing_spans', NULL, 0.6, string_split(min(s), ',')[1], NULL, max(orphan_count) || ' spans name a parent that is missing', max(orphan_count)::VARCHAR FROM (SELECT trace_id, orphan_count, (SELECT string_agg(DISTINCT service, ',' ORDER BY service) FROM tr t WHERE t.trace_id = sm.trace_id AND t.state = 'orphan') AS s FROM sm WHERE orphan_count > 0) GROUP BY trace_id
  UNION ALL SELECT trace_id, 'fan_out', span_id, 0.45, service, operation, service || ' ' || operation || ' has ' || n_children || ' children', n_children::VARCHAR FROM tr WHERE n_children >= 8
  UNION ALL SELECT trace_id, 'cache_miss', span_id, 0.5, service, operation, n || ' cache misses, the slowest in ' || service, n::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ms DESC, us, span_id) AS o, count(*) OVER (PARTITION BY trace_id) AS n FROM tr WHERE miss) WHERE o = 1)"""


@query(f"WITH {FOUND} SELECT trace_id, kind, span_id, round(confidence + 1e-9, 2) AS confidence, service, operation, summary, shown FROM f")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with what they say (numbers with digits behind the point as #) and their first piece of evidence."""
    found = _ranked(spark, sf_dir)[2]
    of = F.create_map(*(F.lit(x) for k, v in (("error_span", "duration_ms"), ("baseline_breach", "duration_ms"), ("slow_span", "share"), ("retry_storm", "call_count"), ("missing_spans", "orphans"), ("fan_out", "children"), ("cache_miss", "misses")) for x in (k, v)))
    return found.select("trace_id", "kind", "span_id", F.round(F.col("confidence") + 1e-9, 2).alias("confidence"), "service", "operation", F.regexp_replace("summary", r"\d+\.\d", "#").alias("summary"), F.element_at("evidence", of[F.col("kind")]).alias("shown"))


@query(f"WITH {SP} SELECT trace_id, up AS span_id, service, operation, count(*) AS calls FROM tr WHERE up IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def retry_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.retry_storms(traces.assemble_traces(views.order_spans(spark, sf_dir)))
    return rows.select("trace_id", "span_id", "service", "operation", F.col("evidence")["call_count"].cast("long").alias("calls"))


@query(f"WITH {FOUND} SELECT kind, count(*) AS findings, count(DISTINCT trace_id) AS traces, count(*) FILTER (confidence > 0.7) AS sure FROM f GROUP BY kind")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ranked(spark, sf_dir)[2]
    return found.groupBy("kind").agg(F.count("*").alias("findings"), F.countDistinct("trace_id").alias("traces"), F.count_if(F.col("confidence") > 0.7).alias("sure"))


@query(f"WITH {FOUND}, k AS (SELECT trace_id, list_position(['error_span', 'baseline_breach', 'slow_span', 'retry_storm', 'missing_spans', 'fan_out', 'cache_miss'], kind) AS p, kind, round(confidence, 2) AS c FROM f) SELECT trace_id, arg_min(kind, p * 10 - c) AS kind, count(*) AS findings FROM k GROUP BY trace_id")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ranked(spark, sf_dir)[2]
    return found.groupBy("trace_id").agg(F.min_by("kind", "rank").alias("kind"), F.count("*").alias("findings"))


@query(f"WITH {FOUND} SELECT CASE WHEN trace_id IN (SELECT trace_id FROM f) THEN 1 ELSE 0 END AS remarkable, count(*) AS traces FROM sm GROUP BY 1")
def trace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, found = _ranked(spark, sf_dir)
    return findings.summarise(tree, found).groupBy((F.col("summary") != findings.UNREMARKABLE).cast("int").alias("remarkable")).agg(F.count("*").alias("traces"))


@query(f"WITH {FOUND} SELECT CASE WHEN round(confidence, 2) >= 0.8 THEN 'high' WHEN round(confidence, 2) >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS findings FROM f GROUP BY 1")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[2].groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("findings"))


@query(f"WITH {FOUND}, hv AS (SELECT trace_id, service, sum(self_ms::DECIMAL(28, 6)) AS v FROM tr GROUP BY ALL), hot AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY v DESC, service) AS r FROM hv), ks AS (SELECT trace_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM f GROUP BY 1) SELECT CASE WHEN s.trace_id IS NULL THEN 0 ELSE s.span_count END AS spans_in_trace, coalesce(s.orphan_count, 0) AS orphans_in_trace, 'q-' || o_orderkey AS query_id, coalesce(s.span_count, 0) AS spans, o_totalprice / 1000 AS latency_ms, coalesce(kinds, '') AS kinds, hot.service AS hotspot, round(hot.v, 3)::DOUBLE AS hotspot_ms FROM orders LEFT JOIN sm s ON s.trace_id = 't-' || o_orderkey LEFT JOIN ks ON ks.trace_id = s.trace_id LEFT JOIN hot ON hot.trace_id = s.trace_id AND hot.r = 1")
def debug_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, baselines = _traces(spark, sf_dir)
    o = views.table(spark, sf_dir, "orders")
    events = o.select(F.concat(F.lit("q-"), F.col("o_orderkey").cast("string")).alias("query_id"), F.lit("gateway").alias("service"), F.lit("ok").alias("status"), (F.col("o_totalprice") / 1000).alias("latency_ms"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    b = findings.debug_bundle(events, tree, baselines, breach_ratio=1.3)
    # the text up to both numbers, read once; a quote within a trace's id is escaped
    head = F.concat(F.substring_index("trace", ',"total_duration_ms":', 1), F.lit("}"))
    b = b.select("*", F.json_tuple(head, "span_count", "orphan_count").alias("span_count", "orphan_count"))
    shown = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return b.select(shown("span_count").alias("spans_in_trace"), shown("orphan_count").alias("orphans_in_trace"), "query_id", F.coalesce("spans", F.lit(0)).alias("spans"), "latency_ms", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "hotspot", "hotspot_ms")


RUNS = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem), d AS (SELECT l_orderkey AS o, list(DISTINCT l_partkey::VARCHAR) AS ids, count(*) AS n FROM ln GROUP BY 1),
  pick AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1),
  df AS (SELECT 'c-' || p.o_custkey AS query_id, oa.o_totalprice / 1000 AS la, ob.o_totalprice / 1000 AS lb, oa.o_orderstatus = 'F' AS fa, ob.o_orderstatus = 'F' AS fb, coalesce(da.ids, []) AS ia, coalesce(db.ids, []) AS ib, coalesce(da.n, 0) AS na, coalesce(db.n, 0) AS nb
    FROM pick p JOIN orders oa ON oa.o_orderkey = p.a JOIN orders ob ON ob.o_orderkey = p.b LEFT JOIN d da ON da.o = p.a LEFT JOIN d db ON db.o = p.b),
  dd AS (SELECT *, CASE WHEN la <= 0 THEN 1 ELSE lb / la END AS ratio, len(list_intersect(ia, ib)) AS n_common, len(list_filter(ib, lambda x: NOT list_contains(ia, x))) AS n_added, len(list_filter(ia, lambda x: NOT list_contains(ib, x))) AS n_removed FROM df)"""


@query(f"WITH {RUNS} SELECT query_id, round(lb - la, 6) AS latency_delta_ms, round(ratio + 1e-12, 4) AS latency_ratio, nb - na AS count_delta, n_common, n_added, n_removed, array_to_string(list_sort(list_intersect(ia, ib)), ',') AS common, array_to_string(list_sort(list_filter(ib, lambda x: NOT list_contains(ia, x))), ',') AS added, array_to_string(list_sort(list_filter(ia, lambda x: NOT list_contains(ib, x))), ',') AS removed, fa <> fb AS status_changed, CASE WHEN fa AND fb THEN 'still failing' WHEN fa THEN 'no longer reproducible' WHEN ratio >= 1.5 THEN 'slower' WHEN n_added > 0 OR n_removed > 0 THEN 'different results' ELSE 'matches' END AS verdict FROM dd")
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = replay.diff_runs(*views.order_runs(spark, sf_dir))
    return d.select("query_id", "latency_delta_ms", "latency_ratio", F.col("count_delta").cast("long").alias("count_delta"), *(F.size(c).cast("long").alias(f"n_{c}") for c in ("common", "added", "removed")), *(F.array_join(c, ",").alias(c) for c in ("common", "added", "removed")), "status_changed", "verdict")


@query("SELECT 'j-c-' || c AS id, 'c-' || c AS query_id, CASE WHEN c % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN c % 5 = 0 THEN 'no replay result' END AS error FROM (SELECT DISTINCT o_custkey AS c FROM orders)")
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = views.order_runs(spark, sf_dir)
    jobs = a.select(F.concat(F.lit("j-"), "query_id").alias("id"), "query_id")
    there = b.where(F.substring("query_id", 3, 20).cast("long") % 5 != 0)
    return replay.replay_outcomes(jobs, a, there).select("id", "query_id", "state", "error")


CT = f"{EV}, h AS (SELECT service, status, epoch(date_trunc('hour', timestamp))::BIGINT AS ts, count(*) AS n FROM ev GROUP BY ALL), inc AS (SELECT service, status, ts, sum(CASE WHEN first THEN 0 ELSE n END) OVER (PARTITION BY service, status ORDER BY ts RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS v FROM (SELECT *, row_number() OVER (PARTITION BY service, status ORDER BY ts) = 1 AS first FROM h))"


@query(f"WITH {CT} SELECT service, status, ts, round(v / 21600.0, 8) AS rate FROM inc")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = monitoring.counter_rate(views.counter_samples(spark, sf_dir), SIX_HOURS)
    return r.select(F.col("labels")["service"].alias("service"), F.col("labels")["status"].alias("status"), sec("ts"), F.round("rate", 8).alias("rate"))


@query(f"WITH {CT}, g AS (SELECT ts, sum(v) FILTER (status = 'error') AS e, sum(v) AS a FROM inc GROUP BY ts) SELECT ts, round(coalesce(e, 0) / greatest(a, 0.001), 6) AS value FROM g")
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = monitoring.counter_increase(views.counter_samples(spark, sf_dir), SIX_HOURS)
    bad = monitoring.sum_by(inc.where(label_matches(F.col("labels")["status"], "err.*")), (), "increase")
    return monitoring.safe_ratio(bad, monitoring.sum_by(inc, (), "increase"), inc).select(sec("ts"), F.round("value", 6).alias("value"))


BK = f"{EV}, le(le, lo) AS (VALUES (50, 0), (100, 50), (200, 100), (300, 200), (400, 300), (1e308, 400)), c AS (SELECT epoch(date_trunc('day', timestamp))::BIGINT AS ts, service, le, lo, count(*) FILTER (latency_ms <= le) AS hi, count(*) FILTER (latency_ms <= lo) AS below, count(*) AS n FROM ev, le GROUP BY ALL)"


@query(f"WITH {BK}, p AS (SELECT *, row_number() OVER (PARTITION BY ts, service ORDER BY le) AS r FROM c WHERE hi >= 0.95 * n) SELECT ts, service, round(CASE WHEN le > 1e300 THEN lo ELSE lo + (le - lo) * (0.95 * n - below) / greatest(hi - below, 1e-12) END, 4) AS value FROM p WHERE r = 1")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.histogram_quantile(views.latency_buckets(spark, sf_dir), 0.95, ("service",)).select(sec("ts"), "service", F.round("value", 4).alias("value"))


AL = f"{RU}, a AS (SELECT *, latency_p95 > 180 AS bad, sum(CASE WHEN latency_p95 > 180 THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY ws) AS run FROM ru), st AS (SELECT service, ws AS ts, CASE WHEN NOT bad THEN 'inactive' WHEN ws - min(ws) OVER (PARTITION BY service, run, bad) >= 43200 THEN 'firing' ELSE 'pending' END AS state FROM a)"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollups(spark, sf_dir).select(F.col("window_start").alias("ts"), "service", "latency_p95")
    return monitoring.evaluate_alert(r, F.col("latency_p95") > 180, 43_200, ("service",))


@query(f"WITH {AL} SELECT * FROM st")
def evaluate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select("service", sec("ts"), "state")


@query(f"WITH {AL}, f AS (SELECT service, ts, CASE WHEN service = 'svc-0' THEN 'critical' ELSE 'warning' END AS severity FROM st WHERE state = 'firing') SELECT service, ts, severity, unnest(CASE WHEN severity = 'critical' THEN ['pager', 'chat'] ELSE ['chat'] END) AS receiver FROM f")
def route_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = _alerts(spark, sf_dir).where("state = 'firing'").withColumn("severity", F.when(F.col("service") == "svc-0", "critical").otherwise("warning"))
    return monitoring.route_alerts(fired).select("service", sec("ts"), "severity", "receiver")


@query(f"WITH {AL}, p AS (SELECT *, lead(ts) OVER (PARTITION BY service ORDER BY ts) AS nxt FROM st WHERE state <> 'inactive') SELECT service, ts + 21600 AS resolved_at FROM p WHERE nxt - ts > 21600")
def resolve_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _alerts(spark, sf_dir).where("state <> 'inactive'")
    return monitoring.resolve(active, SIX_HOURS, by=("service",)).select("service", sec("resolved_at"))


@query(f"WITH {AL}, x AS (SELECT 'HighLatency' AS alertname, 'warning' AS severity, service AS job, ts FROM st WHERE state <> 'inactive'), d AS (SELECT DISTINCT service AS job, ws AS ts FROM ru WHERE query_count < 15) SELECT alertname, job, ts FROM x ANTI JOIN d USING (job, ts) UNION ALL SELECT 'ServiceDown', job, ts FROM d")
def inhibit_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = _alerts(spark, sf_dir).where("state <> 'inactive'").select(F.lit("HighLatency").alias("alertname"), F.lit("warning").alias("severity"), F.col("service").alias("job"), "ts")
    down = rollups(spark, sf_dir).where("query_count < 15").select(F.lit("ServiceDown").alias("alertname"), F.lit("critical").alias("severity"), F.col("service").alias("job"), F.col("window_start").alias("ts"))
    return monitoring.inhibit(high.unionByName(down)).select("alertname", "job", sec("ts"))


@query(f"WITH {EV} SELECT DISTINCT service AS value FROM ev")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.label_values(views.counter_samples(spark, sf_dir), "service")
