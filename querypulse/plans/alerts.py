"""Registered queries of rules, notifications and lifecycles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querypulse.operators import lifecycles, monitoring, rules
from querypulse.plans import views
from querypulse.plans.queries import AL, AN, _alerts, anomalies, query, sec

STEP = 300

# The samples of views.platform_samples as growths, and what the selectors make of them.
GRID = """e AS (SELECT (floor(epoch(ts) / 300)::BIGINT + 1) AS slot, event_type, event_type = 'error' AS bad, 'svc-' || (user_id % 4) AS svc, user_id % 4 AS u, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
  c AS (SELECT 'in' AS m, CASE WHEN event_type = 'signup' THEN 'rejected' ELSE 'accepted' END AS s, slot, 1000 * count(*) AS d FROM e GROUP BY ALL
    UNION ALL SELECT 'done', '', slot, 1000 * count(*) FROM e WHERE event_type = 'click' GROUP BY ALL
    UNION ALL SELECT 'req', svc || CASE WHEN bad THEN '500' ELSE '200' END, slot, count(*) FROM e GROUP BY ALL
    UNION ALL SELECT 'le', le, slot, count(*) FILTER (value <= 100 * b) FROM e, (VALUES ('1', 1), ('2.5', 2.5), ('4', 4), ('+Inf', 1000000000)) l(le, b) GROUP BY ALL
    UNION ALL SELECT 'invalid', '{"kind":"' || event_type || '"}', slot, sum(k) FROM e GROUP BY ALL
    UNION ALL SELECT 'anomalies', '', slot, 20 * count(*) FROM e WHERE bad GROUP BY ALL
    UNION ALL SELECT 'limited', '{"client":"' || svc || '"}', slot, sum(floor(value)::BIGINT * 10) FROM e GROUP BY ALL),
  f AS (SELECT m, s, slot, CASE WHEN row_number() OVER (PARTITION BY m, s ORDER BY slot) = 1 THEN 0 ELSE d END AS d FROM c),
  sel(name, m, pat, keyed, n, per) AS (VALUES ('ingest_rate', 'in', 'accepted', '', 1, 300), ('rejected_rate', 'in', 'rejected', '', 1, 300), ('submitted_rate', 'in', '%', '', 1, 300), ('processing_rate', 'done', '%', '', 1, 300), ('failed_rate', 'req', '%500', '', 1, 300), ('request_rate', 'req', '%', '', 1, 300), ('endpoint_rate', 'req', '%', 'endpoint', 1, 300),
    ('duration_rate', 'le', '%', 'series', 1, 300), ('invalid_growth', 'invalid', '%', 'series', 3, 1), ('anomaly_growth', 'anomalies', '%', '', 2, 1), ('limited_rate', 'limited', '%', 'series', 1, 300)),
  gr AS (SELECT name, key, slot, sum(d) / max(per)::DOUBLE AS value FROM (SELECT name, CASE keyed WHEN 'series' THEN s WHEN 'endpoint' THEN substr(s, 1, 5) ELSE '{}' END AS key, d, per, slot + unnest(range(0, n)) AS slot FROM f JOIN sel ON sel.m = f.m AND f.s LIKE sel.pat) GROUP BY name, key, slot),
  ga AS (SELECT 'lag' AS name, '{}' AS key, (u % 2)::VARCHAR AS s, slot, 200.0 * sum(k) AS value FROM e GROUP BY u % 2, slot UNION ALL SELECT 'up', '{"job":"' || j || '"}', j, slot, CASE WHEN bool_or(bad) THEN 0 ELSE 1 END FROM (SELECT *, CASE u WHEN 0 THEN 'telemetry-collector' WHEN 1 THEN 'metrics-engine' WHEN 2 THEN 'debug-service' ELSE 'api-gateway' END AS j FROM e) GROUP BY j, slot),
  g AS (SELECT * FROM gr UNION ALL SELECT name, key, slot, sum(value)::DOUBLE FROM ga GROUP BY name, key, slot),
  sl AS (SELECT unnest(range(min(slot), max(slot) + 1)) AS slot FROM g),
  w AS (SELECT sl.slot, coalesce(max(value) FILTER (name = 'ingest_rate'), 0) AS ingest, coalesce(max(value) FILTER (name = 'rejected_rate'), 0) AS rejected, coalesce(max(value) FILTER (name = 'submitted_rate'), 0) AS submitted, coalesce(max(value) FILTER (name = 'processing_rate'), 0) AS processing,
    coalesce(max(value) FILTER (name = 'failed_rate'), 0) AS failed, coalesce(max(value) FILTER (name = 'request_rate'), 0) AS requests, coalesce(max(value) FILTER (name = 'anomaly_growth'), 0) AS anomalies, max(value) FILTER (name = 'lag') AS lag FROM sl LEFT JOIN g ON g.slot = sl.slot AND g.key = '{}' GROUP BY sl.slot),
  r AS (SELECT *, rejected / greatest(submitted, 0.001) AS rejection, failed / greatest(requests, 0.001) AS errors FROM w)"""


@query(f"WITH {GRID} SELECT 'collector_ingest_rate5m' AS record, NULL::VARCHAR AS endpoint, slot * 300 AS ts, round(ingest, 6) AS value FROM r UNION ALL SELECT 'collector_rejection_ratio5m', NULL, slot * 300, round(rejection, 6) FROM r UNION ALL SELECT 'engine_processing_rate5m', NULL, slot * 300, round(processing, 6) FROM r UNION ALL SELECT 'gateway_error_ratio5m', NULL, slot * 300, round(errors, 6) FROM r UNION ALL SELECT 'gateway_request_rate5m', key, slot * 300, round(value, 6) FROM g WHERE name = 'endpoint_rate'")
def recording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recording_rows(views.platform_samples(spark, sf_dir), STEP).select("record", "endpoint", sec("ts"), F.round("value", 6).alias("value"))


ALERTED = f"""{GRID}, lo(le, b, low) AS (VALUES ('1', 1.0, 0.0), ('2.5', 2.5, 1.0), ('4', 4.0, 2.5), ('+Inf', 1e300, 4.0)), hq AS (SELECT slot, b, low, value AS cum, coalesce(lag(value) OVER (PARTITION BY slot ORDER BY b), 0) AS before, max(value) OVER (PARTITION BY slot) AS total FROM g JOIN lo ON lo.le = g.key WHERE name = 'duration_rate'),
  p AS (SELECT slot, CASE WHEN b > 1e200 THEN low ELSE low + (b - low) * (0.99 * total - before) / greatest(cum - before, 1e-12) END AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY b) AS o FROM hq WHERE total > 0 AND cum >= 0.99 * total) WHERE o = 1),
  own AS (SELECT a.name, key, slot, max(value) AS value FROM (SELECT name, key, slot, value FROM g WHERE key <> '{{}}' UNION ALL SELECT name, key, slot + 1, NULL FROM g WHERE key <> '{{}}') a GROUP BY a.name, key, slot),
  a AS (SELECT 'SearchLatencyP99High' AS alertname, '{{}}' AS labels, r.slot, p99 AS value, coalesce(p99 > 2, false) AS bad, 300 AS hold FROM r LEFT JOIN p ON p.slot = r.slot
    UNION ALL SELECT 'SearchErrorRateHigh', '{{}}', slot, errors, errors > 0.01, 300 FROM r UNION ALL SELECT 'IngestRejectionRateHigh', '{{}}', slot, rejection, rejection > 0.05, 600 FROM r UNION ALL SELECT 'KafkaConsumerLagGrowing', '{{}}', slot, lag, coalesce(lag > 10000, false), 600 FROM r
    UNION ALL SELECT 'MetricsEngineStalled', '{{}}', slot, ingest, ingest > 1 AND processing = 0, 300 FROM r UNION ALL SELECT 'AnomalyStorm', '{{}}', slot, anomalies, anomalies > 50, 300 FROM r
    UNION ALL SELECT 'ClickHouseWriteFailures', key, slot, value, coalesce(value > 100, false), 300 FROM own WHERE name = 'invalid_growth' UNION ALL SELECT 'ServiceDown', key, slot, value, coalesce(value = 0, false), 120 FROM own WHERE name = 'up' UNION ALL SELECT 'CollectorRateLimitingHeavily', key, slot, value, coalesce(value > 10, false), 600 FROM own WHERE name = 'limited_rate'),
  st AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY alertname, labels ORDER BY slot) AS run FROM a)"""


@query(f"WITH {ALERTED} SELECT alertname, labels, CASE WHEN alertname IN ('SearchLatencyP99High', 'MetricsEngineStalled', 'ServiceDown') THEN 'critical' ELSE 'warning' END AS severity, slot * 300 AS ts, round(value, 6) AS value, CASE WHEN NOT bad THEN 'inactive' WHEN 300 * (slot - min(slot) OVER (PARTITION BY alertname, labels, run, bad)) >= hold THEN 'firing' ELSE 'pending' END AS state FROM st")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine alert rules over the platform's samples."""
    return rules.alert_rows(views.platform_samples(spark, sf_dir), step=STEP).select("alertname", "labels", "severity", sec("ts"), F.round("value", 6).alias("value"), "state")


@query(f"""WITH {AN}, f AS (SELECT service || ':' || metric || ':' || severity AS signature, we AS t, we - lag(we) OVER (PARTITION BY service, metric, severity ORDER BY we) AS gap FROM an), r AS (SELECT signature, t, sum(CASE WHEN gap IS NULL OR gap > 172800 THEN 1 ELSE 0 END) OVER (PARTITION BY signature ORDER BY t) AS run FROM f),
  n AS (SELECT *, row_number() OVER (PARTITION BY signature, run ORDER BY t) AS i FROM r)
  SELECT signature, t AS changed_at, CASE i WHEN 1 THEN 'firing' ELSE 'active' END AS state, i::INT AS fire_count FROM n WHERE i <= 2 UNION ALL SELECT signature, max(t) + 172800, 'resolved', count(*)::INT FROM n GROUP BY signature, run HAVING max(t) + 172800 <= epoch(TIMESTAMP '2024-01-20')""")
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of state of the anomalies' alerts up to an instant, resolved after two quiet days."""
    rows = lifecycles.alert_lifecycle(anomalies(spark, sf_dir), ttl=172_800)
    return rows.where(~((F.col("state") == "resolved") & (F.unix_seconds("at") > 1_705_708_800))).select("signature", sec("at", "changed_at"), "state", "fire_count")


@query("""WITH j AS (SELECT 'j-' || o_orderkey AS id, epoch(o_orderdate)::BIGINT AS t, o_orderkey % 7 AS m FROM orders)
  SELECT id, t AS changed_at, 'pending' AS state, NULL::VARCHAR AS error FROM j UNION ALL SELECT id, t + 60, 'running', NULL FROM j WHERE m NOT IN (0, 1) UNION ALL SELECT id, t + 90, 'failed', 'no recorded run' FROM j WHERE m = 0 UNION ALL SELECT id, t + 3600, 'failed', 'timed out' FROM j WHERE m = 1
  UNION ALL SELECT id, t + 3660, 'failed', 'timed out' FROM j WHERE m = 2 UNION ALL SELECT id, t + 600, 'succeeded', NULL FROM j WHERE m > 2""")
def replay_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as replay jobs: every seventh fails before it runs, one in seven never starts, one in seven runs and is heard of again too late."""
    o = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("j-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderdate").cast("timestamp").alias("t"), (F.col("o_orderkey") % 7).alias("m"))
    step = lambda after, event, error=None: F.struct(F.lit(after).alias("after"), F.lit(event).alias("event"), F.lit(error).cast("string").alias("error"))
    steps = F.when(F.col("m") == 0, F.array(step(0, "requested"), step(90, "failed", "no recorded run"), step(100, "started"))).when(F.col("m") == 1, F.array(step(0, "requested"))).when(F.col("m") == 2, F.array(step(0, "requested"), step(60, "started"), step(9000, "succeeded")))
    events = o.select("id", "t", F.explode(steps.otherwise(F.array(step(0, "requested"), step(60, "started"), step(600, "succeeded"), step(700, "failed", "late")))).alias("e"))
    events = events.select("id", F.timestamp_seconds(F.unix_seconds("t") + F.col("e.after")).alias("at"), "e.event", "e.error")
    return lifecycles.job_lifecycle(events).select("id", sec("at", "changed_at"), "state", "error")


@query(f"""WITH {AL}, f AS (SELECT service, ts, CASE WHEN service = 'svc-0' THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN service = 'svc-1' THEN 'slack-search-quality' ELSE 'slack' END AS channel FROM st WHERE state <> 'inactive'),
  r AS (SELECT *, unnest(CASE WHEN severity = 'critical' THEN ['pager', 'chat'] WHEN channel = 'slack-search-quality' THEN ['quality'] ELSE ['chat'] END) AS receiver FROM f)
  SELECT receiver, service, ts + CASE receiver WHEN 'pager' THEN 10 ELSE 30 END AS notified_at, 1 AS firing, 0 AS resolved FROM r UNION ALL SELECT receiver, service, ts + 300 + CASE receiver WHEN 'pager' THEN 10 ELSE 30 END, 0, 1 FROM r""")
def group_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of the alerts by receiver and service. Their samples are six hours apart, so each is told by itself and resolved at the look that follows its end."""
    fired = _alerts(spark, sf_dir).where("state <> 'inactive'").select("ts", "service", F.lit("HighLatency").alias("alertname"), F.when(F.col("service") == "svc-0", "critical").otherwise("warning").alias("severity"), F.when(F.col("service") == "svc-1", "slack-search-quality").otherwise("slack").alias("channel"))
    told = lifecycles.group_alerts(monitoring.route_alerts(fired))
    return told.select("receiver", "service", sec("notified_at"), F.size("firing").alias("firing"), F.size("resolved").alias("resolved"))


