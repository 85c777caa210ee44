"""Recording and alert rules as rows, all evaluated over one scan of samples (metric, labels map, ts, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querypulse.operators.monitoring import counter_deltas, evaluate_alert, histogram_quantile, series_key
from querypulse.operators.traces import checkpointed


@dataclass(frozen=True)
class Selector:
    """Samples of a metric, brought to a grid of times. kind: rate or increase of counters over the last seconds, last for gauges (no older than seconds).

    by: labels whose values are kept apart, None for whole series. Values that share them are summed.
    """

    name: str
    metric: str
    kind: str
    seconds: int = 300
    where: str = "true"
    by: tuple[str, ...] | None = ()


@dataclass(frozen=True)
class Alert:
    """on: a condition over recorded columns, or over value with a selector that is kept by series."""

    name: str
    on: str
    hold: int
    severity: str
    channel: str
    shows: str
    selector: str | None = None


# Metrics, label matches, ranges, thresholds and holds of the rules.
INGESTED, REQUESTS = "collector_events_ingested_total", "gateway_requests_total"
SELECTORS = (
    Selector("ingest_rate", INGESTED, "rate", where="labels['status'] = 'accepted'"),
    Selector("rejected_rate", INGESTED, "rate", where="labels['status'] = 'rejected'"),
    Selector("submitted_rate", INGESTED, "rate"),
    Selector("processing_rate", "engine_events_processed_total", "rate"),
    Selector("endpoint_rate", REQUESTS, "rate", by=("endpoint",)),
    Selector("failed_rate", REQUESTS, "rate", where="labels['status'] rlike '^(?:5..)$'"),
    Selector("request_rate", REQUESTS, "rate"),
    Selector("duration_rate", "gateway_query_duration_seconds_bucket", "rate", by=("le",)),
    Selector("lag", "kafka_consumergroup_lag", "last", where="labels['consumergroup'] = 'metrics-engine'"),
    Selector("invalid_growth", "engine_events_invalid_total", "increase", 900, by=None),
    Selector("anomaly_growth", "engine_anomalies_detected_total", "increase", 600),
    Selector("up", "up", "last", where="labels['job'] rlike '^(?:telemetry-collector|metrics-engine|debug-service|api-gateway)$'", by=None),
    Selector("limited_rate", "collector_rate_limited_total", "rate", by=None),
)
RECORDED = {
    "collector_ingest_rate5m": "ingest_rate",
    "collector_rejection_ratio5m": "rejected_rate / greatest(submitted_rate, 0.001)",
    "engine_processing_rate5m": "processing_rate",
    "gateway_error_ratio5m": "failed_rate / greatest(request_rate, 0.001)",
}
ALERTS = (
    Alert("SearchLatencyP99High", "latency_p99 > 2", 300, "critical", "pagerduty", "latency_p99"),
    Alert("SearchErrorRateHigh", "gateway_error_ratio5m > 0.01", 300, "warning", "slack", "gateway_error_ratio5m"),
    Alert("IngestRejectionRateHigh", "collector_rejection_ratio5m > 0.05", 600, "warning", "slack", "collector_rejection_ratio5m"),
    Alert("KafkaConsumerLagGrowing", "lag > 10000", 600, "warning", "slack", "lag"),
    Alert("MetricsEngineStalled", "collector_ingest_rate5m > 1 and engine_processing_rate5m = 0", 300, "critical", "pagerduty", "collector_ingest_rate5m"),
    Alert("ClickHouseWriteFailures", "value > 100", 300, "warning", "slack", "value", "invalid_growth"),
    Alert("AnomalyStorm", "anomaly_growth > 50", 300, "warning", "slack", "anomaly_growth"),
    Alert("ServiceDown", "value = 0", 120, "critical", "pagerduty", "value", "up"),
    Alert("CollectorRateLimitingHeavily", "value > 10", 600, "warning", "slack", "value", "limited_rate"),
)


def on_grid(samples: DataFrame, selectors: tuple[Selector, ...] = SELECTORS, step: int = 30) -> DataFrame:
    """(selector, key, slot, value): every selector at each slot (a multiple of step seconds) for which it has samples. key: the labels kept apart, as JSON.

    Growths are summed by slot first; a slot's sum then goes to all slots whose range covers it. So no task holds a series, and what is replicated is the sums.
    """
    wanted = samples.where(F.col("metric").isin(*sorted({s.metric for s in selectors})))
    rows = counter_deltas(wanted).withColumn("_slot", F.ceil(F.col("_t") / step))

    def chosen(kinds: tuple[str, ...]) -> list:
        """For each selector of these kinds that takes a sample: its name, key and range."""
        out = []
        for s in selectors:
            if s.kind in kinds:
                key = F.col("_s") if s.by is None else F.to_json(F.create_map(*(x for b in s.by for x in (F.lit(b), F.col("labels")[b])))) if s.by else F.lit("{}")
                out.append(F.when((F.col("metric") == s.metric) & F.expr(s.where), F.struct(F.lit(s.name).alias("selector"), key.alias("key"), F.lit(s.seconds // step).alias("slots"), F.lit(float(s.seconds) if s.kind == "rate" else 1.0).alias("per"))))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    growth = rows.select(F.explode(chosen(("rate", "increase"))).alias("c"), "_slot", "_d").groupBy("c.selector", "c.key", "c.slots", "c.per", "_slot").agg(F.sum("_d").alias("_d"))
    growth = growth.select("selector", "key", "per", F.explode(F.sequence(F.col("_slot"), F.col("_slot") + F.col("slots") - 1)).alias("slot"), "_d").groupBy("selector", "key", "slot").agg((F.sum("_d") / F.first("per")).alias("value"))

    # A gauge keeps its value until its next sample, or as long as its selector looks back.
    held = rows.where(F.col("metric").isin(*sorted({s.metric for s in selectors if s.kind == "last"})))
    held = held.groupBy("metric", "_s", "_slot").agg(F.max_by(F.struct("value", F.map_entries("labels").alias("labels")), F.struct("_t", "value")).alias("x"))
    held = held.withColumn("_next", F.lead("_slot").over(Window.partitionBy("metric", "_s").orderBy("_slot"))).select("metric", "_s", "_slot", "_next", F.col("x.value").alias("value"), F.map_from_entries("x.labels").alias("labels"))
    held = held.select(F.explode(chosen(("last",))).alias("c"), "_slot", "_next", "value")
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("_slot") + F.col("c.slots") - 1), F.col("_slot") + F.col("c.slots") - 1)
    held = held.select("c.selector", "c.key", F.explode(F.sequence(F.col("_slot"), until)).alias("slot"), "value").groupBy("selector", "key", "slot").agg(F.sum("value").alias("value"))
    return growth.unionByName(held).withColumn("slot", F.col("slot").cast("long"))


def recorded(grid: DataFrame, selectors: tuple[Selector, ...] = SELECTORS) -> DataFrame:
    """A row for each slot from the first to the last: the sums of all selectors that keep no labels apart, the RECORDED columns and latency_p99. Rates and growths are 0 where nothing grew; gauges and latency_p99 null without samples."""
    plain = [s for s in selectors if s.by == ()]
    ends = grid.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a is not null")
    slots = ends.select(F.explode(F.sequence("a", "b")).alias("slot"))
    wide = grid.where(F.col("key") == "{}").groupBy("slot").agg(*(F.max(F.when(F.col("selector") == s.name, F.col("value"))).alias(s.name) for s in plain))
    buckets = grid.where("selector = 'duration_rate'").select(F.col("slot").alias("ts"), F.regexp_replace(F.get_json_object("key", "$.le"), r"^\+Inf$", "Infinity").cast("double").alias("le"), F.col("value").alias("cumulative"))
    p99 = histogram_quantile(buckets, 0.99).select(F.col("ts").alias("slot"), F.col("value").alias("latency_p99"))
    rows = slots.join(wide, "slot", "left").join(p99, "slot", "left").withColumns({s.name: F.coalesce(s.name, F.lit(0.0)) for s in plain if s.kind != "last"})
    return rows.withColumns({n: F.expr(e) for n, e in RECORDED.items()})


def recording_rows(samples: DataFrame, step: int = 30) -> DataFrame:
    """(record, endpoint, ts, value) of the five recording rules."""
    grid = checkpointed(on_grid(samples, step=step))
    rows = recorded(grid).unpivot(["slot"], list(RECORDED), "record", "value").withColumn("endpoint", F.lit(None).cast("string"))
    by = grid.where("selector = 'endpoint_rate'").select("slot", F.lit("gateway_request_rate5m").alias("record"), "value", F.get_json_object("key", "$.endpoint").alias("endpoint"))
    return rows.unionByName(by).select("record", "endpoint", F.timestamp_seconds(F.col("slot") * step).alias("ts"), "value")


def alert_rows(samples: DataFrame, alerts: tuple[Alert, ...] = ALERTS, step: int = 30) -> DataFrame:
    """(alertname, labels: JSON, severity, channel, ts, value, state): every alert at every slot at which its condition is known or has just gone, as evaluate_alert judges it with the alert's own hold.

    Samples are read once, for all rules. A condition whose series is gone does not hold.
    """
    grid = checkpointed(on_grid(samples, step=step))
    wide = [a for a in alerts if a.selector is None]
    told = lambda a, value, on: F.struct(F.lit(a.name).alias("alertname"), F.lit(a.severity).alias("severity"), F.lit(a.channel).alias("channel"), F.lit(a.hold).alias("hold"), value.cast("double").alias("value"), F.coalesce(on, F.lit(False)).alias("on"))
    rows = recorded(grid).select("slot", F.lit("{}").alias("labels"), F.explode(F.array(*(told(a, F.expr(a.shows), F.expr(a.on)) for a in wide))).alias("a")).select("slot", "labels", "a.*")
    for a in alerts:
        if a.selector:
            # the slot behind each one counts as false, if no sample of the series covers it
            own = grid.where(F.col("selector") == a.selector).select("key", F.explode(F.array(F.struct("slot", "value"), F.struct((F.col("slot") + 1).alias("slot"), F.lit(None).cast("double").alias("value")))).alias("x"))
            own = own.groupBy("key", F.col("x.slot").alias("slot")).agg(F.max("x.value").alias("value"))
            rows = rows.unionByName(own.select("slot", F.col("key").alias("labels"), told(a, F.expr(a.shows), F.expr(a.on)).alias("a")).select("slot", "labels", "a.*"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("slot") * step))
    return evaluate_alert(rows, F.col("on"), F.col("hold"), ("alertname", "labels")).select("alertname", "labels", "severity", "channel", "ts", "value", "state")
