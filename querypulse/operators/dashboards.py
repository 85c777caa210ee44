"""Dashboard and operational queries over rollups, events and anomalies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querypulse.functions.columns import bucket, within
from querypulse.schemas import OBJECTIVES, SEVERITIES

Range = tuple[datetime, datetime]


def service_filter(df: DataFrame, service: str | None) -> DataFrame:
    return df if service is None else df.where(F.col("service") == F.lit(service))


def nearest(x, digits: int):
    """Rounded; the nudge makes means that lie on a half independent of the order of their sum."""
    return F.round(x + 1e-9, digits)


def _buckets(rollups: DataFrame, rng: Range, service: str | None, interval: str):
    rows = service_filter(rollups.where(within(F.col("window_start"), rng)), service)
    return rows.groupBy(bucket(F.col("window_start"), interval).alias("bucket"), "service")


def latency_series(rollups: DataFrame, rng: Range, service: str | None = None, interval: str = "1m") -> DataFrame:
    """Percentiles of a bucket are the unweighted mean of its windows' percentiles; rounded to 2 digits."""
    mean = [nearest(F.avg(c), 2).alias(c) for c in ("latency_p50", "latency_p95", "latency_p99", "latency_avg")]
    return _buckets(rollups, rng, service, interval).agg(*mean, F.round(F.max("latency_max"), 2).alias("latency_max"), F.sum("query_count").alias("query_count"))


def relevance_series(rollups: DataFrame, rng: Range, service: str | None = None, interval: str = "1m") -> DataFrame:
    return _buckets(rollups.where("relevance_avg is not null"), rng, service, interval).agg(nearest(F.avg("relevance_avg"), 4).alias("relevance_avg"), nearest(F.avg("relevance_p10"), 4).alias("relevance_p10"), F.sum("query_count").alias("queries"))


def error_series(rollups: DataFrame, rng: Range, service: str | None = None, interval: str = "1m") -> DataFrame:
    rate = F.sum("error_count") / F.nullif(F.sum("query_count"), F.lit(0))
    return _buckets(rollups, rng, service, interval).agg(F.sum("query_count").alias("query_count"), F.sum("error_count").alias("error_count"), F.round(rate, 6).alias("error_rate"))


def summary(rollups: DataFrame, anomalies: DataFrame, rng: Range) -> DataFrame:
    """One row, also for an empty range: counts 0, means null."""
    rows = rollups.where(within(F.col("window_start"), rng))
    opened = anomalies.where(within(F.col("window_start"), rng)).agg(F.count("*").alias("open_anomalies"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = rows.agg(
        total("query_count").alias("query_count"), total("error_count").alias("error_count"), F.round(F.sum("error_count") / F.nullif(F.sum("query_count"), F.lit(0)), 6).alias("error_rate"),
        *(nearest(F.avg(c), 2).alias(c) for c in ("latency_p50", "latency_p95", "latency_p99")), nearest(F.avg("relevance_avg"), 4).alias("relevance_avg"), nearest(F.avg("cache_hit_rate"), 4).alias("cache_hit_rate"),
        F.countDistinct("service").alias("services"),
    )
    return own.crossJoin(opened)  # one row each


def service_table(rollups: DataFrame, rng: Range) -> DataFrame:
    rows = rollups.where(within(F.col("window_start"), rng)).groupBy("service")
    return rows.agg(F.sum("query_count").alias("query_count"), nearest(F.avg("latency_p95"), 2).alias("latency_p95"), F.round(F.sum("error_count") / F.nullif(F.sum("query_count"), F.lit(0)), 6).alias("error_rate")).orderBy(F.desc("query_count"), "service")


def anomaly_page(anomalies: DataFrame, rng: Range, service: str | None = None, severity: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of anomalies, the newest first; limit is held to 1..1000 and offset to 0 or more."""
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    rows = service_filter(anomalies.where(within(F.col("window_start"), rng)), service)
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc("window_end"), "service", "metric").offset(max(0, offset)).limit(min(1000, max(1, limit)))


def slowest_queries(events: DataFrame, rng: Range, service: str | None = None, limit: int = 20) -> DataFrame:
    rows = service_filter(events.where(within(F.col("timestamp"), rng)), service)
    return rows.select("query_id", "service", "timestamp", "latency_ms", "status").orderBy(F.desc("latency_ms"), "query_id").limit(min(1000, max(1, limit)))


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and newest record of each table, an em dash if it is empty. tables: name -> (rows, time column)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.coalesce(F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss"), F.lit("—")).alias("newest")) for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recent_service_stats(events: DataFrame, as_of: datetime, minutes: int = 15) -> DataFrame:
    from datetime import timedelta

    rows = events.where((F.col("timestamp") > F.lit(as_of - timedelta(minutes=minutes))) & (F.col("timestamp") <= F.lit(as_of)))
    return rows.groupBy("service").agg(F.count("*").alias("queries"), nearest(F.avg("latency_ms"), 1).alias("avg_ms"), F.round(100 * F.count_if(F.col("status") != "ok") / F.count("*"), 2).alias("error_pct")).orderBy(F.desc("queries"), "service")


def services_dim(spark: SparkSession, rows: tuple = OBJECTIVES) -> DataFrame:
    """The objectives of each service: 99th percentile in ms and error rate."""
    return spark.createDataFrame(list(rows), "service string, slo_p99_ms double, slo_error_rate double")


def slo_breaches(rollups: DataFrame, services: DataFrame) -> DataFrame:
    """Windows that miss an objective of their service; the dimension has a row for each service only."""
    joined = rollups.join(services, "service")
    flags = joined.withColumns({"latency_breach": F.col("latency_p99") > F.col("slo_p99_ms"), "error_breach": F.col("error_rate") > F.col("slo_error_rate")})
    return flags.where("latency_breach or error_breach").select("service", "window_start", "latency_p99", "error_rate", "latency_breach", "error_breach")


def known_services(df: DataFrame) -> DataFrame:
    return df.select("service").where("service is not null").distinct()


def pivot_series(series: DataFrame, value: str, services: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """A row for each bucket, a column for each service in order; what is missing stays null, or becomes `missing` (error rates: 0)."""
    wide = series.groupBy("bucket").pivot("service", services).agg(F.first(value, ignorenulls=True))
    return (wide if missing is None else wide.fillna(missing)).orderBy("bucket")


def service_baselines(rollups: DataFrame, as_of: datetime, minutes: int = 60) -> DataFrame:
    """Mean 95th percentile of each service over the windows after as_of less minutes; services without any are left out."""
    from datetime import timedelta

    rows = rollups.where(F.col("window_start") > F.lit(as_of - timedelta(minutes=minutes)))
    return rows.groupBy("service").agg(F.avg("latency_p95").alias("baseline_p95")).where("baseline_p95 is not null and baseline_p95 <> 0")
