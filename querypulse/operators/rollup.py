"""Windowed rollups of search events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypulse.functions.columns import orderable, percentile_nearest_rank, window_start
from querypulse.operators.order_stats import nearest_ranks, same


#: Percentiles of a window: name -> (column, share).
RANKS = {"latency_p50": ("latency_ms", 0.5), "latency_p95": ("latency_ms", 0.95), "latency_p99": ("latency_ms", 0.99), "relevance_p10": ("relevance_score", 0.1)}
COLUMNS = ["query_count", "error_count", "error_rate", "latency_p50", "latency_p95", "latency_p99", "latency_avg", "latency_max", "relevance_avg", "relevance_p10", "cache_hit_rate"]


def plain_columns() -> list[Column]:
    """Aggregates of one window of one service but for percentiles. Null latencies, scores and flags are skipped; without any score relevance is null, not 0."""
    return [
        F.count("*").alias("query_count"), F.count_if(F.col("status") != "ok").alias("error_count"), (F.count_if(F.col("status") != "ok") / F.count("*")).alias("error_rate"),
        F.avg("latency_ms").alias("latency_avg"), F.max("latency_ms").alias("latency_max"), F.avg("relevance_score").alias("relevance_avg"), (F.count_if(F.col("cache_hit")) / F.count("*")).alias("cache_hit_rate"),
    ]


def stream_columns() -> list[Column]:
    """All aggregates at once; a stream keeps the values of a window that is open in its state."""
    return [*plain_columns(), *(percentile_nearest_rank("latency_ms", q).alias(n) for n, (c, q) in RANKS.items() if c == "latency_ms"), F.expr("percentile_disc(0.1) within group (order by relevance_score)").alias("relevance_p10")]


def windowed(events: DataFrame, window_seconds: int) -> DataFrame:
    """A stream's windows."""
    window_start(F.col("timestamp"), window_seconds)  # checks the width
    grouped = events.groupBy(F.window("timestamp", f"{window_seconds} seconds").alias("w"), "service").agg(*stream_columns())
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "service", *COLUMNS)


def metric_rollup(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """One row for each window and service that has events, with exact nearest-rank percentiles; a null latency percentile is 0.

    Percentiles come from counts of values (nearest_ranks), so that a busy service is many tasks and no task holds a window's values.
    """
    if events.isStreaming:
        return windowed(events, window_seconds)
    start = window_start(F.col("timestamp"), window_seconds)
    rows = events.where("timestamp is not null").select(start.alias("window_start"), "service", "status", "latency_ms", "relevance_score", "cache_hit")
    plain = rows.groupBy("window_start", "service").agg(*plain_columns())
    ranks = nearest_ranks(rows, ["window_start", "service"], RANKS).withColumnsRenamed({"window_start": "_w", "service": "_s"})
    both = plain.join(ranks, same(["window_start", "service"], ["_w", "_s"]), "left")
    both = both.withColumns({n: F.coalesce(n, F.lit(0.0)) for n, (c, _) in RANKS.items() if c == "latency_ms"})
    return both.select("window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(float(window_seconds)))).alias("window_end"), "service", *COLUMNS)


def ordered_rollup(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    return metric_rollup(events, window_seconds).orderBy("window_start", "service")


def stream_rollup(events: DataFrame, window_seconds: int = 60, grace_seconds: int = 5) -> DataFrame:
    """The same as a stream: a window comes out once, when the latest event time less the grace has reached its end."""
    return windowed(events.withWatermark("timestamp", f"{grace_seconds} seconds"), window_seconds)


def dedupe_events(events: DataFrame, key: str = "event_id", grace: str = "5 seconds") -> DataFrame:
    """Events delivered again count once: of different copies the least by its columns in order (maps as JSON), in a stream the first to come (keys are remembered for the time of its watermark)."""
    if events.isStreaming:
        return events.withWatermark("timestamp", grace).dropDuplicatesWithinWatermark([key])
    own = [c for c in events.columns if c != key]
    if not own:
        return events.distinct()
    kept = events.groupBy(key).agg(F.min_by(F.struct(*own), F.struct(*orderable(events, *own))).alias("_e"))
    return kept.select(*(F.col(key) if c == key else F.col("_e")[c].alias(c) for c in events.columns))


def repair_late(events: DataFrame, late: DataFrame, window_seconds: int = 60, inserted_at: datetime | None = None) -> DataFrame:
    """Whole new rows for the windows that late events fall in, computed from all raw events; append them and read through latest_by."""
    key = [window_start(F.col("timestamp"), window_seconds).alias("_w"), "service"]
    touched = late.select(*key).distinct()
    again = events.withColumn("_w", window_start(F.col("timestamp"), window_seconds)).join(touched, ["_w", "service"], "left_semi").drop("_w")
    return metric_rollup(again, window_seconds).withColumn("inserted_at", F.lit(inserted_at) if inserted_at else F.current_timestamp())


def open_windows(events: DataFrame, window_seconds: int = 60, grace_seconds: int = 5) -> DataFrame:
    """Windows that still take events: their end lies after the latest event time less the grace."""
    mark = events.agg(F.max("timestamp").alias("_m"))
    spans = events.select(F.window("timestamp", f"{window_seconds} seconds").alias("w"), "service").distinct()
    return spans.crossJoin(F.broadcast(mark)).where(F.col("w.end") > F.col("_m") - F.make_dt_interval(secs=F.lit(float(grace_seconds)))).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "service")


def flush_open(events: DataFrame, window_seconds: int = 60, grace_seconds: int = 5) -> DataFrame:
    """Rollups of the windows that still take events, so that nothing is lost when a job is shut down. Together with what a stream put out they are all windows."""
    mark = events.agg(F.max("timestamp").alias("_m"))
    end = window_start(F.col("timestamp"), window_seconds) + F.make_dt_interval(secs=F.lit(float(window_seconds)))
    late = events.crossJoin(F.broadcast(mark)).where(end > F.col("_m") - F.make_dt_interval(secs=F.lit(float(grace_seconds)))).drop("_m")  # one row
    return metric_rollup(late, window_seconds)


def rollup_rows(rollups: DataFrame) -> DataFrame:
    """Rounded half to even for storage: latencies to 3 digits, rates and relevance to 6."""
    digits = {"latency_p50": 3, "latency_p95": 3, "latency_p99": 3, "latency_avg": 3, "latency_max": 3, "error_rate": 6, "relevance_avg": 6, "relevance_p10": 6, "cache_hit_rate": 6}
    return rollups.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in rollups.columns})
