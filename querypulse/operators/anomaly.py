"""Anomalies: every window against its own service's recent windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querypulse.schemas import WATCHED


def unpivot_metrics(rollups: DataFrame, metrics: tuple[str, ...] = WATCHED) -> DataFrame:
    """(service, window_start, window_end, samples: the window's query_count, metric, observed)."""
    rows = rollups.select("service", "window_start", "window_end", F.col("query_count").alias("samples"), *(F.col(m).cast("double").alias(m) for m in metrics))
    return rows.unpivot(["service", "window_start", "window_end", "samples"], list(metrics), "metric", "observed")


def rolling_baseline(series: DataFrame, n: int = 30, block_seconds: int = 604_800) -> DataFrame:
    """Mean, population deviation and count of the n windows before each, of the same service and metric; gaps in time are skipped.

    A long series is many tasks: it is cut into blocks of time, and each is given the last n windows before it. Those come from the ends of the n blocks before, as a block has a window at least.
    """
    keys = ["service", "metric", "_block"]
    rows = series.withColumn("_block", F.floor(F.unix_seconds("window_start") / block_seconds))
    back = Window.partitionBy(*keys).orderBy(F.desc("window_start"))
    ends = rows.select(*keys, "window_start", "observed").withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n)
    ends = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("window_start", "observed"))).alias("_end"))
    before = Window.partitionBy("service", "metric").orderBy("_block").rowsBetween(-n, -1)
    halo = ends.withColumn("_h", F.flatten(F.collect_list("_end").over(before)))
    halo = halo.select(*keys, F.explode(F.slice(F.reverse("_h"), 1, n)).alias("_h")).select(*keys, F.col("_h.window_start").alias("window_start"), F.col("_h.observed").alias("observed"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(halo, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(-n, -1)
    scored = both.withColumns({"baseline_mean": F.avg("observed").over(last), "baseline_stddev": F.stddev_pop("observed").over(last), "sample_count": F.count("observed").over(last)})
    return scored.where("_own").drop("_own", "_block")


def severity(z: Column, threshold: float, critical_multiplier: float = 2.0) -> Column:
    return F.when(F.abs(z) >= threshold * critical_multiplier, "critical").otherwise("warning")


def anomaly_signature() -> Column:
    return F.concat_ws(":", "service", "metric", "severity")


def detect_anomalies(rollups: DataFrame, threshold: float = 3.0, baseline_windows: int = 30, min_baseline_windows: int = 5, min_samples: int = 10, critical_multiplier: float = 2.0) -> DataFrame:
    """Windows at least threshold deviations from their baseline, in either direction.

    Short baselines, flat ones and windows of few queries are not judged, but they are part of later baselines: the gates come after the window function.
    """
    if threshold <= 0 or min_baseline_windows < 2:
        raise ValueError("the threshold must be positive and a baseline two windows at least")
    scored = rolling_baseline(unpivot_metrics(rollups), baseline_windows)
    judged = scored.where((F.col("sample_count") >= min_baseline_windows) & (F.col("baseline_stddev") > 0) & (F.col("samples") >= min_samples))
    z = judged.withColumn("z_score", (F.col("observed") - F.col("baseline_mean")) / F.col("baseline_stddev")).where(F.abs("z_score") >= threshold)
    return z.withColumn("severity", severity(F.col("z_score"), threshold, critical_multiplier)).withColumn("signature", anomaly_signature())


def alert_state(anomalies: DataFrame) -> DataFrame:
    """First and last firing and their number, one row for each signature."""
    return anomalies.groupBy("signature").agg(F.min("window_end").alias("first_fired"), F.max("window_end").alias("last_fired"), F.count("*").alias("fire_count"))


def suppress_duplicates(anomalies: DataFrame, quiet_seconds: int = 3600) -> DataFrame:
    """Only firings that begin a run: the signature was quiet for longer than quiet_seconds before."""
    before = F.lag("window_end").over(Window.partitionBy("signature").orderBy("window_end"))
    gap = F.unix_seconds(F.col("window_end").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    return anomalies.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > quiet_seconds)).drop("_gap")


def explain_anomaly() -> Column:
    """One sentence about a row of detect_anomalies."""
    side = F.when(F.col("z_score") > 0, "above").otherwise("below")
    return F.format_string("%s is %.1fσ %s a baseline of %.1f ± %.1f", "metric", F.abs("z_score"), side, "baseline_mean", "baseline_stddev")


def storm_counts(anomalies: DataFrame, seconds: int = 3600) -> DataFrame:
    """Anomalies by severity over time."""
    return anomalies.groupBy(F.window("window_end", f"{seconds} seconds")["start"].alias("period"), "severity").agg(F.count("*").alias("anomalies"))
