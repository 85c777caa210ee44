"""Stateful streams: anomalies from a rollup stream, and events from raw records to rollups."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from querypulse.operators.anomaly import unpivot_metrics
from querypulse.operators.rollup import windowed
from querypulse.operators.validate import decode_events, event_rules, require_utc, strip_strings
from querypulse.session import importable

OUT = "service string, metric string, window_start timestamp, window_end timestamp, observed double, baseline_mean double, baseline_stddev double, sample_count long, z_score double, severity string, signature string"


class _Detector(StatefulProcessor):
    """Keeps the last values of one (service, metric) and scores each new window against them."""

    def __init__(self, threshold: float, windows: int, least: int, samples: int, critical: float):
        self.rules = threshold, windows, least, samples, critical

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        threshold, windows, least, samples, critical = self.rules
        past = [x[0] for x in self.past.get()]
        found = []
        for row in pd.concat(list(rows)).sort_values("window_start").itertuples():
            n = len(past)
            if n >= least and row.samples >= samples:
                mean = sum(past) / n
                spread = math.sqrt(sum((x - mean) ** 2 for x in past) / n)
                if spread > 0 and abs(z := (row.observed - mean) / spread) >= threshold:
                    level = "critical" if abs(z) >= threshold * critical else "warning"
                    found.append((*key, row.window_start, row.window_end, row.observed, mean, spread, n, z, level, ":".join([*key, level])))
            past = [*past, row.observed][-windows:]
        self.past.put([(x,) for x in past])
        yield pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_anomalies(rollups: DataFrame, threshold: float = 3.0, baseline_windows: int = 30, min_baseline_windows: int = 5, min_samples: int = 10, critical_multiplier: float = 2.0) -> DataFrame:
    """The same anomalies as detect_anomalies, from a stream of closed windows. State: baseline_windows values for each service and metric."""
    if threshold <= 0 or min_baseline_windows < 2:
        raise ValueError("the threshold must be positive and a baseline two windows at least")
    importable(rollups.sparkSession)
    series = unpivot_metrics(rollups)
    return series.groupBy("service", "metric").transformWithStateInPandas(_Detector(threshold, baseline_windows, min_baseline_windows, min_samples, critical_multiplier), OUT, "append", "none")


def events_to_rollups(raw: DataFrame, window_seconds: int = 60, grace_seconds: int = 5) -> DataFrame:
    """Raw JSON event records to closed windows: decode, validate, count repeated event ids once, roll up."""
    decoded = strip_strings(decode_events(raw))
    valid = decoded
    for bad, _ in event_rules(decoded.columns):
        valid = valid.where(~F.coalesce(bad, F.lit(False)))
    events = valid.withColumn("timestamp", require_utc(F.col("timestamp"))).withWatermark("timestamp", f"{grace_seconds} seconds").dropDuplicatesWithinWatermark(["event_id"])
    grouped = events.select("timestamp", "service", "latency_ms", "status", "relevance_score", "cache_hit")
    return windowed(grouped, window_seconds)


def observed_faults(df: DataFrame, rules: list[tuple[Column, str]], name: str = "faults") -> DataFrame:
    """df unchanged, with the number of rows that break each rule, and of rows, told with every batch: see FaultCounts. A row counts under each rule that it breaks."""
    broken = [F.count_if(F.coalesce(bad, F.lit(False))).alias(said) for bad, said in rules]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(reduce(Column.__or__, (F.coalesce(bad, F.lit(False)) for bad, _ in rules))).alias("invalid"), *broken)


class FaultCounts(StreamingQueryListener):
    """Running sums of what observed_faults tells: counts maps "rows", "invalid" and each rule's message to a number. Add it to spark.streams before the query starts."""

    def __init__(self, name: str = "faults"):
        self.name, self.counts = name, Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if row := event.progress.observedMetrics.get(self.name):
            self.counts.update({k: v for k, v in row.asDict().items() if v})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
