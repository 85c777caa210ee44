"""The lifecycles of alerts and jobs, and windows that late events repair, as streams with keyed state and timers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from querypulse.functions.columns import window_start
from querypulse.operators.lifecycles import DEFAULT_POLICY, NOTIFICATION, POLICIES, SECOND, TIMEOUT, Firings, Job, Notifier, member_of
from querypulse.operators.rollup import COLUMNS
from querypulse.session import importable


class _Machine(StatefulProcessor):
    """Keeps a machine for each key: rows wait in it until the watermark has passed them, so that it takes all of them in order, and a timer stands at the next time at which it has something to do."""

    def __init__(self, make: Callable[[tuple], object], columns: list[str], read: Callable[[pd.DataFrame], list[tuple]]):
        self.make, self.columns, self.read = make, columns, read

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.saved = handle, handle.getValueState("saved", "machine string")

    def machine(self, key: tuple):
        m = self.make(key)
        if self.saved.exists():
            m.__dict__.update(json.loads(self.saved.get()[0]))
        return m

    def keep(self, m) -> None:
        due = m.due()
        if due is None:
            self.saved.clear()
            return
        self.saved.update((json.dumps(m.__dict__),))
        # the timer goes off when the watermark is past it
        self.handle.registerTimer(-(-due // 1000))

    def told(self, key: tuple, m, until_ms: int) -> pd.DataFrame:
        out = [(*key, pd.Timestamp(x[0], unit="us"), *x[1:]) for x in m.advance(until_ms * 1000)]
        self.keep(m)
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m = self.machine(key)
        m.add([x for part in rows for x in self.read(part)])
        yield self.told(key, m, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.told(key, self.machine(key), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def micros(t: pd.Series) -> list[int]:
    return (pd.to_datetime(t, utc=True) - pd.Timestamp(0, tz="UTC")).dt.total_seconds().mul(SECOND).round().astype("int64").tolist()


def stream_group_alerts(alerts: DataFrame, timeout: int = TIMEOUT, grace: str = "5 seconds") -> DataFrame:
    """The notifications of group_alerts as a stream, each out once the watermark has passed it. State: a group's alerts, what was told last, and samples the watermark has not passed."""
    importable(alerts.sparkSession)
    group = ["receiver", "alertname", "service"]
    rows = alerts.select("ts", *group, member_of(alerts).alias("member")).withWatermark("ts", grace)
    read = lambda p: [(t, m, t + timeout * SECOND) for t, m in zip(micros(p.ts), p.member, strict=True)]
    machine = _Machine(lambda key: Notifier(POLICIES.get(key[0], DEFAULT_POLICY)), [*group, "notified_at", "firing", "resolved"], read)
    return rows.groupBy(*group).transformWithStateInPandas(machine, f"receiver string, alertname string, service string, {NOTIFICATION}", "append", "eventtime")


def stream_alert_lifecycle(firings: DataFrame, by: str = "signature", at: str = "window_end", ttl: int = 3600, grace: str = "5 seconds") -> DataFrame:
    """The rows of alert_lifecycle as a stream. State: one number of samples and the last time for each alert, and samples the watermark has not passed."""
    importable(firings.sparkSession)
    rows = firings.select(F.col(at).alias("at"), by).withWatermark("at", grace)
    machine = _Machine(lambda _: Firings(ttl), [by, "at", "state", "fire_count"], lambda p: [(t,) for t in micros(p["at"])])
    return rows.groupBy(by).transformWithStateInPandas(machine, f"{by} string, at timestamp, state string, fire_count int", "append", "eventtime")


def stream_job_lifecycle(events: DataFrame, ttl: int = 3600, grace: str = "5 seconds") -> DataFrame:
    """The rows of job_lifecycle as a stream. State: a job's state and since when."""
    importable(events.sparkSession)
    rows = events.select("id", "at", "event", "error").withWatermark("at", grace)
    machine = _Machine(lambda _: Job(ttl), ["id", "at", "state", "error"], lambda p: list(zip(micros(p["at"]), p.event.tolist(), p.error.tolist(), strict=True)))
    return rows.groupBy("id").transformWithStateInPandas(machine, "id string, at timestamp, state string, error string", "append", "eventtime")


def nearest_rank(values: list[float], q: float) -> float | None:
    """The value of rank ceil(n q) of sorted values."""
    n = len(values)
    return values[max(1, min(n, int(-(-n * q // 1)))) - 1] if n else None


VERSIONS = "window_start timestamp, service string, window_end timestamp, query_count long, error_count long, error_rate double, latency_p50 double, latency_p95 double, latency_p99 double, latency_avg double, latency_max double, relevance_avg double, relevance_p10 double, cache_hit_rate double, version int"


class _Window(StatefulProcessor):
    """The events of one window of one service: told when it closes, and again, as the next version, whenever events come late, until the watermark, which trails the newest event by `keep`, has passed it."""

    def __init__(self, seconds: int, grace: int, keep: int):
        self.seconds, self.grace, self.kept = seconds, grace, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "failed boolean, latency double, relevance double, hit boolean")
        self.version = handle.getValueState("version", "version int")

    def rolled(self, key: tuple, version: int) -> pd.DataFrame:
        failed, latency, relevance, hit = zip(*self.events.get(), strict=True)
        n, known, scores = len(failed), sorted(x for x in latency if x is not None), sorted(x for x in relevance if x is not None)
        mean = lambda x: sum(x) / len(x) if x else None
        row = (
            n, sum(failed), sum(failed) / n, *(nearest_rank(known, q) or 0.0 for q in (0.5, 0.95, 0.99)), mean(known), known[-1] if known else None,
            mean(scores), nearest_rank(scores, 0.1), sum(bool(x) for x in hit) / n,
        )
        end = key[0] + pd.Timedelta(seconds=self.seconds)
        self.version.update((version,))
        return pd.DataFrame([(*key, end, *row, version)], columns=["window_start", "service", "window_end", *COLUMNS, "version"])

    def times(self, key: tuple) -> tuple[int, int]:
        """When the window closes and when it is forgotten, as watermarks in ms."""
        end = int(pd.Timestamp(key[0]).timestamp() * 1000) + self.seconds * 1000
        return end + (self.grace - self.kept) * 1000, end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for part in rows for r in part[["failed", "latency_ms", "relevance_score", "cache_hit"]].itertuples(index=False)]
        self.events.appendList([(bool(f), None if x is None else float(x), None if s is None else float(s), None if h is None else bool(h)) for f, x, s, h in new])
        closes, ends = self.times(key)
        if self.version.exists():
            yield self.rolled(key, self.version.get()[0] + 1)
        elif timerValues.getCurrentWatermarkInMs() >= closes:
            yield self.rolled(key, 1)
        else:
            self.handle.registerTimer(max(1, closes))
        self.handle.registerTimer(max(1, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closes, ends = self.times(key)
        if not self.version.exists() and self.events.exists():
            yield self.rolled(key, 1)
        if timerValues.getCurrentWatermarkInMs() >= ends:
            self.events.clear()
            self.version.clear()

    def close(self) -> None:
        pass


def stream_rollup_versions(events: DataFrame, window_seconds: int = 60, grace_seconds: int = 5, keep_seconds: int = 3600) -> DataFrame:
    """Windows with a version: 1 when the newest event time less the grace has passed their end, one more each time that later events, of up to keep_seconds behind the newest one, fall into them.

    Append the rows and read the newest version of each (window_start, service); it is what metric_rollup makes of all events. State: the events of windows that still take some.
    """
    if not 0 <= grace_seconds <= keep_seconds:
        raise ValueError("windows are kept for longer than the grace")
    importable(events.sparkSession)
    rows = events.withWatermark("timestamp", f"{keep_seconds} seconds")
    rows = rows.select("timestamp", window_start(F.col("timestamp"), window_seconds).alias("window_start"), "service", (F.coalesce("status", F.lit("")) != "ok").alias("failed"), "latency_ms", "relevance_score", "cache_hit")
    return rows.groupBy("window_start", "service").transformWithStateInPandas(_Window(window_seconds, grace_seconds, keep_seconds), VERSIONS, "append", "eventtime")
