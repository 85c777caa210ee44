"""What becomes of alerts and jobs over time: notifications of groups, and rows for each change of state. In batch here, as streams in streaming.keyed, by the same machines."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querypulse.session import importable

# Seconds that a group waits before its first notification, between looks at it, and before it is told again, by receiver; an alert without samples for so long is over.
POLICIES = {"pager": (10, 300, 3600)}
DEFAULT_POLICY = (30, 300, 14_400)
TIMEOUT = 300
SECOND = 1_000_000

NOTIFICATION = "notified_at timestamp, firing array<string>, resolved array<string>"


@dataclass
class Notifier:
    """The notifications of one group. Times are microseconds.

    A group begins with its first alert; `wait` later its firing alerts are told, and every `interval` after it is looked at again: it is told if an alert has come or gone since it was last told, or if that is
    `repeat` ago. Once none fires, the group is over, and the next alert begins it anew.
    """

    policy: tuple[int, int, int]
    members: dict[str, int] = field(default_factory=dict)  # alert: when it ends
    told: list[str] | None = None
    last: int | None = None
    flush: int | None = None
    pending: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, rows: list[tuple[int, str, int]]) -> None:
        """rows: (time, alert, when it ends if no more is heard of it)."""
        self.pending = sorted([*map(tuple, self.pending), *rows])

    def due(self) -> int | None:
        times = [t for t in (self.pending[0][0] if self.pending else None, self.flush) if t is not None]
        return min(times) if times else None

    def advance(self, until: int | None = None) -> list[tuple[int, list[str], list[str]]]:
        out, k = [], 0
        wait, interval, repeat = (x * SECOND for x in self.policy)
        while True:
            at = self.pending[k][0] if k < len(self.pending) else None
            if at is not None and (self.flush is None or at <= self.flush):
                if until is not None and at > until:
                    break
                _, member, end = self.pending[k]
                k += 1
                self.members[member] = max(end, self.members.get(member, end))
                self.flush = at + wait if self.flush is None else self.flush
                continue
            if self.flush is None or (until is not None and self.flush > until):
                break
            now = self.flush
            firing = sorted(m for m, end in self.members.items() if end > now)
            told = set(self.told or ())
            gone = sorted(told - set(firing))
            if (firing and self.told is None) or (self.told is not None and (set(firing) - told or gone or (firing and now - self.last >= repeat))):
                out.append((now, firing, gone))
                self.told, self.last = firing, now
            self.members = {m: self.members[m] for m in firing}
            self.flush = now + interval if firing else None
            if not firing:
                self.told = self.last = None
        self.pending = self.pending[k:]
        return out


@dataclass
class Firings:
    """The states of one alert: firing with its first sample, active with the second, resolved when ttl goes by without any."""

    ttl: int
    count: int = 0
    last: int | None = None
    pending: list[int] = field(default_factory=list)

    def add(self, rows: list[tuple[int]]) -> None:
        self.pending = sorted([*self.pending, *(r[0] for r in rows)])

    def due(self) -> int | None:
        times = [t for t in (self.pending[0] if self.pending else None, None if self.last is None else self.last + self.ttl * SECOND) if t is not None]
        return min(times) if times else None

    def advance(self, until: int | None = None) -> list[tuple[int, str, int]]:
        out, k = [], 0
        while True:
            over = None if self.last is None else self.last + self.ttl * SECOND
            at = self.pending[k] if k < len(self.pending) else None
            if at is not None and (over is None or at <= over):
                if until is not None and at > until:
                    break
                k += 1
                self.count, self.last = self.count + 1, at
                if self.count <= 2:
                    out.append((at, "firing" if self.count == 1 else "active", self.count))
                continue
            if over is None or (until is not None and over > until):
                break
            out.append((over, "resolved", self.count))
            self.count, self.last = 0, None
        self.pending = self.pending[k:]
        return out


# What a job's events lead to, by its state.
STEPS = {(None, "requested"): "pending", ("pending", "started"): "running", ("pending", "failed"): "failed", ("running", "succeeded"): "succeeded", ("running", "failed"): "failed"}
TIMED_OUT = "timed out"


@dataclass
class Job:
    """The states of one job; events that its state does not allow are passed over. A job that neither ends nor goes on for ttl has failed."""

    ttl: int
    state: str | None = None
    since: int | None = None
    pending: list[tuple[int, str, str]] = field(default_factory=list)

    def add(self, rows: list[tuple[int, str, str | None]]) -> None:
        self.pending = sorted([*map(tuple, self.pending), *((a, e, x or "") for a, e, x in rows)])

    def due(self) -> int | None:
        times = [t for t in (self.pending[0][0] if self.pending else None, self.since + self.ttl * SECOND if self.state in ("pending", "running") else None) if t is not None]
        return min(times) if times else None

    def advance(self, until: int | None = None) -> list[tuple[int, str, str | None]]:
        out, k = [], 0
        while True:
            over = self.since + self.ttl * SECOND if self.state in ("pending", "running") else None
            at = self.pending[k][0] if k < len(self.pending) else None
            if at is not None and (over is None or at <= over):
                if until is not None and at > until:
                    break
                _, event, error = self.pending[k]
                k += 1
                if to := STEPS.get((self.state, event)):
                    self.state, self.since = to, at
                    out.append((at, to, error or None if to == "failed" else None))
                continue
            if over is None or (until is not None and over > until):
                break
            self.state, self.since = "failed", over
            out.append((over, "failed", TIMED_OUT))
        self.pending = self.pending[k:]
        return out


def member_of(alerts: DataFrame) -> Column:
    """What tells alerts of a group apart: all columns but time, group and receiver, as JSON."""
    own = [c for c in sorted(alerts.columns) if c not in ("ts", "alertname", "service", "receiver", "state", "value")]
    return F.to_json(F.struct(*own)) if own else F.lit("{}")


def group_alerts(alerts: DataFrame, timeout: int = TIMEOUT, until: int | None = None) -> DataFrame:
    """(receiver, alertname, service, notified_at, firing, resolved): the notifications of all groups of alerts (ts, receiver, alertname, service, and columns that tell its alerts apart).

    Samples become spans of time first: an alert fires from its first sample on until `timeout` goes by without one. A group's history is cut where it is quiet for so long that the group is over;
    each part, a row for each span, is a task's. until (seconds): judged so far only.
    """
    importable(alerts.sparkSession)
    group = ["receiver", "alertname", "service"]
    rows = alerts.select("ts", *group, member_of(alerts).alias("member")).distinct()
    longest = max(max(p[:2]) for p in (*POLICIES.values(), DEFAULT_POLICY))
    times = Window.partitionBy(*group).orderBy("ts")
    quiet = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(times)) > (timeout + longest) * SECOND
    rows = rows.withColumn("_new", F.coalesce(quiet, F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("_new").over(times.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lag("ts").over(Window.partitionBy(*group, "part", "member").orderBy("ts"))
    rows = rows.withColumn("_gap", F.coalesce(F.unix_micros("ts") - F.unix_micros(last) > timeout * SECOND, F.lit(True)).cast("int"))
    rows = rows.withColumn("_span", F.sum("_gap").over(Window.partitionBy(*group, "part", "member").orderBy("ts")))
    spans = rows.groupBy(*group, "part", "member", "_span").agg(F.unix_micros(F.min("ts")).alias("begins"), (F.unix_micros(F.max("ts")) + timeout * SECOND).alias("ends")).drop("_span")

    def told(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = Notifier(POLICIES.get(key[0], DEFAULT_POLICY))
        n.add(list(zip(rows.begins.tolist(), rows.member.tolist(), rows.ends.tolist(), strict=True)))
        out = n.advance(None if until is None else until * SECOND)
        return pd.DataFrame([(*key[:3], pd.Timestamp(at, unit="us"), f, r) for at, f, r in out], columns=[*group, "notified_at", "firing", "resolved"])

    return spans.groupBy(*group, "part").applyInPandas(told, f"receiver string, alertname string, service string, {NOTIFICATION}")


def alert_lifecycle(firings: DataFrame, by: tuple[str, ...] = ("signature",), at: str = "window_end", ttl: int = 3600, until: int | None = None) -> DataFrame:
    """(by, at, state, fire_count): a row for each change of state: firing with the first of a run, active with the second, resolved ttl seconds after the last, in runs whose gaps are ttl at most.

    until (seconds): what is resolved later than that is not told yet; None: all is.
    """
    series = Window.partitionBy(*by).orderBy("_t")
    rows = firings.select(*by, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).where("_t is not null")
    rows = rows.withColumn("_new", F.coalesce(F.col("_t") - F.lag("_t").over(series) > ttl * SECOND, F.lit(True)).cast("int"))
    rows = rows.withColumn("_n", F.row_number().over(series)).withColumn("_run", F.sum("_new").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "_run").agg(F.min("_t").alias("a"), F.min_by("_t", "_n").alias("a0"), F.max("_t").alias("z"), F.count("*").alias("n"), F.min(F.when(F.col("_new") == 0, F.struct("_n", "_t"))).alias("second"))
    change = lambda t, state, n: F.struct(t.alias("t"), F.lit(state).alias("state"), n.cast("int").alias("fire_count"))
    changes = F.array(change(F.col("a"), "firing", F.lit(1)), F.when(F.col("second").isNotNull(), change(F.col("second._t"), "active", F.lit(2))), change(F.col("z") + ttl * SECOND, "resolved", F.col("n")))
    out = runs.select(*by, F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("x")).select(*by, F.timestamp_micros("x.t").alias("at"), "x.state", "x.fire_count")
    return out if until is None else out.where(F.unix_micros("at") <= until * SECOND)


def job_lifecycle(events: DataFrame, ttl: int = 3600, until: int | None = None) -> DataFrame:
    """(id, at, state, error) from events (id, at, event, error): a row for each change of a job's state: pending, running, succeeded or failed; see STEPS. ttl and until as in Job; a job has a handful of events."""
    step = F.struct(F.unix_micros("at").alias("at"), "event", F.coalesce("error", F.lit("")).alias("error"))
    jobs = events.where("id is not null and at is not null").groupBy("id").agg(F.sort_array(F.collect_set(step)).alias("e"))
    row = "array<struct<at:bigint,state:string,error:string>>"
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("bigint").alias("since"), F.array().cast(row).alias("out"))
    waits = lambda s: s["state"].isin("pending", "running")
    told = lambda t, state, error: F.array(F.struct(t.alias("at"), state.alias("state"), error.cast("string").alias("error")))

    def ended(s: Column, now: Column) -> Column:
        over = s["since"] + ttl * SECOND
        late = F.coalesce(waits(s) & (over < now), F.lit(False))
        return F.struct(F.when(late, F.lit("failed")).otherwise(s["state"]).alias("state"), F.when(late, over).otherwise(s["since"]).alias("since"), F.when(late, F.concat(s["out"], told(over, F.lit("failed"), F.lit(TIMED_OUT)))).otherwise(s["out"]).alias("out"))

    def moved(s: Column, e: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, event), new in STEPS.items():
            to = F.when((s["state"].isNull() if state is None else s["state"] == state) & (e["event"] == event), new).otherwise(to)
        error = F.when(to == "failed", F.nullif(e["error"], F.lit("")))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), F.when(to.isNotNull(), e["at"]).otherwise(s["since"]).alias("since"), F.when(to.isNotNull(), F.concat(s["out"], told(e["at"], to, error))).otherwise(s["out"]).alias("out"))

    judged = F.col("e") if until is None else F.filter("e", lambda e: e["at"] <= until * SECOND)
    state = F.aggregate(judged, start, lambda s, e: moved(ended(s, e["at"]), e), lambda s: ended(s, F.lit((1 << 62) if until is None else until * SECOND + 1))["out"])
    return jobs.select("id", F.explode(state).alias("x")).select("id", F.timestamp_micros("x.at").alias("at"), "x.state", "x.error")
