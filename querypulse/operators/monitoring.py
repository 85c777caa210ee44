"""Monitoring rules over samples (metric, labels map, ts, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Receivers by severity (a critical alert goes on to chat), receivers by channel.
ROUTES = (("critical", ("pager", "chat")),)
CHANNELS = (("slack-search-quality", "quality"),)


def series_key(labels: Column) -> Column:
    """Labels as text, in order, so that samples of one series group together."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def counter_deltas(samples: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """Adds _s (the series as text), _t (seconds), _block and _d: growth since the series' sample before, resets taken as a new start from 0, 0 for the first.

    A long series is many tasks: samples look back within a block of time, and a block's first one at a row that tells the last value of the block before.
    """
    rows = samples.withColumn("_s", series_key(F.col("labels"))).withColumn("_t", F.unix_seconds("ts")).withColumn("_block", F.floor(F.col("_t") / block_seconds))
    keys = ["metric", "_s", "_block"]
    ends = rows.groupBy(*keys).agg(F.max_by("value", F.struct("_t", "value")).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("metric", "_s").orderBy("_block"))).drop("_end")
    ends = ends.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    last = F.coalesce(F.lag("value").over(Window.partitionBy(*keys).orderBy("_t", "value")), F.col("_before"))
    rows = rows.join(ends, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)))
    delta = F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last)
    return rows.withColumn("_d", delta).drop("_before", *(f"_of_{k}" for k in keys))


def counter_increase(samples: DataFrame, seconds: int) -> DataFrame:
    """Growth of each counter over the last seconds, resets taken as a new start from 0. No extrapolation to the range's ends. Blocks of time are tasks of their own; each is given the end of the one before."""
    block = max(86_400, seconds)
    rows = counter_deltas(samples, block).withColumn("_halo", F.lit(False))
    tail = rows.where((F.col("_block") + 1) * block - F.col("_t") < seconds).withColumns({"_block": F.col("_block") + 1, "_halo": F.lit(True)})
    by = Window.partitionBy("metric", "_s", "_block").orderBy("_t").rangeBetween(-seconds + 1, 0)
    return rows.unionByName(tail).withColumn("increase", F.sum("_d").over(by)).where("not _halo").drop("_s", "_t", "_d", "_block", "_halo")


def counter_rate(samples: DataFrame, seconds: int) -> DataFrame:
    return counter_increase(samples, seconds).withColumn("rate", F.col("increase") / seconds).drop("increase")


def sum_by(df: DataFrame, labels: tuple[str, ...], value: str = "value") -> DataFrame:
    """(ts, a column for each label, value)."""
    return df.groupBy("ts", *(F.col("labels")[k].alias(k) for k in labels)).agg(F.sum(value).alias("value"))


def safe_ratio(num: DataFrame, den: DataFrame, grid: DataFrame, floor: float = 0.001) -> DataFrame:
    """(ts, value) on the grid's times: missing series count as 0, the denominator is floor at least."""
    rows = grid.select("ts").distinct().join(num.select("ts", F.col("value").alias("_n")), "ts", "left").join(den.select("ts", F.col("value").alias("_d")), "ts", "left")
    return rows.select("ts", (F.coalesce("_n", F.lit(0.0)) / F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(floor))).alias("value"))


def recording_rules(rates: DataFrame) -> dict[str, DataFrame]:
    """Named series from rates: the sum of each metric over all its series."""
    total = lambda m: rates.where(F.col("metric") == m).groupBy("ts").agg(F.sum("rate").alias("value"))
    ok, bad = total("events_accepted"), total("events_rejected")
    both = ok.unionByName(bad).groupBy("ts").agg(F.sum("value").alias("value"))
    return {"ingest_rate": ok, "rejection_ratio": safe_ratio(bad, both, both), "processing_rate": total("events_processed"), "request_rate": sum_by(rates.where("metric = 'requests'"), ("endpoint",), "rate"), "error_ratio": safe_ratio(rates.where((F.col("metric") == "requests") & F.col("labels")["status"].rlike("^(?:5..)$")).groupBy("ts").agg(F.sum("rate").alias("value")), total("requests"), rates.where("metric = 'requests'"))}


def histogram_quantile(buckets: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles from cumulative buckets (ts, by..., le, cumulative): linear within the first bucket that reaches q of the total; the last finite bound above it."""
    if not 0 < q < 1:
        raise ValueError("a quantile lies between 0 and 1")
    keys = ["ts", *by]
    w = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = buckets.withColumns({"_low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_before": F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)), "_total": F.max("cumulative").over(whole)}).withColumn("_rank", F.col("_total") * q)
    first = rows.where("_total > 0 and cumulative >= _rank").groupBy(*keys).agg(F.min_by(F.struct("le", "_low", "_before", "cumulative", "_rank"), "le").alias("b"))
    inside = F.col("b._low") + (F.col("b.le") - F.col("b._low")) * (F.col("b._rank") - F.col("b._before")) / F.greatest(F.col("b.cumulative") - F.col("b._before"), F.lit(1e-12))
    return first.select(*keys, F.when(F.col("b.le") == float("inf"), F.col("b._low")).otherwise(inside).alias("value"))


def evaluate_alert(df: DataFrame, predicate: Column, hold_seconds: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds state: inactive, pending, or firing once the condition has held for hold_seconds without a false sample in between.

    Samples are judged day by day, so a long series is many tasks; what one day hands to the next is a row a day: its last false sample, or else its first true one.
    """
    ok = F.coalesce(predicate, F.lit(False))
    rows = df.withColumns({"_ok": ok, "_day": F.floor(F.unix_seconds("ts") / 86_400), "_t": F.unix_seconds("ts")})
    within = Window.partitionBy(*by, "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # a run of true samples begins with the first one after the last false one, of this day or of days before
    number = F.row_number().over(Window.partitionBy(*by, "_day").orderBy("ts"))
    rows = rows.withColumn("_n", number).withColumn("_false", F.max(F.when(~F.col("_ok"), F.col("_n"))).over(within))
    first = F.min(F.when(F.col("_ok"), F.col("_t"))).over(Window.partitionBy(*by, "_day", "_false"))
    rows = rows.withColumn("_first", first)
    days = rows.groupBy(*by, "_day").agg(F.max(F.when(~F.col("_ok"), F.col("_n"))).alias("_last"), F.max_by("_first", "_n").alias("_open"), F.max_by("_ok", "_n").alias("_ends_true"))
    order = Window.partitionBy(*by, F.lit(0)).orderBy("_day")
    blocked = F.sum(F.when(F.col("_last").isNull(), 0).otherwise(1)).over(order)
    days = days.withColumn("_block", blocked)
    # within days of one block there is no false sample but in the first, so the run of its end goes on
    start = F.min(F.when(F.col("_ends_true"), F.col("_open"))).over(Window.partitionBy(*by, F.lit(0), "_block").orderBy("_day"))
    days = days.withColumn("_start", start).withColumn("_carried", F.lag("_start").over(order))
    keys = [*by, "_day"]
    carried = days.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_carried")
    joined = rows.join(carried, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)))
    since = F.when(F.col("_false").isNull(), F.coalesce("_carried", "_first")).otherwise(F.col("_first"))
    held = F.col("_t") - since
    return joined.withColumn("state", F.when(~F.col("_ok"), "inactive").when(held >= hold_seconds, "firing").otherwise("pending")).select(*df.columns, "state")


def both_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ts, a, b) where both have a sample."""
    return a.select("ts", F.col("value").alias("a")).join(b.select("ts", F.col("value").alias("b")), "ts")


def engine_stalled(ingest: DataFrame, processed: DataFrame, hold_seconds: int = 300) -> DataFrame:
    """Events come in, none is processed."""
    return evaluate_alert(both_series(ingest, processed), (F.col("a") > 1) & (F.col("b") == 0), hold_seconds)


def service_down(up: DataFrame, hold_seconds: int = 120) -> DataFrame:
    """up: (ts, job, value)."""
    return evaluate_alert(up, F.col("value") == 0, hold_seconds, ("job",))


def services_up(up: DataFrame) -> DataFrame:
    return up.groupBy("ts").agg(F.sum("value").alias("value"))


def consumer_lag_alert(lag: DataFrame, most: float = 10_000, hold_seconds: int = 600) -> DataFrame:
    """lag: (ts, partition, value); the sum over partitions counts."""
    return evaluate_alert(lag.groupBy("ts").agg(F.sum("value").alias("value")), F.col("value") > most, hold_seconds)


def route_alerts(alerts: DataFrame, routes: tuple = ROUTES, channels: tuple = CHANNELS, default: str = "chat") -> DataFrame:
    """A row for each receiver: those of the severity, or else the one of the channel label (if there is such a column), or else the default."""
    listed = reduce(lambda c, r: c.when(F.col("severity") == r[0], F.array(*map(F.lit, r[1]))), routes, F.when(F.lit(False), F.array(F.lit(default))))
    if "channel" in alerts.columns:
        listed = reduce(lambda c, r: c.when(F.col("channel") == r[0], F.array(F.lit(r[1]))), channels, listed)
    return alerts.withColumn("receiver", F.explode(listed.otherwise(F.array(F.lit(default)))))


def inhibit(alerts: DataFrame, source: str = "ServiceDown", target: tuple[str, ...] = ("warning", "critical"), equal: tuple[str, ...] = ("job",)) -> DataFrame:
    """Alerts without those that a firing source alert of the same time and job mutes; the source itself stays."""
    muting = alerts.where(F.col("alertname") == source).select("ts", *equal).distinct()
    own = (F.col("alertname") == source) | ~F.col("severity").isin(*target)
    return alerts.where(own).unionByName(alerts.where(~own).join(muting, ["ts", *equal], "left_anti"))


def resolve(alerts: DataFrame, timeout_seconds: int = 300, as_of: Column | None = None, by: tuple[str, ...] = ("alertname", "service")) -> DataFrame:
    """(by, resolved_at): ends of runs of samples, where none follows within the timeout (judged at as_of for the last)."""
    nxt = F.lead("ts").over(Window.partitionBy(*by).orderBy("ts"))
    until = F.coalesce(nxt, as_of if as_of is not None else F.lit(None).cast("timestamp"))
    rows = alerts.withColumn("_gap", F.unix_seconds(until) - F.unix_seconds("ts")).where(F.col("_gap") > timeout_seconds)
    return rows.select(*by, F.timestamp_seconds(F.unix_seconds("ts") + timeout_seconds).alias("resolved_at"))


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(F.col("labels")[label].alias("value")).where("value is not null").distinct()
