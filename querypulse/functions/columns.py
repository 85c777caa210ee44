"""Column functions: windows, exact percentiles, tones, formats."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bucket widths that dashboards may ask for.
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window, aligned to the epoch in UTC."""
    if seconds <= 0:
        raise ValueError("a window must last a positive number of seconds")
    return F.window(ts, f"{seconds} seconds")["start"]


def percentile_nearest_rank(x: str, q: float) -> Column:
    """The value at rank ceil(n q) of the non-null values of a column; 0.0 if there is none."""
    if not 0 < q <= 1:
        raise ValueError("a percentile lies in (0, 1]")
    return F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {x})"), F.lit(0.0))


def bucket(ts: Column, interval: str) -> Column:
    """Start of a dashboard bucket; intervals other than those of INTERVALS are an error."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval}")
    return F.window(ts, INTERVALS[interval])["start"]


def time_range(minutes: int | None = None, start: datetime | None = None, end: datetime | None = None, as_of: datetime | None = None) -> tuple[datetime, datetime]:
    """A look-back from as_of, or both bounds; one bound alone is an error. Both ends belong to it."""
    if (start is None) != (end is None):
        raise ValueError("give both bounds or none")
    if start is not None:
        if end < start:
            raise ValueError("the end lies before the start")
        return start, end
    minutes = 60 if minutes is None else minutes
    if not 1 <= minutes <= 43_200:
        raise ValueError("minutes must be 1 to 43200")
    until = (as_of or datetime.now(timezone.utc)).replace(microsecond=0)
    return until - timedelta(minutes=minutes), until


def within(ts: Column, rng: tuple[datetime, datetime]) -> Column:
    return ts.between(F.lit(rng[0]), F.lit(rng[1]))


def error_tone(rate: Column) -> Column:
    return F.when(rate.isNull(), "neutral").when(rate >= 0.05, "bad").when(rate >= 0.01, "warn").otherwise("good")


def latency_tone(ms: Column) -> Column:
    return F.when(ms.isNull(), "neutral").when(ms >= 2000, "bad").when(ms >= 1000, "warn").otherwise("good")


def format_ms(ms: Column) -> Column:
    """Milliseconds below a second, else seconds of two digits; an em dash for null."""
    return F.when(ms.isNull(), "—").when(ms >= 1000, F.format_string("%.2f s", ms / 1000)).otherwise(F.format_string("%.0f ms", ms))


def format_percent(share: Column) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.format_string("%.2f%%", share * 100))


def format_score(score: Column) -> Column:
    return F.when(score.isNull(), "—").otherwise(F.format_string("%.3f", score))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.55, "medium").otherwise("low")


def label_matches(value: Column, pattern: str) -> Column:
    """A label match that covers the whole value."""
    return value.rlike(f"^(?:{pattern})$")


def orderable(df: DataFrame, *names: str) -> list[Column]:
    """Columns as values that have an order: maps (and what holds them) as JSON of their sorted entries."""
    out = []
    for n in names:
        kind = df.schema[n].dataType
        text = kind.simpleString()
        if text.startswith("map<"):
            out.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(n)))).alias(n))
        elif "map<" in text or "variant" in text:
            out.append(F.to_json(F.struct(n)).alias(n))
        else:
            out.append(F.col(n))
    return out
