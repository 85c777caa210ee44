"""Validation, routing and row forms of events, spans and anomalies. Nothing is dropped without a reason: each check gives valid and rejected rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querypulse.schemas import LENGTHS, MAX_BATCH, MAX_LATENCY_MS, SEARCH_EVENT, SEVERITIES, SPAN, STATUSES

ZONE = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def strip_strings(df: DataFrame) -> DataFrame:
    """Trim every top-level string column."""
    return df.withColumns({f.name: F.trim(f.name) for f in df.schema if f.dataType.typeName() == "string"})


def has_zone(raw: Column) -> Column:
    return raw.rlike(ZONE)


def require_utc(raw: Column) -> Column:
    """The instant of a text with a zone; null without a zone or if it is no time."""
    return F.when(has_zone(raw), F.try_to_timestamp(raw))


def known_fields_only(value: Column, known: list[str]) -> Column:
    """Unknown keys of a JSON object, empty if there are none."""
    return F.array_except(F.json_object_keys(value), F.array(*map(F.lit, known)))


def unique_ranks(results: Column) -> Column:
    ranks = F.transform(results, lambda r: r["rank"])
    return results.isNull() | (F.size(F.array_distinct(ranks)) == F.size(results))


def results_within_count(results: Column, count: Column) -> Column:
    return results.isNull() | (F.size(results) == 0) | (F.size(results) <= count)


def _lengths(columns: list[str]) -> list[tuple[Column, str]]:
    out = []
    for name, (least, most) in LENGTHS.items():
        if name in columns:
            n = F.length(name)
            out.append((n > most, f"{name}: longer than {most}"))
            if least:
                out.append((F.coalesce(n, F.lit(0)) < least, f"{name}: missing"))
    return out


def _judged(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(msg)) for bad, msg in rules))))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def event_rules(columns: list[str]) -> list[tuple[Column, str]]:
    """(broken, message) of every rule for a search event whose timestamp is text."""
    c = F.col
    outside = lambda x: ~x.between(0, 1)
    bare = (F.coalesce(c("error_type"), F.lit("")) != "") | (F.coalesce(c("error_message"), F.lit("")) != "")
    rules = _lengths(columns) + [
        (c("latency_ms").isNull() | ~c("latency_ms").between(0, MAX_LATENCY_MS) | F.isnan("latency_ms"), f"latency_ms: not within 0 and {MAX_LATENCY_MS:.0f}"),
        (require_utc(c("timestamp")).isNull(), "timestamp: no time with a zone"),
        (c("status").isNull() | ~c("status").isin(*STATUSES), "status: unknown"),
        (c("result_count").isNull() | ~c("result_count").between(0, 10_000), "result_count: not within 0 and 10000"),
        (outside(c("relevance_score")), "relevance_score: not within 0 and 1"),
        ((c("status") == "ok") & bare, "status: ok with error details"),
        ((c("status") != "ok") & (F.coalesce(c("error_type"), F.lit("")) == ""), "error_type: missing for a failure"),
    ]
    if "results" in columns:
        rules += [
            (~results_within_count(c("results"), c("result_count")), "results: more than result_count"), (~unique_ranks(c("results")), "results: ranks repeat"),
            (F.exists("results", lambda r: outside(r["score"])), "results: score not within 0 and 1"), (F.exists("results", lambda r: ~r["rank"].between(0, 10_000)), "results: rank not within 0 and 10000"),
        ]
    if "unknown_fields" in columns:
        rules.append((F.size("unknown_fields") > 0, "unknown fields"))
    return rules


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with violations). Strings are trimmed first; a column unknown_fields, if there is one, must be empty."""
    df = strip_strings(df)
    return _judged(df, event_rules(df.columns))


def validate_spans(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    df = strip_strings(df)
    c = F.col
    empty = lambda n: F.coalesce(c(n), F.lit("")) == ""
    rules = _lengths([x for x in df.columns if x in ("trace_id", "span_id", "service")]) + [
        (empty("trace_id"), "trace_id: missing"), (empty("span_id"), "span_id: missing"), (empty("operation"), "operation: missing"),
        (c("duration_ms").isNull() | ~c("duration_ms").between(0, MAX_LATENCY_MS), f"duration_ms: not within 0 and {MAX_LATENCY_MS:.0f}"),
        (require_utc(c("start_time")).isNull(), "start_time: no time with a zone"), (c("parent_span_id") == c("span_id"), "parent_span_id: a span is its own parent"),
    ]
    return _judged(df, rules)


def validate_anomalies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with violations): names of 1 to 64 characters, a window that ends after it starts, a count and a spread that are there and not negative, a known severity."""
    c = F.col
    rules = [(F.coalesce(F.length(n), F.lit(0)) < 1, f"{n}: missing") for n in ("service", "metric")] + [(F.length(n) > 64, f"{n}: longer than 64") for n in ("service", "metric")] + [
        (~F.coalesce(c("window_end") > c("window_start"), F.lit(False)), "window_end: not after window_start"), (c("baseline_stddev").isNull() | (c("baseline_stddev") < 0), "baseline_stddev: missing or negative"),
        (c("sample_count").isNull() | (c("sample_count") < 0), "sample_count: missing or negative"), (c("severity").isNull() | ~c("severity").isin(*SEVERITIES), "severity: unknown"),
    ]
    return _judged(df, rules)


def batch_size_gate(df: DataFrame, by: str = "request_id", limit: int = MAX_BATCH) -> DataFrame:
    """Batches of 1 to limit entries; larger ones are refused whole. A batch beyond the limit may hold most rows, so its size is counted apart from its rows."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") <= limit).select(by)
    return df.join(sizes, by, "left_semi")


def ingest_summary(rejected: DataFrame, total: DataFrame, by: str = "request_id", index: str = "index_in_batch") -> DataFrame:
    """(by, accepted, rejected, errors): of each bad entry the first violation, in order; batches are bounded by batch_size_gate."""
    bad = rejected.groupBy(by).agg(F.count("*").alias("rejected"), F.transform(F.array_sort(F.collect_list(F.struct(index, F.col("violations")[0].alias("m")))), lambda x: F.concat(F.lit("event "), x[index].cast("string"), F.lit(": "), x["m"])).alias("errors"))
    n = total.groupBy(by).agg(F.count("*").alias("_n"))
    return n.join(bad, by, "left").select(by, (F.col("_n") - F.coalesce("rejected", F.lit(0))).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def enrich(df: DataFrame, received_at: datetime | Column, trace_context: Column | None = None) -> DataFrame:
    """Adds metadata.received_at, and a trace id where there is none."""
    at = received_at if isinstance(received_at, Column) else F.lit(received_at)
    stamp = F.create_map(F.lit("received_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    kept = F.map_filter(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k != "received_at")
    return df.withColumn("metadata", F.map_concat(kept, stamp)).withColumn("trace_id", F.coalesce(F.nullif("trace_id", F.lit("")), trace_context if trace_context is not None else F.lit(None).cast("string")))


def route_topic() -> Column:
    return F.when(F.col("status") == "ok", "events").otherwise("errors")


def route_by_shape(df: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """Raw JSON records by their keys: spans have span_id and operation (asked first), results have results and no latency_ms, all else is an event. Also what is no JSON object."""
    keys = F.json_object_keys(F.col(value))
    has = lambda k: F.array_contains(keys, k)
    kind = F.when(keys.isNull(), "invalid").when(has("span_id") & has("operation"), "spans").when(has("results") & ~has("latency_ms"), "results").otherwise("events")
    marked = df.withColumn("kind", kind)
    return {k: marked.where(F.col("kind") == k).drop("kind") for k in ("events", "results", "spans", "invalid")}


def decode_json(df: DataFrame, schema, value: str = "value") -> DataFrame:
    """Fields of a JSON record, and unknown_fields. What cannot be decoded has nulls and so is rejected by validation."""
    parsed = df.withColumn("_r", F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    others = [c for c in df.columns if c != value and c not in schema.fieldNames()]
    return parsed.select(*others, "_r.*", F.coalesce(known_fields_only(F.col(value), schema.fieldNames()), F.array().cast("array<string>")).alias("unknown_fields"))


def decode_events(df: DataFrame, value: str = "value") -> DataFrame:
    return decode_json(df, SEARCH_EVENT, value)


def decode_spans(df: DataFrame, value: str = "value") -> DataFrame:
    return decode_json(df, SPAN, value).drop("unknown_fields")  # readers of spans are lenient


def encode_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def event_rows(events: DataFrame) -> DataFrame:
    """Storage form of valid events: texts are never null, times cut to milliseconds, received_at from metadata or the timestamp, flags 0 or 1."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    at = require_utc(F.col("timestamp"))
    received = F.coalesce(F.try_to_timestamp(F.col("metadata")["received_at"]), at)
    ms = lambda c: F.date_trunc("MILLISECOND", c)
    return events.select(
        *(text(c) for c in ("event_id", "query_id", "trace_id", "span_id", "service", "query")), F.coalesce("index", F.lit("")).alias("index_name"), ms(at).alias("timestamp"), ms(received).alias("received_at"),
        "latency_ms", "status", "result_count", "relevance_score", F.coalesce(F.col("cache_hit").cast("int"), F.lit(0)).alias("cache_hit"), *(text(c) for c in ("user_id", "session_id", "error_type", "error_message")),
    )


def result_rows(events: DataFrame) -> DataFrame:
    """A row for each result of each event, with defaults for missing parts."""
    r = events.where(F.size("results") > 0).select("query_id", "service", require_utc(F.col("timestamp")).alias("timestamp"), F.explode("results").alias("r"))
    return r.select("query_id", "service", "timestamp", F.coalesce("r.document_id", F.lit("")).alias("document_id"), F.coalesce("r.rank", F.lit(0)).alias("rank"), F.coalesce("r.score", F.lit(0.0)).alias("score"), F.coalesce("r.title", F.lit("")).alias("title"))


def result_records(events: DataFrame) -> DataFrame:
    """JSON records of the results topic, only for events that have results."""
    return events.where(F.size("results") > 0).select(F.col("query_id").alias("key"), F.to_json(F.struct("query_id", "service", "timestamp", "results")).alias("value"))


def span_rows(spans: DataFrame) -> DataFrame:
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("trace_id", "span_id", "parent_span_id", "query_id", "service", "operation")]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return spans.select(*texts, require_utc(F.col("start_time")).alias("start_time"), F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"), F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("attributes", empty).alias("attributes"))


def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """Window bounds in seconds, time of detection in milliseconds, as text."""
    s, ms = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS"
    return anomalies.withColumns({"window_start": F.date_format("window_start", s), "window_end": F.date_format("window_end", s), "detected_at": F.date_format("detected_at", ms)})


def clock_skew_ms() -> Column:
    """Milliseconds from the event's time to its receipt."""
    return F.expr("timestampdiff(MILLISECOND, timestamp, received_at)")


def record_key(kind: str) -> Column:
    return F.col({"events": "query_id", "errors": "query_id", "results": "query_id", "spans": "trace_id", "anomalies": "service"}[kind])


