"""Record types, limits and stored tables of search telemetry."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


RESULT = struct(document_id=S, rank=I, score=D, title=S)
#: On the wire a timestamp is text, so that a missing zone can be told.
SEARCH_EVENT = struct(
    event_id=S, query_id=S, trace_id=S, span_id=S, service=S, query=S, index=S, timestamp=S, latency_ms=D, status=S, result_count=I, relevance_score=D,
    results=T.ArrayType(RESULT), cache_hit=B, user_id=S, session_id=S, error_type=S, error_message=S, metadata=T.MapType(S, S),
)
SPAN = struct(trace_id=S, span_id=S, parent_span_id=S, query_id=S, service=S, operation=S, start_time=S, duration_ms=D, status=S, attributes=T.MapType(S, S))
ANOMALY = struct(anomaly_id=S, service=S, metric=S, severity=S, observed=D, baseline_mean=D, baseline_stddev=D, z_score=D, window_start=TS, window_end=TS, sample_count=L, detected_at=TS)
RESULTS_RECORD = struct(query_id=S, service=S, timestamp=S, results=T.ArrayType(RESULT))

# Limits of valid records, states, severities, topics, days that tables are kept, watched metrics, service objectives.
MAX_LATENCY_MS = 600_000.0
MAX_BATCH = 500
LENGTHS = {"query_id": (1, 128), "trace_id": (0, 64), "span_id": (0, 32), "service": (1, 64), "query": (1, 1024), "index": (0, 64), "user_id": (0, 128), "session_id": (0, 128), "error_type": (0, 128), "error_message": (0, 2048)}
STATUSES = ("ok", "error", "timeout", "rejected")
SEVERITIES = ("info", "warning", "critical")
TOPICS = ("events", "results", "errors", "anomalies", "spans")
KEEP_DAYS = {"events": 90, "query_results": 30, "metric_rollups": 365, "anomalies": 365, "spans": 7}
TIME_COLUMN = {"events": "timestamp", "query_results": "timestamp", "metric_rollups": "window_start", "anomalies": "window_start", "spans": "start_time"}
SORT_KEYS = {"events": ("service", "timestamp", "query_id"), "query_results": ("query_id", "rank"), "metric_rollups": ("service", "window_start"), "anomalies": ("service", "metric", "window_start"), "spans": ("trace_id", "start_time")}
VERSIONED = {"metric_rollups": (("service", "window_start"), "inserted_at"), "anomalies": (("service", "metric", "window_start"), "detected_at")}
WATCHED = ("latency_p95", "latency_p99", "error_rate", "query_count")
OBJECTIVES = (("svc-0", 2000.0, 0.01), ("svc-1", 1500.0, 0.005), ("svc-2", 3000.0, 0.01), ("svc-3", 500.0, 0.02))
