"""Two runs of one query, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypulse.functions.columns import orderable


def newest_events(events: DataFrame) -> DataFrame:
    """The newest event of each query, with all its columns; of equal times the largest by service, latency and its other columns in order (maps as JSON)."""
    own = [c for c in events.columns if c != "query_id"]
    first = ["timestamp", "service", "latency_ms"]
    order = F.struct(*orderable(events, *first, *(c for c in own if c not in first)))
    return events.groupBy("query_id").agg(F.max_by(F.struct(*own), order).alias("e")).select("query_id", *(F.col("e")[c].alias(c) for c in own))


def documents_in_order(results: DataFrame) -> DataFrame:
    """(query_id, document_ids) by rank."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "document_id")))
    return results.groupBy("query_id").agg(F.transform(pairs, lambda x: x["document_id"]).alias("document_ids"))


def original_runs(events: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, latency_ms, result_count, status, document_ids) of each query's newest event."""
    runs = newest_events(events).join(documents_in_order(results), "query_id", "left")
    return runs.select("query_id", "latency_ms", "result_count", "status", F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"))


def diff_runs(original: DataFrame, replay: DataFrame, regression_ratio: float = 1.5) -> DataFrame:
    """One row for each query in both: latency delta and ratio, documents in common, added and removed (as sets, sorted), whether the status changed, and a verdict."""
    a = original.select("query_id", *(F.col(c).alias(f"a_{c}") for c in ("latency_ms", "result_count", "status", "document_ids")))
    b = replay.select("query_id", *(F.col(c).alias(f"b_{c}") for c in ("latency_ms", "result_count", "status", "document_ids")))
    both = a.join(b, "query_id")
    docs = lambda fn, x, y: F.array_sort(F.array_distinct(fn(F.col(x), F.col(y))))
    out = both.select(
        "query_id", F.round(F.col("b_latency_ms") - F.col("a_latency_ms"), 6).alias("latency_delta_ms"), F.when(F.col("a_latency_ms") <= 0, 1.0).otherwise(F.col("b_latency_ms") / F.col("a_latency_ms")).alias("latency_ratio"),
        (F.col("b_result_count") - F.col("a_result_count")).alias("count_delta"), docs(F.array_intersect, "a_document_ids", "b_document_ids").alias("common"),
        docs(F.array_except, "b_document_ids", "a_document_ids").alias("added"), docs(F.array_except, "a_document_ids", "b_document_ids").alias("removed"),
        (F.col("a_status") != F.col("b_status")).alias("status_changed"), (F.col("a_status") != "ok").alias("_failed"), (F.col("b_status") != "ok").alias("_fails"),
    )
    verdict = (
        F.when(F.col("_failed") & F.col("_fails"), "still failing").when(F.col("_failed") & ~F.col("_fails"), "no longer reproducible").when(F.col("latency_ratio") >= regression_ratio, "slower")
        .when((F.size("added") > 0) | (F.size("removed") > 0), "different results").otherwise("matches")
    )
    return out.withColumn("verdict", verdict).withColumn("latency_ratio", F.round("latency_ratio", 4)).drop("_failed", "_fails")


def replay_outcomes(jobs: DataFrame, original: DataFrame, replay: DataFrame, regression_ratio: float = 1.5) -> DataFrame:
    """(id, query_id, state, verdict, error): a job succeeds if both runs are there, else it fails with a reason."""
    known, there = original.select("query_id", F.lit(True).alias("_known")), replay.select("query_id", F.lit(True).alias("_there"))
    rows = jobs.join(known, "query_id", "left").join(there, "query_id", "left").join(diff_runs(original, replay, regression_ratio).select("query_id", "verdict"), "query_id", "left")
    why = F.when(F.col("_known").isNull(), "no recorded run").when(F.col("_there").isNull(), "no replay result")
    return rows.select("id", "query_id", F.when(why.isNull(), "succeeded").otherwise("failed").alias("state"), "verdict", why.alias("error"))


def safe_replay_targets(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Requests with their target: the one asked for, else the recorded service; it must be a plain service name on the allowlist (a short list of services)."""
    rows = requests.withColumn("target", F.coalesce(F.nullif(F.trim("candidate"), F.lit("")), F.col("recorded_service")))
    return rows.where(F.col("target").rlike("^[a-z][a-z0-9-]{0,62}$")).join(allowlist.select(F.col("service").alias("target")).distinct(), "target", "left_semi")
