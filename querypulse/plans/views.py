"""Telemetry as views of the given tables: events as search events, orders and lines as spans, conversations as deep traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("e-"), "event_id").alias("event_id"), F.concat(F.lit("q-"), "event_id").alias("query_id"), F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("latency_ms"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "Upstream").alias("error_type"), (F.col("event_type") == "view").alias("cache_hit"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("double") / 100).alias("relevance_score"), F.get_json_object("props", "$.k").cast("int").alias("result_count"),
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a number that is unique in their order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(by))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roots, every tenth missing, their lines as children a millisecond apart."""
    text = lambda p, *c: F.concat(F.lit(p), *c)
    orders = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    attributes = lambda hit, why: F.create_map(F.lit("cache.hit"), hit, F.lit("error.message"), why)
    key = F.col("o_orderkey").cast("string")
    start = F.col("o_orderdate").cast("timestamp")
    roots = orders.where("o_orderkey % 10 <> 0").select(text("t-", key).alias("trace_id"), text("o-", key).alias("span_id"), none.alias("parent_span_id"), text("q-", key).alias("query_id"), F.lit("gateway").alias("service"), F.lit("order").alias("operation"), start.alias("start_time"), (F.col("o_totalprice") / 1000).alias("duration_ms"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), attributes(F.lit("true"), F.lit("failed")).alias("attributes"))
    lines = numbered_lines(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), start.alias("_at")), "l_orderkey")
    key = F.col("l_orderkey").cast("string")
    at = F.timestamp_micros(F.unix_micros("_at") + 1000 * F.col("rn"))
    kids = lines.select(text("t-", key).alias("trace_id"), text("l-", key, F.lit("-"), F.col("rn").cast("string")).alias("span_id"), text("o-", key).alias("parent_span_id"), text("q-", key).alias("query_id"), F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("operation"), at.alias("start_time"), (F.col("l_extendedprice") / 1000).alias("duration_ms"), F.lit("ok").alias("status"), attributes(F.when(F.col("l_discount") >= 0.09, "false").otherwise("true"), none).alias("attributes"))
    return roots.unionByName(kids)


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans under the turn before."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return c.select(
        F.col("conv_id").cast("string").alias("trace_id"), turn.cast("string").alias("span_id"), F.when(turn > 0, (turn - 1).cast("string")).alias("parent_span_id"), F.concat(F.lit("q-"), F.col("conv_id").cast("string")).alias("query_id"),
        F.col("role").alias("service"), F.lit("turn").alias("operation"), F.timestamp_seconds(1_700_000_000 + turn).alias("start_time"), F.length("text").cast("double").alias("duration_ms"), F.lit("ok").alias("status"), F.create_map(F.lit("cache.hit"), F.lit("true")).alias("attributes"),
    )


def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).select(F.concat(F.lit("q-"), F.col("l_orderkey").cast("string")).alias("query_id"), F.col("l_partkey").cast("string").alias("document_id"), F.col("rn").alias("rank"))


def order_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and last order of each customer as two runs of one query."""
    docs = query_results(spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("document_ids"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("q-"), F.col("o_orderkey").cast("string")).alias("query_id"), (F.col("o_totalprice") / 1000).alias("latency_ms"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))
    picked = o.groupBy("o_custkey").agg(F.min_by(F.struct("query_id", "latency_ms", "status"), "o_orderkey").alias("a"), F.max_by(F.struct("query_id", "latency_ms", "status"), "o_orderkey").alias("b"))

    def run(c: str) -> DataFrame:
        rows = picked.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("name"), f"{c}.*").join(docs, "query_id", "left")
        ids = F.coalesce("document_ids", F.array().cast("array<string>"))
        return rows.select(F.col("name").alias("query_id"), "latency_ms", "status", ids.alias("document_ids"), F.size(ids).alias("result_count"))

    return run("a"), run("b")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events so far by service and status at each hour that has some."""
    e = search_events(spark, sf_dir).groupBy("service", "status", F.date_trunc("hour", "timestamp").alias("ts")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("service", "status").orderBy("ts"))
    return e.select(F.lit("requests").alias("metric"), F.create_map(F.lit("service"), F.col("service"), F.lit("status"), F.col("status")).alias("labels"), "ts", total.cast("double").alias("value"))


def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts of latencies by day, service and upper bound."""
    bounds = [50.0, 100.0, 200.0, 300.0, 400.0, float("inf")]
    e = search_events(spark, sf_dir).withColumn("ts", F.date_trunc("day", "timestamp"))
    counts = e.groupBy("ts", "service").agg(*(F.count_if(F.col("latency_ms") <= b).alias(str(k)) for k, b in enumerate(bounds)))
    return counts.select("ts", "service", F.posexplode(F.array(*(F.col(str(k)) for k in range(len(bounds))))).alias("k", "c")).select("ts", "service", F.element_at(F.array(*map(F.lit, bounds)), F.col("k") + 1).alias("le"), F.col("c").cast("double").alias("cumulative"))


def platform_samples(spark: SparkSession, sf_dir: str, seconds: int = 300) -> DataFrame:
    """Events as samples of the platform's own counters and gauges, one for each series and run of seconds in which it has events, at that run's end."""
    e = table(spark, sf_dir, "events").select(
        ((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) + 1) * seconds).alias("t"), "event_type", (F.col("event_type") == "error").alias("bad"), F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("svc"),
        (F.col("user_id") % 4).alias("u"), F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    labels = lambda **x: F.create_map(*(y for k, v in x.items() for y in (F.lit(k), v))) if x else F.create_map().cast("map<string,string>")
    one = lambda metric, n, **x: F.struct(F.lit(metric).alias("metric"), labels(**x).alias("labels"), n.cast("double").alias("n"))
    job = F.element_at(F.array(*map(F.lit, ("telemetry-collector", "metrics-engine", "debug-service", "api-gateway"))), (F.col("u") + 1).cast("int"))
    counters = [
        one("collector_events_ingested_total", F.lit(1000), status=F.when(F.col("event_type") == "signup", "rejected").otherwise("accepted")),
        F.when(F.col("event_type") == "click", one("engine_events_processed_total", F.lit(1000))), one("gateway_requests_total", F.lit(1), endpoint=F.col("svc"), status=F.when(F.col("bad"), "500").otherwise("200")),
        *(one("gateway_query_duration_seconds_bucket", (F.col("value") <= 100 * b).cast("int"), le=F.lit(n)) for n, b in (("1", 1.0), ("2.5", 2.5), ("4", 4.0), ("+Inf", 1e9))),
        one("engine_events_invalid_total", F.col("k"), kind=F.col("event_type")), F.when(F.col("bad"), one("engine_anomalies_detected_total", F.lit(20))), one("collector_rate_limited_total", F.floor("value") * 10, client=F.col("svc")),
    ]
    rows = e.select("t", F.explode(F.filter(F.array(*counters), lambda x: x.isNotNull())).alias("c")).select("t", "c.*")
    counts = rows.groupBy("metric", F.to_json("labels").alias("s"), "t").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("value", F.sum("n").over(Window.partitionBy("metric", "s").orderBy("t"))).drop("n")
    gauges = e.groupBy("t", (F.col("u") % 2).cast("string").alias("p")).agg((F.sum("k") * 200).cast("double").alias("value")).select(F.lit("kafka_consumergroup_lag").alias("metric"), F.to_json(labels(consumergroup=F.lit("metrics-engine"), partition=F.col("p"))).alias("s"), "t", "value")
    up = e.groupBy("t", job.alias("job")).agg((1 - F.max(F.col("bad").cast("int"))).cast("double").alias("value")).select(F.lit("up").alias("metric"), F.to_json(labels(job=F.col("job"))).alias("s"), "t", "value")
    return counts.unionByName(gauges).unionByName(up).select("metric", F.from_json("s", "map<string,string>").alias("labels"), F.timestamp_seconds("t").alias("ts"), "value")
