"""Likely root causes: seven rules over assembled traces, each for all traces at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querypulse.operators.traces import is_error

# Thresholds, the order of kinds, the sentence for traces without findings.
SLOW_SHARE, SLOW_MS, RETRIES, FAN_OUT, BREACH_RATIO = 0.35, 100.0, 3, 8, 2.0
PRIORITY = ("error_span", "baseline_breach", "slow_span", "retry_storm", "missing_spans", "fan_out", "cache_miss")
UNREMARKABLE = "No span stands out: the trace looks unremarkable."


def digits(x: Column, n: int) -> Column:
    """x to n digits by the product of x and the power of ten, as SQL engines do: 257.8665 * 1000 is 257866.49999999997 and gives 257.866. Spark's own round takes the shortest decimal that names x, and so rounds it up."""
    return F.round(x * float(10**n), 0) / float(10**n)


#: A rule: when it holds for a row, and the finding it then makes.
Rule = tuple[Column, Column]
FIELDS = ("kind", "span_id", "service", "operation", "confidence", "evidence", "summary", "start_time")


def _finding(kind: str, confidence: Column, evidence: dict[str, Column], summary: Column, span_id: Column | None = None, service: Column | None = None, operation: Column | None = None, start_time: Column | None = None, of: Callable[[str], Column] = F.col) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    own = lambda c, name: (of(name) if c is None else c).alias(name)
    return F.struct(F.lit(kind).alias("kind"), own(span_id, "span_id"), own(service, "service"), own(operation, "operation"), F.round(confidence, 2).alias("confidence"), F.create_map(*pairs).alias("evidence"), summary.alias("summary"), own(start_time, "start_time"))


def _listed(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule that holds for a row. Only the rules' numbers are listed; a finding is worked out behind that, and only the fields of it that are asked for."""
    held = F.filter(F.array(*(F.when(holds, F.lit(k)) for k, (holds, _) in enumerate(rules))), lambda x: x.isNotNull())
    told = rows.withColumn("_rule", F.explode(held))
    field = lambda name: F.coalesce(*(F.when(F.col("_rule") == k, found[name]) for k, (_, found) in enumerate(rules))).alias(name)
    return told.select("trace_id", *map(field, FIELDS))


def error_span() -> Rule:
    say = F.format_string("%s %s failed with status %s", "service", "operation", "status")
    return is_error(F.col("status")), _finding("error_span", F.lit(0.95), {"status": F.col("status"), "duration_ms": digits(F.col("duration_ms"), 3), "message": F.col("attributes")["error.message"]}, say)


def slow_span(share: float = SLOW_SHARE, least_ms: float = SLOW_MS, of: Callable[[str], Column] = F.col) -> Rule:
    """A span that spends a large share of its trace (total_ms) by itself. of: gives the span's columns by name."""
    part = of("self_time_ms") / F.nullif(of("total_ms"), F.lit(0.0))
    say = F.format_string("%s %s spent %.1f ms itself", of("service"), of("operation"), of("self_time_ms"))
    found = _finding("slow_span", F.least(F.lit(0.9), 0.5 + part), {"self_time_ms": digits(of("self_time_ms"), 3), "share": digits(part, 4)}, say, of=of)
    return (of("total_ms") > 0) & (of("self_time_ms") >= least_ms) & (part >= share), found


def baseline_breach(ratio: float = BREACH_RATIO) -> Rule:
    """A span that lasts a multiple of its service's usual 95th percentile (baseline_p95)."""
    times = F.col("duration_ms") / F.nullif(F.col("baseline_p95"), F.lit(0.0))
    found = _finding("baseline_breach", F.least(F.lit(0.95), 0.55 + times / 20), {"duration_ms": digits(F.col("duration_ms"), 3), "baseline_p95": digits(F.col("baseline_p95"), 3), "ratio": digits(times, 3)}, F.format_string("%s %s took %.1f times its baseline", "service", "operation", times))
    return (F.col("baseline_p95") > 0) & (times >= ratio), found


def fan_out(least: int = FAN_OUT) -> Rule:
    return F.col("n_children") >= least, _finding("fan_out", F.lit(0.45), {"children": F.col("n_children")}, F.format_string("%s %s has %d children", "service", "operation", "n_children"))


def span_rules(slow_share: float = SLOW_SHARE, slow_ms: float = SLOW_MS, least_children: int = FAN_OUT, breach_ratio: float = BREACH_RATIO) -> list[Rule]:
    """The four rules that judge a span by itself (total_ms and baseline_p95 beside it)."""
    return [error_span(), baseline_breach(breach_ratio), slow_span(slow_share, slow_ms), fan_out(least_children)]


def storm(least: int = RETRIES) -> Rule:
    """An operation that one parent calls again and again: the service and operation are those called, the span is the parent."""
    say = F.format_string("%s %s ran %d times below one %s", "service", "operation", "n", "up_operation")
    return F.col("n") >= least, _finding("retry_storm", F.least(F.lit(0.85), 0.4 + 0.1 * F.col("n")), {"call_count": F.col("n"), "parent_operation": F.col("up_operation")}, say, F.col("up"), start_time=F.col("up_start"))


def retry_storms(tree: DataFrame, least: int = RETRIES) -> DataFrame:
    """Operations that one parent calls again and again."""
    calls = tree.where("up is not null").groupBy("trace_id", "up", "service", "operation").agg(F.count("*").alias("n"), F.max("up_operation").alias("up_operation"), F.max("up_start").alias("up_start"))
    return _listed(calls, [storm(least)])


def call_rule(least: int = RETRIES) -> Rule:
    """storm told of one of such calls."""
    again, found = storm(least)
    return F.coalesce("one_alike", F.lit(False)) & again, found


def trace_rules() -> list[Rule]:
    """The two rules that judge a trace, told of one of its spans (_first): cache misses, on the slowest of them, and spans that name a parent that is missing."""
    none = F.lit(None).cast("string")
    gone = _finding("missing_spans", F.lit(0.6), {"orphans": F.col("orphans"), "services": F.array_join("lost", ",")}, F.format_string("%d spans name a parent that is missing", "orphans"), none, F.get("lost", F.lit(0)), none, F.col("lost_start"))
    miss = _finding("cache_miss", F.lit(0.5), {"misses": F.col("misses")}, F.format_string("%d cache misses, the slowest in %s", "misses", "service"))
    return [(F.col("_first") & (F.col("orphans") > 0), gone), (F.col("_first") & (F.col("misses") > 0), miss)]


def cache_missed() -> Column:
    return F.coalesce(F.lower(F.col("attributes")["cache.hit"]) == "false", F.lit(False))


def slowest_miss() -> Column:
    """Sorts misses before hits, the longest first (NaN is longer than all, null shorter), then by start and id."""
    ms = F.col("duration_ms")
    return F.struct((~cache_missed()).alias("a"), ms.isNull().alias("b"), (~F.isnan(ms)).alias("c"), (-ms).alias("d"), F.col("start_time").isNull().alias("e"), F.col("start_time").alias("f"), F.col("span_id").alias("g"))


def judged(tree: DataFrame, baselines: DataFrame, slow_share: float = SLOW_SHARE, slow_ms: float = SLOW_MS, retries: int = RETRIES, least_children: int = FAN_OUT, breach_ratio: float = BREACH_RATIO) -> tuple[DataFrame, list[Rule]]:
    """The tree with what all seven rules need beside each span, and the rules: what a rule needs of the trace comes from windows within the trace. baselines: (service, baseline_p95), a row for each service; they are broadcast."""
    trace = Window.partitionBy("trace_id")
    missed, lost, order, start, ms = cache_missed(), F.col("parent_state") == "orphan", slowest_miss(), F.unix_micros("start_time") / 1000.0, F.col("duration_ms")
    rows = tree.withColumns({
        "total_ms": F.round(F.max(start + ms).over(trace) - F.min(start).over(trace), 3), "misses": F.count_if(missed).over(trace), "orphans": F.count_if(lost).over(trace),
        "lost": F.sort_array(F.collect_set(F.when(lost, F.col("service"))).over(trace)), "lost_start": F.min(F.when(lost, F.col("start_time"))).over(trace),
        "_first": F.min(order).over(trace)["g"] == F.col("span_id"),
    })
    rows = rows.withColumnRenamed("n_alike", "n").join(F.broadcast(baselines.select("service", "baseline_p95")), "service", "left")
    rules = [*span_rules(slow_share, slow_ms, least_children, breach_ratio), call_rule(retries), *trace_rules()]
    return rows, [(~F.col("cyclic") & holds, found) for holds, found in rules]


def findings(tree: DataFrame, baselines: DataFrame, slow_share: float = SLOW_SHARE, slow_ms: float = SLOW_MS, retries: int = RETRIES, least_children: int = FAN_OUT, breach_ratio: float = BREACH_RATIO) -> DataFrame:
    """All seven rules over traces that are not corrupt, in one scan of the tree."""
    return _listed(*judged(tree.where("not cyclic"), baselines, slow_share, slow_ms, retries, least_children, breach_ratio))


def rank_findings(found: DataFrame) -> DataFrame:
    """Adds rank within the trace: by kind, then confidence, then the spans' order."""
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    by = Window.partitionBy("trace_id").orderBy(order, F.desc("confidence"), "start_time", "span_id", "summary")
    return found.withColumn("rank", F.row_number().over(by))


def summarise(tree: DataFrame, ranked: DataFrame) -> DataFrame:
    """(trace_id, summary): the first finding, or the fixed sentence."""
    first = ranked.where("rank = 1").select("trace_id", F.col("summary").alias("_s"))
    return tree.select("trace_id").distinct().join(first, "trace_id", "left").select("trace_id", F.coalesce("_s", F.lit(UNREMARKABLE)).alias("summary"))


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("findings"))


#: Sums of self times.
TOTAL = "decimal(38,6)"


def most_spent(spent: Column) -> Column:
    """Of (service, ms) sorted by service the service of the largest sum of ms, of equal ones the first: (o, service, ms). One pass, and a sum of nulls alone is null."""
    none = lambda c: F.lit(None).cast(c)
    best = lambda a: F.least(a["best"], F.when(a["any"], F.struct((-a["ms"]).cast(TOTAL).alias("o"), a["service"].alias("service"), a["ms"].alias("ms"))))

    def add(a: Column, x: Column) -> Column:
        more = a["any"] & a["service"].eqNullSafe(x["service"])
        both = F.coalesce((a["ms"] + x["ms"]).cast(TOTAL), a["ms"], x["ms"])
        return F.struct(F.lit(True).alias("any"), x["service"].alias("service"), F.when(more, both).otherwise(x["ms"]).alias("ms"), F.when(more, a["best"]).otherwise(best(a)).alias("best"))

    start = F.struct(F.lit(False).alias("any"), none("string").alias("service"), none(TOTAL).alias("ms"), none(f"struct<o: {TOTAL}, service: string, ms: {TOTAL}>").alias("best"))
    return F.aggregate(spent, start, add, best)


def debug_bundle(events: DataFrame, tree: DataFrame, baselines: DataFrame, query_id: str | None = None, slow_share: float = SLOW_SHARE, slow_ms: float = SLOW_MS, retries: int = RETRIES, least_children: int = FAN_OUT, breach_ratio: float = BREACH_RATIO) -> DataFrame:
    """A row for each query that has an event or spans: its newest event, summary, findings with evidence by rank, hotspot, trace as JSON and baseline. An unknown query gives no row. The limits are those of the rules (see judged).

    Findings, hotspot and JSON of a trace are one aggregate of its rows where they lie; what is judged by the trace, slow spans too, is judged behind it, so that no window is needed. Events and ids of traces are brought there, so that no text is dealt out.
    """
    from querypulse.operators.replay import newest_events
    from querypulse.operators.traces import opened_span, self_time, summary_columns, trace_text

    own = F.lit(True) if query_id is None else F.coalesce(F.col("query_id") == F.lit(query_id), F.lit(False))
    start, lost = F.unix_micros("start_time") / 1000.0, F.col("parent_state") == "orphan"
    rows = tree.withColumnRenamed("n_alike", "n").join(F.broadcast(baselines.select("service", "baseline_p95")), "service", "left")
    by_span = [(~F.col("cyclic") & holds, found) for holds, found in (error_span(), baseline_breach(breach_ratio), fan_out(least_children), call_rule(retries))]
    saying = lambda f: F.struct(
        F.array_position(F.array(*map(F.lit, PRIORITY)), f["kind"]).alias("order"), (-f["confidence"]).alias("less"), f["start_time"].alias("start_time"), f["span_id"].alias("span_id"), f["summary"].alias("said"),
        f["kind"].alias("kind"), f["service"].alias("service"), f["confidence"].alias("confidence"), F.map_entries(f["evidence"]).alias("evidence"))
    sayings = lambda rules: F.filter(F.array(*(F.when(holds, saying(f)) for holds, f in rules)), lambda x: x.isNotNull())
    any_holds = lambda rules: reduce(Column.__or__, (F.coalesce(holds, F.lit(False)) for holds, _ in rules))
    # worked out before the aggregate, which would evaluate it by the row and field
    rows = rows.select(
        "trace_id", F.when(any_holds(by_span), sayings(by_span)).alias("_said"), F.when(own, F.struct("service", self_time().cast(TOTAL).alias("ms"))).alias("_spent"), F.when(own, opened_span()).alias("_opened"),
        F.when(~F.col("cyclic") & (F.col("self_time_ms") >= slow_ms), F.struct("span_id", "service", "operation", "start_time", "self_time_ms")).alias("_slow"),
        cache_missed().alias("_missed"), lost.alias("_lost"), F.when(cache_missed(), F.struct(slowest_miss().alias("o"), "service", "operation")).alias("_miss"),
        "service", "start_time", "duration_ms", "parent_state", "cyclic", *(["query_id"] if query_id is not None else []),
    )
    told = rows.groupBy("trace_id").agg(
        F.flatten(F.collect_list("_said")).alias("_said"), F.sort_array(F.collect_list("_spent")).alias("spent"), F.sort_array(F.collect_list("_opened")).alias("s"), F.collect_list("_slow").alias("slow"),
        F.count_if("_missed").alias("misses"), F.count_if("_lost").alias("orphans"), F.sort_array(F.collect_set(F.when(F.col("_lost"), F.col("service")))).alias("lost"), F.min(F.when(F.col("_lost"), F.col("start_time"))).alias("lost_start"),
        F.min("_miss").alias("first"), F.round(F.max(start + F.col("duration_ms")) - F.min(start), 3).alias("whole_ms"), *summary_columns(own), (~F.max("cyclic")).alias("_first"),
    )
    # the rules of traces are told of the slowest miss
    whole = told.select("*", "first.service", "first.operation", F.col("first.o.f").alias("start_time"), F.col("first.o.g").alias("span_id"))

    def slow(x: Column) -> Column:
        holds, found = slow_span(slow_share, slow_ms, lambda c: F.col("whole_ms") if c == "total_ms" else x[c])
        return F.when(holds, saying(found))

    more = [F.when(F.size("slow") > 0, F.filter(F.transform("slow", slow), lambda x: x.isNotNull())), F.when(any_holds(trace_rules()), sayings(trace_rules()))]
    none = F.array().cast(rows.schema["_said"].dataType)
    whole = whole.withColumns({"said": F.concat("_said", *(F.coalesce(x, none) for x in more)), "hot": most_spent(F.col("spent"))})
    fields = ("kind", "service", "span_id", "confidence", "said", "evidence")
    told = whole.select(
        F.col("trace_id").alias("_key"), F.col("hot.service").alias("hotspot"), F.round("hot.ms", 3).cast("double").alias("hotspot_ms"), F.when(~F.col("cyclic"), trace_text()).alias("trace"),
        F.when(F.size("said") > 0, F.transform(F.sort_array("said"), lambda x, i: F.struct((i + 1).alias("rank"), *(x[c].alias(c) for c in fields)))).alias("findings"),
    )
    ids = tree.where(own).groupBy("query_id", "trace_id").agg(F.count("*").alias("spans"), F.max("cyclic").alias("cyclic"))
    newest = newest_events(events.where(own)).select("query_id", "service", "status", "latency_ms")
    # an event without a trace has a key of its own, so that such events are dealt out evenly; what a key like it might find is left out
    queries = newest.join(ids, "query_id", "full").withColumn("_key", F.coalesce("trace_id", F.concat(F.lit("-"), "query_id")))
    joined = queries.hint("shuffle_hash").join(told, "_key", "left").join(F.broadcast(baselines.select("service", "baseline_p95")), "service", "left")
    of = lambda c: F.when(F.col("trace_id").isNotNull(), F.col(c))
    found = of("findings")
    kinds = F.coalesce(F.transform(found, lambda x: x["kind"]), F.array().cast("array<string>"))
    summary = F.coalesce(F.get(found, F.lit(0))["said"], F.lit(UNREMARKABLE))
    return joined.select("query_id", "service", "status", "latency_ms", "trace_id", "spans", "cyclic", *(of(c).alias(c) for c in ("hotspot", "hotspot_ms")), summary.alias("summary"), kinds.alias("kinds"), found.alias("findings"), of("trace").alias("trace"), "baseline_p95")
