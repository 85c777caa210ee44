"""Traces from spans, all at once: a row for each span with its place in its tree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spans of a task.
MOST_SPANS = 250_000


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares. Where it is unset, a scratch folder in local mode; else an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/spark-{uuid.uuid4().hex[:10]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that rounds keep a short lineage and survive lost executors."""
    path = shared_folder(df.sparkSession, "traces")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_error(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin("ok", "unset", "")


def unique_spans(spans: DataFrame) -> DataFrame:
    """Of spans with equal (trace_id, span_id) the one that starts last."""
    by = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("start_time"), F.desc("duration_ms"), F.desc("operation"))
    return spans.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def named(parent: Column) -> Column:
    return F.coalesce(parent, F.lit("")) != ""


def link_parents(spans: DataFrame) -> DataFrame:
    """Adds parent_state: root (no parent named), child (the parent is there) or orphan (it is not; the span is a further root), up, the parent that is there, its up_start, up_operation and up_named (it names a parent itself), child_ms and n_children.

    Each span stands twice among its trace's rows, under its own id and under its parent's, so that windows within the trace take the place of joins: rows dealt out by trace stay where they are.
    """
    sides = F.array(F.struct(F.lit(True).alias("own"), F.col("span_id").alias("k")), F.when(named(F.col("parent_span_id")), F.struct(F.lit(False).alias("own"), F.col("parent_span_id").alias("k"))))
    rows = spans.withColumn("_side", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    own = F.col("_own")
    rows = rows.select("trace_id", "span_id", F.col("_side.own").alias("_own"), F.col("_side.k").alias("_k"), F.col("duration_ms").alias("_ms"), *(F.when(F.col("_side.own"), F.col(c)).alias(c) for c in spans.columns if c not in ("trace_id", "span_id")))
    meet = Window.partitionBy("trace_id", "_k")
    met = rows.withColumns({
        "_up": F.max(F.when(own, F.col("span_id"))).over(meet), "_start": F.max("start_time").over(meet), "_operation": F.max("operation").over(meet), "_named": F.max(named(F.col("parent_span_id"))).over(meet),
        "child_ms": F.sum(F.when(~own, F.col("_ms"))).over(meet), "n_children": F.count_if(~own).over(meet),
    })
    span, above = Window.partitionBy("trace_id", "span_id"), lambda c: F.when(~own, F.col(c))
    told = met.withColumns({"up": F.max(above("_up")).over(span), "up_start": F.max(above("_start")).over(span), "up_operation": F.max(above("_operation")).over(span), "up_named": F.coalesce(F.max(above("_named")).over(span), F.lit(False))})
    told = told.where("_own").drop("_own", "_k", "_ms", "_up", "_start", "_operation", "_named")
    return told.withColumn("parent_state", F.when(~named(F.col("parent_span_id")), "root").when(F.col("up").isNull(), "orphan").otherwise("child"))


def link_shallow(spans: DataFrame) -> DataFrame:
    """What link_parents and with_calls add, for spans of different ids that name none but roots as parents: each stands once, under its parent's id or, a root, under its own, and one sort and one window serve all."""
    child = named(F.col("parent_span_id"))
    rows = spans.withColumns({"_child": child, "_k": F.when(child, F.col("parent_span_id")).otherwise(F.col("span_id"))})
    by = Window.partitionBy("trace_id", "_k").orderBy("_child", "service", "operation")
    meet, calls = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rangeBetween(Window.currentRow, Window.currentRow)
    above = lambda c: F.when(F.col("_child"), F.max(F.when(~F.col("_child"), F.col(c))).over(meet))
    told = rows.withColumns({
        "up": above("span_id"), "up_start": above("start_time"), "up_operation": above("operation"), "up_named": F.lit(False),
        "child_ms": F.when(~F.col("_child"), F.sum(F.when(F.col("_child"), F.col("duration_ms"))).over(meet)), "n_children": F.when(F.col("_child"), F.lit(0)).otherwise(F.count_if("_child").over(meet)),
        "n_alike": F.count("*").over(calls), "one_alike": F.min("span_id").over(calls) == F.col("span_id"),
    })
    below = lambda c: F.when(F.col("up").isNotNull(), F.col(c))
    state = F.when(~F.col("_child"), "root").when(F.col("up").isNull(), "orphan").otherwise("child")
    return told.withColumns({"parent_state": state, "n_alike": below("n_alike"), "one_alike": below("one_alike")}).drop("_child", "_k")


def with_calls(tree: DataFrame) -> DataFrame:
    """Adds n_alike, how many spans of its service and operation a span's parent has, and one_alike, true for a single one of them (the least id); both null without a parent."""
    calls = Window.partitionBy("trace_id", "up", "service", "operation").orderBy("span_id")
    below = lambda c: F.when(F.col("up").isNotNull(), c)
    return tree.withColumns({"n_alike": below(F.count("*").over(calls.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "one_alike": below(F.row_number().over(calls) == 1)})


def shapes(spans: DataFrame) -> tuple[bool, bool, int]:
    """Whether a span that is named as a parent may name a parent itself, whether an id may stand twice in its trace, and the number of spans. Ids are compared by 64 bits: a chance hit only means that traces are looked at closely."""
    there = spans.where("trace_id is not null and span_id is not null")
    child = named(F.col("parent_span_id"))
    side = lambda c, own, child, above: F.struct(F.xxhash64("trace_id", c).alias("k"), F.lit(own).alias("own"), child.alias("child"), F.lit(above).alias("above"))
    sides = F.array(side("span_id", 1, child, False), F.when(child, side("parent_span_id", 0, F.lit(False), True)))
    # in one reading, as spans may be made anew at each
    ids = there.select(F.explode(sides).alias("i")).where("i is not null").select("i.*").groupBy("k").agg(F.sum("own").alias("own"), F.max("child").alias("child"), F.max("above").alias("above"))
    deep, repeated, n = ids.agg(F.max(F.col("child") & F.col("above")), F.max(F.col("own") > 1), F.sum("own")).first()
    return bool(deep), bool(repeated), n or 0


def dealt(spans: DataFrame, n: int) -> DataFrame:
    """n spans dealt out by trace, at most some MOST_SPANS to a task: with their texts, which are gathered by trace, they then stay in its memory."""
    parts = -(-n // MOST_SPANS)
    return spans.repartition(parts, "trace_id") if parts > spans.sparkSession.sparkContext.defaultParallelism else spans.repartition("trace_id")


def ranked_chains(base: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(trace_id, span_id, ancestor, depth, root, on_critical_path, preorder) from base (trace_id, span_id, up, start, _heavy).

    Chains of parents are ranked by pointer doubling: in round k a span looks up the one that stands 2^k above it, adds that one's numbers to its own and takes over its pointer. The
    first pass of rounds gives depth and root, and, downwards, the number of spans below each: those of fewer than 2^k steps, and those below each span 2^k steps down. With these sizes a
    span's weight is the spans that a preorder walk meets between its parent and itself, and a second pass over the same pointers sums the weights up to the root: its preorder number.
    A row is a few numbers whatever the depth, and the rounds are as many as the logarithm of the depth, not of the size, of the deepest trace.

    Spans that hang on a circle keep an ancestor.
    """
    now = base.select("trace_id", "span_id", F.col("up").alias("ancestor"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("_heavy").alias("on_critical_path"), F.coalesce("up", "span_id").alias("root"), F.lit(1).cast("long").alias("size"))
    rounds, now, waiting = [], checkpointed(now), None
    for _ in range(most_rounds):
        # with a deeper span there is one of every depth above it, so only circles leave the number as it was
        waiting, before = now.where("ancestor is not null").count(), waiting
        if waiting in (0, before):
            break
        rounds.append(now)
        above = now.select("trace_id", F.col("span_id").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"), F.col("on_critical_path").alias("_c"), F.col("root").alias("_root"))
        moved = now.where("ancestor is not null").join(above, ["trace_id", "ancestor"]).select(
            "trace_id", "span_id", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("on_critical_path") & F.col("_c")).alias("on_critical_path"), F.col("_root").alias("root"), "size",
        )
        more = now.where("ancestor is not null").groupBy("trace_id", F.col("ancestor").alias("span_id")).agg(F.sum("size").alias("_more"))
        now = checkpointed(now.where("ancestor is null").unionByName(moved).join(more, ["trace_id", "span_id"], "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more"))
    # spans before a span of the same parent, or roots before a root, with all below them
    placed = base.select("trace_id", "span_id", "up", "start").join(now.select("trace_id", "span_id", "ancestor", "depth", "root", "on_critical_path", "size"), ["trace_id", "span_id"])
    row = Window.partitionBy("trace_id", "up").orderBy("start", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.coalesce(F.sum("size").over(row), F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)
    placed = checkpointed(placed.withColumn("preorder", weight).drop("up", "start", "size"))
    sums = placed.select("trace_id", "span_id", "preorder")
    for pointers in rounds:
        steps = pointers.where("ancestor is not null").select("trace_id", "span_id", "ancestor")
        more = steps.join(sums.select("trace_id", F.col("span_id").alias("ancestor"), F.col("preorder").alias("_more")), ["trace_id", "ancestor"]).select("trace_id", "span_id", "_more")
        sums = checkpointed(sums.join(more, ["trace_id", "span_id"], "left").select("trace_id", "span_id", (F.col("preorder") + F.coalesce("_more", F.lit(0))).alias("preorder")))
    return placed.drop("preorder").join(sums, ["trace_id", "span_id"])


def assemble_traces(spans: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Every span with parent_state, depth, root, preorder (its number in a walk of its trace: siblings and roots by start, then id), place (what sorts a trace's spans by preorder, without a window), on_critical_path, self_time_ms, n_children, n_alike, one_alike (see with_calls) and cyclic (of its trace).

    Spans are dealt out by trace once. Where no id is repeated and no trace is deeper than roots and children, they are linked in one sort. Traces of roots and their children are ranked where they lie. In others depth, root and preorder come from ranked_chains; spans that never reach a
    root hang on a circle; their trace is flagged, its spans have null depths, and no span of it a preorder.
    """
    whole = Window.partitionBy("trace_id")
    heavy = Window.partitionBy("trace_id", "up").orderBy(F.desc("duration_ms"), "start_time", "span_id")
    deep, repeated, n = shapes(spans)
    rows = dealt(spans.where("trace_id is not null and span_id is not null"), n)
    plain = not deep and not repeated
    linked = link_shallow(rows) if plain else link_parents(unique_spans(rows))
    full = linked.withColumns({"_heavy": F.row_number().over(heavy) == 1, "_deep": F.max("up_named").over(whole) if deep else F.lit(False)})
    full = full.withColumn("self_time_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("child_ms", F.lit(0.0)))).drop("child_ms", "up_named")

    rootless = F.when(F.col("up").isNull(), 0).otherwise(1)
    top = Window.partitionBy("trace_id").orderBy(rootless, F.desc("duration_ms"), "start_time", "span_id")
    first = F.first("span_id").over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    root = F.coalesce("up", "span_id")
    top_start = F.when(F.col("up").isNull(), F.col("start_time")).otherwise(F.col("up_start"))
    walk = Window.partitionBy("trace_id").orderBy(top_start, "root", "depth", "start_time", "span_id")
    flat = full.where(~F.col("_deep")).withColumns({"depth": rootless, "root": root, "cyclic": F.lit(False), "on_critical_path": F.col("_heavy") & (root == first)})
    place = F.struct(F.unix_micros(top_start).alias("a"), F.col("root").alias("b"), F.col("depth").alias("c"), F.col("start_time").alias("d"), F.col("span_id").alias("e"))
    flat = flat.withColumns({"preorder": F.row_number().over(walk).cast("long") - 1, "place": place}).drop("_heavy", "_deep")
    if not deep:
        return flat if plain else with_calls(flat)

    base = checkpointed(full.where("_deep").drop("_deep"))
    ranks = ranked_chains(base.select("trace_id", "span_id", "up", F.unix_micros("start_time").alias("start"), "_heavy"), most_rounds)
    tree = base.drop("_heavy").join(ranks, ["trace_id", "span_id"])
    lost = F.col("ancestor").isNotNull()
    marked = tree.withColumns({"cyclic": F.max(lost).over(whole), "_top": first})
    marked = marked.withColumn("on_critical_path", ~lost & F.col("on_critical_path") & (F.col("root") == F.col("_top")))
    marked = marked.withColumns({"depth": F.when(~lost, F.col("depth")), "root": F.when(~lost, F.col("root")), "preorder": F.when(~F.col("cyclic"), F.col("preorder"))})
    none = lambda c: F.lit(None).cast(c)
    marked = marked.withColumn("place", F.struct(F.col("preorder").alias("a"), none("string").alias("b"), none("int").alias("c"), none("timestamp").alias("d"), none("string").alias("e")))
    return with_calls(flat.unionByName(marked.drop("ancestor", "_top")))


def critical_path(tree: DataFrame) -> DataFrame:
    """From the longest root always the longest child, first by start of equal ones."""
    return tree.where("on_critical_path").select("trace_id", "depth", "span_id", "service", "operation", "duration_ms")


def summary_columns(own: Column | None = None) -> list[Column]:
    """Aggregates of a trace, or of those of its spans for which own holds."""
    start = F.unix_micros("start_time") / 1000.0
    of = lambda c: c if own is None else F.when(own, c)
    return [
        F.count(of(F.lit(1))).alias("span_count"), F.count_if(of(F.col("parent_state") == "orphan")).alias("orphan_count"), F.sort_array(F.collect_set(of(F.col("service")))).alias("services"),
        F.round(F.max(of(start + F.col("duration_ms"))) - F.min(of(start)), 3).alias("total_ms"), F.max(of(F.col("cyclic"))).alias("cyclic"),
    ]


def trace_summary(tree: DataFrame) -> DataFrame:
    """span_count, orphan_count, services, total_ms (first start to last end, 3 digits) and whether the trace is corrupt."""
    return tree.groupBy("trace_id").agg(*summary_columns())


def self_time() -> Column:
    """Self time as a decimal, so that no order of rows matters to a sum."""
    return F.col("self_time_ms").cast("decimal(28,6)")


def slowest_service(tree: DataFrame) -> DataFrame:
    """Of each trace the service of the most self time; of equal ones the first by name. Times are summed as decimals, so that no order of rows matters."""
    sums = tree.groupBy("trace_id", "service").agg(F.sum(self_time()).alias("ms"))
    best = sums.groupBy("trace_id").agg(F.min(F.struct((-F.col("ms")).alias("o"), "service", "ms")).alias("b"))
    return best.select("trace_id", F.col("b.service").alias("service"), F.round("b.ms", 3).cast("double").alias("self_time_ms"))


def waterfall(tree: DataFrame) -> DataFrame:
    """Offset and width of each span in percent of its trace (1 ms at least), width 0.5 at least."""
    by = Window.partitionBy("trace_id")
    start = F.unix_micros("start_time") / 1000.0
    first, total = F.min(start).over(by), F.greatest(F.lit(1.0), F.max(start + F.col("duration_ms")).over(by) - F.min(start).over(by))
    return tree.select("trace_id", "span_id", "depth", "service", "operation", ((start - first) / total * 100).alias("offset_pct"), F.greatest(F.lit(0.5), F.col("duration_ms") / total * 100).alias("width_pct"), "on_critical_path")


def unclosed(text: Column) -> Column:
    """JSON without its last character, a single byte: cut as bytes, as characters would be counted one by one."""
    return F.substring(text.cast("binary"), F.lit(1), F.octet_length(text) - 1).cast("string")


def opened_span() -> Column:
    """A span's place and its JSON up to its children."""
    own = F.to_json(F.struct("span_id", "parent_span_id", "service", "operation", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"), "duration_ms", F.round("self_time_ms", 3).alias("self_time_ms"), "status", "depth", (F.col("parent_state") == "orphan").alias("orphaned"), "attributes"), {"ignoreNullFields": "false"})
    return F.struct("place", "depth", F.concat(unclosed(own), F.lit(',"children":[')).alias("opened"))


def trace_text() -> Column:
    """A trace's JSON from s, its opened spans in preorder, and its summary columns. The depths of neighbours tell how many open spans end between them."""

    def placed(x: Column, k: Column) -> Column:
        last, following = F.get("s", k - 1)["depth"], F.coalesce(F.get("s", k + 1)["depth"], F.lit(0))
        return F.concat(F.when(x["depth"] <= last, ",").otherwise(""), x["opened"], F.repeat(F.lit("]}"), x["depth"] - following + 1))

    head = F.to_json(F.struct("trace_id", "span_count", "orphan_count", F.col("total_ms").alias("total_duration_ms"), "services"))
    return F.concat(unclosed(head), F.lit(',"roots":['), F.array_join(F.transform("s", placed), ""), F.lit("]}"))


def trace_json(tree: DataFrame) -> DataFrame:
    """(trace_id, trace): each trace as JSON, its spans nested as children in the order of their starts. Corrupt traces have none. A trace is one row, as long as its spans together."""
    rows = tree.where("not cyclic").groupBy("trace_id").agg(F.sort_array(F.collect_list(opened_span())).alias("s"), *summary_columns())
    return rows.select("trace_id", trace_text().alias("trace"))


def spans_for_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == F.lit(trace_id)).orderBy("start_time", "span_id")


def spans_for_query(spans: DataFrame, query_id: str) -> DataFrame:
    return spans.where(F.col("query_id") == F.lit(query_id)).orderBy("start_time", "span_id")
