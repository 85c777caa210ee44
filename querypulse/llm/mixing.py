"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares are raised to an exponent between 1 (as they are) and 0 (all alike) and normalised. Bisection finds the largest exponent whose weights have the target
entropy, then, if some source would be repeated too often, the smallest one that keeps to the limit. The weights are realised by passes over blocks of
documents: every pass over a source takes its blocks in another order, until the source's part of the budget is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shipping import stored

STEPS = 60
#: So many sources' numbers are broadcast (about 100 bytes each); more are joined.
BROADCAST_SOURCES = 100_000


def words_by_blanks(text: Column) -> Column:
    """A cheap count of tokens: blanks and line ends, and one; 0 for null and empty texts."""
    t = text.cast("string")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " \n", "")) + 1).cast("long")


def draw(modulus: Column, *parts: Column) -> Column:
    """A number from 0 to modulus - 1 that follows from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 8), 16, 10).cast("long") % modulus


def powered(shares: Column, exponent: Column) -> Column:
    """Normalised powers of an array of shares."""
    raised = F.transform(shares, lambda x: F.pow(x, exponent))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def bisected(test, low: float = 0.0, high: float = 1.0) -> Column:
    """The end of STEPS halvings of [low, high]: the largest exponent for which test holds, if it holds below and not above."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(test(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["lo"]


def temperature_weights(sources: DataFrame, budget: int | None = None, target_entropy: float = 0.9, max_repeats: float = 4.0) -> DataFrame:
    """From (source, tokens): (source, tokens, share, exponent, weight, target_tokens).

    target_entropy is a share of the highest entropy, log of the number of sources. budget: tokens of the mixture; None: as many as let every document in once.
    max_repeats bounds target_tokens / tokens; where even a weight in proportion exceeds it (a large budget), weights are in proportion. Sources without
    tokens are left out. One row of all sources' numbers is built: one number by source, not by document.
    """
    have = sources.where("tokens > 0")
    one = have.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("t", F.transform("s", lambda x: x["tokens"].cast("double")))
    one = one.withColumn("total", F.aggregate("t", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("t", lambda x: x / F.col("total")))
    goal = F.log(F.size("p").cast("double")) * target_entropy
    entropy = lambda e: -F.aggregate(powered(F.col("p"), e), F.lit(0.0), lambda a, w: a + F.when(w > 0, w * F.log(w)).otherwise(0.0))

    def repeats(e: Column) -> Column:
        """The most passes over a source. By share it is w / p; the largest source has the fewest."""
        ratio = F.zip_with(powered(F.col("p"), e), F.col("p"), lambda w, p: w / p)
        if budget is None:
            return F.array_max(ratio) / F.array_min(ratio)
        return F.array_max(ratio) * (F.lit(float(budget)) / F.col("total"))

    one = one.withColumn("by_entropy", F.when(entropy(F.lit(1.0)) >= goal - 1e-12, F.lit(1.0)).otherwise(bisected(lambda e: entropy(e) >= goal)))
    # the smaller the exponent, the more repeats: 1 - e is bisected upwards
    held = 1 - bisected(lambda d: repeats(1 - d) <= max_repeats + 1e-12)
    one = one.withColumn("exponent", F.when(repeats(F.col("by_entropy")) <= max_repeats + 1e-12, F.col("by_entropy")).otherwise(F.greatest(F.col("by_entropy"), held)))
    one = one.withColumn("w", powered(F.col("p"), F.col("exponent")))
    full = F.lit(float(budget)) if budget is not None else F.array_max(F.zip_with("t", "w", lambda t, w: t / w))
    one = one.withColumn("budget", full)
    rows = one.select("exponent", "budget", F.explode(F.arrays_zip("s", "p", "w")).alias("x"))
    target = F.round(F.col("x.w") * F.col("budget") - 1e-6).cast("long")
    return rows.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), F.col("x.p").alias("share"), "exponent", F.col("x.w").alias("weight"), target.alias("target_tokens"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None, target_entropy: float = 0.9, max_repeats: float = 4.0, block_tokens: int = 100_000, seed: int = 1, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The mixture, a row for each document and pass that it is taken in.

    Returns id_col, source_col, tokens, pass (from 0), block, place (0 to 1, by which blocks of all sources interleave in proportion) and the columns in keep.
    A source gets its whole passes, then whole blocks in the order of the next pass, then documents of one more block as long as they start within its target.

    A null source is a source of its own. Null and empty texts count 0 tokens: they come with the passes of their block; those of a source without any tokens come once. Null ids and repeated rows are
    documents of their own, equal ones in equal order. An empty table gives an empty result. Very long texts are documents as others. keep must not name the other result columns (ValueError); other columns are not read.
    """
    own = [id_col, source_col, "tokens", "pass", "block", "place"]
    if set(keep) & set(own):
        raise ValueError(f"columns of these names are made: {own}")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(id_col, source_col, *keep, key.alias("_s"), words_by_blanks(F.col(text_col)).alias("tokens"))
    totals = stored(rows.groupBy(F.col("_s").alias("source")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    zero = F.lit(0).cast("long")
    silent = totals.where("tokens = 0").select(F.col("source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_tokens)).alias("_blocks"), (zero + 1).alias("_full"), zero.alias("_rest"), zero.alias("_target"), zero.alias("_all"))
    plan = temperature_weights(totals, budget, target_entropy, max_repeats).select(
        F.col("source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).alias("_blocks"), F.floor(F.col("target_tokens") / F.col("tokens")).alias("_full"), (F.col("target_tokens") % F.col("tokens")).alias("_rest"), F.col("target_tokens").alias("_target"), F.col("tokens").alias("_all"),
    )
    plan = stored(plan.unionByName(silent))
    placed = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "_s").withColumn("block", draw(F.col("_blocks"), F.lit(seed), F.col(id_col)))
    blocks = placed.groupBy("_s", "block", "_full", "_rest", "_target", "_all").agg(F.sum("tokens").alias("_bt"))
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full"))))
    # The running sum over a pass in two steps, so that a source of many blocks is many tasks: by the first three of 32 digits of the order, then within them.
    passes = passes.withColumn("_o", F.md5(F.concat_ws(":", F.lit(seed), "pass", "_s", "block"))).withColumn("_head", F.substring("_o", 1, 3))
    so_far = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = passes.groupBy("_s", "pass", "_head").agg(F.sum("_bt").alias("_ht")).select("_s", "pass", "_head", so_far("_ht", Window.partitionBy("_s", "pass").orderBy("_head")).alias("_hb"))
    passes = passes.join(heads, ["_s", "pass", "_head"]).withColumn("_wb", so_far("_bt", Window.partitionBy("_s", "pass", "_head").orderBy("_o", "block")))
    before = F.col("_hb") + F.col("_wb")
    passes = passes.withColumn("_left", F.when(F.col("pass") < F.col("_full"), F.col("_bt")).otherwise(F.col("_rest") - before)).withColumn("_before", before + F.col("pass") * F.col("_all")).where((F.col("pass") < F.col("_full")) | (F.col("_left") > 0))
    passes = passes.select("_s", "block", "pass", F.when(F.col("_left") < F.col("_bt"), F.col("_left")).alias("_cut"), ((F.col("_before") + F.col("_bt") / 2) / F.greatest(F.col("_target"), F.lit(1))).alias("place"))
    whole = placed.select("_s", "block", id_col, source_col, "tokens", *keep)
    taken = whole.join(passes.where("_cut is null").drop("_cut"), ["_s", "block"])
    last = whole.join(passes.where("_cut is not null"), ["_s", "block"])  # one block of a source at most
    inside = Window.partitionBy("_s", "block", "pass").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pass", F.coalesce(F.col(id_col).cast("string"), F.lit("")))), id_col, "tokens")
    last = last.withColumn("_b", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_b < _cut").drop("_b", "_cut")
    return taken.unionByName(last).select(id_col, source_col, "tokens", F.col("pass").cast("int").alias("pass"), "block", "place", *keep)


#: DuckDB SQL for mix_sources(documents, target_entropy=0.95, max_repeats=4.0): same bisections over lists, same permutations by md5.
ORACLE_SQL = """WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10), '')) + 1 END AS tokens, coalesce('=' || source, 'null') AS s FROM documents),
t AS (SELECT s, sum(tokens)::BIGINT AS tokens FROM d GROUP BY s HAVING sum(tokens) > 0), z AS (SELECT s, count(*) AS n FROM d GROUP BY s HAVING sum(tokens) = 0),
l AS (SELECT list(tokens::DOUBLE ORDER BY s) AS ts, list(s ORDER BY s) AS ss, sum(tokens)::DOUBLE AS total, ln(count(*)) * 0.95 AS goal FROM t),
q AS (SELECT ts, ss, goal, list_transform(ts, lambda x: x / total) AS p FROM l),
e(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END FROM (
  SELECT i, lo, hi, mid, goal, -list_sum(list_transform(r, lambda x: x / z * ln(x / z))) AS h FROM (SELECT *, list_sum(r) AS z FROM (SELECT e.*, (lo + hi) / 2 AS mid, goal, list_transform(p, lambda x: pow(x, (lo + hi) / 2)) AS r FROM e, q WHERE i < 60)))),
f(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN g <= 4.0 + 1e-12 THEN mid ELSE lo END, CASE WHEN g <= 4.0 + 1e-12 THEN hi ELSE mid END FROM (
  SELECT i, lo, hi, mid, list_max(list_transform(p, lambda x: pow(x, -mid))) / list_min(list_transform(p, lambda x: pow(x, -mid))) AS g FROM (SELECT f.*, (lo + hi) / 2 AS mid, p FROM f, q WHERE i < 60))),
c AS (SELECT ts, ss, p, CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= goal - 1e-12 THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 60) END AS be, 1 - (SELECT lo FROM f WHERE i = 60) AS bf FROM q),
x AS (SELECT ts, ss, p, CASE WHEN list_max(list_transform(p, lambda y: pow(y, be - 1))) / list_min(list_transform(p, lambda y: pow(y, be - 1))) <= 4.0 + 1e-12 THEN be ELSE greatest(be, bf) END AS ex FROM c),
r AS (SELECT ts, ss, list_transform(p, lambda y: pow(y, ex)) AS r FROM x), w AS (SELECT ts, ss, list_transform(r, lambda y: y / list_sum(r)) AS w FROM r),
b AS (SELECT unnest(ss) AS s, unnest(ts)::BIGINT AS tk, unnest(w) AS w, (SELECT max(a) FROM (SELECT unnest(ts) / unnest(w) AS a FROM w)) AS budget FROM w),
pl AS (SELECT s, greatest(1, ceil(tk / 100000.0))::BIGINT AS nb, round(w * budget - 1e-6)::BIGINT AS target, tk FROM b UNION ALL SELECT s, greatest(1, ceil(n / 100000.0))::BIGINT, 0, 0 FROM z),
pd AS (SELECT d.*, pl.*, ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % nb AS block FROM d JOIN pl ON d.s = pl.s),
bl AS (SELECT s, block, target, tk, CASE WHEN tk = 0 THEN 1 ELSE target // tk END AS fl, CASE WHEN tk = 0 THEN 0 ELSE target % tk END AS rest, sum(tokens)::BIGINT AS bt FROM pd GROUP BY ALL),
ps AS (SELECT *, unnest(range(0, fl + 1)) AS pass FROM bl),
o AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY s, pass ORDER BY md5('1:' || pass || ':' || s || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM ps),
k AS (SELECT s, block, pass, CASE WHEN pass >= fl AND rest - bef < bt THEN rest - bef END AS cut, (bef + pass * tk + bt / 2) / greatest(target, 1) AS place FROM o WHERE pass < fl OR rest - bef > 0),
a AS (SELECT pd.doc_id, pd.source, pd.tokens, k.pass, pd.block, k.place, k.cut, coalesce(sum(pd.tokens) OVER (PARTITION BY pd.s, pd.block, k.pass ORDER BY md5('1:' || k.pass || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, pd.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pd JOIN k ON k.s = pd.s AND k.block = pd.block)
SELECT doc_id, source, tokens, pass::INT AS pass, block, place FROM a WHERE cut IS NULL OR before < cut"""
