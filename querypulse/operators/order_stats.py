"""Exact order statistics of groups of any size, from counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of e that values span; two values of a bucket differ by a 4096th at most.
FINE = 4096


def value_bucket(x: Column) -> Column:
    """A whole number that never falls as x grows; NaN, the largest value, stands behind all."""
    size = F.least(F.log1p(F.abs(x) * 1048576.0), F.lit(1e6))
    return F.when(F.isnan(x), F.lit(1 << 40)).otherwise(F.floor(F.signum(x) * size * FINE)).cast("long")


def same(a: list[str], b: list[str]) -> Column:
    """Keys are equal, or both null."""
    return reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)))


def nearest_ranks(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, a column for each name in wanted): the value of rank ceil(n q) among the n non-null values of a column in a group. wanted: name -> (column, q).

    Values are counted first, each distinct one a row, then summed in two levels: buckets of a group, and the values of the one bucket that holds a rank. No buffer holds the values of a
    group, and a busy group's are spread over all tasks until a rank is looked up. Groups without values of a column have null there; groups without any are left out.
    """
    for _, q in wanted.values():
        if not 0 < q <= 1:
            raise ValueError("a percentile lies in (0, 1]")
    by_column: dict[str, list[tuple[str, float]]] = {}
    for name, (column, q) in wanted.items():
        by_column.setdefault(column, []).append((name, q))
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("x")) for c in by_column)))
    rows = df.select(*keys, values.alias("_v")).select(*keys, F.col("_v.of").alias("_of"), F.col("_v.x").alias("_x")).where("_x is not null")
    counts = rows.groupBy(*keys, "_of", "_x").agg(F.count("*").alias("_n")).withColumn("_b", value_bucket(F.col("_x")))

    whole = Window.partitionBy(*keys, "_of")
    buckets = counts.groupBy(*keys, "_of", "_b").agg(F.sum("_n").alias("_n"))
    buckets = buckets.withColumns({"_total": F.sum("_n").over(whole), "_up": F.sum("_n").over(whole.orderBy("_b"))})
    asked = [F.when(F.col("_of") == c, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in x))) for c, x in by_column.items()]
    rank = F.greatest(F.lit(1), F.least(F.col("_total"), F.ceil(F.col("_total") * F.col("_a.q"))))
    hit = buckets.withColumn("_a", F.explode(F.coalesce(*asked))).withColumn("_rank", rank).where("_rank <= _up and _rank > _up - _n")
    hit = hit.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_of").alias("_hit_of"), F.col("_b").alias("_hit_b"), F.col("_a.name").alias("_name"), (F.col("_rank") - F.col("_up") + F.col("_n")).alias("_rank"))

    inside = counts.join(hit, same([*keys, "_of", "_b"], [*(f"_of_{k}" for k in keys), "_hit_of", "_hit_b"]))
    inside = inside.withColumn("_up", F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy("_x"))).where("_rank <= _up and _rank > _up - _n")
    return inside.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in wanted))
