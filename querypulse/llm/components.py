"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component: the smallest node that edges reach) for every node of an edge; long ids, nulls and loops are left out, repeated edges count once.

    Each round is written to the shared folder. The number of rounds is logarithmic in the longest path; RuntimeError beyond most_rounds.
    """
    now = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            ends = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
        state = seen
    raise RuntimeError(f"no end after {most_rounds} rounds")
