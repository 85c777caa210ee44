"""Scores with filters that are broadcast and with filters that are asked in their buckets."""

import random

from pyspark.sql import functions as F

from querypulse.llm.lm import MOST_BROADCAST, score_texts


def test_scores_are_the_same_either_way(spark):
    random.seed(21)
    words = [f"w{int(random.paretovariate(0.7)) % 60}" for _ in range(400)]
    text = lambda: " ".join(random.choice(words) for _ in range(random.randint(0, 80)))
    rows = [(k, text()) for k in range(300)] + [(None, text()), (1, None), (2, ""), (3, "w1 " * 5000), (3, "w1 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 10 == 0
    both = [sorted(map(str, score_texts(df, held, most_broadcast=m).collect())) for m in (MOST_BROADCAST, 0)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
