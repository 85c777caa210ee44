"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querypulse.llm.line_dedup import dedup_lines
from querypulse.llm.mixing import mix_sources
from querypulse.llm.ngram_join import ngram_components
from querypulse.llm.packing import pack_hierarchical
from querypulse.llm.queries import toxicity_fold
from querypulse.llm.shipping import stored
from querypulse.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3, learned from the labels outside of fold 2. Null and empty texts stay."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity_fold() != 2)
    return score_toxicity(docs.select(COLUMNS), model, threshold=0.3, as_col="_toxicity").where("_toxicity.predicted = 0").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one, up to a word in 12 and two words; n_chars follows the text. A text may become empty."""
    kept = dedup_lines(docs.select(COLUMNS), max_edits=2, units_an_edit=12)
    n_chars = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their 5-word shingles the one of the smallest id. Null ids stay; rows that repeat an id are one document and stay together."""
    found = ngram_components(docs, size=5, percent=80)
    gone = found.where("component_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again: to 90 % of the highest entropy of sources, or until the most repeated source comes 1.25 times."""
    return mix_sources(docs, budget=None, target_entropy=0.9, max_repeats=1.25, keep=("text", "lang", "n_chars")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in sequences of 2048 ids."""
    return pack_hierarchical(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, tiers=(256, 512, 1024), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Iterative and learned stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
