"""The subpackage's registered queries, each over whole tables with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, merkle, mixing, quotes
from .ann import nearest
from .line_dedup import dedup_lines
from .lm import score_texts
from .media import decode_tiff, encode_payloads
from .ngram_join import ngram_components
from .packing import pack_hierarchical
from .tokens import prefix_token_counts
from .toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and where a text must be cut to fit 512."""
    counts = prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limits=(512,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("cuts")[0].alias("cut_chars"))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a TIFF of deflate strips with the horizontal predictor, read back page by page."""
    media = encode_payloads(table(spark, sf_dir, "documents"))
    pages = decode_tiff(media, keep=("doc_id", "n_bytes", "media"))
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("page.pixels").cast("long").alias("payload_bytes"), F.sha2("page.pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("page.pixels", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%dx%d %s/%d mean=%.6f entropy=%.6f", "page.width", "page.height", "page.samples", "page.compression", "page.blocks", "page.mean", "page.entropy").alias("feature"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return pack_hierarchical(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, tiers=(256, 512, 1024), end_id=1)


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, in the order of replies."""
    return quotes.unquoted_conversations(table(spark, sf_dir, "conversations"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 % of their 4-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to 95 % of the highest entropy, none repeated more than four times, with as many tokens as let every document in once."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeats=4.0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one, up to a word in 12 and two words; repeats of lines of any length."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), max_edits=2, units_an_edit=12).withColumnRenamed("_lines_removed", "lines_removed")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, found by greedy search of the neighbour graph of all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all texts under a bigram model of nine tenths of them."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held_out)


def toxicity_fold(id_col: str = "doc_id") -> Column:
    """The fold of a document, 0 to 3; labels of fold 2 are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels outside of the held-out fold."""
    docs, held_out = table(spark, sf_dir, "documents"), toxicity_fold() == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = score_toxicity(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "toxicity.score", "toxicity.predicted", "toxicity.n_words", F.size("toxicity.hits").alias("n_hits"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle tree of all documents by language, and what becomes of each proof where n_chars is off by one in a seventh of them."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.leaf_digest(*(n_chars if c == "n_chars" else F.col(c) for c in LEAF))
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    rows = merkle.merkle_manifest(docs.withColumn("other", other), LEAF, "lang", "doc_id", keep=("other",))
    folded = merkle.folded(F.coalesce("keep.other", "leaf"), F.col("path"))
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language that stand out most, of 2 to 5 words that come 100 times or more."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in runs of ten words of a benchmark item, and the items they are from."""
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("leaks.items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"))


#: What a leaf of the manifest is made of, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_tiff_pages": op2_tiff_pages,
    "op3_packing": op3_packing,
    "op4_quote_linking": op4_quote_linking,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest": op8_nearest,
    "op9_lm_scores": op9_lm_scores,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_collocations": op12_collocations,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {"op4_quote_linking": quotes.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_decontamination": decontamination.ORACLE_SQL}
