"""Language-model scores of whole texts, with bigram counts in log-frequency Bloom filters.

Words become 64-bit numbers. Chunks of documents are stored as numbered words; their distinct words and bigrams go to buckets by number, where counts over the whole corpus
are made. Word counts come back to the chunks exactly. Each bucket of bigrams has a filter of its own, as large as its keys need: a bigram seen c times in training sets the bits of (bigram, 1) to
(bigram, 1 + log2 c), and repeated probes find its level again for the chunks that ask. Probabilities interpolate the bigram's share of its first word with the smoothed unigram; the weights depend on how often the first word
was seen and are chosen on training texts with each text's own count taken out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import ODD, mix, slices, words
from .shipping import ship, stored

U = np.uint64
END = mix(np.array([0x656E64], U))[0]  # the number of the end of a text
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 64 << 20
HASHES = 3
#: Filters that are bound to have no more bytes together are broadcast and probed where texts are scored; larger ones are asked in their buckets.
MOST_BROADCAST = 48 << 20
#: A bucket's filter has 16 to 32 bits for each key, a power of two, at least so many.
LEAST_BITS = 1 << 16
LAMBDAS = np.array([0.0, 0.05, 0.15, 0.35, 0.6, 0.85])
#: Classes of first words, by how often they were seen: each four times the one before, the last open.
CLASSES = 8

CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("facts", T.BinaryType()), T.StructField("uniq", T.BinaryType()), T.StructField("stream", T.BinaryType())])
SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def chunks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """CHUNK rows: facts (id, null, held out, tokens of each document), distinct words, and every token's place among them (each text followed by its end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2), CHUNK_BYTES):
                word, row = words(data, offsets)
                counts = np.bincount(row, minlength=b - a)
                stream = np.insert(word, np.cumsum(counts), END)
                uniq, at = np.unique(stream, return_inverse=True)
                key = batch.column(0).slice(a, b - a)
                facts = np.stack([key.fill_null(0).to_numpy().astype(np.int64), key.is_null().to_numpy(zero_copy_only=False), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), counts + 1], 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (facts, uniq, at.astype(width_of(uniq))))], names=CHUNK.fieldNames())
                chunk += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, CHUNK)


def width_of(uniq: np.ndarray) -> type:
    return np.uint16 if len(uniq) <= 1 << 16 else np.uint32


def opened(facts: bytes, uniq: bytes, stream: bytes) -> tuple[np.ndarray, ...]:
    """(facts, uniq, stream, document of each token, whether it is of training)."""
    f, u = np.frombuffer(facts, np.int64).reshape(-1, 4), np.frombuffer(uniq, U)
    s = np.frombuffer(stream, width_of(u))
    doc = np.repeat(np.arange(len(f)), f[:, 3])
    return f, u, s, doc, f[doc, 2] == 0


def pairs(u: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word before each token: the end for a text's first, bigram number)."""
    end = np.searchsorted(u, END)
    before = np.empty(len(s), np.int64)
    before[0:1] = end
    before[1:] = np.where(doc[1:] == doc[:-1], s[:-1], end)
    return before, mix(u[before] * ODD + u[s])


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (numbers >> U(40)) % U(buckets)


def cuts_of(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, (bucket, start, end) of those that are there), whatever the number of buckets."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    return order, list(zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False))


def bigrams_sent(u: np.ndarray, s: np.ndarray, doc: np.ndarray, train: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(place of each token's bigram among them, distinct bigrams by bucket, in each those seen once in training first; their counts there; (bucket, start, end))."""
    numbers, at = np.unique(pairs(u, s, doc)[1], return_inverse=True)
    counts = np.bincount(at[train], minlength=len(numbers)).astype(np.uint32)
    once = np.argsort(counts != 1, kind="stable")
    order, there = cuts_of(bucket_of(numbers[once], buckets))
    order = once[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[at], numbers[order], counts[order], there


def sent(table: DataFrame, what: str, buckets: int) -> DataFrame:
    """SENT rows of each chunk: distinct words with training counts, or 32 bits of distinct bigrams, those seen once in training first, and the others' counts. Counts of 0 are sent too, they want an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                _, u, s, doc, train = opened(*raw)
                if what == "words":
                    order, there = cuts_of(bucket_of(u, buckets))
                    numbers, counts = u[order], np.bincount(s[train], minlength=len(u)).astype(np.uint32)[order]
                    n, c = [numbers[a:b].tobytes() for _, a, b in there], [planes(counts[a:b]) for _, a, b in there]
                else:
                    _, numbers, counts, there = bigrams_sent(u, s, doc, train, buckets)
                    low = (numbers & U(0xFFFFFFFF)).astype(np.uint32)
                    n, c = [low[a:b].tobytes() for _, a, b in there], [(x := counts[a:b])[x != 1].tobytes() for _, a, b in there]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in there], pa.int32()), pa.array([chunk] * len(there), pa.int64()), pa.array(n, pa.binary()), pa.array(c, pa.binary())], names=SENT.fieldNames())

    return table.mapInArrow(run, SENT)


def planes(x: np.ndarray) -> bytes:
    """Numbers by their first bytes, second bytes and so on: the upper ones are mostly 0 and take no room once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def answered(table: pa.Table) -> pa.Table:
    """Counts over the corpus for the words of a bucket, chunk by chunk in the order they came; a row of chunk -1 has the bucket's tokens and distinct words of training."""
    parts = [np.frombuffer(x.as_py(), U) for x in table["numbers"]]
    counts = np.concatenate([from_planes(x.as_py(), np.uint32) for x in table["counts"]])
    uniq, at = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(at, counts, len(uniq)).astype(np.int64)
    back = [planes(x) for x in np.split(count[at], np.cumsum([len(p) for p in parts])[:-1])]
    facts = np.array([count.sum(), (count > 0).sum()], np.int64).tobytes()
    return pa.table([pa.array([*table["bucket"].to_pylist(), 0], pa.int32()), pa.array([*table["chunk"].to_pylist(), -1], pa.int64()), pa.array([b""] * (len(parts) + 1), pa.binary()), pa.array([*back, facts], pa.binary())], names=SENT.fieldNames())


def bigram_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a bucket: numbers of bigrams (from the bucket and their last 32 bits: only these are sent, a thousandth of a bucket at most share theirs), how often each was seen in training, its place for each one sent, and how many each chunk sent."""
    low, counts = [], []
    for n, c in zip(table["numbers"], table["counts"], strict=True):
        low.append(np.frombuffer(n.as_py(), np.uint32))
        more = np.frombuffer(c.as_py(), np.uint32)
        counts.append(np.concatenate([np.ones(len(low[-1]) - len(more), np.uint32), more]))
    uniq, at = np.unique(np.concatenate(low), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(uniq)).astype(np.int64)
    return mix(U(table["bucket"][0].as_py()) << U(32) | uniq.astype(U)), count, at, [len(x) for x in low]


def keys_of(numbers: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return mix(numbers + levels.astype(U) * ODD)


def bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places for each key."""
    second = mix(keys) | U(1)
    return np.concatenate([(keys + U(k) * second) & U(bits - 1) for k in range(HASHES)])


def level_of(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)  # 2 and 3 are level 1, 4 to 7 level 2


def bloom_filter(numbers: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter of bigrams seen at least once, and its bits: all of their keys get in."""
    numbers, steps = numbers[count > 0], level_of(count[count > 0]) + 1
    bits = max(LEAST_BITS, 1 << (16 * int(steps.sum())).bit_length())
    bloom = np.zeros(bits, bool)
    for q in range(1, int(steps.max(initial=0)) + 1):
        g = numbers[steps >= q]
        bloom[bits_of(keys_of(g, np.full(len(g), q)), bits)] = True
    return np.packbits(bloom, bitorder="little"), bits


def probed(numbers: np.ndarray, bloom: np.ndarray, bits: int) -> np.ndarray:
    """1 + the level of each bigram: the last of consecutive steps of which all bits are set; 0 if not even the first."""
    level, todo = np.zeros(len(numbers), np.int64), np.arange(len(numbers))
    step = 1
    while len(todo) and step < 60:
        places = bits_of(keys_of(numbers[todo], np.full(len(todo), step)), bits)
        hit = ((bloom[places >> U(3)] >> (places & U(7)).astype(np.uint8)) & 1).reshape(HASHES, -1).all(axis=0)
        todo = todo[hit]
        level[todo] = step
        step += 1
    return level


def model_share(level: np.ndarray, less: int = 0) -> np.ndarray:
    """The least count of what probed() gives, less the text's own."""
    return np.where(level > 0, np.maximum((1 << np.maximum(level - 1, 0)) - less, 0), 0)


def levelled(bigrams: DataFrame, buckets: int) -> DataFrame:
    """From bigrams' SENT rows: what probes of the bucket's filter give for them, a byte each, as counts of bucket + buckets.

    A bucket holds the bigrams of BUCKET_BYTES of text at the mean, and a bigram seen c times has 1 + log2 c <= c keys, so a filter is bounded however large the corpus is.
    """

    def run(table: pa.Table) -> pa.Table:
        numbers, count, at, sizes = bigram_counts(table)
        level = probed(numbers, *bloom_filter(numbers, count)).astype(np.uint8)
        back = [x.tobytes() for x in np.split(level[at], np.cumsum(sizes)[:-1])]
        return pa.table([pa.array([k + buckets for k in table["bucket"].to_pylist()], pa.int32()), pa.array(table["chunk"].to_pylist(), pa.int64()), pa.array([b""] * len(back), pa.binary()), pa.array(back, pa.binary())], names=SENT.fieldNames())

    return bigrams.groupBy("bucket").applyInArrow(run, SENT)


def filters(bigrams: DataFrame) -> DataFrame:
    """(bucket, bloom): the filter of each bucket, the same as levelled() probes."""

    def run(table: pa.Table) -> pa.Table:
        numbers, count, _, _ = bigram_counts(table)
        return pa.table([pa.array(table["bucket"][:1].to_pylist(), pa.int32()), pa.array([bloom_filter(numbers, count)[0].tobytes()], pa.binary())], names=["bucket", "bloom"])

    return bigrams.groupBy("bucket").applyInArrow(run, "bucket int, bloom binary")


def levels_here(u: np.ndarray, s: np.ndarray, doc: np.ndarray, train: np.ndarray, buckets: int, blooms: dict[int, bytes]) -> np.ndarray:
    """The level of each token's bigram, from filters that are here."""
    place, numbers, _, there = bigrams_sent(u, s, doc, train, buckets)
    level = np.zeros(len(numbers), np.int64)
    for bucket, a, b in there:
        bloom = np.frombuffer(blooms[bucket], np.uint8)
        level[a:b] = probed(mix(U(bucket) << U(32) | numbers[a:b] & U(0xFFFFFFFF)), bloom, 8 * len(bloom))
    return level[place]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Score all texts with a model of those that are not held out.

    The filters of bigrams are broadcast to workers if the number of training tokens bounds them by most_broadcast bytes, and probed while texts are scored; else they are probed in the buckets where they are made.
    The bits are the same, so the scores are. Very long texts are numbered and scored whole, in memory in proportion to their length.

    Returns id_col, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, vocabulary, base_score (sum of log10 of unigrams smoothed by 0.1), score (log10 of
    the interpolated model, ends included). Null and empty texts are their end alone. A null held_out counts as false. Null ids stay, repeated rows are texts of their own. An empty table
    gives an empty result; without training texts all tokens are unknown and both scores are those of the smoothing. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(128, -(-total // BUCKET_BYTES))
    table = stored(chunks(docs, id_col, text_col, held_out))
    back = stored(sent(table, "words", buckets).groupBy("bucket").applyInArrow(answered, SENT))
    n, v = np.sum([np.frombuffer(r["counts"], np.int64) for r in back.where("chunk < 0").select("counts").collect()] or [[0, 0]], axis=0).tolist()  # two numbers a bucket
    # A filter has 32 bits for each key at most, and a bigram seen c times no more than c keys, so 4 bytes for each token of training and the least size of each filter bound them all.
    small = 4 * n + buckets * LEAST_BITS // 8 <= most_broadcast
    blooms = spark.sparkContext.broadcast({r["bucket"]: bytes(r["bloom"]) for r in filters(sent(table, "bigrams", buckets)).collect()}) if small else None
    answers = back.where("chunk >= 0") if small else back.where("chunk >= 0").unionByName(stored(levelled(sent(table, "bigrams", buckets), buckets)))
    floor = math.log10(n + 0.1 * (v + 1)) if n + v else -1.0

    active = len(LAMBDAS) * CLASSES

    def parts_of(c: np.ndarray, h: np.ndarray, level: np.ndarray, less: int) -> list[np.ndarray]:
        """log10 of the interpolated probability of each token, by weight of the bigram."""
        uni = (np.maximum(c - less, 0) + 0.1) / (n - less + 0.1 * (v + 1))
        share = np.minimum(model_share(level, less) / np.maximum(h - less, 1), 1.0)
        return [np.log10(lam * share + (1 - lam) * uni) for lam in LAMBDAS]

    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("by_weight", T.ArrayType(T.DoubleType())), T.StructField("left_out", T.BooleanType()),
    ])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each document log10 sums by class and weight; and a row for the chunk (left_out) with those of its training tokens, their own count taken out."""
        right = right.sort_by("bucket")
        told, bucket = right["counts"].to_pylist(), right["bucket"].to_pylist()
        counts = np.concatenate([from_planes(x, np.int64) for x, k in zip(told, bucket, strict=True) if k < buckets])
        asked = [np.frombuffer(x, np.uint8) for x, k in zip(told, bucket, strict=True) if k >= buckets]
        tables = []
        for k in range(left.num_rows):
            f, u, s, doc, train = opened(*(left[c][k].as_py() for c in ("facts", "uniq", "stream")))
            c = np.empty(len(u), np.int64)
            c[np.argsort(bucket_of(u, buckets), kind="stable")] = counts
            level = levels_here(u, s, doc, train, buckets, blooms.value) if blooms else np.concatenate(asked).astype(np.int64)[bigrams_sent(u, s, doc, train, buckets)[0]]
            own, h = c[s], c[pairs(u, s, doc)[0]]
            kind = np.minimum(level_of(h + 1) >> 1, CLASSES - 1)
            sums = np.stack([np.bincount(doc * CLASSES + kind, x, len(f) * CLASSES).reshape(-1, CLASSES) for x in parts_of(own, h, level, 0)], 2).reshape(len(f), active)
            out = np.stack([np.bincount(kind[train], x, CLASSES) for x in parts_of(own[train], h[train], level[train], 1)], 1).reshape(1, active)
            base = np.bincount(doc, np.log10(own + 0.1) - floor, len(f))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([sums, out]).ravel()), active).cast(pa.list_(pa.float64()))
            null = np.append(f[:, 1] > 0, True)
            tables.append(pa.table([pa.array(np.append(f[:, 0], 0), mask=null), pa.array(np.append(f[:, 2] > 0, False)), pa.array(np.append(f[:, 3], 0)), pa.array(np.append(np.bincount(doc, own > 0, len(f)), 0).astype(np.int64)), pa.array(np.append(base, 0.0)), rows, pa.array(np.arange(len(f) + 1) == len(f))], names=schema.fieldNames()))
        return pa.concat_tables(tables)

    found = stored(table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema))
    likely = np.zeros(active)
    for r in found.where("left_out").select(F.posexplode("by_weight").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        likely[r["k"]] = r["x"]
    chosen = np.arange(CLASSES) * len(LAMBDAS) + np.argmax(likely.reshape(CLASSES, -1), axis=1)
    score = sum((F.element_at("by_weight", int(k) + 1) for k in chosen[1:]), F.element_at("by_weight", int(chosen[0]) + 1))
    return found.where("not left_out").select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.lit(v).cast("long").alias("vocabulary"), "base_score", score.alias("score"))
