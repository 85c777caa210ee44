"""Phrases whose words come together more often than chance has it, by Toivonen's sampling.

Phrases are counted only if both phrases of one word less are thought frequent. A sample of pieces of all documents proposes what is frequent; a full pass counts all those phrases and their negative
border, that is whatever else has frequent parts. A frequent phrase of the border makes the guess wider, and a further pass counts what that adds, until the border has none: then no phrase is left out.

Tasks know the guess as a bitmap, of bounded size, by which a phrase may be taken for frequent but never for rare: false bits cost counting, not results. Phrases travel as 64-bit numbers
while they are of the border, cut to the bits that tell them apart, and as text, which the counts returned are of, once they are thought frequent: two of the border that share a number only
look more frequent than they are.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import _letters, mix, powers
from .shipping import ship, stored

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
#: Bytes of text that are numbered at a time; a longer text is cut where a piece ends.
CHUNK_BYTES = 4 << 20
#: Bits of the guess: 64 for each frequent phrase of the sample, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: A sample's phrase is proposed from this share of the frequency that is expected of a phrase at the threshold.
SLACK = 0.32
SAMPLE = 0.25
#: Border phrases of so much text, at the mean, meet in one task; so many numbers a task gathers before it sends them.
BUCKET_BYTES = 64 << 20
LEAST_BUCKET_BITS = 5
HELD = 4_000_000

_ends = np.zeros(256, bool)
_ends[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_blank = _ends.copy()
_blank[[0x20, 0x09]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

#: What tasks send for a bucket: numbers of the border, packed, and phrases with their counts, as compressed lines in order.
SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("named", T.BinaryType())])
COUNTS = T.StructType([T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])
PAGE = 1 << 20


@dataclass(frozen=True)
class Guess:
    """What is thought frequent, as bits (None: nothing is), and what was in the pass before (None: there was none). bucket_bits and 32 more are what a number of the border keeps."""

    now: np.ndarray | None
    before: np.ndarray | None
    bucket_bits: int

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> U(32 - self.bucket_bits)


def slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each number."""
    k = mix(keys * ODD)
    return k & U(size - 1), (k >> U(32)) & U(size - 1)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether numbers are in the guess."""
    found = np.ones(len(keys), bool)
    for slot in slots(keys, len(bits) * 8):
        found &= (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1
    return found


def packed(low: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted 32-bit numbers and their counts: differences by planes of bytes, which compress, then counts up to 255, then those beyond."""
    step = np.diff(low, prepend=np.uint32(0))
    large = np.flatnonzero(n >= 255)
    planes = step.view(np.uint8).reshape(-1, 4).T
    return np.int64(len(low)).tobytes() + planes.tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + n[large].astype(np.int64).tobytes()


def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(x, np.int64, 1)[0])
    step = np.ascontiguousarray(np.frombuffer(x, np.uint8, 4 * m, 8).reshape(4, m).T).view(np.uint32).ravel()
    n = np.frombuffer(x, np.uint8, m, 8 + 4 * m).astype(np.int64)
    n[n == 255] = np.frombuffer(x, np.int64, -1, 8 + 5 * m) if len(x) > 8 + 5 * m else 0
    return np.cumsum(step, dtype=np.uint32), n


def bits_of(keys: DataFrame, size: int, bucket_bits: int, before: np.ndarray | None = None) -> np.ndarray:
    """The guess as a bitmap of so many bits (a power of two), those of before set as well. keys: h. Each task makes pages of it, so the driver gets size / 8 bytes at most."""
    guess = Guess(None, None, bucket_bits)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(np.concatenate(slots(guess.cut(batch.column(0).to_numpy().view(U)), size))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // PAGE), pa.array(slot % PAGE)], names=["page", "slot"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            page, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(page):
                made.setdefault(int(p), np.zeros(min(PAGE, size), bool))[slot[page == p]] = True
        for p, x in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

    bits = np.zeros(size // 8, np.uint8) if before is None else before.copy()
    for page, part in keys.select("h").mapInArrow(placed, "page long, slot long").repartition("page").mapInArrow(pages, "page long, bits binary").collect():
        at = page * PAGE // 8
        bits[at : at + len(part)] |= np.frombuffer(part, np.uint8)
    return bits


def cut(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets from 0, rows) of runs of rows of about so many bytes. A longer row is cut behind ends of pieces, so no phrase is cut; a piece stays whole."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        if len(part) <= most:
            yield part, offsets[row : end + 1] - offsets[row], np.arange(row, end)
        else:
            breaks, at = np.flatnonzero(_ends[part]) + 1, 0
            while at < len(part):
                k = int(np.searchsorted(breaks, at + most, "right")) - 1
                to = int(breaks[k]) if k >= 0 and breaks[k] > at else int(breaks[k + 1]) if k + 1 < len(breaks) else len(part)
                yield part[at:to], np.array([0, to - at]), np.array([row])
                at = to
        row = end


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, row, piece, start, end) of each word of lower-cased texts. Words are told apart first, so that each distinct one is numbered once."""
    n = len(data)
    inside = ~_blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
    row = np.searchsorted(offsets, starts, "right") - 1
    # rows and ends of pieces both only grow, so their sum tells pieces apart
    return numbers(words.dictionary)[words.indices.to_numpy()], row, np.searchsorted(np.flatnonzero(_ends[data]), starts) + row, starts, ends


def numbers(words: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit numbers of distinct words, some at a time so that memory stays small."""
    if not len(words):
        return np.zeros(0, U)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out, k = np.empty(len(words), U), 0
    while k < len(words):
        to = max(k + 1, int(np.searchsorted(at, at[k] + (1 << 19), "right")) - 1)
        part = data[at[k] : at[to]]
        up, down = powers(max(1, len(part)))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_letters[part] * up[: len(part)], out=total[1:])
        here = at[k : to + 1] - at[k]
        out[k:to] = mix((total[here[1:]] - total[here[:-1]]) * down[here[:-1]])
        k = to
    return out


class Gathered:
    """What a task has counted so far: numbers of the border, and phrases that are thought frequent."""

    def __init__(self, guess: Guess):
        self.guess, self.border, self.held = guess, [], 0
        self.named: dict[str, int] = {}  # language as JSON, a tab, phrase: neither holds a tab or line end

    def add_border(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(self.guess.cut(h), return_counts=True)
        self.border.append((keys, n))
        self.held += len(keys)
        if self.held > HELD:
            yield from self.sent_border()

    def add_phrases(self, lines: list[str], counts: list[int]) -> None:
        named = self.named
        for line, n in zip(lines, counts, strict=True):
            named[line] = named.get(line, 0) + n

    def sent_border(self) -> Iterator[pa.RecordBatch]:
        if not self.border:
            return
        keys, n = summed(np.concatenate([k for k, _ in self.border]), np.concatenate([n for _, n in self.border]))
        self.border, self.held = [], 0
        bucket = (keys >> U(32)).astype(np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(keys)]])
        low = keys.astype(np.uint32)
        rows = [(int(bucket[a]), packed(low[a:b], n[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k in range(0, len(rows), 64):
            yield sent([r[0] for r in rows[k : k + 64]], "packed", [r[1] for r in rows[k : k + 64]])

    def sent_phrases(self) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[str]] = {}
        mask = (1 << self.guess.bucket_bits) - 1
        for line in sorted(self.named):
            parts.setdefault(zlib.crc32(line.encode()) & mask, []).append(f"{line}\t{self.named[line]}")
        self.named = {}
        for bucket, lines in parts.items():
            yield sent([bucket], "named", [zlib.compress("\n".join(lines).encode(), 1)])


def sent(bucket: list[int], column: str, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(values if c == column else [None] * len(bucket), pa.binary()) for c in ("packed", "named"))], names=SENT.fieldNames())


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(docs: DataFrame, text_col: str, lang_col: str, most: int, least: int, guess: Guess) -> DataFrame:
    """COUNTS rows: of the phrases of up to most words that have to be counted under the guess `now` and were not under `before`, those that come at least so often.

    Thought frequent: with language and text; of the border: with h alone, cut as in Guess. In the first pass (before is None) the number of words of each language stands under the phrase "".
    Counts are made by task and meet by bucket, one of which is in memory at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    shared: Broadcast = spark.sparkContext.broadcast(guess)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = shared.value
        gathered = Gathered(guess)
        for batch in batches:
            langs, lang = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            seeds = seeds_of(langs)
            offsets, data = laid_out(batch.column(1))
            for part, at, rows in cut(data, offsets, CHUNK_BYTES):
                yield from chunk_counts(_lower[part], at, lang[rows], langs, seeds, most, gathered)
        yield from gathered.sent_border()
        yield from gathered.sent_phrases()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bucket by bucket."""
        held: list[pa.RecordBatch] = []

        def ended() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            blobs = [unpacked(x.as_py()) for x in table["packed"].drop_null()]
            if blobs:
                low, n = summed(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]))
                often = n >= least
                h = (U(held[0].column(0)[0].as_py()) << U(32) | low[often].astype(U)) << U(32 - bucket_bits)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.nulls(len(h), pa.string()), pa.nulls(len(h), pa.string()), pa.array(n[often])], names=COUNTS.fieldNames())
            sums: dict[str, int] = {}
            for x in table["named"].drop_null():
                for line in zlib.decompress(x.as_py()).decode().split("\n"):
                    key, _, n = line.rpartition("\t")
                    sums[key] = sums.get(key, 0) + int(n)
            often = [(*k.split("\t"), n) for k, n in sums.items() if n >= least or k.endswith("\t")]
            if often:
                langs, phrases, n = [json.loads(x[0]) for x in often], [x[1] for x in often], [x[2] for x in often]
                yield pa.RecordBatch.from_arrays([pa.array(phrase_numbers(langs, phrases).view(np.int64)), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], names=COUNTS.fieldNames())

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != bucket[a]:
                    yield from ended()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from ended()

    bucket_bits = guess.bucket_bits
    return texts_of(docs, text_col, lang_col).mapInArrow(run, SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, COUNTS)


def hash_of(name: str) -> int:
    """A number below 2^63, the same in every worker."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") >> 1


def seeds_of(langs: list[str]) -> np.ndarray:
    return mix(np.array([hash_of(x) for x in langs], U) * ODD)


def phrase_numbers(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The numbers that chunk_counts gives to phrases."""
    words = [p.encode().split(b" ") for p in phrases]
    known = sorted({w for p in words for w in p})
    number = dict(zip(known, numbers(pa.array(known, pa.large_binary())).tolist(), strict=True))
    seed = dict(zip(names := sorted(set(langs)), seeds_of(names).tolist(), strict=True))
    out = mix(np.array([number[p[0]] ^ seed[lang] for p, lang in zip(words, langs, strict=True)], U))
    for k in range(1, max(map(len, words), default=0)):
        at = np.array([i for i, p in enumerate(words) if len(p) > k], np.int64)
        out[at] = mix(out[at] * ODD + np.array([number[words[i][k]] for i in at], U))
    return out


def chunk_counts(low: np.ndarray, offsets: np.ndarray, lang: np.ndarray, langs: np.ndarray, seeds: np.ndarray, most: int, gathered: Gathered) -> Iterator[pa.RecordBatch]:
    word, row, piece, starts, ends = numbered(low, offsets)
    guess, lang = gathered.guess, lang[row]
    now, before = guess.now, guess.before
    if before is None:
        totals = np.bincount(lang, minlength=len(langs))
        there = np.flatnonzero(totals)
        gathered.add_phrases([f"{json.dumps(langs[k])}\t" for k in there], totals[there].tolist())
    heads = [json.dumps(x) + "\t" for x in langs]
    known = counted_before = None
    g = mix(word ^ seeds[lang])
    for n in range(1, most + 1):
        m = len(word) - n + 1
        if m <= 0:
            return
        if n == 1:
            may, done = np.arange(m), np.full(m, before is not None)
        else:
            may = np.flatnonzero((piece[:m] == piece[n - 1 :]) & known[:m] & known[1 : m + 1])
            done = (counted_before[:m] & counted_before[1 : m + 1])[may]
            h = np.zeros(m, U)
            h[may] = mix(g[may] * ODD + word[may + n - 1])
            g = h
        own = g[may]
        is_in = in_bits(now, guess.cut(own)) if now is not None else np.zeros(len(own), bool)
        was_in = done & in_bits(before, guess.cut(own)) if before is not None else np.zeros(len(own), bool)
        known, counted_before = np.zeros(m, bool), np.zeros(m, bool)
        known[may], counted_before[may] = is_in, was_in
        # the border: counted once, when both parts are first thought frequent
        yield from gathered.add_border(own[~is_in & ~done])
        named = np.flatnonzero(is_in & ~was_in)
        _, first, counts = np.unique(own[named], return_index=True, return_counts=True)
        at = may[named[first]]
        gathered.add_phrases([heads[k] + b" ".join(low[a:b].tobytes().split()).decode() for k, a, b in zip(lang[at].tolist(), starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)], counts.tolist())


def closed(docs: DataFrame, text_col: str, lang_col: str, most: int, least: int, now: np.ndarray | None, size: int, bucket_bits: int) -> DataFrame:
    """(h, lang, phrase, n): the phrases of up to most words that come at least so many times, exactly, and the words of each language (phrase ""), from the guess on."""
    before, found = None, None
    while True:
        counts = stored(counted(docs, text_col, lang_col, most, least, Guess(now, before, bucket_bits)))
        named = counts.where("phrase is not null")
        found = named if found is None else found.unionByName(named)
        missed = counts.where("phrase is null")
        if missed.isEmpty():
            return found
        before, now = now if now is not None else np.zeros(size // 8, np.uint8), bits_of(missed, size, bucket_bits, now)


def sampled(docs: DataFrame, text_col: str, lang_col: str, share: float, least: int) -> DataFrame:
    """(lang, text): of each text the pieces that a hash of their place chooses, about this share of them, and all that could hold a phrase `least` times by themselves. Pieces, not documents, so that a phrase that few documents repeat has its share too."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            offsets, data = laid_out(batch.column(1))
            bounds = np.union1d(offsets, np.flatnonzero(_ends[data]) + 1)
            sizes = np.diff(bounds)
            chosen = (mix(np.arange(seen, seen + len(sizes), dtype=U) * ODD) >> U(44)) < U(int(share * (1 << 20)))
            chosen |= sizes >= 2 * least
            seen += len(sizes)
            kept = np.zeros(len(bounds), np.int64)
            np.cumsum(sizes * chosen, out=kept[1:])
            text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(kept[np.searchsorted(bounds, offsets)]), pa.py_buffer(np.ascontiguousarray(data[np.repeat(chosen, sizes)]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["lang", "text"])

    return texts_of(docs, text_col, lang_col).mapInArrow(run, "lang string, text string").where("text <> ''")


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a column of texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, least: int = 100, sample: float = SAMPLE) -> DataFrame:
    """(lang, phrase, n): see closed(). sample: the share of pieces that propose; it changes the number of passes, never the result."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bucket_bits = min(32, max(LEAST_BUCKET_BITS, (size // BUCKET_BYTES).bit_length()))
    proposals = closed(stored(sampled(docs, text_col, lang_col, sample, least)), "text", "lang", most, max(2, int(least * sample * SLACK)), None, 1 << 26, bucket_bits)
    keys = proposals.where("phrase <> ''")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(keys.count() * 64).bit_length()))
    return closed(docs, text_col, lang_col, most, least, bits_of(keys, bits, bucket_bits), bits, bucket_bits).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, least: int = 100, top: int = 2000, sample: float = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first `top` phrases of 2 to most words that come a >= least times.

    Words are what stands between blanks and tabs, A-Z in lower case; a phrase never reaches over `.,;:!?` or a line end. Cut behind its first k words a phrase scores floor(1000 a n / (l r)),
    n words of the language, l and r occurrences of both parts; the lowest cut counts, of equal ones the smallest k. Phrases that a longer one holds, as often, are left out.

    Null and empty texts have no words; a null language is `und`. Repeated rows count as often as they stand there. Very long texts are taken in parts that end where pieces end. An
    empty table gives no rows; other columns are left alone. Of equal scores the more frequent phrase comes first, then the smaller by bytes.
    """
    found = stored(frequent_phrases(docs, text_col, lang_col, most, least, sample))
    words = found.where("phrase = ''").select("lang", F.col("n").alias("n_words"))
    known = found.where("phrase <> ''")
    phrases = known.withColumn("w", F.split("phrase", " ", -1)).withColumn("k", F.size("w"))
    # A phrase that is part of a longer one, as often, is part of one that is a word longer, as often.
    parts = phrases.where("k > 2").select("lang", "n", F.explode(F.array(F.array_join(F.expr("slice(w, 1, k - 1)"), " "), F.array_join(F.expr("slice(w, 2, k - 1)"), " "))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.where("k > 1").join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * n")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("transform(sequence(1, k - 1), i -> struct(i as k, array_join(slice(w, 1, i), ' ') as first, array_join(slice(w, i + 1, k - i), ' ') as rest))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", F.col("c.k").alias("k"), F.col("c.first").alias("first"), F.col("c.rest").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words, "lang")
    # 19 and 18 digits: products of 38 at most, and a quotient of whole decimals is cut, not rounded
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n_words as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n_words")).alias("b"))
    best = lowest.select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.n_words").alias("n"), "b.score")
    return best.selectExpr("lang", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank", "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


ORACLE_SQL = r"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  g AS (SELECT lang, s.k, array_to_string(w[i : i + s.k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) s),
  f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100), nw AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
  s AS (SELECT lang, k, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  longer AS (SELECT lang, part, max(n) AS longer FROM (SELECT lang, n, array_to_string(w[1 : k - 1], ' ') AS part FROM s UNION ALL SELECT lang, n, array_to_string(w[2 : k], ' ') FROM s) GROUP BY lang, part),
  c AS (SELECT lang, phrase, n AS a, i, array_to_string(w[1 : i], ' ') AS a1, array_to_string(w[i + 1 : k], ' ') AS a2 FROM (SELECT s.*, unnest(range(1, k)) AS i FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.part = s.phrase WHERE longer.longer IS NULL OR 100 * longer.longer < 100 * s.n)),
  x AS (SELECT c.lang, c.phrase, c.a, c.i, f1.n AS l, f2.n AS r, nw.n, (1000::HUGEINT * c.a * nw.n) // (f1.n::HUGEINT * f2.n) AS score FROM c JOIN f f1 ON f1.lang = c.lang AND f1.phrase = c.a1 JOIN f f2 ON f2.lang = c.lang AND f2.phrase = c.a2 JOIN nw ON nw.lang = c.lang),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM x) WHERE o = 1),
  t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t WHERE rank <= 2000"""
