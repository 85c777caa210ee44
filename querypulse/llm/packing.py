"""Hierarchical packing of tokenised documents into windows of a few lengths.

Every document is cut into full windows and a rest; the rest is routed to the smallest tier that holds it and packed in windows of that tier's size. Tiers are packed from the longest
down, so that gaps in long windows take documents of shorter tiers (best fit); the shortest tier fills what is left, cut where needed, and its own windows. What remains at the end
of a partition becomes windows of powers of two. Windows of a block are then dealt into step groups of even attention cost.
Each input partition packs its own documents in blocks of bounded size: no shuffle, no state that grows with the table.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship, texts

#: Words that a worker remembers the ids of; beyond that it starts anew.
REMEMBERED = 600_000
#: Tokens that are packed together in a task.
BLOCK = 2_000_000


class WordIds:
    """Ids by word, for vocabularies whose pieces never hold a blank or line end; each word goes through the tokenizers library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {"": b""}
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that close a piece
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def add(self, words: list[str]) -> None:
        """Words of plain letters are one piece each, so they go through the library as one line, told apart by the ids that close a piece."""
        plain = [w for w in words if self.plain.fullmatch(w)]
        line = np.array(self.library.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
        if len(stops := np.flatnonzero(self.ends[line]) + 1) == len(plain):
            raw, at = line.tobytes(), [0, *(4 * stops).tolist()]
            self.known.update((w, raw[a:b]) for w, a, b in zip(plain, at, at[1:], strict=False))
            words = [w for w in words if w not in self.known]
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        known = self.known
        words = text.replace("\n", " ").split(" ")
        parts = list(map(known.get, words))
        if None in parts:
            if len(known) > REMEMBERED:
                known.clear()
                known[""] = b""
            missing = {w for w, p in zip(words, parts, strict=True) if p is None}
            # a word of plain letters, which lower-casing leaves letters, and the mark after it are pieces of their own
            stems = {w: (w[:-1], w[-1]) for w in missing if w[-1] in ",." and self.plain.fullmatch(w[:-1])}
            if lacking := [w for w in {*(missing - stems.keys()), *(x for pair in stems.values() for x in pair)} if w not in known]:
                self.add(lacking)
            known.update((w, known[a] + known[b]) for w, (a, b) in stems.items())
            parts = [known[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


Piece = tuple[int, int, int]  # document of the block, start, length


def fit(rests: list[Piece], window: int, tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows for pieces shorter than window, each full at its tier's size; and the pieces of one that is not."""
    sizes = (*tiers, window)
    by_tier: list[list[Piece]] = [[] for _ in sizes]
    for p in rests:
        by_tier[bisect_left(sizes, p[2])].append(p)
    windows: list[list[Piece]] = []
    gaps: list[tuple[int, int]] = []  # gap, window; ascending
    for size, tier in zip(sizes[:0:-1], by_tier[:0:-1], strict=True):
        for p in sorted(tier, key=lambda p: (-p[2], p)):
            k = bisect_left(gaps, (p[2], -1))
            gap, w = gaps.pop(k) if k < len(gaps) else (size, len(windows))
            if w == len(windows):
                windows.append([])
            windows[w].append(p)
            if gap > p[2]:
                insort(gaps, (gap - p[2], w))
    filler = sorted(by_tier[0], key=lambda p: (p[2], p))  # the longest is taken first
    left: list[Piece] = []
    while gaps:
        gap, w = gaps.pop(0)
        while gap:
            if not filler:
                if not gaps:
                    left, windows[w] = windows[w], []
                    break
                filler = windows[gaps[-1][1]]  # the emptiest window goes to fill the others
                windows[gaps.pop()[1]] = []
            d, start, n = filler.pop()
            windows[w].append((d, start, min(n, gap)))
            if n > gap:
                filler.append((d, start + gap, n - gap))
            gap -= min(n, gap)
    while filler:
        room, new = sizes[0], []
        while room and filler:
            d, start, n = filler.pop()
            new.append((d, start, min(n, room)))
            if n > room:
                filler.append((d, start + room, n - room))
            room -= min(n, room)
        if room:
            left = new
        else:
            windows.append(new)
    return [w for w in windows if w], left


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut a window that is not full into windows of powers of two."""
    out, pieces, total = [], pieces[::-1], sum(p[2] for p in pieces)
    while total:
        room = size = 1 << total.bit_length() - 1
        new = []
        while room:
            d, start, n = pieces.pop()
            new.append((d, start, min(n, room)))
            if n > room:
                pieces.append((d, start + room, n - room))
            room -= min(n, room)
        out.append(new)
        total -= size
    return out


def step_groups(costs: list[int], group: int) -> list[int]:
    """The group of each window, group windows in one at most: the dearest windows first, each to the cheapest group that has room."""
    groups = [(0, 0, k) for k in range(-(-len(costs) // group))]  # cost, windows, number
    out = [0] * len(costs)
    for w in sorted(range(len(costs)), key=lambda w: (-costs[w], w)):
        cost, n, k = heappop(groups)
        out[w] = k
        if n + 1 < group:
            heappush(groups, (cost + costs[w], n + 1, k))
    return out


def pack_hierarchical(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, tiers: tuple[int, ...] = (256, 512, 1024), end_id: int | None = 1, group: int = 8, with_ids: bool = False
) -> DataFrame:
    """Pack all documents; a row for each piece.

    Returns id_col, start (ids of the document before it), length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, tier (the
    smallest of tiers and window that holds the sequence), step_group (sequences of a group go into one step; group of them, of even attention cost),
    sequence_tokens and, if with_ids, ids: array<int>. window and tiers are powers of two. A sequence is full at the size of a tier or of window or, at the end of a partition, at a smaller power of two.

    A null or empty text is its end id alone; without end_id it gives no row. Null ids and repeated rows are packed as documents of their own. An empty table gives an
    empty result. Other columns are not read. A very long text is cut into full windows as any other; a task holds BLOCK tokens or one document if that is longer.
    """
    if any(x & (x - 1) or x < 1 for x in (*tiers, window)) or sorted({*tiers, window}) != [*tiers, window]:
        raise ValueError("window and tiers must be powers of two, tiers ascending and smaller")
    ship(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "sequence_tokens"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = word_ids(tokenizer)
        top = TaskContext.get().partitionId() << 32
        made = 0
        keys: list = []
        ids: list[bytes] = []
        carried: list[Piece] = []
        pending = 0

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, keys, ids, carried, pending
            lengths = [len(x) >> 2 for x in ids]
            full = [[(d, k, window)] for d, n in enumerate(lengths) if (d,) not in whole for k in range(0, n - n % window, window)]
            rests = [(d, n - n % window, n % window) for d, n in enumerate(lengths) if n % window and (d,) not in whole] + carried
            packed, left = fit(rests, window, tiers)
            packed = full + packed
            carried = []
            if left and last:
                packed += powers(left)
            elif left:
                carried = left
            row = step_groups([sum(p[2] ** 2 for p in pieces) for pieces in packed], group)
            out: dict[str, list] = {n: [] for n in ["key", *names, "ids"]}
            for w, pieces in enumerate(packed):
                offset, total = 0, sum(p[2] for p in pieces)
                for d, start, n in pieces:
                    part = ids[d][4 * start : 4 * (start + n)]
                    tier = next((t for t in tiers if t >= total), window)
                    for name, v in zip(["key", *names], (keys[d], start, n, zlib.crc32(part), lengths[d], top + made + w, offset, tier, top + made + row[w], total), strict=True):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                    offset += n
            made += len(packed)
            held = sorted({p[0] for p in carried})
            new = {d: k for k, d in enumerate(held)}
            keys, ids, carried = [keys[d] for d in held], [ids[d] for d in held], [(new[d], s, n) for d, s, n in carried]
            whole.clear()
            whole.update((k,) for k in range(len(held)))  # their windows are out already
            pending = 0
            if out["key"]:
                columns = [pa.array(out["key"], kind), *(pa.array(out[n], pa.int64()) for n in names)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else []), names=schema.fieldNames())

        whole: set[tuple[int]] = set()
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = find.ids(text) + tail
                if not found:
                    continue
                keys.append(key)
                ids.append(found)
                pending += len(found) >> 2
                if pending >= BLOCK:
                    yield from block(False)
        yield from block(True)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
