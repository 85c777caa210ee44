"""Benchmark passages in documents, found by an Aho-Corasick automaton over the words of all benchmark items.

Texts become lower-case words. Every run of so many words of an item is a pattern, the letters of the automaton are the words that items have; it takes a document once from end to end
and names all patterns that occur, overlaps included. Places of words lead back to the original text, so that hits are also spans of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship, stored

#: Words of patterns in an automaton, at the mean: 100 to 200 bytes of memory each. The items of larger benchmarks are dealt to several automata, which take the documents one after another.
MOST_WORDS = 2_000_000

_plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: The words of the original text.
_words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def words_of(text: str) -> list[bytes]:
    """The words in lower case: ASCII letters and digits and whatever is not ASCII, between all else."""
    return text.encode("utf-8", "replace").translate(_plain).split()


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(window, item, n): each run of size words of an item once, all words of an item that has fewer; items without words have none."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.col(item_col).alias("item"), F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    rows = rows.select("item", "w", F.explode(starts).alias("k")).select(F.array_join(F.slice("w", F.col("k"), size), " ").alias("window"), "item", F.least(F.size("w"), F.lit(size)).alias("n"))
    return rows.distinct()


class Matcher:
    """The automaton of some windows: rows (window, item)."""

    def __init__(self, rows: list[tuple[str, object]]):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], tuple[int, list]] = {}
        for window, item in rows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window.encode().split(b" "))
            found.setdefault(key, (len(key), []))[1].append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, x in found.items():
            self.automaton.add_word(key, x)
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs of hit words (first, behind the last) in order, and the items found."""
        ends, sizes, items = [], [], set()
        if len(self.automaton) and words:
            for end, (n, owners) in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
                ends.append(end)
                sizes.append(n)
                items.update(owners)
        behind = np.array(ends, np.int64) + 1
        return united(behind - np.array(sizes, np.int64), behind), items


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs that overlap or touch become one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])].tolist(), strict=True))


_matchers: dict[str, Matcher] = {}


def matcher(rows: Broadcast) -> Matcher:
    """One at a time for each worker."""
    name, windows = rows.value
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(windows)
    return _matchers[name]


def scanned(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows (own, text, found) with what these windows, a bounded number, hit added to found."""
    listed = [(r.window, r.item) for r in windows.select("window", "item").collect()]
    shared = rows.sparkSession.sparkContext.broadcast((hashlib.sha1(repr(sorted(listed, key=str)).encode()).hexdigest(), listed))
    arrow = pa.schema([("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(shared)
        for batch in batches:
            n_words, items, runs = [], [], []
            # text by text, so that only one is held as words
            for text, before in zip(batch.column(1), batch.column(2), strict=True):
                words, before = words_of(text.as_py()), before.as_py()
                hit, owners = m.scan(words)
                if before["runs"]:
                    both = np.array([*hit, *((r["start"], r["end"]) for r in before["runs"])], np.int64)
                    hit = united(both[:, 0], both[:, 1])
                n_words.append(len(words))
                items.append(sorted({*owners, *before["items"]} - {None}))
                runs.append([{"start": a, "end": b} for a, b in hit])
            found = pa.StructArray.from_arrays([pa.array(n_words, arrow.field(0).type), pa.array(items, batch.schema.field(2).type.field("items").type), pa.array(runs, arrow.field(2).type)], fields=[arrow.field(0), pa.field("items", batch.schema.field(2).type.field("items").type), arrow.field(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["own", "text", "found"])

    return rows.mapInArrow(run, rows.schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, keep: tuple[str, ...] = ("doc_id",), as_col: str = "leaks", most_words: int = MOST_WORDS) -> DataFrame:
    """The columns in keep and as_col, a struct(n_words, n_hit, items, runs), for every row of docs.

    A word is hit if it stands in a run of size words that an item has as well, or in all words of an item that has fewer. items: those with such runs, in order, numbers or strings; runs: the hit words
    as (first, behind the last); place_spans() finds them in the original text.

    Null and empty texts have no words, an item without words hits nothing; an empty benchmark or table gives no hits or no rows. Repeated rows are judged alike. Items that repeat an id
    count as one; items of a null id hit words but are not listed. Very long texts are scanned whole, in time in proportion to their length. Names of other columns can't clash.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, size))
    total = windows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // most_words))
    kind = windows.schema["item"].dataType.simpleString()
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{kind}>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep)).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), none.alias("found"))
    for k in range(shards):
        rows = scanned(stored(rows) if k else rows, windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == k) if shards > 1 else windows)
    n_hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    leaks = F.struct("found.n_words", n_hit.alias("n_hit"), "found.items", "found.runs")
    return rows.select(*(F.col("own")[c].alias(c) for c in keep), leaks.alias(as_col))


def place_spans(rows: DataFrame, text_col: str = "text", runs: str = "leaks.runs", as_col: str = "spans") -> DataFrame:
    """rows with runs of words as spans of the original text: (start, end) in characters, from 0. Null texts have none."""
    ship(rows.sparkSession)

    @F.pandas_udf(T.ArrayType(RUN))
    def placed(texts, found):
        import pandas as pd

        out = []
        for text, hit in zip(texts, found, strict=True):
            at = [m.span() for m in _words.finditer(text)] if text and hit is not None and len(hit) else []
            out.append([{"start": at[r["start"]][0], "end": at[r["end"] - 1][1]} for r in hit] if at else [])
        return pd.Series(out)

    return rows.withColumn(as_col, placed(F.col(text_col), F.col(runs)))


ORACLE_SQL = r"""WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM it WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM win),
  hits AS (SELECT doc_id, k, n, win.item_id FROM (SELECT doc_id, n AS m, k, array_to_string(w[k : k + n - 1], ' ') AS text FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM low, sizes WHERE len(w) >= n)) d JOIN win ON win.win = d.text AND win.n = d.m),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
