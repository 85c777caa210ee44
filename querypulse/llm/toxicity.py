"""Toxicity of whole texts by a weighted lexicon.

Texts are folded first: case, accents, letters of other scripts that look Latin, and digits or signs that stand for letters. An Aho-Corasick automaton then
finds the entries, all of which begin at a word; matches inside an exception phrase do not count. The weight found, per hundred words, gives the score.
Entries and weights are learned from labelled rows: words and word beginnings that are far more common in toxic texts.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship, stored, texts

# Letters that look like Latin ones, and signs that stand for letters. i, l and 1 are one class.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɡ": "g", "ɩ": "i", "ı": "i", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
# Entries known without any label, with a weight of DEFAULT_WEIGHT, and phrases in which entries are harmless.
KNOWN = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown", "imbecile", "dumbass", "retard", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof")
DEFAULT_WEIGHT = 3.0

#: About so many labelled rows are learned from (those of the smallest hashes); all if there are fewer.
MAX_TRAIN = 20_000
SHORTEST, LONGEST = 4, 12

_accents = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)] if unicodedata.normalize("NFKD", chr(c))[0] != chr(c)}
_table = _accents | {ord(k): v for k, v in LOOKALIKES.items()} | {ord(" "): " "}
_runs = re.compile(r"(?<![\w@$!|+])[^\W0-9]*+[0-9@$!|+][\w@$!|+]*+")  # runs of letters and signs that hold a sign
_signs_table = str.maketrans(SIGNS)
_last_letter = re.compile("[a-z]")
_words = re.compile(r"[^\W_]+")
_signs = re.compile(r"[0-9@$!|+]")


def letters_for_signs(run: re.Match) -> str:
    """Signs before the last letter of a run stand for letters; so does one right behind it, unless more letters, digits or such signs follow."""
    run = run[0]
    back = _last_letter.search(run[::-1])
    if not back:
        return run
    last = len(run) - 1 - back.start()
    tail = run[last + 1 :]
    if tail[:1] and tail[0] in "0123456789@$" and not (tail[1:2] and (tail[1] in "@$_" or tail[1].isalnum())):
        tail = SIGNS.get(tail[0], tail[0]) + tail[1:]
    return run[:last].translate(_signs_table) + run[last] + tail


def fold(text: str) -> str:
    """Folded words, each between single blanks; in time in proportion to the text, whatever its runs of digits or letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_table)
    if _signs.search(low):
        low = _runs.sub(letters_for_signs, low)
    return f" {' '.join(_words.findall(low))} ".replace("l", "i")


@dataclass(frozen=True)
class ToxicityModel:
    """entries: folded, from a blank on, with weights; shift, slope: of the logistic score over features()."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    shift: float = -3.5
    slope: tuple[float, float, float] = (3.0, 1.0, 0.5)
    n_train: int = 0
    key: str = field(default="", compare=False)

    def automaton(self) -> ahocorasick.Automaton:
        name = sha1(repr((self.entries, self.exceptions)).encode()).hexdigest()
        if name not in _automata:
            _automata.clear()
            a = ahocorasick.Automaton()
            for e, w in self.entries.items():
                a.add_word(e, (e, w))
            for p in self.exceptions:
                phrase = fold(p)
                a.add_word(phrase, (phrase, None))
            a.make_automaton()
            _automata[name] = a
        return _automata[name]


_automata: dict[str, ahocorasick.Automaton] = {}


def matches(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[str, float]]:
    """Entries found, one for each word start (the heaviest), outside of exception phrases."""
    found: dict[int, tuple[str, float]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (entry, weight) in automaton.iter(folded):
            start = end - len(entry) + 1
            if weight is None:
                spared.append((start, end))
            elif start not in found or found[start][1] < weight:
                found[start] = entry, weight
    kept, spared, k, reach = [], sorted(spared), 0, -1
    for start in sorted(found):
        while k < len(spared) and spared[k][0] <= start:
            reach = max(reach, spared[k][1])
            k += 1
        if start >= reach:
            kept.append(found[start])
    return kept


def features(weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Whether there is any weight, the weight per hundred words (at least a hundred), and the weight; on a log scale."""
    return np.stack([np.minimum(weight, 3.0) / 3.0, np.log1p(weight / np.maximum(n_words / 100.0, 1.0)), np.log1p(weight)], 1)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, usable: Column, max_train: int) -> DataFrame:
    """Labelled texts to learn from: (text, y), of ids whose hash is under the bound."""
    marked = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    total = marked.count()
    share = min(1.0, max_train / max(total, 1))
    chosen = marked.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else marked
    # max_train rows at the mean, so the broadcast is bounded
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    return rows.groupBy("_text").agg(F.max("_y").alias("_y"))  # copies would count as evidence over and over


def learn_lexicon(rows: DataFrame, min_docs: int = 6, min_weight: float = 1.5) -> dict[str, float]:
    """Entries from (text, y): word beginnings of 4 to 12 letters and whole shorter words in at least min_docs toxic texts, by the lower end of their log odds (99 %).

    Of a beginning and its continuations the shortest stays if it covers clearly more texts, else the longest.
    """
    counted = T.StructType([T.StructField("e", T.StringType()), T.StructField("n", T.LongType())])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen = set()
                for w in set(fold(text).split()):
                    seen.update([f" {w} "] if len(w) < SHORTEST else [f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1)])
                total.update(seen)
                if len(total) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["e", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["e", "n"])

    toxic = rows.where("_y = 1").select("_text").mapInArrow(beginnings, counted).groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    pos = {r["e"]: r["n"] for r in toxic.collect()}  # bounded by the sample: a text has so many words, and min_docs of them must share one
    if not pos:
        return {}
    raw = sorted(pos)

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for e in raw:
            a.add_word(e, e)
        a.make_automaton()
        total: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                total.update({e for _, e in a.iter(fold(text))})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["e", "n"])

    neg = {r["e"]: r["n"] for r in rows.where("_y = 0").select("_text").mapInArrow(clean_counts, counted).groupBy("e").agg(F.sum("n").alias("n")).collect()}
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    odds = lambda p, q: np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1)) - 2.58 * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    weight = {e: float(odds(p, neg.get(e, 0))) for e, p in pos.items()}
    strong = sorted(e for e, w in weight.items() if w >= min_weight)  # a beginning stands right before its continuations
    kept: dict[str, float] = {}
    for k, e in enumerate(strong):
        if any(e.startswith(x) for x in (e[:n] for n in range(2, len(e))) if x in kept):
            continue
        longest = 0
        for other in itertools.takewhile(lambda x: x.startswith(e), itertools.islice(strong, k + 1, None)):  # noqa: B023
            longest = max(longest, pos[other])
        if longest < 0.9 * pos[e]:
            kept[e] = weight[e]
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn a lexicon and the score's four numbers from labelled rows for which usable holds.

    Null ids or labels, ids without a text and labels of no document are left out; of repeated labels the largest counts. Without labelled rows the model is the known
    entries alone. Only the named columns are read.
    """
    ship(docs.sparkSession)
    rows = stored(training_rows(docs, labels, label_col, id_col, text_col, F.lit(True) if usable is None else usable, max_train))
    entries = {f" {fold(w).strip()}": DEFAULT_WEIGHT for w in KNOWN} | learn_lexicon(rows)
    model = ToxicityModel(entries, exceptions)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            found = [fold(t) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sum(w for _, w in matches(a, f)) for f in found], pa.float64()), pa.array([float(f.count(" ") - 1) for f in found], pa.float64())], names=["y", "w", "n"])

    seen = rows.mapInArrow(weigh, "y int, w double, n double").toPandas()  # three numbers for each row of the bounded sample
    if not len(seen) or seen["y"].nunique() < 2:
        return model
    x, y = features(seen["w"].to_numpy(), seen["n"].to_numpy()), seen["y"].to_numpy(float)
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    b = np.zeros(4)
    ridge = np.diag([1e-3, 1.0, 1.0, 1.0])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(entries, exceptions, float(b[0]), (float(b[1]), float(b[2]), float(b[3])), len(seen))


SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """A struct (score 0 to 1, n_words, weight, hits: entries found, folded). Null and empty texts have no words and the score of a text without hits."""

    def run(column: pd.Series) -> pd.DataFrame:
        a = model.automaton()
        found = [fold(t or "") for t in column]
        hits = [matches(a, f) for f in found]
        n = np.array([max(0, f.count(" ") - 1) if f.strip() else 0 for f in found], np.int64)
        w = np.array([sum(x for _, x in h) for h in hits], float)
        z = model.shift + (features(w, n) @ np.array(model.slope) if len(w) else w)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "n_words": n, "weight": w, "hits": [[e.strip() for e, _ in h] for h in hits]})

    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, SCORE)(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3, as_col: str = "toxicity") -> DataFrame:
    """All rows and columns, and as_col: a struct of SCORE and predicted (1 if the score reaches the threshold, else 0). A column of that name is replaced."""
    ship(docs.sparkSession)
    scored = docs.withColumn(as_col, toxicity(F.col(text_col).cast("string"), model))
    return scored.withColumn(as_col, F.col(as_col).withField("predicted", (F.col(as_col)["score"] >= threshold).cast("int")))
