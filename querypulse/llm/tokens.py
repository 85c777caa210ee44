"""Exact token counts at every prefix of a text, by dynamic programming over the positions of a byte-pair vocabulary.

In BPE a sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their
own concatenation. So each prefix has one encoding, and its last token follows from the shorter prefixes: it is the one token that
ends there and fits the last token of the prefix before it. One pass therefore counts the tokens of all prefixes.
Pre-tokenisation bounds the work: a count never crosses a piece, and pieces repeat, so their counts are kept by worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shipping import ship, texts

# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Chunks that a worker remembers (some 200 bytes each); beyond that it starts anew, which costs time and changes no result.
REMEMBERED = 1_500_000
#: A chunk of more characters is counted on its own and not remembered.
LONG_CHUNK = 4_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def runs(numbers: Iterable[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


class PrefixCounter:
    """Token counts of all prefixes under one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        raw = lambda t: bytes(letters[c] for c in t)
        self.merges = {(self.vocab[raw(a)], self.vocab[raw(b)]): (n, self.vocab[raw(a) + raw(b)]) for n, (a, b) in enumerate(pairs)}
        self.library = Tokenizer.from_file(path).pre_tokenizer
        old = unicodedata.ucd_3_2_0
        self.newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs(c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and old.category(chr(c)) == "Cn")) + "]")
        self.kinds: dict[str, str] = {}
        #: For tokens that one merge makes: its rank and the two parts. Bytes have no parts and come before any merge.
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in self.merges.items()}
        self.single = len(self.made) == len(self.merges)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.ends = ahocorasick.Automaton()  # gives the tokens that end at each byte
        for b, i in self.vocab.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self.pattern, self.blank = regex.compile(PATTERN), regex.compile(r"\s+")
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, array] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE by rank; used on two tokens at a time only."""
        ids = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, at = min((self.merges.get((a, b), (1 << 60,))[0], k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE keeps the boundary between two tokens: merges are undone from the latest on, and none across the boundary may come before them."""
        if not self.single:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        limit = 1 << 60  # a merge across the boundary counts only if it comes before those that are undone already
        while True:
            across = self.merges.get((left, right))
            if across and across[0] < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:  # of equal ranks the left one is merged first, so the right one is undone first
                limit, right = b[0] + 1, b[1]

    def piece(self, text: str) -> array:
        """Counts at each character prefix (from 1) of one piece, in time and memory in proportion to its length and the tokens in it."""
        data = text.encode()
        n, fits = len(data), self.fits
        last, count, done = [-1] * (n + 1), [0] * (n + 1), -1
        for end, (token, length) in self.ends.iter(data.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - length
            pair = last[start], token
            ok = fits.get(pair)
            if ok is None:
                if len(fits) >= 2 * REMEMBERED:
                    fits.clear()
                ok = fits[pair] = self.fit(*pair) if start else self.merged(self.bytes_of[token]) == [token]
            if ok:
                done = end
                last[end + 1] = token
                count[end + 1] = count[start] + 1
        if n == len(text):
            return array("i", count[1:])
        return array("i", [count[e] for e in range(1, n + 1) if e == n or data[e] & 0xC0 != 0x80])

    def shape(self, text: str) -> str:
        """The text with characters that are newer than Unicode 3.2 as a letter, digit or mark, whichever the library takes them for."""

        def kind(m: re.Match) -> str:
            c = m[0]
            if c not in self.kinds:
                pieces = {p for p, _ in self.library.pre_tokenize_str(f"a{c}")}, {p for p, _ in self.library.pre_tokenize_str(f"1{c}")}, {p for p, _ in self.library.pre_tokenize_str(f"!{c}")}
                self.kinds[c] = next((k for k, p in zip("a1!", pieces, strict=True) if len(p) == 1), c)
            return self.kinds[c]

        return self.newer.sub(kind, text)

    def known(self, piece: str) -> array:
        found = self.pieces.get(piece)
        if found is None:
            found = self.piece(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= REMEMBERED // 8:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at each prefix of a text without special strings, whatever its white space."""
        out = np.zeros(len(text), np.int64)
        total, blank_to = 0, 0
        for m in self.pattern.finditer(self.shape(text)):
            a, b = m.span()
            word = text[a:b]
            counts = self.known(word)
            lead = len(word) if self.blank.fullmatch(word) else int(word[0] == " ")
            if lead and a >= blank_to:  # a prefix that ends in white space has the run so far as its last piece, so one table of the whole run answers for them all
                run = self.blank.match(text, a)[0]
                blank_to = a + len(run)
                out[a:blank_to] = np.asarray(self.known(run)) + total
            if lead < len(word):
                out[a + lead : b] = np.asarray(counts[lead:]) + total
                if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction that is cut
                    out[a] = total + self.known("'")[-1]
                    if len(word) > 2:
                        out[a + 1] = out[a] + self.known(word[1])[-1]
            total += counts[-1]
        return out

    def chunk(self, text: str) -> bytes:
        """Counts of a chunk of prefixes(), as unsigned 16-bit numbers: white space stands only before its first word."""
        if text[1:].isalpha() and text[0] == " ":
            return array("H", self.piece(text)).tobytes()  # a chunk is remembered as such
        if "'" in text:
            return array("H", self.ordinary(text).tolist()).tobytes()
        counts = array("H")
        for word in self.pattern.findall(text):
            if word[0] == " " and word[1:].isalpha():
                found = self.chunks.get(word[1:])
                if found is None:
                    found = self.chunks[word[1:]] = self.chunk(word)
                found = array("H", found)
            else:
                found = self.known(word)
            if counts:
                total = counts[-1]
                counts.extend([total + x for x in found])
            else:
                counts = array("H", found)
        return counts.tobytes()

    def prefixes(self, text: str) -> np.ndarray:
        """Counts at each character prefix (from 1); exactly what the library gives for text[:k], without added tokens."""
        if not text:
            return np.zeros(0, np.int64)
        words = text.split()
        if any(s in text for s in self.special) or words != text.replace("\n", " ").split(" ") or max(map(len, words)) > LONG_CHUNK or not text.isascii() and self.newer.search(text):
            return self.mixed(text)
        # Only single blanks and line ends between words: pieces never cross them, so the text falls into chunks that repeat.
        first, *rest = text.replace("\n", " \n").split(" ")
        chunks = self.chunks
        if len(chunks) >= REMEMBERED:
            chunks.clear()
        parts = list(map(chunks.get, rest))
        if None in parts:
            for k in [k for k, p in enumerate(parts) if p is None]:
                c = rest[k]
                parts[k] = chunks[c] = self.chunk(c if c[0] == "\n" else " " + c)
        parts.insert(0, self.chunk(first))
        inside = np.frombuffer(b"".join(parts), np.uint16)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 1
        totals = inside[np.cumsum(lengths) - 1].astype(np.int64)
        return inside + np.repeat(np.cumsum(totals) - totals, lengths)

    def mixed(self, text: str) -> np.ndarray:
        """Any text; special strings count as one token each, as the library does by default."""
        if not self.special:
            return self.ordinary(text)
        parts, total = [], 0
        cut = regex.compile("|".join(map(regex.escape, self.special)))
        at = 0
        for m in cut.finditer(text):
            here = self.ordinary(text[at : m.end() - 1])  # while it is incomplete, the special string is plain text
            before = int(here[m.start() - at - 1]) if m.start() > at else 0
            parts += [here + total, np.array([total + before + 1])]
            total, at = total + before + 1, m.end()
        parts.append(self.ordinary(text[at:]) + total)
        return np.concatenate(parts)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter by worker and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, ...] = (512,), with_prefixes: bool = False) -> DataFrame:
    """Count tokens of whole texts and of all their prefixes.

    Returns for each row: id_col, n_bytes (UTF-8), n_chars, n_tokens, cuts (for each limit the length in characters of the longest prefix of at
    most so many tokens) and, if with_prefixes, prefix_counts: array<int>, item k-1 for the first k characters (see count_at, longest_prefix).

    A null or empty text has 0 tokens and an empty array. Null ids and repeated rows stay, one row each. An empty table gives an empty
    result. Columns other than the two named are not read, so they may have any name. Very long texts take memory in proportion to their length.
    """
    ship(docs.sparkSession)
    limits = tuple(int(x) for x in limits)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType()))]
    if with_prefixes:
        fields.append(T.StructField("prefix_counts", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n_bytes, n_chars, n_tokens, cuts, kept = [], [], [], [], []
            for text in texts(batch.column(1)):
                p = count.prefixes(text)
                n_bytes.append(len(text.encode()))
                n_chars.append(len(text))
                n_tokens.append(int(p[-1]) if len(p) else 0)
                cuts.append([len(p) - int(np.argmax(p[::-1] <= x)) if len(p) and (p <= x).any() else 0 for x in limits])
                if with_prefixes:
                    kept.append(p.astype(np.int32))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))]
            if with_prefixes:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))


def count_at(prefix_counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars characters; 0 for none, the whole text beyond its end."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(prefix_counts))
    return F.when(n <= 0, F.lit(0)).otherwise(F.try_element_at(prefix_counts, n.cast("int")))


def longest_prefix(prefix_counts: Column, budget: Column | int) -> Column:
    """Length in characters of the longest prefix of at most budget tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(prefix_counts, lambda x, i: F.when(x <= limit, i + 1).otherwise(F.lit(0)))), F.lit(0))
