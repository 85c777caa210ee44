"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querypulse.llm import line_dedup, lm, media, packing, toxicity
from querypulse.llm.ann import graph_search, neighbour_graph
from querypulse.llm.components import connected_components
from querypulse.llm.line_dedup import dedup_lines, within_edits
from querypulse.llm.lm import score_texts
from querypulse.llm.mixing import mix_sources, temperature_weights
from querypulse.llm.ngram_join import ngram_components
from querypulse.llm.packing import fit, pack_hierarchical, powers
from querypulse.llm.queries import QUERIES
from querypulse.llm.quotes import link_quotes, unquoted_conversations
from querypulse.llm.tokens import PrefixCounter, count_at, longest_prefix, prefix_token_counts
from querypulse.llm.toxicity import fit_toxicity, fold, score_toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD_ROWS = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id"), (4, "word " * 3000)]
SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    """With extra columns whose names clash with what operators make."""
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA + ", n_tokens long, page string, _text int")


def test_prefix_counts_are_the_librarys():
    c, t = PrefixCounter(BYTE), Tokenizer.from_file(BYTE)
    random.seed(1)
    parts = ["'", "'re", "'s", " ", "  ", "\n", "the", "ing", "1", "é", "ß", "<|endoftext|>", "<|endo", "!", "日本", "\t", " ", "😀", "'ll", "-----", "\r\n", "\x85", "\x1c", "՘", "₏"]
    for _ in range(200):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert c.prefixes(s).tolist() == [len(t.encode(s[:k], add_special_tokens=False).ids) for k in range(1, len(s) + 1)], repr(s)


def test_prefix_counts_of_long_runs():
    """Runs of white space, signs and letters take time in proportion to their length."""
    c, t = PrefixCounter(BYTE), Tokenizer.from_file(BYTE)
    began = time.time()
    for s in (" " * 1_000_000, " \t" * 200_000, "\n" * 200_000 + "x", "-" * 200_000, "a" * 200_000):
        p = c.prefixes(s)
        assert len(p) == len(s) and p[-1] == len(t.encode(s, add_special_tokens=False).ids) and p[4999] == len(t.encode(s[:5000], add_special_tokens=False).ids)
    assert time.time() - began < 30


def test_prefix_counts_of_odd_rows(spark):
    rows = prefix_token_counts(frame(spark, ODD_ROWS), BYTE, limits=(5, 512), with_prefixes=True)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.cuts) for r in rows.collect()), key=str)
    t = Tokenizer.from_file(BYTE)
    assert [(i, n) for i, _, n, _ in got] == sorted([(i or 0, len(t.encode(x or "").ids)) for i, x in ODD_ROWS], key=str)
    r = rows.where("doc_id = 4").select("n_tokens", count_at(F.col("prefix_counts"), 10).alias("ten"), longest_prefix(F.col("prefix_counts"), 512).alias("cut"), F.col("cuts")[1].alias("cut2")).first()
    assert r.ten == len(t.encode(("word " * 3000)[:10]).ids) and r.cut == r.cut2 and len(t.encode(("word " * 3000)[: r.cut]).ids) <= 512
    assert prefix_token_counts(frame(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("scheme", list(media.PACK))
@pytest.mark.parametrize("tile", [None, 16, 48])
def test_tiff_round_trip(scheme, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 4, shape).astype(np.uint8) for shape in ((1, 1), (33, 70), (40, 17, 3), (300, 64))]
    for predictor in (1, 2):
        back = media.pages_of(media.write_tiff(pages, scheme, predictor, 7, tile))
        assert [(p["number"], p["of"], p["error"], p["pixels"]) for p in back] == [(k, 4, None, p.tobytes()) for k, p in enumerate(pages)]


def test_tiff_codecs_and_faults():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 127, 128, 129, 5000):
        for k in (1, 2, 200):
            b = bytes(rng.integers(0, k, n).astype(np.uint8))
            assert media.unpackbits(media.packbits(b)) == b and media.unlzw(media.lzw(b)) == b
    assert media.pages_of(None) == [] and media.pages_of(b"junk....")[0]["error"] == "not a TIFF"
    whole = media.write_tiff([np.zeros((64, 64), np.uint8)])
    assert all(p["error"] for p in media.pages_of(whole[:40])) and media.pages_of(whole, 100)[0]["error"]


def tiff_by_hand(order, tags, strips):
    """A TIFF of one page from plain tags; strips: their bytes, tag 273 and 279 are filled in."""
    head = (b"II*\0" if order == "<" else b"MM\0*")
    at, offsets = 8, []
    for x in strips:
        offsets.append(at)
        at += len(x)
    tags = tags | {273: ("I", offsets), 279: ("I", [len(x) for x in strips])}
    later, entries, end = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (letter, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(raw) > 4:
            later, raw = later + raw, struct.pack(f"{order}I", end + len(later))
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack(f"{order}I", at) + b"".join(strips) + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0" + later


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_kinds_that_are_only_read(order):
    """1 bit, 16 bits, planes of their own, both byte orders."""
    rng = np.random.default_rng(1)
    base = lambda w, h, bits, n=1: {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [bits] * n), 259: ("H", [1]), 277: ("H", [n]), 278: ("H", [h])}
    one = rng.integers(0, 2, (5, 13)).astype(np.uint8)
    page = media.pages_of(tiff_by_hand(order, base(13, 5, 1), [np.packbits(one, axis=1).tobytes()]))[0]
    assert page["pixels"] == one.tobytes() and page["bits"] == 1
    wide = rng.integers(0, 65536, (4, 6)).astype(np.uint16)
    for predictor in (1, 2):
        stored = wide if predictor == 1 else np.concatenate((wide[:, :1], np.diff(wide, axis=1)), axis=1).astype(np.uint16)
        page = media.pages_of(tiff_by_hand(order, base(6, 4, 16) | {317: ("H", [predictor])}, [stored.astype(f"{order}u2").tobytes()]))[0]
        assert page["pixels"] == wide.tobytes() and page["error"] is None
    colour = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    page = media.pages_of(tiff_by_hand(order, base(5, 3, 8, 3) | {284: ("H", [2])}, [colour[:, :, k].tobytes() for k in range(3)]))[0]
    assert page["pixels"] == colour.tobytes() and page["samples"] == 3
    bomb = tiff_by_hand(order, base(5, 3, 8) | {259: ("H", [8])}, [zlib.compress(b"x" * 10_000_000)])
    assert media.pages_of(bomb)[0]["pixels"] == b"x" * 15


def test_tiff_table(spark):
    stored = media.encode_payloads(frame(spark, ODD_ROWS))
    rows = media.decode_tiff(stored, keep=("doc_id", "n_bytes", "media")).select("doc_id", "n_bytes", "page.*").collect()
    assert len(rows) == len(ODD_ROWS) and all(r.error is None and len(r.pixels) % 64 == 0 and r.pixels for r in rows)
    assert {bytes(r.pixels)[: r.n_bytes].decode() for r in rows} == {x or "" for _, x in ODD_ROWS}
    with pytest.raises(ValueError):
        media.decode_tiff(stored, keep=("page",))


def test_packing_fits():
    random.seed(2)
    for _ in range(100):
        rests = [(d, 0, random.randint(1, 2047)) for d in range(random.randint(0, 60))]
        windows, left = fit(rests, 2048, (256, 512, 1024))
        pieces = sorted(p for w in [*windows, left] for p in w)
        at = {}
        for d, start, n in pieces:
            assert start == at.get(d, 0)
            at[d] = start + n
        assert at == {d: n for d, _, n in rests} and all(sum(p[2] for p in w) in (256, 512, 1024, 2048) for w in windows)
        assert all((n := sum(p[2] for p in w)) & (n - 1) == 0 for w in powers(left)) and sum(p[2] for w in powers(left) for p in w) == sum(p[2] for p in left)


def test_packing_tiers(spark, monkeypatch):
    """Each tier has windows of its size, whole documents mostly; step groups cost about the same; pieces carried over blocks stay in order."""
    monkeypatch.setattr(packing, "BLOCK", 20_000)
    random.seed(13)
    t = Tokenizer.from_file(WORD)
    rows = [(k, " ".join(random.choice(["tree", "river", "stone", "sky"]) for _ in range(random.choice([100, 300, 300, 300, 300, 700, 1500, 3000])))) for k in range(160)]
    made = pack_hierarchical(spark.createDataFrame(rows, SCHEMA).coalesce(1), WORD, with_ids=True).toPandas()
    sizes = made.groupby("sequence_id").agg(n=("length", "sum"), tier=("tier", "first"), group=("step_group", "first"))
    assert {256, 512, 1024, 2048} <= set(sizes.n) and (sizes.n <= sizes.tier).all() and (sizes.n == sizes.tier).mean() > 0.9
    for k, text in rows:
        mine = made[made.doc_id == k].sort_values("start")
        assert [x for ids in mine.ids for x in ids] == [*t.encode(text, add_special_tokens=False).ids, 1] and mine.start.tolist() == [0, *mine.length.cumsum()[:-1]]


def test_step_groups():
    random.seed(15)
    costs = [random.choice([256, 512, 1024, 2048]) * random.randint(100, 2000) for _ in range(801)]
    rows = packing.step_groups(costs, 8)
    by = Counter()
    for c, k in zip(costs, rows, strict=True):
        by[k] += c
    assert max(Counter(rows).values()) <= 8 and len(by) == 101 and max(by.values()) <= 1.5 * sum(costs) / 101 and packing.step_groups([], 8) == []


def test_packing_ids_are_the_librarys():
    """Letters whose lower case is no letter, marks that stand alone or compose, letters of other scripts, all punctuation."""
    random.seed(14)
    t, w = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    parts = ["İ", "KAYSERİ", "a\u0301", "\u0307", "e\u0308.", "ſ", "ß", "ŉ", "ǰ", "日本", "\u0345", "ñ", "É", "İ,", "n't", "'s", "12", "3.5", "x", "Word", "…", "—", "\xa0", "\t", "\u200d", "ﬁ", "Å", "Ω", "🙂"] + list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    strings = ["".join(random.choice(parts) + random.choice(["", "", " ", ",", ".", "\n"]) for _ in range(random.randint(0, 8))) for _ in range(20_000)]
    for s in strings:
        want = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(w.ids(s), "<u4").tolist() == want, repr(s)


def test_packing_table(spark):
    rows = pack_hierarchical(frame(spark, ODD_ROWS), WORD, with_ids=True).collect()
    t = Tokenizer.from_file(WORD)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in ODD_ROWS)
    whole: dict = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i in {r.doc_id for r in rows}:
        whole[i] = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id)) for x in r.ids]
    assert sum(map(len, whole.values())) == sum(len(k[1]) * n for k, n in want.items())
    assert tuple(whole[4]) in {k[1] for k in want if k[0] == 4}
    for s in {r.sequence_id for r in rows}:
        parts = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and (total := sum(n for _, n in parts)) <= 2048 and total & (total - 1) == 0
    assert pack_hierarchical(frame(spark, []), WORD).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}


def brute_components(rows, size, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("block", [2_000_000, 150])
def test_ngram_join_is_brute_force(spark, block):
    random.seed(3)
    words = [f"w{k}" for k in range(40)]
    base = [[random.choice(words) for _ in range(random.randint(1, 60))] for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((k, (" " if k % 3 else "\n").join(w).upper() if k % 5 == 0 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "Ä b"), (504, "ä b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows), size=4, percent=85, block_shingles=block).collect()}
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(frame(spark, ODD_ROWS)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 1, 4)], key=str)
    assert ngram_components(frame(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, most):
    s = list(text)
    for _ in range(random.randint(0, most)):
        k = random.randrange(len(s) + 1)
        if (o := random.random()) < 0.34:
            s.insert(k, random.choice("abcé"))
        elif k < len(s):
            s[k : k + 1] = [] if o < 0.67 else [random.choice("abcd")]
    return "".join(s)


def test_banded_distance(spark):
    random.seed(5)
    pairs = [(a, edited(a, 3)) for a in ("".join(random.choice("abcdé ") for _ in range(random.randint(0, 30))) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2):
        assert all(r.w == (distance(r.a, r.b) <= k) for r in df.select("a", "b", within_edits(F.col("a"), F.col("b"), k).alias("w")).collect())


def low(n):
    step = 1 << max(0, n.bit_length() - 2)
    return n - n % step


def brute_lines(rows, most, per, unit, min_chars=1):
    """Texts without the lines that are not the first of their class, every line against every other."""
    cut = (lambda x: x.split(" ")) if unit == "word" else list
    lines = sorted({y for _, t in rows for x in (t or "").split("\n") if len(y := x.strip(" ")) >= min_chars})
    of = {x: x for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            a, b = cut(x), cut(y)
            allowed = min(most, low(min(len(a), len(b))) // per)
            if of[x] != of[y] and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed:
                gone, stay = of[x], of[y]
                of = {k: stay if v == gone else v for k, v in of.items()}
    seen, want = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for at, x in enumerate((t or "").split("\n")):
            kind = of.get(x.strip(" "))
            if kind is None or seen.setdefault(kind, (d, at)) == (d, at):
                kept.append(x)
        want.append((d, None if t is None else "\n".join(kept)))
    return Counter(want)


@pytest.mark.parametrize("most", [1, 2])
def test_line_dedup_is_brute_force(spark, most):
    random.seed(6)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(30, 50))) for _ in range(20)]
    rows = [(d, "\n".join(edited(random.choice(base), 2) if random.random() < 0.8 else "short" for _ in range(5))) for d in range(40)] + [(90, None), (91, ""), (92, base[0]), (92, base[0])]
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, rows), max_edits=most, units_an_edit=4, unit="char", min_chars=30).collect()]
    assert Counter(got) == brute_lines(rows, most, 4, "char", 30)
    assert dedup_lines(frame(spark, [])).count() == 0


def reworded(words, most, pool):
    w = list(words)
    for _ in range(random.randint(0, most)):
        k, o = random.randrange(len(w) + 1), random.random()
        if o < 0.3:
            w.insert(k, random.choice(pool))
        elif k < len(w):
            w[k : k + 1] = [] if o < 0.5 else [random.choice(pool)]
    return " ".join(w)


@pytest.mark.parametrize(("most", "few"), [(2, 16), (3, 3)])
def test_line_dedup_of_words_is_brute_force(spark, monkeypatch, most, few):
    """Words as units, lines of all classes' ends, frequent words, short lines, and templates: many lines that share most of their words and are no copies. With few = 3 groups are refined."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    random.seed(most)
    pool = [f"w{k}" for k in range(60)] + ["a", "b"] * 20
    base = [[random.choice(pool) for _ in range(n)] for n in (1, 2, 5, 7, 8, 11, 12, 13, 15, 16, 17, 23, 24, 25, 31, 32, 33, 47, 48, 49, 64, 90, 130)]
    template = [random.choice(pool) for _ in range(40)]
    rows = []
    for d in range(40):
        here = [reworded(random.choice(base), 3, pool) for _ in range(4)]
        t = list(template)
        for k in range(20, 20 + random.randint(1, 9)):
            t[k] = f"x{random.randrange(30)}"
        rows.append((d, "\n".join([*here, "  " + " ".join(t), "", "}"])))
    rows += [(90, None), (91, ""), (92, "a  b\na  b "), (93, "a  b\n  ")]
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, rows), max_edits=most, units_an_edit=8).collect()]
    assert Counter(got) == brute_lines(rows, most, 8, "word")


def test_line_dedup_of_many_edits_is_brute_force(spark):
    """An edit for 32 characters, up to 8."""
    random.seed(11)
    base = ["".join(random.choice("abcdefgh ") for _ in range(n)).strip().ljust(30, "x") for n in (34, 63, 64, 70, 130, 200, 257, 300, 420)]
    rows = [(k, x) for k, x in enumerate(sorted({edited(x, 10).strip() for x in base for _ in range(14)}))]
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, rows), max_edits=8, units_an_edit=32, unit="char").collect()]
    want = brute_lines(rows, 8, 32, "char")
    assert Counter(got) == want and 9 < sum(x != "" for _, x in want) < len(rows)


def test_line_dedup_of_long_lines_and_odd_rows(spark):
    long = " ".join(f"w{k % 997}" for k in range(20_000))
    rows = [(1, long), (2, long + " more"), (3, "x\n" + long.replace("w5 ", "", 1)), (4, "yes"), (5, " yes\n\n\n"), (None, "yes"), (None, None), (6, long[:-4])]
    docs = spark.createDataFrame([(*r, "k", "g", 7) for r in rows], SCHEMA + ", key string, gone_doc string, _lines_removed int")
    got = sorted(((r.doc_id, r.text, r._lines_removed) for r in dedup_lines(docs).collect()), key=lambda r: (r[0] or 0, str(r[1])))
    assert got == [(None, None, 0), (None, "yes", 0), (1, long, 0), (2, "", 1), (3, "x", 1), (4, "", 1), (5, "\n\n", 1), (6, "", 1)]
    with pytest.raises(ValueError):
        dedup_lines(docs, units_an_edit=3)


def test_line_dedup_query_takes_near_copies(spark, tmp_path):
    line = "a paragraph of some length in which one single word is not what it was in the copy that came before it, as happens with edited pages; " * 2
    docs = [(1, line + "end"), (2, line.replace("single", "changed", 1) + "end"), (3, "something else that is long enough to count as a line")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.lines_removed, r.text) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, docs[0][1]), 2: (1, ""), 3: (0, docs[2][1])}


def test_mixing(spark):
    rows = [(k, "big" if k % 10 < 7 else f"s{k % 10}", "a b c d") for k in range(400)] + [(1000, None, "x"), (1001, "s7", None), (1002, "none", ""), (None, "s8", "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made = mix_sources(docs, target_entropy=0.95, max_repeats=3.0, block_tokens=50).collect()
    passes = Counter((r.doc_id, r.source) for r in made)
    assert {(i, s) for i, s, _ in rows} == set(passes) and passes[1002, "none"] == 1  # every document comes, that of a source without tokens once
    tokens = Counter()
    for i, s, t in rows:
        tokens[s] += len((t or "").split())
    used = Counter()
    for r in made:
        used[r.source] += r.tokens
    assert all(used[s] <= 3.0 * n + 4 for s, n in tokens.items()) and used["s7"] > 1.3 * tokens["s7"] and used["big"] == tokens["big"]
    assert all(0 <= r.place <= 1.5 for r in made)
    assert [tuple(r) for r in sorted(made, key=str)] == [tuple(r) for r in sorted(mix_sources(docs, target_entropy=0.95, max_repeats=3.0, block_tokens=50).collect(), key=str)]
    w = temperature_weights(spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long"), target_entropy=0.8, max_repeats=1e9).collect()
    assert math.isclose(-sum(r.weight * math.log(r.weight) for r in w), 0.8 * math.log(3), rel_tol=1e-6) and math.isclose(sum(r.weight for r in w), 1)
    half = mix_sources(docs.where("source = 'big'"), budget=500, block_tokens=50).collect()
    assert 500 <= sum(r.tokens for r in half) <= 504 and max(Counter(r.doc_id for r in half).values()) == 1
    assert mix_sources(docs.where("false")).count() == 0


def test_quotes(spark):
    talk = [
        (1, 0, "u", "The first  point here.\nAnd a second one."), (1, 1, "v", "Something else."), (1, 2, "u", "> the first point HERE.\n> And a second one.\nI agree."),
        (1, 3, "v", ">> The first point here.\n> I agree.\nNo."), (2, 0, "u", "> Something else.\nseen elsewhere"), (2, 1, "v", None), (2, 2, "u", ""), (2, 3, "v", "> nobody said this"), (None, 0, "u", "> x\nlost"), (2, 0, "u", "> Something else.\nseen elsewhere"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.root, r.depth, r.linked) for r in unquoted_conversations(df).collect()}
    assert got[1, 2] == ("I agree.", 0, 0, 1, 1) and got[1, 3][:2] == ("No.", 2) and got[1, 3][3] == 2 and got[1, 1] == ("Something else.", 0, 0, 1, 0)
    assert got[2, 0] == ("seen elsewhere", None, 0, 0, 1) and got[2, 1][0] is None and got[2, 2][0] == "" and got[2, 3] == ("", 2, 0, 3, 0) and got[None, 0][0] == "lost" and len(got) == 9
    links = {(r.conv, r.turn, r.level): (r.source_conv, r.source_turn) for r in link_quotes(df, "conv_id", "turn", "text").collect()}
    assert links[1, 3, 2] == (1, 0) and links[1, 3, 1] == (1, 2) and links[2, 0, 1] == (1, 1) and links[2, 3, 1] == (None, None)
    assert unquoted_conversations(df.where("false")).count() == 0


def test_quotes_vote_over_all_messages(spark):
    """Lines that several messages say: each passage against the votes counted in plain Python."""
    random.seed(12)
    pool = ["Hi.", "Thanks."] + [f"point {k}" for k in range(14)]
    talk = [(0, 1, "Hi.\nalpha"), (0, 3, "Hi.\nalpha\nbeta"), (0, 5, "> Hi.\n> alpha\n> beta\nyes"), (0, 6, "Hi.\nalpha\nbeta\ngamma"), (9, 0, "> gamma\n> Hi.")]
    for c in range(1, 7):
        for k in range(12):
            own, quoted = random.sample(pool, random.randint(1, 3)), random.choices(pool, k=random.randint(0, 4))
            talk.append((c, k, "\n".join([*(f"> {q}" for q in quoted), *own])))
    says = {(c, k): {x for x in t.split("\n") if x[0] != ">"} for c, k, t in talk}
    m = Counter(x for own in says.values() for x in own)
    want = {}
    for c, k, t in talk:
        quoted = [x[2:] for x in t.split("\n") if x[0] == ">"]
        rank = lambda at: (-sum((1 << 40) // m[x] for x in quoted if x in says[at]), -sum(x in says[at] for x in quoted), at[0] != c, at)  # noqa: B023, E731
        hit = [at for at in says if at != (c, k) and says[at] & set(quoted)]
        best = min([at for at in hit if at[0] != c or at[1] < k] or hit, key=rank, default=(None, None))
        if quoted:
            want[c, k] = (len(quoted), -rank(best)[1] if hit else 0, *best)
    df = spark.createDataFrame([(c, k, "u", t) for c, k, t in talk], "conv_id long, turn long, role string, text string")
    assert {(r.conv, r.turn): (r.n_lines, r.matched, r.source_conv, r.source_turn) for r in link_quotes(df).collect()} == want
    assert want[0, 5] == (3, 3, 0, 3) and want[9, 0] == (2, 2, 0, 6)
    assert unquoted_conversations(df).where("conv_id = 0 and turn = 5").first().reply_to == 3


def test_nearest_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)) + np.repeat(rng.standard_normal((10, 24)) * 2, 150, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, []), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    nodes, edges = neighbour_graph(df)
    got = graph_search(nodes, edges, nodes.where("id % 20 = 0").select(F.col("id").alias("q"))).toPandas()
    exact = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        s = exact @ exact[q]
        s[q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id]) and (np.diff(mine.score) <= 0).all()
        hits += len(set(mine.vec_id) & set(np.argsort(-s)[:20]))
    assert hits / (75 * 20) >= 0.9 and got.query_id.max() < 1500
    few = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "vec_id long, embedding array<float>")
    nodes, edges = neighbour_graph(few)
    assert graph_search(nodes, edges, nodes.where("id = 0").select(F.col("id").alias("q"))).count() == 2
    nodes, edges = neighbour_graph(few.where("false"))
    assert graph_search(nodes, edges, nodes.select(F.col("id").alias("q"))).count() == 0


def test_nearest_of_ties_norms_and_repeated_ids(spark):
    """Few vectors, so that all are found: lengths of all sizes, equal vectors (the smaller id first), rows that repeat an id (the largest vector counts, once)."""
    rng = np.random.default_rng(3)
    x = (rng.integers(-3, 4, (45, 6)) * np.exp2(rng.integers(-3, 4, (45, 1)))).astype(np.float32)
    x[~x.any(axis=1)] = 1
    x[10:20] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, [-99.0] * 6), (7, x[7].tolist())]
    nodes, edges = neighbour_graph(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = graph_search(nodes, edges, nodes.where("id % 20 = 0").select(F.col("id").alias("q"))).toPandas()
    for q in (0, 20, 40):
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-s[k], k))[:20]  # noqa: B023
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and np.array_equal(mine.score, s[want])


def test_nearest_of_skewed_vectors(spark):
    """Most vectors around one direction, some elsewhere, alone in their buckets, and a small tight group: every query finds 20, nearly all of them right."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((1200, 16)) * 0.1 + 3, rng.standard_normal((60, 16)) * 3, rng.standard_normal((1, 16)) + rng.standard_normal((30, 16)) * 0.01]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes, edges = neighbour_graph(df, bucket=4)
    asked = nodes.where("id >= 1200").select(F.col("id").alias("q"))
    got = graph_search(nodes, edges, asked).toPandas()
    hits = 0
    for q in range(1200, len(x)):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        mine = got[got.query_id == q]
        assert sorted(mine["rank"]) == list(range(1, 21)), q
        hits += len(set(mine.vec_id) & set(np.argsort(-s)[:20]))
    assert hits / (20 * (len(x) - 1200)) >= 0.9
    none = graph_search(nodes, edges.where("false"), asked.where("q % 9 = 0"), entries=0).toPandas()  # no way at all: scanned
    for q, mine in none.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert np.allclose(mine.sort_values("rank").score, np.sort(s)[::-1][:20])
    assert none.query_id.nunique() == sum(k % 9 == 0 for k in range(1200, len(x)))


def test_nearest_of_vectors_without_structure(spark):
    """A graph of few rounds misses much of rows without structure: measured on a few queries, it makes all be scanned; equal vectors come by id."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((1200, 48)) * np.exp(rng.standard_normal((1200, 1)) / 2)).astype(np.float32)
    x[300:380] = x[5]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes, edges = neighbour_graph(df, k=6, rounds=1, tables=1)
    got = graph_search(nodes, edges, nodes.where("id % 20 = 0").select(F.col("id").alias("q")), pool=24, hops=1, entries=16, sample=10).toPandas()
    for q in range(0, 1200, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-s[k], k))[:20]  # noqa: B023
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and np.array_equal(mine.score, s[want])


def test_lm_scores(spark):
    random.seed(8)
    rows = [(k, " ".join(random.choice(["the cat sat", "on a mat", "Dogs bark", "birds sing well"]) for _ in range(20))) for k in range(120)] + [(200, None), (201, ""), (None, "cat cat"), (201, "")]
    held = F.col("doc_id") % 10 == 0
    got = score_texts(frame(spark, rows), held).collect()
    words = {k: [*(t or "").lower().split(), "</s>"] for k, t in rows}
    train = Counter(w for k, t in rows if k is None or k % 10 for w in [*(t or "").lower().split(), "</s>"])
    n, v = sum(train.values()), len(train)
    for r in got:
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_tokens == len(words[r.doc_id]) and r.train_tokens == n and r.n_known == sum(train[w] > 0 for w in words[r.doc_id])
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) and len(got) == len(rows)
    assert score_texts(frame(spark, []), held).count() == 0


def test_lm_levels_are_exact_counts(spark):
    """Bigrams seen once and thousands of distinct ones count as they are: scores against plain Python, but for the filters' few errors."""
    random.seed(10)
    rows = [(k, " ".join(random.choice(["q", "r"]) + str(random.randint(0, 40 if k % 2 else 3000)) for _ in range(60))) for k in range(150)]
    got = {r.doc_id: r.score for r in score_texts(frame(spark, rows), F.col("doc_id") % 10 == 0).collect()}
    texts = {k: ["</s>", *t.split(), "</s>"] for k, t in rows}
    one, two = Counter(w for k, t in texts.items() if k % 10 for w in t[1:]), Counter(p for k, t in texts.items() if k % 10 for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    kind = lambda a: min(int(math.log2(one[a] + 1)) >> 1, lm.CLASSES - 1)

    def p(a, b, lam, less):
        least = max(0, (1 << int(math.log2(two[a, b]))) - less) if two[a, b] else 0
        return math.log10(lam * min(1, least / max(one[a] - less, 1)) + (1 - lam) * (max(one[b] - less, 0) + 0.1) / (n - less + 0.1 * (v + 1)))

    sums = [[sum(p(a, b, lam, 1) * c for (a, b), c in two.items() if kind(a) == k) for lam in lm.LAMBDAS] for k in range(lm.CLASSES)]
    lam = [lm.LAMBDAS[int(np.argmax(x))] for x in sums]
    want = {k: sum(p(a, b, lam[kind(a)], 0) for a, b in zip(t, t[1:])) for k, t in texts.items()}
    assert sum(two.values()) - len(two) < sum(c == 1 for c in two.values()) and max(lam) > 0
    assert sum(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want) >= 0.7 * len(want)
    assert all(math.isclose(got[k], want[k], rel_tol=0.05) for k in want)


def test_lm_filter_takes_every_key():
    numbers = lm.mix(np.arange(1, 400_001, dtype=np.uint64))
    count = np.arange(400_000) % 9
    bloom, bits = lm.bloom_filter(numbers, count)
    level = lm.probed(numbers, bloom, bits)
    want = np.where(count > 0, lm.level_of(count) + 1, 0)
    assert (level >= want).all() and (level == want).mean() > 0.98 and bits >= 16 * want.sum()


def test_folding():
    assert fold("You 1D10T! l0ser Ѕtupid covid19 5cum, trash can") == " you idiot ioser stupid covid19 scum trash can "
    assert fold("") == "  "


def test_folding_takes_linear_time():
    began = time.time()
    for s in ("7" * 1_000_000, "a" * 1_000_000, "a1" * 500_000, "1!" * 500_000, "é$" * 300_000, "trash can idiot " * 60_000):
        m = toxicity.matches(toxicity.ToxicityModel({" idiot": 1.0, " trash": 2.0}).automaton(), fold(s))
        assert len(m) == (60_000 if "idiot" in s else 0)
    assert time.time() - began < 8


def test_matches_are_those_of_plain_search():
    """Every word start against every entry; equal weights, entries that begin alike, exceptions that overlap."""
    random.seed(16)
    entries = {" ab": 1.0, " abc": 1.0, " abcd ": 3.0, " b": 0.5, " ca": 2.0, " ca b": 2.0}
    model = toxicity.ToxicityModel(entries, ("ab c", "c abc a", "b b"))
    phrases = [fold(p) for p in model.exceptions]
    for _ in range(400):
        text = fold(" ".join(random.choice(["a", "ab", "abc", "abcd", "b", "ca", "c", "cab"]) for _ in range(random.randint(0, 14))))
        spared = {k for p in phrases for at in range(len(text)) if text.startswith(p, at) for k in range(at, at + len(p) - 1)}
        want = []
        for at in range(len(text)):
            hits = [w for e, w in entries.items() if text.startswith(e, at)]
            if hits and at not in spared:
                want.append(max(hits))
        assert [w for _, w in toxicity.matches(model.automaton(), text)] == want, text


def test_toxicity(spark):
    random.seed(9)
    words = ["alpha", "beta", "gamma", "delta", "table", "river"]
    rows = []
    for k in range(600):
        w = [random.choice(words) for _ in range(random.randint(5, 80))]
        if k % 4 == 0:
            w.insert(random.randrange(len(w)), random.choice(["grobian", "Grobians", "gr0bian"]))
        rows.append((k, " ".join(w)))
    docs = frame(spark, rows + [(1000, None), (1001, ""), (1002, "1d10t " * 3), (1003, "put it in the trash can"), (None, "x")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(600) if k % 3 == 0)
    assert got[1002].predicted == 1 and got[1003].predicted == 0 and got[1000].score == got[1001].score < 0.3 and got[1000].n_words == 0
    twice = score_toxicity(docs.unionByName(docs), model).where("doc_id = 4").select("toxicity").collect()
    assert twice == [(got[4],)] * 2
    assert fit_toxicity(docs, labels.where("false")).n_train == 0 and score_toxicity(docs.where("false"), model).count() == 0
