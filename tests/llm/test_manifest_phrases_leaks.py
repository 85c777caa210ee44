"""Merkle manifest, collocations and benchmark passages against plain Python, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querypulse.llm import collocations as co
from querypulse.llm import decontamination as de
from querypulse.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node int, total string, leaks int"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """{leaf: [(subroot, root, siblings, folded)]} from (doc_id, text, lang, source, n_chars)."""
    leaf = lambda d, t, lang, s, n: H("".join(map(part, (d, s, lang, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def steps(levels, at):
        out = []
        for level in levels[:-1]:
            out.append((level[at ^ 1] if at ^ 1 < len(level) else None, at % 2))
            at //= 2
        return out

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: up([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = up([own[g][-1][0] for g in order])
    found = []
    for i, g in enumerate(order):
        for at, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            d, t, lang, s, n = x[3]
            path = steps(own[g], at) + steps(top, i)
            tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
            h = leaf(d, t, lang, s, n + 1) if tampered else x[2]
            for sibling, left in path:
                h = H(h if sibling is None else sibling + h if left else h + sibling)
            found.append((d, x[2], own[g][-1][0], top[-1][0], H("".join(s or "" for s, _ in path)), h, h == top[-1][0]))
    return sorted(found, key=str)


def manifest(df):
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    rows = merkle.merkle_manifest(df.withColumn("other", other), COLUMNS, "lang", "doc_id", keep=("other",))
    rows = rows.withColumn("folded", merkle.folded(F.coalesce("keep.other", "leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path")))
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in rows.collect()), key=str)


def test_manifest(spark):
    random.seed(4)
    rows = [(k, random.choice([None, "", "é", "text " * random.randint(1, 9)]), random.choice(["en", "en", "en", None, "", "ß", "zz"]), random.choice([None, "s"]), random.choice([None, 3])) for k in range(601)]
    rows += [(7, "twice", "en", "s", 5), (7, "twice", "en", "s", 5), (7, "otherwise", "en", None, 5), (None, "no id", "en", "s", 1), (9000, "x" * 300_000, "alone", "-", -1)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    assert manifest(df.repartition(5)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 256, 257])
def test_manifest_of_sizes(spark, n):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(n)]
    assert manifest(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)) == plain_manifest(rows)


def test_a_path_with_a_wrong_sibling_gives_another_root(spark):
    rows = merkle.merkle_manifest(spark.createDataFrame([(k, f"t{k}", "en", "s", k, "x", 1, "y", 2) for k in range(5)], SCHEMA), COLUMNS, "lang", "doc_id")
    wrong = F.transform("path", lambda s, i: F.struct(F.when(i == 0, F.lit("0" * 64)).otherwise(s["sibling"]).alias("sibling"), s["on_left"].alias("on_left")))
    held = rows.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.col("leaf"), wrong) == F.col("root")).alias("bad")).collect()
    assert all(r.ok and not r.bad for r in held)


def plain_phrases(rows, least, top, most=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, *w), a in f.items():
        if len(w) == 1 or any(100 * c >= 100 * a and p[0] == lang and len(p) - 1 > len(w) and any(list(p[i : i + len(w)]) == w for i in range(1, len(p))) for p, c in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    return [(x[0], r, *x[1:]) for x in out if (r := ranks.update([x[0]]) or ranks[x[0]]) <= top]


def some_texts(n):
    random.seed(6)
    words = ["a", "b", "c", "d", "É", "ß", "New", "york", "city", "'t", "x\x1cy"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! ", ":"]
    text = lambda: "".join(random.choice(words) + random.choice(seps) for _ in range(random.randint(0, 60)))
    rows = [(text(), random.choice(["en", "en", None, "de"])) for _ in range(n)] + [(None, "en"), ("", "en"), (None, None), ("a b c d e", "fr"), ("a b. c d. " * 3000, "en")]
    return rows + rows[:5]


@pytest.mark.parametrize("sample", [0.2, 1e-9, 1.0])
def test_collocations(spark, sample):
    """With a sample that proposes nothing every level is a failure of the border, and the result is the same."""
    rows = some_texts(500)
    df = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in rows], "text string, lang string, h int, phrase string, n int")
    found = [tuple(r) for r in co.collocations(df, least=12, top=40, sample=sample).collect()]
    assert sorted(found) == sorted(plain_phrases(rows, 12, 40)) and len(found) > 30


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(df).count() == 0 and co.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), least=1).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12, 7 * 10**13, 3 * 10**12 + 1, 3 * 10**12 + 7)], "a long, n_words long, l long, r long")
    got = row.selectExpr("(cast(1000 * a as decimal(19,0)) * cast(n_words as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))").first()[0]
    assert got == 1000 * 3 * 10**12 * 7 * 10**13 // ((3 * 10**12 + 1) * (3 * 10**12 + 7))


def test_long_texts_are_cut_where_pieces_end():
    data = np.frombuffer(b"aa bb. cc dd, ee ff gg hh ii jj kk; ll." + b"x", np.uint8)
    parts = [bytes(p) for p, _, _ in co.cut(data, np.array([0, 39, 40]), 10)]
    assert b"".join(parts) == bytes(data) and parts == [b"aa bb.", b" cc dd,", b" ee ff gg hh ii jj kk;", b" ll.", b"x"]
    whole = lambda most: Counter(h for p, at, _ in co.cut(data, np.array([0, 39, 40]), most) for h in co.numbered(p, at)[0].tolist())
    assert whole(10) == whole(1000)


def plain_leaks(docs, items, size=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_words", [2_000_000, 60])
def test_passages(spark, most_words):
    """With a bound of few words there are several automata, and the result is the same."""
    random.seed(8)
    vocabulary = ["the", "Cat", "sat", "é", "日本", "x1", "on"]
    some = lambda n: "".join(random.choice(vocabulary) + random.choice([" ", ", ", "\n", " - ", "_"]) for _ in range(n))
    items = [(k, some(random.randint(0, 30))) for k in range(12)] + [(3, some(14)), (None, some(12)), (50, None), (51, ""), (52, "!?"), (53, "On x1"), (12, some(11))]
    docs = [(k, some(random.randint(0, 20)) + (random.choice(items)[1] or "").upper().replace(" ", "  ") + some(9)) for k in range(60)]
    docs += [(1, "the " * 5), (100, None), (101, ""), (102, "..."), (None, items[2][1]), (103, items[4][1] * 3000), (1, "the " * 5)]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, own int, found string, leaks int")
    got = de.find_passages(df, spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, window int"), most_words=most_words)
    assert sorted(((r.doc_id, r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) for r in got.collect()), key=str) == plain_leaks(docs, items)


def test_passages_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert de.find_passages(docs, items).count() == 0
    assert de.find_passages(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).select("leaks.*").first() == (2, 0, [], [])


def test_spans_lead_back_to_the_text(spark):
    text = "Say -- (ÉCOLE one, two... three four) five SIX seven eight nine; and  ÉCOLE ONE two three four five six seven eight nine ten!"
    items = spark.createDataFrame([("q1", "école ONE two three four five six seven eight nine ten"), ("q2", "and école")], "item_id string, text string")
    low = items.withColumn("text", F.translate("text", "é", "É"))  # only A-Z are lower-cased
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in de.place_spans(de.find_passages(docs, low, keep=("doc_id", "text"))).collect()}
    assert [text[s.start : s.end] for s in rows[1].spans] == ["ÉCOLE one, two... three four) five SIX seven eight nine; and  ÉCOLE ONE two three four five six seven eight nine ten"]
    assert rows[1].leaks["items"] == ["q1", "q2"] and rows[2].spans == [] and rows[3].spans == []
