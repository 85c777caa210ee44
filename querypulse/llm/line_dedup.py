"""Near-duplicate lines by segment partition, in DataFrame functions only.

A line is a sequence of units, words or characters. Lines of a length class are cut into threshold + 1 segments of a size of the class's own, the first half of them told from the
line's beginning, the others from its end. Within the threshold of edits one segment stays whole and is shifted by no more than the edits that can stand before it (or behind it), so a
line is looked up by few substrings, whatever the other's length in the class; near the lower end of its class it asks for the class below as well. Of lines that share a substring, a banded
bit-parallel simulation tells the edits apart (for characters, beyond BANDED edits, Spark's own banded distance).

Only numbers are dealt out: 64 bits for a substring, 128 for a line. Texts are fetched for lines that share a substring with another one.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shipping import hot_join, stored

#: Beyond so many edits of characters the simulation's expression is larger than the distance it replaces.
BANDED = 2
#: Groups of so many lines that share a substring are compared pair by pair where the first comparison left several labels; lines of larger ones are grouped anew.
FEW = 16
#: The parts of a line that are left out in turn, up to two of them, when lines are grouped anew: what remains is three quarters and more.
BLOCKS = 8


def units_of(line: Column, unit: str) -> Column:
    """What an edit adds, takes or replaces: words between single blanks, or characters."""
    return F.split(line, " " if unit == "word" else "", -1)


def within_edits(a: Column, b: Column, most: int, unit: str | None = "char", allowed: Column | None = None) -> Column:
    """Whether two texts (or, without unit, two arrays of units) are at most so many edits apart (with allowed: at most that many, which is most or less); null if one is null.

    For each number of edits a word of 2 most + 1 bits holds the rows of the band that are reached; one step for each unit of b
    moves them: by a match or a substitution (same bit), an insertion (to the right), a deletion (to the left).
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    first, second = (units_of(a, unit), units_of(b, unit)) if unit else (a, b)
    n, m = (F.length(a), F.length(b)) if unit == "char" else (F.size(first), F.size(second))
    # Beside each unit of b the units of a that its band meets, so that a step looks nothing up.
    bands = [F.concat(F.array_repeat(F.lit(None).cast("string"), most - t), first) if t < most else F.slice(first, t - most + 1, F.greatest(n, F.lit(1))) for t in range(width)]
    rows = F.slice(F.arrays_zip(second.alias("b"), *(x.alias(f"a{t}") for t, x in enumerate(bands))), 1, m)
    start = F.struct(*(F.lit(sum(1 << (most + t) for t in range(d + 1))).cast("long").alias(f"r{d}") for d in range(most + 1)))

    def step(state: Column, row: Column) -> Column:
        bits = F.lit(0).cast("long")
        for t in range(width):
            bits = bits + F.when(row[f"a{t}"] == row["b"], F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long"))
        # bits stands in a struct of its own: written into each row it would be worked out again each time
        return F.transform(F.array(F.struct(state.alias("s"), bits.alias("bits"))), moved)[0]

    def moved(x: Column) -> Column:
        new = []
        for d in range(most + 1):
            r = x["s"][f"r{d}"].bitwiseAND(x["bits"])
            if d:
                old = x["s"][f"r{d - 1}"]
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(F.lit(full).cast("long")))
            new.append(r)
        return F.struct(*(r.alias(f"r{d}") for d, r in enumerate(new)))

    def of_allowed(end: Column) -> Column:
        row = end[f"r{most}"]
        for d in range(most if allowed is not None else 0):
            row = F.when(allowed == d, end[f"r{d}"]).otherwise(row)
        return row

    row = F.aggregate(rows, start, step, of_allowed)
    near = F.getbit(row, F.greatest(F.least(n - m + most, F.lit(width - 1)), F.lit(0)).cast("int")) == 1
    return F.when(F.abs(n - m) > most, F.lit(False)).when(a.isNotNull() & b.isNotNull(), near)


def lower_end(n: Column) -> Column:
    """The least length of the class of n: 1, 2, 3, 4, 6, 8, 12, 16, 24 ..."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin(n)) - 2))
    return n - n % step


def threshold(low: Column, most: int, units_an_edit: int) -> Column:
    """The edits allowed in a class, from its least length."""
    return F.least(F.lit(most), F.floor(low / units_an_edit).cast("int"))


def with_segments(rows: DataFrame, most: int, units_an_edit: int) -> DataFrame:
    """rows (with units: array<string>) and keys: numbers of the substrings a line is looked up by, null where there is none, the last bit set for a segment of its own class."""
    rows = rows.withColumn("_n", F.size("units")).withColumn("_low", lower_end(F.col("_n"))).withColumn("_low1", F.when(F.col("_low") > 1, lower_end(F.col("_low") - 1)).otherwise(0))
    for k, low in enumerate(("_low", "_low1")):
        rows = rows.withColumn(f"_t{k}", threshold(F.col(low), most, units_an_edit)).withColumn(f"_s{k}", F.floor(F.col(low) / (F.col(f"_t{k}") + 1)).cast("int"))
    n, out = F.col("_n"), []
    for k, low in enumerate(("_low", "_low1")):
        t, size = F.col(f"_t{k}"), F.col(f"_s{k}")
        asked = (t > 0) if k == 0 else (t > 0) & (n - t < F.col("_low"))
        for side, sides in (("b", most // 2), ("e", (most - 1) // 2)):
            for i in range(sides + 1):
                for shift in range(-i, i + 1):
                    start = size * i + shift if side == "b" else n - size * (i + 1) + shift
                    there = asked & (t >= 2 * i if side == "b" else t > 2 * i)
                    if shift or k:
                        there = there & (start >= 0) & (start + size <= n)
                    key = F.xxhash64(F.lit(f"{side}{i}"), F.col(low), F.slice("units", start + 1, size)).bitwiseAND(F.lit(-2).cast("long"))
                    out.append(F.when(there, key.bitwiseOR(F.lit(int(k == 0 and shift == 0)).cast("long"))))
    return rows.withColumn("keys", F.array(*out)).drop("_n", "_low", "_low1", "_t0", "_t1", "_s0", "_s1")


def with_blocks(rows: DataFrame, most: int, units_an_edit: int) -> DataFrame:
    """rows (with units: an array) and key, own: a row for each way to leave out as many of a line's parts (BLOCKS; with more than two edits, one or two more than edits) as there may be edits. What remains is the same in a line within the threshold:
    what stands before the first part left out from the line's beginning, what stands behind the last one from its end, between them shifted by the edits before it.
    """
    parts = BLOCKS if most <= 2 else most + 2 if most <= 4 else most + 1
    rows = rows.withColumn("_n", F.size("units")).withColumn("_top", lower_end(F.col("_n")))
    below = rows.where("_top > 1").withColumn("_low", lower_end(F.col("_top") - 1)).withColumn("_t", threshold(F.col("_low"), most, units_an_edit)).where("_t > 0 and _n - _t < _top").drop("_t")
    both = rows.withColumn("_low", F.col("_top")).withColumn("_own", F.lit(1)).unionByName(below.withColumn("_own", F.lit(0))).drop("_top").withColumn("_size", F.floor(F.col("_low") / parts).cast("int"))
    ways = []
    for left in combinations(range(parts), most):
        inside = [range(-j, j + 1) if b - a > 1 else (0,) for j, (a, b) in enumerate(zip(left, left[1:], strict=False), 1)]
        ways += [F.struct(F.array(*map(F.lit, left)).alias("left"), F.array(*map(F.lit, (0, *shifts))).alias("shift")) for shifts in product(*inside)]
    n, size, left, shift = F.col("_n"), F.col("_size"), F.col("w.left"), F.col("w.shift")
    tail = size * (parts - 1 - left[most - 1])
    blocks, there, plain = [F.slice("units", 1, size * left[0])], F.lit(True), F.lit(True)
    for j in range(1, most):
        start, length = size * (left[j - 1] + 1) + shift[j], size * (left[j] - left[j - 1] - 1)
        there, plain = there & (start >= 0) & (start + length <= n - tail), plain & (shift[j] == 0)
        blocks.append(F.slice("units", F.greatest(start, F.lit(0)) + 1, length))
    blocks.append(F.slice("units", n - tail + 1, tail))
    key = F.xxhash64(left, "_low", *blocks).bitwiseAND(F.lit(-2).cast("long"))
    own = F.when(plain, F.col("_own")).otherwise(0)
    kept = [c for c in both.columns if c not in ("units", "_n", "_low", "_size", "_own")]
    return both.withColumn("w", F.explode(F.array(*ways))).where(there).select(*kept, key.alias("key"), own.alias("own"))


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, at, line, h, g) of the lines that count: trimmed, not empty, of at least min_chars characters. h and g are their number."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("at", "line"))
    rows = rows.select("doc", "at", F.trim("line").alias("line")).where(F.length("line") >= max(1, min_chars))
    return rows.select("doc", "at", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("g"), F.col("line")).alias("g"))


def split_last(keys: Column) -> tuple[Column, Column]:
    """A key without its last bit, and the bit: whether it is of a segment of the line's own class."""
    return keys.bitwiseAND(F.lit(-2).cast("long")), keys.bitwiseAND(F.lit(1).cast("long")).cast("int")


def near_links(lines: DataFrame, members: DataFrame, most: int, units_an_edit: int, unit: str) -> DataFrame:
    """(a, b): links that join all lines within the threshold of each other. lines: h, line (each h once); members: (key, own, h, copies) of those that share a substring.

    In every group all lines are compared with the one of most copies, which others mostly are copies of; what is near it has its label, and pairs of one label need no comparison.
    Of groups of several labels, those of few lines are compared pair by pair. Lines of larger ones are grouped anew by most of their units (with_blocks), the same way: labels first, then pairs of different ones.
    """
    whole = unit == "char" and most > BANDED
    cut = lines.select("h", F.col("line") if whole else F.lit(None).cast("string").alias("line"), units_of(F.col("line"), unit).alias("units"))
    lines = stored(cut.withColumn("nums", F.transform("units", lambda x: F.xxhash64(x))))  # numbers are smaller and sooner compared than words
    text = lambda c: lines.select(F.col("h").alias(c), F.col("line" if whole else "nums").alias(f"x_{c}"), F.col("nums").alias(f"nums_{c}"), F.size("nums").alias(f"n_{c}"))
    a, b = F.col("x_a"), F.col("x_b")
    allowed = threshold(lower_end(F.col("n")), most, units_an_edit)
    near = F.levenshtein(a, b, most).between(F.lit(0), F.col("allowed")) if whole else within_edits(a, b, most, None, F.col("allowed"))

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(text("a"), "a").join(text("b"), "b").withColumn("n", F.least("n_a", "n_b")).withColumn("allowed", allowed)
        both = both.where(F.abs(F.col("n_a") - F.col("n_b")) <= F.col("allowed"))
        for one, other in (("a", "b"), ("b", "a")):  # an edit leaves at most one unit that the other line has not
            both = both.where(F.size(F.array_except(f"nums_{one}", f"nums_{other}")) <= F.col("allowed"))
        return stored(both.where(near).select("a", "b"))

    links: DataFrame | None = None
    members = members.withColumn("label", F.col("h"))
    for level in (0, 1):
        mixed = (F.min("label") != F.max("label")).alias("mixed")
        sizes = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("copies", "h", "label")).alias("first"), mixed).where("mixed").select("key", "n", F.col("first.h").alias("first"), F.col("first.label").alias("first_label")))
        total = sizes.agg(F.sum("n")).first()[0]
        if links is not None and not total:
            break
        told = stored(hot_join(members, sizes.withColumn("_w", F.col("n")), ["key"], "_w", total or 0))
        star = compared(told.where("label <> first_label").select(F.col("first").alias("a"), F.col("h").alias("b")))
        links = star if links is None else links.unionByName(star)
        # Labels are lines; who is near a first line takes over its label, and so on twice more.
        told_near = told.join(star.select(F.col("a").alias("first"), F.col("b").alias("h")), ["first", "h"]).groupBy("h").agg(F.max("first_label").alias("to"))
        step = stored(told_near)
        for _ in range(2):
            step = step.join(step.select(F.col("h").alias("to"), F.col("to").alias("on")), "to", "left").select("h", F.coalesce("on", "to").alias("to"))
        told = stored(told.join(step, "h", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
        still = told.groupBy("key").agg(F.count("*").alias("_w"), mixed).where("mixed").select("key", "_w")
        told = stored(hot_join(told, still, ["key"], "_w", total or 0))
        side = lambda c, rows: rows.where("h <> first").select("key", F.col("h").alias(c), F.col("own").alias(f"own_{c}"), F.col("label").alias(f"label_{c}"))
        few = told.where(F.col("n") <= FEW) if level == 0 else told
        pairs = side("a", few).join(side("b", few), "key").where("a < b and label_a <> label_b and (own_a = 1 or own_b = 1)").select("a", "b")
        links = links.unionByName(compared(pairs))
        if level == 0:
            if told.where(F.col("n") > FEW).isEmpty():
                break
            crowded = told.where(F.col("n") > FEW).select("h", "copies", "label").distinct().join(lines.select("h", F.col("nums").alias("units")), "h")
            members = stored(with_blocks(crowded, most, units_an_edit).groupBy("key", "h", "copies", "label").agg(F.max("own").alias("own")))
    return links


def marked_lines(docs: DataFrame, id_col: str, text_col: str, max_edits: int, units_an_edit: int, unit: str, min_chars: int) -> DataFrame:
    """(doc, at) of the lines to take out: all but the first of each class."""
    lines = occurrences(docs, id_col, text_col, min_chars)
    if max_edits:
        lines = with_segments(lines.withColumn("units", units_of(F.col("line"), unit)), max_edits, units_an_edit)
    lines = stored(lines.drop("line", "units"))
    place = F.struct("doc", "at")
    total = lines.count()
    same = stored(lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    marks = same.select("h", "g", "n", "first")
    if max_edits:
        key, own = split_last(F.col("k"))
        asked = lines.select("h", "g", "doc", "at", F.explode("keys").alias("k")).where("k is not null").select(key.alias("key"), own.alias("own"), "h", "g", "doc", "at")
        shared = stored(asked.groupBy("key").agg(F.max("own").alias("own"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("_w")).where("own = 1 and lo <> hi").select("key", "_w"))
        # A line said very often is looked up by its first place only.
        found = hot_join(asked, shared, ["key"], "_w", total).groupBy("key", "h", "g").agg(F.max("own").alias("own"), F.min(place).alias("first"), F.count("*").alias("copies"))
        found = stored(found)
        places = stored(found.groupBy("h", "g").agg(F.min("first").alias("first")))
        wanted = places.select(F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "h").where("doc is not null")
        held = docs.where(F.col(id_col).isNotNull()).join(wanted.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi")
        null = docs.where(F.col(id_col).isNull())
        texts = stored(occurrences(held.select(id_col, text_col), id_col, text_col, min_chars).drop("g").join(wanted, ["doc", "at", "h"]).select("h", "line").unionByName(
            occurrences(null.select(id_col, text_col), id_col, text_col, min_chars).join(places.where("first.doc is null").select("h", "g"), ["h", "g"], "left_semi").select("h", "line")).dropDuplicates(["h"]))
        kinds = connected_components(near_links(texts, found.groupBy("key", "h").agg(F.max("own").alias("own"), F.sum("copies").alias("copies")), max_edits, units_an_edit, unit))
        classes = stored(places.join(kinds.select(F.col("node").alias("h"), F.col("component").alias("class")), "h"))
        firsts = classes.groupBy("class").agg(F.min("first").alias("class_first"))
        linked = classes.join(firsts, "class").select("h", "g", "class_first")
        marks = marks.join(linked, ["h", "g"], "full").select("h", "g", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("class_first", "first").alias("first"))
    marks = stored(marks)
    return hot_join(lines.select("h", "g", "doc", "at"), marks, ["h", "g"], "n", total).where(~place.eqNullSafe(F.col("first"))).select("doc", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, units_an_edit: int = 12, unit: str = "word", min_chars: int = 1) -> DataFrame:
    """Keep the first of each class of near-duplicate lines in all documents (smallest id, then place), take out the others.

    Two lines are near if they are equal but for blanks at their ends, or apart by no more edits than the shorter one's length class allows: one for units_an_edit (4 or more) of the class's
    least length (see lower_end), max_edits at most; 0: exact repeats only. An edit adds, takes or replaces a unit: a word between single blanks, or a character (unit="char"). Classes are joined over
    chains. Blank lines and lines of under min_chars characters are left alone; so is a document whose every line is the first of its kind.

    All rows and columns of docs stay; text_col is the text without those lines, _lines_removed their number (a column of that name is replaced). Null texts stay null, empty ones empty; a text may become empty.
    Null ids come before others. Rows that repeat an id are one document: a line in both counts as one occurrence, and what is taken out is taken out of both. An empty table gives an empty result.
    Very long lines are cut and compared like others, as a whole. Exact repeats are told by 128 bits; a class is numbered by 64.
    """
    if units_an_edit < 4 or unit not in ("word", "char"):
        raise ValueError("an edit for 4 units or more, words or characters")
    gone = marked_lines(docs, id_col, text_col, max_edits, units_an_edit, unit, min_chars).groupBy("doc").agg(F.collect_set("at").alias("at"))
    own = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in docs.columns if c not in (text_col, "_lines_removed")))  # in a struct no name can clash
    kept = docs.select(F.col(id_col).alias("doc"), own.alias("own"), F.col(text_col).cast("string").alias("text")).join(gone.withColumnRenamed("doc", "gone_doc"), F.col("doc").eqNullSafe(F.col("gone_doc")), "left")
    cleaned = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("at", i)), "\n")
    text = F.when(F.col("at").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cleaned)
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("at"), F.lit(0)))
    return kept.select(*(text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns if c != "_lines_removed"), removed.alias("_lines_removed"))
