"""Conversations without quotes, in DataFrame functions only.

Leading marks give each line's quote level; consecutive lines of a level are a passage. Normalised quoted lines are hashed and joined to all messages that say them; they vote,
rare lines more than common ones, and a passage belongs to the message of most votes. The outermost quote tells what a message replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shipping import stored

#: The votes of a line that one message says; one that m messages say has this / m.
VOTES = 1 << 40
MARKS = r"^\s*(>[\s>]*)"


def level_of(line: Column) -> Column:
    """How many marks > a line begins with; blanks between them do not count."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(line: Column) -> Column:
    """What two copies of a quoted line have in common: no marks, one blank between words, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def message_lines(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """(conv, turn, at, level, line, h) of all lines; h is null for lines without content."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("at", "line"))
    text = normalised(F.col("line"))
    return rows.select("conv", "turn", "at", level_of(F.col("line")).alias("level"), "line", F.when(text != "", F.md5(text)).alias("h"))


def quoted_passages(lines: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, at, h): quoted lines, numbered by runs of a level within their message."""
    by = Window.partitionBy("conv", "turn").orderBy("at")
    new = F.when(F.col("level").eqNullSafe(F.lag("level").over(by)), 0).otherwise(1)
    quoting = lines.join(lines.where("level > 0").select("conv", "turn").distinct(), ["conv", "turn"], "left_semi")
    runs = quoting.withColumn("new", new).withColumn("passage", F.sum("new").over(by))
    return runs.where("level > 0 and h is not null").select("conv", "turn", "passage", "level", "at", "h")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, passage, level, n_lines, matched, source_conv, source_turn): for each quoted passage the message it comes from, or nulls.

    Every message that says a line of the passage gets votes for it, its own message and later turns of its conversation aside: they are taken only if nothing else says a line (later turns), or
    never (its own). The most votes count, then the most lines, then the same conversation, then the smallest (conv, turn).
    """
    lines = message_lines(messages, conv_col, turn_col, text_col).where("conv is not null and turn is not null")
    quotes = quoted_passages(lines).groupBy("conv", "turn", "passage", "level").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    passages = stored(quotes.select("conv", "turn", "passage", "level", F.size("hs").cast("long").alias("n_lines"), F.md5(F.array_join("hs", ",")).alias("content"), "hs"))
    # What is quoted often is looked up once.
    contents = passages.groupBy("content").agg(F.first("hs").alias("hs")).select("content", F.explode("hs").alias("h")).groupBy("content", "h").agg(F.count("*").alias("times"))
    said = stored(lines.where("level = 0 and h is not null").select("conv", "turn", "h").join(contents.select("h").distinct(), "h", "left_semi").distinct())
    rarity = said.groupBy("h").agg(F.floor(F.lit(VOTES) / F.count("*")).alias("votes"), (F.min("conv") != F.max("conv")).alias("wide"))
    weighed = stored(contents.join(rarity, "h").withColumn("votes", F.col("votes") * F.col("times")))
    made = (F.sum("votes").alias("votes"), F.sum("times").alias("n"))
    ranked = lambda home: F.struct((-F.col("votes")).alias("o"), (-F.col("n")).alias("p"), F.lit(home).alias("home"), "conv", "turn")
    # Two conversations at least say the rarest line of several conversations. Lines that together weigh less cannot bring in a better message, however often they are said.
    lightest = F.sum("votes").over(Window.partitionBy("content").orderBy("votes", "h").rowsBetween(Window.unboundedPreceding, 0))
    certain = F.max(F.when(F.col("wide"), F.col("votes"))).over(Window.partitionBy("content"))
    leading = weighed.withColumn("sum", lightest).withColumn("certain", certain).where("certain is null or sum >= certain").select("content", "h")
    candidates = leading.join(said, "h").select("content", "conv", "turn").distinct()
    everywhere = candidates.join(said, ["conv", "turn"]).join(weighed, ["content", "h"]).groupBy("content", "conv", "turn").agg(*made)
    by_conv = everywhere.groupBy("content", "conv").agg(F.min(ranked(1)).alias("b")).withColumn("_r", F.row_number().over(Window.partitionBy("content").orderBy("b"))).where("_r <= 2")
    far = by_conv.groupBy("content").agg(F.max(F.when(F.col("_r") == 1, F.col("b"))).alias("one"), F.max(F.when(F.col("_r") == 2, F.col("b"))).alias("two"))
    at_home = passages.select("conv", "content").distinct().join(weighed, "content").join(said, ["conv", "h"]).groupBy("conv", "content", "turn").agg(*made)
    asked = passages.select("conv", "content", "turn").distinct()
    both = at_home.select("conv", "content", "turn", ranked(0).alias("b")).unionByName(asked.withColumn("b", F.lit(None)), allowMissingColumns=True)
    turns = lambda order: Window.partitionBy("conv", "content").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    number = F.col("turn").cast("long")
    home = both.withColumn("early", F.min("b").over(turns(number))).withColumn("late", F.min("b").over(turns(-number))).where("b is null").drop("b")
    found = passages.join(home, ["conv", "content", "turn"]).join(far, "content", "left")
    other = F.when(F.col("one.conv") != F.col("conv"), F.col("one")).otherwise(F.col("two"))
    best = found.withColumn("b", F.coalesce(F.least("early", other), F.col("late")))
    return best.select("conv", "turn", "passage", "level", "n_lines", F.coalesce(-F.col("b.p"), F.lit(0).cast("long")).alias("matched"), F.col("b.conv").alias("source_conv"), F.col("b.turn").alias("source_turn"))


def reply_order(parents: DataFrame) -> DataFrame:
    """From (conv, turn, parent: an earlier turn or null): (conv, turn, root, depth) by pointer doubling; rounds are logarithmic in the longest chain."""
    now = stored(parents.select("conv", "turn", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "turn").alias("root")))
    while not now.where("up is not null").isEmpty():
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        now = stored(now.join(above, ["conv", "up"], "left").select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root")))
    return now.select("conv", "turn", "root", "depth")


def unquoted_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message: conv_id, turn, role, text without quotes, quoted_lines, passages, linked, reply_to, root, depth.

    reply_to: the turn of the same conversation that its first outermost linked passage comes from, else the turn before. Ordered by (conv_id, root, depth, turn) messages follow their replies.
    Quotes from other conversations count as linked only. Messages of equal (conversation, turn) are one: the first role and text by value stay. Null conversations or turns are
    left as they are, without a parent. Null texts stay null, empty ones empty; a message of quotes alone becomes empty. Other columns are not read. An empty table gives none.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    placed = rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv", "turn", "m.role", "m.text")
    links = stored(link_quotes(placed, "conv", "turn", "text"))
    by_message = links.groupBy("conv", "turn").agg(
        F.count("*").alias("passages"), F.count("source_turn").alias("linked"),
        F.min(F.when((F.col("source_conv") == F.col("conv")) & (F.col("source_turn") < F.col("turn")), F.struct("level", "passage", "source_turn")))["source_turn"].alias("quoted"),
    )
    before = Window.partitionBy("conv", F.floor(F.col("turn") / 512)).orderBy("turn")  # a long conversation is not one task: the turn before is in the same stretch, or the last of one before
    chain = placed.select("conv", "turn").withColumn("prev", F.lag("turn").over(before)).withColumn("stretch", F.floor(F.col("turn") / 512))
    lasts = chain.groupBy("conv", "stretch").agg(F.max("turn").alias("last"))
    gaps = lasts.select("conv", "stretch", F.lag("last").over(Window.partitionBy("conv").orderBy("stretch")).alias("carried"))
    parents = chain.join(gaps, ["conv", "stretch"]).join(by_message.select("conv", "turn", "quoted"), ["conv", "turn"], "left").select("conv", "turn", F.coalesce("quoted", "prev", "carried").alias("parent"))
    parents = stored(parents)
    levels = F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.struct(level_of(x).alias("level"), x.alias("line")))
    clean = F.trim(F.array_join(F.transform(F.filter(levels, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    n_quoted = F.coalesce(F.size(F.filter(levels, lambda x: x["level"] > 0)), F.lit(0))
    text = F.when(n_quoted > 0, clean).otherwise(F.col("text"))
    full = placed.join(by_message.drop("quoted"), ["conv", "turn"], "left").join(parents, ["conv", "turn"]).join(reply_order(parents), ["conv", "turn"])
    done = full.select("conv", "turn", "role", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_quoted).alias("quoted_lines"), F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("linked", F.lit(0)).alias("linked"), F.col("parent").alias("reply_to"), "root", "depth")
    odd = rows.where("conv is null or turn is null").select("conv", "turn", "role", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_quoted).alias("quoted_lines"), F.lit(0).cast("long").alias("passages"), F.lit(0).cast("long").alias("linked"), F.lit(None).cast(messages.schema[turn_col].dataType).alias("reply_to"), F.col("turn").alias("root"), F.lit(0).alias("depth"))
    return done.unionByName(odd).withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})


#: DuckDB SQL for unquoted_conversations(conversations), for quoted lines that one message says: of several it takes the first only.
ORACLE_SQL = r"""WITH RECURSIVE m AS (SELECT conv, turn, (min(r)).role AS role, (min(r)).text AS text FROM (SELECT conv_id AS conv, turn, {'role': role, 'text': text} AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv, turn),
ln0 AS (SELECT conv, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM m WHERE text IS NOT NULL),
ln AS (SELECT conv, turn, k, line, length(mk) - length(replace(mk, '>', '')) AS level, lower(trim(regexp_replace(regexp_replace(line, '^\s*(>[\s>]*)', ''), '\s+', ' ', 'g'))) AS norm FROM (SELECT *, regexp_extract(line, '^\s*(>[\s>]*)', 1) AS mk FROM ln0)),
run AS (SELECT *, sum(nw) OVER (PARTITION BY conv, turn ORDER BY k) AS passage FROM (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER (PARTITION BY conv, turn ORDER BY k) THEN 0 ELSE 1 END AS nw FROM ln)),
q AS (SELECT * FROM run WHERE level > 0 AND norm <> ''),
said AS (SELECT conv, turn, norm FROM ln WHERE level = 0 AND norm IN (SELECT norm FROM q)),
near AS (SELECT conv, norm, min(turn) AS near FROM said GROUP BY conv, norm),
far AS (SELECT norm, min({'conv': conv, 'turn': turn}) AS far, max({'conv': conv, 'turn': turn}) AS other FROM said GROUP BY norm),
v AS (SELECT conv, turn, passage, level, src, count(*) AS n FROM (SELECT q.conv, q.turn, q.passage, q.level, CASE WHEN near < q.turn THEN {'conv': q.conv, 'turn': near} WHEN far IS NOT NULL AND NOT (far.conv = q.conv AND far.turn = q.turn) THEN far
  WHEN other IS NOT NULL AND NOT (other.conv = q.conv AND other.turn = q.turn) THEN other END AS src FROM q LEFT JOIN near ON near.conv = q.conv AND near.norm = q.norm LEFT JOIN far ON far.norm = q.norm) GROUP BY ALL),
best AS (SELECT conv, turn, passage, level, min(CASE WHEN src IS NOT NULL THEN {'o': -n, 'home': CASE WHEN src.conv = conv THEN 0 ELSE 1 END, 'conv': src.conv, 'turn': src.turn} END) AS b FROM v GROUP BY conv, turn, passage, level),
bm AS (SELECT conv, turn, count(*) AS passages, count(b.turn) AS linked, (min(CASE WHEN b.conv = conv AND b.turn < turn THEN {'level': level, 'passage': passage, 't': b.turn} END)).t AS quoted FROM best GROUP BY conv, turn),
own AS (SELECT conv, turn, count(*) FILTER (level > 0) AS quoted_lines, trim(string_agg(line, chr(10) ORDER BY k) FILTER (level = 0)) AS clean FROM ln GROUP BY conv, turn),
par AS (SELECT m.*, coalesce(quoted, lag(m.turn) OVER (PARTITION BY m.conv ORDER BY m.turn)) AS parent, coalesce(passages, 0) AS passages, coalesce(linked, 0) AS linked FROM m LEFT JOIN bm ON bm.conv = m.conv AND bm.turn = m.turn),
tree AS (SELECT conv, turn, turn AS root, 0 AS depth FROM par WHERE parent IS NULL UNION ALL SELECT p.conv, p.turn, t.root, t.depth + 1 FROM par p JOIN tree t ON p.conv = t.conv AND p.parent = t.turn)
SELECT p.conv AS conv_id, p.turn, p.role, CASE WHEN o.quoted_lines > 0 THEN coalesce(o.clean, '') ELSE p.text END AS text, coalesce(o.quoted_lines, 0) AS quoted_lines, p.passages, p.linked, p.parent AS reply_to, t.root, t.depth
FROM par p JOIN tree t ON t.conv = p.conv AND t.turn = p.turn LEFT JOIN own o ON o.conv = p.conv AND o.turn = p.turn
UNION ALL SELECT conv_id, turn, role, text, 0, 0, 0, NULL, turn, 0 FROM conversations WHERE conv_id IS NULL OR turn IS NULL"""
