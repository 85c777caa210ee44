"""The subpackage's SQL on fixtures that exercise what the tables lack: skewed sources, quotes."""

import duckdb
import pyarrow as pa

from querypulse.llm import mixing, quotes

TALK = [
    (1, 0, "u", "The first  point here.\nAnd a second one."), (1, 1, "v", "Something else."), (1, 2, "u", "> the first point HERE.\n> And a second one.\nI agree."), (1, 3, "v", ">> The first point here.\n> I agree.\nNo."),
    (2, 0, "u", "> Something else.\nseen elsewhere"), (2, 1, "v", None), (2, 2, "u", ""), (2, 3, "v", "> nobody said this"), (2, 0, "u", "> Something else.\nseen elsewhere"), (2, 9, "u", "> Something else.\n> I agree.\n> nothing\n\n>> No.\nend"),
]


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    key = lambda rows: sorted(map(str, rows))
    want = con.sql(sql)
    assert key(tuple(r) for r in df.select(*want.columns).collect()) == key(want.fetchall())


def test_quotes_sql(spark):
    columns = ["conv_id", "turn", "role", "text"]
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    same(quotes.unquoted_conversations(df), quotes.ORACLE_SQL, conversations=pa.Table.from_pylist([dict(zip(columns, r, strict=True)) for r in TALK]))


def test_mixing_sql(spark):
    rows = [(k, "big" if k % 10 < 7 else f"s{k % 10}", "a b c " + "d " * (k % 9)) for k in range(500)] + [(1000, None, "x"), (1001, "s7", None), (1002, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made = mixing.mix_sources(df, target_entropy=0.95, max_repeats=4.0)
    same(made, mixing.ORACLE_SQL, documents=pa.Table.from_pylist([dict(zip(["doc_id", "source", "text"], r, strict=True)) for r in rows]))
