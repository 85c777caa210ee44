"""The pipeline's stages: their columns on the small tables, and their decisions against plain Python on a fixture."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components, brute_lines
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == corpus_pipeline.COLUMNS and new.schema == docs.select(corpus_pipeline.COLUMNS).schema, name
        ids = {r.doc_id for r in new.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name in ("line_dedup", "mixing"):
            assert len(ids) == docs.select("doc_id").distinct().count()
        docs = new.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def planted():
    """(id, text) of clean documents, and of toxic ones, copies and near copies; with null and empty texts, a null id and a repeated row."""
    random.seed(21)
    pool = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(random.choice(pool) for _ in range(n))
    clean = [(k, "\n".join(say(random.randint(3, 40)) for _ in range(random.randint(1, 4)))) for k in range(60)] + [(1000 + k, say(8)) for k in range(240)]
    toxic = [(100 + k, f"{say(12)} grobian {say(3)}") for k in range(40)]
    shared = say(30)
    repeats = [(200 + k, f"{say(20)}\n{shared if k % 2 else shared.replace('word1', 'other', 1)}\n{say(15)}") for k in range(6)]
    base = [random.choice(pool) for _ in range(200)]
    copies = [(300 + k, "\n".join([" ".join(base[:70]), " ".join(base[70:] if k < 2 else [*base[70:120], "new", "and", "more", *base[120:]])])) for k in range(4)]
    return clean, toxic, [*repeats, *copies, (400, None), (401, ""), (None, "no id at all here"), (402, "twice the same row"), (402, "twice the same row")]


def test_decisions(spark, tmp_path):
    clean, toxic, others = planted()
    rows = [*clean, *toxic, *others]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 7 // 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    spark.createDataFrame([(i, int((i, t) in toxic)) for i, t in clean + toxic], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    kept = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert text(kept) == Counter(clean + others)

    cleaned = stages["line_dedup"](spark, kept, str(tmp_path)).cache()
    known = [(i, t) for i, t in clean + others if i is not None]
    assert text(cleaned) == brute_lines(known, 2, 12, "word") + Counter([(None, "no id at all here")])
    assert cleaned.where("text is not null and n_chars <> length(text)").count() == 0

    # the stage on its own input: here the copies are whole
    single = stages["near_duplicates"](spark, kept, str(tmp_path)).cache()
    component = {i: c for i, (_, c) in brute_components(known, 5, 80).items()}
    assert text(single) == Counter((i, t) for i, t in clean + others if i is None or component[i] == i) and component[303] == 300

    mixed = stages["mixing"](spark, single, str(tmp_path)).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(text(mixed)) == set(text(single)) and max(times[i] for i in times if i != 402) <= 2

    packed = stages["packing"](spark, mixed, str(tmp_path)).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in known}
    ids = packed[packed.doc_id.notna()]
    assert all(ids[ids.doc_id == i].length.sum() == length[i] * n for i, n in times.items() if i is not None)
    full = packed.groupby("sequence_id").length.sum().to_numpy()
    assert ((full & (full - 1)) == 0).all() and full.max() <= 2048 and np.issubdtype(full.dtype, np.integer)

    for stage in stages.values():
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0
