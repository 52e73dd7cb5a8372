"""Null and repeated ids in each stage of the pipeline that drops rows."""

import random

import pytest
from test_llm import SF

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(5000)]
    return [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]


def out(spark, stage, rows):
    return sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND), SF).collect()), key=repr)


def test_quality(spark, texts):
    good, bad = texts[:3], "too few words"
    rows = [(None, good[0]), (None, bad), (7, bad), (7, good[1]), (None, good[2]), (8, None), (None, None), (9, good[0]), (9, good[0])]
    assert out(spark, corpus_pipeline.quality, rows) == sorted([(None, good[0]), (7, good[1]), (None, good[2]), (9, good[0]), (9, good[0])], key=repr)


def test_near_dedup(spark, texts):
    a, b, c, d = texts[:4]
    near = a + " more"
    rows = [(None, b), (None, c), (None, near), (5, a), (5, d), (5, d), (6, d)]
    assert out(spark, corpus_pipeline.near_dedup, rows) == sorted([(None, b), (None, c), (5, a), (5, d)], key=repr)
    assert len(out(spark, corpus_pipeline.near_dedup, [(5, a), (5, near), (None, a)])) == 1


def test_decontamination(spark, texts):
    leak = texts[0] + " " + max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, leak), (None, texts[1]), (3, leak), (3, texts[2]), (None, texts[3])]
    assert out(spark, corpus_pipeline.decontaminate, rows) == sorted([(None, texts[1]), (3, texts[2]), (None, texts[3])], key=repr)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_in_every_stage(spark, texts, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, and columns with the names used inside."""
    long = " ".join(f"word{i}" for i in range(120_000))
    rows = [(1, texts[0], None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", 5), (None, texts[1], "en", "s", 5), (5, texts[2], "en", "s", 5), (5, texts[2], "en", "s", 5)]
    extra = "_row long, _doc string, _tk string, _text int, spans string, kept string, first int, h string, key string, grams string, similarity int, rest string"
    df = spark.createDataFrame([(*r, 7, "a", "b", 8, "c", "d", 9, "e", "f", "g", 10, "i") for r in rows], f"{KIND}, {extra}")
    got = stage(spark, df, SF)
    ids = {r.doc_id for r in got.collect()}
    assert {1, 4, 5, None} <= ids and (name == "quality rules" or {2, 3} & ids)
    assert stage(spark, df.limit(0), SF).count() == 0
    if name != "packing":
        assert got.columns == corpus_pipeline.COLUMNS
        once = {(r.doc_id, r.lang, r.source) for r in got.collect()}
        assert (1, None, None) in once


def test_short_benchmark_items_are_whole_lines(spark, texts, tmp_path):
    items = [(1, "the capital  city"), (2, "yes"), (3, ""), (4, None), (5, texts[0])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, texts[1] + "\n the capital\tcity \nmore"), (2, texts[2] + " the capital city is"), (3, "yes"), (4, "yes and no"), (5, "Yes"), (6, None), (7, "a " + texts[0]), (None, texts[3] + "\nyes")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND)
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 4, 5, 6]
