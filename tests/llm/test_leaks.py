"""Leaks against Smith-Waterman of all pairs, recall on edited copies, short items, odd texts."""

import random
import re

import numpy as np
import oracle
import pytest

from agrispark.llm import decontaminate

SF = f"{oracle.DATA}/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def matched(item, text):
    """Words matched by the best local alignment, cell by cell; of equal scores the one with more matches."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for w in item:
        here = [(0, 0)]
        for j, t in enumerate(text):
            s, m = above[j]
            step = (s + 2, m + 1) if w == t else (s - 1, m)
            cell = max(step, (above[j + 1][0] - 1, above[j + 1][1]), (here[j][0] - 1, here[j][1]))
            here.append(cell if cell[0] > 0 else (0, 0))
        best, above = max(best, *here), here
    return best[1]


def found(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), **more).collect()}


def test_all_pairs(spark):
    """Every pair of the smallest tables at 0.8 and more, by brute force, and no other."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = found(spark, docs, items)
    bags = {i: set(words_of(t)) for i, t in docs}
    want = {}
    for k, u in items:
        item = words_of(u)
        for i, t in docs:
            if sum(w in bags[i] for w in item) >= 0.8 * len(item):  # fewer words in common can't match
                share = matched(item, words_of(t)) / len(item)
                if share >= 0.8:
                    want[i, k] = share
    assert got == pytest.approx(want) and want


@pytest.mark.parametrize("edits, least", [(0.05, 1.0), (0.1, 1.0), (0.15, 1.0), (0.2, 0.99)])
def test_edited_copies(spark, edits, least):
    rng = random.Random(int(edits * 100))
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [vocabulary[min(int(rng.expovariate(1 / 300)), 2999)] for _ in range(n)]
    items = {k: text(rng.randrange(8, 60)) for k in range(300)}
    docs = {}
    for k, item in items.items():
        copy = list(item)
        for at in rng.sample(range(len(copy)), int(edits * len(copy) + 1e-9)):
            copy[at] = rng.choice([[f"new{rng.randrange(10**9)}"], []])
        copy = [w for x in copy for w in ([x] if isinstance(x, str) else x)]
        docs[k] = text(rng.randrange(0, 200)) + copy + text(rng.randrange(0, 200))
    got = found(spark, [(k, " ".join(d)) for k, d in docs.items()], [(k, " ".join(i)) for k, i in items.items()])
    alike = [k for k in items if matched(items[k], docs[k]) >= 0.8 * len(items[k])]
    assert len(alike) > 250 and sum((k, k) in got for k in alike) >= least * len(alike)


def test_short_items_and_odd_texts(spark):
    long = " ".join(f"x{i}" for i in range(100_000))
    docs = [(1, "so the Answer, is 42!"), (2, "the answer is not 42"), (3, long + " the answer is 42 " + long), (None, "the answer is 42"), (4, None), (5, ""), (6, " ,,, ")]
    items = [(7, "The answer is 42."), (8, "!!"), (9, None), (10, "x99998 x99999")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 7), (3, 7), (None, 7), (3, 10)} and set(got.values()) == {1.0}
    clash = spark.createDataFrame([(1, "the answer is 42", "a", 0, "b")], "doc_id long, text string, item_id string, similarity int, _text string")
    assert decontaminate.contaminated(clash, spark.createDataFrame(items, "item_id long, text string")).count() == 1


def test_seeds_are_short_enough():
    """However a fifth of the words is chosen to be edited, a run of ``seed_width`` words stays whole."""
    rng = np.random.default_rng(5)
    for n in range(1, 120):
        width = decontaminate.seed_width(n, 0.8, 4)
        edits = int(0.2 * n + 1e-9)
        even = np.array_split(np.ones(n - edits), edits + 1)
        assert max(len(x) for x in even) >= width and (n < 16 or width == 4)
        for _ in range(20):
            hit = np.zeros(n, bool)
            hit[rng.choice(n, edits, replace=False)] = True
            runs = [len(r) for r in "".join("x" if h else "." for h in hit).split("x")]
            assert max(runs) >= width
