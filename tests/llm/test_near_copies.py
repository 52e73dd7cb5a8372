"""Near copies at a similarity against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SF, classes, shingles

from agrispark.llm import common, near_copies, simhash_golay


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("block", [512, 8])
def test_copies_of_every_similarity_from_08_are_linked(spark, block):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(40):
        text = [word() for _ in range(rng.randrange(3, 300))]
        rows.append(" ".join(text))
        for _ in range(3):
            other = list(text)
            for at in rng.sample(range(len(other)), rng.randrange(0, 1 + len(other) // 30)):
                other[at] = word().upper()
            rows.append("  ".join(other))
    hot = [word() for _ in range(200)]
    for _ in range(60):
        hot = list(hot)
        hot[rng.randrange(200)] = word()
        rows.append(" ".join(hot))
    rows += ["", None, " \n", "w1 W2", "W1  w2", rows[0]]
    sets = dict(enumerate(map(shingles, rows)))
    got = {r._doc: r.first._doc for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), block=block).collect()}
    assert got == classes(list(sets), lambda a, b: alike(sets[a], sets[b]))


def test_stage_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    low = classes(list(sets), lambda a, b: alike(sets[a], sets[b]))
    assert low[177] == 1  # of similarity 0.83, and 9 bits apart
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {i for i in low if low[i] == i}


@pytest.mark.parametrize("similarity, least", [(0.8, 0.985), (0.85, 0.995), (0.9, 0.999)])
def test_share_of_pairs_that_meet(similarity, least):
    """Of pairs of sets of just this similarity nearly all share a key and differ in few of the further bits."""
    rng = np.random.default_rng(12)
    met = total = 0
    for common in (16, 40, 160, 640):
        own = round(common * (1 / similarity - 1) / 2)
        n = 1500 if common < 600 else 400
        sides = []
        shared = rng.integers(0, 2**64, (n, common), dtype=np.uint64)
        for _ in range(2):
            h = np.concatenate([shared, rng.integers(0, 2**64, (n, own), dtype=np.uint64)], axis=1)
            vote = simhash_golay.votes(h.ravel(), np.full(n, common + own))
            sides.append((near_copies.further_bits(h.ravel(), np.full(n, common + own)), [simhash_golay.likely_indices(vote[:, a : a + b], near_copies.CODES) for a, b in simhash_golay.SEGMENTS]))
        near = np.bitwise_count(sides[0][0] ^ sides[1][0]).sum(axis=1) <= near_copies.DISTANCE
        some = sum((x[:, :, None] == y[:, None, :]).any((1, 2)).astype(int) for x, y in zip(sides[0][1], sides[1][1], strict=True))
        met += int((near & (some >= 2)).sum())
        total += n
    print(similarity, met / total)
    assert met >= least * total


def test_a_sets_bits_travel_once_for_six_keys(spark):
    """A set sends 18 rows, of which its 108 keys are made after the shuffle; sets without a shingle send none."""
    rng = np.random.default_rng(3)
    codes = [rng.permutation(4096)[:18].tolist() for _ in range(5)]
    rows = [(i, i + 10, i + 20, c) for i, c in enumerate(codes)] + [(5, 0, 0, [])]
    dealt = near_copies._dealt(spark.createDataFrame(rows, "h long, b0 long, b1 long, codes array<short>"))
    assert dealt.count() == 18 * len(codes)
    keys = dealt.withColumn("code", F.explode("codes")).select((F.col("lead") * 4096 + F.col("code")).alias("key"), "h", "b0", "b1").collect()
    want = [(k << 24 | x << 12 | y, i, i + 10, i + 20) for i, c in enumerate(codes) for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))) for x in c[6 * a : 6 * a + 6] for y in c[6 * b : 6 * b + 6]]
    assert sorted(map(tuple, keys)) == sorted(want)


def test_zipped_texts_come_back(spark):
    """Null, empty and odd texts too, and zipped ones are smaller in a shuffle."""
    rows = [(0, None), (1, ""), (2, "a\x00\u00e9\U0001f600"), (3, "one two three " * 500)]
    packed = common.zipped(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert packed.where("doc_id = 3").select(F.length("text")).first()[0] < 700
    assert sorted(map(tuple, common.restored(packed, "text").collect())) == rows
    odd = spark.sql("SELECT CAST(X'61FF62' AS STRING) AS text")
    assert common.restored(common.zipped(odd, "text"), "text").select(F.hex("text")).first()[0] == "61FF62"
