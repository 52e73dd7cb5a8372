"""Very long runs of white space, and rows of one id whose texts' short hashes collide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrispark.llm import packing
from agrispark.llm.substring_dedup import substring_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n"])
def test_megabytes_of_white_space_are_tokenized(blank):
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for size in (99_999, 1_000_000, 2_000_000, 5_000_000):
        for text in (blank * (size // len(blank)), "word" + blank * (size // len(blank)) + "word"):
            want = enc.slow.encode(text, add_special_tokens=False).ids
            assert np.array_equal(enc.ids(text), [*want, 1])


def test_pack_goes_on_after_long_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a few words"), (3, "x" + "\n" * 2_000_000 + "y")], "doc_id long, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and all(r.n == r["all"] for r in got)


def test_null_ids_whose_texts_share_32_bits(spark):
    passage, other = " ".join(f"w{i}" for i in range(24)), " ".join(f"v{i}" for i in range(24))
    made = lambda head: spark.range(200_000).select(F.concat(F.lit(head + " "), "id").alias("text")).withColumn("h", F.hash("text"))
    pair = made(passage).alias("a").join(made(other).alias("b"), "h").select("a.text", F.col("b.text").alias("other")).first()
    assert pair is not None
    docs = spark.createDataFrame([(1, passage), (None, pair.text), (None, pair.other), (None, "short text")], "doc_id long, text string")
    got = {r.kept_text: r.n_removed for r in substring_dedup(docs).collect()}
    assert got == {passage: 0, pair.text.rsplit(" ", 1)[1]: 24, pair.other: 0, "short text": 0}
