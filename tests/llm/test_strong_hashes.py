"""Texts made to collide under polynomial hashes modulo 2^64 count as what they are."""

import hashlib
import re

import pytest

from agrispark.llm import decontaminate, quality_rules, substring_dedup


def thue_morse(n, a="a", b="b"):
    return ["".join(b if (bin(i).count("1") + k) & 1 else a for i in range(n)) for k in (0, 1)]


@pytest.mark.parametrize("size", [1024, 4096])
def test_lines_words_and_windows(spark, size):
    one, two = thue_morse(size)
    rows = [(1, f"{one}\n{two}\n{one}"), (2, f"{one} x y {two} x y {one} x y")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_dup_lines, got[1].n_repeat_words) == (1, 0)
    assert got[2].n_repeat_words == 6 and got[2].n_words == 9
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *words])), (2, " ".join([two, *words])), (3, " ".join([one, *words]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    rows = [(1, " ".join([two] * 8)), (2, " ".join([one] * 8))]
    bench = spark.createDataFrame([(7, " ".join([one] * 8))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [r.doc_id for r in got] == [2]


def test_windows_of_colliding_word_rows(spark):
    one, two = (x.replace("a", "u ").replace("b", "v ").split() for x in thue_morse(4096))
    rows = [(1, " ".join(one)), (2, " ".join(two))]
    seen, want = set(), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        want[i] = hashlib.sha256(" ".join(x for x, y in zip(w, gone, strict=True) if not y).encode()).hexdigest()
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got} == want
