import random

import oracle
from agrispark.llm import spelling
from agrispark.llm.oracles import ORACLES


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs(spark, words, **kw):
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    return sorted(map(tuple, spelling.near_words(table, **kw).collect()))


def brute(words):
    return sorted((a, b, j + 1) for a in words for j, b in enumerate(words) if a != b and one_apart(a, b))


def test_sql(spark):
    sf = f"{oracle.DATA}/sf0.001"
    assert oracle.same(spelling.op11_spelling_variants(spark, sf), oracle.connect(sf), ORACLES["op11_spelling_variants"]) == ""


def test_all_pairs_of_random_words(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    words |= {"a" * k for k in range(1, 9)} | {"b" * k + "a" for k in range(7)}
    words = sorted(words)
    assert pairs(spark, words) == brute(words)


def test_long_words_meet_across_the_trie_s_depth(spark):
    rng = random.Random(3)
    words = set()
    for size in (5, 6, 7, 30):
        base = "".join(rng.choice("ab") for _ in range(size))
        words |= {base, base[:-1], base[1:], base + "a", "b" + base, base[:2] + "c" + base[3:], base[:2] + "d" + base[3:], base[: size // 2] + "c" + base[size // 2 :]}
    words |= {"a" * k for k in (6, 7, 8, 5000, 5001)} | {"a" * 2500 + "b" + "a" * 2500}
    words = sorted(words)
    assert pairs(spark, words, levels=6) == brute(words)


def test_forms_and_roots(spark):
    table = [("colour", 1000), ("color", 100), ("colr", 10), ("col", 1), ("other", 5), ("othar", 4), ("tiesa", 50), ("tiesb", 50), ("ties", 5), (None, 9)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(table, "word string, n long")).collect()}
    assert len(got) == 9
    assert [got[w].form for w in ("colour", "color", "colr", "col")] == [None, "colour", "color", "colr"]
    assert {got[w].root for w in ("colour", "color", "colr", "col")} == {"colour"}
    assert (got["other"].form, got["othar"].form, got["other"].n_near, got["othar"].root) == (None, None, 1, "othar")
    assert (got["ties"].form, got["ties"].form_n, got["ties"].n_near) == ("tiesa", 50, 2)


def test_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Wörtern Wörtern wörtern ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ short", "x"), (None, "Wörterm " * 40, "x"), (3, "y" * 100_000, "x"), (3, "y" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    words = spelling.occurrences(docs)
    assert {(r.word[:9], r.n) for r in words.collect()} == {("wörtern", 3), ("÷÷÷÷÷÷÷", 2), ("wörterm", 40), ("yyyyyyyyy", 2)}
    got = {r.word[:9]: (r.form, r.n_near) for r in spelling.variants(words, levels=12).collect()}
    assert got == {"wörtern": ("wörterm", 1), "wörterm": (None, 1), "÷÷÷÷÷÷÷": (None, 0), "yyyyyyyyy": (None, 0)}
    damaged = spelling.occurrences(docs, damage=True)
    assert damaged.agg({"n": "sum"}).first()[0] == 47
    assert spelling.variants(spelling.occurrences(docs.limit(0))).count() == 0
