import hashlib
import itertools
import random
import re

import oracle
from agrispark.llm import turn_repair
from agrispark.llm.oracles import ORACLES

KIND = "conv_id long, turn long, role string, text string, fault int, audit string"


def brute(codes: str) -> tuple[int, str]:
    """The least of all edits, by trying all up to two insertions in each gap."""
    found = []

    def go(at, made, cost, letters):
        for word, more in (("", 0), ("I", 2), ("II", 4)):
            for roles in itertools.product("ua", repeat=len(word)):
                now, paid, said = made + "".join(roles), cost + more, letters + word
                if at == len(codes):
                    if re.fullmatch("(s?(ua)+)?", now):
                        found.append((paid, said))
                    continue
                code = codes[at]
                go(at + 1, now, paid + 3, said + "D")
                if code != "d":
                    cut = int(code.isupper())
                    go(at + 1, now + code.lower(), paid + cut, said + "K")
                    for role in "ua":
                        go(at + 1, now + role, paid + 2 + cut, said + "R")

    go(0, "", 0, "")
    return min(found)


def test_sql(spark):
    sf = f"{oracle.DATA}/sf0.01"
    assert oracle.same(turn_repair.op12_turn_repair(spark, sf), oracle.connect(sf), ORACLES["op12_turn_repair"]) == ""


def test_all_short_conversations():
    for n in range(4):
        for codes in map("".join, itertools.product("suaxSAd", repeat=n)):
            assert turn_repair.cheapest(codes) == brute(codes), codes


def test_long_conversations():
    rng = random.Random(1)
    codes = "".join(rng.choice("suaxSUAXd") for _ in range(3000))
    cost, audit = turn_repair.cheapest(codes)
    assert len(re.sub("I", "", audit)) == 3000 and cost > 0
    assert turn_repair.cheapest("ua" * 2000) == (0, "K" * 4000)
    assert turn_repair.cheapest(codes, 10**6) == (cost, audit)  # with a digit for every letter


def test_cut_digits_change_no_decision():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice(rng.choice(("suaxSUAXd", "ua", "uua", "dUA"))) for _ in range(rng.randrange(40)))
        assert len({turn_repair.cheapest(codes, places) for places in (1, 2, 7, 10**6)}) == 1, codes


def test_rows_and_digests(spark):
    rows = [
        (1, None, "system", "Be kind.", 0, "x"),
        (1, 1, "user", "Hello.", 0, "x"),
        (1, 1, "user", "Hello.", 0, "x"),
        (1, 5, "assistant", "Yes, but", 0, "x"),
        (2, 3, "tool", "Ran.", 0, "x"),
        (2, 4, None, None, 0, "x"),
        (None, 1, "assistant", "Hi!", 0, "x"),
        (3, None, "", "", 0, "x"),
    ]
    faults = turn_repair.faults(spark.createDataFrame(rows, KIND)).cache()
    plans = turn_repair.plans(faults)
    got = {r.conv_id: r for r in plans.collect()}
    numbers = lambda r: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit)
    assert numbers(got[1]) == (3, 0, 1, 1, 1, 4, "KKDK")
    assert numbers(got[2]) == (0, 1, 0, 0, 1, 6, "DD")
    assert numbers(got[None]) == (0, 0, 0, 0, 0, 2, "IK")
    assert numbers(got[3]) == (0, 1, 0, 0, 0, 3, "D")
    turns = {}
    for r in turn_repair.repaired(faults, plans).orderBy("conv_id", "position").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {1: [("system", "Be kind."), ("user", "Hello."), ("assistant", "Yes, but")], None: [("user", ""), ("assistant", "Hi!")]}
    digests = {r.conv_id: r.repaired_sha256 for r in turn_repair.repaired_digests(faults, plans).collect()}
    assert digests == {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns.get(c, [])).encode()).hexdigest() for c in (1, 2, 3, None)}


def test_empty(spark):
    faults = turn_repair.faults(spark.createDataFrame([], KIND))
    plans = turn_repair.plans(faults)
    assert plans.count() == turn_repair.repaired(faults, plans).count() == turn_repair.repaired_digests(faults, plans).count() == 0


def test_all_rows_damaged_away(spark, tmp_path):
    conversations = spark.createDataFrame([(c, t, "user", "So.") for c in range(300) for t in range(1)], "conv_id long, turn long, role string, text string")
    conversations.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()}
    kept = {r.conv_id for r in turn_repair.damaged(conversations).select("conv_id").distinct().collect()}
    assert len(got) == 300 and 250 < len(kept) < 300
    none = hashlib.sha256(b"").hexdigest()
    assert all((got[c].cost, got[c].audit, got[c].repaired_sha256) == (0, "", none) for c in set(got) - kept)
