"""Learners go through different rows, each as often as it occurs."""

import numpy as np
import pytest

from agrispark.operators import learning


def test_repeated_rows_are_counted_once(spark):
    rows = [(float(i % 7), float(i % 5)) for i in range(700)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    each = learning.counted(df, ["a", "b"]).collect()
    assert len(each) == 35 and all(r["_n"] == 20 for r in each)
    m = learning.fit_one_class(df, ["a", "b"], features=8, steps=2)
    x = np.array([[3.0, 2.0]])
    want = (np.cos((x - m["mean"]) / m["sd"] @ m["w_in"] + m["shift"]) * np.sqrt(2 / 8)) @ m["w"] - m["rho"]
    got = spark.createDataFrame([(3, 2), (None, 2)], "a int, b int").select(learning.one_class_score(["a", "b"], m).alias("s")).collect()
    assert got[0].s == pytest.approx(float(want[0]), abs=1e-12) and got[1].s is None
