"""Query sets beyond one broadcast."""

import numpy as np

from pyspark.sql import functions as F

from agrispark.operators import learning, models
from agrispark.plans.register import rounded


def test_blocks_give_the_same(spark):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "desc_id long, vec array<double>")
    q = d.selectExpr("desc_id as query_id", "vec as qvec")
    pairs = lambda most: sorted((r.query_id, r.desc_id) for r in models.against_all(q, d, most).collect())
    assert pairs(7) == pairs(100) == [(a, b) for a in range(60) for b in range(60)]


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(300, 6)), 1)
    points[50:90] = points[7]  # more equal vectors than are asked for
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(999, None)], "desc_id long, vec array<double>").repartition(4)
    norm = np.linalg.norm(points, axis=1)
    for metric, score in (("cosine", points @ points.T / (norm[:, None] * norm + 1e-12)), ("euclidean", -np.linalg.norm(points[:, None] - points[None], axis=2))):
        want = []
        for q in range(0, 300, 7):
            best = sorted((-round(float(s), 9), i) for i, s in enumerate(score[q]) if i != q)[:5]
            want += [(q, i, n + 1) for n, (_, i) in enumerate(best)]
        for most in (1000, 9):
            got = models.similar(d.where("desc_id % 7 = 0 and desc_id < 300"), d, 5, metric, most).collect()
            assert sorted((r.query_id, r.desc_id, r["rank"]) for r in got) == sorted(want)


def test_histogram_distances_in_tasks(spark):
    """The same doubles as the expression, odd vectors included, and no nested-loop join."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.uniform(0, 1, 6)]) for i in range(57)] + [(57, None), (58, [0.5, None, 0.1, 0.1, 0.1, 0.1]), (59, [1.0, 2.0]), (60, [float("nan")] + [0.25] * 5)]
    base = spark.createDataFrame(rows, "desc_id long, vec array<double>")
    asked = base.where("desc_id % 3 = 0 OR desc_id > 56").select(base.desc_id.alias("query_id"), base.vec.alias("qvec"))
    pair = lambda m: learning.histogram_distance(F.col("qvec"), F.col("vec"), m).alias(m)
    want = models.against_all(asked, base).select("query_id", "desc_id", pair("chi_square"), pair("intersection"))
    for most in (100, 8):
        got = learning.histogram_distances(asked, base, most)
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        key = lambda rows: sorted(map(repr, rows))
        assert key(got.collect()) == key(want.collect())
    assert learning.histogram_distances(asked.limit(0), base).count() == 0


def test_histogram_pairs_of_equal_vectors(spark, tmp_path):
    """Copies of a vector, wherever they lie, are summed once and written one after the other; a file of one task is dealt into many."""
    r = np.random.default_rng(5)
    points = r.uniform(0, 1, (2000, 8))
    rows = [(i, points[i % 2000].tolist()) for i in range(12_003)]
    base = spark.createDataFrame(rows, "desc_id long, vec array<double>").coalesce(1)
    asked = base.where("desc_id < 14 OR desc_id % 1000 = 0").select(base.desc_id.alias("query_id"), base.vec.alias("qvec"))
    pair = lambda m: learning.histogram_distance(F.col("qvec"), F.col("vec"), m).alias(m)
    want = models.against_all(asked, base).select("query_id", "desc_id", pair("chi_square"), pair("intersection"))
    pairs = want.count()
    for most in (1000, 8):
        got = learning.histogram_distances(asked, base, most, dealt=50_000)
        assert got.rdd.getNumPartitions() >= 6
        path = tmp_path / str(most)
        got.write.parquet(str(path))
        back = spark.read.parquet(str(path))
        assert back.count() == pairs and back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
        assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 10 * pairs  # two numbers that never come again take 16 bytes


def test_strips_hold_each_row_once():
    for n in (0, 1, 7, 8, 9, 20, 24, 25, 31, 48, 100):
        cut = learning._strips(n, 24)
        assert [i for a, z in cut for i in range(a, z)] == list(range(n))
        assert all((z - a) % 8 == 0 or z == n and z - a < 8 for a, z in cut)


def test_rounded_is_round(spark):
    r = np.random.default_rng(6)
    halves = (np.arange(4000) * 7919 + 0.5) / 1e6
    some = [*halves, *np.nextafter(halves, 0), *np.nextafter(halves, 9e9), *r.normal(0, 5, 4000), *r.uniform(0, 2e3, 4000), 0.0, -0.0, 4e-7, 5e-7, -5e-7, 999.9999995, 1e9 + 0.0000005, 1e17, 1e300, float("inf"), float("-inf"), float("nan")]
    x = spark.createDataFrame([(float(v),) for v in some] + [(-float(v),) for v in some] + [(None,)], "x double")
    for places in (3, 6):
        assert x.where(~rounded("x", places).eqNullSafe(F.round("x", places))).isEmpty()
