"""Detectors on many columns: plans that don't grow with the square of the columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrispark.operators import detectors, models


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 16000
    return x, spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "obj long, " + ", ".join(f"c{i} double" for i in range(12)))


COLS = [f"c{i}" for i in range(12)]


def test_moments_of_many_columns(spark, wide):
    x, df = wide
    mean, cov = models.moments(df, COLS)
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(cov, np.cov(x.T, bias=True), atol=1e-8)
    holed = df.select("obj", *(F.when(F.col("obj") % 7 != i % 7, F.col(c)).alias(c) for i, c in enumerate(COLS)))
    plain, by_matrix = models.moments(holed, COLS, few=12), models.moments(holed, COLS)
    np.testing.assert_allclose(by_matrix[0], plain[0])
    np.testing.assert_allclose(by_matrix[1], plain[1], atol=1e-8)


def test_distance_on_many_columns(spark, wide):
    x, df = wide
    scored = detectors.Distance(COLS).fit(df).score(df)
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 40_000  # a product for each two columns made it larger
    got = np.array([r.score for r in scored.orderBy("obj").collect()])
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.99 - 1e-12)) + 1
    p, cov = z @ vectors[:, :k], np.diag(values[:k])
    mu = values[:k].mean()
    delta = ((cov - mu * np.eye(k)) ** 2).sum() / k
    beta = min(delta, (((p**2).sum(1) ** 2).mean() - (cov**2).sum()) / (k * len(x)))
    cov = (1 - beta / delta) * cov + beta / delta * mu * np.eye(k)
    np.testing.assert_allclose(got, -np.sqrt(np.einsum("ij,jk,ik->i", p, np.linalg.inv(cov), p)), rtol=1e-6)
