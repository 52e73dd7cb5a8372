"""One interface for one-class detectors, and polygon layers scored by one of them."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, functions as F

from agrispark.operators import learning as E, models as M
from agrispark.operators.ranges import exact_percentiles


class Detector(Protocol):
    """What ``score_layer`` needs of a detector: bring your own by these two methods."""

    def fit(self, features: DataFrame) -> Detector:
        """Learn from rows that belong to the class."""

    def score(self, features: DataFrame) -> DataFrame:
        """All rows and columns with a double ``score``; higher is more normal."""


class Distance:
    """Scaled, projected on the components that keep a share of the variance, then the negative distance under a shrunk covariance.

    Two passes fit it; d * d values reach the driver. Flat columns are left as they are.
    """

    def __init__(self, columns: list[str], share: float = 0.99, least: int = 2):
        self.columns, self.share, self.least = columns, share, least

    def fit(self, features: DataFrame) -> Distance:
        self.mean, cov = M.moments(features, self.columns)
        if self.mean[0] is None:
            raise ValueError("no rows to learn from")
        self.support = features.count()
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1.0
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
        shares = np.cumsum(values) / max(values.sum(), 1e-300)
        kept = min(len(values), max(self.least, int(np.searchsorted(shares, self.share - 1e-12)) + 1))
        self.loads = vectors[:kept] / sd
        self.cov, self.shrinkage = M.shrunk(features, M.squared(self.columns, self.mean, self.loads), np.diag(values[:kept]))
        spread, axes = np.linalg.eigh(np.linalg.pinv(self.cov))
        self.white = np.sqrt(np.maximum(spread, 0))[:, None] * axes.T @ self.loads
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", -F.sqrt(M.squared(self.columns, self.mean, self.white)))


class Plain:
    """The negative distance under the covariance of the training rows, without scaling or projection. One pass fits it."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, features: DataFrame) -> Plain:
        self.mean, self.cov = M.moments(features, self.columns)
        if self.mean[0] is None:
            raise ValueError("no rows to learn from")
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", -M.mahalanobis(self.columns, self.mean, self.cov))


class Mixture:
    """The best of several Gaussian mixtures; the score is the log density."""

    def __init__(self, columns: list[str], k: int = 3):
        self.columns, self.k = columns, k

    def fit(self, features: DataFrame) -> Mixture:
        self.model, _ = E.fit_mixture(features, self.columns, self.k)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", E.mixture_score(self.model, self.columns))


class OneClass:
    """A one-class machine over random Fourier features."""

    def __init__(self, columns: list[str], nu: float = 0.1, features: int = 64, steps: int = 30):
        self.columns, self.nu, self.size, self.steps = columns, nu, features, steps

    def fit(self, features: DataFrame) -> OneClass:
        self.model = E.fit_one_class(features, self.columns, self.nu, self.size, self.steps)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", E.one_class_score(self.columns, self.model))


class Forest:
    """An isolation forest; rows keep the ``key`` that its samples are drawn by."""

    def __init__(self, columns: list[str], key: str, trees: int = 200, sample: int = 256):
        self.columns, self.key, self.trees, self.sample = columns, key, trees, sample

    def fit(self, features: DataFrame) -> Forest:
        self.forest, self.size = E.fit_forest(features, self.columns, self.key, self.trees, self.sample)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.join(E.forest_scores(features, self.columns, self.key, self.forest, self.size), self.key, "left")


class ExactOneClass:
    """The exact one-class machine, fitted on a bounded sample; a score of 0 and more is normal."""

    def __init__(self, columns: list[str], key: str, nu: float = 0.001, sample: int = 2000):
        self.columns, self.key, self.nu, self.sample = columns, key, nu, sample

    def fit(self, features: DataFrame) -> ExactOneClass:
        self.machine = E.fit_one_class_exact(features, self.columns, self.key, self.nu, self.sample)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        return features.join(E.one_class_exact_scores(features, self.columns, self.key, self.machine), self.key, "left")


def cut_at(detector: Detector, features: DataFrame, contamination: float) -> float:
    """The score under which a share of the training rows lies; exact, in a few passes."""
    return exact_percentiles(detector.score(features), "score", [contamination])[0]


def score_layer(layer: DataFrame, features: DataFrame, detector: Detector, cut: float, key: str = "obj") -> DataFrame:
    """The layer's rows with ``score`` and ``is_inlier``; both null for polygons without features."""
    found = detector.score(features).select(key, "score", (F.col("score") >= cut).alias("is_inlier"))
    return layer.drop("score", "is_inlier").join(found, key, "left")
