"""One-class detectors, principal components, visual words, and what is reported of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from agrispark.operators.models import dot, mahalanobis, moments
from agrispark.operators.ranges import exact_percentiles, running_sums
from agrispark.session import stored

# --- principal components --------------------------------------------------------------------------------------


def principal(df: DataFrame, columns: list[str], share: float = 0.95, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) that keep a share of the variance, and the shares of all; one pass, d * d values reach the driver."""
    mean, cov = moments(df, columns)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    total = values.sum()
    shares = values / total if total > 0 else np.full(len(values), 1 / len(values))
    kept = min(len(values), max(least, int(np.searchsorted(np.cumsum(shares), share - 1e-12)) + 1))
    return mean, vectors[:kept], shares


def projected(columns: list[str], mean: np.ndarray, components: np.ndarray) -> list[Column]:
    centred = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return [sum((x * float(w) for x, w in zip(centred[1:], row[1:], strict=True)), centred[0] * float(row[0])) for row in components]


def scree(df: DataFrame, columns: list[str]) -> DataFrame:
    """``component, share, cumulative, top`` (the column of greatest loading); d rows."""
    _, vectors, shares = principal(df, columns, 1.0, len(columns))
    rows = [(i + 1, float(s), float(c), columns[int(np.abs(v).argmax())]) for i, (s, c, v) in enumerate(zip(shares, np.cumsum(shares), vectors, strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, top string")


# --- distances, thresholds, reports ----------------------------------------------------------------------------


def thresholds(scored: DataFrame, column: str, shares: tuple[float, ...] = (0.95, 0.975, 0.99, 1.0)) -> DataFrame:
    """``pct, threshold`` (exact percentiles) with the least, mean and greatest score and its population deviation.

    Building the query finds the percentiles, in a few passes.
    """
    found = exact_percentiles(scored, column, list(shares))
    one = scored.agg(F.min(column).alias("lo"), F.avg(column).alias("mean"), F.max(column).alias("hi"), F.stddev_pop(column).alias("sd"))
    rows = [F.struct(F.lit(100 * s).alias("pct"), F.lit(x).cast("double").alias("threshold")) for s, x in zip(shares, found, strict=True)]
    return one.select(F.explode(F.array(*rows)).alias("r"), "lo", "mean", "hi", "sd").select("r.*", "lo", "mean", "hi", "sd")


def ecdf(scored: DataFrame, column: str) -> DataFrame:
    """``value, share``: the share of rows up to each distinct value; nulls count in none."""
    by = scored.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return running_sums(by, "value", {"upto": "n"}).crossJoin(F.broadcast(total)).select("value", (F.col("upto") / F.col("all")).alias("share"))  # one row


def score_histogram(scored: DataFrame, column: str, lo: float, hi: float, bins: int, inlier: Column) -> DataFrame:
    """``bin, inlier, n``; scores outside lo..hi go to bins 0 and ``bins`` + 1."""
    b = F.when(F.col(column) < lo, 0).when(F.col(column) >= hi, bins + 1).otherwise(F.floor((F.col(column) - lo) / (hi - lo) * bins) + 1)
    return scored.groupBy(b.cast("int").alias("bin"), inlier.alias("inlier")).agg(F.count(F.lit(1)).alias("n"))


def permutation_importance(df: DataFrame, columns: list[str], score, key: str, seed: int = 42) -> DataFrame:
    """``feature, drop``: how far the mean score falls when a column's values are dealt out anew.

    Values move by one place in a seeded order (MD5) within 256 slices of it, so no
    row meets all others in one task. score: a Column over ``columns``.
    """
    base = df.select(key, *columns)
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(F.substr(lot, F.lit(1), F.lit(2))).orderBy(lot, key)
    moved = base.select("*", *(F.coalesce(F.lag(c).over(w), F.col(c)).alias(f"_m_{c}") for c in columns))
    plain = moved.select("*", score.alias("_s"))
    out = None
    for c in columns:
        swapped = plain.withColumn(c, F.col(f"_m_{c}")).select((F.col("_s") - score).alias("d"))
        one = swapped.agg(F.avg("d").alias("drop")).select(F.lit(c).alias("feature"), "drop")
        out = one if out is None else out.unionByName(one)
    return out


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of ``columns`` (as doubles; rows with a null are left out) and how often each occurs, ``_n``.

    What iterates over rows reads these instead: far fewer where values recur, as those of quantised bands do, and never more.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))


# --- mixtures --------------------------------------------------------------------------------------------------


def fit_mixture(df: DataFrame, columns: list[str], k: int = 3, starts: int = 3, iterations: int = 100) -> tuple[object, float]:
    """The best of several Gaussian mixtures and its log-likelihood; all rows count, different ones are gone through."""
    v = counted(df, columns).select(array_to_vector(F.array(*columns)).alias("features"), "_n").persist()
    try:
        return _best_mixture(v, k, starts, iterations)
    finally:
        v.unpersist()


def _best_mixture(v: DataFrame, k: int, starts: int, iterations: int) -> tuple[object, float]:
    """Of weighted vectors, ``features, _n``."""
    fits = [GaussianMixture(k=k, seed=s, maxIter=iterations, weightCol="_n").fit(v) for s in range(starts)]
    best = max(fits, key=lambda m: m.summary.logLikelihood)
    return best, float(best.summary.logLikelihood)


def mixture_score(model, columns: list[str]) -> Column:
    """Log density as one expression (higher: more normal); 1e-9 is added to all variances, so that flat components have one."""
    parts = []
    for w, g in zip(model.weights, model.gaussians, strict=True):
        cov = np.asarray(g.cov.toArray()) + 1e-9 * np.eye(len(columns))
        _, logdet = np.linalg.slogdet(cov)
        const = np.log(max(w, 1e-300)) - 0.5 * (len(columns) * np.log(2 * np.pi) + logdet)
        d = mahalanobis(columns, np.asarray(g.mean.toArray()), cov)
        parts.append(F.lit(float(const)) - d * d / 2)
    return F.aggregate(
        F.transform(F.array(F.array(*parts)), lambda p: F.struct(F.array_max(p).alias("m"), p.alias("p"))), F.lit(0.0),
        lambda _, s: s["m"] + F.log(F.aggregate(s["p"], F.lit(0.0), lambda a, x: a + F.exp(x - s["m"]))),
    )


def bic_sweep(df: DataFrame, columns: list[str], most: int = 10, iterations: int = 30) -> DataFrame:
    """``k, bic, best`` of mixtures with 1..most components, one component in closed form; best: the least k of the lowest."""
    n, d, rows = df.count(), len(columns), []
    v = counted(df, columns).select(array_to_vector(F.array(*columns)).alias("features"), "_n").persist()  # for all sizes
    try:
        for k in range(1, most + 1):
            if k == 1:
                _, cov = moments(df, columns)
                ll = -0.5 * n * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1] + d)
            else:
                _, ll = _best_mixture(v, k, 1, iterations)
            rows.append((k, float(-2 * ll + (k - 1 + k * d + k * d * (d + 1) // 2) * np.log(max(n, 1)))))
    finally:
        v.unpersist()
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, bic double, best boolean")


# --- isolation forest ------------------------------------------------------------------------------------------


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes ``feature, cut, left, right, path``; leaves have feature -1."""
    nodes: list[list] = [[]]
    todo = [(0, x, 0)]
    while todo:
        at, part, level = todo.pop()
        wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else np.empty(0, int)
        if level >= depth or not len(wide):
            nodes[at] = [-1, 0.0, -1, -1, level + mean_path(len(part))]
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] <= cut
        nodes += [[], []]
        nodes[at] = [f, cut, len(nodes) - 2, len(nodes) - 1, 0.0]
        todo += [(len(nodes) - 2, part[low], level + 1), (len(nodes) - 1, part[~low], level + 1)]
    return [tuple(n) for n in nodes]


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(df: DataFrame, columns: list[str], key: str, trees: int = 200, sample: int = 256, seed: int = 42) -> tuple[list[np.ndarray], int]:
    """Isolation trees on hashed samples of about ``sample`` rows each (all rows, if there are fewer): node tables and sample size.

    trees * sample rows are shuffled and 2 * trees * sample nodes reach the driver, whatever the input's size.
    """
    n = df.count()
    size = max(min(sample, n), 1)
    share = min(1.0, sample / max(n, 1))
    lot = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0)
    drawn = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    drawn = drawn.withColumn("_t", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lot)))
    depth = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_t"].iloc[0])
        pdf = pdf.sort_values(key)
        nodes = _tree(pdf[columns].to_numpy(), np.random.default_rng([seed, t]), depth)
        out = pd.DataFrame(nodes, columns=["f", "cut", "low", "high", "path"])
        return out.assign(t=t, node=range(len(out)))

    got = drawn.groupBy("_t").applyInPandas(grow, "f int, cut double, low int, high int, path double, t int, node int").toPandas()
    return [g.sort_values("node")[["f", "cut", "low", "high", "path"]].to_numpy() for _, g in got.groupby("t")], size


def forest_scores(df: DataFrame, columns: list[str], key: str, forest: list[np.ndarray], size: int) -> DataFrame:
    """``key, score``: minus 2 to the power of mean depth over its norm (higher: more normal); rows with nulls have none."""
    norm = max(mean_path(size), 1e-9)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, rows, total = b[columns].to_numpy(float), np.arange(len(b)), np.zeros(len(b))
            for t in forest:
                at = np.zeros(len(b), int)
                while True:
                    f = t[at, 0].astype(int)
                    if (f < 0).all():
                        break
                    low = x[rows, np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(f < 0, at, np.where(low, t[at, 2], t[at, 3]).astype(int))
                total += t[at, 4]
            yield pd.DataFrame({key: b[key], "score": -np.power(2.0, -total / len(forest) / norm)})

    return df.select(key, *columns).na.drop().mapInPandas(run, f"{key} {kind}, score double")


# --- one-class support vectors ---------------------------------------------------------------------------------


def fit_one_class(df: DataFrame, columns: list[str], nu: float = 0.1, features: int = 64, steps: int = 30, seed: int = 42) -> dict[str, np.ndarray | float]:
    """A one-class machine on random Fourier features of a radial kernel, gamma = 1 / (d * variance), by averaged subgradient steps.

    Every step is one pass over all different rows, each as often as it occurs, whose partial sums (``features`` + 2
    numbers a partition) are added up by Spark.
    """
    mean, cov = moments(df, columns)
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    rng = np.random.default_rng(seed)
    w_in, shift = rng.normal(size=(len(columns), features)) * np.sqrt(2 / len(columns)), rng.uniform(0, 2 * np.pi, features)

    def phi(x: np.ndarray) -> np.ndarray:
        return np.cos((x - mean) / sd @ w_in + shift) * np.sqrt(2 / features)

    rows = counted(df, columns).persist()
    w, rho, kept = np.zeros(features), 0.0, []
    names = [f"g{i}" for i in range(features)] + ["out", "n"]
    try:
        for step in range(1, steps + 1):

            def part(batches: Iterator[pd.DataFrame], w=w, rho=rho) -> Iterator[pd.DataFrame]:
                s = np.zeros(features + 2)
                for b in batches:
                    z, times = phi(b[columns].to_numpy()), b["_n"].to_numpy()
                    off = np.where(z @ w <= rho, times, 0.0)
                    s += np.concatenate([off @ z, [off.sum(), times.sum()]])
                yield pd.DataFrame([s], columns=names)

            got = np.array(rows.mapInPandas(part, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c) for c in names)).first(), float)
            n = max(got[-1], 1.0)
            rate = 1 / np.sqrt(step)
            w = w - rate * (w - got[:features] / (nu * n))
            rho = rho - rate * (got[-2] / (nu * n) - 1)
            if step > steps // 2:
                kept.append(np.append(w, rho))
    finally:
        rows.unpersist()
    avg = np.mean(kept, axis=0)
    return {"mean": mean, "sd": sd, "w_in": w_in, "shift": shift, "w": avg[:-1], "rho": float(avg[-1])}


def one_class_score(columns: list[str], m: dict) -> Column:
    """Its decision value (higher: more normal), before any offset, by matrices of 2,000 rows; null where a value is null."""
    size = np.sqrt(2 / len(m["w"]))

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        out = np.empty(len(values[0]))
        for a in range(0, len(out), 2000):
            x = np.column_stack([v.to_numpy(float)[a : a + 2000] for v in values])
            out[a : a + 2000] = np.cos((x - m["mean"]) / m["sd"] @ m["w_in"] + m["shift"]) @ m["w"] * size - m["rho"]
        return pd.Series(out)

    has = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(has, score(*(F.col(c).cast("double") for c in columns)))


def one_class_dual(kernel: np.ndarray, nu: float, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and offset of the exact one-class machine of a kernel matrix: least w'Kw / 2 with weights in 0..1 that sum to nu * n.

    Two weights are moved at a time, the pair that breaks the conditions of
    the optimum most, by the step that is best for it; ends when no pair breaks
    them by more than the tolerance.
    """
    n = len(kernel)
    total = nu * n
    w = np.clip(total - np.arange(n), 0.0, 1.0)
    slope = kernel @ w
    while True:
        up, down = np.where(w < 1, slope, np.inf), np.where(w > 0, slope, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        gap = slope[j] - slope[i]
        if not gap > tolerance:
            break
        step = min(gap / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12), 1 - w[i], w[j])
        w[i] = 1.0 if step == 1 - w[i] else w[i] + step
        w[j] = 0.0 if step == w[j] else w[j] - step
        slope += step * (kernel[:, i] - kernel[:, j])
    free = (w > 0) & (w < 1)
    if free.any():
        return w, float(slope[free].mean())
    ends = slope[w >= 1].max(initial=-np.inf), slope[w <= 0].min(initial=np.inf)
    return w, float(np.mean([e for e in ends if np.isfinite(e)]))


def fit_one_class_exact(df: DataFrame, columns: list[str], key: str, nu: float = 0.001, sample: int = 2000, seed: int = 42) -> dict[str, np.ndarray | float]:
    """The exact one-class machine with a radial kernel, gamma = 1 / (d * variance of all scaled values).

    Scaling is by all rows (one pass). The machine is fitted on at most
    ``sample`` rows, those of least seeded hash of ``key`` (all, if there are
    no more): that many rows and their kernel matrix are all the driver holds.
    Rows with nulls are left out; no rows are an error.
    """
    mean, cov = moments(df, columns)
    if mean[0] is None:
        raise ValueError("no rows to learn from")
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    rows = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop(subset=columns)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key, *columns).limit(sample).toPandas()
    x = (drawn[columns].to_numpy(float) - mean) / sd
    gamma = 1 / (len(columns) * x.var()) if x.var() > 0 else 1.0
    w, rho = one_class_dual(radial(x, x, gamma), nu)
    return {"mean": mean, "sd": sd, "x": x[w > 0], "w": w[w > 0], "rho": rho, "gamma": gamma}


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def one_class_exact_scores(df: DataFrame, columns: list[str], key: str, machine: dict) -> DataFrame:
    """``key, score``: the decision value, under 0 for outliers; rows with nulls have none. The support vectors go along with the task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = (b[columns].to_numpy(float) - machine["mean"]) / machine["sd"]
            parts = [radial(x[i : i + 1000], machine["x"], machine["gamma"]) @ machine["w"] for i in range(0, len(x), 1000)]
            yield pd.DataFrame({key: b[key], "score": np.concatenate(parts) - machine["rho"] if parts else []})

    return df.select(key, *columns).na.drop(subset=columns).mapInPandas(run, f"{key} {kind}, score double")


# --- visual words ----------------------------------------------------------------------------------------------


def vocabulary(descriptors: DataFrame, k: int = 100, share: float = 1.0, seed: int = 42) -> np.ndarray:
    """k-means centres of a seeded share of all descriptors."""
    d = descriptors.where(F.pmod(F.xxhash64(F.lit(seed), "desc_id"), F.lit(10_000)) < int(share * 10_000)).select(array_to_vector("vec").alias("features"))
    return np.array(KMeans(k=k, seed=seed).fit(d).clusterCenters())


def nearest_word(vec: Column, words: np.ndarray) -> Column:
    """The number of the nearest centre, the first of several."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.array(*(F.lit(float(x)) for x in w)).alias("c")) for i, w in enumerate(words)))
    far = lambda w: F.aggregate(F.zip_with(w["c"], vec, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(table, lambda w: F.struct(far(w).alias("d"), w["i"].alias("i"))))["i"]


def tfidf(assigned: DataFrame, image: str = "image_id") -> DataFrame:
    """``image, word, weight``: term share times ln(images / (images with it + 1)), scaled to length 1 per image; sparse, zero vectors have no row."""
    tf = assigned.groupBy(image, "word").agg(F.count(F.lit(1)).alias("n"))
    total = assigned.groupBy(image).agg(F.count(F.lit(1)).alias("t"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    images = total.agg(F.count(F.lit(1)).alias("images"))
    w = F.col("n") / (F.col("t") + 1e-6) * F.log(F.col("images") / (F.col("df") + 1))
    raw = tf.join(total, image).join(df, "word").crossJoin(F.broadcast(images)).select(image, "word", w.alias("w"))  # one row
    size = raw.groupBy(image).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, image).where("size > 0 and w <> 0").select(image, "word", (F.col("w") / F.col("size")).alias("weight"))


def histogram_distance(a: Column, b: Column, metric: str) -> Column:
    """chi_square: half the sum of (a - b)² / (a + b + 1e-10); intersection: the sum of least values."""
    term = {"chi_square": lambda x, y: (x - y) * (x - y) / (x + y + 1e-10) / 2, "intersection": lambda x, y: F.least(x, y)}[metric]
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def histogram_distances(queries: DataFrame, base: DataFrame, most: int = 10_000, dealt: int = 1 << 22) -> DataFrame:
    """``query_id, desc_id, chi_square, intersection`` of a stated query set (``query_id, qvec``) and every row of ``base`` (``desc_id, vec``).

    The query set goes to all tasks in blocks of about ``most`` rows at most,
    ``base`` is dealt into tasks of about ``dealt`` pairs each. Both are dealt and
    sorted by vector, so that equal vectors come one after the other: they are
    summed once, and their pairs take little space where they are written.
    Tasks sum place by place over small squares of pairs, in the order of
    ``histogram_distance``, so that both give the same doubles and nulls.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")).withColumn("h", F.xxhash64("qvec"))
    rows = base.select(F.col("desc_id").cast("long").alias("desc_id"), F.col("vec").cast("array<double>").alias("vec")).withColumn("h", F.xxhash64("vec"))
    n = q.count()
    parts = [q]
    if n > most:
        q = stored(q.repartitionByRange(-(-2 * n // most), "h", "query_id").withColumn("block", F.spark_partition_id()))
        parts = [q.where(F.col("block") == i) for i in range(q.agg(F.max("block")).first()[0] + 1)]
    tasks = max(min(len(parts), 2), -(-n * rows.count() // (len(parts) * dealt)))  # a union of single partitions is one task
    rows = rows.repartitionByRange(tasks, "h", "desc_id").sortWithinPartitions("h", "desc_id").select("desc_id", "vec")
    return reduce(DataFrame.union, [_histogram_block(x.select("h", "query_id", "qvec"), rows) for x in parts])


def _kinds(vec: pa.ListArray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Vectors by length (-1: null) and by whether one holds a null: ``length, holds, places, rows``; a null is 0 in the rows."""
    size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
    holds = np.zeros(len(vec), bool)
    flat = pc.list_flatten(vec)
    if flat.null_count:
        holds[pc.list_parent_indices(vec).filter(pc.is_null(flat)).to_numpy()] = True
    for n in np.unique(size).tolist():
        for odd in (False, True):
            at = np.flatnonzero((size == n) & (holds == odd))
            if len(at):
                yield n, odd, at, pc.list_flatten(vec.take(pa.array(at)))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal rows begins, and the run of each row."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _strips(n: int, most: int) -> list[tuple[int, int]]:
    """``n`` rows in strips of ``most`` rows, then of eights, as Parquet packs numbers by eights: ids that come again in whole bytes compress."""
    cuts = sorted({*range(0, n, most), n - n % most + n % most // 8 * 8, n})
    return list(zip(cuts, cuts[1:]))


def _histogram_block(queries: DataFrame, base: DataFrame, across: int = 2016, down: int = 16) -> DataFrame:
    asked = queries.toArrow().sort_by([("h", "ascending"), ("query_id", "ascending")]).select(["query_id", "qvec"]).combine_chunks()  # a block of the stated query set, of bounded size
    shared = base.sparkSession.sparkContext.broadcast(asked.to_batches()[0] if asked.num_rows else None)

    def rows(flat: pa.Array, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Values, a row for each vector, and which of them are missing."""
        shape = n, max(size, 0)
        return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)

    def square(q: np.ndarray, v: np.ndarray, runs: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """chi_square and intersection of all rows of ``q`` with those of all ``runs``, for each of which ``v`` has a column."""
        first, copies = _runs(q)
        q = q[first]
        chi, least = np.zeros((2, len(q), v.shape[1]))
        up, low = np.empty((2, len(q), v.shape[1]))
        for i in range(q.shape[1]):
            x, y = q[:, i, None], v[i]
            np.subtract(x, y, out=up)
            np.multiply(up, up, out=up)
            np.add(x, y, out=low)
            low += 1e-10
            up /= low
            up /= 2
            chi += up
            np.fmin(x, y, out=low)
            least += low
        if len(first) < len(copies):
            chi, least = chi[copies], least[copies]
        if v.shape[1] < len(runs):
            chi, least = chi[:, runs], least[:, runs]
        return pa.array(chi.ravel()), pa.array(least.ravel())

    def odd_square(q: np.ndarray, no_q: np.ndarray, v: np.ndarray, no_v: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The same where a place is missing on a side: no chi_square, and the value of the other side is the lesser."""
        wide = max(q.shape[1], v.shape[0])
        pad = lambda x, axis, fill: np.pad(x, [(0, wide - x.shape[k] if k == axis else 0) for k in (0, 1)], constant_values=fill)
        q, no_q, v, no_v = pad(q, 1, 0.0), pad(no_q, 1, True), pad(v, 0, 0.0), pad(no_v, 0, True)
        least, none = np.zeros((len(q), v.shape[1])), np.zeros((len(q), v.shape[1]), bool)
        for i in range(wide):
            x, y, no_x, no_y = q[:, i, None], v[i], no_q[:, i, None], no_v[i]
            least += np.where(no_x, y, np.where(no_y, x, np.fmin(x, y)))
            none |= no_x & no_y
        return pa.nulls(least.size, pa.float64()), pa.array(least.ravel(), mask=none.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        if asked is None:
            return
        kinds = [(size, odd, asked.column(0).take(pa.array(at)), *rows(flat, len(at), size)) for size, odd, at, flat in _kinds(asked.column(1))]
        for batch in batches:
            for own, holds, at, flat in _kinds(batch.column(1)):
                whole, missing = rows(flat, len(at), own)
                for a, z in _strips(len(at), across):
                    ids = batch.column(0).take(pa.array(at[a:z]))
                    v, no_v = whole[a:z].T, missing[a:z].T
                    first, runs = _runs(v.T)
                    single = v[:, first].copy()
                    for size, odd, qids, q, no_q in kinds:
                        for s in range(0, len(q), down):
                            few = len(q[s : s + down])
                            if own < 0 or size < 0:
                                chi = least = pa.nulls(few * len(ids), pa.float64())
                            elif own == size and not holds and not odd:
                                chi, least = square(q[s : s + few], single, runs)
                            else:
                                chi, least = odd_square(q[s : s + few], no_q[s : s + few], v, no_v)
                            qid = qids.slice(s, few).take(pa.array(np.repeat(np.arange(few), len(ids))))
                            did = ids.take(pa.array(np.tile(np.arange(len(ids)), few)))
                            yield pa.RecordBatch.from_arrays([qid, did, chi, least], names=["query_id", "desc_id", "chi_square", "intersection"])

    return base.mapInArrow(run, "query_id long, desc_id long, chi_square double, intersection double")


def in_group(neighbours: DataFrame, least: float, needed: int = 3, top: int = 5) -> DataFrame:
    """``query_id, member``: whether at least ``needed`` of a query's ``top`` best reach a score."""
    hits = F.count_if((F.col("rank") <= top) & (F.col("score") >= least))
    return neighbours.groupBy("query_id").agg((hits >= needed).alias("member"))
