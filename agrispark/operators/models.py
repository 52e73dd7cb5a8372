"""One-class scoring, descriptor search, and routes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def moments(df: DataFrame, columns: list[str], few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (population, of the rows that have both values); d values and d * d for each task reach the driver.

    One pass of aggregates for a ``few`` columns. Of more, d * d aggregates are more than one plan holds: a second pass
    sums the products of centred values as matrices, task by task.
    """
    d = len(columns)
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    if d <= few:
        one = df.agg(*means, *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
        mean = np.array([one[f"m{i}"] for i in range(d)])
        return mean, np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    one = df.agg(*means).first()
    mean = np.array([one[f"m{i}"] for i in range(d)])
    centre = np.array([0.0 if m is None else m for m in mean])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, d, d))
        for batch in batches:
            has = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(has > 0, x - centre, 0.0)
            total += np.stack([has.T @ has, x.T @ has, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(sums, "s array<double>").collect()  # a row for each task
    n, own, both = np.sum([np.reshape(r["s"], (3, d, d)) for r in parts], axis=0)
    n = np.where(n > 0, n, np.nan)
    return mean, both / n - own / n * (own / n).T


def ledoit_wolf(df: DataFrame, columns: list[str], mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards its mean variance, and the shrinkage; needs one more pass."""
    centred = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return shrunk(df, sum((x * x for x in centred[1:]), centred[0] * centred[0]), cov)


def shrunk(df: DataFrame, square: Column, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """``ledoit_wolf`` by the squared distance of a row from the mean."""
    d = len(cov)
    r = df.agg(F.avg(square**2).alias("q"), F.count(F.lit(1)).alias("n")).first()
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
    beta = min(delta, (r["q"] - (cov**2).sum()) / (d * r["n"]))
    shrink = 0.0 if delta == 0 else max(beta, 0.0) / delta
    return (1 - shrink) * cov + shrink * mu * np.eye(d), shrink


def squared(columns: list[str], mean: np.ndarray, matrix: np.ndarray) -> Column:
    """The squared length of ``matrix @ (row - mean)``, as an expression whose size doesn't grow with the matrix; null if a value is null."""
    centred = F.transform(F.array(*(F.col(c).cast("double") for c in columns)), lambda x, i: x - F.get(F.lit([float(m) for m in mean]), i))
    return F.aggregate(F.lit(matrix.tolist()), F.lit(0.0), lambda s, row: s + F.pow(dot(row, centred), F.lit(2.0)))


def mahalanobis(columns: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Distance as one expression over the columns; a singular covariance takes its pseudo-inverse."""
    inv = np.linalg.pinv(cov)
    c = [F.col(x) - float(m) for x, m in zip(columns, mean, strict=True)]
    terms = [c[i] * c[j] * float(inv[i, j]) for i in range(len(c)) for j in range(len(c))]
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def against_all(queries: DataFrame, base: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row of a stated query set (``query_id``) beside every row of ``base``.

    A set of more than ``most`` rows is dealt by a hash of its id into blocks of
    half as many on average, each of which is broadcast by itself.
    """
    n = queries.count()
    blocks = 1 if n <= most else -(-2 * n // most)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [base.crossJoin(F.broadcast(queries.where(block == i) if blocks > 1 else queries)) for i in range(blocks)]
    return reduce(DataFrame.union, parts)


def _proposed(base: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """For each batch of ``base`` and each query of a bounded block the rows that may be among the k best: ``query_id, qvec, desc_id, vec``.

    Scores by matrix products choose generously (all within 3e-9 of the k-th); what counts is scored again.
    """
    rows = queries.orderBy("query_id").collect()  # a block of the stated query set, of bounded size
    ids, points = np.array([r["query_id"] for r in rows], np.int64), np.array([r["qvec"] for r in rows], float)
    shared = base.sparkSession.sparkContext.broadcast((ids, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = shared.value
        for batch in batches:
            own, vec = batch.column(0).to_numpy(), batch.column(1)
            if not len(own) or not len(ids):
                continue
            v = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            step = max(1, 1_000_000 // len(own))  # 8 MB of scores at once
            for i in range(0, len(ids), step):
                q = points[i : i + step]
                both = v @ q.T
                if metric == "cosine":
                    score = both / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1) + 1e-12)
                else:
                    score = -np.sqrt(np.maximum((v * v).sum(1)[:, None] + (q * q).sum(1) - 2 * both, 0))
                score[own[:, None] == ids[i : i + step]] = -np.inf
                least = np.partition(score, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(len(q), -np.inf)
                slack = 3e-9 if metric == "cosine" else 1e-6 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                r, c = np.nonzero((score >= least - slack) & np.isfinite(score))
                flat = pa.array(q[c].ravel())
                qvec = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * q.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + c]), qvec, pa.array(own[r]), vec.take(pa.array(r))], names=["query_id", "qvec", "desc_id", "vec"])

    kinds = "query_id long, qvec array<double>, desc_id long, vec array<double>"
    whole = base.where(F.col("vec").isNotNull()).select(F.col("desc_id").cast("long").alias("desc_id"), F.col("vec").cast("array<double>").alias("vec"))
    return whole.mapInArrow(run, kinds)


def similar(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "cosine", most: int = 10_000) -> DataFrame:
    """Each query's k best of ``base`` (``desc_id, vec``), itself left out: ``query_id, desc_id, score, rank``.

    The stated query set goes to all tasks in blocks of about ``most`` rows at most; each batch keeps the best of a query before anything is shuffled.
    Vectors are of one length; null ones match nothing.
    """
    q = queries.where(F.col("vec").isNotNull()).select(F.col("desc_id").alias("query_id"), F.col("vec").alias("qvec"))
    n = q.count()
    blocks = 1 if n <= most else -(-2 * n // most)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    pairs = reduce(DataFrame.union, [_proposed(base, q.where(block == i), k, metric) for i in range(blocks)])
    if metric == "cosine":
        score = dot("vec", "qvec") / (F.sqrt(dot("vec", "vec")) * F.sqrt(dot("qvec", "qvec")) + 1e-12)
    else:
        score = -F.sqrt(F.aggregate(F.zip_with("vec", "qvec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "desc_id")
    return pairs.select("query_id", "desc_id", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_similarity(base: DataFrame) -> DataFrame:
    """Each vector's mean cosine to all others, from the sum of unit vectors and not from pairs: ``desc_id, mean_sim``."""
    norm = F.sqrt(dot("vec", "vec"))
    unit = base.select("desc_id", F.transform("vec", lambda x: x / (norm + 1e-12)).alias("u"))
    total = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = total.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.lit(1).alias("one")).select(F.col("s.x").alias("sum"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    both = unit.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n))  # one row each
    return both.select("desc_id", ((dot("u", "sum") - dot("u", "u")) / (F.col("n") - 1)).alias("mean_sim"))


def mean_distance(base: DataFrame, block: int = 512, most: int = 1 << 16, dealt: int = 16) -> DataFrame:
    """Each vector's mean euclidean distance to all others: ``desc_id, mean_dist``; null where there is no other.

    Rows are dealt by a hash of their id into blocks, and each two blocks meet
    in one task, where matrix products give all their distances, a strip at a
    time; only sums for each row come out. Blocks have ``block`` rows until
    there are ``dealt`` of them and grow with the table from there to ``most``
    rows, so up to ``dealt * most`` rows each travels ``dealt`` times. A task
    holds two blocks and a strip of their distances. Vectors are of one length;
    null ones are left out, and an id given twice counts as two vectors of one mean.
    """
    rows = base.where(F.col("vec").isNotNull()).select("desc_id", F.col("vec").cast("array<double>").alias("vec"))
    n = rows.count()
    blocks = max(1, min(-(-n // block), max(dealt, -(-n // most))))
    own = F.pmod(F.xxhash64("desc_id"), F.lit(blocks)).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the distances between all rows of both, by row of each."""
        down, across = np.zeros(len(x)), np.zeros(len(y))
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        step = max(1, 2_000_000 // max(len(y), 1))
        for s in range(0, len(x), step):
            size = xx[s : s + step, None] + yy
            d = size - 2 * (x[s : s + step] @ y.T)
            a, b = np.nonzero(d < 1e-5 * size)  # too near for the product to tell
            d[a, b] = ((x[s + a] - y[b]) ** 2).sum(1)
            d = np.sqrt(d)
            down[s : s + step] += d.sum(1)
            across += d.sum(0)
        return down, across

    def meet(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        vec = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        if i == j:
            return pa.table({"desc_id": table["desc_id"], "d": sums(vec, vec)[0]})
        first = table["own"].to_numpy() == i
        d = np.empty(len(vec))
        d[first], d[~first] = sums(vec[first], vec[~first])
        return pa.table({"desc_id": table["desc_id"], "d": d})

    kind = base.schema["desc_id"].dataType.simpleString()
    met = met.select("i", "j", "own", "desc_id", "vec").groupBy("i", "j").applyInArrow(meet, f"desc_id {kind}, d double")
    times = rows.groupBy("desc_id").agg(F.count(F.lit(1)).alias("times"))
    total = met.groupBy("desc_id").agg(F.sum("d").alias("d")).join(times, "desc_id")
    return total.select("desc_id", F.when(F.lit(n > 1), F.col("d") / F.col("times") / F.lit(max(n - 1, 1))).alias("mean_dist"))


def outliers(base: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """``desc_id, score`` of vectors unlike all others: a mean similarity under the threshold, or a mean distance over it."""
    if metric == "cosine":
        return mean_similarity(base).select("desc_id", F.col("mean_sim").alias("score")).where(F.col("score") < threshold)
    return mean_distance(base).select("desc_id", F.col("mean_dist").alias("score")).where(F.col("score") > threshold)


def nearest_order(points: np.ndarray, start: int = 0) -> list[int]:
    """Nearest-neighbour order from one point."""
    left, route = np.ones(len(points), bool), [start]
    left[start] = False
    for _ in range(len(points) - 1):
        rest = np.flatnonzero(left)
        d = np.hypot(*(points[rest] - points[route[-1]]).T)
        route.append(int(rest[d.argmin()]))
        left[route[-1]] = False
    return route


def two_opt(points: np.ndarray, route: list[int], near: int | None = None) -> list[int]:
    """2-opt on the open path until nothing is gained; with ``near``, a point is joined only to that many nearest points."""
    n = len(points)
    route = np.array(route)
    close = None
    if near is not None and near < n - 1:
        close = np.array([np.argsort(np.hypot(*(points - p).T), kind="stable")[1 : near + 1] for p in points])
    gained = n > 3
    while gained:
        gained = False
        p = points[route]
        place = np.argsort(route)
        for i in range(n - 2):
            j = np.arange(i + 2, n) if close is None else place[close[route[i]]]
            j = j[j > i + 1]
            if not len(j):
                continue
            old = np.hypot(*(p[i] - p[i + 1])) + np.where(j + 1 < n, np.hypot(*(p[j] - p[np.minimum(j + 1, n - 1)]).T), 0)
            new = np.hypot(*(p[i] - p[j]).T) + np.where(j + 1 < n, np.hypot(*(p[i + 1] - p[np.minimum(j + 1, n - 1)]).T), 0)
            k = int((old - new).argmax())
            if old[k] - new[k] > 1e-9:
                route[i + 1 : j[k] + 1] = route[i + 1 : j[k] + 1][::-1].copy()
                p, place = points[route], np.argsort(route)
                gained = True
    return route.tolist()


def ranked(points: DataFrame, group: str, column: str, tie: str, most: int = 1_000_000) -> DataFrame:
    """With ``_rank``: 0, 1, ... in each group by ``column``, then ``tie``; no task sorts a group.

    Approximate quantiles cut the column's range into parts of about ``most``
    rows (64 parts at least); a row's rank is that in its part after the sizes
    of the group's parts before it. Rows of one value share a part.
    """
    parts = max(64, -(-points.count() // most))
    cuts = sorted(set(points.approxQuantile(column, [i / parts for i in range(1, parts)], 0.5 / parts)))
    lower = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)
    dealt = points.withColumn("_part", lower)
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_part").orderBy(column, tie)
    out = dealt.join(sizes, [group, "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)
    return out.drop("_part", "_before")


def zone_bands(points: DataFrame, most: int) -> DataFrame:
    """Points with the ``band`` of their zone: bands along x of at most ``most`` points; zones under 3 points are left out."""
    n = points.groupBy("zone").agg(F.count(F.lit(1)).alias("_n"))
    bands = F.ceil(F.col("_n") / most)
    cut = ranked(points.select("zone", "fid", "x", "y"), "zone", "x", "fid").join(n, "zone").where("_n >= 3")
    return cut.select("zone", F.floor(F.col("_rank") * bands / F.col("_n")).alias("band"), "fid", "x", "y")


def in_sequence(routes: DataFrame) -> DataFrame:
    """Bands one after the other: ``zone, seq, fid, x, y``; a band starts after the sizes of those before it, so nothing is sorted."""
    sizes = routes.groupBy("zone", "band").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("zone").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row for each band
    sizes = sizes.select("zone", "band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return routes.join(sizes, ["zone", "band"]).select("zone", (F.col("_before") + F.col("seq")).alias("seq"), "fid", "x", "y")


def stitched(routes: DataFrame, height: float) -> DataFrame:
    """Routes of zones (``zone, seq, fid, x, y``; seq 0, 1, ... in each) as one: ``seq, zone, fid, x, y``.

    Zones follow each other in a serpentine: by rows of ``height`` along y, to
    the right in the first row, back in the next (ties by zone). Each route
    goes forward or backward, so that the links between zones are shortest
    together (ties: forward). Only ends, size and middle of a zone are
    gathered, a row for each zone; a point's place follows from its zone's by
    arithmetic. Null zones are left out.
    """
    at = lambda f: f(F.struct("x", "y"), "seq")
    ends = routes.where(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), ((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"), at(F.min_by).alias("a"), at(F.max_by).alias("b")
    )
    row = F.floor((F.col("my") - F.min("my").over(Window.partitionBy())) / height)
    ends = ends.select("zone", "n", "a", "b", "mx", row.alias("row"))
    order = Window.orderBy("row", F.when(F.col("row") % 2 == 0, F.col("mx")).otherwise(-F.col("mx")), "zone")  # a row for each zone
    ends = ends.withColumns({"place": F.row_number().over(order), "first": F.sum("n").over(order) - F.col("n")})
    kind = routes.schema["zone"].dataType.simpleString()

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        spots = pdf[["ax", "ay", "bx", "by"]].to_numpy()
        ways = [(s[:2], s[2:]) for s in spots], [(s[2:], s[:2]) for s in spots]  # forward, backward: where it begins and ends
        cost, came = [0.0, 0.0], []
        for k in range(1, len(spots)):
            link = [[cost[p] + float(np.hypot(*(ways[p][k - 1][1] - ways[q][k][0]))) for p in (0, 1)] for q in (0, 1)]
            came.append([int(x[1] < x[0]) for x in link])
            cost = [min(x) for x in link]
        back = [int(cost[1] < cost[0])]
        for step in reversed(came):
            back.append(step[back[-1]])
        return pd.DataFrame({"zone": pdf["zone"], "backward": [bool(x) for x in reversed(back)]})

    flat = ends.select("zone", "place", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.lit(0).alias("g"))
    ways = flat.groupBy("g").applyInPandas(lambda pdf: turn(pdf), f"zone {kind}, backward boolean")  # a row for each zone
    placed = routes.join(ends.select("zone", "n", "first").join(ways, "zone"), "zone")
    seq = F.col("first") + F.when(F.col("backward"), F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq"))
    return placed.select(seq.alias("seq"), "zone", "fid", "x", "y")


def route_line(route: DataFrame) -> DataFrame:
    """``n_points, length`` of one route whose ``seq`` counts up by one: each point meets the next in an equi-join, nothing is sorted."""
    after = route.select((F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    step = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    return route.select("seq", "x", "y").join(after, "seq", "left").agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("length"))


def by_places(points: np.ndarray, route: Callable[[np.ndarray], list[int]]) -> list[int]:
    """A route of points from one of their places: copies at one place follow each other in their given order, at no length.

    The work follows the places, so points that lie on each other cost nothing.
    """
    _, first, place = np.unique(points, axis=0, return_index=True, return_inverse=True)
    if len(first) == len(points):
        return route(points)
    seen = np.argsort(first)  # places in the order in which the points name them
    number = np.argsort(seen)[place.ravel()]
    ends = np.cumsum(np.bincount(number))
    copies = np.split(np.argsort(number, kind="stable"), ends[:-1])
    return [int(i) for k in route(points[first[seen]]) for i in copies[k]]


def zone_routes(points: DataFrame, most: int = 5000, near: int | None = None) -> DataFrame:
    """A short open route through the points of each zone: ``zone, seq, fid, x, y``; zones under 3 points have none.

    Zones are independent groups; one with more than ``most`` points is cut
    into bands along x first, so that no group grows with the input. Points at
    one place are one stop.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "fid"]).reset_index(drop=True)
        at = pdf[["x", "y"]].to_numpy()
        route = by_places(at, lambda spots: two_opt(spots, nearest_order(spots), near))
        return pdf.loc[route, ["zone", "band", "fid", "x", "y"]].assign(seq=range(len(route)))

    return in_sequence(zone_bands(points, most).groupBy("zone", "band").applyInPandas(order, "zone int, band long, fid long, x double, y double, seq long"))


def crossed(mothers: np.ndarray, fathers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Order crossover of many pairs of routes at once.

    A child keeps its mother's stops at places lo to hi; its other stops come,
    going round from place hi, in the order in which the father visits them
    going round from there.
    """
    n, at = mothers.shape[1], np.arange(mothers.shape[1])
    lo, hi = lo[:, None], hi[:, None]
    kept = (at >= lo) & (at < hi)
    has = np.zeros_like(kept)
    np.put_along_axis(has, mothers, kept, axis=1)
    visit = np.argsort(fathers, axis=1)  # by stop: its place in the father's route
    stops = np.argsort((visit - hi) % n + n * has, axis=1)  # those that the child lacks come first
    places = np.argsort((at - hi) % n + n * kept, axis=1)  # open places come first
    child = mothers.copy()
    row, k = np.nonzero(at < n - (hi - lo))
    child[row, places[row, k]] = stops[row, k]
    return child


def turned(routes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Routes with their stops at places lo to hi in reverse."""
    at = np.arange(routes.shape[1])
    return np.take_along_axis(routes, np.where((at >= lo[:, None]) & (at < hi[:, None]), lo[:, None] + hi[:, None] - 1 - at, at), axis=1)


def evolved(points: np.ndarray, rng: np.random.Generator, size: int, rounds: int, patience: int, mutation: float, elite: int = 3, seeds: int = 10) -> tuple[np.ndarray, float]:
    """The best open path of one population of ``size`` routes and its length.

    Some routes start from nearest neighbours, others at random. In each round
    the ``elite`` best, improved by 2-opt, stay; all others are children of the
    best of five drawn routes each, some of them with a stretch turned round.
    Ends after ``rounds``, or ``patience`` of them in a row without a gain.
    """
    n = len(points)
    cost = lambda routes: np.hypot(*np.moveaxis(np.diff(points[routes], axis=1), 2, 0)).sum(axis=1)
    span = lambda k: np.sort(rng.integers(0, n + 1, (2, k)), axis=0)
    grown = [nearest_order(points, int(s)) for s in rng.permutation(n)[: min(seeds, size)]]
    routes = np.array([*grown, *(rng.permutation(n) for _ in range(size - len(grown)))])
    length = cost(routes)
    history = [float(length.min())]
    while len(history) <= rounds and not (patience and len(history) > patience and history[-1 - patience] - history[-1] <= 1e-6):
        leaders = routes[np.argpartition(length, min(elite, size - 1))[:elite]]
        leaders = np.array([two_opt(points, r, 15) for r in leaders])
        k = size - len(leaders)
        drawn = rng.integers(0, size, (2, k, 5))
        parents = routes[np.take_along_axis(drawn, length[drawn].argmin(axis=2)[:, :, None], axis=2)[:, :, 0]]
        children = crossed(*parents, *span(k))
        some = rng.random(k) < mutation
        children[some] = turned(children[some], *span(int(some.sum())))
        routes = np.concatenate([leaders, children])
        length = cost(routes)
        history.append(min(history[-1], float(length.min())))
    return routes[length.argmin()], float(length.min())


def genetic_routes(points: DataFrame, islands: int = 4, size: int = 60, rounds: int = 150, patience: int = 10, mutation: float = 0.015, most: int = 500, seed: int = 42) -> DataFrame:
    """Routes like ``zone_routes``, each the best of independent populations that Spark runs side by side."""
    cut = zone_bands(points, most)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "fid"], ignore_index=True)
        first = pdf.iloc[0]
        rng = np.random.default_rng([seed, int(first.zone) % 2**32, int(first.band), int(first.island)])
        at = pdf[["x", "y"]].to_numpy()
        route = by_places(at, lambda spots: evolved(spots, rng, size, rounds, patience, mutation)[0].tolist())
        length = float(np.hypot(*np.diff(at[route], axis=0).T).sum())
        stops = [{"seq": i, "fid": f, "x": x, "y": y} for i, (f, x, y) in enumerate(pdf.loc[route, ["fid", "x", "y"]].itertuples(index=False))]
        return pd.DataFrame({"zone": [first.zone], "band": [first.band], "island": [first.island], "length": [length], "stops": [stops]})

    tried = cut.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("zone", "band", "island")
    found = tried.applyInPandas(search, "zone int, band long, island int, length double, stops array<struct<seq: long, fid: long, x: double, y: double>>")
    best = found.groupBy("zone", "band").agg(F.min_by("stops", F.struct("length", "island")).alias("stops"))
    return in_sequence(best.select("zone", "band", F.inline("stops")))


def route_length(route: DataFrame) -> DataFrame:
    """``zone, n_points, length`` of ordered points (ties by ``fid``); each meets the next one in an equi-join on its rank."""
    placed = ranked(route.select("zone", "seq", "fid", "x", "y"), "zone", "seq", "fid")
    after = placed.select("zone", (F.col("_rank") - 1).alias("_rank"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    step = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    met = placed.join(after, ["zone", "_rank"], "left")
    return met.groupBy("zone").agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("length"))
