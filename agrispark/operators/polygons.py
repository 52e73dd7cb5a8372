"""Convex polygons: exact overlap as column expressions, and smallest rectangles of point groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from agrispark.operators.chunks import in_chunks, starts
from agrispark.operators.spatial import box_pairs, overlap_graph, overlap_ratio


def signed_area(ring: Column) -> Column:
    """Shoelace area of an array of ``x, y``, positive if counter-clockwise; 0 under three corners."""
    n = F.size(ring)
    parts = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.when(n >= 3, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(F.lit(0.0))


def ccw(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clipped(subject: Column, clip: Column) -> Column:
    """The common part of two convex counter-clockwise rings, cut edge by edge of ``clip``."""
    edges = F.transform(clip, lambda p, i: F.struct(p.alias("a"), F.get(clip, (i + 1) % F.size(clip)).alias("b")))

    def cut(ring: Column, e: Column) -> Column:
        def side(p: Column) -> Column:
            return (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])

        def step(here: Column, there: Column) -> Column:
            p, sp, q, sq = here["p"], here["s"], there["p"], there["s"]
            share = sp / F.when(sp != sq, sp - sq)
            met = F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))
            return F.when((sp >= 0) & (sq >= 0), F.array(q)).when(sp >= 0, F.array(met)).when(sq >= 0, F.array(met, q)).otherwise(F.slice(F.array(q), 1, 0))

        sided = F.transform(ring, lambda p: F.struct(p.alias("p"), side(p).alias("s")))
        return let(sided, lambda r: F.flatten(F.transform(r, lambda p, i: step(p, F.get(r, (i + 1) % F.size(r))))))

    return F.aggregate(edges, subject, cut)


def quad_iou(a: Column, b: Column) -> Column:
    """Exact IoU of two convex rings of any orientation; 0 where both are empty."""

    def share(r: Column) -> Column:
        union = r["a"] + r["b"] - r["c"]
        return F.when(union > 0, r["c"] / union).otherwise(F.lit(0.0))

    def areas(r: Column) -> Column:
        return F.struct(signed_area(r["a"]).alias("a"), signed_area(r["b"]).alias("b"), let(clipped(r["a"], r["b"]), signed_area).alias("c"))

    return let(let(F.struct(ccw(a).alias("a"), ccw(b).alias("b")), areas), share)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost point."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for part in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in part:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle around a hull, one side along an edge: top left, top right, bottom right, bottom left (y down)."""
    edges = np.diff(np.vstack([points, points[:1]]), axis=0)
    best, found = np.inf, None
    for dx, dy in edges if len(points) > 1 else [(1.0, 0.0)]:
        size = np.hypot(dx, dy)
        if size == 0:
            continue
        turn = np.array([[dx, dy], [-dy, dx]]) / size
        q = points @ turn.T
        lo, hi = q.min(0), q.max(0)
        area = (hi - lo).prod()
        if area < best - 1e-12:
            best, found = area, np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ turn
    if found is None:
        found = np.repeat(points[:1], 4, axis=0)
    top, bottom = np.split(found[np.lexsort((found[:, 0], found[:, 1]))], 2)
    return np.vstack([top[np.argsort(top[:, 0])], bottom[np.argsort(-bottom[:, 0])]])


def hulls(group: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``hull``, of many groups (numbers) at once: the group and the corners of each, group by group."""
    order = np.lexsort((points[:, 1], points[:, 0], group))
    group, points = group[order], points[order]
    first = starts(group, points[:, 0], points[:, 1])
    group, points = group[first], points[first]
    ends, (xs, ys) = [*starts(group).tolist(), len(group)], points.T.tolist()
    kept: list[int] = []
    for lo, hi in zip(ends, ends[1:], strict=False):
        if hi - lo < 3:
            kept += range(lo, hi)
            continue
        for part in (range(lo, hi), range(hi - 1, lo - 1, -1)):
            chain: list[int] = []
            for i in part:
                while len(chain) > 1:
                    a, b = chain[-2], chain[-1]
                    if (xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a]) > 0:
                        break
                    chain.pop()
                chain.append(i)
            kept += chain[:-1]
    return group[kept], points[kept]


def rectangles(points: np.ndarray) -> np.ndarray:
    """As ``rectangle``, of many hulls of one number of corners: arrays of groups x corners x 2, and of groups x 4 x 2."""
    n, h, _ = points.shape
    if h == 1:
        return np.repeat(points, 4, axis=1)
    edges = np.roll(points, -1, axis=1) - points
    best, way = np.full(n, np.inf), np.zeros((n, 2))
    for e in range(h):
        size = np.hypot(edges[:, e, 0], edges[:, e, 1])
        c, s = (edges[:, e] / np.where(size > 0, size, 1)[:, None]).T[:, :, None]
        u, v = points[:, :, 0] * c + points[:, :, 1] * s, points[:, :, 1] * c - points[:, :, 0] * s
        area = np.where(size > 0, np.ptp(u, axis=1) * np.ptp(v, axis=1), np.inf)
        better = area < best - 1e-12
        best[better], way[better] = area[better], np.column_stack([c, s])[better]
    c, s = way.T[:, :, None]
    u, v = points[:, :, 0] * c + points[:, :, 1] * s, points[:, :, 1] * c - points[:, :, 0] * s
    u = np.stack([u.min(1), u.max(1), u.max(1), u.min(1)], axis=1)
    v = np.stack([v.min(1), v.min(1), v.max(1), v.max(1)], axis=1)
    out = np.stack([u * c - v * s, u * s + v * c], axis=2)
    sort = lambda r, by: np.take_along_axis(r, np.argsort(by, axis=1, kind="stable")[:, :, None], axis=1)
    out = sort(out, out[:, :, 0])
    out = sort(out, out[:, :, 1])
    return np.concatenate([sort(out[:, :2], out[:, :2, 0]), sort(out[:, 2:], -out[:, 2:, 0])], axis=1)


def smallest_rectangles(points: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """The smallest turned rectangle of each group of ``key, x, y``: ``key, ring`` (four corners).

    Every batch keeps only the hulls of its groups, before the first shuffle
    and again after one by salted key, so that a large group meets in one task
    as a small number of corners. The rest is done for many groups at once.
    Nulls are left out.
    """
    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, x double, y double"
    spots = [f"{c}{i}" for i in range(4) for c in "xy"]

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group, names = pd.factorize(b[key])
            large = np.bincount(group, minlength=len(names))[group] > 8
            who, at = hulls(group[large], b[["x", "y"]].to_numpy()[large])
            yield pd.concat([b[~large], pd.DataFrame({key: names[who], "x": at[:, 0], "y": at[:, 1]})])[[key, "x", "y"]].astype({key: b[key].dtype})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        group, names = pd.factorize(pdf[key])
        who, at = hulls(group, pdf[["x", "y"]].to_numpy(float))
        first = starts(who)
        size, out = np.diff([*first, len(who)]), np.zeros((len(first), 4, 2))
        for h in np.unique(size):
            some = np.flatnonzero(size == h)
            out[some] = rectangles(at[first[some, None] + np.arange(h)])
        return pd.DataFrame({key: names, **dict(zip(spots, out.reshape(-1, 8).T, strict=True))})

    p = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop()
    some = p.mapInPandas(corners, schema).repartition(F.col(key), F.pmod(F.xxhash64("x", "y"), F.lit(parts))).mapInPandas(corners, schema)
    out = in_chunks(some, [key], final, f"{key} {kind}, " + ", ".join(f"{c} double" for c in spots))
    return out.select(key, F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(4))).alias("ring"))


def merge_to_rectangles(boxes: DataFrame, key: str, least: float = 0.1, size: float = 1.0) -> DataFrame:
    """Overlapping boxes of one class as one smallest rectangle: ``group_id, class_id, n, conf, ring``.

    A box that is a group by itself is its own rectangle; only the corners of others are gathered.
    """
    pairs = box_pairs(boxes, boxes, size).where((F.col(key) < F.col(f"b_{key}")) & (F.col("class_id") == F.col("b_class_id"))).where(overlap_ratio() >= least)
    comp = overlap_graph(pairs, key, f"b_{key}", size)
    named = boxes.join(comp, boxes[key] == comp.id, "left").withColumn("group_id", F.coalesce("component", key)).where("group_id is not null")
    bounds = ["minx", "miny", "maxx", "maxy"]
    facts = named.groupBy("group_id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"), *(F.min(c).alias(c) for c in bounds))
    single = (F.col("n") == 1) & (F.col("minx") + F.col("miny") + F.col("maxx") + F.col("maxy")).isNotNull() & (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))
    spot = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    out = ["group_id", "class_id", "n", "conf", "ring"]
    plain = facts.where(single).withColumn("ring", F.array(spot("minx", "miny"), spot("maxx", "miny"), spot("maxx", "maxy"), spot("minx", "maxy"))).select(*out)
    several = facts.where(~F.coalesce(single, F.lit(False))).drop(*bounds)
    corners = [spot(x, y) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    points = named.join(several.select("group_id"), "group_id", "left_semi").select("group_id", F.explode(F.array(*corners)).alias("p")).select("group_id", "p.*")
    return plain.unionByName(several.join(smallest_rectangles(points, "group_id"), "group_id").select(*out))


def merge_union(boxes: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """Boxes that meet, in one group each: bounds, and the attributes of the most confident (ties: least key).

    source: 'merged_union' for groups of several, else 'single'.
    """
    pairs = box_pairs(boxes, boxes, size).where(F.col(key) < F.col(f"b_{key}"))
    comp = overlap_graph(pairs, key, f"b_{key}", size)
    named = boxes.join(comp, boxes[key] == comp.id, "left")
    best = F.max_by(F.struct(key, "class_id", "conf"), F.struct(F.col("conf"), -F.col(key)))
    out = named.groupBy(F.coalesce("component", key).alias("group_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), best.alias("b")
    )
    return out.select("group_id", "n", "minx", "miny", "maxx", "maxy", F.col(f"b.{key}").alias("best_id"), "b.class_id", "b.conf", F.when(F.col("n") > 1, "merged_union").otherwise("single").alias("source"))
