"""Joins of boxes by grid cells, matching, merging, and detection metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from agrispark.operators.chunks import in_chunks, starts
from agrispark.operators.components import connected_components
from agrispark.operators.ranges import running_sums
from agrispark.session import checkpoint as checkpointed

BOX = ["minx", "miny", "maxx", "maxy"]


def cells(low: str, high: str, size: float, grow: float = 0.0) -> Column:
    return F.sequence(F.floor((F.col(low) - grow) / size), F.floor((F.col(high) + grow) / size))


def _in_cells(boxes: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    return boxes.withColumn("_cx", F.explode(cells("minx", "maxx", size, grow))).withColumn("_cy", F.explode(cells("miny", "maxy", size, grow)))


def box_pairs(a: DataFrame, b: DataFrame, size: float = 1.0, grow: float = 0.0, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes that meet (or are within ``grow`` on each axis); b's columns get the prefix ``b_``.

    Both sides go to the grid cells they cover and meet in an equi-join; a
    pair is kept only in the cell of its common corner, so once. on: columns
    that both layers have and a pair shares, such as the image whose label
    units the bounds are in; a null there meets nothing.
    """
    shared = {f"_on{i}": F.col(c) for i, c in enumerate(on)}
    keys = ["_cx", "_cy", *shared]
    left = _in_cells(a, size, grow).withColumns(shared)
    right = _in_cells(b, size).withColumns(shared).select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns))
    both = left.join(right, keys)
    meet = (F.col("minx") - grow <= F.col("b_maxx")) & (F.col("b_minx") <= F.col("maxx") + grow) & (F.col("miny") - grow <= F.col("b_maxy")) & (F.col("b_miny") <= F.col("maxy") + grow)
    corner = (F.floor(F.greatest(F.col("minx") - grow, "b_minx") / size) == F.col("_cx")) & (F.floor(F.greatest(F.col("miny") - grow, "b_miny") / size) == F.col("_cy"))
    return both.where(meet & corner).drop(*keys)


def _area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}maxx") - F.col(f"{prefix}minx")) * (F.col(f"{prefix}maxy") - F.col(f"{prefix}miny"))


def intersection() -> Column:
    w = F.least("maxx", "b_maxx") - F.greatest("minx", "b_minx")
    h = F.least("maxy", "b_maxy") - F.greatest("miny", "b_miny")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou() -> Column:
    """Of the pairs of ``box_pairs``."""
    union = _area() + _area("b_") - intersection()
    return F.when(union > 0, intersection() / union).otherwise(F.lit(0.0))


def overlap_ratio() -> Column:
    """Intersection over the smaller area, 0 where that is 0."""
    small = F.least(_area(), _area("b_"))
    return F.when(small > 0, intersection() / small).otherwise(F.lit(0.0))


def best_match(pred: DataFrame, gt: DataFrame, size: float = 1.0, on: Sequence[str] = ()) -> DataFrame:
    """Each prediction with its truth of highest IoU (ties: least gt_id): ``pred_id, gt_id, iou``, after the columns ``on``; nulls without one.

    on: columns that name the image whose units the boxes are in.
    """
    keys = [*on, "pred_id"]
    pairs = box_pairs(pred, gt, size, on=on).select(*keys, F.col("b_gt_id").alias("gt_id"), iou().alias("iou")).where("iou > 0")
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct("gt_id", "iou"), F.struct("iou", -F.col("gt_id"))).alias("m"))
    return pred.select(*keys).join(best, keys, "left").select(*keys, "m.gt_id", "m.iou")


def confusion(pred: DataFrame, gt: DataFrame, least: float = 0.5, size: float = 1.0, on: Sequence[str] = ()) -> DataFrame:
    """One row ``tp, fp, fn``; several predictions may share a truth. on: as in ``best_match``."""
    hit = best_match(pred, gt, size, on).where(F.col("iou") >= least)
    tp = hit.agg(F.count(F.lit(1)).alias("tp"), F.countDistinct(*on, "gt_id").alias("met"))
    n = pred.agg(F.count(F.lit(1)).alias("n_pred")).crossJoin(gt.agg(F.count(F.lit(1)).alias("n_gt")))
    return tp.crossJoin(n).select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("met")).alias("fn"))  # one row each


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of ``tp, fp, fn``, 0 where undefined, 4 decimals."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))

    def share(a, b):
        return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)

    return counts.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("accuracy"))


def nearest(a: DataFrame, b: DataFrame, most: float, key: str, size: float = 1.0) -> DataFrame:
    """Each box of ``a`` with all nearest boxes of ``b`` within ``most``, ties kept; nulls without one."""
    dx = F.greatest(F.col("b_minx") - F.col("maxx"), F.col("minx") - F.col("b_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("b_miny") - F.col("maxy"), F.col("miny") - F.col("b_maxy"), F.lit(0.0))
    pairs = box_pairs(a, b, size, most).withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= most)
    low = pairs.groupBy(key).agg(F.min("dist").alias("_low"))
    near = pairs.join(low, key).where("dist = _low").select(key, *(c for c in pairs.columns if c.startswith("b_")), "dist")
    return a.join(near, key, "left")


def overlap_graph(pairs: DataFrame, u: Column | str, v: Column | str, size: float = 1.0, on: Sequence[str] = ()) -> DataFrame:
    """``id, component`` of the nodes ``u`` and ``v`` of pairs of boxes; pairs of a square of 16 cells are joined up together first."""
    at = lambda c: F.floor(F.col(c) / (16 * size))
    named = lambda c: F.col(c) if isinstance(c, str) else c
    edges = pairs.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)), at("minx").alias("_bx"), at("miny").alias("_by"), named(u).alias("u"), named(v).alias("v"))
    return connected_components(edges, place=[*(f"_on{i}" for i in range(len(on))), "_bx", "_by"])


def merge_boxes(boxes: DataFrame, key: str, least: float = 0.1, size: float = 1.0, confidence: str | Mapping[str, str] = "max") -> DataFrame:
    """Boxes of each component of the overlap graph as one: bounds, confidence by rule, class of the least key.

    confidence: the rule of ``conf``, or columns with a rule each.
    """
    rules = {"max": F.max, "avg": F.avg, "min": F.min}
    asked = {"conf": confidence} if isinstance(confidence, str) else confidence
    pairs = box_pairs(boxes, boxes, size).where(F.col(key) < F.col(f"b_{key}")).where(overlap_ratio() >= least)
    comp = overlap_graph(pairs, key, f"b_{key}", size)
    return (
        boxes.join(comp, boxes[key] == comp.id, "left")
        .groupBy(F.coalesce("component", key).alias("group_id"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
            *(rules[r]("conf").alias(c) for c, r in asked.items()), F.min_by("class_id", key).alias("class_id"),
        )
    )


def _covered_area(box: np.ndarray, others: np.ndarray) -> float:
    """The area of ``box`` that the union of ``others`` covers."""
    lo, hi = np.maximum(others[:, :2], box[:2]), np.minimum(others[:, 2:], box[2:])
    met = (hi > lo).all(axis=1)
    if met.sum() < 2:
        return float((hi[met] - lo[met]).prod(axis=1).sum())
    lo, hi = lo[met], hi[met]
    x, y = (np.unique(np.concatenate([lo[:, i], hi[:, i]])) for i in (0, 1))
    on = np.zeros((len(x) - 1, len(y) - 1), bool)
    for (ax, ay), (bx, by) in zip(np.column_stack([np.searchsorted(x, lo[:, 0]), np.searchsorted(y, lo[:, 1])]), np.column_stack([np.searchsorted(x, hi[:, 0]), np.searchsorted(y, hi[:, 1])]), strict=True):
        on[ax:bx, ay:by] = True
    return float(np.diff(x) @ on @ np.diff(y))


def grown_groups(boxes: np.ndarray, least: float) -> np.ndarray:
    """For each box (rows of bounds, in order) the first of its group, as groups are grown one after the other.

    A group starts with the first box left and takes, in order, every box left
    within its bounds whose common area with the union so far is at least a
    share of the smaller of the two; bounds are taken anew until none joins.
    """
    n = len(boxes)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    first = np.full(n, -1)
    for i in range(n):
        if first[i] >= 0:
            continue
        first[i], members, size, grew = i, [i], area[i], True
        while grew:
            grew = False
            own = boxes[members]
            lo, hi = own[:, :2].min(axis=0), own[:, 2:].max(axis=0)
            for k in np.flatnonzero((first < 0) & (boxes[:, :2] <= hi).all(axis=1) & (boxes[:, 2:] >= lo).all(axis=1)):
                common = _covered_area(boxes[k], boxes[members])
                if min(size, area[k]) > 0 and common / min(size, area[k]) >= least:
                    first[k], grew = i, True
                    members.append(int(k))
                    size += area[k] - common
    return first


def merge_greedy(boxes: DataFrame, key: str, least: float = 0.1, size: float = 1.0, confidence: str = "max") -> DataFrame:
    """As ``merge_boxes``, with groups grown in the order of the key: a box joins if it overlaps the union of its group so far.

    The order matters: a union grows and a box may overlap it by too small a
    share where it overlaps one member by enough. Boxes that share no area
    never meet, so each component of that graph is replayed by itself, as one
    group of bounds; its size follows the density of boxes in a place. ``least``
    is over 0. Boxes without area stay alone.
    """
    if not 0 < least <= 1:
        raise ValueError("the least share must be over 0 and at most 1")
    rule = {"max": F.max, "avg": F.avg, "min": F.min}[confidence]
    pairs = box_pairs(boxes, boxes, size).where((F.col(key) < F.col(f"b_{key}")) & (intersection() > 0))
    comp = overlap_graph(pairs, key, f"b_{key}", size)
    kind = boxes.schema[key].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, first = pdf[BOX].to_numpy(float), starts(pdf["component"].to_numpy())
        ends = [*first.tolist(), len(pdf)]
        group = np.concatenate([lo + grown_groups(rows[lo:hi], least) for lo, hi in zip(ends, ends[1:], strict=False)])
        return pd.DataFrame({"_id": pdf[key], "group_id": pdf[key].to_numpy()[group]})

    inside = boxes.join(comp, boxes[key] == comp.id).select("component", key, *BOX)
    grown = in_chunks(inside, ["component"], replay, f"_id {kind}, group_id {kind}", order=[key])
    named = boxes.join(grown, boxes[key] == grown["_id"], "left").withColumn("group_id", F.coalesce("group_id", key))
    return named.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        rule("conf").alias("conf"), F.min_by("class_id", key).alias("class_id"),
    )


def roc_points(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """``score, p, n, tp, fp``: rows of each score that are true and not, and the same of accepting everything from it up."""
    by = scored.groupBy(F.col(score).alias("score")).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    return running_sums(by, "score", {"tp": "p", "fp": "n"}, descending=True)


def youden(points: DataFrame) -> DataFrame:
    """The first threshold with the greatest TPR - FPR: ``threshold, j``."""
    total = points.agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    j = F.col("tp") / F.col("_p") - F.col("fp") / F.col("_n")
    return points.crossJoin(F.broadcast(total)).agg(F.max_by("score", F.struct(F.round(j, 9), F.col("score"))).alias("threshold"), F.round(F.max(j), 6).alias("j"))  # one row


def normalised(df: DataFrame, column: str, method: str, out: str) -> DataFrame:
    """Scores to 0..1: minmax, sigmoid (by the sample deviation) or rank (mean of ties)."""
    c = F.col(column)
    if method == "rank":
        by = df.groupBy(column).agg(F.count(F.lit(1)).alias("_ties"))
        by = running_sums(by.where(c.isNotNull()), column, {"_below": "_ties"}, inclusive=False)
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        ranked = by.crossJoin(F.broadcast(total)).select(column, ((F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("_n")).alias(out))  # one row
        return df.join(ranked, column)
    stats = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.stddev_samp(c).alias("_sd"))
    v = (c - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) if method == "minmax" else 1 / (1 + F.exp(-c / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, v).drop("_lo", "_hi", "_sd")  # one row


def fuse(a: Column, b: Column, strategy: str, weight: float = 0.5, fallback: float = 0.0) -> Column:
    """One score of two detectors' (null: 0 and ``fallback``)."""
    y, s = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(fallback))
    return {
        "weighted_sum": lambda: weight * y + (1 - weight) * s,
        "product": lambda: y * s,
        "and_min": lambda: F.least(y, s),
        "or_max": lambda: F.greatest(y, s),
        "harmonic": lambda: F.when(y + s > 0, 2 * y * s / F.when(y + s > 0, y + s)).otherwise(F.lit(0.0)),
        "yolo_only": lambda: y,
        "svm_only": lambda: s,
    }[strategy]()


def within_buffer(a: DataFrame, b: DataFrame, buffer: float, key: str, size: float = 1.0) -> DataFrame:
    """``key, inside``: 1 if all of a box is within ``buffer`` of one box of ``b`` (rounded corners), else 0."""

    def gap(x: str, y: str) -> Column:
        dx = F.greatest(F.col("b_minx") - F.col(x), F.col(x) - F.col("b_maxx"), F.lit(0.0))
        dy = F.greatest(F.col("b_miny") - F.col(y), F.col(y) - F.col("b_maxy"), F.lit(0.0))
        return dx * dx + dy * dy

    far = F.greatest(*(gap(x, y) for x in ("minx", "maxx") for y in ("miny", "maxy")))
    met = box_pairs(a, b, size, buffer).where(far <= buffer * buffer).select(key).distinct().withColumn("_in", F.lit(1))
    return a.select(key).join(met, key, "left").select(key, F.coalesce("_in", F.lit(0)).alias("inside"))


def clip_to_tiles(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each box and square tile that share some area, cut to the tile: bounds, ``tile_row``, ``tile_col``, ``whole``."""
    last = lambda hi, lo: F.greatest(F.ceil(F.col(hi) / size) - 1, F.floor(F.col(lo) / size))
    spread = boxes.drop("tile_row", "tile_col").withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("minx") / size), last("maxx", "minx"))))
    spread = spread.withColumn("tile_row", F.explode(F.sequence(F.floor(F.col("miny") / size), last("maxy", "miny"))))
    cut = {
        "_ax": F.greatest(F.col("minx"), F.col("tile_col") * size), "_ay": F.greatest(F.col("miny"), F.col("tile_row") * size),
        "_bx": F.least(F.col("maxx"), (F.col("tile_col") + 1) * size), "_by": F.least(F.col("maxy"), (F.col("tile_row") + 1) * size),
    }
    whole = (F.col("_ax") == F.col("minx")) & (F.col("_ay") == F.col("miny")) & (F.col("_bx") == F.col("maxx")) & (F.col("_by") == F.col("maxy"))
    out = spread.withColumns(cut).withColumn("whole", whole)
    return out.withColumns({"minx": F.col("_ax"), "miny": F.col("_ay"), "maxx": F.col("_bx"), "maxy": F.col("_by")}).drop(*cut)


def rotate_layer(boxes: DataFrame, degrees: float) -> DataFrame:
    """Boxes turned about the centre of the layer's bounds, as ``ring``; counter-clockwise in map axes."""
    c = boxes.agg(((F.min("minx") + F.max("maxx")) / 2).alias("_cx"), ((F.min("miny") + F.max("maxy")) / 2).alias("_cy"))
    cos, sin = F.cos(F.radians(F.lit(float(degrees)))), F.sin(F.radians(F.lit(float(degrees))))

    def corner(x: str, y: str) -> Column:
        dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
        return F.struct((F.col("_cx") + dx * cos - dy * sin).alias("x"), (F.col("_cy") + dx * sin + dy * cos).alias("y"))

    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"))
    return boxes.crossJoin(F.broadcast(c)).withColumn("ring", ring).drop("_cx", "_cy")  # one row


def fuse_layers(first: DataFrame, second: DataFrame, buffer: float = 2.0, least: float = 0.3, method: str = "minmax", size: float = 1.0) -> DataFrame:
    """Two detectors' boxes as one layer: ``minx, miny, maxx, maxy, conf_first, conf_second, confidence, source``.

    ``second`` (margin) is normalised, kept from ``least`` up, and confirmed by
    the nearest boxes of ``first`` (conf) within ``buffer``: harmonic mean of
    both. All of ``first`` follows; of equal boxes the most confident stays.
    """
    strong = normalised(second, "margin", method, "score").where(F.col("score") >= least)
    near = nearest(strong, first.select("pred_id", *BOX, "conf"), buffer, "svm_id", size).where("dist is not null")
    both = near.select(*BOX, F.col("b_conf").alias("conf_first"), F.col("score").alias("conf_second"), F.round(fuse(F.col("b_conf"), F.col("score"), "harmonic"), 6).alias("confidence"), F.lit("both").alias("source"))
    alone = first.select(*BOX, F.col("conf").alias("conf_first"), F.lit(None).cast("double").alias("conf_second"), F.round("conf", 6).alias("confidence"), F.lit("first").alias("source"))
    row = F.struct("conf_first", "conf_second", "confidence", "source")
    best = both.unionByName(alone).groupBy(*BOX).agg(F.max_by(row, F.struct("confidence", F.when(F.col("source") == "both", 1).otherwise(0), "conf_first", F.coalesce("conf_second", F.lit(-1.0)))).alias("r"))
    return best.select(*BOX, "r.*")


def tagged(scored: DataFrame, threshold: float, score: str = "score", truth: str = "truth") -> DataFrame:
    """With ``result``: TP, FP, FN or TN of accepting scores from ``threshold`` up."""
    on = F.col(score) >= threshold
    real = F.col(truth) == 1
    return scored.withColumn("result", F.when(on & real, "TP").when(on, "FP").when(real, "FN").otherwise("TN"))


def auc(points: DataFrame) -> DataFrame:
    """``auc`` of the points of ``roc_points``, by trapezoids; null without both kinds."""
    area = points.agg(F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select(F.when(F.col("p") * F.col("n") > 0, F.col("a") / (F.col("p") * F.col("n"))).alias("auc"))


def neighbour_graph(points: DataFrame, key: str, k: int, size: float, many: int = 20_000) -> DataFrame:
    """Each point's k nearest others (ties by key): ``key, other, dist, rank``.

    Points look into the grid cells around them. A point is settled if its
    k-th neighbour is no further than the ring just searched; the rest look
    twice as far, so only sparse places pay for wide rings. The last ring is
    wider than all points together, so every point is settled. Points are dealt
    into tasks of about ``many``, so a task's candidates don't grow with them.
    """
    base = points.select(key, "x", "y").where("x is not null and y is not null")
    n, wide = base.agg(F.count(F.lit(1)), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    open_, out, rings, left_over = base, None, 1, n
    usual = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        cell = size * rings
        tasks = max(usual, -(-left_over // many))
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: B023, E731
        right = base.select(F.col(key).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), at("x").alias("_cx"), at("y").alias("_cy"))
        around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))  # noqa: B023, E731
        left = open_.withColumn("_cx", around("x")).withColumn("_cy", around("y"))
        d2 = F.pow(F.col("ox") - F.col("x"), 2) + F.pow(F.col("oy") - F.col("y"), 2)
        both = left.repartition(tasks, "_cx", "_cy").join(right.repartition(max(usual, -(-n // many)), "_cx", "_cy"), ["_cx", "_cy"]) if tasks > usual else left.join(right, ["_cx", "_cy"])
        near = both.where(F.col("other") != F.col(key)).select(key, "other", d2.alias("_d")).repartition(tasks, key)
        w = Window.partitionBy(key).orderBy("_d", "other")
        ranked = checkpointed(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        done = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_far")).where((F.col("_n") >= min(k, n - 1)) & ((F.col("_far") < cell * cell) | F.lit(cell > (wide or 0))))
        settled = ranked.join(done.select(key), key, "left_semi").select(key, "other", F.sqrt("_d").alias("dist"), "rank")
        out = settled if out is None else out.unionByName(settled)
        open_ = checkpointed(open_.join(done.select(key), key, "left_anti"))
        left_over = open_.count()
        if n < 2 or not left_over:
            return out
        rings *= 2
