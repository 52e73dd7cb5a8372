"""One-to-one matching of detections and truths, and the scores that rest on it."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from agrispark.operators.chunks import in_chunks
from agrispark.operators.spatial import box_pairs, iou, overlap_graph


class Assignment:
    """The assignment of greatest total gain over lists of pairs, grown row by row.

    Pairs that are not listed gain nothing. A row that is added takes the
    shortest augmenting path by reduced costs; it ends at a free column, or at
    a row that goes without one. So after each addition the assignment is the
    best of the rows so far, and memory is that of the pairs.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, gain: np.ndarray, least: float = 0.0) -> None:
        order = np.argsort(row, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row))]).tolist()
        self.row, self.col, self.gain, self.place = row[order].tolist(), col[order].tolist(), gain[order].tolist(), order
        self.u, self.v = [0.0] * (len(self.ends) - 1), [0.0] * (int(col.max(initial=-1)) + 1)
        self.of_row: dict[int, int] = {}
        self.of_col: dict[int, int] = {}
        self.least, self.hits = least, 0

    def add(self, start: int) -> None:
        row_of, col_of, gain, u, v = self.row, self.col, self.gain, self.u, self.v
        mine = range(self.ends[start], self.ends[start + 1])
        u[start] = min(0.0, min((-gain[k] - v[col_of[k]] for k in mine), default=0.0))
        far: dict[int, float] = {}
        via: dict[int, int] = {}
        rows, done, heap = {start: 0.0}, {}, []
        last, without = start, (-u[start], start)
        while True:
            base = rows[last]
            for k in range(self.ends[last], self.ends[last + 1]):
                c = col_of[k]
                through = base - gain[k] - u[last] - v[c]
                if c not in done and through < far.get(c, math.inf):
                    far[c], via[c] = through, k
                    heapq.heappush(heap, (through, c))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or without[0] <= heap[0][0]:
                length, at = without[0], -1
                break
            length, at = heapq.heappop(heap)
            if at not in self.of_col:
                break
            done[at] = length
            last = row_of[self.of_col[at]]
            rows[last] = length
            without = min(without, (length - u[last], last))
        for r, d in rows.items():
            u[r] += length - d
        for c, d in done.items():
            v[c] -= length - d
        if at < 0:
            freed = self.of_row.pop(without[1], None)
            if freed is None:
                return
            self.hits -= gain[freed] >= self.least
            at = col_of[freed]
        while True:
            k = via[at]
            before = self.of_row.get(row_of[k])
            self.of_row[row_of[k]] = self.of_col[at] = k
            self.hits += (gain[k] >= self.least) - (before is not None and gain[before] >= self.least)
            if before is None:
                return
            at = col_of[before]

    def pairs(self) -> np.ndarray:
        """Places of the assigned pairs among those given."""
        return self.place[list(self.of_row.values())] if self.of_row else np.zeros(0, np.int64)


def _pairs(pred: DataFrame, gt: DataFrame, size: float, on: Sequence[str]) -> DataFrame:
    keys = [F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]
    pairs = box_pairs(pred, gt, size, on=[*on, "class_id"])
    return pairs.select(*keys, "minx", "miny", "pred_id", "conf", F.col("b_gt_id").alias("gt_id"), iou().alias("iou")).where("iou > 0")


def _by_groups(pred: DataFrame, gt: DataFrame, size: float, on: Sequence[str], split: bool, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``call`` on overlapping pairs of one class, in groups that can be assigned by themselves: images, or components of the overlap graph.

    Many whole groups come at once: pairs of different groups share no end, so each path that an assignment takes stays in its own group.
    """
    pairs, keys = _pairs(pred, gt, size, on), [f"_on{i}" for i in range(len(on))]
    if on and not split:
        return in_chunks(pairs, keys, call, schema, ["pred_id", "gt_id"])
    # ids may repeat in another image; two nodes of one hash only put two components into one group
    node = lambda side, c: F.xxhash64(*keys, F.lit(side), F.col(c))
    named = pairs.withColumns({"_u": node(0, "pred_id"), "_v": node(1, "gt_id")})
    comp = overlap_graph(named, "_u", "_v", size, keys)
    inside = named.join(comp, named["_u"] == comp.id).select("component", *keys, "pred_id", "gt_id", "conf", "iou")
    return in_chunks(inside, ["component"], call, schema, [*keys, "pred_id", "gt_id"])


def _coded(pdf: pd.DataFrame, least: float = 0.0) -> tuple[Assignment, np.ndarray]:
    """An empty assignment of the pairs, and each pair's prediction by number."""
    images = [c for c in pdf.columns if c.startswith("_on")]
    row, col = (pdf.groupby([*images, c], sort=False).ngroup().to_numpy() for c in ("pred_id", "gt_id"))
    return Assignment(row, col, pdf["iou"].to_numpy(), least), row


def one_to_one(pred: DataFrame, gt: DataFrame, least: float = 0.5, size: float = 1.0, on: Sequence[str] = (), split: bool = False) -> DataFrame:
    """The assignment of greatest total IoU, pairs of ``least`` and more: ``pred_id, gt_id, iou``, after the columns ``on``.

    on: columns that name the image whose units the boxes are in; boxes of
    different images never meet, and ids may repeat in another one. Pairs of
    different classes or without overlap gain nothing. An image is a group by
    itself; with ``split``, or without images, a component of the overlap graph
    is one. Either keeps only its overlapping pairs, as lists. Null images,
    classes and ids match nothing.
    """
    names = [f"_on{i}" for i in range(len(on))]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        found, row = _coded(pdf)
        for r in range(int(row.max()) + 1):
            found.add(r)
        return pdf.iloc[found.pairs()][[*names, "pred_id", "gt_id", "iou"]]

    kinds = "".join(f"{n} {pred.schema[c].dataType.simpleString()}, " for n, c in zip(names, on, strict=True))
    out = _by_groups(pred, gt, size, on, split, best, f"{kinds}pred_id long, gt_id long, iou double").where(F.col("iou") >= least)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, on, strict=True)), "pred_id", "gt_id", "iou")


def evaluate(pred: DataFrame, gt: DataFrame, images: list[str], confidence: float = 0.3, least: float = 0.5, size: float = 1.0, split: bool = False) -> DataFrame:
    """``tp, fp, fn, mean_conf`` of predictions from ``confidence`` up, matched image by image; those of images without truths are left out.

    images: the columns that name an image in both layers.
    """
    kept = pred.where(F.col("conf") >= confidence).join(gt.select(*images).distinct(), images, "left_semi")
    tp = one_to_one(kept, gt, least, size, images, split).agg(F.count(F.lit(1)).alias("tp"))
    n = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf")).crossJoin(gt.agg(F.count(F.lit(1)).alias("m")))
    return tp.crossJoin(n).select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("m") - F.col("tp")).alias("fn"), "mean_conf")  # one row each


def pr_sweep(pred: DataFrame, gt: DataFrame, lowest: float = 0.001, steps: int = 200, least: float = 0.5, size: float = 1.0, on: Sequence[str] = (), split: bool = False) -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall`` at evenly spaced thresholds from 1 down, with one-to-one matching at each.

    Predictions enter their group's assignment from the most confident down,
    each by one augmenting path, so a whole sweep costs as much as one
    assignment; the counts of each step come from small aggregates.
    """
    levels = np.linspace(1.0, lowest, steps)

    def counts(pdf: pd.DataFrame) -> pd.DataFrame:
        found, row = _coded(pdf, least)
        step = np.full(int(row.max()) + 1, steps)
        np.minimum.at(step, row, np.searchsorted(-levels, -pdf["conf"].to_numpy(), side="left"))
        order = np.argsort(step, kind="stable")
        out, before = [], 0
        for s in np.unique(step[step < steps]):
            for r in order[step[order] == s].tolist():
                found.add(r)
            out.append((int(s), found.hits - before))
            before = found.hits
        return pd.DataFrame(out, columns=["step", "gained"])

    tp = _by_groups(pred, gt, size, on, split, counts, "step int, gained long").groupBy("step").agg(F.sum("gained").alias("gained"))
    spark = pred.sparkSession
    axis = spark.createDataFrame([(i, float(t)) for i, t in enumerate(levels)], "step int, threshold double")
    # the thresholds above a confidence, counted by comparison with the exact ones around the place that even spacing gives
    exact, gap = F.lit(levels.tolist()), (1.0 - lowest) / (steps - 1) if steps > 1 and lowest < 1 else 0.0
    near = F.least(F.greatest(F.floor((1.0 - F.col("conf")) / gap) - 1, F.lit(0)), F.lit(steps)).cast("int") if gap else F.lit(0)
    above = [F.coalesce(F.get(exact, near + i) > F.col("conf"), F.lit(False)).cast("int") for i in range(3 if gap else steps)]
    place = F.when(F.isnan("conf"), 0).otherwise(near + sum(above[1:], above[0]))
    n = pred.where(F.col("conf") >= lowest).select(place.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # as many rows as steps
    run = axis.join(F.broadcast(tp), "step", "left").join(F.broadcast(n), "step", "left").select(
        "threshold", F.coalesce(F.sum("gained").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n")
    )
    all_gt = gt.agg(F.count(F.lit(1)).alias("m"))
    found = run.crossJoin(F.broadcast(all_gt)).select("threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("m") - F.col("tp")).alias("fn"))  # one row
    return found.select("*", (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9)).alias("recall"))


def average_precision(points: DataFrame) -> DataFrame:
    """``ap``: the area under the envelope of precision over recall, by trapezoids; a row for each threshold only."""
    up = Window.orderBy("recall", F.desc("threshold"))
    env = F.max("precision").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    p = points.select("recall", "threshold", env.alias("p"))
    part = (F.col("recall") - F.lag("recall").over(up)) * (F.col("p") + F.lag("p").over(up)) / 2
    return p.select(part.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("ap"))


def promote(pred: DataFrame, gt: DataFrame, confidence: float, least: float = 0.3, size: float = 1.0) -> DataFrame:
    """Truths after confident predictions replaced those they overlap: ``id, origin, minx, miny, maxx, maxy``.

    Predictions are taken by id; a promoted one goes again if a later one overlaps it by more than ``least``.
    """
    taken = pred.where(F.col("conf") >= confidence)
    gone = box_pairs(gt, taken, size).where(iou() > least).select("gt_id").distinct()
    later = box_pairs(taken, taken, size).where("b_pred_id > pred_id").where(iou() > least).select("pred_id").distinct()
    box = ["minx", "miny", "maxx", "maxy"]
    old = gt.join(gone, "gt_id", "left_anti").select(F.col("gt_id").alias("id"), F.lit("truth").alias("origin"), *box)
    return old.unionByName(taken.join(later, "pred_id", "left_anti").select(F.col("pred_id").alias("id"), F.lit("promoted").alias("origin"), *box))
