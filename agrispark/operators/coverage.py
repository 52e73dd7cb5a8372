"""Whether boxes lie within the union of other boxes grown by a distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from agrispark.operators.spatial import BOX, cells


#: Shapes that are looked at together; a box that more of them cross is halved first.
MANY = 32


def covered(box: np.ndarray, grown: np.ndarray, buffer: float, halvings: int = 24) -> bool:
    """Whether ``box`` lies in the union of the boxes ``grown``, each with all within ``buffer`` of it (corners are round).

    Shapes out of reach are left out, and one that holds the whole box settles
    it. A box that many shapes cross is halved along its longer side, so that
    dense places cost little more than others.
    """
    x0, y0, x1, y1 = box
    a, b, c, d = grown.T
    near = np.hypot(np.maximum(np.maximum(a - x1, x0 - c), 0), np.maximum(np.maximum(b - y1, y0 - d), 0)) <= buffer
    grown = grown[near]
    a, b, c, d = grown.T
    if (np.hypot(np.maximum(np.maximum(a - x0, x1 - c), 0), np.maximum(np.maximum(b - y0, y1 - d), 0)) <= buffer).any():
        return True
    if len(grown) < 2:
        return False
    if len(grown) > MANY and halvings:
        axis = int(y1 - y0 > x1 - x0)
        left, right = np.array(box, float), np.array(box, float)
        left[axis + 2] = right[axis] = (box[axis] + box[axis + 2]) / 2
        return covered(left, grown, buffer, halvings - 1) and covered(right, grown, buffer, halvings - 1)
    return _covered_by_lines(box, grown, buffer)


def _covered_by_lines(box: np.ndarray, grown: np.ndarray, buffer: float) -> bool:
    """The same for few shapes.

    The outlines change their order along y only at certain x: at the ends of
    a box, where an arc meets another, or where one meets a level edge. Between
    two of these it is enough to look along one upright line, in its middle:
    the shapes cut it in intervals, which cover it or not.
    """
    x0, y0, x1, y1 = box
    a, b, c, d = grown.T
    centre = np.unique(np.array([(x, y) for x in (a, c) for y in (b, d)]).transpose(0, 2, 1).reshape(-1, 2), axis=0)
    at = [[x0, x1], a - buffer, a, c, c + buffer]
    level = np.unique(np.concatenate([b - buffer, d + buffer, [y0, y1]]))
    off = buffer * buffer - (level[:, None] - centre[:, 1]) ** 2
    half = np.sqrt(np.maximum(off, 0))
    at += [(centre[:, 0] - half)[off >= 0], (centre[:, 0] + half)[off >= 0]]
    i, j = np.triu_indices(len(centre), 1)
    gap = centre[j] - centre[i]
    far = np.hypot(*gap.T)
    meet = (far > 0) & (far <= 2 * buffer)
    gap, far, mid = gap[meet], far[meet], (centre[i] + centre[j])[meet] / 2
    side = np.sqrt(np.maximum(buffer * buffer - far * far / 4, 0)) * gap[:, 1] / np.where(far > 0, far, 1)
    at += [mid[:, 0] - side, mid[:, 0] + side]
    x = np.unique(np.clip(np.concatenate(at), x0, x1))
    x = (x[:-1] + x[1:]) / 2 if len(x) > 1 else x
    out = np.maximum(np.maximum(a - x[:, None], x[:, None] - c), 0)
    lift = np.sqrt(np.maximum(buffer * buffer - out * out, 0))
    low = np.where(out <= buffer, b - lift, np.inf)
    high = np.where(out <= buffer, d + lift, -np.inf)
    order = np.argsort(low, axis=1)
    low, high = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
    reach = np.maximum.accumulate(np.concatenate([np.full((len(x), 1), y0), high], axis=1), axis=1)
    slack = 1e-12 * max(1.0, float(np.abs(box).max()))
    open_ = (low > reach[:, :-1] + slack) & (reach[:, :-1] < y1 - slack)
    touched = ((low <= y0 + slack) & (high >= y0 - slack)).any(axis=1)
    return bool((touched & ~open_.any(axis=1) & (reach[:, -1] >= y1 - slack)).all())


def within_union(a: DataFrame, b: DataFrame, buffer: float, key: str, size: float = 1.0) -> DataFrame:
    """``key, inside``: 1 if all of a box of ``a`` is within ``buffer`` of the boxes of ``b`` together, else 0.

    A box is cut at the grid's cells and is inside if each piece is, so that a
    wide one is many small groups; a piece meets the truths that reach its
    cell. Pieces within reach of one truth are settled by an expression, the
    others by ``covered``. A point is a box without extent. Rows of one key
    are one box of several parts; rows with a null bound aren't inside.
    """
    ends = {"minx": "_cx", "miny": "_cy", "maxx": "_cx", "maxy": "_cy"}
    cut = a.select(key, *BOX).withColumn("_cx", F.explode(cells("minx", "maxx", size))).withColumn("_cy", F.explode(cells("miny", "maxy", size)))
    clip = {c: (F.greatest if c.startswith("min") else F.least)(F.col(c), (F.col(at) + (0 if c.startswith("min") else 1)) * size) for c, at in ends.items()}
    pieces = cut.withColumns(clip)
    truths = b.select(*(F.col(c).alias(f"b_{c}") for c in BOX)).withColumn("_cx", F.explode(cells("b_minx", "b_maxx", size, buffer))).withColumn("_cy", F.explode(cells("b_miny", "b_maxy", size, buffer)))

    def gap(x: Column, y: Column) -> Column:
        dx = F.greatest(F.col("b_minx") - x, x - F.col("b_maxx"), F.lit(0.0))
        dy = F.greatest(F.col("b_miny") - y, y - F.col("b_maxy"), F.lit(0.0))
        return dx * dx + dy * dy

    far = F.greatest(*(gap(F.col(x), F.col(y)) for x in ("minx", "maxx") for y in ("miny", "maxy")))
    nearest = gap(F.greatest("minx", F.least("maxx", "b_minx")), F.greatest("miny", F.least("maxy", "b_miny")))
    met = pieces.join(truths, ["_cx", "_cy"]).withColumn("_one", far <= buffer * buffer).where(nearest <= buffer * buffer)
    spot = [key, "_cx", "_cy", *BOX]
    near = met.groupBy(*spot).agg(F.max("_one").alias("one"), F.collect_set(F.struct(*(f"b_{c}" for c in BOX))).alias("near"))
    alone = near.where("one").select(key, "_cx", "_cy", *BOX)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = np.column_stack([batch.column(c).to_numpy() for c in BOX])
            lists = batch.column("near")
            flat = np.column_stack([f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()])
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
            ok = [covered(box, flat[s:e], buffer) for box, s, e in zip(boxes, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in spot], names=spot).filter(pa.array(ok, pa.bool_()))

    rest = near.where("not one and size(near) > 1")
    kinds = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in spot)
    whole = alone.unionByName(rest.select(*spot, "near").mapInArrow(settle, kinds))
    inside = whole.groupBy(key).agg(F.count(F.lit(1)).alias("_got"))
    wanted = pieces.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    both = wanted.join(inside, key, "left").select(key, (F.col("_got") == F.col("_all")).alias("_in"))
    return a.select(key).distinct().join(both, key, "left").select(key, F.coalesce(F.col("_in").cast("int"), F.lit(0)).alias("inside"))
