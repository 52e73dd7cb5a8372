"""Outlines of segments, and boxes of four corners from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from agrispark.operators.chunks import starts, whole_groups
from agrispark.operators.polygons import hull, rectangle

#: Shapes whose corners a task keeps, so that segments of one shape are traced once.
KEPT = 1 << 14

#: The eight neighbours of a pixel, clockwise from the left (y down).
AROUND = np.array([(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)])


def outline(pixels: np.ndarray) -> np.ndarray:
    """The outer boundary of an 8-connected set of pixels (rows of x, y), clockwise from its topmost leftmost one.

    The boundary is walked with the outside to the left, until the first step
    would be taken again; pixels inside a straight stretch are left out.
    """
    lo = pixels.min(0)
    mask = np.zeros(pixels.max(0) - lo + 3, bool)
    mask[tuple((pixels - lo + 1).T)] = True
    top = pixels[np.lexsort((pixels[:, 0], pixels[:, 1]))[0]] - lo + 1
    here, look, path, first = (int(top[0]), int(top[1])), 0, [], None
    while True:
        for turn in range(8):
            way = (look + turn) % 8
            there = (here[0] + int(AROUND[way][0]), here[1] + int(AROUND[way][1]))
            if mask[there]:
                break
        else:
            return pixels[:1].copy()
        if (here, way) == first:
            break
        first = first or (here, way)
        path.append((here, way))
        here, look = there, (way + 5) % 8  # just after the direction it came from
    kept = [p for (p, way), (_, before) in zip(path, [path[-1], *path[:-1]], strict=True) if way != before]
    return np.array(kept) + lo - 1


def perimeter(ring: np.ndarray) -> float:
    return float(np.hypot(*(ring - np.roll(ring, -1, axis=0)).T).sum())


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring with fewer corners, none of those left out further than ``tolerance`` from the side that replaces it.

    Two far corners split the ring; each half is split at the corner furthest
    from its chord while that is too far. Corners that lie within 0.7 of the
    tolerance of the line between their neighbours go last.
    """
    n, start, far = len(ring), 0, 0
    if n < 3:
        return ring
    for _ in range(3):
        start, far = far, int(np.hypot(*(ring - ring[far]).T).argmax())
    if np.hypot(*(ring[far] - ring[start])) <= tolerance:
        return ring[[start]]
    stop = far if far > start else far + n
    keep, todo = {start % n, far % n}, [(start, stop), (stop, start + n)]
    while todo:
        a, b = todo.pop()
        inner = np.arange(a + 1, b) % n
        if not len(inner):
            continue
        p, (dx, dy) = ring[a % n], ring[b % n] - ring[a % n]
        off = np.abs((ring[inner] - p) @ np.array([-dy, dx])) / np.hypot(dx, dy)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(int(inner[k]))
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    corners = [ring[i % n] for i in range(start, start + n) if i % n in keep]
    at = 0
    while at < len(corners) and len(corners) > 2:
        before, here, after = corners[at - 1], corners[at], corners[(at + 1) % len(corners)]
        dx, dy = after - before
        cross = abs((here[0] - before[0]) * dy - (here[1] - before[1]) * dx)
        onward = (here - before) @ (after - here) >= 0
        if onward and dx and dy and cross * cross <= 0.5 * tolerance * tolerance * (dx * dx + dy * dy):
            corners.pop(at)
        else:
            at += 1
    return np.array(corners)


def in_order(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left (y down): the upper two by y, then x, are the top."""
    by = corners[np.lexsort((corners[:, 0], corners[:, 1]))]
    top, bottom = by[:2], by[2:]
    return np.vstack([top[np.argsort(top[:, 0], kind="stable")], bottom[np.argsort(-bottom[:, 0], kind="stable")]])


def four_corners(pixels: np.ndarray, method: str, share: float = 0.02) -> np.ndarray:
    """Four whole-number corners of a segment: its smallest rectangle, or its hull or outline simplified.

    The tolerance is a share of the perimeter. Where that leaves another number
    of corners than four, the smallest rectangle stands in. Fractions are cut.
    """
    return ring_corners(outline(pixels), method, share)


def ring_corners(ring: np.ndarray, method: str, share: float = 0.02) -> np.ndarray:
    """``four_corners`` of a segment whose outline is known."""
    if method != "rectangle":
        shape = hull(ring) if method == "hull" else ring
        few = simplified(shape, share * perimeter(shape))
        if len(few) == 4:
            return in_order(few)
    return in_order(np.trunc(rectangle(hull(ring)) + 1e-9).astype(int))


def segment_quads(pixels: DataFrame, method: str = "contour", size: int = 20, key: str = "seg_id") -> DataFrame:
    """``key, x1, y1 .. x4, y4`` of each segment, in 0..1 of its tile, from its pixels (``key, x, y``).

    method: rectangle, hull or contour. A segment is inside one tile, so its
    pixels are a group of bounded size. Corners are pixel centres in the tile,
    divided by its size and clamped. Null keys and places are left out.
    """
    return quads_by_method(pixels, [method], size, key).drop("method")


def quads_by_method(pixels: DataFrame, methods: Sequence[str], size: int = 20, key: str = "seg_id") -> DataFrame:
    """``method`` and ``segment_quads``' columns by each of the methods, from one outline a segment.

    Segments come to Python many at once; those with the same pixels in their tiles have the same corners.
    """
    if unknown := set(methods) - {"rectangle", "hull", "contour"}:
        raise ValueError(f"unknown method: {', '.join(sorted(unknown))}")
    kind = pixels.schema[key].dataType.simpleString()
    names = [f"{c}{i}" for i in range(1, 5) for c in "xy"]

    def corners(places: np.ndarray) -> np.ndarray:
        ring = outline(np.stack([places % size, places // size], axis=1))
        return np.array([np.clip(ring_corners(ring, m) / size, 0.0, 1.0).ravel() for m in methods])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, np.ndarray] = {}
        for chunk in whole_groups(batches, [key]):
            first, places, quads = starts(chunk[key].to_numpy()), chunk["place"].to_numpy(), []
            for own in np.split(places, first[1:]):
                own = own[np.append(True, own[1:] != own[:-1])]
                shape = own.tobytes()
                if shape not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[shape] = corners(own)
                quads.append(known[shape])
            out = pd.DataFrame(np.concatenate(quads), columns=names)
            out.insert(0, key, np.repeat(chunk[key].to_numpy()[first], len(methods)))
            out.insert(0, "method", np.tile(methods, len(first)))
            yield out

    inside = pixels.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    place = (F.col("y") % size).cast("int") * size + (F.col("x") % size).cast("int")
    inside = inside.select(key, place.alias("place")).repartition(key).sortWithinPartitions(key, "place")
    return inside.mapInPandas(trace, f"method string, {key} {kind}, " + ", ".join(f"{n} double" for n in names))
