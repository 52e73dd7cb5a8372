"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from agrispark.session import checkpoint

#: Edges that a task holds at once while it joins them up locally.
CHUNK = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbered nodes the least one reachable: roots hook onto lesser ones, then all point to their root."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        hooked = root.copy()
        np.minimum.at(hooked, a, low)
        np.minimum.at(hooked, b, low)
        while (further := hooked[hooked]).tobytes() != hooked.tobytes():
            hooked = further
        if (hooked == root).all():
            return root
        root = hooked


def _joined_up(edges: DataFrame, place: Sequence[str], closed: bool) -> DataFrame:
    """Edges ``u, v`` (and ``place``) as stars of the parts that those of one place make, one shuffle."""
    kind, name = to_arrow_type(edges.schema["u"].dataType), edges.schema["u"].dataType.simpleString()

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = np.concatenate([np.concatenate([x[i] for x in held]) for i in (0, 1)])
        nodes, at = np.unique(ends, return_inverse=True)
        root = least_reachable(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf], kind), pa.array(nodes[root[leaf]], kind)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            u, v, where = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if size > CHUNK:  # a closed place is cut nowhere
                first = np.flatnonzero(where != last) if closed else np.array([0])
                cut = int(first[0]) if len(first) else len(u)
                held.append((u[:cut], v[:cut]))
                if not len(first):
                    continue
                yield stars(held)
                held, size, u, v = [], 0, u[cut:], v[cut:]
            if len(u):
                held.append((u, v))
                size, last = size + len(u), where[-1]
        if size:
            yield stars(held)

    dealt = edges.select("u", "v", F.xxhash64(*place).alias("w")).repartition("w").sortWithinPartitions("w")
    return dealt.mapInArrow(run, f"u {name}, v {name}")


def closed_components(edges: DataFrame, place: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """As ``connected_components``, of edges none of which leaves its place (``place``: columns), such as a tile.

    One shuffle, by place; a task holds the edges of one place (or of several
    that together are few), so a place must be of bounded size. Ids are numbers or strings.
    """
    e = edges.select(*place, F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    star = _joined_up(e, place, closed=True)
    both = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component"))))
    return star.select(both.alias("p")).select("p.*").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007))).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", place: Sequence[str] = ()) -> DataFrame:
    """One row ``(id, component)`` for every node of an edge; component: the smallest id reachable.

    Alternates large-star and small-star steps, which halve the depth of each
    tree; every round is a few equi-joins and aggregates with a map-side
    combine, and is cut with a reliable checkpoint. Nulls and self-loops are
    ignored; repeated edges count once. An empty table gives no rows.

    place: columns that say roughly where an edge is (ids are numbers or strings then).
    Edges of one place are first joined up in a task, in chunks of bounded
    size, so that rounds are needed only for what reaches over several places.
    Building the query runs the rounds.
    """
    e = edges.select(*place, F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = _joined_up(e, place, closed=False) if place else e
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, _fingerprint(e)
    while now[0] and now != before:  # each round halves the depth of what isn't a star yet
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e = checkpoint(small)
        before, now = now, _fingerprint(e)
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(
        e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    )
