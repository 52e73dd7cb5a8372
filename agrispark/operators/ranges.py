"""Running sums over an ordered column in parts of its range, so that no task sorts all of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def running_sums(df: DataFrame, column: str, sums: dict[str, str], parts: int = 64, descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``df`` and, for each new name in ``sums``, the running sum of its column in the order of ``column``.

    Values are distinct in ``column`` (or ties come in any order). Approximate
    quantiles cut its range into ``parts``; each part is summed by itself and
    starts from the total of those before it, of which there is one row a part.
    """
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.5 / parts)))
    lower = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)
    dealt = df.withColumn("_part", -lower if descending else lower)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    order = F.desc(column) if descending else F.asc(column)
    upto = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = dealt.join(F.broadcast(totals), "_part")  # one row for each part
    return out.select(*df.columns, *((F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(n) for n, c in sums.items()))


def exact_percentiles(df: DataFrame, column: str, shares: list[float], bins: int = 2048, few: int = 10_000) -> list[float | None]:
    """Exact percentiles (between two values in proportion) of a column, None where it has no value; nulls and NaN are left out.

    The range is cut into bins and only counts and ends of the bins come back;
    then only the bins that hold a wanted rank are cut again, until they hold
    one value or ``few`` rows together, whose values are counted. So neither a
    task nor the driver holds more than ``bins`` rows for each wanted rank,
    whatever the number of distinct values; each pass is an aggregate with a
    map-side combine.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None for _ in shares]
    at = [(n - 1) * s for s in shares]
    wanted = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found: dict[int, float] = {}
    open_ = [(low, high, 0, n, wanted)]  # least and greatest value, ranks before, rows, ranks wanted
    edge = 8e307  # so that a width is finite

    def narrowed(parts, rows):
        """The stretches of each part that hold a wanted rank, from counts in order."""
        out = []
        for i, (_, _, before, _, ranks) in enumerate(parts):
            upto = before
            for r in (r for r in rows if r["part"] == i):
                mine = [k for k in ranks if upto <= k < upto + r["n"]]
                if mine:
                    out.append((r["low"], r["high"], upto, r["n"], mine))
                upto += r["n"]
        return out

    while True:
        for low, high, _, _, ranks in open_:
            if low == high:
                found |= dict.fromkeys(ranks, low)
        open_ = [p for p in open_ if p[0] != p[1]]
        if not open_:
            break
        part = F.lit(None).cast("int")
        place = F.lit(None).cast("double")
        last = sum(p[3] for p in open_) <= few
        for i, (low, high, *_) in enumerate(open_):
            inside = F.col("v").between(low, high)
            part = F.when(inside, i).otherwise(part)
            a, b = max(low, -edge), min(high, edge)
            clipped = F.least(F.greatest(F.col("v"), F.lit(a)), F.lit(b))
            spot = F.col("v") if last else F.when(F.col("v") == high, float(bins)).otherwise(F.floor((clipped - a) / ((b - a) or 1.0) * bins).cast("double"))
            place = F.when(inside, spot).otherwise(place)
        counts = v.select("v", part.alias("part"), place.alias("place")).where("part is not null").groupBy("part", "place")
        rows = counts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        open_ = narrowed(open_, sorted(rows, key=lambda r: (r["part"], r["low"])))
    value = lambda x: found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) if x % 1 else found[int(x)]
    return [value(x) for x in at]
