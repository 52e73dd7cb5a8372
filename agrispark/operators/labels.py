"""Label lines, file names and dataset splits as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def parse_labels(lines: DataFrame, conf_pos: str = "second") -> DataFrame:
    """Label lines of 5, 6, 9 or 10 tokens: ``layout, class_id, conf, coords`` and the other columns.

    Other lines have layout 'bad' ('blank' without a token) and nulls.
    conf_pos: where lines of 6 and 10 tokens have their confidence, second or last.
    """
    t = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    n = F.size("_t")
    layout = F.when(n == 0, "blank").when(n == 5, "box").when(n == 6, "box_conf").when(n == 9, "quad").when(n == 10, "quad_conf").otherwise("bad")
    has = F.col("layout").endswith("_conf")
    good = ~F.col("layout").isin("blank", "bad")
    at = F.lit(2) if conf_pos == "second" else n
    first = F.when(has & F.lit(conf_pos == "second"), 3).otherwise(2)
    k = F.when(has, n - 2).otherwise(n - 1)
    return (
        lines.withColumn("_t", t)
        .withColumn("layout", layout)
        .withColumns(
            {
                "class_id": F.when(good, F.element_at("_t", 1).cast("int")),
                "conf": F.when(has, F.element_at("_t", at).cast("double")),
                "coords": F.when(good, F.transform(F.slice("_t", first, k), lambda x: x.cast("double"))),
            }
        )
        .drop("_t")
    )


def bounds(labels: DataFrame) -> DataFrame:
    """Bounds of parsed labels of every layout."""
    c = lambda i: F.element_at("coords", i)
    box = F.col("layout").startswith("box")
    odd = F.filter("coords", lambda _, i: i % 2 == 0)
    even = F.filter("coords", lambda _, i: i % 2 == 1)
    good = ~F.col("layout").isin("blank", "bad")
    return labels.where(good).withColumns(
        {
            "minx": F.when(box, c(1) - c(3) / 2).otherwise(F.array_min(odd)),
            "miny": F.when(box, c(2) - c(4) / 2).otherwise(F.array_min(even)),
            "maxx": F.when(box, c(1) + c(3) / 2).otherwise(F.array_max(odd)),
            "maxy": F.when(box, c(2) + c(4) / 2).otherwise(F.array_max(even)),
        }
    )


def to_map(boxes: DataFrame, tile_size: float = 10.0) -> DataFrame:
    """Bounds in 0..1 of a tile to map units, y turned; the tile comes from ``stem``."""
    row = F.regexp_extract("stem", r"tile_(\d+)_(\d+)", 1).cast("int")
    col = F.regexp_extract("stem", r"tile_(\d+)_(\d+)", 2).cast("int")
    return boxes.withColumns(
        {
            "map_minx": (col + F.col("minx")) * tile_size,
            "map_maxx": (col + F.col("maxx")) * tile_size,
            "map_miny": (row + 1 - F.col("maxy")) * tile_size,
            "map_maxy": (row + 1 - F.col("miny")) * tile_size,
        }
    )


def canonical_stem(name: Column) -> Column:
    """A download's stem: without what follows .rf., _NEN, _png and _jpg; lower case."""
    out = F.element_at(F.split(name, r"\.rf\."), 1)
    for part in ("_NEN", "_png", "_jpg"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.lower(F.trim(out))


def split_dataset(stems: DataFrame, shares: tuple[float, float] = (0.7, 0.2), seed: int = 42) -> DataFrame:
    """``stem, split``: disjoint train, val and test shares of the distinct stems, in the order of a seeded digest.

    Ranks come from counts of digest prefixes, so the stems aren't sorted in one task.
    """
    d = stems.select("stem").distinct().withColumn("_d", F.md5(F.concat(F.lit(f"{seed}:"), F.col("stem")))).withColumn("_b", F.substring("_d", 1, 2))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", "stem"))
    ranked = d.join(F.broadcast(counts), "_b").withColumn("_r", rank)
    train, val = (F.floor(F.col("_all") * s + 1e-9) for s in (shares[0], shares[0] + shares[1]))
    return ranked.select("stem", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= val, "val").otherwise("test").alias("split"))


def confusion_lines(counts: DataFrame) -> DataFrame:
    """``tp, fp, fn`` and scores as the lines of a report."""
    pairs = [("TP", "tp"), ("FP", "fp"), ("FN", "fn"), ("Accuracy", "accuracy"), ("Precision", "precision"), ("F1", "f1"), ("Recall", "recall")]
    rows = [F.struct(F.lit(i).alias("no"), F.concat(F.lit(f"{n}: "), F.col(c).cast("string")).alias("line")) for i, (n, c) in enumerate(pairs)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def confusion_from_lines(lines: DataFrame) -> DataFrame:
    """``tp, fp, fn`` back from report lines."""
    get = lambda n: F.max(F.when(F.col("line").startswith(f"{n}: "), F.regexp_extract("line", r": (\d+)", 1))).cast("long")
    return lines.agg(get("TP").alias("tp"), get("FP").alias("fp"), get("FN").alias("fn"))


def collapse_classes(parsed: DataFrame, lines: str = "line") -> DataFrame:
    """Label lines with class 0 in place of any class; blank lines are left out."""
    return parsed.where(F.trim(lines) != "").withColumn(lines, F.regexp_replace(F.trim(F.col(lines)), r"^\S+", "0"))


def prefixed(name: Column, prefix: str) -> Column:
    """``prefix_name``, unless the name holds the prefix already."""
    return F.when(F.contains(name, F.lit(prefix)), name).otherwise(F.concat(F.lit(f"{prefix}_"), name))


def field_name(name: Column) -> Column:
    """``base_size_tile`` and the ending of an oriented-box download; other names stay."""
    pattern = r"^(.+?)_(bigger|mid|small)_obb_(tile_\d+_\d+).*(\.\w+)$"
    return F.regexp_replace(name, pattern, "$1_$2_$3$4")


def cut_stem(name: Column, marks: tuple[str, ...] = ("_png", "_NEN")) -> Column:
    """A name up to the first of ``marks`` in it; without one, up to its third underscore."""
    places = [F.instr(name, m) for m in marks]
    first = F.least(*(F.when(p > 0, p) for p in places)) if len(marks) > 1 else F.when(places[0] > 0, places[0])
    return F.coalesce(F.substr(name, F.lit(1), first - 1), F.substring_index(name, "_", 3))


def paired(images: DataFrame, labels: DataFrame, key) -> DataFrame:
    """Images and labels of one canonical key, by an equi-join on it: both sides' ``name`` as ``image, label``."""
    a = images.select(F.col("name").alias("image"), key(F.col("name")).alias("_k"))
    b = labels.select(F.col("name").alias("label"), key(F.col("name")).alias("_k"))
    return a.join(b, "_k").select(F.col("_k").alias("stem"), "image", "label")


def replaced(names: DataFrame, lookup: DataFrame, key: str = "stem") -> DataFrame:
    """Rows of ``names`` with the ``name`` of ``lookup`` where it has their key, and ``found``; the least name of several."""
    one = lookup.groupBy(key).agg(F.min("name").alias("_new"))
    out = names.join(one, key, "left")
    return out.withColumn("found", F.col("_new").isNotNull()).withColumn("name", F.coalesce("_new", "name")).drop("_new")


def combined(datasets: dict[str, DataFrame]) -> DataFrame:
    """All rows of several datasets; names get their dataset's prefix, columns that one lacks are null."""
    out = None
    for label, d in datasets.items():
        one = d.withColumn("name", prefixed(F.col("name"), label)).withColumn("dataset", F.lit(label))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset")
    return out


def split_by_field(stem: Column, fields: dict[str, str] | None = None) -> Column:
    """train, val or test by the field in a name (default: large, mid, small in this order); null without one."""
    out = None
    for field, part in (fields or {"large": "train", "mid": "val", "small": "test"}).items():
        hit = F.contains(stem, F.lit(field))
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out


def apply_split(names: DataFrame, split: DataFrame) -> DataFrame:
    """``names`` with the saved split of their stem; stems without one are left out."""
    return names.join(split.select("stem", "split").dropDuplicates(["stem"]), "stem")


def descriptor(classes: DataFrame, root: str) -> DataFrame:
    """One row describing a dataset: paths of its parts, number of classes and their names, from ``class_id, class_name``."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("class_id", "class_name"))), lambda c: c["class_name"])
    paths = [F.lit(f"{root}/images/{p}").alias(p) for p in ("train", "val", "test")]
    return classes.agg(names.alias("names")).select(*paths, F.size("names").alias("nc"), "names")


def numbered(names: DataFrame, group: str, order: str) -> DataFrame:
    """Names with a running number from 0 in each group before their ending."""
    w = Window.partitionBy(group).orderBy(order)
    stem, end = F.regexp_replace("name", r"\.\w+$", ""), F.regexp_extract("name", r"(\.\w+)$", 1)
    return names.withColumn("name", F.concat(stem, F.lit("_"), (F.row_number().over(w) - 1).cast("string"), end))


def pending(source: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs that have no output yet; all of them with ``overwrite``."""
    return source if overwrite else source.join(done.select(key).distinct(), key, "left_anti")


def to_tile(boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """Map boxes to shares of their ``tile_row, tile_col``, y turned and all clamped to 0..1: ``x1, y1, x2, y2, cx, cy, w, h``."""
    left, top = F.col("tile_col") * size, (F.col("tile_row") + 1) * size
    share = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    out = boxes.withColumns(
        {"x1": share((F.col("minx") - left) / size), "x2": share((F.col("maxx") - left) / size), "y1": share((top - F.col("maxy")) / size), "y2": share((top - F.col("miny")) / size)}
    )
    return out.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})


def quad_line(class_id: Column, ring: list[tuple[Column, Column]], conf: Column | None = None) -> Column:
    """A label line of a quad, six decimals rounded half to even, with its confidence second if given."""
    numbers = ([conf] if conf is not None else []) + [c for p in ring for c in p]
    return F.concat_ws(" ", class_id.cast("string"), *(F.format_string("%.6f", F.bround(c, 6)) for c in numbers))


def geojson(boxes: DataFrame, key: str) -> DataFrame:
    """``key, feature``: each box as a GeoJSON polygon with its tile and class."""
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("maxx", "maxy"), pt("minx", "maxy"), pt("minx", "miny"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    facts = F.struct(F.concat_ws("_", F.lit("tile"), "tile_row", "tile_col").alias("tile"), "class_id")
    return boxes.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), facts.alias("properties"), shape.alias("geometry"))).alias("feature"))
