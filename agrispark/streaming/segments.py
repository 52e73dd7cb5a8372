"""Segments that arrive as a stream of feature rows, scored by a detector that was fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from agrispark.operators.detectors import Detector


def segment_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of feature rows, as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)


def scored_segments(stream: DataFrame, detector: Detector, cut: float, tiles: DataFrame | None = None, on: tuple[str, ...] = ("tile_row", "tile_col")) -> DataFrame:
    """The stream's rows with ``score`` and ``is_inlier`` (a score of ``cut`` or more), and the columns of their tile.

    The fitted detector is part of the plan, as numbers in expressions, so a
    batch needs nothing but its rows: no state is kept. ``tiles`` is a table
    of one row for each tile, which is joined as it is when a batch starts;
    rows of tiles that it doesn't hold keep nulls. Rows with null features
    have a null score and are no inliers.
    """
    out = detector.score(stream).withColumn("is_inlier", F.coalesce(F.col("score") >= cut, F.lit(False)))
    return out if tiles is None else out.join(tiles, list(on), "left")
