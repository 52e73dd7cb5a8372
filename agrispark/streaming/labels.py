"""Label files that arrive one by one, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from agrispark.operators.labels import parse_labels


def label_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of parsed label lines and their ``file``, as files arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(path)
    return parse_labels(lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def tile_counts(parsed: DataFrame) -> DataFrame:
    """Running ``tile_row, tile_col, n, n_conf, mean_conf`` of the detections in files named after tiles.

    Blank and bad lines, and files without a tile in their name, count in none.
    State is one row for each tile; in update mode a batch gives the tiles it
    touched, with their totals so far.
    """
    name = F.element_at(F.split("file", "/"), -1)
    place = lambda i: F.regexp_extract(name, r"tile_(\d+)_(\d+)", i)
    real = parsed.where(~F.col("layout").isin("blank", "bad") & (place(1) != ""))
    return real.groupBy(place(1).cast("int").alias("tile_row"), place(2).cast("int").alias("tile_col")).agg(
        F.count(F.lit(1)).alias("n"), F.count("conf").alias("n_conf"), F.avg("conf").alias("mean_conf")
    )


def class_counts(parsed: DataFrame) -> DataFrame:
    """Running ``layout, class_id, n, mean_conf``; state is one row for each layout and class, so it doesn't grow with the stream."""
    return parsed.groupBy("layout", "class_id").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"))


def drained(stream: DataFrame, table_path: str, checkpoint_path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, then give its result, a Parquet table that each batch replaces (complete) or adds to (append).

    A batch replayed after a failure overwrites its own folder, so no row comes twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        target = table_path if mode == "complete" else f"{table_path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path)


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateless stream with a detector's columns; ``score`` may only project and filter."""
    return score(stream)
