"""Label, route and report files as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_labels(lines: DataFrame, path: str, parts: list[str] | None = None) -> None:
    """Rows ``line`` as text, in one folder for each value of ``parts``."""
    parts = parts or []
    lines.select(*parts, F.col("line").alias("value")).write.partitionBy(*parts).mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``line, file`` of all text files below a folder, and the columns of its ``name=value`` folders."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return lines.withColumnRenamed("value", "line")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``line, run`` of prediction runs in folders ``runN``; lines of other folders are left out."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/run(\d+)/", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"), run.alias("run"))
    return lines.where("run <> ''").withColumn("run", F.col("run").cast("int"))


def next_run(runs: DataFrame) -> DataFrame:
    """``run``: one more than the greatest, 0 without any."""
    return runs.agg((F.coalesce(F.max("run"), F.lit(-1)) + 1).alias("run"))


def write_route(route: DataFrame, path: str) -> None:
    """``sequence, orig_fid, x, y`` as CSV with a header, in order within each file."""
    out = route.select(F.col("seq").alias("sequence"), F.col("fid").alias("orig_fid"), "x", "y")
    out.repartitionByRange("sequence").sortWithinPartitions("sequence").write.mode("overwrite").option("header", True).csv(path)


def write_parameters(spark: SparkSession, values: dict[str, str | float | int | bool], path: str) -> None:
    """The parameters of a run as one JSON row beside its output."""
    columns = [F.lit(v).alias(k) for k, v in sorted(values.items())]
    spark.range(1).select(*columns).write.mode("overwrite").json(path)


def write_detections(boxes: DataFrame, path: str, key: str = "pred_id") -> None:
    """A layer of detections as a table of ``key, class_id, conf, minx, miny, maxx, maxy``; a table already there is replaced."""
    boxes.select(key, "class_id", "conf", "minx", "miny", "maxx", "maxy").write.mode("overwrite").parquet(path)


def read_detections(spark: SparkSession, path: str, key: str = "pred_id") -> DataFrame:
    """A layer that ``write_detections`` wrote; rows without bounds are left out."""
    kind = f"{key} long, class_id int, conf double, minx double, miny double, maxx double, maxy double"
    return spark.read.schema(kind).parquet(path).where("minx <= maxx AND miny <= maxy")


def read_parameters(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The record that ``write_parameters`` wrote, with the columns of the schema ``kind``."""
    return spark.read.schema(kind).json(path)


def append_histograms(histograms: DataFrame, path: str, image: str = "image_id") -> None:
    """Adds rows ``image, word, weight`` to a feature table; images that are in it already are left as they are."""
    spark = histograms.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        histograms = histograms.join(spark.read.parquet(path).select(image).distinct(), image, "left_anti")
    histograms.write.mode("append").parquet(path)
