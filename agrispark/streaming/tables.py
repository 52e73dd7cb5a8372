"""Keyed results of a stream as a table in files: changes batch by batch, folded together now and then."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches of which a folder holds all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def latest(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """The last row of each key in a table that ``merged`` keeps; an empty one where nothing was written.

    Read from the last whole table and the changes after it, so its cost
    follows the number of keys and of changes since, not the stream's length.
    """
    within = lambda found: [n for n in found if upto is None or n <= upto]
    bases = within(_complete(spark, f"{path}/base"))
    base = bases[-1] if bases else -1
    folders = [(base, f"{path}/base/batch={base}")] if bases else []
    folders += [(n, f"{path}/changes/batch={n}") for n in within(_complete(spark, f"{path}/changes")) if n > base]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = None
    for n, folder in folders:
        one = spark.read.schema(schema).parquet(folder).withColumn("_batch", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    values = F.struct(*schema.fieldNames())
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(values, "_batch").alias("r")).select("r.*")


def merged(stream: DataFrame, keys: Sequence[str], path: str, checkpoint_path: str, fold_every: int = 16, before_commit: Callable[[int], None] | None = None) -> DataFrame:
    """Run a stream in update mode over all that is there, then give its table: the last row of each key.

    Each batch's rows replace what its key had, as they are totals and not
    differences. They are written to a folder of the batch, which a replay
    after a failure overwrites, so a batch counts once however often it runs;
    a folder is read only when it is whole. Every ``fold_every`` batches the
    table so far is written as one. before_commit: called with the batch's
    number when its rows are written and the batch isn't yet done, for tests.
    """
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % fold_every == 0:
            latest(spark, path, schema, keys, number).write.mode("overwrite").parquet(f"{path}/base/batch={number}")
        if before_commit is not None:
            before_commit(number)

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint_path).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return latest(stream.sparkSession, path, schema, keys)
