"""Table helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LAST = 9223372036854775807
#: Rows of an Arrow batch of whole texts, where the session has Spark's default of 10,000.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc, _tk, _text``: the id (null: the largest long), a hash of the text and the text (null: empty).

    A row's id and text name it, so that no row number has to stay the same
    when a lost partition is computed again; rows alike in both get alike results.
    """
    conf = docs.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text).alias("_tk"), text.alias("_text")
    )


def original_id(doc: Column | str = "_doc") -> Column:
    doc = F.col(doc) if isinstance(doc, str) else doc
    return F.when(doc != LAST, doc)


def zipped(base: DataFrame, column: str = "_text") -> DataFrame:
    """A text column as zstd bytes (null stays), so that a shuffle of whole texts moves and keeps less; ``unzipped`` and ``restored`` undo it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else pack(t) for t in cols[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names, at = base.columns, base.columns.index(column)
    raw = base.withColumn(column, F.col(column).cast("binary"))
    return raw.mapInArrow(run, raw.schema)


def unzipped(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if z is None else unpack(z) for z in column.to_pylist()], pa.binary())


def restored(packed: DataFrame, column: str = "_text") -> DataFrame:
    """The table that ``zipped`` was given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = unzipped(cols[at])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names, at = packed.columns, packed.columns.index(column)
    return packed.mapInArrow(run, packed.schema).withColumn(column, F.col(column).cast("string"))
