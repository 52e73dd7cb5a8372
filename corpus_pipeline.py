"""A training corpus from ``documents``: filter, de-duplicate, decontaminate, redact, pack.

Each stage reads what the stage before it wrote and keeps the columns of
``documents``; the last gives packed pieces. No stage drops a row for any
reason but its own decision: rows with null or repeated ids pass like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agrispark.llm.common import LAST, restored, zipped
from agrispark.llm.decontaminate import contaminated
from agrispark.llm.near_copies import near_copies
from agrispark.llm.packing import default_tokenizer, pack
from agrispark.llm.pii import find_spans, redacted
from agrispark.llm.quality_rules import quality_rules
from agrispark.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a hash of id and text: the operators judge rows by both, so ids may be null or repeat."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _keep(named: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``named`` whose ``_row`` is (left_semi) or isn't (left_anti) among ``rows``; operators give the largest long as null."""
    some = rows.select(F.coalesce("_row", F.lit(LAST)).alias("_row")).distinct()
    return named.join(some, "_row", how).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    named = _named(docs)
    return _keep(named, quality_rules(named, id_col="_row").where("kept"), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: texts whose
    sets of 5-word shingles have a similarity of 0.8 or more. Of rows with that id the one
    with the least hash of its text stays."""
    first = near_copies(docs).where("_doc = first._doc and _tk = first._tk").select("_doc", "_tk").distinct()
    keyed = docs.withColumn("_doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("_tk", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = zipped(keyed, "text").join(first, ["_doc", "_tk"], "left_semi").dropDuplicates(["_doc", "_tk"])
    return restored(kept.select(*COLUMNS), "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Items of under five words, which clean texts hold by chance, have to be a whole line of a document, word for word."""
    named = _named(docs)
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("_words", words(F.col("text")))
    bad = contaminated(named, items.where(F.size("_words") >= 5).drop("_words"), id_col="_row").select("_row")
    short = items.where(F.size("_words").between(1, 4)).select("_words").distinct()
    if not short.isEmpty():
        lines = named.select("_row", F.explode(F.split("text", "\n")).alias("line")).select("_row", words(F.col("line")).alias("_words"))
        bad = bad.unionByName(lines.where(F.size("_words").between(1, 4)).join(stored(short), "_words", "left_semi").select("_row"))
    return _keep(named, bad, "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    found = find_spans(docs)
    text = redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left, with their token ids."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
