"""The text pipeline: from documents to packed sequences.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``, whatever further columns the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.storage import stored
from plumbline.llm.exact_dedup import drop_exact_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality import drop_low_quality, train_quality
from plumbline.llm.queries import WORD_VOCABULARY
from plumbline.llm.simhash_dedup import drop_near_duplicates
from plumbline.llm.substring_dedup import remove_repeated_windows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_low_quality(docs, train_quality(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for A-Z and a-z, the one with the largest id."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with close fingerprints the one with the smallest id."""
    return drop_near_duplicates(docs, shingle=3, distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat an earlier window.

    A text that loses words is left as its other words, joined by one space, and
    ``n_chars`` is counted again; other texts stay as they are.
    """
    rows = remove_repeated_windows(docs, whole_rows=True)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; the documents end here."""
    return pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# A vocabulary, a trained classifier and fingerprints cannot be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
