"""A corpus cleaned and packed by five operators, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet under the shared folder and rereads for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import decontaminate as winnow
from braid.llm import line_dedup as lines
from braid.llm import minhash, packing, quality
from braid.llm.common import gathered, materialize
from braid.llm.queries import tokenizer_path

#: Documents with a lower score go.
QUALITY = 0.7
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _like(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c in DOCUMENTS])


def _row() -> Column:
    """Identity of a row: a 64-bit hash of doc_id (null is a value of its own) and text. Only rows equal in both share it, but for collisions."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("text").isNull(), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` and their ``_row``, less those whose identity is in ``rows`` (one column)."""
    return _like(docs).withColumn("_row", _row()).join(rows.toDF("_row").distinct(), "_row", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below ``QUALITY``; learns from all labels of documents that are here.

    With no such label there is nothing to learn from, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.where("quality in (0, 1)").join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        return _like(docs)
    scores = quality.quality_scores(docs, labels, row=_row())
    return gathered(_like(_without(docs, scores.where(F.col("score") < QUALITY).select("row"))), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; documents that had nothing else go. ``n_chars`` follows the text."""
    found = lines.line_dedup(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _like(kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the smallest doc_id of each near-duplicate group; rows equal in doc_id and text once.

    Texts of one doc_id stay apart, and a group of null doc_ids only stays whole.
    """
    gone = minhash.near_duplicates(docs, row=_row()).where(~F.col("kept")).select("row")
    return gathered(_like(_without(docs, gone).dropDuplicates(["_row", "doc_id", "text"])), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = winnow.decontaminate(docs.select(_row().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return gathered(_like(_without(docs, found.where("contaminated").select("doc_id"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Scores, sketches and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
