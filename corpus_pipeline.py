"""The training-corpus pipeline: a row of stages over ``documents``, each written and read again as a table.

A stage takes (spark, docs, sf_dir) and returns what it keeps: all columns of ``docs``, also those it does not know, up to the last stage,
which returns the pieces of the packed windows. Labels come from the ``labels`` table of ``sf_dir``. Null and empty texts, null and repeated
doc_id and tables without rows have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import documents, labels, written
from querycorpus.llm.line_dedup import dedup_lines
from querycorpus.llm.minhash_dedup import near_duplicates
from querycorpus.llm.packing import pack_documents
from querycorpus.llm.quality import keep_good
from querycorpus.llm.toxicity import drop_toxic


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least 0.7 for quality."""
    return keep_good(docs, labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5 for toxicity."""
    return drop_toxic(docs, labels(spark, sf_dir))


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside doc_id and text, so that other columns may have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text."""
    out = dedup_lines(_packed(docs))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more."""
    dropped = near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    kept = _packed(docs).join(dropped, F.col("doc_id").cast("long") == F.col("_dropped"), "left_anti")
    return kept.select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens."""
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]
#: Classifiers, signatures and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
