"""What the operators of this folder share: narrow views of inputs, written tables, per-word memos."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table under the shared folder and read it back: computed once, safe from lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Longer words are rarely met again: texts in scripts without blanks, encoded data. They are not held.
LONGEST_HELD = 64


class Memo(dict):
    """Per-worker memo of a pure function of a word; emptied when it holds ``limit`` words. Only words of up to ``LONGEST_HELD``
    letters or bytes are held, so that its size in memory has a bound as well."""

    def __init__(self, function: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, word):
        value = self.function(word)
        if len(word) > LONGEST_HELD:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


_WORKER: dict[str, object] = {}


def per_worker(key: str, make: Callable):
    """An object with memos that the tasks of one Python worker share. Only the last one is held, so that the stages of a
    pipeline don't add up in the memory of a worker."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def release() -> None:
    """Let go of what the stages before have left in this Python worker."""
    _WORKER.clear()


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null without doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)).cast("int")


def labelled(docs: DataFrame, marks: DataFrame, label: str, modulus: int, held_out: int, keep: bool, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most about ``max_rows`` labelled documents on the learning side, chosen by a hash of doc_id.

    ``keep``: learn from rows whose remainder differs from ``held_out``, else from those that equal it. Labels of a repeated doc_id
    are averaged (a draw gives none); null labels are left out. The chosen labels are the only broadcast side: ``max_rows`` small rows.
    """
    y = F.avg(F.col(label).cast("double"))
    side = remainder(modulus) != held_out if keep else remainder(modulus) == held_out
    chosen = marks.where(F.col(label).isin(0, 1) & side).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(y.alias("_y")).where("_y <> 0.5")
    chosen = chosen.select("_id", (F.col("_y") > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
