"""Incremental reading of a folder of JSON Lines files, a few files per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querycorpus.sources.sinks import append_unique


def stream_jsonl(spark: SparkSession, folder: str, schema: StructType | str, files_per_step: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).json(folder)


def land_available(stream: DataFrame, target: str, progress: str) -> None:
    """Write all files present now to Parquet in small steps, exactly once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_available(stream: DataFrame, target: str, progress: str, key: str, name: str) -> None:
    """Append all rows present now to a table with unique keys in small steps, and stop.

    Of rows with one key the stored one stays, else that of the earlier step, else the least one. A step that is run again after a failure,
    or all of them after ``progress`` was lost, adds nothing twice: its number is kept beside the keys under the stream's ``name``.
    With new ``progress`` numbers start again, so take a new name then; stored keys are skipped all the same. Null keys are all kept.
    """

    def step(rows: DataFrame, number: int) -> None:
        columns = rows.columns
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
        append_unique(one.unionByName(rows.where(F.col(key).isNull())), target, key, "skip", (name, number))

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
