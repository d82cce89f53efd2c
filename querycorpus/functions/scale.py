"""Building blocks that keep operators whole and balanced when one group is huge.

A single key may hold a third of all rows, so nothing here gathers a group of
unknown size in one task: ranks come from a range partitioning whose order has a
unique tie-break, and top-k is limited on the map side.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="querycorpus-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that may be as large as the rows, whatever Catalyst makes of it.

    Exploded and checkpointed rows keep the size of the files that they came from as an estimate, so that the larger side would be
    collected by the driver and broadcast.
    """
    return df.hint("merge")


#: Into how many parts the rows of one key are dealt by ``dealt_join``.
DEALT = 64


def dealt_join(rows: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join (inner, left_semi or left_anti) of rows, of which one key may hold any number, with the few rows of each key in ``few``: rows are
    dealt by a hash of ``by``, so that the rows of a key go to many tasks, and ``few`` is repeated for each part."""
    part = F.pmod(F.xxhash64(*by), F.lit(DEALT)).cast("int")
    parts = few.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return by_shuffle(rows.withColumn("_dealt", part)).join(parts, [*on, "_dealt"], how).drop("_dealt")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group as column ``rank``.

    Written as a filter on ``row_number`` so Catalyst places a group limit before the
    shuffle: each map task sends at most ``k`` rows of a group, however hot it is.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def global_position(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows of each group from 0 without holding a group in one task.

    Rows are range partitioned on (group, order), so a hot group spans many partitions, sorted inside each and numbered
    through by ``monotonically_increasing_id``. A row's place is its number less the first number of its group in the
    partition, plus the rows of the group in earlier partitions; both come from one row per (partition, group), so the rows themselves
    are shuffled once. ``order`` must end in a tie-break that is unique in its group.
    """
    keys = [F.col(c) for c in group]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(placed.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    sizes = placed.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least"))
    shift = shift.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(group)], "_shift")
    on = [F.shiftright("_m", 33) == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(group)]]
    joined = placed.join(shift, on, "inner")
    return joined.select(*df.columns, (F.col("_m") + F.col("_shift")).cast("long").alias(name))
