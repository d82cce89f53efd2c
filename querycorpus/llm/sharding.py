"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querycorpus.functions.scale import cut_lineage, global_position
from querycorpus.llm.common import documents


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sum(batch.num_rows for batch in batches)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64())], ["part", "n"])


def communication_matrix(counts: np.ndarray, capacities: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """How many rows each partition sends to each shard, as a uniform shuffle would: row p is drawn without
    replacement from the places that are still free. Row sums are ``counts``, column sums ``capacities``."""
    rng, free = np.random.default_rng(seed), capacities.copy()
    matrix = np.zeros((len(counts), len(capacities)), np.int64)
    for p, n in enumerate(counts):
        places, left = int(free.sum()), int(n)
        for j in range(len(free)):
            places -= int(free[j])
            if not left:
                break
            matrix[p, j] = _hypergeometric(rng, int(free[j]), places, left)
            left -= matrix[p, j]
        free -= matrix[p]
    return matrix


def partition_row(ends: np.ndarray, capacities: np.ndarray, seed: int, part: int, fan: int = 32) -> np.ndarray:
    """The row of one partition of the communication matrix, without the other rows. ``ends`` are the running sums of the rows by partition.

    The partitions are split into ``fan`` ranges, those again, down to single ones. A small matrix deals the places of a range to its
    parts; its seed is named by the range, so all partitions of a range draw the same one. Only the ranges of ``part`` are drawn: some
    ``fan`` x shards numbers for each factor ``fan`` of partitions. Sums of a hypergeometric deal are dealt alike, so the rows together are uniform.
    """
    low, high, free = 0, len(ends), capacities
    before = np.r_[0, ends]
    while high - low > 1:
        step = -(-(high - low) // fan)
        bounds = np.append(np.arange(low, high, step), high)
        dealt = communication_matrix(np.diff(before[bounds]), free, [seed, low, high])
        own = (part - low) // step
        low, high, free = int(bounds[own]), int(bounds[own + 1]), dealt[own]
    return free


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A draw of any size. Beyond the generator's range of 10^9 places it is drawn in parts of 10^6 rows, each binomial:
    a part is at most about a thousandth of the places, the sums stay exact."""
    total, limit = 0, 900_000_000
    while drawn:
        if good + bad < limit:
            return total + int(rng.hypergeometric(good, bad, drawn))
        part = min(drawn, 1_000_000)
        share = good / (good + bad)
        got = min(good, part, int(rng.binomial(part, share)))
        got = max(got, part - bad)
        total, good, bad, drawn = total + got, good - got, bad - (part - got), drawn - part
    return total


def _dealt(ends: np.ndarray, capacities: np.ndarray, seed: int):
    """Give each row of a partition a shard: the partition's row of the matrix in random order. A second number orders the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        # A partition without rows may lie beyond those that were counted.
        own_row = partition_row(ends, capacities, seed, part) if part < len(ends) else np.zeros_like(capacities)
        shards = rng.permutation(np.repeat(np.arange(len(capacities), dtype=np.int32), own_row))
        done = 0
        for batch in batches:
            n = batch.num_rows
            own = pa.array(shards[done : done + n], pa.int32())
            order = pa.array(rng.integers(0, 2**63 - 1, n, dtype=np.int64), pa.int64())
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, own, order], [*batch.schema.names, "_shard", "_order"])

    return run


def shuffle_into_shards(df: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Deal all rows into ``shards`` shards whose row counts differ by one at most; add ``shard`` and ``slot``.

    1. The rows are checkpointed, which fixes what each partition holds, and counted by partition.
    2. Each partition draws its own row of the communication matrix (partitions x shards) from the counts: eight bytes a partition.
    3. It permutes that over its rows, then rows are exchanged.
    4. Each shard is permuted by a second random number; ``slot`` counts from 0 without gaps. A shard is range
       partitioned over as many tasks as its rows need.

    Equal seeds on equal partitions give equal results. All columns are kept whatever their values; columns
    called shard or slot are replaced. Nulls, repeated rows and ties are ordinary rows. No rows: none.
    """
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]).alias("_row"))
    fixed = cut_lineage(kept)
    parts = sorted((r["part"], r["n"]) for r in fixed.mapInArrow(_counted, "part int, n long").collect())
    counts = np.zeros(max([p for p, _ in parts], default=-1) + 1, np.int64)
    for part, n in parts:
        counts[part] = n
    total = int(counts.sum())
    capacities = np.full(shards, total // shards, np.int64)
    capacities[np.random.default_rng([seed, 1]).permutation(shards)[: total % shards]] += 1
    schema = T.StructType([*fixed.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_order", T.LongType())])
    dealt = fixed.mapInArrow(_dealt(np.cumsum(counts), capacities, seed), schema)
    placed = global_position(dealt, ["_shard"], [F.col("_order")], "_slot")
    return placed.select("_row.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
