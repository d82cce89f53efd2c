"""Writers: split caches, JSON outputs, reports, unique appends, kept query results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage
from querycorpus.sources.keyruns import KeyRuns


def read_if_complete(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing or no finished write is there. A folder that can't be read is an error."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    there = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    return spark.read.parquet(path) if there else None


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows at ``path``, finished appends or not, or None if there are no files yet."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "*.parquet")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return spark.read.parquet(path) if files else None


def cached_splits(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Processed rows, written once by split and read back on later calls."""
    kept = read_if_complete(spark, path)
    if kept is None:
        build().write.mode("overwrite").partitionBy("split").parquet(path)
        kept = spark.read.parquet(path)
    return kept


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(config: DataFrame, rows: DataFrame, totals: DataFrame, path: str) -> None:
    """Three tables under one path: the settings, one row per prediction, the totals."""
    config.write.mode("overwrite").json(f"{path}/config")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    totals.write.mode("overwrite").json(f"{path}/totals")


def append_unique(rows: DataFrame, path: str, key: str, stored_keys: str = "error", step: tuple[str, int] | None = None) -> int:
    """Append rows with a unique key to a Parquet table of the same column set; gives the number of key buckets opened.

    A key given twice is an error. A key that is stored already is an error too, or with ``stored_keys="skip"`` its row is left out.
    Null keys equal nothing. Stored keys are found by ``KeyRuns``, not in the table. ``step``, a stream's name and a number that rises,
    marks a repeated step: one that is done adds nothing, one that broke off adds what is missing.

    The keys are noted as pending before the rows are written and as stored after that, so an append that broke off is known to the next one.
    One writer at a time; a second one fails.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows)  # checked, compared and written from one computation
    if not rows.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).limit(1).isEmpty():
        raise ValueError(f"column {key} must be unique in the rows to append")
    stored = stored_rows(spark, path)
    if stored is not None and set(stored.columns) != set(rows.columns):
        raise ValueError(f"columns differ: stored {sorted(stored.columns)}, given {sorted(rows.columns)}")
    runs = KeyRuns(spark, path, key)
    repeated = False
    if runs.manifest:
        done, pending = runs.manifest["steps"], runs.manifest["pending"]
        if step and done.get(step[0], -1) >= step[1]:
            return 0
        repeated = bool(step and pending and pending["step"] == list(step))
    runs.start(stored, rows.schema[key].dataType.simpleString())
    found, opened = runs.stored(rows.select(key))
    if found is not None:
        found = cut_lineage(found)
        if stored_keys == "error" and not repeated and not found.limit(1).isEmpty():
            raise ValueError(f"some values of {key} are stored already")
        rows = cut_lineage(rows.join(found, key, "left_anti"))
    if stored is not None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema])
    run = runs.new_run(rows.select(key))
    runs.write(pending={"run": run, "step": list(step) if step else None})
    rows.write.mode("append").parquet(path)
    steps = {**runs.manifest["steps"], **({step[0]: step[1]} if step else {})}
    runs.write(runs=runs.with_run(run), pending=None, steps=steps)
    return opened


class ResultStore:
    """Query results kept as Parquet under the hash of (database, SQL), with their row order. Errors are never kept.

    Files of a table come back in any order, so each row is stored with its place (``ROW``): a number that rises with
    the order of the result, taken before the write without a shuffle.
    """

    ROW = "_row"

    def __init__(self, root: str) -> None:
        self.root = root

    def path(self, db_id: str, sql: str) -> str:
        key = hashlib.sha256(f"{db_id}\n{sql}".encode()).hexdigest()
        return f"{self.root}/{key}"

    def get_placed(self, spark: SparkSession, db_id: str, sql: str) -> DataFrame | None:
        """The kept rows in no order; their last column is their place."""
        return read_if_complete(spark, self.path(db_id, sql))

    def get(self, spark: SparkSession, db_id: str, sql: str) -> DataFrame | None:
        """The kept result in its own order."""
        kept = self.get_placed(spark, db_id, sql)
        return None if kept is None else kept.orderBy(self.ROW).drop(self.ROW)

    def keep(self, spark: SparkSession, db_id: str, sql: str, run: Callable[[], DataFrame]) -> None:
        """Run and store the query unless it is there."""
        if self.get_placed(spark, db_id, sql) is None:
            result = run()
            if self.ROW in result.columns:
                raise ValueError(f"a result column may not be called {self.ROW}")
            # Repeated column names can't be stored; the second and later ones get their place.
            names = [c if c not in result.columns[:i] else f"{c}_{i}" for i, c in enumerate(result.columns)]
            result.toDF(*names).withColumn(self.ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(self.path(db_id, sql))

    def get_or_run(self, spark: SparkSession, db_id: str, sql: str, run: Callable[[], DataFrame]) -> DataFrame:
        self.keep(spark, db_id, sql, run)
        return self.get(spark, db_id, sql)


def result_keys(log: DataFrame) -> DataFrame:
    """The store key of every (db_id, sql) of a log, as a column."""
    return log.withColumn("result_key", F.sha2(F.concat_ws("\n", "db_id", "sql"), 256))
