"""Results of many queries in one table: rows by column types, made visible by a manifest, settled into sorted files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

MANIFEST = "result string, fields string, shape string, write string"


class ResultTable:
    """Query results kept under the hash of (database, SQL), with types, column names (repeated ones too) and row order. Errors are never kept.

    Results with the same list of column types share one folder of Parquet files, whatever their number and their names. A row carries its
    result, its write and its place. A result exists once its row stands in the manifest; rows of a write that broke off have none and are
    never read. After ``settle_after`` writes the young rows are sorted by result into the settled files, each row once in its life; a marker
    file makes that visible, and the young folder before the last one is deleted. So a DataFrame got before the last settling but one is to
    be got again. If two writers keep the same result, one of the two counts.
    """

    def __init__(self, root: str, settle_after: int = 64, per_write: int = 64) -> None:
        self.root, self.settle_after, self.per_write = root, settle_after, per_write

    @staticmethod
    def key(db_id: str, sql: str) -> str:
        return hashlib.sha256(f"{db_id}\n{sql}".encode()).hexdigest()

    def _names(self, spark: SparkSession, *below: str) -> list[str]:
        """The names in a folder, none if it is not there."""
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _state(self, spark: SparkSession) -> tuple[int, list[str]]:
        """The number of the young folder, and the writes that settled rows carry."""
        marks = self._names(spark, "settlings")
        return len(marks), marks

    def _manifest(self, spark: SparkSession) -> DataFrame:
        """One row per visible result and its folder."""
        generation, marks = self._state(spark)
        parts = [spark.createDataFrame([], MANIFEST + ", folder string")]
        for folder in ("settled", f"young-{generation}"):
            if self._names(spark, "manifest", folder):
                part = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{folder}").withColumn("folder", F.lit(folder))
                parts.append(part.where(F.col("write").isin(marks)) if folder == "settled" else part)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.groupBy("result").agg(F.min_by(F.struct("fields", "shape", "write", "folder"), "write").alias("e")).select("result", "e.*")

    def entries(self, spark: SparkSession, keys: list[str]) -> dict[str, Row]:
        """The manifest rows of the results that are there, of those asked for."""
        return {r["result"]: r for r in self._manifest(spark).where(F.col("result").isin(keys)).collect()}

    @staticmethod
    def _stored_schema(fields: str) -> StructType:
        given = StructType.fromJson(json.loads(fields))
        own = [StructField("_result", StringType()), StructField("_write", StringType()), StructField("_row", LongType())]
        return StructType(own + [StructField(f"c{i}", f.dataType) for i, f in enumerate(given)])

    def get(self, spark: SparkSession, db_id: str, sql: str) -> DataFrame | None:
        """The kept result in its own order, or None."""
        entry = self.entries(spark, [self.key(db_id, sql)]).get(self.key(db_id, sql))
        if entry is None:
            return None
        rows = spark.read.schema(self._stored_schema(entry["fields"])).parquet(f"{self.root}/rows/{entry['folder']}/{entry['shape']}")
        rows = rows.where((F.col("_result") == entry["result"]) & (F.col("_write") == entry["write"])).orderBy("_row")
        return rows.drop("_result", "_write", "_row").toDF(*StructType.fromJson(json.loads(entry["fields"])).names)

    def keep_all(self, spark: SparkSession, queries: Iterable[tuple[str, str, Callable[[], DataFrame]]]) -> dict[tuple[str, str], str]:
        """Run and keep the queries (db_id, sql, run) that are not there yet, many in one write; gives the errors of those that failed.

        If a write fails, its queries are halved until the failing ones stand alone, so the others are kept.
        """
        wanted = {self.key(db_id, sql): (db_id, sql, run) for db_id, sql, run in queries}
        errors: dict[tuple[str, str], str] = {}
        keys = list(wanted)
        for start in range(0, len(keys), self.per_write):
            some = keys[start : start + self.per_write]
            there = self.entries(spark, some)
            shapes: dict[str, list[tuple[str, DataFrame]]] = {}
            for key in some:
                if key not in there:
                    try:
                        frame = wanted[key][2]()
                        types = json.dumps([f.dataType.jsonValue() for f in frame.schema])
                    except Exception as error:
                        errors[wanted[key][:2]] = str(error)
                    else:
                        shapes.setdefault(hashlib.md5(types.encode()).hexdigest(), []).append((key, frame))
            for shape, results in shapes.items():
                errors |= {wanted[key][:2]: message for key, message in self._write(spark, shape, results)}
        if len([n for n in self._names(spark, "manifest", f"young-{self._state(spark)[0]}") if n.endswith(".parquet")]) >= self.settle_after:
            self.settle(spark)
        return errors

    def _write(self, spark: SparkSession, shape: str, results: list[tuple[str, DataFrame]]) -> list[tuple[str, str]]:
        write, folder = uuid.uuid4().hex, f"young-{self._state(spark)[0]}"
        together = None
        for key, frame in results:
            named = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
            # The number rises with the order of the result and needs no shuffle.
            placed = named.select(F.lit(key).alias("_result"), F.lit(write).alias("_write"), F.monotonically_increasing_id().alias("_row"), *named.columns)
            together = placed if together is None else together.union(placed)
        try:
            together.write.mode("append").parquet(f"{self.root}/rows/{folder}/{shape}")
        except Exception as error:
            if len(results) == 1:
                return [(results[0][0], str(error))]
            half = len(results) // 2
            return self._write(spark, shape, results[:half]) + self._write(spark, shape, results[half:])
        rows = [(key, frame.schema.json(), shape, write) for key, frame in results]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest/{folder}")
        return []

    def keep(self, spark: SparkSession, db_id: str, sql: str, run: Callable[[], DataFrame]) -> None:
        for message in self.keep_all(spark, [(db_id, sql, run)]).values():
            raise RuntimeError(message)

    def get_or_run(self, spark: SparkSession, db_id: str, sql: str, run: Callable[[], DataFrame]) -> DataFrame:
        self.keep(spark, db_id, sql, run)
        return self.get(spark, db_id, sql)

    def settle(self, spark: SparkSession) -> None:
        """Move the young rows to the settled files, sorted by result. One that breaks off leaves the young rows in force."""
        generation, _ = self._state(spark)
        folder, write = f"young-{generation}", f"{generation:09d}-{uuid.uuid4().hex}"
        young = self._manifest(spark).where(F.col("folder") == folder)
        for entry in young.groupBy("shape").agg(F.min("fields").alias("fields")).collect():
            rows = spark.read.schema(self._stored_schema(entry["fields"])).parquet(f"{self.root}/rows/{folder}/{entry['shape']}")
            visible = young.select(F.col("result").alias("_result"), F.col("write").alias("_write"))
            moved = rows.join(visible, ["_result", "_write"], "left_semi").withColumn("_write", F.lit(write)).select(*rows.columns)
            moved = moved.repartitionByRange("_result", "_row").sortWithinPartitions("_result", "_row")
            moved.write.mode("append").parquet(f"{self.root}/rows/settled/{entry['shape']}")
        kept = young.withColumn("write", F.lit(write)).select("result", "fields", "shape", "write")
        kept.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest/settled")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/settlings/{write}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.create(path, False).close()
        for kind in ("rows", "manifest"):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/young-{generation - 1}"), True)
