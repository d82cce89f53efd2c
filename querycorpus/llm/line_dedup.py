"""Repeated lines across documents by levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import scratch_path
from querycorpus.llm.common import documents, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Line keys seen so far, each with the first document that held it, as levelled sorted runs.

    A run is a table bucketed and sorted by the 128-bit key hash, so joining a batch with a run moves the
    batch only. Every batch adds a run on level 0; ``fanout`` runs of a level are merged into one of the
    next, so there are at most ``fanout`` runs on each of log(batches) levels and a key is rewritten once a
    level. Runs hold different keys. ``close`` drops the table names.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = keys.select(*KEY, "owner").repartition(self.buckets, "h1").sortWithinPartitions(*KEY)
        rows.write.bucketBy(self.buckets, "h1").sortBy(*KEY).option("path", scratch_path(self.spark, name)).saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def seen(self) -> DataFrame:
        """All keys with their owners, in no order."""
        runs = [self.spark.table(name) for name in self.tables()]
        return _union(runs)

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch's keys with every run and add the new ones. Batches come in rising doc_id."""
        fresh = lines.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for name in self.tables():
            fresh = fresh.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(_union([self.spark.table(name) for name in merged]), level + 1)
            for name in merged:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def close(self) -> None:
        for name in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _drops(docs: DataFrame, batches: int, fanout: int, shortest: int) -> DataFrame:
    """Per document with repeated lines: (doc_id, text hash, sorted places of the lines to drop, from 0)."""
    spark = docs.sparkSession
    key = F.transform(lines_of(F.col("text")), line_key)
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(key).alias("place", "key")).where(F.length("key") >= shortest)
    lines = lines.select("doc_id", "th", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    lines = lines.withColumn("batch", F.when(F.col("doc_id").isNull(), batches).otherwise(batch))
    lines = written(lines, "lines", ["batch"])
    runs = LineRuns(spark, fanout)
    for number in range(batches + 1):
        runs.add(lines.where(F.col("batch") == number))
    repeated = lines.join(runs.seen().withColumnRenamed("owner", "first_doc"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    drops = written(repeated.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("place")).alias("drops")), "line_drops")
    runs.close()
    return drops


def dedup_lines(docs: DataFrame, shortest: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines that an earlier document holds. Adds n_lines (before), n_dropped and kept_text.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least
    ``shortest`` code points found in two documents or more stays only in the smallest doc_id holding it
    (there with all its lines). Documents come in ``batches`` of rising doc_id. Keys are compared by two
    independent 64-bit hashes (a false match in 10^12 lines has a chance of about 10^-15).

    * Null or empty text: one empty line. Rows keep their other columns; columns named n_lines, n_dropped or
      kept_text are replaced.
    * Rows with one doc_id are one document: they drop nothing from each other.
    * Rows without doc_id are one document that comes last.
    * A document that loses all its lines keeps an empty text. No rows: none.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = _drops(ids, batches, fanout, shortest).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("drops").alias("_drops"))
    # In one struct, columns of any name stay apart from those of this join.
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    packed = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.col("text").cast("string").alias("_x"))
    joined = packed.join(drops, F.col("_i").eqNullSafe(F.col("_d")) & (F.xxhash64("_x") == F.col("_t")), "left")
    joined = joined.withColumn("_lines", lines_of(F.col("_x")))
    lines, dropped = F.col("_lines"), F.coalesce("_drops", F.array().cast("array<int>"))
    # The kept lines are the slices between the dropped places: linear in the lines of a document.
    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    kept = F.flatten(
        F.transform(
            F.arrays_zip(F.slice(bounds, 1, F.size(dropped) + 1).alias("a"), F.slice(bounds, 2, F.size(dropped) + 1).alias("b")),
            lambda x: F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1),
        )
    )
    text = F.when(F.size(dropped) == 0, F.coalesce("_x", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "_row.*",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM d),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        marked AS (SELECT doc_id, line, place, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owned USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """
}
