"""Readers for question/SQL corpora and tables, and a registry to address them by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Reader = Callable[[SparkSession], DataFrame]


def _pool(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_json_corpus(spark: SparkSession, splits: dict[str, str], schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each, one path per split.

    Such a file cannot be cut, so a large corpus should come as several files per path.
    """
    return _pool(
        [
            spark.read.schema(schema).json(path, multiLine=True).withColumn("split", F.lit(name))
            for name, path in splits.items()
        ]
    )


def read_jsonl_corpus(spark: SparkSession, splits: dict[str, str], schema: StructType | str) -> DataFrame:
    """JSON Lines, one path per split; Spark cuts uncompressed files freely."""
    return _pool(
        [
            spark.read.schema(schema).json(path).withColumn("split", F.lit(name))
            for name, path in splits.items()
        ]
    )


def read_large_jsonl(
    spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None
) -> DataFrame:
    """Compressed JSON Lines. A gzip file is one task, so rows are spread right after the read."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_csv_tables(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with a header; ``source_file`` tells which table a row came from."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=False).withColumn(
        "source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    )


def csv_records(text: Column) -> Column:
    """Records of a CSV text; line ends inside quotes do not end a record."""
    return F.regexp_extract_all(text, F.lit(r'((?:[^"\n]++|"(?:[^"]++|"")*+")++)'), F.lit(1))


def csv_fields(record: Column) -> Column:
    """Fields of one CSV record with quotes removed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.when(
            f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        ).when(f.contains("\r"), F.regexp_replace(f, r"\r$", "")).otherwise(f),
    )


def csv_text_cells(df: DataFrame, key: str, column: str, index_columns: int = 1) -> DataFrame:
    """Cells ``(key, r, c, name, value)`` of a CSV held in a string column.

    The first record names the columns; ``index_columns`` leading fields are left out.
    Header and rows come from the same text, so the step needs no shuffle.
    """
    records = F.transform(csv_records(F.col(column)), csv_fields)
    header = F.element_at("_records", 1)
    rows = df.withColumn("_records", records).select(
        key,
        header.alias("_header"),
        F.posexplode(F.slice("_records", 2, F.greatest(F.size("_records") - 1, F.lit(0)))).alias("r", "_row"),
    )
    cells = rows.select(key, "r", "_header", F.posexplode("_row").alias("_c", "value"))
    return cells.where(F.col("_c") >= index_columns).select(
        key,
        "r",
        (F.col("_c") - index_columns).alias("c"),
        F.element_at("_header", F.col("_c") + 1).alias("name"),
        "value",
    )


class Corpora:
    """Readers by name. ``load("name")`` pools all splits, ``load("name.dev")`` keeps one."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}

    def register(self, name: str, reader: Reader) -> None:
        self._readers[name] = reader

    def names(self) -> list[str]:
        return sorted(self._readers)

    def load(self, spark: SparkSession, address: str) -> DataFrame:
        name, _, split = address.partition(".")
        if name not in self._readers:
            raise KeyError(f"unknown corpus {name!r}; known: {', '.join(self.names())}")
        rows = self._readers[name](spark)
        return rows.where(F.col("split") == split) if split else rows

    def pool(self, spark: SparkSession, addresses: list[str]) -> DataFrame:
        return _pool([self.load(spark, a).withColumn("corpus", F.lit(a)) for a in addresses])


def jdbc_table(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """A database table read by ``partitions`` parallel range queries on ``column``."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=column,
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=str(partitions),
        **options,
    )
    return reader.load()
