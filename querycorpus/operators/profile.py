"""Profile databases: columns, types, keys, inferred joins, sample values.

The catalog is kept flat: ``columns(db_id, table_name, ordinal, column, data_type, ...)``
and ``fks(db_id, table_name, column, foreign_table, foreign_column)``. Rows are nested per
table only on output, where a list is as long as a table is wide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage, global_position, top_k
from querycorpus.functions.text import simple_name, without_last_s
from querycorpus.sources.sinks import read_if_complete

# Names that mark system tables, and the characters a bare name may hold.
SYSTEM_TABLE_MARKS = ["pg_stat_", "sqlite_"]
BARE_NAME = "^[A-Za-z0-9_]*$"

COLUMN_KEY = ["db_id", "table_name", "column"]


# --- inventory, types, system tables ---------------------------------------------------


def columns_of(spark: SparkSession, tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """Flat column rows of registered tables, from their schemas alone."""
    rows = [
        (db_id, name, i, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema)
    ]
    return spark.createDataFrame(
        rows, "db_id string, table_name string, ordinal int, column string, data_type string"
    )


def drop_system_tables(columns: DataFrame) -> DataFrame:
    name = F.col("table_name")
    return columns.where(~reduce(lambda a, b: a | b, [name.contains(m) for m in SYSTEM_TABLE_MARKS]))


def inventory(columns: DataFrame, exclude_tables: list[str] = ()) -> DataFrame:
    """Columns with a running ``column_id`` per database, minus tables matching LIKE patterns.

    The id comes from a range partitioning, so one huge catalog is not numbered by one task.
    """
    kept = columns
    for pattern in exclude_tables:
        kept = kept.where(~F.col("table_name").like(pattern))
    order = [F.col("table_name"), F.col("ordinal"), F.col("column")]
    return global_position(kept, ["db_id"], order, "column_id")


def normal_types(columns: DataFrame) -> DataFrame:
    """Upper-case type names, ``character varying`` shortened."""
    short = F.regexp_replace(F.lower("data_type"), "character varying", "varchar")
    return columns.withColumn("data_type", F.upper(short))


# --- keys -----------------------------------------------------------------------------


def declared_primary_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Key columns from constraint rows joined to their column usage."""
    keys = constraints.where(F.col("constraint_type") == "PRIMARY KEY")
    on = ["db_id", "table_schema", "table_name", "constraint_name"]
    return keys.join(usage, on).select(*COLUMN_KEY).distinct()


def flag_primary_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    flagged = keys.select(*COLUMN_KEY, F.lit(True).alias("_pk"))
    return (
        columns.join(flagged, COLUMN_KEY, "left")
        .withColumn("is_pk", F.coalesce("_pk", F.lit(False)))
        .drop("_pk")
    )


def declared_foreign_keys(constraints: DataFrame, usage: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per key column and its target; the columns of a composite key pair by position.

    ``usage`` and ``targets`` carry ``position``. Rows with a missing name are dropped.
    """
    keys = constraints.where(F.col("constraint_type") == "FOREIGN KEY")
    on = ["db_id", "table_schema", "table_name", "constraint_name"]
    return (
        keys.join(usage, on)
        .join(targets, ["db_id", "table_schema", "constraint_name", "position"])
        .select(*COLUMN_KEY, "foreign_table", "foreign_column")
        .dropna()
        .distinct()
    )


def foreign_keys_per_column(fks: DataFrame) -> DataFrame:
    target = F.struct("foreign_table", "foreign_column")
    return fks.groupBy(*COLUMN_KEY).agg(F.sort_array(F.collect_set(target)).alias("foreign_keys"))


def infer_foreign_keys(columns: DataFrame, fks: DataFrame | None = None) -> DataFrame:
    """Columns whose simple name equals simple(table) + simple(column) of some column.

    Of several candidates with one name the last in catalog order wins; pairs declared
    already are left out.
    """
    named = columns.select(
        *COLUMN_KEY,
        "ordinal",
        simple_name(F.col("column")).alias("_own"),
        simple_name(F.concat_ws("_", without_last_s(F.col("table_name")), "column")).alias("_full"),
    )
    last = F.max_by(F.struct("table_name", "column"), F.struct("table_name", "ordinal", "column"))
    targets = (
        named.groupBy("db_id", "_full")
        .agg(last.alias("_t"))
        .select(
            "db_id",
            F.col("_full").alias("_own"),
            F.col("_t.table_name").alias("foreign_table"),
            F.col("_t.column").alias("foreign_column"),
        )
    )
    found = named.join(targets, ["db_id", "_own"]).select(*COLUMN_KEY, "foreign_table", "foreign_column")
    if fks is not None:
        found = found.join(fks, found.columns, "left_anti")
    return found


def join_conditions(fks: DataFrame) -> DataFrame:
    """Conditions between two tables, in both directions, joined by AND."""
    condition = F.concat(
        "table_name", F.lit("."), "column", F.lit("="), "foreign_table", F.lit("."), "foreign_column"
    )
    pairs = fks.select("db_id", F.col("table_name").alias("a"), F.col("foreign_table").alias("b"), condition.alias("c"))
    both = pairs.select("db_id", "a", "b", "c").union(pairs.select("db_id", "b", "a", "c"))
    return (
        both.groupBy("db_id", "a", "b")
        .agg(F.concat_ws(" AND ", F.sort_array(F.collect_set("c"))).alias("condition"))
        .select("db_id", F.col("a").alias("table_name"), F.col("b").alias("other_table"), "condition")
    )


# --- keys checked on data --------------------------------------------------------------


def key_check(df: DataFrame, table_name: str, keys: list[list[str]]) -> DataFrame:
    """Per column set: rows, rows without null, distinct values, and whether it acts as a key."""
    frames = []
    for cols in keys:
        counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        frames.append(
            counted.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
                F.coalesce(F.sum(F.when(whole, F.col("_n"))), F.lit(0)).cast("long").alias("n_non_null"),
                F.count(F.when(whole, True)).alias("n_distinct"),
            ).select(
                F.lit(table_name).alias("table_name"),
                F.lit(",".join(cols)).alias("columns"),
                "n_rows",
                "n_non_null",
                "n_distinct",
                ((F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0)).alias("is_key"),
            )
        )
    return reduce(DataFrame.union, frames)


def orphan_counts(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows of a child table whose key value is missing in the parent, per relation.

    Child rows are counted per key value before the join, so a hot value crosses it once.
    """
    frames = []
    for child, column, parent, target in relations:
        values = (
            tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        )
        parents = tables[parent].select(F.col(target).alias("_v")).distinct()
        frames.append(
            values.join(parents, "_v", "left_anti")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("orphans"))
            .select(F.lit(f"{child}.{column} = {parent}.{target}").alias("relation"), "orphans")
        )
    return reduce(DataFrame.union, frames)


# --- values ---------------------------------------------------------------------------


def long_values(df: DataFrame, table_name: str, columns: list[str] | None = None) -> DataFrame:
    """A table as rows ``table_name, column, value``, nested columns left out."""
    cols = columns or [f.name for f in df.schema if f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct")]
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return texts.select(F.lit(table_name).alias("table_name"), "column", "value")


def value_counts(df: DataFrame, table_name: str, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column with their counts, in one pass over the table.

    Counting happens before the shuffle, so a value that fills a column travels once per task.
    """
    long = long_values(df, table_name, columns)
    return long.groupBy("table_name", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def sample_values(counts: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` smallest distinct non-null values per column, as an ordered list."""
    first = top_k(counts.where("value is not null"), ["table_name", "column"], [F.col("value")], n)
    return first.groupBy("table_name", "column").agg(F.sort_array(F.collect_list("value")).alias("values"))


def column_statistics(counts: DataFrame) -> DataFrame:
    return counts.groupBy("table_name", "column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        (F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)) == 1).alias("_single"),
    ).withColumn("is_key", F.col("_single") & (F.col("n_null") == 0)).drop("_single")


def shown_values(values: Column, n: int, threshold: int | None = None) -> Column:
    """All values of a categorical column, else the first ``n``. No threshold means no column is."""
    first = F.slice(values, 1, n) if n > 0 else F.array().cast("array<string>")
    return first if threshold is None else F.when(F.size(values) <= threshold, values).otherwise(first)


def profile_tables(tables: dict[str, DataFrame], n_values: int = 20) -> DataFrame:
    """Type, distinct and null counts, key flag and samples for every column of the tables.

    The columns of all tables are counted in one grouping, written once and read by both parts: one scan per table.
    """
    long = reduce(DataFrame.union, [long_values(df, name) for name, df in tables.items()])
    counts = cut_lineage(long.groupBy("table_name", "column", "value").agg(F.count(F.lit(1)).alias("n")))
    spark = next(iter(tables.values())).sparkSession
    types = [(t, f.name, f.dataType.simpleString().upper()) for t, df in tables.items() for f in df.schema]
    types = spark.createDataFrame(types, "table_name string, column string, data_type string")
    key = ["table_name", "column"]
    # As many rows as the schemas have columns.
    return column_statistics(counts).join(sample_values(counts, n_values), key, "left").join(F.broadcast(types), key)


def profile_table(df: DataFrame, table_name: str, n_values: int = 20) -> DataFrame:
    return profile_tables({table_name: df}, n_values)


# --- editing a catalog -----------------------------------------------------------------


def filter_catalog(
    columns: DataFrame, fks: DataFrame, keep: DataFrame | None = None, exclude: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep or exclude columns by rules ``(table_name, column)``; ``*`` stands for a whole table.

    Foreign keys with an end that was removed go too. Fails on unknown names, and unless
    exactly one rule set is given.
    """
    if (keep is None) == (exclude is None):
        raise ValueError("give either keep or exclude rules")
    rules = keep if keep is not None else exclude
    whole = rules.where(F.col("column") == "*").select("table_name").distinct()
    single = rules.where(F.col("column") != "*").select("table_name", "column").distinct()
    unknown = single.join(columns, ["table_name", "column"], "left_anti").unionByName(
        whole.join(columns, "table_name", "left_anti").withColumn("column", F.lit("*"))
    )
    wrong = unknown.limit(5).collect()
    if wrong:
        raise ValueError("unknown names: " + ", ".join(f"{r['table_name']}.{r['column']}" for r in wrong))
    if keep is not None:
        by_table = columns.join(whole, "table_name", "left_semi")
        by_name = columns.join(whole, "table_name", "left_anti").join(single, ["table_name", "column"], "left_semi")
        left = by_table.unionByName(by_name)
    else:
        left = columns.join(whole, "table_name", "left_anti").join(single, ["table_name", "column"], "left_anti")
    ends = left.select(*COLUMN_KEY)
    targets = ends.toDF("db_id", "foreign_table", "foreign_column")
    kept_fks = fks.join(ends, COLUMN_KEY, "left_semi").join(targets, targets.columns, "left_semi")
    return left, kept_fks


def attach_notes(columns: DataFrame, names: DataFrame, style: str = "space") -> DataFrame:
    """Add a descriptive name as ``note`` where it really differs from the stored one.

    ``space`` compares with underscores as spaces, ``none`` without underscores and spaces.
    """
    def plain(c: Column) -> Column:
        return F.translate(F.lower(c), "_", " ") if style == "space" else F.translate(F.lower(c), "_ ", "")

    described = columns.join(names.select(*COLUMN_KEY, "description"), COLUMN_KEY, "left")
    differs = plain(F.col("column")) != plain(F.col("description"))
    return described.withColumn("note", F.when(differs, F.col("description"))).drop("description")


def quoted(name: Column, mark: str = '"') -> Column:
    """Quote a name that holds anything but letters, digits and underscores."""
    return F.when(~name.rlike(BARE_NAME), F.concat(F.lit(mark), name, F.lit(mark))).otherwise(name)


# --- forms ----------------------------------------------------------------------------


def full_profile(columns: DataFrame, keys: DataFrame, fks: DataFrame, samples: DataFrame, quote: str = '"') -> DataFrame:
    """One nested row per table: typed, keyed, sampled columns with quoted names."""
    flat = flag_primary_keys(normal_types(drop_system_tables(columns)), keys)
    flat = flat.join(foreign_keys_per_column(fks), COLUMN_KEY, "left").join(samples, COLUMN_KEY, "left")
    entry = F.struct(
        "ordinal",
        quoted(F.col("column"), quote).alias("column"),
        "data_type",
        "is_pk",
        F.coalesce("foreign_keys", F.array().cast("array<struct<foreign_table:string,foreign_column:string>>")).alias("foreign_keys"),
        F.coalesce("values", F.array().cast("array<string>")).alias("values"),
    )
    return (
        flat.groupBy("db_id", "table_name")
        .agg(F.sort_array(F.collect_list(entry)).alias("columns"))
        .withColumn("table_name", quoted(F.col("table_name"), quote))
    )


def kept_profile(spark: SparkSession, root: str, db_id: str, n_values: int, infer: bool, build) -> DataFrame:
    """A profile stored once per (database, sample size, inference flag)."""
    path = f"{root}/db_id={db_id}/n_values={n_values}/infer={str(infer).lower()}"
    kept = read_if_complete(spark, path)
    if kept is None:
        build().write.mode("overwrite").parquet(path)
        kept = read_if_complete(spark, path)
    return kept


def flat_columns(indexed: DataFrame) -> DataFrame:
    """Indexed schemas (table names, [table index, column name] pairs) as flat column rows."""
    tables = indexed.select("db_id", "table_names", F.posexplode("column_names").alias("column_id", "_c"))
    return tables.where(F.col("_c.t") >= 0).select(
        "db_id",
        F.element_at("table_names", F.col("_c.t") + 1).alias("table_name"),
        F.col("column_id").alias("ordinal"),
        F.col("_c.name").alias("column"),
    )


def flat_foreign_keys(indexed: DataFrame) -> DataFrame:
    """Foreign keys given as pairs of column positions, with the names looked up in place."""
    def end(i: int) -> tuple[Column, Column]:
        spot = F.element_at("column_names", F.element_at("_fk", i) + 1)
        return F.element_at("table_names", spot["t"] + 1), spot["name"]

    pairs = indexed.select("db_id", "table_names", "column_names", F.explode("foreign_keys").alias("_fk"))
    (t1, c1), (t2, c2) = end(1), end(2)
    return pairs.select(
        "db_id",
        t1.alias("table_name"),
        c1.alias("column"),
        t2.alias("foreign_table"),
        c2.alias("foreign_column"),
    )


def table_columns(columns: DataFrame) -> DataFrame:
    """Ordered column names per table."""
    spot = F.sort_array(F.collect_list(F.struct("ordinal", "column")))
    return columns.groupBy("db_id", "table_name").agg(spot["column"].alias("columns"))


def schema_mapping(indexed: DataFrame) -> DataFrame:
    """Lower-case column names per lower-case table, without the ``*`` entry."""
    lower = flat_columns(indexed).select(
        "db_id", F.lower("table_name").alias("table_name"), "ordinal", F.lower("column").alias("column")
    )
    return table_columns(lower)


def split_column_ids(names: DataFrame) -> DataFrame:
    """``table.column`` texts to an ordered column list per table."""
    parts = names.select(
        "db_id",
        F.substring_index("name", ".", 1).alias("table_name"),
        F.expr("substring(name, instr(name, '.') + 1)").alias("column"),
        "ordinal",
    )
    return table_columns(parts)
