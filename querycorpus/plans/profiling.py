"""Profiling and schema text on the given tables and on catalogs derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.operators import profile as P
from querycorpus.operators import schematext as T
from querycorpus.plans.inputs import TABLES, given, table, with_inputs

STAR = ["orders", "customer", "nation", "region", "lineitem"]
RELATIONS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "benchmark", "item_id"),
]
KEYS = {
    "orders": [["o_orderkey"], ["o_custkey"]],
    "lineitem": [["l_orderkey", "l_linenumber"], ["l_orderkey"]],
    "conversations": [["conv_id", "turn"], ["conv_id"]],
    "part": [["p_partkey"], ["p_name"]],
}


def star_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every column of the star schema with type, counts, key flag and samples."""
    return P.profile_tables({t: table(spark, sf_dir, t) for t in STAR}, 3).select(
        "table_name",
        "column",
        "data_type",
        "n_rows",
        "n_null",
        "n_distinct",
        "is_key",
        F.concat_ws("|", "values").alias("samples"),
    )


def _fks(spark, sf_dir):
    return P.declared_foreign_keys(
        given(spark, sf_dir, "constraints"), given(spark, sf_dir, "key_usage"), given(spark, sf_dir, "key_targets")
    )


def _pks(spark, sf_dir):
    return P.declared_primary_keys(given(spark, sf_dir, "constraints"), given(spark, sf_dir, "key_usage"))


def column_inventory(spark, sf_dir):
    return P.inventory(P.drop_system_tables(given(spark, sf_dir, "catalog")), ["e%s"]).select(
        "db_id", "table_name", "column", "column_id"
    )


def column_types(spark, sf_dir):
    return P.normal_types(given(spark, sf_dir, "catalog")).select("db_id", "table_name", "column", "data_type")


def primary_keys(spark, sf_dir):
    flagged = P.flag_primary_keys(given(spark, sf_dir, "catalog"), _pks(spark, sf_dir))
    return flagged.select("db_id", "table_name", "column", "is_pk")


def foreign_keys(spark, sf_dir):
    listed = P.foreign_keys_per_column(_fks(spark, sf_dir))
    pairs = F.transform("foreign_keys", lambda k: F.concat(k["foreign_table"], F.lit("."), k["foreign_column"]))
    return listed.select("db_id", "table_name", "column", F.concat_ws("|", pairs).alias("targets"))


def key_columns(spark, sf_dir):
    return reduce(DataFrame.union, [P.key_check(table(spark, sf_dir, t), t, keys) for t, keys in KEYS.items()])


def foreign_key_orphans(spark, sf_dir):
    names = sorted({r[0] for r in RELATIONS} | {r[2] for r in RELATIONS})
    return P.orphan_counts({n: table(spark, sf_dir, n) for n in names}, RELATIONS)


def inferred_foreign_keys(spark, sf_dir):
    return P.infer_foreign_keys(given(spark, sf_dir, "catalog"), _fks(spark, sf_dir))


def join_map(spark, sf_dir):
    return P.join_conditions(_fks(spark, sf_dir))


def column_samples(spark, sf_dir):
    parts = [P.sample_values(P.value_counts(table(spark, sf_dir, t), t), 5) for t in ("part", "events", "supplier", "labels")]
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "column", F.concat_ws("|", "values").alias("samples"), F.size("values").alias("n_samples")
    )


def categorical_values(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    listed = P.sample_values(P.value_counts(df, "part"), 30)
    return listed.select("column", F.concat_ws("|", P.shown_values(F.col("values"), 2, 25)).alias("shown"))


def filtered_catalog(spark, sf_dir):
    catalog = given(spark, sf_dir, "catalog")
    rules = catalog.where("`column` = 'id' OR table_name = 'larges'").select(
        "table_name", F.when(F.col("table_name") == "larges", "*").otherwise(F.col("column")).alias("column")
    ).distinct()
    columns, fks = P.filter_catalog(catalog, _fks(spark, sf_dir), keep=rules)
    kept = columns.select("db_id", "table_name", "column", F.lit(None).cast("string").alias("target"))
    return kept.union(
        fks.select("db_id", "table_name", "column", F.concat("foreign_table", F.lit("."), "foreign_column"))
    )


def column_notes(spark, sf_dir):
    catalog = given(spark, sf_dir, "catalog")
    names = catalog.select(
        "db_id",
        "table_name",
        "column",
        F.when(F.col("column").contains("red"), F.concat(F.lit("colour "), "column")).otherwise(
            F.upper(F.replace("column", F.lit("_"), F.lit(" ")))
        ).alias("description"),
    )
    return P.attach_notes(catalog, names).select("db_id", "table_name", "column", "note")


def quoted_names(spark, sf_dir):
    return given(spark, sf_dir, "catalog").select(
        "db_id", "table_name", "ordinal", P.quoted(F.col("column"), "`").alias("quoted")
    )


def _samples(spark, sf_dir):
    catalog = given(spark, sf_dir, "catalog")
    letters = F.transform(F.split("column", "[ _]"), lambda w: F.concat(w, F.lit("'s ")))
    return catalog.select("db_id", "table_name", "column", F.sort_array(letters).alias("values"))


def catalog_profile(spark, sf_dir):
    nested = P.full_profile(
        given(spark, sf_dir, "catalog"), _pks(spark, sf_dir), _fks(spark, sf_dir), _samples(spark, sf_dir), "`"
    )
    line = F.transform(
        "columns",
        lambda c: F.concat_ws(
            ",",
            c["column"],
            c["data_type"],
            c["is_pk"].cast("string"),
            F.concat_ws("/", F.transform(c["foreign_keys"], lambda k: k["foreign_table"])),
            F.concat_ws("/", c["values"]),
        ),
    )
    return nested.select("db_id", "table_name", F.concat_ws(";", line).alias("profile"))


def indexed_schema(spark, sf_dir):
    """The catalog in its positional form: names in lists, columns as (table index, name)."""
    catalog = given(spark, sf_dir, "catalog")
    tables = catalog.groupBy("db_id").agg(F.sort_array(F.collect_set("table_name")).alias("table_names"))
    placed = catalog.join(tables, "db_id").withColumn("t", F.array_position("table_names", F.col("table_name")).cast("int") - 1)
    star = F.array(F.struct(F.lit(-1).alias("t"), F.lit("*").alias("name")))
    listed = placed.groupBy("db_id", "table_names").agg(
        F.sort_array(F.collect_list(F.struct("t", "ordinal", F.col("column").alias("name")))).alias("_c")
    )
    spots = F.transform("_c", lambda c: F.struct(c["t"].alias("t"), c["name"].alias("name")))
    key = F.filter(
        F.sequence(F.lit(1), F.size("_c")), lambda i: F.element_at("_c", i.cast("int"))["name"] == "promo_id"
    )
    promo = F.filter(
        F.sequence(F.lit(1), F.size("_c")),
        lambda i: (F.element_at("_c", i.cast("int"))["name"] == "id")
        & (F.element_at("_c", i.cast("int"))["t"] == F.array_position("table_names", F.lit("promos")).cast("int") - 1),
    )
    return listed.select(
        "db_id",
        "table_names",
        F.concat(star, spots).alias("column_names"),
        F.transform(key, lambda i: F.array(i, F.element_at(promo, 1))).alias("foreign_keys"),
    )


def flattened_schema(spark, sf_dir):
    indexed = indexed_schema(spark, sf_dir)
    columns = P.table_columns(P.flat_columns(indexed)).select(
        "db_id", "table_name", F.concat_ws("|", "columns").alias("text")
    )
    fks = P.flat_foreign_keys(indexed).select(
        "db_id",
        "table_name",
        F.concat("column", F.lit("="), "foreign_table", F.lit("."), "foreign_column").alias("text"),
    )
    return columns.union(fks)


def lower_schema_mapping(spark, sf_dir):
    return P.schema_mapping(indexed_schema(spark, sf_dir)).select(
        "db_id", "table_name", F.concat_ws("|", "columns").alias("columns")
    )


def kept_profiles(spark, sf_dir):
    """The stored profile of one database form, read back on the second request."""
    from querycorpus.functions.scale import scratch_path

    root = scratch_path(spark, "profiles")
    df = table(spark, sf_dir, "supplier")

    def build():
        return P.profile_table(df, "supplier", 4)

    P.kept_profile(spark, root, "star", 4, False, build)
    again = P.kept_profile(spark, root, "star", 4, False, build)
    return again.select("table_name", "column", "n_distinct", F.concat_ws("|", "values").alias("samples"))


def _described(spark, sf_dir):
    """Catalog columns with every optional part of the text forms filled for some of them."""
    flat = P.flag_primary_keys(P.normal_types(given(spark, sf_dir, "catalog")), _pks(spark, sf_dir))
    flat = flat.join(_samples(spark, sf_dir), ["db_id", "table_name", "column"], "left")
    return flat.withColumn("note", F.when(F.col("column").contains("red"), F.concat(F.lit("colour "), "column"))).withColumn(
        "table_note", F.when(F.col("table_name") == "promos", F.lit("offers"))
    )


def schema_one_line(spark, sf_dir):
    links = (
        given(spark, sf_dir, "catalog")
        .where(F.col("column").startswith("hot"))
        .select("db_id", "table_name", "column", F.array(F.lit("v1"), F.upper("column")).alias("values"))
    )
    return T.one_line(given(spark, sf_dir, "catalog"), _fks(spark, sf_dir), with_db_id=True, links=links)


def schema_compact(spark, sf_dir):
    return T.schema_text(_described(spark, sf_dir), "compact", fks=_fks(spark, sf_dir), n_values=1, threshold=1)


def schema_ddl(spark, sf_dir):
    return T.schema_text(_described(spark, sf_dir), "ddl", fks=_fks(spark, sf_dir), n_values=2)


def schema_m_schema(spark, sf_dir):
    return T.schema_text(_described(spark, sf_dir), "m-schema", fks=_fks(spark, sf_dir), n_values=2)


def value_text(spark, sf_dir):
    """Sample values of every document source as text, long ones cut."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("column"), F.col("text").alias("value"))
    counts = docs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit("documents"))
    listed = P.sample_values(counts, 3)
    return listed.select("column", T.value_sequence(F.col("values"), F.lit("STRING")).alias("text"))


def schema_inventory(spark, sf_dir):
    """Flat rows of the registered tables' own schemas beside their row counts."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    columns = P.columns_of(spark, tables, "star").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    rows = reduce(
        DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(t)) for t, df in tables.items()]
    )
    return columns.join(rows, "table_name")


QUERIES = {
    "star_profile": star_profile,
    "schema_inventory": schema_inventory,
    "column_inventory": column_inventory,
    "column_types": column_types,
    "primary_keys": primary_keys,
    "key_columns": key_columns,
    "foreign_keys": foreign_keys,
    "foreign_key_orphans": foreign_key_orphans,
    "inferred_foreign_keys": inferred_foreign_keys,
    "join_map": join_map,
    "column_samples": column_samples,
    "categorical_values": categorical_values,
    "filtered_catalog": filtered_catalog,
    "column_notes": column_notes,
    "quoted_names": quoted_names,
    "catalog_profile": catalog_profile,
    "kept_profiles": kept_profiles,
    "flattened_schema": flattened_schema,
    "lower_schema_mapping": lower_schema_mapping,
    "schema_one_line": schema_one_line,
    "schema_compact": schema_compact,
    "schema_ddl": schema_ddl,
    "schema_m_schema": schema_m_schema,
    "value_text": value_text,
}

COLUMNS = {
    "orders": "o_orderkey:BIGINT o_custkey:BIGINT o_orderstatus:STRING o_totalprice:DOUBLE o_orderdate:TIMESTAMP_NTZ o_orderpriority:STRING",
    "customer": "c_custkey:BIGINT c_name:STRING c_nationkey:INT c_acctbal:DOUBLE c_mktsegment:STRING",
    "nation": "n_nationkey:INT n_name:STRING n_regionkey:INT",
    "region": "r_regionkey:INT r_name:STRING",
    "lineitem": "l_orderkey:BIGINT l_partkey:BIGINT l_suppkey:BIGINT l_linenumber:INT l_quantity:DOUBLE l_extendedprice:DOUBLE"
    " l_discount:DOUBLE l_tax:DOUBLE l_returnflag:STRING l_linestatus:STRING l_shipdate:TIMESTAMP_NTZ",
    "supplier": "s_suppkey:BIGINT s_name:STRING s_nationkey:INT s_acctbal:DOUBLE",
    "part": "p_partkey:BIGINT p_name:STRING p_brand:STRING p_type:STRING p_size:INT p_retailprice:DOUBLE",
    "events": "event_id:BIGINT ts:TIMESTAMP_NTZ user_id:BIGINT event_type:STRING value:DOUBLE props:STRING",
    "labels": "doc_id:BIGINT quality:INT toxic:INT",
}


def _columns(t):
    return [c.split(":") for c in COLUMNS[t].split()]


def _text(c, kind):
    return f"CAST({c} AS VARCHAR)"


def _samples_sql(t, c, kind, n):
    v = _text(c, kind)
    return f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {v} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT {n}))"


STAR_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{k}' AS data_type, count(*) AS n_rows,"
    f" count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct,"
    f" count(DISTINCT {c}) = count(*) AS is_key, {_samples_sql(t, c, k, 3)} AS samples FROM {t}"
    for t in STAR
    for c, k in _columns(t)
)

FKS = """fks AS (
  SELECT DISTINCT db_id, table_name, column_name, CASE WHEN column_name = 'promo_id' THEN 'promos' ELSE 'larges' END AS foreign_table,
         'id' AS foreign_column
  FROM catalog WHERE column_name IN ('promo_id', 'Large_Id'))"""

DESCRIBED = """described AS (
  SELECT db_id, table_name, column_name, ordinal,
         upper(replace(data_type, 'character varying', 'varchar')) AS data_type,
         column_name = 'id' AS is_pk,
         CASE WHEN column_name LIKE '%red%' THEN 'colour ' || column_name END AS note,
         CASE WHEN table_name = 'promos' THEN 'offers' END AS table_note,
         list_sort(list_transform(string_split_regex(column_name, '[ _]'), lambda w: w || '''s ')) AS vals
  FROM catalog)"""


def _vals(values, sep):
    """Values of text columns in double quotes (each holds a single quote), numbers bare."""
    return (
        f"array_to_string(list_transform({values}, lambda v: CASE WHEN data_type = 'INT' THEN v ELSE '\"' || v || '\"' END), '{sep}')"
    )


ORACLES = {
    "star_profile": STAR_SQL,
    "schema_inventory": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, count(*) AS n_rows FROM {t}" for t in TABLES
    ),
    "column_inventory": with_inputs(
        ["catalog"],
        """SELECT db_id, table_name, column_name AS "column",
                  row_number() OVER (PARTITION BY db_id ORDER BY table_name, ordinal) - 1 AS column_id
           FROM catalog WHERE table_name NOT LIKE 'sqlite%' AND table_name <> 'economys'""",
    ),
    "column_types": with_inputs(
        ["catalog"],
        """SELECT db_id, table_name, column_name AS "column",
                  CASE WHEN column_name LIKE '%d%' THEN 'VARCHAR(' || length(column_name) || ')' ELSE 'INT' END AS data_type
           FROM catalog""",
    ),
    "primary_keys": with_inputs(
        ["catalog"], "SELECT db_id, table_name, column_name AS \"column\", column_name = 'id' AS is_pk FROM catalog"
    ),
    "key_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{','.join(k)}' AS columns, count(*) AS n_rows, count(*) AS n_non_null,"
        f" count(DISTINCT ({', '.join(k)})) AS n_distinct, count(DISTINCT ({', '.join(k)})) = count(*) AS is_key FROM {t}"
        for t, keys in KEYS.items()
        for k in keys
    ),
    "foreign_keys": with_inputs(
        ["catalog"],
        f"""WITH {FKS} SELECT db_id, table_name, column_name AS "column", foreign_table || '.id' AS targets FROM fks""",
    ),
    "foreign_key_orphans": " UNION ALL ".join(
        f"SELECT '{c}.{cc} = {p}.{pc}' AS relation, count(*) AS orphans FROM {c} WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p})"
        for c, cc, p, pc in RELATIONS
    ),
    "inferred_foreign_keys": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, named AS (
              SELECT *, replace(lower(CASE WHEN column_name LIKE '%s' THEN column_name[:-2] ELSE column_name END), '_', '') AS own,
                     replace(lower((CASE WHEN table_name LIKE '%s' THEN table_name[:-2] ELSE table_name END) || '_' ||
                       (CASE WHEN column_name LIKE '%s' THEN column_name[:-2] ELSE column_name END)), '_', '') AS whole
              FROM catalog),
            last AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY db_id, whole ORDER BY table_name DESC, ordinal DESC) = 1)
            SELECT n.db_id, n.table_name, n.column_name AS "column", l.table_name AS foreign_table, l.column_name AS foreign_column
            FROM named n JOIN last l ON n.db_id = l.db_id AND n.own = l.whole
            WHERE NOT EXISTS (SELECT 1 FROM fks f WHERE f.db_id = n.db_id AND f.table_name = n.table_name
              AND f.column_name = n.column_name AND f.foreign_table = l.table_name AND f.foreign_column = l.column_name)""",
    ),
    "join_map": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, both_ways AS (
              SELECT db_id, table_name AS a, foreign_table AS b, table_name || '.' || column_name || '=' || foreign_table || '.id' AS c FROM fks
              UNION SELECT db_id, foreign_table, table_name, table_name || '.' || column_name || '=' || foreign_table || '.id' FROM fks)
            SELECT db_id, a AS table_name, b AS other_table, string_agg(c, ' AND ' ORDER BY c) AS condition FROM both_ways GROUP BY ALL""",
    ),
    "column_samples": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", {_samples_sql(t, c, k, 5)} AS samples,"
        f" CAST(least(5, count(DISTINCT {c})) AS INT) AS n_samples FROM {t}"
        for t in ("part", "events", "supplier", "labels")
        for c, k in _columns(t)
    ),
    "categorical_values": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN (SELECT count(DISTINCT {c}) FROM part) <= 25 THEN {_samples_sql('part', c, k, 30)}"
        f" ELSE {_samples_sql('part', c, k, 2)} END AS shown"
        for c, k in _columns("part")
    ),
    "filtered_catalog": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, kept AS (SELECT * FROM catalog WHERE table_name = 'larges' OR column_name = 'id')
            SELECT db_id, table_name, column_name AS "column", CAST(NULL AS VARCHAR) AS target FROM kept
            UNION ALL SELECT db_id, table_name, column_name, foreign_table || '.id' FROM fks
            WHERE table_name = 'larges' AND (db_id, foreign_table) IN (SELECT (db_id, table_name) FROM kept WHERE column_name = 'id')""",
    ),
    "column_notes": with_inputs(
        ["catalog"],
        """SELECT db_id, table_name, column_name AS "column",
                  CASE WHEN column_name LIKE '%red%' THEN 'colour ' || column_name END AS note FROM catalog""",
    ),
    "quoted_names": with_inputs(
        ["catalog"],
        """SELECT db_id, table_name, ordinal, CASE WHEN column_name LIKE '% %' THEN '`' || column_name || '`' ELSE column_name END AS quoted
           FROM catalog""",
    ),
    "catalog_profile": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, {DESCRIBED}
            SELECT d.db_id, d.table_name, string_agg(
                     concat_ws(',', CASE WHEN d.column_name LIKE '% %' THEN '`' || d.column_name || '`' ELSE d.column_name END,
                               d.data_type, CAST(is_pk AS VARCHAR), coalesce(foreign_table, ''), array_to_string(vals, '/')), ';' ORDER BY ordinal) AS profile
            FROM described d LEFT JOIN fks f ON d.db_id = f.db_id AND d.table_name = f.table_name AND d.column_name = f.column_name
            WHERE d.table_name NOT LIKE 'sqlite%' GROUP BY ALL""",
    ),
    "kept_profiles": " UNION ALL ".join(
        f"SELECT 'supplier' AS table_name, '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, {_samples_sql('supplier', c, k, 4)} AS samples FROM supplier"
        for c, k in _columns("supplier")
    ),
    "flattened_schema": with_inputs(
        ["catalog"],
        """SELECT db_id, table_name, string_agg(column_name, '|' ORDER BY ordinal) AS text FROM catalog GROUP BY ALL
           UNION ALL SELECT db_id, table_name, 'promo_id=promos.id' FROM catalog WHERE column_name = 'promo_id'""",
    ),
    "lower_schema_mapping": with_inputs(
        ["catalog"],
        "SELECT db_id, table_name, string_agg(lower(column_name), '|' ORDER BY ordinal) AS columns FROM catalog GROUP BY ALL",
    ),
    "schema_one_line": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, t AS (
              SELECT db_id, table_name || ' : ' || string_agg(CASE WHEN column_name LIKE 'hot%' THEN column_name || ' (v1, ' || upper(column_name) || ')'
                ELSE column_name END, ' , ' ORDER BY ordinal) AS txt, table_name FROM catalog GROUP BY db_id, table_name),
            f AS (SELECT db_id, string_agg(table_name || '.' || column_name || ' = ' || foreign_table || '.id', ' , ' ORDER BY table_name, column_name) AS k
                  FROM fks GROUP BY db_id)
            SELECT t.db_id, t.db_id || ' | ' || string_agg(txt, ' | ' ORDER BY table_name) || coalesce(' | ' || any_value(k), '') AS schema_text
            FROM t LEFT JOIN f USING (db_id) GROUP BY t.db_id""",
    ),
    "schema_compact": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, {DESCRIBED}, t AS (
              SELECT db_id, table_name, 'table ' || table_name || coalesce(' ( comment : ' || any_value(table_note) || ' )', '') || ' , columns = [ ' ||
                string_agg(table_name || '.' || column_name || ' ( ' || concat_ws(' | ', data_type, CASE WHEN is_pk THEN 'primary key' END,
                  'comment : ' || note, 'values : ' || {_vals("CASE WHEN len(vals) > 1 THEN vals[1:1] ELSE vals END", " , ")}) || ' )', ' , ' ORDER BY ordinal) || ' ]' AS txt
              FROM described GROUP BY db_id, table_name),
            f AS (SELECT db_id, string_agg(table_name || '.' || column_name || ' = ' || foreign_table || '.id', chr(10) ORDER BY table_name, column_name) AS k
                  FROM fks GROUP BY db_id)
            SELECT t.db_id, string_agg(txt, chr(10) ORDER BY table_name) || coalesce(chr(10) || 'foreign keys :' || chr(10) || any_value(k), '') AS schema_text
            FROM t LEFT JOIN f USING (db_id) GROUP BY t.db_id""",
    ),
    "schema_ddl": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, {DESCRIBED}, t AS (
              SELECT db_id, table_name, 'CREATE TABLE ' || table_name || ' (' || coalesce(' -- ' || any_value(table_note), '') || chr(10) ||
                string_agg(chr(9) || column_name || ' ' || data_type || CASE WHEN is_pk THEN ' primary key' ELSE '' END || ', -- ' ||
                  concat_ws(', ', 'comment : ' || note, 'values : ' || {_vals("vals[1:2]", " , ")}), chr(10) ORDER BY ordinal) || chr(10) || ');' AS txt
              FROM described GROUP BY db_id, table_name),
            f AS (SELECT db_id, string_agg('-- ' || table_name || '.' || column_name || ' = ' || foreign_table || '.id', chr(10) ORDER BY table_name, column_name) AS k
                  FROM fks GROUP BY db_id)
            SELECT t.db_id, string_agg(txt, chr(10) || chr(10) ORDER BY table_name) || coalesce(chr(10) || chr(10) ||
              '-- Also take into account the following foreign keys :' || chr(10) || any_value(k), '') AS schema_text
            FROM t LEFT JOIN f USING (db_id) GROUP BY t.db_id""",
    ),
    "schema_m_schema": with_inputs(
        ["catalog"],
        f"""WITH {FKS}, {DESCRIBED}, t AS (
              SELECT db_id, table_name, '# Table: ' || table_name || coalesce(', ' || any_value(table_note), '') || chr(10) || '[' || chr(10) ||
                string_agg('(' || column_name || ':' || regexp_replace(data_type, '\\(.*', '') || coalesce(', ' || note, '') ||
                  CASE WHEN is_pk THEN ', Primary Key' ELSE '' END || ', Examples: [' || {_vals("vals[1:2]", ", ")} || '])', ',' || chr(10) ORDER BY ordinal)
                || chr(10) || ']' AS txt
              FROM described GROUP BY db_id, table_name),
            f AS (SELECT db_id, string_agg(table_name || '.' || column_name || '=' || foreign_table || '.id', chr(10) ORDER BY table_name, column_name) AS k
                  FROM fks GROUP BY db_id)
            SELECT t.db_id, '【DB_ID】 ' || t.db_id || chr(10) || '【Schema】' || chr(10) || string_agg(txt, chr(10) ORDER BY table_name) ||
              coalesce(chr(10) || '【Foreign keys】' || chr(10) || any_value(k), '') AS schema_text
            FROM t LEFT JOIN f USING (db_id) GROUP BY t.db_id""",
    ),
    "value_text": """
        WITH v AS (SELECT DISTINCT source || '/' || lang AS c, text FROM documents),
        r AS (SELECT c, text, row_number() OVER (PARTITION BY c ORDER BY text) AS k FROM v),
        s AS (SELECT c, k, CASE WHEN length(text) > 30 THEN text[:30] || '...' ELSE text END AS t FROM r WHERE k <= 3),
        e AS (SELECT c, k, replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS x,
                     CASE WHEN contains(t, chr(39)) AND NOT contains(t, chr(34)) THEN chr(34) ELSE chr(39) END AS q FROM s)
        SELECT c AS "column", 'values : ' || string_agg(q || CASE WHEN q = chr(39) THEN replace(x, chr(39), chr(92) || chr(39)) ELSE x END || q, ' , ' ORDER BY k) AS text
        FROM e GROUP BY c""",
}
