"""Operator inputs that Spark derives from the given tables.

The reference operators work on catalogs and query logs; here these are generated from the
rows of the given tables, so they grow with them. Each input is one SQL text that both Spark
and DuckDB run; the oracles take it as their starting point and derive the result on their own.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

INPUTS = {
    # One database per 400 parts; tables by part type; columns by part name, an id and references.
    "catalog_names": """
        SELECT DISTINCT 'db' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING) AS db_id,
               CASE WHEN p_size = 50 THEN 'sqlite_' || lower(p_type) ELSE lower(p_type) || 's' END AS table_name,
               replace(p_name, ' ', CASE WHEN p_size < 5 THEN ' ' ELSE '_' END) AS column_name
        FROM part
        UNION
        SELECT DISTINCT 'db' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING), lower(p_type) || 's', 'id'
        FROM part
        UNION
        SELECT DISTINCT 'db' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING), lower(p_type) || 's',
               CASE WHEN p_size < 10 THEN 'promo_id' WHEN p_size < 20 THEN 'Large_Id' ELSE 'medium_ids' END
        FROM part
    """,
    "catalog": """
        SELECT db_id, table_name, column_name,
               CAST(row_number() OVER (PARTITION BY db_id, table_name ORDER BY column_name) - 1 AS INT) AS ordinal,
               CASE WHEN column_name LIKE '%d%' THEN 'character varying(' || CAST(length(column_name) AS STRING) || ')'
                    ELSE 'int' END AS data_type
        FROM catalog_names
    """,
    "constraints": """
        SELECT db_id, 'public' AS table_schema, table_name, table_name || '_' || column_name AS constraint_name,
               CASE WHEN column_name = 'id' THEN 'PRIMARY KEY'
                    WHEN position('_id' IN lower(column_name)) > 0 THEN 'FOREIGN KEY' ELSE 'CHECK' END AS constraint_type
        FROM catalog
    """,
    "key_usage": """
        SELECT db_id, 'public' AS table_schema, table_name, table_name || '_' || column_name AS constraint_name,
               column_name, 1 AS position
        FROM catalog
    """,
    "key_targets": """
        SELECT db_id, 'public' AS table_schema, table_name || '_' || column_name AS constraint_name, 1 AS position,
               CASE WHEN column_name = 'promo_id' THEN 'promos' WHEN column_name = 'Large_Id' THEN 'larges' END AS foreign_table,
               'id' AS foreign_column
        FROM catalog
        WHERE position('_id' IN lower(column_name)) > 0
    """,
}

# Query texts by template number; ~ stands for a single quote.
TEMPLATES = [
    "SELECT p_name FROM part WHERE p_size = {size}",
    "SELECT DISTINCT p.p_name AS name, count(*) FROM part AS p JOIN lineitem AS l ON p.p_partkey = l.l_partkey"
    " WHERE p.p_brand = ~{brand}~ AND l.l_quantity > {size} GROUP BY p.p_name HAVING count(*) > 2"
    " ORDER BY count(*) DESC, p.p_name LIMIT {size}",
    "SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity BETWEEN 1 AND {size})"
    " OR p_name LIKE ~%{name}%~",
    "SELECT n_name FROM nation UNION SELECT r_name FROM region WHERE r_name IS NOT NULL",
    "SELECT * FROM part, supplier WHERE p_size NOT IN ({size}, 7) AND NOT s_acctbal < 10",
    "SELECT max(p_retailprice) - min(p_retailprice) AS spread FROM part WHERE p_name = ~FROM {name}~ ORDER BY spread",
    "this is no query about {name}",
    "SELECT s.s_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE EXISTS (SELECT l_suppkey"
    " FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity > (SELECT avg(l_quantity) FROM lineitem))"
    " AND n.n_name NOT LIKE ~NATION_{size}~",
    "WITH big AS (SELECT p_partkey, p_name FROM part WHERE p_size >= {size}) SELECT big.p_name FROM big ORDER BY big.p_name LIMIT 5",
    "SELECT p_nam FROM parts WHERE p_sizes = {size}",
    "select p_brand, sum(p_size) from part group by p_brand order by p_brand asc",
    "SELECT p_type label, CASE WHEN p_size > {size} THEN ~big~ ELSE ~small~ END AS kind, p_retailprice::int FROM part /* FROM nation */"
    " WHERE p_retailprice > 15e2",
    "SELECT EXTRACT(YEAR FROM l_shipdate) AS y, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS total FROM lineitem"
    " WHERE l_quantity > -1",
    "(SELECT n_name FROM nation WHERE n_name <> ~{name}~ ORDER BY n_name LIMIT 3) UNION (SELECT r_name FROM region)",
]
_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES))
INPUTS["query_log"] = f"""
        SELECT p_partkey AS query_id, 'star' AS db_id, CAST(p_partkey % {len(TEMPLATES)} AS INT) AS template,
               replace(replace(replace(replace(CASE p_partkey % {len(TEMPLATES)} {_CASES} END,
                 '{{name}}', p_name), '{{brand}}', p_brand), '{{size}}', CAST(p_size AS STRING)), '~', chr(39)) AS sql
        FROM part
    """

# One question per part with its name misspelt, possessive, capital or plural.
INPUTS["questions"] = """
        SELECT p_partkey AS question_id,
               'Show the ' || CASE p_size % 4 WHEN 0 THEN replace(p_name, 'i', '') WHEN 1 THEN p_name || chr(39) || 's'
                 WHEN 2 THEN upper(p_name) ELSE p_name || 's' END || ' parts of ' || p_brand || ' in ' || p_type || '?' AS question
        FROM part
    """
INPUTS["stored_values"] = """
        SELECT DISTINCT 'part' AS table_name, 'p_name' AS column_name, p_name AS value FROM part
        UNION ALL SELECT DISTINCT 'part', 'p_label', p_name FROM part
        UNION ALL SELECT DISTINCT 'part', 'p_brand', p_brand FROM part
        UNION ALL SELECT DISTINCT 'part', 'p_type', p_type FROM part
        UNION ALL SELECT DISTINCT 'nation', 'n_code', n_name FROM nation
    """
INPUTS["sql_pairs"] = """
        SELECT query_id AS pair_id, template, sql AS prediction,
               CASE template WHEN 0 THEN sql || ' ORDER BY p_name DESC LIMIT 3' WHEN 2 THEN replace(sql, ' OR ', ' AND ') ELSE sql END AS target
        FROM query_log
    """

# What each input reads: given tables or other inputs.
NEEDS = {
    "query_log": ["part"],
    "questions": ["part"],
    "stored_values": ["part", "nation"],
    "sql_pairs": ["query_log"],
    "catalog_names": ["part"],
    "catalog": ["catalog_names"],
    "constraints": ["catalog"],
    "key_usage": ["catalog"],
    "key_targets": ["catalog"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def views(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _chain(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for needed in [*_chain(NEEDS.get(name, [])), name]:
            if needed not in found:
                found.append(needed)
    return found


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; ``column_name`` is called ``column`` in the operators."""
    for needed in _chain([name]):
        if needed in TABLES:
            views(spark, sf_dir, [needed])
        else:
            spark.sql(INPUTS[needed]).createOrReplaceTempView(needed)
    df = spark.table(name)
    return df.withColumnRenamed("column_name", "column")


def with_inputs(names: list[str], body: str) -> str:
    """DuckDB text: the derived inputs as named queries in front of ``body``."""
    named = ", ".join(f"{n} AS ({INPUTS[n]})" for n in _chain(names) if n in INPUTS)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {named}, {body[5:]}"
    return f"WITH {named} {body}"
