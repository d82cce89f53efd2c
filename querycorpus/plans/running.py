"""Running user queries: shaping of results, template audits, and the SQL constructs they may use."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.operators import runsql as Q
from querycorpus.plans.inputs import TABLES, table, views


def reformatted_dates(spark, sf_dir):
    views(spark, sf_dir, ["orders"])
    sql = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS as_date, CAST(o_orderdate AS STRING) AS as_text, o_orderpriority,
             CASE WHEN o_orderkey > 5 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE 'unknown' END AS mixed FROM orders"""
    return Q.run_query(spark, sql, limit=0, fix_dates=True)


def service_cap(spark, sf_dir):
    """The smaller of the user's LIMIT and the cap of the service, for two reports."""
    views(spark, sf_dir, ["orders"])
    top = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {}"
    wide = Q.capped(spark, top.format(100)).withColumn("asked", F.lit(100))
    return wide.union(Q.capped(spark, top.format(5)).withColumn("asked", F.lit(5)))


def random_order(spark, sf_dir):
    """All rows come back whatever their order."""
    views(spark, sf_dir, ["customer"])
    return Q.run_query(spark, "SELECT c_custkey FROM customer", limit=-1, random_order=True, seed=3)


def companion_key(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_sk_id", F.col("p_partkey") * 2)
    shown = Q.with_companion_key(part, ["p_name", "p_size", "p_sk_id"], "name", "p_partkey")
    return Q.without_marked_columns(shown)


def template_audit(spark, sf_dir):
    """Templates over the parts, filled with types and sizes that exist, with some that do not, and with some that make one filling fail."""
    views(spark, sf_dir, ["part"])
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().union(spark.createDataFrame([("NOPE",)], "p_type string"))
    templates = [
        (1, "SELECT p_partkey FROM part WHERE p_type = '{type}'"), (2, "SELECT missing FROM part WHERE p_type = '{type}'"), (3, "DROP VIEW {type}"),
        (4, "SELECT p_partkey FROM part WHERE p_name <> 'x' AND p_size = {size} AND p_brand <> 'y'"), (5, "SELECT p_partkey FROM part WHERE p_size = '{size}'"),
    ]
    values = types.select(
        F.create_map(F.lit("type"), F.col("p_type")).alias("marks"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("template_id")
    )
    odd = spark.createDataFrame([("abc",), ("7.5",), ("99999",), ("5 +",), ("p_size",)], "size string")
    sizes = part.select(F.col("p_size").cast("string").alias("size")).distinct().union(odd)
    values = values.union(sizes.select(F.create_map(F.lit("size"), F.col("size")), F.explode(F.array(F.lit(4), F.lit(5)))))
    return Q.audit_templates(spark, templates, values).select("filled", "status")


# One query per construct; both engines run the same text.
CONSTRUCTS = {
    "select_distinct": "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 10",
    "inner_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": """SELECT n_name, count(s_suppkey) AS n FROM nation LEFT OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) AS s
        ON s_nationkey = n_nationkey GROUP BY n_name""",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "comma_join": "SELECT r_name, count(*) AS n FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey GROUP BY r_name",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "exists_subquery": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "aggregates": """SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(CAST(l_quantity AS BIGINT)) * 1.0 AS total,
        round(avg(l_discount), 6) AS mean, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""",
    "group_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20",
    "union_sets": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_sets": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "except_sets": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "comparisons": """SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_size NOT BETWEEN 10 AND 12 AND p_retailprice >= 950 AND p_retailprice < 1000
        AND p_brand <> 'Brand#1'""",
    "logical": "SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND NOT p_type = 'SMALL'",
    "like_forms": "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name ILIKE '%RING' OR (p_type NOT LIKE '%O%' AND p_size = 3)",
    "arithmetic": """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) + l_tax / 2 - 1, 4) AS net FROM lineitem""",
    "null_tests": """SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS t FROM orders) AS x
        WHERE t IS NULL UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 490000 THEN 1 END AS u FROM orders) AS y WHERE u IS NOT NULL""",
    "functions": "SELECT event_id, length(props) AS n, date_part('day', ts) AS day FROM events",
    "quantifiers": """SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part) OR EXISTS
        (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey AND s_acctbal < 0)""",
    "nesting": """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best
        FROM (SELECT * FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)) AS rich""",
    "named_query": "WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS BIGINT)) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey FROM big WHERE t > 3000000",
}


def _construct(sql):
    def run(spark, sf_dir):
        views(spark, sf_dir, [t for t in TABLES if t in sql])
        return Q.run_query(spark, sql, limit=0)

    return run


QUERIES = {f.__name__: f for f in [reformatted_dates, service_cap, random_order, companion_key, template_audit]} | {
    f"construct_{name}": _construct(sql) for name, sql in CONSTRUCTS.items()
}

_TOP = "(SELECT o_orderkey, o_totalprice, {} AS asked FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {})"
_FILL = "SELECT DISTINCT p_type AS t FROM part UNION ALL SELECT 'NOPE'"
ORACLES = {
    "reformatted_dates": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS as_date, strftime(o_orderdate, '%d/%m/%Y') AS as_text, o_orderpriority,
        CASE WHEN o_orderkey > 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS mixed FROM orders""",
    "service_cap": f"SELECT * FROM {_TOP.format(100, 60)} UNION ALL SELECT * FROM {_TOP.format(5, 5)}",
    "random_order": "SELECT c_custkey FROM customer",
    "companion_key": "SELECT p_name, p_size, p_partkey FROM part",
    "template_audit": f"""WITH f AS ({_FILL}),
        s AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS t, 'rows' AS s4, 'rows' AS s5 FROM part
              UNION ALL VALUES ('abc', 'error', 'error'), ('7.5', 'empty', 'error'), ('99999', 'empty', 'empty'), ('5 +', 'error', 'error'), ('p_size', 'rows', 'error'))
        SELECT 'SELECT p_partkey FROM part WHERE p_type = ''' || t || '''' AS filled,
               CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_type = t) THEN 'rows' ELSE 'empty' END AS status FROM f
        UNION ALL SELECT 'SELECT p_partkey FROM part WHERE p_name <> ''x'' AND p_size = ' || t || ' AND p_brand <> ''y''', s4 FROM s
        UNION ALL SELECT 'SELECT p_partkey FROM part WHERE p_size = ''' || t || '''', s5 FROM s
        UNION ALL SELECT 'SELECT missing FROM part WHERE p_type = ''' || t || '''', 'error' FROM f UNION ALL SELECT 'DROP VIEW ' || t, 'error' FROM f""",
} | {f"construct_{name}": sql for name, sql in CONSTRUCTS.items()}
