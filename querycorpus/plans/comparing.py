"""Result comparison on pairs of results made from the customers of every nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage, scratch_path
from querycorpus.operators import compare as C
from querycorpus.plans.inputs import table, views
from querycorpus.sources.sinks import ResultStore

# Per variant: order matters, prediction columns, target columns (SQL over customer), verdict.
VARIANTS = {
    0: (True, "k b m", "k b m", "equal"),
    1: (False, "k b m", "k b m", "equal"),
    2: (True, "k b", "k b", "different"),
    3: (False, "m k b", "k b m", "equal"),
    4: (False, "k b m", "k m", "columns_superset"),
    5: (False, "m b", "b k m", "columns_subset"),
    6: (False, "k near m", "b m k", "equal"),
    7: (False, "k far m", "k b m", "columns_intersect"),
    8: (False, "k b m", "k b m", "different"),
    9: (False, "k", "far", "different"),
    10: (False, "k m", "b", "equal"),
    11: (False, "k neg", "k other", "columns_intersect"),
    12: (False, "b b2 near", "near b b", "equal"),
    13: (True, "m near k", "k b m", "equal"),
    14: (False, "k far", "m k b", "columns_intersect"),
    15: (False, "gap m", "m gap", "equal"),
}
VALUES = {
    "k": "c_custkey",
    "b": "c_acctbal",
    "b2": "c_acctbal",
    "near": "c_acctbal * (1 + 1e-7)",
    "far": "c_acctbal + 100.5",
    "neg": "c_custkey",
    "other": "other_key",
    "gap": "CASE WHEN c_acctbal > 3000 THEN c_acctbal END",
    "m": "c_mktsegment",
}
ROW = "CAST(CASE WHEN c.v IN (0, 13) OR c.side = 'pred' THEN c_custkey ELSE -c_custkey END AS BIGINT)"


def _cells_sql() -> str:
    """All cells of one customer row over all variants, as one exploded array."""
    cells = []
    for v, (_, pred, target, _verdict) in VARIANTS.items():
        if v == 10:
            continue
        for side, names in (("pred", pred), ("target", target)):
            for i, name in enumerate(names.split()):
                number = "CAST(NULL AS DOUBLE)" if name == "m" else f"CAST({VALUES[name]} AS DOUBLE)"
                string = VALUES[name] if name == "m" else "CAST(NULL AS STRING)"
                cells.append(f"named_struct('v', {v}, 'side', '{side}', 'col_idx', {i}, 'num', {number}, 'str', {string})")
    return f"SELECT c_nationkey, c_custkey, last_key, explode(array({', '.join(cells)})) AS c FROM placed"


def result_pairs(spark, sf_dir):
    """Cells and pair rows: one pair per nation and variant, with all customers of the nation."""
    views(spark, sf_dir, ["customer"])
    # other_key: the keys of the nation, given to other customers (same values, other rows).
    spark.sql(
        """SELECT c.*, n.last_key, CASE WHEN c_custkey = n.last_key THEN n.first_key WHEN c_custkey = n.first_key THEN n.last_key
             ELSE c_custkey END AS other_key
           FROM customer c JOIN (SELECT c_nationkey AS nk, max(c_custkey) AS last_key, min(c_custkey) AS first_key FROM customer
             GROUP BY c_nationkey) n ON c.c_nationkey = n.nk"""
    ).createOrReplaceTempView("placed")
    cells = spark.sql(
        f"""SELECT CAST(c.v * 100 + c_nationkey AS BIGINT) AS pair_id, c.side, {ROW} AS row_idx, c.col_idx, c.num, c.str
            FROM ({_cells_sql()}) WHERE NOT (c.v = 8 AND c.side = 'pred' AND c_custkey = last_key)"""
    )
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    variants = F.array(
        *[
            F.struct(
                F.lit(v).alias("v"), F.lit(o).alias("order_matters"), F.lit(len(p.split())).alias("pred_cols"), F.lit(len(t.split())).alias("target_cols")
            )
            for v, (o, p, t, _) in VARIANTS.items()
        ]
    )
    rows = F.when(F.col("v") == 10, 0).otherwise(F.col("n"))
    pairs = sizes.select("*", F.inline(variants)).select(
        (F.col("v") * 100 + F.col("c_nationkey")).cast("long").alias("pair_id"),
        "order_matters",
        F.when(F.col("v") == 8, F.col("n") - 1).otherwise(rows).alias("pred_rows"),
        "pred_cols",
        rows.alias("target_rows"),
        "target_cols",
    )
    return cut_lineage(cells), pairs


def result_verdicts(spark, sf_dir):
    cells, pairs = result_pairs(spark, sf_dir)
    return C.execution_flags(C.compare_results(cells, pairs))


def loose_verdicts(spark, sf_dir):
    cells, pairs = result_pairs(spark, sf_dir)
    return C.compare_results(cells, pairs, loose=True)


def mean_scores(spark, sf_dir):
    flags = result_verdicts(spark, sf_dir).withColumn("variant", F.floor(F.col("pair_id") / 100))
    names = ["exec", "only_common", "subset", "superset"]
    return flags.rollup("variant").agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.count(F.lit(1)).alias("pairs"))


QUERY_PAIRS = [
    ("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
     "SELECT count(*), n_name FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name", "equal"),
    ("SELECT o_orderstatus, sum(o_totalprice) FROM orders GROUP BY o_orderstatus",
     "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus", "columns_superset"),
    ("SELECT p_brand FROM part GROUP BY p_brand", "SELECT p_brand, avg(p_size) FROM part GROUP BY p_brand", "columns_subset"),
    ("SELECT c_custkey FROM customer ORDER BY c_custkey DESC", "SELECT c_custkey FROM customer ORDER BY c_custkey", "different"),
    ("SELECT c_custkey FROM customer ORDER BY c_custkey DESC", "SELECT c_custkey FROM customer", "equal"),
    ("SELECT no_such FROM customer", "SELECT c_custkey FROM customer", None),
    ("DROP TABLE customer", "SELECT c_custkey FROM customer", None),
    (None, "SELECT c_custkey FROM customer", None),
    ("SELECT c_custkey, c_acctbal + 1 AS b FROM customer", "SELECT c_custkey, c_acctbal AS b FROM customer", "columns_intersect"),
    ("SELECT s_suppkey AS error FROM supplier", "SELECT s_suppkey FROM supplier", "equal"),
    ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber",
     "equal"),
    ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber",
     "different"),
]


def executed_scores(spark, sf_dir):
    """Run query pairs over the whole tables and score them."""
    views(spark, sf_dir, ["customer", "lineitem", "nation", "orders", "part", "supplier"])
    store = ResultStore(scratch_path(spark, "results"))
    cells, runs = C.run_pairs(spark, [(i, "star", p, t) for i, (p, t, _) in enumerate(QUERY_PAIRS)], store)
    return C.execution_scores(cells, runs).select(
        "pair_id", "verdict", "exec", "only_common", "subset", "superset", F.col("exec_error").isNotNull().alias("failed")
    )


def order_lists(spark, sf_dir):
    """Part lists per order against a reversed copy and a copy without its repeats."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return lists.select(
        "l_orderkey",
        C.same_multiset(F.col("parts"), F.reverse("parts")).alias("same_reversed"),
        C.same_multiset(F.col("parts"), F.array_distinct("parts")).alias("same_distinct"),
    )


QUERIES = {
    "result_verdicts": result_verdicts,
    "loose_verdicts": loose_verdicts,
    "mean_scores": mean_scores,
    "executed_scores": executed_scores,
    "order_lists": order_lists,
}

_KNOWN = ", ".join(f"({v}, '{x[3]}', {len(x[1].split())}, {len(x[2].split())})" for v, x in VARIANTS.items())
_NATIONS = f"(SELECT DISTINCT c_nationkey AS k FROM customer) n, (VALUES {_KNOWN}) w(v, verdict, p, t)"
_FLAGS = """CAST(verdict = 'equal' AS INT) AS exec, CAST(verdict <> 'different' AS INT) AS only_common,
            CAST(verdict IN ('equal', 'columns_subset') AS INT) AS subset, CAST(verdict IN ('equal', 'columns_superset') AS INT) AS superset"""
_RUN = ", ".join(f"({i}, {repr(v) if v else 'NULL'})" for i, (_, _, v) in enumerate(QUERY_PAIRS))

ORACLES = {
    "result_verdicts": f"SELECT CAST(v * 100 + k AS BIGINT) AS pair_id, verdict, {_FLAGS} FROM {_NATIONS}",
    "loose_verdicts": f"""SELECT CAST(v * 100 + k AS BIGINT) AS pair_id,
        CASE WHEN verdict = 'columns_intersect' AND p > t THEN 'columns_superset' WHEN verdict = 'columns_intersect' AND p < t THEN 'columns_subset'
             ELSE verdict END AS verdict FROM {_NATIONS}""",
    "mean_scores": f"""WITH f AS (SELECT v, {_FLAGS} FROM {_NATIONS})
        SELECT CAST(v AS BIGINT) AS variant, round(avg(exec), 6) AS exec, round(avg(only_common), 6) AS only_common,
               round(avg(subset), 6) AS subset, round(avg(superset), 6) AS superset, count(*) AS pairs FROM f GROUP BY ROLLUP (v)""",
    "executed_scores": f"""WITH w(pair_id, verdict) AS (VALUES {_RUN})
        SELECT CAST(pair_id AS BIGINT) AS pair_id, verdict, coalesce(CAST(verdict = 'equal' AS INT), 0) AS exec,
               coalesce(CAST(verdict <> 'different' AS INT), 0) AS only_common,
               coalesce(CAST(verdict IN ('equal', 'columns_subset') AS INT), 0) AS subset,
               coalesce(CAST(verdict IN ('equal', 'columns_superset') AS INT), 0) AS superset, verdict IS NULL AS failed FROM w""",
    "order_lists": """SELECT l_orderkey, true AS same_reversed, count(*) = count(DISTINCT l_partkey) AS same_distinct
        FROM lineitem GROUP BY l_orderkey""",
}
