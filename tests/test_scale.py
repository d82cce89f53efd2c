import random
import re

from pyspark.sql import functions as F

from querycorpus.functions import scale
from querycorpus.operators import compare as C
from querycorpus.operators import linking as K
from querycorpus.operators import metrics as M
from querycorpus.operators import sqltext as X
from querycorpus.plans import landing


def plan(df):
    return df._jdf.queryExecution().toString()


def test_global_position_numbers_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r["id"]: r["position"] for r in scale.global_position(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            want[r[2]] = n
    assert got == want


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    top = scale.top_k(df, ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in plan(top)
    assert {(r["g"], r["id"]) for r in top.collect()} == {(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)}


def broadcast_joins(df):
    return [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line]


def test_cells_are_joined_by_shuffles(spark):
    """Cells come exploded from a few rows, so Catalyst takes them for the smaller side."""
    cells = spark.range(5).selectExpr("id", "explode(array('pred', 'target')) AS side").selectExpr("*", "explode(array(0, 1)) AS col_idx").selectExpr(
        "1L AS pair_id", "side", "id AS row_idx", "col_idx", "id + if(side = 'pred', 1e-9D, 0D) AS num", "CAST(NULL AS STRING) AS str"
    )
    doubtful = spark.createDataFrame([(1, True, 0, 0), (1, True, 1, 1)], "pair_id long, order_matters boolean, pc int, tc int")
    checked = C._verified(cells, doubtful, C.ATOL, C.RTOL)
    # Only the numbers that shift the ranks of a partition may be broadcast.
    assert all("_of#" in line for line in broadcast_joins(checked)), broadcast_joins(checked)
    assert {(r["pc"], r["tc"]) for r in checked.collect()} == {(0, 0), (1, 1)}
    mappings = spark.createDataFrame([(1, 0, [0], [0], 0)], "pair_id long, mapping int, p_cols array<int>, t_cols array<int>, n_exact int")
    joint = C._jointly_equal(cells, mappings, C.ATOL, C.RTOL)
    assert [r["pair_id"] for r in joint.collect()] == [1]
    assert not [line for line in broadcast_joins(joint) if "place#" in line]


def test_links_are_joined_by_shuffles(spark):
    questions = spark.sql("VALUES (1L, 'parts of hot bolts'), (2L, 'no such') AS t(question_id, question)")
    values = spark.sql("VALUES ('part', 'p_label', 'hot bolt') AS t(table_name, column, value)")
    found = K.value_matches(questions, values)
    assert all("_counter#" in line for line in broadcast_joins(found)), broadcast_joins(found)
    assert [(r["question_id"], r["value"]) for r in found.collect()] == [(1, "hot bolt")]


def test_parts_of_queries_are_joined_by_shuffles(spark):
    """Scopes, elements and scores come from checkpointed tokens, so Catalyst takes them for small; a null pair_id has no score."""
    one, other = "SELECT a FROM t WHERE a = 1", "SELECT a FROM t WHERE b IN (SELECT c FROM u)"
    pairs = spark.sql(f"VALUES (1L, '{one}', '{one}'), (2L, '{one}', '{other}'), (2L, '{one}', '{other}'), (NULL, '{one}', '{one}') AS t(pair_id, prediction, target)")
    scores = M.partial_match(pairs)
    assert not broadcast_joins(scores)
    got = sorted((r["pair_id"] or 0, round(r["partial_match"], 6)) for r in scores.collect())
    assert [k for k, _ in got] == [0, 1, 2, 2] and [v for _, v in got[:2]] == [0.0, 1.0] and got[2] == got[3] and 0 < got[2][1] < 1
    assert not broadcast_joins(M.variable_errors(pairs))


def test_first_valid_texts_are_joined_by_shuffles(spark):
    """What is known of all candidates grows with the questions, so the driver must not collect it; null and repeated keys keep their rows."""
    columns = spark.createDataFrame([("d", "t", "a"), ("d", "u", "b")], "db_id string, table_name string, column string")
    questions = spark.sql("""SELECT id, IF(id = 3, NULL, id DIV 2) AS question_id, IF(id = 6, NULL, 'd') AS db_id,
        array('SELECT nope FROM t', IF(id < 4, 'SELECT x FROM t, u', 'SELECT b FROM t, u'), IF(id = 0, 'SELECT a FROM v', 'SELECT a FROM t')) AS candidates FROM range(7)""")
    questions = questions.where("id <> 1").drop("id")
    found = X.first_valid(questions, columns)
    got = sorted(((-1 if r["question_id"] is None else r["question_id"], r["prediction"]) for r in found.collect()), key=str)
    assert got == [(-1, None), (0, None), (1, "SELECT a FROM t"), (2, "SELECT b FROM t, u"), (2, "SELECT b FROM t, u"), (3, "SELECT nope FROM t")]
    assert not broadcast_joins(found)


def test_cells_of_a_single_file_are_counted_in_many_tasks(spark, tmp_path):
    rows = [(i, f"n{i}", i % 3, i / 4, None if i % 5 else "m") for i in range(20)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    summed = landing.result_cells(spark, str(tmp_path))
    assert re.search(r"hashpartitioning\(row_idx#\d+L?, \d", plan(summed))
    got = {r["col_idx"]: (r["n"], r["numbers"], r["texts"], r["rows"], r["last"], r["total"]) for r in summed.collect()}
    assert got == {0: (20, 20, 0, 20, 19, 190.0), 1: (20, 0, 20, 20, 19, None), 2: (20, 20, 0, 20, 19, 19.0), 3: (20, 20, 0, 20, 19, 47.5), 4: (20, 0, 4, 20, 19, None)}


def test_rows_of_one_key_are_joined_in_many_tasks(spark):
    """One key holds nearly all rows: its rows are joined in many tasks, each with all of the key's few partners; a row without a place stays."""
    rows = spark.range(2000).select(F.when(F.col("id") < 1990, 1).otherwise(2).alias("k"), F.when(F.col("id") > 0, F.col("id")).alias("at"))
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    adaptive, parts = (spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scale.dealt_join(rows, few, ["k"], ["at"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    plain = rows.join(few, "k").collect()
    assert sorted((r["k"], r["at"] or -1, r["v"]) for r in got) == sorted((r["k"], r["at"] or -1, r["v"]) for r in plain)
    assert len({r["task"] for r in got if r["k"] == 1}) > 8
