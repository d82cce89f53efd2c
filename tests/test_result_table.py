"""Many results in one table: order, types, names, errors, settling."""

import os

import pytest
from pyspark.sql import functions as F

from querycorpus.sources.resulttable import ResultTable


def _query(spark, sql):
    return ("db", sql, lambda: spark.sql(sql))


def test_results_keep_order_types_and_names(spark, tmp_path):
    store = ResultTable(str(tmp_path), settle_after=100)
    texts = [
        "SELECT id, id * 2 AS a FROM range(50) ORDER BY id DESC",
        "SELECT id AS a, id AS a FROM range(3)",
        "SELECT id, CAST(1.50 AS DECIMAL(9, 2)) AS d, TIMESTAMP '2024-01-02 03:04:05.678901' AS t, CAST('NaN' AS DOUBLE) AS x, array(NULL, 1) AS l FROM range(2)",
        "SELECT id AS `x.y`, id AS _row FROM range(0)",
    ]
    assert store.keep_all(spark, [_query(spark, t) for t in texts]) == {}
    for settled in (False, True):
        if settled:
            store.settle(spark)
        for t in texts:
            want, got = spark.sql(t), store.get(spark, "db", t)
            assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
            assert str(got.collect()) == str(want.collect())
    assert store.get(spark, "other", texts[0]) is None
    # Kept once: the second run is not called.
    store.keep(spark, "db", texts[0], lambda: pytest.fail("run again"))


def test_a_failing_query_leaves_the_others(spark, tmp_path):
    store = ResultTable(str(tmp_path))
    good = [f"SELECT id + {k} AS v FROM range(4)" for k in range(5)]
    bad = ["SELECT CAST(raise_error('broken') AS BIGINT) AS v FROM range(4)", "SELECT nowhere FROM range(2)"]
    errors = store.keep_all(spark, [_query(spark, t) for t in [*good[:3], *bad, *good[3:]]])
    assert set(errors) == {("db", t) for t in bad}
    assert [store.get(spark, "db", t).count() for t in good] == [4] * 5
    assert all(store.get(spark, "db", t) is None for t in bad)
    with pytest.raises(RuntimeError, match="broken"):
        store.keep(spark, "db", bad[0], lambda: spark.sql(bad[0]))


def test_folders_do_not_grow_with_the_results(spark, tmp_path):
    store = ResultTable(str(tmp_path), settle_after=3)
    texts = [f"SELECT id AS n{k}, 'v{k}' AS s FROM range({k})" for k in range(12)]
    for t in texts:
        store.keep(spark, "db", t, lambda t=t: spark.sql(t))
    folders = [d for d, _, _ in os.walk(tmp_path)]
    marks = [n for n in os.listdir(tmp_path / "settlings") if not n.startswith(".")]
    assert len(marks) == 4 and len(folders) < 12
    for k, t in enumerate(texts):
        got = store.get(spark, "db", t)
        assert got.columns == [f"n{k}", "s"] and [r[0] for r in got.collect()] == list(range(k))


def test_rows_without_a_manifest_row_are_not_seen(spark, tmp_path):
    """A write and a settling that broke off before their last step change nothing."""
    store = ResultTable(str(tmp_path))
    text = "SELECT id FROM range(7) ORDER BY id"
    store.keep(spark, "db", text, lambda: spark.sql(text))
    entry = store.entries(spark, [store.key("db", text)])[store.key("db", text)]
    folder = f"{tmp_path}/rows/young-0/{entry['shape']}"
    spark.read.parquet(folder).withColumn("_write", F.lit("lost")).write.mode("append").parquet(folder)
    spark.read.parquet(folder).withColumn("_write", F.lit("000000000-lost")).write.parquet(f"{tmp_path}/rows/settled/{entry['shape']}")
    lost = spark.read.parquet(f"{tmp_path}/manifest/young-0").withColumn("write", F.lit("000000000-lost"))
    lost.write.parquet(f"{tmp_path}/manifest/settled")
    assert store.get(spark, "db", text).count() == 7
    store.settle(spark)
    assert [r[0] for r in store.get(spark, "db", text).collect()] == list(range(7))
