import numpy as np
import pytest
from pyspark.sql import functions as F

from querycorpus.operators import vectors as V


def clustered(n, dims, centres, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(middle[i % centres] + rng.normal(scale=spread, size=dims)).tolist() for i in range(n)]


def brute(data, q, k, same=lambda i, q: True):
    unit = np.array([np.array(v) / (np.linalg.norm(v) or 1) for v in data])
    scores = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(len(data)) if i != q and np.any(data[i]) and same(i, q)]
    return [i for _, i in sorted(scores)[:k]]


@pytest.mark.parametrize(("leaf", "fan", "filters", "k"), [(8, 3, [], 7), (40, 64, [], 60), (8, 3, ["tag"], 7), (5, 2, ["tag"], 1)])
def test_deep_trees_match_brute_force(spark, leaf, fan, filters, k):
    """Several levels, copies of one vector beyond a leaf's size, cells smaller than k, a filter value with few items and one with none."""
    data = clustered(300, 6, 7, 4) + [[1.0] * 6] * 80 + [[0.0] * 6] + clustered(20, 6, 1, 9)
    tags = [i % 4 if i % 4 else (9 if i < 8 else None) for i in range(len(data))]
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(data, tags))], "item_id long, embedding array<double>, tag int")
    asked = df.where("item_id % 9 = 0 OR item_id IN (4, 380)").withColumnRenamed("item_id", "query_id")
    got = {}
    for r in V.nearest(df, asked, k, filters=filters, exclude_same=True, leaf=leaf, fan=fan).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for q in [i for i in range(len(data)) if (i % 9 == 0 or i == 4) and i != 380]:
        assert got.get(q, []) == brute(data, q, k, lambda i, q: not filters or tags[i] == tags[q])
    assert 380 not in got


def test_a_filter_value_without_items(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 1)], "item_id long, embedding array<double>, tag int")
    asked = spark.createDataFrame([(5, [1.0, 0.1], 2), (6, [1.0, 0.1], 1)], "query_id long, embedding array<double>, tag int")
    assert [(r["query_id"], r["item_id"]) for r in V.nearest(items, asked, 3, filters=["tag"]).collect()] == [(6, 1)]
    assert V.nearest(items.limit(0), asked, 3).count() == 0 and V.nearest(items, asked.limit(0), 3).count() == 0


def test_fewer_cells_are_kept_than_there_are(spark):
    data = clustered(2400, 8, 24, 5, 0.05)
    df = spark.createDataFrame(list(enumerate(data)), "item_id long, embedding array<double>")
    items = df.select("item_id", F.lit("").alias("node"), F.col("embedding").alias("vec"))
    asked = items.where("item_id % 40 = 0").withColumnRenamed("item_id", "query_id")
    tree = V.CellTree(items, 60, 16)
    assert len(tree.levels) >= 2
    assert tree.placed.groupBy("node").count().agg(F.max("count")).first()[0] <= 60
    kept = V._frontier(tree, asked, 5, None)
    assert kept.agg(F.sum("n")).first()[0] < 0.4 * 60 * 2400
    level = tree.levels[-1].collect()
    assert all(r["near"] <= r["far"] for r in level)


def test_probes_trade_recall(spark):
    data = clustered(600, 8, 6, 6)
    df = spark.createDataFrame(list(enumerate(data)), "item_id long, embedding array<double>")
    asked = df.where("item_id < 50").withColumnRenamed("item_id", "query_id")
    exact = V.nearest(df, asked, 5, exclude_same=True, leaf=40, fan=8)
    few = V.nearest(df, asked, 5, exclude_same=True, leaf=40, fan=8, probes=4)
    assert few.join(exact, ["query_id", "item_id"]).count() >= 0.8 * exact.count()


def test_no_table_has_a_row_per_query_and_leaf(spark, monkeypatch):
    """Vectors without clusters, where every query visits nearly every leaf: tables grow with the vectors, not with vectors times leaves."""
    data = np.random.default_rng(11).normal(size=(300, 16)).tolist()
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    sizes, cut = [], V.cut_lineage

    def counted(rows):
        kept = cut(rows)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(V, "cut_lineage", counted)
    found = V.nearest(df, df, 3, "vec_id", "vec_id", exclude_same=True, leaf=10, fan=8)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert all(got[q] == brute(data, q, 3) for q in range(len(data)))
    assert max(sizes) <= 2 * len(data)
