import pytest
from pyspark.sql import functions as F

from querycorpus.operators import runsql as Q
from querycorpus.sources import corpora as S
from querycorpus.sources import sinks as W
from querycorpus.sources.keyruns import KeyRuns
from querycorpus.streaming.chunks import append_available, stream_jsonl


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1", "  (SELECT 1) UNION SELECT 2", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "VALUES (1)", "SELECT 'insert into t; drop'",
        "SELECT 1 -- insert\n", "WITH a AS (SELECT 1), b AS (SELECT 2) SELECT * FROM a, b;",
    ],
)
def test_guard_accepts_queries(sql):
    Q.require_read_only(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "CREATE TABLE t (a int)", "DROP TABLE t", "EXPLAIN SELECT 1",
        "SELECT 1; DROP TABLE t", "FROM a INSERT INTO t SELECT *", "DELETE FROM t", "SET x = 1", "", "-- SELECT 1\nDROP VIEW v",
    ],
)
def test_guard_refuses_everything_else(sql):
    with pytest.raises(ValueError):
        Q.require_read_only(sql)


def test_limits_and_dates(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert Q.run_query(spark, "SELECT * FROM ten", 3).count() == 3
    assert Q.run_query(spark, "SELECT * FROM ten LIMIT 2", 5).count() == 2
    assert Q.run_query(spark, "SELECT * FROM ten", -1).count() == Q.run_query(spark, "SELECT * FROM ten", 0).count() == 10
    df = spark.createDataFrame([("2024-01-31", "2024-01-31", None), ("2024-02-01", "x", "2024-02-01")], "a string, b string, c string")
    rows = Q.reformat_dates(df).collect()
    assert [r["a"] for r in rows] == ["31/01/2024", "01/02/2024"] and rows[0]["b"] == "2024-01-31" and rows[1]["c"] == "2024-02-01"


def test_csv_text(spark):
    df = spark.createDataFrame([(1, ',a,b\n0,"x, ""y""",1\n1,"two\nlines",\n')], "id int, t string")
    cells = {(r["r"], r["c"]): (r["name"], r["value"]) for r in S.csv_text_cells(df, "id", "t").collect()}
    assert cells == {(0, 0): ("a", 'x, "y"'), (0, 1): ("b", "1"), (1, 0): ("a", "two\nlines"), (1, 1): ("b", "")}


def test_unknown_corpus_and_appends(spark, tmp_path):
    with pytest.raises(KeyError):
        S.Corpora().load(spark, "none.train")
    rows, path = spark.range(5).withColumn("v", F.lit(1)), str(tmp_path / "t")
    W.append_unique(rows, path, "id")
    with pytest.raises(ValueError, match="stored already"):
        W.append_unique(rows.limit(1), path, "id")
    with pytest.raises(ValueError, match="unique"):
        W.append_unique(rows.union(rows), path, "id", "skip")
    with pytest.raises(ValueError, match="columns differ"):
        W.append_unique(rows.drop("v"), path, "id")
    W.append_unique(spark.range(7).withColumn("v", F.lit(2)), path, "id", "skip")
    assert spark.read.parquet(path).count() == 7


def test_appends_open_few_buckets(spark, tmp_path):
    """A batch of new keys opens next to no bucket, a few stored keys only theirs; runs are merged; every append equals a join with all keys."""
    path, seen = str(tmp_path / "t"), set()
    for i in range(6):
        batch = [f"k{j}" for j in range(i * 3000, i * 3000 + 4000)] + [None]
        W.append_unique(spark.createDataFrame([(k, i) for k in batch], "id string, v int"), path, "id", "skip")
        seen |= {k for k in batch if k}
    rows = spark.read.parquet(path)
    assert rows.where("id is not null").count() == len(seen) == rows.select("id").distinct().count() - 1 and rows.where("id is null").count() == 6
    assert {(r["id"], r["v"]) for r in rows.where("id in ('k3500', 'k4100', 'k18999')").collect()} == {("k3500", 0), ("k4100", 1), ("k18999", 5)}
    runs = KeyRuns(spark, path, "id")
    assert len(runs.manifest["runs"]) < 6 and sum(r["n"] for r in runs.manifest["runs"]) == len(seen)
    fresh = spark.range(200).select(F.concat(F.lit("new"), "id").alias("id"))
    assert runs.stored(fresh)[1] <= 8
    found, opened = runs.stored(fresh.union(spark.createDataFrame([("k5",), ("k18000",), (None,)], "id string")))
    assert {r["id"] for r in found.collect()} == {"k5", "k18000"} and opened <= 10


@pytest.mark.parametrize("part", ["nothing", "some", "all"])
def test_broken_append_is_taken_up(spark, tmp_path, part):
    """An append that broke off between its notes: the repeated step adds what is missing, whatever part of its rows was written."""
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumn("v", F.lit(1))
    W.append_unique(rows, path, "id", step=("s", 0))
    more = spark.range(10, 20).withColumn("v", F.lit(2))
    runs = KeyRuns(spark, path, "id")
    runs.write(pending={"run": runs.new_run(more.select("id")), "step": ["s", 1]})
    if part != "nothing":
        more.where("id < 14" if part == "some" else "true").write.mode("append").parquet(path)
    W.append_unique(more, path, "id", step=("s", 1))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))
    W.append_unique(more, path, "id", step=("s", 1))
    assert spark.read.parquet(path).count() == 20
    with pytest.raises(ValueError, match="stored already"):
        W.append_unique(more, path, "id", step=("s", 2))


def test_tables_without_runs_and_second_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).withColumn("v", F.lit(0)).write.parquet(path)
    first, second = KeyRuns(spark, path, "id"), KeyRuns(spark, path, "id")
    first.start(spark.read.parquet(path), "bigint")
    with pytest.raises(RuntimeError, match="another append"):
        second.start(spark.read.parquet(path), "bigint")
    W.append_unique(spark.range(8).select(F.col("id").cast("int"), F.lit(1).alias("v")), path, "id", "skip")
    assert {(r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(i, int(i > 4)) for i in range(8)}


def test_streamed_appends_are_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for i in range(3):
        spark.range(i * 4, i * 4 + 8).selectExpr("id", f"{i} AS v").union(spark.range(i, i + 1).selectExpr("id", "9 AS v")).coalesce(1).write.mode("append").json(source)
    stream = stream_jsonl(spark, source, "id long, v int", 1)
    append_available(stream, path, str(tmp_path / "p1"), "id", "a")
    once = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert [r[0] for r in once] == list(range(16))
    append_available(stream, path, str(tmp_path / "p2"), "id", "a")
    append_available(stream, path, str(tmp_path / "p3"), "id", "b")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == once


def test_errors_are_never_kept(spark, tmp_path):
    store = W.ResultStore(str(tmp_path))
    with pytest.raises(Exception):
        store.get_or_run(spark, "d", "q", lambda: spark.sql("SELECT raise_error('x') AS a"))
    assert store.get(spark, "d", "q") is None
    store.get_or_run(spark, "d", "q", lambda: spark.range(3))
    assert store.get(spark, "d", "q").count() == 3 and store.get(spark, "other", "q") is None


def test_templates_run_once_for_all_fillings(spark):
    spark.range(50).selectExpr("id", "concat('n', id) AS name").createOrReplaceTempView("audited")
    values = spark.range(12_000).selectExpr("map('n', concat('n', id), 'k', CAST(id AS STRING)) AS marks", "explode(array(1, 2, 3, 4)) AS template_id")
    templates = [(1, "SELECT id FROM audited WHERE name = '{n}' AND id < 20"), (2, "SELECT id FROM audited WHERE id = {k} OR name LIKE '%{n}0%'"), (3, "SELECT nope FROM audited"), (4, "DROP TABLE {n}")]
    got = {(r["template_id"], r["status"]): r["n"] for r in Q.audit_templates(spark, templates, values).groupBy("template_id", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "rows"): 20, (1, "empty"): 11_980, (2, "rows"): 50, (2, "empty"): 11_950, (3, "error"): 1, (4, "error"): 12_000}
    with pytest.raises(ValueError, match="all its fillings at once"):
        Q.audit_templates(spark, [(1, "SELECT id FROM audited ORDER BY id LIMIT {k}")], values)


def test_statuses_equal_those_of_single_queries(spark):
    """Marks of every kind, bare and in quotes: an error belongs to its filling only."""
    spark.range(50).selectExpr("id", "concat('n', id) AS name", "id / 4.0 AS part", "CAST(id AS DOUBLE) / 8 AS share").createOrReplaceTempView("audited")
    marks = ["3", "77", "abc", "id", "3.25", ".5", "2e-1", "NULL", "'n4'", "o'brien", "; DROP VIEW audited", ""]
    templates = [
        "SELECT id FROM audited WHERE id = {k}", "SELECT id FROM audited WHERE id = '{k}'", "SELECT id FROM audited WHERE name LIKE '{k}' AND 'x' <> 'y'",
        "SELECT name FROM audited WHERE part = {k} OR share = {k};",
        "SELECT id FROM audited WHERE concat('id is ', id, '{k}') = 'id is 3{k}' AND id < {k}",
        "SELECT id FROM audited WHERE 10 % (CAST('{k}' AS INT) - 3) = 0",
        "WITH w AS (SELECT id FROM audited) SELECT id FROM w WHERE id = {k} -- it's all", "SELECT id FROM audited WHERE id > 48", "INSERT INTO audited VALUES ({k})",
    ]
    values = spark.createDataFrame([(i, {"k": m}) for i in range(len(templates)) for m in marks], "template_id int, marks map<string,string>")
    got = {(r["filled"], r["status"]) for r in Q.audit_templates(spark, list(enumerate(templates)), values).collect()}
    texts = list(dict.fromkeys(t.replace("{k}", m) for t in templates for m in marks))
    want = {(r["filled"], r["status"]) for r in Q.audit_queries(spark, texts).collect()}
    assert got == want
    assert len({status for _, status in want}) == 3


def test_failing_fillings_are_isolated_by_halving(spark):
    spark.range(50).selectExpr("id").createOrReplaceTempView("audited")
    values = spark.range(700).selectExpr("1 AS template_id", "map('k', CASE WHEN id IN (5, 333) THEN concat('bad', id) ELSE CAST(id AS STRING) END) AS marks")
    got = Q.audit_templates(spark, [(1, "SELECT id FROM audited WHERE id = '{k}'")], values).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"rows": 49, "empty": 649, "error": 2}
    lacking = spark.createDataFrame([(1, {"other": "1"}), (1, None)], "template_id int, marks map<string,string>")
    assert {r["status"] for r in Q.audit_templates(spark, [(1, "SELECT id FROM audited WHERE id = '{k}'")], lacking).collect()} == {"error"}


def test_audit_joins_fillings_with_values_once(spark, monkeypatch):
    """Rows that the marks are compared with are made distinct before they are broadcast or shuffled."""
    spark.range(1000).selectExpr("id AS k", "concat('t', id % 3) AS kind", "id % 5 AS size").createOrReplaceTempView("many_rows")
    values = spark.createDataFrame([(n, {"kind": f"t{i}", "size": str(i)}) for n in (1, 2) for i in range(7)], "template_id int, marks map<string,string>")
    plans = []
    statuses = Q._statuses

    def seen(spark, fillings, body, view, depth=0):
        fillings.createOrReplaceTempView(view)
        plans.append(spark.sql(f"SELECT filled FROM {view} WHERE EXISTS ({body})")._jdf.queryExecution().toString())
        return statuses(spark, fillings, body, view, depth)

    monkeypatch.setattr(Q, "_statuses", seen)
    templates = [(1, "SELECT k FROM many_rows WHERE kind = '{kind}' -- a note"), (2, "SELECT k FROM many_rows WHERE size > {size}")]
    got = {r["filled"]: r["status"] for r in Q.audit_templates(spark, templates, values).collect()}
    # A comparison other than equality keeps its form: it would need a join of all rows with all marks first.
    assert ["HashAggregate(keys=[" in p for p in plans] == [True, False]
    assert got == {f"SELECT k FROM many_rows WHERE kind = 't{i}' -- a note": "rows" if i < 3 else "empty" for i in range(7)} | {
        f"SELECT k FROM many_rows WHERE size > {i}": "rows" if i < 4 else "empty" for i in range(7)
    }
