from pyspark.sql import functions as F

from querycorpus.operators import sqltext as X
from querycorpus.operators.sqltokens import tokenized


def log(spark, *texts):
    return spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "query_id long, db_id string, sql string")


def test_unreadable_texts_are_null(spark):
    rows = X.categories(log(spark, "hello", "SELECT a FROM t WHERE (x = 1", "SELECT 'open FROM t", None, "", "SELECT a FROM t")).orderBy("query_id").collect()
    assert [r["category"] for r in rows] == [None, None, None, None, None, "S-F-"]


def test_keywords_inside_literals_and_quotes(spark):
    rows = X.categories(log(spark, "SELECT \"group by\" FROM t WHERE a = 'it''s order by limit 3'")).collect()
    assert rows[0]["structure_name"] == "S-F-W"


def test_text_edits(spark):
    t = tokenized(log(spark, "SELECT a FROM t AS x WHERE x.b = 'x.b' ORDER BY x.a, count(*) LIMIT 3"))
    row = t.select(
        X.explicit_order(F.col("tokens")).alias("o"), X.without_table_aliases(F.col("tokens")).alias("a"), X.lowercase_sql(F.col("sql")).alias("l")
    ).first()
    assert row["o"] == "SELECT a FROM t AS x WHERE x.b = 'x.b' ORDER BY x.a asc, count(*) asc LIMIT 3"
    assert row["a"] == "SELECT a FROM t WHERE t.b = 'x.b' ORDER BY t.a, count(*) LIMIT 3"
    assert row["l"] == "select a from t as x where x.b = 'x.b' order by x.a, count(*) limit 3"


def test_fenced_answers(spark):
    df = spark.createDataFrame([("```sql\nSELECT 1```",), ("```SELECT 2``` ```x```",), ("SELECT 3",), ("```SQL SELECT 4\n``` end",)], "a string")
    assert [r[0].strip() for r in df.select(X.fenced_sql(F.col("a"))).collect()] == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT 4"]


def test_strip_db_id(spark):
    df = spark.createDataFrame([("d | SELECT 1",), ("SELECT 1",), ("d | a | b",)], "a string")
    assert [r[0] for r in df.select(X.strip_db_id(F.col("a"))).collect()] == ["SELECT 1", None, "a | b"]


def test_operators_of_nested_and_negated_conditions(spark):
    sql = "SELECT -a, b * 2 FROM t WHERE NOT (a NOT BETWEEN 1 AND 2 AND b NOT LIKE 'x' AND c IS NOT NULL OR d IN (1, 2)) AND EXISTS (SELECT * FROM u)"
    got = sorted((r["clause"], r["member"]) for r in X.operators(log(spark, sql)).collect())
    assert got == sorted(
        [("select", "mul"), ("where", "not"), ("where", "not_between"), ("where", "and"), ("where", "not_like"), ("where", "is not null"),
         ("where", "or"), ("where", "in"), ("where", "and"), ("where", "exists")]
    )


def test_correlated_alias_resolves_outwards(spark):
    sql = "SELECT o.a FROM t1 o WHERE o.a > (SELECT max(i.a) FROM t2 i WHERE i.k = o.k)"
    cols = {(r["depth"], r["table_name"], r["name"]) for r in X.variables(log(spark, sql)).where("kind = 'columns'").collect()}
    assert cols == {(0, "t1", "a"), (1, "t2", "a"), (1, "t2", "k"), (1, "t1", "k")}


def test_same_literal_on_two_columns_is_kept(spark):
    got = {(r["table_name"], r["column"], r["operator"], r["value"]) for r in X.filter_values(log(spark, "SELECT a FROM t WHERE b = 'v' AND c != 'v' AND d IN ('p', 'q')")).collect()}
    assert got == {("t", "b", "=", "v"), ("t", "c", "!=", "v"), ("t", "d", "in", "p"), ("t", "d", "in", "q")}


def test_validity_and_repair(spark):
    columns = spark.createDataFrame([("d", "singer", "name"), ("d", "singer", "age"), ("d", "concert", "year")], "db_id string, table_name string, column string")
    texts = ["SELECT Name FROM singer", "SELECT nme FROM singers WHERE age = 'nme'", "SELECT s.year FROM singer AS s", "SELECT year FROM singer, concert"]
    valid = [r["is_valid"] for r in X.validity(log(spark, *texts), columns).orderBy("query_id").collect()]
    assert valid == [True, False, False, True]
    fixed = [r["repaired"] for r in X.repaired_names(log(spark, *texts[:2]), columns).orderBy("query_id").collect()]
    assert fixed[1] == "SELECT name FROM singer WHERE age = 'nme'"


def test_token_step_needs_no_shuffle(spark):
    plan = X.categories(log(spark, "SELECT 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_real_logs_invent_no_names(spark):
    """Comments, casts, units, exponents, signs and parentheses around arms."""
    texts = [
        "SELECT a::int, b::double precision FROM t WHERE x > 1e5 AND y = .5 AND z = -1 -- pick b",
        "SELECT EXTRACT(YEAR FROM d) /* c FROM u */ FROM t WHERE d > timestamp '2020-01-01' + INTERVAL '1' DAY",
        "(SELECT a FROM t ORDER BY a LIMIT 3) UNION (SELECT b FROM u) ORDER BY 1 LIMIT 7",
        "(SELECT a FROM t) UNION (SELECT b FROM u)",
        "SELECT a - 1 FROM t WHERE n = 'x -- no comment' AND m IN (-3, 4) AND k BETWEEN -2 AND 5;",
        'SELECT sum(x) OVER (PARTITION BY g ORDER BY h) AS w, CASE WHEN p > 1.5e-3 THEN \'q\' ELSE r END FROM "my t"',
        "SELECT CAST(a AS double precision) FROM t -- end",
    ]
    log = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "query_id long, db_id string, sql string")
    found = {}
    for r in X.variables(log).collect():
        found.setdefault((r["query_id"], r["kind"]), set()).add(r["name"])
    columns = [set("abxyz"), {"d"}, {"a", "b"}, {"a", "b"}, set("anmk"), set("xghpr"), {"a"}]
    values = [{"1e5", ".5", "-1"}, {"2020-01-01", "1"}, {"1"}, None, {"1", "x -- no comment", "-3", "4", "-2", "5"}, {"1.5e-3", "q"}, None]
    assert [found.get((i, "columns")) for i in range(7)] == columns and [found.get((i, "values")) for i in range(7)] == values
    assert {k: v for k, v in found.items() if k[1] == "aliases"} == {(5, "aliases"): {"w"}}
    outer = {r["query_id"]: (r["has_order_by"], r["limit_value"]) for r in X.outer_features(log).collect()}
    assert outer == {i: (i == 2, 7 if i == 2 else None) for i in range(7)}
    filters = {(r["query_id"], r["column"], r["operator"], r["value"]) for r in X.filter_values(log).collect()}
    assert {(0, "z", "=", "-1"), (0, "x", ">", "1e5"), (4, "m", "in", "-3"), (4, "n", "=", "x -- no comment")} <= filters


def test_companion_column(spark):
    texts = [
        "SELECT title FROM result", "SELECT r.title, x FROM result r JOIN t ON r.a = t.a", "SELECT title, id FROM result", "SELECT r.title, r.id FROM result AS r",
        "SELECT title FROM other", "SELECT a FROM result", "(SELECT", "SELECT title FROM (SELECT title FROM result) AS q",
    ]
    got = [r["with_key"] for r in X.with_companion_column(log(spark, *texts), "result", "title", "id").orderBy("query_id").collect()]
    assert got == ["SELECT title, id FROM result", "SELECT r.title, x, r.id FROM result r JOIN t ON r.a = t.a", *texts[2:6], None, texts[7]]


def test_select_lists_of_real_logs(spark):
    """FROM inside of parentheses, aliases without AS, CASE, windows, casts, quoted aliases."""
    texts = [
        "SELECT EXTRACT(YEAR FROM d) FROM t",
        "SELECT TRIM(BOTH ' ' FROM a) b, SUBSTRING(c FROM 2 FOR 3) AS d FROM t",
        "SELECT a b, t.c, count(*) n, CASE WHEN a > 1 THEN 'x' ELSE 'y' END label FROM t",
        'SELECT DISTINCT a::int "my a", sum(x) OVER (PARTITION BY g) w, INTERVAL \'1\' day FROM t',
        "SELECT a, /* FROM u */ b -- x FROM v\n FROM t",
        "(SELECT a z FROM t) UNION (SELECT b FROM u)",
    ]
    rows = X.select_list(log(spark, *texts)).orderBy("query_id").collect()
    assert [r["items"] for r in rows[:5]] == [
        ["EXTRACT(YEAR FROM d)"], ["TRIM(BOTH ' ' FROM a) b", "SUBSTRING(c FROM 2 FOR 3) AS d"],
        ["a b", "t.c", "count(*) n", "CASE WHEN a > 1 THEN 'x' ELSE 'y' END label"],
        ['a::int "my a"', "sum(x) OVER (PARTITION BY g) w", "INTERVAL '1' day"], ["a", "b"],
    ]
    aliases = [{(a["alias"], a["stands_for"]) for a in r["aliases"]} for r in rows]
    assert aliases == [
        set(), {("b", "trim"), ("d", "substring")}, {("b", "a"), ("n", "count"), ("label", "CASE WHEN a > 1 THEN 'x' ELSE 'y' END")},
        {('"my a"', "a::int"), ("w", "sum")}, set(), {("z", "a")},
    ]
    got = {}
    for r in X.variables(log(spark, *texts)).where("kind = 'aliases'").collect():
        got.setdefault(r["query_id"], set()).add(r["name"])
    assert got == {1: {"b", "d"}, 2: {"b", "n", "label"}, 3: {"my a", "w"}, 5: {"z"}}
    edited = tokenized(log(spark, *texts)).select("query_id", X.without_select_aliases(F.col("tokens")).alias("t"), X.with_select_column(F.col("tokens"), "k").alias("k"))
    edited = edited.orderBy("query_id").collect()
    assert edited[2]["t"].startswith("SELECT a, t.c, count(*) n,") and edited[0]["k"] == "SELECT EXTRACT(YEAR FROM d), k FROM t"


def test_place_of_a_token_is_decided_once(spark):
    """The rules of clauses stand in the fold once, not once for each of its uses."""
    found = tokenized(log(spark, "SELECT (a) x, b FROM t, (SELECT c FROM u) v WHERE a BETWEEN 1 AND 2 /* x */ ;"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("THEN setop") == 1
    tokens = found.first()["tokens"]
    assert [t["tok"] for t in tokens if t["range_and"]] == ["AND"]
    inner = [(t["tok"], t["clause"], t["depth"], t["n1"]) for t in tokens if t["tok"] in ("c", "u")]
    assert inner == [("c", "select", 1, "from"), ("u", "from", 1, ")")]
