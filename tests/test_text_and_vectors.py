import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querycorpus.functions.text import indel_similarity
from querycorpus.operators import corpus as D
from querycorpus.operators import linearize as L
from querycorpus.operators import linking as K
from querycorpus.operators import metrics as M
from querycorpus.operators import profile as P
from querycorpus.operators import schematext as T
from querycorpus.operators import vectors as V

TABLE = (
    "table array<array<struct<value:string,is_header:boolean,column_span:int>>>, table_page_title string, table_section_title string,"
    " highlighted_cells array<array<int>>, sentence_annotations array<struct<final_sentence:string>>"
)


def test_spanning_headers_and_round_trip(spark):
    table = [[("T", True, 2), ("U", True, 1)], [("a", True, 1), ("b", False, 1), ("c", False, 1)]]
    df = spark.createDataFrame([(table, "P", "", [[1, 1], [1, 2]], None)], TABLE)
    rows = L.highlighted(df).collect()
    assert [(r["value"], r["col_headers"], r["row_headers"]) for r in rows] == [("b", ["T"], ["a"]), ("c", ["U"], ["a"])]
    text = L.subtable_text(df)
    assert text.first()["text"].startswith("<page_title> P </page_title> <table> <cell> b <col_header> T </col_header> <row_header> a ")
    back = text.select(L.cells_of_text(F.col("text")).alias("c")).first()["c"]
    assert [(c["value"], c["name"]) for c in back] == [("b", "T"), ("c", "U")]


def test_cell_types(spark):
    values = ["1,234", "6.0", "1998-05-05", "May 5, 1998", "31/12/2020", "abc", "12 34", "-"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(L.cell_type(F.col("v"))).collect()]
    assert got == ["NUMERIC", "NUMERIC", "NUMERIC", "DATE", "DATE", "STRING", "NUMERIC", "STRING"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    return row[-1]


@pytest.mark.parametrize("measure", ["levenshtein", "indel"])
def test_similarity_join_misses_nothing(spark, measure):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for _ in range(150)]
    spans = ["".join(c for c in w if rng.random() > 0.08) + rng.choice(["", "a"]) for w in words]
    spans = sorted({s for s in spans if len(s) > 1})
    got = K.similar_pairs(spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(w,) for w in sorted(set(words))], "norm string"), 0.85, measure)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    def score(a, b):
        return 1 - lev(a, b) / max(len(a), len(b)) if measure == "levenshtein" else 2 * lcs(a, b) / (len(a) + len(b))

    want = {(s, w) for s in spans for w in set(words) if s[0] == w[0] and score(s, w) >= 0.85 - 1e-9}
    assert {(r["span"], r["norm"]) for r in got.collect()} == want and len(want) > 50


def test_indel_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("abc", "abc"), ("a", "b")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(indel_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [round(8 / 13, 6), 1.0, 0.0]


def test_value_rules(spark):
    questions = spark.createDataFrame([(1, "Did many French singers' id 1999 win the GRAMMY award, yes?")], "question_id long, question string")
    values = spark.createDataFrame(
        [("t", "c", v) for v in ["French", "many", "id", "1999", "the", "GRAMMYS", "GRAMMY", "award", "yess"]], "table_name string, column string, value string"
    )
    got = {r["value"]: r["score"] for r in K.value_matches(questions, values).collect()}
    assert set(got) == {"French", "many", "GRAMMY", "award"} and got["French"] == 1.0


def test_link_score_notes(spark):
    rows = [
        (1, ["t.c.a", "t.d.5"], ["t.c.a", "t.x.y"]), (2, ["t.d.7.5%"], ["t.d.9"]), (3, [], ["t.c.z"]), (4, ["t.c.v.w", "t.c.v.w"], ["t.c.v.w"]),
    ]
    df = spark.createDataFrame(rows, "idx long, gt array<string>, pred array<string>")
    plain, textual = K.link_scores(df).first(), K.link_scores(df, True).first()
    assert plain["records"] == 4 and plain["inclusion"] == 0.5 and plain["precision"] == 3 / 5 and plain["recall"] == (0.5 + 0 + 0 + 1) / 4
    assert textual["records"] == 2 and textual["precision"] == 3 / 5 and textual["recall"] == 1.0
    with pytest.raises(ValueError):
        K.paired_records(df.select("idx", "gt"), df.select("idx", "pred").limit(2))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    data = [(centres[i % 6] + rng.normal(scale=0.3, size=8)).tolist() for i in range(400)]
    data += [data[0]] * 150 + [[0.0] * 8]
    rows = [(i, v, i % 3) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>, tag int")
    asked = df.where("item_id < 60 OR item_id = 550").withColumnRenamed("item_id", "query_id")
    unit = np.array([np.array(v) / (np.linalg.norm(v) or 1) for v in data])
    for filters in ([], ["tag"]):
        got = {}
        for r in V.nearest(df, asked, 7, filters=filters, exclude_same=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["item_id"])
        assert 550 not in got
        for q in range(60):
            scores = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(550) if i != q and (not filters or i % 3 == q % 3)]
            assert got[q] == [i for _, i in sorted(scores)[:7]]
    few = V.nearest(df, asked, 7, exclude_same=True, probes=3)
    exact = V.nearest(df, asked, 7, exclude_same=True)
    assert few.join(exact, ["query_id", "item_id"]).count() >= 0.8 * exact.count()


def test_vector_table_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, embedding array<double>")
    with pytest.raises(ValueError, match="3 numbers"):
        V.store_vectors(df, str(tmp_path / "v"), "k", "embedding", 3)
    with pytest.raises(ValueError):
        V.store_vectors(df, str(tmp_path / "v"), "embedding", "embedding", 2)
    assert not V.is_filled(spark, str(tmp_path / "v"))
    assert V.reduced(df, "embedding", 2) is df


def test_reduction_keeps_the_main_direction(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x), float(2 * x + e), float(e)]) for i, (x, e) in enumerate(zip(rng.normal(size=200), rng.normal(scale=0.01, size=200)))]
    out = V.reduced(spark.createDataFrame(data, "id long, v array<double>"), "v", 1).collect()
    assert len(out[0]["v"]) == 1 and abs(np.mean([r["v"][0] for r in out])) < 1e-4 and np.var([r["v"][0] for r in out]) > 3


def test_bleu_small(spark):
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d f", "x"]), (2, "a b", ["a b"])], "id long, prediction string, refs array<string>")
    row = M.corpus_bleu(df).first()
    p = [6 / 7, 4 / 5, 2 / 3, 1 / 2]
    assert row["bleu"] == pytest.approx(math.exp(1 - 7 / 7) * math.exp(sum(map(math.log, p)) / 4))
    assert M.corpus_bleu(spark.createDataFrame([(1, "a b", ["c d"])], df.schema)).first()["bleu"] == 0


def test_partial_match_of_odd_pairs(spark):
    pairs = spark.createDataFrame(
        [(1, "SELECT a FROM t", "SELECT a FROM t"), (2, "oops", "SELECT a FROM t"), (3, "SELECT t.x FROM t JOIN u ON t.x = u.y", "SELECT u.y FROM t JOIN u ON t.x = u.y"), (4, None, "SELECT 1 FROM t")],
        "pair_id long, prediction string, target string",
    )
    got = {r["pair_id"]: r for r in M.partial_match(pairs).collect()}
    assert got[1]["partial_match"] == got[3]["partial_match"] == 1.0 and got[2]["partial_match"] == got[4]["partial_match"] == 0.0


def test_precision_padding_and_typos(spark):
    with pytest.raises(ValueError):
        D.predictions_of_precision(F.col("a"), F.col("b"), 0, F.col("k"))
    df = spark.createDataFrame([(1, "find red bolt", [("t", "c", "Red Bolt", "=")], "d"), (2, "nothing", [("t", "c", "Red", "=")], "d")],
                               "id long, question string, values array<struct<table:string,column:string,value:string,condition:string>>, db_id string")
    once, again = D.with_typos(df, "id", "s").collect(), D.with_typos(df, "id", "s").collect()
    assert once == again and [r["id"] for r in once] == [1] and once[0]["question"] != "find red bolt"
    with pytest.raises(ValueError, match="unknown steps"):
        D.run_steps(df, [("no_step", {})])


def test_a_group_of_any_size_is_decided_as_a_whole(spark):
    """Far more rows than the former bound of 10,000 in one group, with one odd value near the end."""
    n = 25_000
    df = spark.range(n).repartition(7).select(
        F.lit("q").alias("query"), F.lit("d").alias("db_id"), "id", F.concat(F.lit("question "), F.col("id")).alias("question"),
        F.lit("same").alias("same"), F.when(F.col("id") == n - 3, "odd").otherwise("even").alias("almost"), F.lit(None).cast("string").alias("none"),
    )
    rows = D.grouped_by_query(df, ["query", "db_id"], ["id"])
    found = {r["column"]: (r["rows"], r["n_distinct"]) for r in rows.groupBy("column", "n_distinct").agg(F.count(F.lit(1)).alias("rows")).collect()}
    assert found == {"id": (n, n), "question": (n, n), "same": (1, 1), "almost": (n, 2), "none": (1, 1)}
    assert rows.where("column = 'id' AND value <> place").isEmpty()
    points = D.datapoints(df, "question", "query", "db_id", ["id"])
    assert [r["nl_query"] for r in points.select("nl_query").distinct().collect()] == ["question 0"]
    assert points.where("nl_query_alt IS NULL").count() == 1 and points.where("nl_query_alt = concat('question ', place)").count() == n - 1


def test_value_texts_are_escaped(spark):
    values = ["it's", 'say "x"', "both ' and \"", "a\\b\nc\td\re", "x" * 31]
    df = spark.createDataFrame([(values,)], "v array<string>")
    text = df.select(T.value_sequence(F.col("v"), F.lit("STRING"))).first()[0]
    assert text == "values : " + " , ".join(repr(v if len(v) <= 30 else v[:30] + "...") for v in values)


def test_catalog_rules(spark):
    schema = "db_id string, table_name string, ordinal int, column string"
    columns = spark.createDataFrame([("d", "authors", 0, "ids"), ("d", "books", 0, "author_id"), ("d", "books", 1, "title")], schema)
    fks = P.infer_foreign_keys(columns)
    assert [(r["table_name"], r["column"], r["foreign_table"], r["foreign_column"]) for r in fks.collect()] == [("books", "author_id", "authors", "ids")]
    rule = lambda *r: spark.createDataFrame(list(r), "table_name string, column string")
    left, kept = P.filter_catalog(columns, fks, exclude=rule(("authors", "*")))
    assert left.count() == 2 and kept.count() == 0
    with pytest.raises(ValueError, match="unknown"):
        P.filter_catalog(columns, fks, keep=rule(("books", "nope")))
    with pytest.raises(ValueError):
        P.filter_catalog(columns, fks)


def test_schema_texts(spark):
    schema = "db_id string, table_name string, ordinal int, column string, data_type string, is_pk boolean, note string, table_note string, values array<string>"
    columns = spark.createDataFrame(
        [("d", "t", 0, "a", "INT", True, None, "N", ["1", "2"]), ("d", "t", 1, "b", "VARCHAR(9)", False, "B name", "N", ["x" * 31, "it's"])], schema
    )
    fks = spark.createDataFrame([("d", "t", "b", "u", "id")], "db_id string, table_name string, column string, foreign_table string, foreign_column string")
    text = lambda form, **o: T.schema_text(columns, form, fks=fks, n_values=2, **o).first()["schema_text"]
    cut = "'" + "x" * 30 + "...'"
    assert text("compact") == (
        "table t ( comment : N ) , columns = [ t.a ( INT | primary key | values : 1 , 2 ) , t.b ( VARCHAR(9) | comment : B name | values : "
        + cut + " , \"it's\" ) ]\nforeign keys :\nt.b = u.id"
    )
    assert text("ddl", notes=False).startswith("CREATE TABLE t (\n\ta INT primary key, -- values : 1 , 2\n\tb VARCHAR(9), -- values : ")
    assert text("m-schema") == (
        "【DB_ID】 d\n【Schema】\n# Table: t, N\n[\n(a:INT, Primary Key, Examples: [1, 2]),\n(b:VARCHAR, B name, Examples: [" + cut + ", \"it's\"])\n]\n【Foreign keys】\nt.b=u.id"
    )
    with pytest.raises(ValueError):
        T.schema_text(columns, "other")


def test_equivalent_columns_close_over_chains(spark):
    target = "SELECT a.x FROM a JOIN b ON a.x = b.x JOIN c ON b.x = c.x"
    log = M.paired_log(spark.createDataFrame([(1, target.replace("SELECT a.x", "SELECT c.x"), target)], "pair_id long, prediction string, target string"))
    names = {r["element"].rsplit("/", 1)[0] for r in M.variable_elements(log, M.scopes_of(log)).collect() if r["element"].startswith("columns")}
    assert names == {"columns/a.x"}


def test_compact_text_takes_the_value_of_a_cell_once(spark):
    """Types and date forms are sought in the value of a cell, which is cut out of the cell one time."""
    df = spark.createDataFrame([(1, ',n,d,t\n0,3.0,05/11/2020,"a, ""b"""\n1,2.5,x,\r\n', "T", "Q")], "id int, result string, table_name string, query_description string")
    out = L.csv_result_text(df, use_query=True).select(L.compact_text(F.col("text")).alias("text"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(.*) <col_header>") == 1
    assert out.first()["text"] == (
        '<query> Q <table> T <col0> n | NUMERIC | 3 <col1> d | DATE | 05/11/2020 <col2> t | STRING | a, "b" '
        "<col3> n | NUMERIC | 2.5 <col4> d | STRING | x <col5> t | STRING |  "
    )
