from collections import defaultdict

import cases
import pytest
from test_exact_and_lines import lines_brute
from test_near import linked_texts
from test_scores_and_licenses import marked_rows

import corpus_pipeline
from querycorpus.llm.common import Memo, written


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, marks = marked_rows(200)
    rows += [(i + 10_000, t) for i, t in rows[:20]] + [(i + 20_000, t) for i, t in cases.texts(n=20)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder, docs


def test_stages_do_what_they_say(spark, tables):
    folder, docs = tables
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = written(stage(spark, docs, folder), "stage")
    assert list(seen) == ["start", "quality", "toxicity", "line dedup", "near dedup", "packing"]
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in seen.items() if name != "packing"}
    assert all(df.columns == seen["start"].columns for name, df in seen.items() if name != "packing")
    assert sum(i % 4 == 1 for i in rows["quality"] if i < 200) <= 3 and len(rows["quality"]) > 130
    assert sum(i % 5 == 0 for i in rows["toxicity"] if i < 200) <= 3
    want = lines_brute([(i, r["text"]) for i, r in rows["toxicity"].items()])
    assert {i: r["text"] for i, r in rows["line dedup"].items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line dedup"].values())
    groups = linked_texts([(i, r["text"]) for i, r in rows["line dedup"].items()], 5, 80)
    assert set(rows["near dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    pieces = defaultdict(list)
    for p in seen["packing"].collect():
        pieces[p["doc_id"]].append(p)
    assert set(pieces) == set(rows["near dedup"])
    assert all(sum(p["length"] for p in ps) == ps[0]["doc_tokens"] for ps in pieces.values())


def test_run_is_its_stages(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 0


def test_stages_on_no_rows_and_other_columns(spark, tables):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, cases.empty(spark), tables[0])
        assert empty.count() == 0
        some = stage(spark, cases.frame(spark, [*cases.texts(n=8), (None, None), (1, "x"), (1, "x")]), tables[0])
        assert name == "packing" or some.columns == cases.empty(spark).columns
        assert some.count() > 0 or name in ("quality", "toxicity")


def test_stages_keep_columns_of_any_name(spark, tables):
    """Names that the stages use themselves, names with a dot or a blank."""
    names = ["_lines", "_d", "_t", "_i", "_x", "_drops", "_dropped", "_row", "a.b", "doc id", "n_lines", "n_dropped", "kept_text", "kept", "component_id", "score"]
    rows = [*cases.texts(n=12), (None, None), (7, "x y z"), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in out.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables[0]).count() > 0


def test_memos_hold_short_words_only():
    calls = []
    memo = Memo(lambda w: calls.append(w) or len(w), 3)
    assert [memo[w] for w in ["ab", "ab", "x" * 5000, "x" * 5000, b"y" * 65, b"y" * 65]] == [2, 2, 5000, 5000, 65, 65]
    assert len(calls) == 5 and len(memo) == 1
