"""Sources and sinks: the given tables written in each corpus form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.functions.scale import global_position, scratch_path
from querycorpus.operators import compare as C
from querycorpus.plans.inputs import given, table, with_inputs
from querycorpus.sources import corpora as S
from querycorpus.sources import sinks as W
from querycorpus.sources.resulttable import ResultTable
from querycorpus.streaming.chunks import append_available, land_available, stream_jsonl

TURN = "conv_id long, turn long, role string, text string"


def _json_arrays(spark, sf_dir, path):
    """Conversations as files of one JSON array each, a bounded number of conversations per file."""
    rows = table(spark, sf_dir, "conversations").withColumn("file", F.floor(F.col("conv_id") / 200))
    one = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("conv_id", "turn", "role", "text"))), ",\n"), F.lit("]"))
    rows.groupBy("file").agg(one.alias("value")).write.partitionBy("file").text(path)


def json_array_corpus(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    _json_arrays(spark, sf_dir, path)
    rows = S.read_json_corpus(spark, {"train": path, "dev": path}, TURN)
    return rows.select("conv_id", "turn", "role", "text", "split")


def jsonl_corpus(spark, sf_dir):
    """JSON Lines by role as splits."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "conversations").write.partitionBy("role").json(path)
    splits = {r: f"{path}/role={r}" for r in ("user", "assistant", "system")}
    return S.read_jsonl_corpus(spark, splits, "conv_id long, turn long, text string")


def gzipped_jsonl(spark, sf_dir):
    path = scratch_path(spark, "gz")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.option("compression", "gzip").json(path)
    rows = S.read_large_jsonl(spark, path, "doc_id long, text string", 8)
    return rows.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def streamed_jsonl(spark, sf_dir):
    """The events as JSON Lines, landed in small steps by a stream, then counted."""
    folder, target, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").repartition(4).write.json(folder)
    land_available(stream_jsonl(spark, folder, "event_id long, event_type string, value double"), target, progress)
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def csv_tables(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").write.csv(path, header=True, escape='"')
    rows = S.read_csv_tables(spark, path, "event_id long, event_type string, value double, props string")
    return rows.select("event_id", "event_type", "value", "props", (F.length("source_file") > 0).alias("has_file"))


def _corpora(sf_dir):
    book = S.Corpora()
    book.register("turns", lambda s: table(s, sf_dir, "conversations").select("text", F.col("role").alias("split")))
    book.register("items", lambda s: table(s, sf_dir, "benchmark").select("text", "item_id", F.lit("train").alias("split")))
    return book


def pooled_corpora(spark, sf_dir):
    pool = _corpora(sf_dir).pool(spark, ["turns.user", "turns.system", "items"])
    return pool.groupBy("corpus", "split").agg(F.count(F.lit(1)).alias("n"), F.count("item_id").alias("n_ids"), F.sum(F.length("text")).alias("chars"))


def cached_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")

    def build():
        return table(spark, sf_dir, "customer").withColumn("split", F.when(F.col("c_acctbal") < 0, "dev").otherwise("train"))

    W.cached_splits(spark, path, build)
    again = W.cached_splits(spark, path, lambda: build().limit(0))
    return again.select("c_custkey", "split")


def written_report(spark, sf_dir):
    """A scored report written as config, rows and totals, and read back."""
    path = scratch_path(spark, "report")
    rows = table(spark, sf_dir, "labels")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"))
    W.write_report(spark.createDataFrame([("labels", 1)], "corpus string, version int"), rows, totals, path)
    kept = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    config = spark.read.schema("corpus string, version int").json(f"{path}/config")
    back = spark.read.schema("n long, quality double").json(f"{path}/totals").join(kept, "n")
    return back.withColumn("version", F.lit(1)).join(config, "version").select(F.col("n").alias("rows"), "toxic", "n", "quality", "corpus", "version")


def json_outputs(spark, sf_dir):
    path = scratch_path(spark, "json")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    W.write_json(lists, path)
    back = spark.read.schema("l_orderkey long, parts array<long>").json(path)
    return back.select("l_orderkey", F.concat_ws("|", F.transform("parts", lambda p: p.cast("string"))).alias("parts"))


def unique_appends(spark, sf_dir):
    """Two overlapping batches of events; a key is stored once."""
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    W.append_unique(events.where("event_type <> 'view'"), path, "event_id")
    W.append_unique(events.where("event_type IN ('view', 'click')"), path, "event_id", stored_keys="skip")
    return spark.read.parquet(path)


def streamed_appends(spark, sf_dir):
    """Files of events, whose views come twice, appended by a stream; then all of it again by a stream that lost its progress."""
    folder, target = scratch_path(spark, "in"), scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.repartition(2, "event_id").write.json(folder)
    events.where("event_type = 'view'").coalesce(1).write.mode("append").json(folder)
    for name in ("first", "again"):
        append_available(stream_jsonl(spark, folder, events.schema, 2), target, scratch_path(spark, "progress"), "event_id", name)
    return spark.read.parquet(target)


def result_keys(spark, sf_dir):
    return W.result_keys(given(spark, sf_dir, "query_log")).select("query_id", "result_key")


def kept_results(spark, sf_dir):
    """A stored query result keeps its types and is read back, not run again."""
    store = W.ResultStore(scratch_path(spark, "store"))
    orders = table(spark, sf_dir, "orders")
    store.get_or_run(spark, "star", "q", lambda: orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last")))
    return store.get_or_run(spark, "star", "q", lambda: orders.limit(0))


def kept_result_table(spark, sf_dir):
    """The ranked customers of each market segment as results of one table, kept in two writes with a settling between, and read back with their places."""
    store = ResultTable(scratch_path(spark, "results"), settle_after=1)
    customers = table(spark, sf_dir, "customer")
    segments = sorted(r[0] for r in customers.select("c_mktsegment").distinct().collect())

    def ranked(segment):
        return customers.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")

    for some in (segments[:3], segments[2:]):
        store.keep_all(spark, [("star", s, lambda s=s: ranked(s)) for s in some])
    kept = [store.get(spark, "star", s).select(F.lit(s).alias("segment"), F.monotonically_increasing_id().alias("row"), "c_custkey", "c_acctbal") for s in segments]
    together = kept[0]
    for one in kept[1:]:
        together = together.union(one)
    return global_position(together, ["segment"], [F.col("row")], "place").drop("row")


def result_cells(spark, sf_dir):
    """The customers as cells with a row number, summed up per column."""
    # Spread by rows: the row numbers of a table in one file would be counted in one task.
    cells = C.result_cells(table(spark, sf_dir, "customer"), 7, "pred").repartition("row_idx")
    return cells.groupBy("pair_id", "side", "col_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count("num").alias("numbers"), F.count("str").alias("texts"),
        F.count_distinct("row_idx").alias("rows"), F.max("row_idx").alias("last"), F.round(F.sum("num"), 2).alias("total"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        json_array_corpus, jsonl_corpus, gzipped_jsonl, streamed_jsonl, csv_tables, pooled_corpora, cached_splits, written_report, json_outputs,
        unique_appends, streamed_appends, result_keys, kept_results, kept_result_table, result_cells,
    ]
}

_CELLS = [("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0)]
ORACLES = {
    "json_array_corpus": "SELECT conv_id, turn, role, text, s AS split FROM conversations, (VALUES ('train'), ('dev')) v(s)",
    "jsonl_corpus": "SELECT conv_id, turn, text, role AS split FROM conversations",
    "gzipped_jsonl": "SELECT doc_id, CAST(length(text) AS INT) AS n, md5(text) AS digest FROM documents",
    "streamed_jsonl": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "csv_tables": "SELECT event_id, event_type, value, props, true AS has_file FROM events",
    "pooled_corpora": """SELECT 'turns.' || role AS corpus, role AS split, count(*) AS n, 0 AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars
        FROM conversations WHERE role IN ('user', 'system') GROUP BY role
        UNION ALL SELECT 'items', 'train', count(*), count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark""",
    "cached_splits": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'dev' ELSE 'train' END AS split FROM customer",
    "written_report": """SELECT count(*) AS rows, CAST(sum(toxic) AS BIGINT) AS toxic, count(*) AS n, round(avg(quality), 6) AS quality, 'labels' AS corpus, 1 AS version
        FROM labels""",
    "json_outputs": """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) AS parts
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey""",
    "unique_appends": "SELECT event_id, event_type, value FROM events",
    "streamed_appends": "SELECT event_id, event_type, value FROM events",
    "result_keys": with_inputs(["query_log"], "SELECT query_id, sha256('star' || chr(10) || sql) AS result_key FROM query_log"),
    "kept_results": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus",
    "kept_result_table": """SELECT c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS place,
        c_custkey, c_acctbal FROM customer""",
    "result_cells": " UNION ALL ".join(
        f"""SELECT 7 AS pair_id, 'pred' AS side, {i} AS col_idx, count(*) AS n, {'count(*)' if num else '0'} AS numbers, {'0' if num else 'count(*)'} AS texts,
        count(*) AS rows, count(*) - 1 AS last, {f'round(CAST(sum({c}) AS DOUBLE), 2)' if num else 'CAST(NULL AS DOUBLE)'} AS total FROM customer"""
        for i, (c, num) in enumerate(_CELLS)
    ),
}
