"""Table-to-text operators on one small table per order, built from its line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.operators import linearize as L
from querycorpus.plans.inputs import table
from querycorpus.sources.corpora import csv_text_cells


def _lines(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def order_tables(spark, sf_dir):
    """A spanning title row, a header row, the lines; every quantity is highlighted."""
    def cell(value, header, span=1):
        return F.struct(value.cast("string").alias("value"), F.lit(header).alias("is_header"), F.lit(span).alias("column_span"))

    title = F.array(cell(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), True, 3))
    names = F.array(cell(F.lit("line"), True), cell(F.lit("part"), True), cell(F.lit("quantity"), True))
    rows = F.transform(
        "lines", lambda x: F.array(cell(x["l_linenumber"], False), cell(x["l_partkey"], False), cell(x["q"], False))
    )
    return _lines(spark, sf_dir).select(
        "l_orderkey",
        F.concat(F.array(title), F.array(names), rows).alias("table"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("table_page_title"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("Lines")).otherwise("").alias("table_section_title"),
        F.transform(F.sequence(F.lit(2), F.size("lines") + 1), lambda r: F.array(r, F.lit(2))).alias("highlighted_cells"),
        F.transform("lines", lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("final_sentence"))).alias(
            "sentence_annotations"
        ),
    )


def table_highlights(spark, sf_dir):
    return L.highlighted(order_tables(spark, sf_dir)).select(
        "l_orderkey", "place", "value", F.concat_ws("|", "col_headers").alias("col_headers"), F.size("row_headers").alias("n_row_headers")
    )


def table_subtable_text(spark, sf_dir):
    return L.subtable_text(order_tables(spark, sf_dir)).select("l_orderkey", "text")


def table_full_text(spark, sf_dir):
    return L.full_table_text(order_tables(spark, sf_dir)).select("l_orderkey", "text")


def table_serialized(spark, sf_dir):
    """The form without titles, for the orders of customers with a positive balance."""
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    wanted = table(spark, sf_dir, "orders").join(good, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"))
    tables = L.picked(order_tables(spark, sf_dir), wanted, "l_orderkey")
    return L.serialized_tables(tables, with_metadata=False).select(
        "l_orderkey", "subtable_and_metadata", F.concat_ws("|", "final_sentence").alias("sentences")
    )


def _csv(spark, sf_dir):
    """Lines of each order as CSV text with an index field and quoted texts."""
    row = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("d"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("x"))
    text = F.transform(
        "x",
        lambda r, i: F.concat_ws(
            ",", i.cast("string"), r["l_linenumber"].cast("string"), r["l_quantity"].cast("string"), r["l_extendedprice"].cast("string"),
            F.concat(F.lit('"'), r["l_returnflag"], F.lit(', ""x"""')), r["d"],
        ),
    )
    return lines.select(
        "l_orderkey",
        F.concat(F.lit(",line,quantity,price,flag,shipped\n"), F.array_join(text, "\n")).alias("result"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("table_name"),
        F.lit("lines of an order").alias("query_description"),
    )


def csv_cells(spark, sf_dir):
    return csv_text_cells(_csv(spark, sf_dir), "l_orderkey", "result")


def csv_result_text(spark, sf_dir):
    return L.csv_result_text(_csv(spark, sf_dir), use_query=True).select("l_orderkey", "text")


def compact_result_text(spark, sf_dir):
    return L.csv_result_text(_csv(spark, sf_dir), use_query=True).select("l_orderkey", L.compact_text(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in [table_highlights, table_subtable_text, table_full_text, table_serialized, csv_cells, csv_result_text, compact_result_text]
}

_O = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"
_K = "CAST(l_orderkey AS VARCHAR)"
_TITLES = f"'<page_title> Order ' || {_K} || ' </page_title> ' || CASE WHEN l_orderkey % 2 = 0 THEN '<section_title> Lines </section_title> ' ELSE '' END"
_Q = "CAST(CAST(l_quantity AS INT) AS VARCHAR)"


def _cell(value, name, tag="cell"):
    return f"'<{tag}> ' || {value} || ' <col_header> order ' || {_K} || ' </col_header> <col_header> {name} </col_header> </{tag}> '"


_SUB = f"'<table> ' || string_agg({_cell(_Q, 'quantity')}, '' {_O}) || '</table>'"
_NUM = "CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_FIELDS = [
    ("line", "CAST(l_linenumber AS VARCHAR)", "NUMERIC"), ("quantity", _NUM.format(c="l_quantity"), "NUMERIC"),
    ("price", _NUM.format(c="l_extendedprice"), "NUMERIC"), ("flag", "l_returnflag || ', \"x\"'", "STRING"),
    ("shipped", "strftime(l_shipdate, '%d/%m/%Y')", "DATE"),
]
_CELLS = " || ".join(f"'<cell> ' || {v} || ' <col_header> {n} </col_header> </cell> '" for n, v, _ in _FIELDS)
_FO = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, strftime(l_shipdate, '%d/%m/%Y')"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey {_FO}) - 1 AS r FROM lineitem)"
_COMPACT = " || ".join(
    f"'<col' || CAST(5 * r + {i} AS VARCHAR) || '> {n} | {t} | ' || {v} || ' '" for i, (n, v, t) in enumerate(_FIELDS)
)

ORACLES = {
    "table_highlights": f"""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey {_O}) - 1 AS INT) AS place, {_Q} AS value,
        'order ' || {_K} || '|quantity' AS col_headers, 0 AS n_row_headers FROM lineitem""",
    "table_subtable_text": f"SELECT l_orderkey, {_TITLES} || {_SUB} AS text FROM lineitem GROUP BY l_orderkey",
    "table_full_text": f"""SELECT l_orderkey, {_TITLES} || '<table> <row> <cell> order ' || {_K} || ' </cell> </row> <row> <cell> line <col_header> order ' || {_K}
        || ' </col_header> </cell> <cell> part <col_header> order ' || {_K} || ' </col_header> <row_header> line </row_header> </cell> <cell> quantity <col_header> order '
        || {_K} || ' </col_header> <row_header> line </row_header> <row_header> part </row_header> </cell> </row> ' ||
        string_agg('<row> ' || {_cell('CAST(l_linenumber AS VARCHAR)', 'line')} || {_cell('CAST(l_partkey AS VARCHAR)', 'part')} ||
          {_cell(_Q, 'quantity', 'highlighted_cell')} || '</row> ', '' {_O}) || '</table>' AS text FROM lineitem GROUP BY l_orderkey""",
    "table_serialized": f"""SELECT l_orderkey, {_SUB} AS subtable_and_metadata, string_agg('part ' || CAST(l_partkey AS VARCHAR), '|' {_O}) AS sentences
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) GROUP BY l_orderkey""",
    "csv_cells": " UNION ALL ".join(
        f"SELECT l_orderkey, CAST(r AS INT) AS r, {i} AS c, '{n}' AS name, {v if n not in ('quantity', 'price') else 'CAST(' + ('l_quantity' if n == 'quantity' else 'l_extendedprice') + ' AS VARCHAR)'} AS value FROM {_RANKED}"
        for i, (n, v, _) in enumerate(_FIELDS)
    ),
    "csv_result_text": f"""SELECT l_orderkey, '<page_title> Order ' || {_K} || ' </page_title> <section_title> lines of an order </section_title> <table> ' ||
        string_agg({_CELLS}, '' {_FO}) || '</table>' AS text FROM lineitem GROUP BY l_orderkey""",
    "compact_result_text": f"""SELECT l_orderkey, '<query> lines of an order <table> Order ' || {_K} || ' ' || string_agg({_COMPACT}, '' ORDER BY r) AS text
        FROM {_RANKED} GROUP BY l_orderkey""",
}
