"""Tables and query results as tagged text.

An annotated table arrives as one record: ``table`` (rows of cells ``value, is_header,
column_span``), ``table_page_title``, ``table_section_title``, ``highlighted_cells`` ([row, column]
pairs). All steps stay inside the record, so no shuffle is needed however the records are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.arrays import held, once, pinned
from querycorpus.sources.corpora import csv_fields, csv_records

# Forms of numbers and of dates in cells.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)\s*$"
DATE_FORMATS = [
    ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"),
    ("yyyy/MM/dd", r"^\d{4}/\d\d/\d\d$"),
    ("dd/MM/yyyy", r"^\d\d/\d\d/\d{4}$"),
    ("MM/dd/yyyy", r"^\d\d/\d\d/\d{4}$"),
    ("dd-MM-yyyy", r"^\d\d-\d\d-\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]+ \d\d?, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d\d?, \d{4}$"),
    ("d MMMM yyyy", r"^\d\d? [A-Z][a-z]+ \d{4}$"),
    ("d MMM yyyy", r"^\d\d? [A-Z][a-z]{2} \d{4}$"),
    ("MMMM yyyy", r"^[A-Z][a-z]+ \d{4}$"),
    ("MMM yyyy", r"^[A-Z][a-z]{2} \d{4}$"),
    ("HH:mm:ss", r"^\d\d:\d\d:\d\d$"),
    ("HH:mm", r"^\d\d:\d\d$"),
]


def placed_cells(table: Column) -> Column:
    """Rows of ``struct<value, is_header, r, c, start, end>`` with real column offsets from the spans."""
    def row(cells: Column, r: Column) -> Column:
        def cell(x: Column, c: Column) -> Column:
            start = F.aggregate(F.slice(cells, F.lit(1), c), F.lit(0), lambda a, y: a + y["column_span"])
            return F.struct(
                x["value"].alias("value"),
                x["is_header"].alias("is_header"),
                r.cast("int").alias("r"),
                c.cast("int").alias("c"),
                start.alias("start"),
                (start + x["column_span"]).alias("end"),
            )

        return F.transform(cells, cell)

    return F.transform(table, row)


def _with_cells(df: DataFrame) -> DataFrame:
    placed = pinned(df, "_cells", placed_cells(F.col("table")))
    return pinned(placed, "_headers", F.filter(F.flatten("_cells"), lambda x: x["is_header"]))


def row_headers(cell: Column) -> Column:
    """Header cells to the left in the same row."""
    return F.filter("_headers", lambda h: (h["r"] == cell["r"]) & (h["c"] < cell["c"]))


def column_headers(cell: Column) -> Column:
    """Header cells of earlier rows whose columns overlap the cell."""
    return F.filter(
        "_headers", lambda h: (h["r"] < cell["r"]) & (h["start"] < cell["end"]) & (h["end"] > cell["start"])
    )


def _tagged(headers: Column, tag: str) -> Column:
    return F.array_join(
        F.transform(headers, lambda h: F.concat(F.lit(f"<{tag}> "), h["value"], F.lit(f" </{tag}> "))), ""
    )


def _cell_text(cell: Column, headers: bool, tag: Column | str = "cell") -> Column:
    name = F.lit(tag) if isinstance(tag, str) else tag
    parts = [_tagged(column_headers(cell), "col_header"), _tagged(row_headers(cell), "row_header")] if headers else []
    return F.concat(F.lit("<"), name, F.lit("> "), cell["value"], F.lit(" "), *parts, F.lit("</"), name, F.lit("> "))


def _titles(with_titles: bool) -> Column:
    def title(column: str, tag: str) -> Column:
        return F.when(
            F.coalesce(F.length(column), F.lit(0)) > 0, F.concat(F.lit(f"<{tag}> "), column, F.lit(f" </{tag}> "))
        ).otherwise("")

    if not with_titles:
        return F.lit("")
    return F.concat(title("table_page_title", "page_title"), title("table_section_title", "section_title"))


def highlighted(df: DataFrame) -> DataFrame:
    """Highlighted cells in their given order with their headers, one row per cell."""
    found = F.transform(
        "highlighted_cells", lambda at: F.try_element_at(F.try_element_at(F.col("_cells"), at[0] + 1), at[1] + 1)
    )
    rows = _with_cells(df).select(*df.columns, "_headers", F.posexplode(found).alias("place", "cell"))
    return rows.select(
        *df.columns,
        "place",
        F.col("cell.r").alias("r"),
        F.col("cell.c").alias("c"),
        F.col("cell.value").alias("value"),
        F.transform(column_headers(F.col("cell")), lambda h: h["value"]).alias("col_headers"),
        F.transform(row_headers(F.col("cell")), lambda h: h["value"]).alias("row_headers"),
    )


def subtable_text(df: DataFrame, with_titles: bool = True, with_headers: bool = True) -> DataFrame:
    """Add ``text``: the highlighted cells with their headers."""
    cells = F.transform(
        "highlighted_cells",
        lambda at: _cell_text(
            F.try_element_at(F.try_element_at(F.col("_cells"), at[0] + 1), at[1] + 1), with_headers
        ),
    )
    text = F.concat(_titles(with_titles), F.lit("<table> "), F.array_join(cells, ""), F.lit("</table>"))
    return _with_cells(df).withColumn("text", held(F.col("_headers"), held(F.col("_cells"), text))).drop("_cells", "_headers")


def full_table_text(df: DataFrame, with_titles: bool = True) -> DataFrame:
    """Add ``text``: the whole table row by row, highlighted cells marked."""
    def tag(cell: Column) -> Column:
        marked = F.exists("highlighted_cells", lambda at: (at[0] == cell["r"]) & (at[1] == cell["c"]))
        return F.when(marked, F.lit("highlighted_cell")).otherwise(F.lit("cell"))

    def row(cells: Column) -> Column:
        return F.concat(
            F.lit("<row> "), F.array_join(F.transform(cells, lambda x: _cell_text(x, True, tag(x))), ""), F.lit("</row> ")
        )

    text = F.concat(
        _titles(with_titles), F.lit("<table> "), F.array_join(F.transform("_cells", row), ""), F.lit("</table>")
    )
    return _with_cells(df).withColumn("text", held(F.col("_headers"), held(F.col("_cells"), text))).drop("_cells", "_headers")


def serialized_tables(df: DataFrame, full_table: bool = False, with_metadata: bool = True) -> DataFrame:
    """One of the four forms with the final sentences of the annotations beside it."""
    shown = full_table_text(df, with_metadata) if full_table else subtable_text(df, with_metadata)
    sentences = F.transform("sentence_annotations", lambda a: a["final_sentence"])
    return shown.withColumnRenamed("text", "subtable_and_metadata").withColumn("final_sentence", sentences)


def picked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The records whose key is in a list of keys."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


# --- query results ------------------------------------------------------------------------


def csv_result_text(df: DataFrame, use_query: bool = False) -> DataFrame:
    """Add ``text`` for results held as CSV text in ``result`` (first field of a line is an index).

    A column is numeric if all its values are; its whole numbers are shown without a fraction.
    """
    lines = F.transform(csv_records(F.col("result")), lambda r: csv_fields(r))
    base = pinned(df, "_lines", lines)
    base = pinned(base, "_rows", F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))))
    header = F.try_element_at(F.col("_lines"), F.lit(1))
    width = F.greatest(F.size(header), F.lit(1))
    numeric = F.transform(
        F.sequence(F.lit(1), width),
        lambda c: F.forall("_rows", lambda r: F.coalesce(F.try_element_at(r, c).rlike(NUMBER) | (F.try_element_at(r, c) == ""), F.lit(False))),
    )
    base = pinned(base, "_numeric", numeric)

    def shown(value: Column, c: Column) -> Column:
        def number_text(number: Column) -> Column:
            whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
            return F.when(number.isNotNull(), whole).otherwise(F.lit("nan"))

        return F.when(F.get("_numeric", c), once(value.try_cast("double"), number_text)).otherwise(value)

    cells = F.flatten(
        F.transform(
            "_rows",
            lambda r: F.transform(
                F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
                lambda v, c: F.concat(
                    F.lit("<cell> "), shown(v, c + 1), F.lit(" <col_header> "),
                    F.get(F.try_element_at(F.col("_lines"), F.lit(1)), c + 1), F.lit(" </col_header> </cell> "),
                ),
            ),
        )
    )
    section = F.col("query_description") if use_query else F.col("table_name")
    text = F.concat(
        F.lit("<page_title> "), "table_name", F.lit(" </page_title> <section_title> "), section,
        F.lit(" </section_title> <table> "), F.array_join(cells, ""), F.lit("</table>"),
    )
    ready = held(F.col("_rows"), held(F.col("_numeric"), held(F.col("_lines"), text)))
    return base.withColumn("text", ready).drop("_lines", "_rows", "_numeric")


def cell_type(value: Column) -> Column:
    """NUMERIC, DATE or STRING by the look of a cell; dates by a stated list of forms."""
    number = F.replace(value, F.lit(",")).rlike(NUMBER) | F.translate(value, " -", "").rlike(NUMBER)
    dated = [value.rlike(shape) & F.try_to_timestamp(value, F.lit(form)).isNotNull() for form, shape in DATE_FORMATS]
    return F.when(number, "NUMERIC").when(reduce(lambda a, b: a | b, dated), "DATE").otherwise("STRING")


def compact_text(text: Column) -> Column:
    """Tagged text as ``<query> .. <table> .. <col0> name | type | value``."""
    page = F.regexp_extract(text, r"<page_title> (.*) </page_title>", 1)
    section = F.regexp_extract(text, r"<section_title> (.*) </section_title>", 1)
    cells = F.regexp_extract_all(text, F.lit(r"<cell> (.*?) </cell>"), F.lit(1))

    def one(cell: Column, i: Column) -> Column:
        value = F.when(cell.contains(" <col_header>"), F.regexp_extract(cell, r"(.*) <col_header>", 1)).otherwise(cell)
        name = F.regexp_extract(cell, r"<col_header> (.*) </col_header>", 1)
        return F.concat(
            F.lit("<col"), i.cast("string"), F.lit("> "), name, F.lit(" | "),
            once(value, lambda v: F.concat(cell_type(v), F.lit(" | "), v)), F.lit(" "),
        )

    return F.concat(
        F.lit("<query> "), section, F.lit(" <table> "), page, F.lit(" "), F.array_join(F.transform(cells, one), "")
    )


def cells_of_text(text: Column) -> Column:
    """``array<struct<value, name>>`` read back from tagged text."""
    cells = F.regexp_extract_all(text, F.lit(r"<cell> (.*?) </cell>"), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.struct(
            F.when(c.contains(" <col_header>"), F.regexp_extract(c, r"(.*?) <col_header>", 1)).otherwise(c).alias("value"),
            F.regexp_extract(c, r"<col_header> (.*?) </col_header>", 1).alias("name"),
        ),
    )
