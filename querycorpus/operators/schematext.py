"""Schemas as text in four forms.

Each form is two ordered aggregations: column texts per table, then table texts per
database. A list is as long as a table is wide or a database has tables: the text of a database is one value at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.operators.profile import shown_values

# Longest shown sample value.
VALUE_LENGTH = 30


def _ordered(order: list[str | Column], text: Column, separator: str) -> Column:
    keys = [F.col(o).alias(f"k{i}") if isinstance(o, str) else o.alias(f"k{i}") for i, o in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*keys, text.alias("text"))))
    return F.concat_ws(separator, items["text"])


def _in_order(columns: DataFrame) -> DataFrame:
    return columns if "table_ordinal" in columns.columns else columns.withColumn("table_ordinal", F.col("table_name"))


def value_texts(values: Column, data_type: Column) -> Column:
    """Values as they are shown: texts quoted and cut after 30 characters, numbers bare. Quotes of both kinds, backslashes,
    line ends and tabs are escaped."""
    numeric = F.upper(data_type).rlike("^(TINY|SMALL|BIG)?INT|^INTEGER|^DOUBLE|^FLOAT|^REAL|^DECIMAL|^NUMERIC")

    def shown(v: Column) -> Column:
        cut = F.when(F.length(v) > VALUE_LENGTH, F.concat(F.substring(v, 1, VALUE_LENGTH), F.lit("..."))).otherwise(v)
        quote = F.when(cut.contains("'") & ~cut.contains('"'), F.lit('"')).otherwise(F.lit("'"))
        inner = cut
        for mark, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            inner = F.replace(inner, F.lit(mark), F.lit(escape))
        inner = F.when(quote == "'", F.replace(inner, F.lit("'"), F.lit("\\'"))).otherwise(inner)
        return F.when(numeric, v).otherwise(F.concat(quote, inner, quote))

    return F.transform(values, shown)


def value_sequence(values: Column, data_type: Column) -> Column:
    return F.concat(F.lit("values : "), F.concat_ws(" , ", value_texts(values, data_type)))


def _parts(columns: DataFrame, n_values: int, threshold: int | None, notes: bool, keys: bool) -> DataFrame:
    """Columns with the optional parts of their text as nullable columns."""
    picked = shown_values(F.coalesce("values", F.array().cast("array<string>")), n_values, threshold)
    return (
        _in_order(columns)
        .withColumn("_values", picked)
        .withColumn("_has_values", (F.size("_values") > 0) & F.lit(n_values != 0))
        .withColumn("_note", F.when(F.lit(notes), F.col("note")))
        .withColumn("_table_note", F.when(F.lit(notes), F.col("table_note")))
        .withColumn("_pk", F.col("is_pk") & F.lit(keys))
    )


def _tables(parts: DataFrame, column_text: Column, separator: str) -> DataFrame:
    return parts.groupBy("db_id", "table_ordinal", "table_name").agg(
        F.first("_table_note").alias("_table_note"), _ordered(["ordinal"], column_text, separator).alias("_columns")
    )


def _pair(equals: str) -> Column:
    return F.concat(
        "table_name", F.lit("."), "column", F.lit(equals), "foreign_table", F.lit("."), "foreign_column"
    )


def _assemble(tables: DataFrame, table_text: Column, separator: str, fks: DataFrame | None, pair: Column, head: str, line: str) -> DataFrame:
    """``db_id, schema_text``: one row per database, whatever its size: table texts, then the foreign keys."""
    body = tables.groupBy("db_id").agg(_ordered(["table_ordinal", "table_name"], table_text, separator).alias("schema_text"))
    if fks is None:
        return body
    keys = fks.groupBy("db_id").agg(_ordered(["table_name", "column", "foreign_table", "foreign_column"], pair, line).alias("_keys"))
    text = F.concat("schema_text", F.coalesce(F.concat(F.lit(head), F.col("_keys")), F.lit("")))
    return body.join(keys, "db_id", "left").select("db_id", text.alias("schema_text"))


def one_line(
    columns: DataFrame,
    fks: DataFrame | None = None,
    with_db_id: bool = False,
    links: DataFrame | None = None,
    db_separator: str = " | ",
    table_separator: str = " | ",
    opening: str = " : ",
    closing: str = "",
    column_separator: str = " , ",
    relation_separator: str = " , ",
    value_separator: str = ", ",
    value_opening: str = "(",
    value_closing: str = ")",
) -> DataFrame:
    """``db | t1 : a , b (v1, v2) | t2 : c | t1.a = t2.c``.

    ``links`` holds ``(db_id, table_name, column, values)`` found for the columns.
    """
    named = _in_order(columns)
    if links is not None:
        named = named.join(
            links.select("db_id", "table_name", "column", F.col("values").alias("_linked")),
            ["db_id", "table_name", "column"],
            "left",
        )
        linked = F.concat(
            F.col("column"), F.lit(f" {value_opening}"), F.concat_ws(value_separator, "_linked"), F.lit(value_closing)
        )
        text = F.when(F.col("_linked").isNull(), F.col("column")).otherwise(linked)
    else:
        text = F.col("column")
    tables = named.groupBy("db_id", "table_ordinal", "table_name").agg(
        _ordered(["ordinal"], text, column_separator).alias("_columns")
    )
    table_text = F.concat("table_name", F.lit(opening), "_columns", F.lit(closing))
    out = _assemble(tables, table_text, table_separator, fks, _pair(" = "), table_separator, relation_separator)
    if with_db_id:
        out = out.withColumn("schema_text", F.concat("db_id", F.lit(db_separator), "schema_text"))
    return out


def compact(
    columns: DataFrame,
    fks: DataFrame | None = None,
    n_values: int = 0,
    threshold: int | None = None,
    notes: bool = True,
    keys: bool = True,
) -> DataFrame:
    """``table t ( comment : N ) , columns = [ t.a ( INT | primary key | ... ) , ... ]`` per line."""
    parts = _parts(columns, n_values, threshold, notes, keys)
    info = F.concat_ws(
        " | ",
        F.col("data_type"),
        F.when(F.col("_pk"), F.lit("primary key")),
        F.concat(F.lit("comment : "), F.col("_note")),
        F.when(F.col("_has_values"), value_sequence(F.col("_values"), F.col("data_type"))),
    )
    column_text = F.concat("table_name", F.lit("."), "column", F.lit(" ( "), info, F.lit(" )"))
    tables = _tables(parts, column_text, " , ")
    note = F.coalesce(F.concat(F.lit(" ( comment : "), F.col("_table_note"), F.lit(" )")), F.lit(""))
    table_text = F.concat(F.lit("table "), "table_name", note, F.lit(" , columns = [ "), "_columns", F.lit(" ]"))
    return _assemble(tables, table_text, "\n", fks, _pair(" = "), "\nforeign keys :\n", "\n")


def ddl(
    columns: DataFrame,
    fks: DataFrame | None = None,
    n_values: int = 0,
    threshold: int | None = None,
    notes: bool = True,
    keys: bool = True,
) -> DataFrame:
    """CREATE TABLE texts with notes, values and foreign keys as comments."""
    parts = _parts(columns, n_values, threshold, notes, keys)
    extra = F.concat_ws(
        ", ",
        F.concat(F.lit("comment : "), F.col("_note")),
        F.when(F.col("_has_values"), value_sequence(F.col("_values"), F.col("data_type"))),
    )
    column_text = F.concat(
        F.lit("\t"),
        "column",
        F.lit(" "),
        "data_type",
        F.when(F.col("_pk"), F.lit(" primary key")).otherwise(F.lit("")),
        F.lit(","),
        F.when(extra != "", F.concat(F.lit(" -- "), extra)).otherwise(F.lit("")),
    )
    tables = _tables(parts, column_text, "\n")
    note = F.coalesce(F.concat(F.lit(" -- "), F.col("_table_note")), F.lit(""))
    table_text = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" ("), note, F.lit("\n"), "_columns", F.lit("\n);"))
    head = "\n\n-- Also take into account the following foreign keys :\n"
    return _assemble(tables, table_text, "\n\n", fks, F.concat(F.lit("-- "), _pair(" = ")), head, "\n")


def m_schema(
    columns: DataFrame,
    fks: DataFrame | None = None,
    n_values: int = 0,
    threshold: int | None = None,
    notes: bool = True,
    keys: bool = True,
) -> DataFrame:
    """The form with ``# Table:`` sections, types without length, keys and examples."""
    parts = _parts(columns, n_values, threshold, notes, keys)
    column_text = F.concat(
        F.lit("("),
        "column",
        F.lit(":"),
        F.upper(F.substring_index("data_type", "(", 1)),
        F.coalesce(F.concat(F.lit(", "), F.trim("_note")), F.lit("")),
        F.when(F.col("_pk"), F.lit(", Primary Key")).otherwise(F.lit("")),
        F.when(
            F.col("_has_values"),
            F.concat(
                F.lit(", Examples: ["),
                F.concat_ws(", ", value_texts(F.slice("_values", 1, max(n_values, 1)), F.col("data_type"))),
                F.lit("]"),
            ),
        ).otherwise(F.lit("")),
        F.lit(")"),
    )
    tables = _tables(parts, column_text, ",\n")
    note = F.coalesce(F.concat(F.lit(", "), F.col("_table_note")), F.lit(""))
    table_text = F.concat(F.lit("# Table: "), "table_name", note, F.lit("\n[\n"), "_columns", F.lit("\n]"))
    out = _assemble(tables, table_text, "\n", fks, _pair("="), "\n【Foreign keys】\n", "\n")
    titled = F.concat(F.lit("【DB_ID】 "), "db_id", F.lit("\n【Schema】\n"), "schema_text")
    return out.withColumn("schema_text", titled)


FORMS = {"compact": compact, "ddl": ddl, "m-schema": m_schema}


def schema_text(columns: DataFrame, form: str = "ddl", **options) -> DataFrame:
    if form not in FORMS:
        raise ValueError(f"schema form {form!r} is not one of {sorted(FORMS)}")
    return FORMS[form](columns, **options)
