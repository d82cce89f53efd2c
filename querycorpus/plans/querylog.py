"""SQL text operators over a query log made from the parts, one text per part.

The oracles know the features of every template and never look into a text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.operators import profile as P
from querycorpus.operators import sqltext as X
from querycorpus.operators.sqltokens import tokenized
from querycorpus.plans.inputs import TEMPLATES, given, table, with_inputs

STAR = ["part", "lineitem", "supplier", "nation", "region"]
N = len(TEMPLATES)


def _log(spark, sf_dir):
    """The log spread over all cores: a small table arrives as one file and one task."""
    return given(spark, sf_dir, "query_log").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _columns(spark, sf_dir):
    return P.columns_of(spark, {t: table(spark, sf_dir, t) for t in STAR}, "star")


def sql_lowercase(spark, sf_dir):
    return _log(spark, sf_dir).select("query_id", X.lowercase_sql(F.col("sql")).alias("text"))


def sql_text_edits(spark, sf_dir):
    answer = F.concat(F.lit("Here:\n```SQL\n"), "sql", F.lit("\n```\ndone"))
    wide = F.concat(F.lit("  star | "), F.replace("sql", F.lit(" "), F.lit(" \n ")), F.lit(" "))
    from querycorpus.functions.text import squeeze

    return _log(spark, sf_dir).select(
        "query_id",
        squeeze(wide).alias("squeezed"),
        X.strip_db_id(F.concat(F.lit("star | "), "sql", F.lit(" | rest"))).alias("without_db"),
        X.strip_db_id(F.replace("sql", F.lit("|"), F.lit(""))).alias("no_separator"),
        F.trim(X.fenced_sql(answer)).alias("fenced"),
        X.fenced_sql(F.col("sql")).alias("unfenced"),
        X.spaced_names(F.concat(F.col("sql"), F.lit(" 'a_b.c'"))).alias("spaced"),
    )


def sql_explicit_order(spark, sf_dir):
    return tokenized(_log(spark, sf_dir)).select("query_id", X.explicit_order(F.col("tokens")).alias("text"))


def sql_without_table_aliases(spark, sf_dir):
    return tokenized(_log(spark, sf_dir)).select("query_id", X.without_table_aliases(F.col("tokens")).alias("text"))


def sql_select_edits(spark, sf_dir):
    return tokenized(_log(spark, sf_dir)).select(
        "query_id",
        X.without_select_aliases(F.col("tokens")).alias("without_aliases"),
        X.with_select_column(F.col("tokens"), "extra_id").alias("with_column"),
    )


def sql_companion_key(spark, sf_dir):
    """The key of the parts added where their name is selected."""
    return X.with_companion_column(_log(spark, sf_dir), "part", "p_name", "p_partkey").select("query_id", "with_key")


def sql_select_list(spark, sf_dir):
    listed = X.select_list(_log(spark, sf_dir))
    named = F.transform("aliases", lambda a: F.concat_ws("=", a["alias"], a["stands_for"]))
    return listed.select("query_id", F.concat_ws(";", "items").alias("items"), "has_star", F.concat_ws(";", named).alias("aliases"))


def sql_outer_features(spark, sf_dir):
    return X.outer_features(_log(spark, sf_dir)).select("query_id", "has_group_by", "has_order_by", "limit_value")


def sql_outer_tables(spark, sf_dir):
    found = X.outer_tables(_log(spark, sf_dir))
    shown = F.transform("tables", lambda e: F.concat_ws(" ", e["name"], e["alias"]))
    return found.select("query_id", F.concat_ws(",", shown).alias("tables"), X.has_outer_table(F.col("tables"), "part").alias("uses_part"))


def sql_structure(spark, sf_dir):
    return X.structure(_log(spark, sf_dir)).select(
        "query_id", "depth", "sibling", F.concat_ws(" ", "clauses", "nestings", "set_operators").alias("components")
    )


def sql_nesting(spark, sf_dir):
    return X.nesting_depth(_log(spark, sf_dir)).select("query_id", "depth", "subqueries")


def sql_operators(spark, sf_dir):
    return X.operator_counts(_log(spark, sf_dir)).select("query_id", "clause", "type", "member", "n")


def sql_variables(spark, sf_dir):
    return X.variables(_log(spark, sf_dir)).groupBy("template", "depth", "kind", F.concat_ws(".", "table_name", "name").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("kind <> 'values'")


def sql_values(spark, sf_dir):
    return X.variables(_log(spark, sf_dir)).where("kind = 'values'").select("query_id", "depth", "name")


def sql_equivalences(spark, sf_dir):
    return X.column_equivalences(_log(spark, sf_dir)).select("query_id", "column", "equals")


def sql_categories(spark, sf_dir):
    return X.categories(_log(spark, sf_dir)).select(
        "query_id", "structure_name", "structure_binary", "structure_counter", "operators_name", "operators_binary", "operators_counter", "category"
    )


def sql_sizes(spark, sf_dir):
    return X.sizes(_log(spark, sf_dir)).select("query_id", "columns_num", "conditions_num")


def sql_filter_values(spark, sf_dir):
    return X.filter_values(_log(spark, sf_dir), _columns(spark, sf_dir)).select("query_id", "table_name", "column", "operator", "value")


def sql_validity(spark, sf_dir):
    return X.validity(_log(spark, sf_dir), _columns(spark, sf_dir)).select("query_id", "is_valid")


def sql_first_valid(spark, sf_dir):
    """Candidates per part: its own text between two wrong ones."""
    log = _log(spark, sf_dir)
    asked = log.select(
        F.col("query_id").alias("question_id"),
        "db_id",
        F.array(F.lit("SELECT nope FROM part"), F.col("sql"), F.lit("SELECT p_name FROM part")).alias("candidates"),
    )
    return X.first_valid(asked, _columns(spark, sf_dir)).select("question_id", "prediction")


def sql_repaired(spark, sf_dir):
    return X.repaired_names(_log(spark, sf_dir), _columns(spark, sf_dir)).select("query_id", "repaired")


QUERIES = {
    f.__name__: f
    for f in [
        sql_lowercase, sql_text_edits, sql_explicit_order, sql_without_table_aliases, sql_select_edits, sql_companion_key, sql_select_list,
        sql_outer_features, sql_outer_tables, sql_structure, sql_nesting, sql_operators, sql_variables, sql_values,
        sql_equivalences, sql_categories, sql_sizes, sql_filter_values, sql_validity, sql_first_valid, sql_repaired,
    ]
}


def _fill(text: str) -> str:
    """SQL that builds a template text from the part row."""
    quoted = text.replace("'", "''")
    return (
        f"replace(replace(replace(replace('{quoted}', '{{name}}', p_name), '{{brand}}', p_brand), '{{size}}', CAST(p_size AS VARCHAR)), '~', chr(39))"
    )


def _by_template(texts: dict[int, str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if t is None else _fill(t)}" for i, t in texts.items())
    return f"CASE p_partkey % {N} {cases} END"


def _all(change=lambda t: t, **special) -> dict[int, str | None]:
    return {i: special.get(f"t{i}", None if i == 6 else change(t)) for i, t in enumerate(TEMPLATES)}


def _lower(t: str) -> str:
    return "~".join(x if k % 2 else x.lower() for k, x in enumerate(t.split("~")))


def _spaced(t: str) -> str:
    words = [w if w.startswith("~") else w.replace(".", " . ").replace("_", " _ ") for w in t.split()]
    return " ".join(words)


def _values(rows: list[tuple], names: str) -> str:
    def sql(v):
        return "NULL" if v is None else ("true" if v is True else "false" if v is False else repr(v))

    return f"(VALUES {', '.join('(' + ', '.join(sql(v) for v in r) + ')' for r in rows)}) w({names})"


def _join(rows: list[tuple], names: str, select: str) -> str:
    return f"SELECT p_partkey AS query_id, {select} FROM part JOIN {_values(rows, 't, ' + names)} ON p_partkey % {N} = t"


LISTS = [
    (0, "p_name", False, ""), (1, "p.p_name AS name;count(*)", False, "name=p_name"), (2, "p_name", False, ""), (3, "n_name", False, ""),
    (4, "*", True, ""), (5, "max(p_retailprice) - min(p_retailprice) AS spread", False, "spread=max"), (6, "", None, ""),
    (7, "s.s_name", False, ""), (8, "big.p_name", False, ""), (9, "p_nam", False, ""), (10, "p_brand;sum(p_size)", False, ""),
    (11, "p_type label;CASE WHEN p_size > {size} THEN ~big~ ELSE ~small~ END AS kind;p_retailprice::int", False, "label=p_type;kind=CASE WHEN p_size > {size} THEN ~big~ ELSE ~small~ END"),
    (12, "EXTRACT(YEAR FROM l_shipdate) AS y;sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS total", False, "y=extract;total=sum"),
    (13, "n_name", False, ""),
]
FEATURES = [
    (0, False, False), (1, True, True), (2, False, False), (3, False, False), (4, False, False), (5, False, True), (6, None, None),
    (7, False, False), (8, False, True), (9, False, False), (10, True, True),
    (11, False, False), (12, False, False), (13, False, False),
]
OUTER = [
    (0, "part", True), (1, "part p,lineitem l", True), (2, "part", True), (3, "nation", False), (4, "part,supplier", True), (5, "part", True),
    (6, "", None), (7, "supplier s,nation n", False), (8, "big", False), (9, "parts", False), (10, "part", True),
    (11, "part", True), (12, "lineitem", False), (13, "nation", False),
]
STRUCTURE = [
    (0, 0, 0, "select from where"),
    (1, 0, 0, "select from where groupby having orderby_desc_asc limit"),
    (2, 0, 0, "select from where nesting_where"), (2, 1, 0, "select from where"),
    (3, 0, 0, "select from select_1 from_1 where_1 union"),
    (4, 0, 0, "select from where"),
    (5, 0, 0, "select from where orderby_asc"),
    (7, 0, 0, "select from where nesting_where"), (7, 1, 0, "select from where nesting_where"), (7, 2, 0, "select from"),
    (8, 0, 0, "select from orderby_asc limit nesting_with"), (8, 1, 0, "select from where"),
    (9, 0, 0, "select from where"),
    (10, 0, 0, "select from groupby orderby_asc"),
    (11, 0, 0, "select from where"), (12, 0, 0, "select from where"), (13, 0, 0, "select from where orderby_asc limit select_1 from_1 union"),
]
NESTING = [(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, None, None), (7, 2, 2), (8, 1, 1), (9, 0, 0), (10, 0, 0), (11, 0, 0), (12, 0, 0), (13, 0, 0)]
OPERATORS = [
    (0, "where", "C", "eq", 1),
    (1, "select", "Ag", "count", 1), (1, "from", "J", "join", 1), (1, "from", "C", "eq", 1), (1, "where", "C", "eq", 1), (1, "where", "Lo", "and", 1),
    (1, "where", "C", "gt", 1), (1, "having", "Ag", "count", 1), (1, "having", "C", "gt", 1), (1, "orderby", "Ag", "count", 1),
    (2, "where", "Me", "in", 1), (2, "where", "C", "between", 1), (2, "where", "Lo", "or", 1), (2, "where", "Li", "like", 1),
    (3, "where", "Nu", "is not null", 1),
    (4, "from", "J", "join", 1), (4, "where", "Me", "nin", 1), (4, "where", "Lo", "and", 1), (4, "where", "Lo", "not", 1), (4, "where", "C", "lt", 1),
    (5, "select", "Ag", "max", 1), (5, "select", "Ag", "min", 1), (5, "select", "Ar", "sub", 1), (5, "where", "C", "eq", 1),
    (7, "from", "J", "left join", 1), (7, "from", "C", "eq", 1), (7, "where", "UnOp", "exists", 1), (7, "where", "C", "eq", 1), (7, "where", "Lo", "and", 2),
    (7, "where", "C", "gt", 1), (7, "select", "Ag", "avg", 1), (7, "where", "Li", "not_like", 1),
    (8, "where", "C", "gte", 1), (9, "where", "C", "eq", 1), (10, "select", "Ag", "sum", 1),
    (11, "select", "C", "gt", 1), (11, "where", "C", "gt", 1), (12, "select", "Ag", "sum", 1), (12, "where", "C", "gt", 1), (13, "where", "C", "neq", 1),
]
VARIABLES = [
    (0, 0, "tables", "part", 1), (0, 0, "columns", "part.p_name", 1), (0, 0, "columns", "part.p_size", 1),
    (1, 0, "tables", "part", 1), (1, 0, "tables", "lineitem", 1), (1, 0, "aliases", "p", 1), (1, 0, "aliases", "l", 1), (1, 0, "aliases", "name", 1),
    (1, 0, "columns", "part.p_name", 3), (1, 0, "columns", "part.p_partkey", 1), (1, 0, "columns", "lineitem.l_partkey", 1),
    (1, 0, "columns", "part.p_brand", 1), (1, 0, "columns", "lineitem.l_quantity", 1),
    (2, 0, "tables", "part", 1), (2, 1, "tables", "lineitem", 1), (2, 0, "columns", "part.p_name", 2), (2, 0, "columns", "part.p_partkey", 1),
    (2, 1, "columns", "lineitem.l_partkey", 1), (2, 1, "columns", "lineitem.l_quantity", 1),
    (3, 0, "tables", "nation", 1), (3, 0, "tables", "region", 1), (3, 0, "columns", "nation.n_name", 1), (3, 0, "columns", "region.r_name", 2),
    (4, 0, "tables", "part", 1), (4, 0, "tables", "supplier", 1), (4, 0, "columns", "p_size", 1), (4, 0, "columns", "s_acctbal", 1),
    (5, 0, "tables", "part", 1), (5, 0, "columns", "part.p_retailprice", 2), (5, 0, "columns", "part.p_name", 1), (5, 0, "columns", "part.spread", 1),
    (5, 0, "aliases", "spread", 1),
    (7, 0, "tables", "supplier", 1), (7, 0, "tables", "nation", 1), (7, 1, "tables", "lineitem", 1), (7, 2, "tables", "lineitem", 1),
    (7, 0, "aliases", "s", 1), (7, 0, "aliases", "n", 1), (7, 0, "columns", "supplier.s_name", 1), (7, 0, "columns", "supplier.s_nationkey", 1),
    (7, 0, "columns", "nation.n_nationkey", 1), (7, 0, "columns", "nation.n_name", 1), (7, 1, "columns", "lineitem.l_suppkey", 2),
    (7, 1, "columns", "supplier.s_suppkey", 1), (7, 1, "columns", "lineitem.l_quantity", 1), (7, 2, "columns", "lineitem.l_quantity", 1),
    (8, 0, "tables", "big", 1), (8, 1, "tables", "part", 1), (8, 1, "columns", "part.p_partkey", 1), (8, 1, "columns", "part.p_name", 1),
    (8, 1, "columns", "part.p_size", 1), (8, 0, "columns", "big.p_name", 2),
    (9, 0, "tables", "parts", 1), (9, 0, "columns", "parts.p_nam", 1), (9, 0, "columns", "parts.p_sizes", 1),
    (10, 0, "tables", "part", 1), (10, 0, "columns", "part.p_brand", 3), (10, 0, "columns", "part.p_size", 1),
    (11, 0, "tables", "part", 1), (11, 0, "aliases", "label", 1), (11, 0, "aliases", "kind", 1), (11, 0, "columns", "part.p_type", 1),
    (11, 0, "columns", "part.p_size", 1), (11, 0, "columns", "part.p_retailprice", 2),
    (12, 0, "tables", "lineitem", 1), (12, 0, "aliases", "y", 1), (12, 0, "aliases", "total", 1), (12, 0, "columns", "lineitem.l_shipdate", 1),
    (12, 0, "columns", "lineitem.l_quantity", 2), (12, 0, "columns", "lineitem.l_partkey", 1), (12, 0, "columns", "lineitem.l_linenumber", 1),
    (13, 0, "tables", "nation", 1), (13, 0, "tables", "region", 1), (13, 0, "columns", "nation.n_name", 3), (13, 0, "columns", "region.r_name", 1),
]
VALUES = [
    (0, 0, "{size}"), (1, 0, "{brand}"), (1, 0, "{size}"), (1, 0, "2"), (2, 1, "1"), (2, 1, "{size}"), (2, 0, "%{name}%"), (4, 0, "{size}"), (4, 0, "7"),
    (4, 0, "10"), (5, 0, "FROM {name}"), (7, 0, "NATION_{size}"), (8, 1, "{size}"), (9, 0, "{size}"),
    (11, 0, "{size}"), (11, 0, "big"), (11, 0, "small"), (11, 0, "15e2"), (12, 0, "-1"), (13, 0, "{name}"),
]
EQUAL = [
    (1, "part.p_partkey", "lineitem.l_partkey"), (1, "lineitem.l_partkey", "part.p_partkey"),
    (7, "supplier.s_nationkey", "nation.n_nationkey"), (7, "nation.n_nationkey", "supplier.s_nationkey"),
    (7, "lineitem.l_suppkey", "supplier.s_suppkey"), (7, "supplier.s_suppkey", "lineitem.l_suppkey"),
]
CATEGORIES = [
    (0, "S-F-W", "1.1.1.0.0.0.0.0.0", "C", "0.0.1.0.0.0.0.0.0.0"),
    (1, "S-F-W-G-H-O-L", "1.1.1.1.1.1.1.0.0", "J-Ag-C-Lo", "1.3.4.1.0.0.0.0.0.0"),
    (2, "S-F-W-N", "2.2.2.0.0.0.0.0.1", "C-Lo-Li-Me", "0.0.1.1.1.0.1.0.0.0"),
    (3, "S-F-W-SO", "2.2.1.0.0.0.0.1.0", "Nu", "0.0.0.0.0.0.0.1.0.0"),
    (4, "S-F-W", "1.1.1.0.0.0.0.0.0", "J-C-Lo-Me", "1.0.1.2.0.0.1.0.0.0"),
    (5, "S-F-W-O", "1.1.1.0.0.1.0.0.0", "Ag-C-Ar", "0.2.1.0.0.1.0.0.0.0"),
    (6, None, None, None, None),
    (7, "S-F-W-N", "3.3.2.0.0.0.0.0.2", "J-Ag-C-Lo-Li-UnOp", "1.1.3.2.1.0.0.0.1.0"),
    (8, "S-F-W-O-L-N", "2.2.1.0.0.1.1.0.1", "C", "0.0.1.0.0.0.0.0.0.0"),
    (9, "S-F-W", "1.1.1.0.0.0.0.0.0", "C", "0.0.1.0.0.0.0.0.0.0"),
    (10, "S-F-G-O", "1.1.0.1.0.1.0.0.0", "Ag", "0.1.0.0.0.0.0.0.0.0"),
    (11, "S-F-W", "1.1.1.0.0.0.0.0.0", "C", "0.0.2.0.0.0.0.0.0.0"),
    (12, "S-F-W", "1.1.1.0.0.0.0.0.0", "Ag-C", "0.1.1.0.0.0.0.0.0.0"),
    (13, "S-F-W-O-L-SO", "2.2.1.0.0.1.1.1.0", "C", "0.0.1.0.0.0.0.0.0.0"),
]
SIZES = [(0, 1, 1), (1, 2, 3), (2, 1, 3), (3, 1, 0), (4, None, 4), (5, 1, 1), (6, None, None), (7, 1, 3), (8, 1, 0), (9, 1, 1), (10, 2, 0), (11, 3, 1), (12, 2, 1), (13, 1, 1)]
FILTERS = [
    (0, "part", "p_size", "=", "{size}"), (1, "part", "p_brand", "=", "{brand}"), (1, "lineitem", "l_quantity", ">", "{size}"),
    (2, "part", "p_name", "like", "%{name}%"), (4, "part", "p_size", "not in", "{size}"), (4, "part", "p_size", "not in", "7"),
    (4, "supplier", "s_acctbal", "<", "10"), (5, "part", "p_name", "=", "FROM {name}"), (7, "nation", "n_name", "not like", "NATION_{size}"),
    (8, "part", "p_size", ">=", "{size}"), (9, "parts", "p_sizes", "=", "{size}"),
    (11, "part", "p_size", ">", "{size}"), (11, "part", "p_retailprice", ">", "15e2"), (12, "lineitem", "l_quantity", ">", "-1"),
    (13, "nation", "n_name", "<>", "{name}"),
]
INVALID = "(6, 8, 9)"


def _filled(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '{{name}}', p_name), '{{brand}}', p_brand), '{{size}}', CAST(p_size AS VARCHAR)), '~', chr(39))"


def _binary(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '[1-9]', '1', 'g'), '\\.', '', 'g')"


_PLAIN = _by_template({i: t for i, t in enumerate(TEMPLATES)})
_ASC = _all(
    t1=TEMPLATES[1].replace("p.p_name LIMIT", "p.p_name asc LIMIT"), t5=TEMPLATES[5] + " asc",
    t8=TEMPLATES[8].replace("big.p_name LIMIT", "big.p_name asc LIMIT"), t13=TEMPLATES[13].replace("n_name LIMIT", "n_name asc LIMIT"),
)
_NO_TABLE_ALIAS = _all(
    t1=TEMPLATES[1].replace("part AS p", "part").replace("lineitem AS l", "lineitem").replace("p.p_", "part.p_").replace("l.l_", "lineitem.l_"),
    t7=TEMPLATES[7].replace("supplier s", "supplier").replace("nation n ", "nation ").replace("s.s_", "supplier.s_").replace("n.n_", "nation.n_"),
)
_NO_SELECT_ALIAS = _all(t1=TEMPLATES[1].replace(" AS name", ""), t11=TEMPLATES[11].replace(" label", ""))
_REPAIRED = {i: t for i, t in enumerate(TEMPLATES)} | {9: "SELECT p_name FROM part WHERE p_size = {size}"}


def _extra(t: str) -> str:
    # The FROM of a named query or of EXTRACT is not the outer one.
    at = t.index(") SELECT") if t.startswith("WITH") else t.index(" AS y") if "EXTRACT" in t else 0
    word = " FROM " if " FROM " in t else " from "
    cut = t.index(word, at)
    return t[:cut] + ", extra_id" + t[cut:]


ORACLES = {
    "sql_lowercase": f"SELECT p_partkey AS query_id, {_by_template({i: _lower(t) for i, t in enumerate(TEMPLATES)})} AS text FROM part",
    "sql_text_edits": f"""SELECT p_partkey AS query_id, 'star | ' || t AS squeezed, t || ' | rest' AS without_db, CAST(NULL AS VARCHAR) AS no_separator,
        chr(10) || t || chr(10) AS fenced, t AS unfenced, {_by_template({i: _spaced(t) for i, t in enumerate(TEMPLATES)})} || ' ''a_b.c''' AS spaced
        FROM (SELECT *, {_PLAIN} AS t FROM part)""",
    "sql_explicit_order": f"SELECT p_partkey AS query_id, {_by_template(_ASC)} AS text FROM part",
    "sql_without_table_aliases": f"SELECT p_partkey AS query_id, {_by_template(_NO_TABLE_ALIAS)} AS text FROM part",
    "sql_select_edits": f"""SELECT p_partkey AS query_id, {_by_template(_NO_SELECT_ALIAS)} AS without_aliases,
        {_by_template(_all(_extra))} AS with_column FROM part""",
    "sql_companion_key": with_inputs(
        ["query_log"],
        """SELECT query_id, CASE template WHEN 1 THEN replace(sql, ' FROM part AS', ', p.p_partkey FROM part AS') WHEN 6 THEN NULL
             WHEN 0 THEN replace(sql, ' FROM part', ', p_partkey FROM part') WHEN 2 THEN replace(sql, ' FROM part', ', p_partkey FROM part') ELSE sql END AS with_key
           FROM query_log""",
    ),
    "sql_select_list": _join(LISTS, "items, has_star, aliases", f"{_filled('items')} AS items, has_star, {_filled('aliases')} AS aliases"),
    "sql_outer_features": _join(
        FEATURES, "g, o", f"g AS has_group_by, o AS has_order_by, CASE WHEN t = 1 THEN CAST(p_size AS BIGINT) WHEN t = 8 THEN 5 END AS limit_value"
    ),
    "sql_outer_tables": _join(OUTER, "tables, uses_part", "tables, uses_part"),
    "sql_structure": _join(STRUCTURE, "depth, sibling, components", "depth, sibling, components"),
    "sql_nesting": _join(NESTING, "depth, subqueries", "depth, subqueries"),
    "sql_operators": _join(OPERATORS, "clause, type, member, n", "clause, type, member, CAST(n AS BIGINT) AS n"),
    "sql_variables": f"""SELECT t AS template, depth, kind, name, CAST(any_value(k) * count(*) AS BIGINT) AS n
        FROM part JOIN {_values(VARIABLES, "t, depth, kind, name, k")} ON p_partkey % {N} = t GROUP BY t, depth, kind, name""",
    "sql_values": _join(VALUES, "depth, v", f"depth, {_filled('v')} AS name"),
    "sql_equivalences": _join(EQUAL, "a, b", 'a AS "column", b AS equals'),
    "sql_categories": _join(
        CATEGORIES,
        "sn, sc, op_n, oc",
        f"sn AS structure_name, {_binary('sc')} AS structure_binary, sc AS structure_counter, op_n AS operators_name,"
        f" {_binary('oc')} AS operators_binary, oc AS operators_counter, sn || '-' || op_n AS category",
    ),
    "sql_sizes": _join(SIZES, "c, k", "c AS columns_num, k AS conditions_num"),
    "sql_filter_values": f"SELECT DISTINCT * FROM ({_join(FILTERS, 'tn, c, o, v', 'tn AS table_name, c AS column_, o AS operator, ' + _filled('v') + ' AS value')})".replace(
        "SELECT DISTINCT *", 'SELECT DISTINCT query_id, table_name, column_ AS "column", operator, value'
    ),
    "sql_validity": f"SELECT p_partkey AS query_id, p_partkey % {N} NOT IN {INVALID} AS is_valid FROM part",
    "sql_first_valid": f"""SELECT p_partkey AS question_id, CASE WHEN p_partkey % {N} IN {INVALID} THEN 'SELECT p_name FROM part' ELSE {_PLAIN} END AS prediction
        FROM part""",
    "sql_repaired": f"SELECT p_partkey AS query_id, {_by_template(_REPAIRED)} AS repaired FROM part",
}
