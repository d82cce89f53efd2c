"""Clean, edit, classify and check SQL texts of a query log.

Everything that looks at one text works inside its row on the annotated tokens of
:mod:`sqltokens`. Joins appear only where a catalog is consulted. Not covered, and given as null:
texts that open with neither SELECT nor WITH, and vendor clauses. Comments count as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.arrays import held, once, pinned
from querycorpus.functions.scale import by_shuffle, cut_lineage, dealt_join
from querycorpus.operators.linking import similar_pairs
from querycorpus.operators.sqltokens import (
    QUOTED,
    bare_alias,
    is_alias,
    is_column,
    is_function,
    is_literal,
    is_name,
    names_table,
    own_columns,
    owner_of,
    signed,
    table_entries,
    tokenized,
    unquoted,
)

# Clause order and letters, operator members by type, and their order in a category.
CLAUSE_LETTERS = {
    "select": "S", "from": "F", "where": "W", "groupby": "G", "having": "H", "orderby": "O", "limit": "L",
}
STRUCTURE_ORDER = ["S", "F", "W", "G", "H", "O", "L", "SO", "N"]
OPERATOR_ORDER = ["J", "Ag", "C", "Lo", "Li", "Ar", "Me", "Nu", "UnOp", "BiOp"]
AGGREGATES = ["count", "min", "max", "sum", "avg"]
COMPARISONS = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "==": "eq", "!=": "neq", "<>": "neq"}
ARITHMETIC = {"-": "sub", "+": "add", "*": "mul", "/": "div"}
UNARY_FUNCTIONS = ["length", "any", "all", "exists"]
BINARY_FUNCTIONS = ["date_part", "date_sub", "string_to_array"]
#: Similarities at which unknown names are sought, one after the other.
NAME_RADII = [0.7, 0.4, 0.2, 0.1]
FILTER_OPERATORS = ["=", "!=", "<>", "<", "<=", ">", ">=", "like"]


# --- one text ---------------------------------------------------------------------------


def lowercase_sql(sql: Column) -> Column:
    """Lower-case keywords and names; single- and double-quoted text stays."""
    runs = F.regexp_extract_all(sql, F.lit(r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+"|[^'"]++|['"]"""), F.lit(0))
    kept = F.transform(runs, lambda r: F.when(r.rlike("""^['"]"""), r).otherwise(F.lower(r)))
    return F.array_join(kept, "")


def spaced_names(sql: Column) -> Column:
    """Spaces around ``.`` and ``_`` in words that do not open with a quote."""
    words = F.split(F.trim(F.regexp_replace(sql, r"\s+", " ")), " ")
    wide = F.transform(
        words, lambda w: F.when(w.rlike("""^['"]"""), w).otherwise(F.regexp_replace(w, r"([._])", " $1 "))
    )
    return F.array_join(wide, " ")


def strip_db_id(text: Column, separator: str = "|") -> Column:
    """What follows the first separator with a space on each side; null if there is none."""
    mark = f" {separator} "
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def fenced_sql(answer: Column) -> Column:
    """Content of the first fenced block, else the text itself."""
    pattern = r"(?is)```(?:sql)?(.*?)```"
    return F.when(answer.rlike(pattern), F.regexp_extract(answer, pattern, 1)).otherwise(answer)


def rewritten(tokens: Column, new) -> Column:
    """The text with every token replaced by ``new(token)``; null drops it with its gap."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.concat(t["gap"], new(t)), F.lit(""))), "")


def explicit_order(tokens: Column) -> Column:
    """Write ``asc`` after every ORDER BY item without a direction."""
    def new(t: Column) -> Column:
        in_item = (t["clause"] == "orderby") & (t["plain"] == 0) & ~t["low"].isin("order", "by", ",", "(", "asc", "desc", "nulls", "first", "last")
        ends = t["n1"].isin(",", "limit", "offset", "union", "intersect", "except", ")", "", "nulls")
        return F.when(in_item & ends, F.concat(t["tok"], F.lit(" asc"))).otherwise(t["tok"])

    return rewritten(tokens, new)


def without_table_aliases(tokens: Column) -> Column:
    """Use table names in place of their aliases and drop the alias declarations."""
    tables = table_entries(tokens)

    def declared(t: Column) -> Column:
        return (t["clause"] == "from") & is_name(t) & ~names_table(t) & F.exists(
            tables, lambda e: (e["alias"] == F.lower(unquoted(t["tok"]))) & (e["path"] == t["path"])
        )

    def new(t: Column) -> Column:
        before_alias = (t["low"] == "as") & (t["clause"] == "from") & F.exists(
            tables, lambda e: (e["alias"] == unquoted(t["n1"])) & (e["path"] == t["path"])
        )
        prefix = F.substring_index(t["tok"], ".", 1)
        name = owner_of(unquoted(prefix), t["path"], tables)
        replaced = F.concat(name, F.substring(t["tok"], F.length(prefix) + 1, F.length(t["tok"])))
        dotted = is_name(t) & t["tok"].contains(".") & ~names_table(t)
        return F.when(before_alias | declared(t), F.lit(None).cast("string")).otherwise(
            F.when(dotted, F.coalesce(replaced, t["tok"])).otherwise(t["tok"])
        )

    return held(tokens, rewritten(tokens, new))


# --- the outer SELECT list ----------------------------------------------------------------


def _outer(t: Column) -> Column:
    return (t["depth"] == 0) & (t["arm"] == 0)


def outer_select_items(tokens: Column) -> Column:
    """Texts of the outer SELECT items, cut at commas outside parentheses."""
    return F.transform(_marked_items(tokens), lambda x: F.replace(x, F.lit("\x02"), F.lit(" ")))


def _marked_items(tokens: Column) -> Column:
    """The same with a mark in place of the blank before an alias without AS."""
    opening = F.try_element_at(F.filter(tokens, lambda t: (t["low"] == "select") & (t["depth"] == 0)), F.lit(1))["i"]
    first_from = F.coalesce(
        F.try_element_at(F.filter(tokens, lambda t: (t["low"] == "from") & (t["depth"] == 0) & (t["plain"] == 0)), F.lit(1))["i"],
        F.size(tokens),
    )
    ends = F.struct(opening.alias("after"), first_from.alias("before"))
    inside = once(ends, lambda e: F.filter(tokens, lambda t: (t["i"] > e["after"]) & (t["i"] < e["before"])))
    cut = F.transform(
        inside,
        lambda t: F.when((t["tok"] == ",") & (t["depth"] == 0) & (t["plain"] == 0), F.lit("\x01")).otherwise(
            F.concat(F.when((t["depth"] == 0) & bare_alias(t), F.lit("\x02")).when(t["gap"] == "", F.lit("")).otherwise(F.lit(" ")), t["tok"])
        ),
    )
    items = F.transform(F.split(F.array_join(cut, ""), "\x01"), lambda x: F.trim(x))
    bare = F.transform(items, lambda x: F.regexp_replace(x, r"(?i)^distinct\s+", ""))
    return held(tokens, bare)


def without_select_aliases(tokens: Column) -> Column:
    """Drop ``AS name``, or a name without AS, after plain columns of the outer SELECT list."""
    def marks(t: Column) -> Column:
        return (t["clause"] == "select") & _outer(t) & (t["plain"] == 0)

    def new(t: Column) -> Column:
        opens = marks(t) & (t["low"] == "as") & t["b1"].rlike(r"^[a-z_\"`]") & (t["b1"] != "end")
        alias = marks(t) & ((t["b1"] == "as") & t["b2"].rlike(r"^[a-z_\"`]") & (t["b2"] != "end") | bare_alias(t) & t["b1"].rlike(r"^[a-z_\"`]") & (t["b1"] != "end"))
        return F.when(opens | alias, F.lit(None).cast("string")).otherwise(t["tok"])

    return rewritten(tokens, new)


def with_select_column(tokens: Column, column: str | Column) -> Column:
    """Append a column to the outer SELECT list."""
    added = F.concat(F.lit(", "), F.lit(column) if isinstance(column, str) else column)

    def new(t: Column) -> Column:
        first_from = (t["low"] == "from") & _outer(t) & (t["plain"] == 0)
        text = F.concat(t["gap"], t["tok"])
        return F.when(first_from, F.concat(added, text)).otherwise(text)

    return F.array_join(F.transform(tokens, new), "")


def with_companion_column(log: DataFrame, table: str, trigger: str, key: str) -> DataFrame:
    """Add ``with_key``: the text with ``key`` appended to its SELECT list where the outer query reads ``table``, shows a column
    whose name holds ``trigger``, and does not show the key yet. The key takes the prefix of the first trigger column that has one.
    Other texts stay as they are; unreadable ones give null."""
    found = outer_tables(tokenized(log)) if "tables" not in log.columns else log
    base = tokenized(found).withColumn("_items", outer_select_items(F.col("tokens")))
    own = F.filter("tables", lambda e: e["name"] == table)
    alias = F.coalesce(F.try_element_at(own, F.lit(1))["alias"], F.lit(table))
    shown = F.exists("_items", lambda x: x.contains(trigger))
    there = F.exists("_items", lambda x: (x == key) | (x == F.concat(alias, F.lit(f".{key}"))) | (x == f"{table}.{key}"))
    prefix = F.regexp_extract(F.coalesce(F.try_element_at(F.filter("_items", lambda x: x.contains(f".{trigger}")), F.lit(1)), F.lit("")), r"^([^.\s(]+)\.", 1)
    text = F.when(prefix == "", F.lit(key)).otherwise(F.concat(prefix, F.lit(f".{key}")))
    wanted = (F.size(own) > 0) & shown & ~there
    out = base.withColumn("with_key", F.when(F.col("tokens").isNull(), F.lit(None)).when(wanted, with_select_column(F.col("tokens"), text)).otherwise(F.col("sql")))
    return out.select(*own_columns(log), "with_key")


def select_list(log: DataFrame) -> DataFrame:
    """Items of the outer SELECT list, star forms, and what each alias stands for."""
    items = pinned(tokenized(log), "_marked", _marked_items(F.col("tokens")))
    items = pinned(items, "items", F.transform("_marked", lambda x: F.replace(x, F.lit("\x02"), F.lit(" "))))
    ending = rf"(?i)(?:\s+as\s+|\x02)({QUOTED}|\S+)$"
    named = F.filter("_marked", lambda x: x.rlike(ending))
    pairs = F.transform(
        named,
        lambda x: F.struct(
            F.regexp_extract(x, ending, 1).alias("alias"),
            F.regexp_replace(F.regexp_replace(x, ending, ""), r"\b\w+\.(\w+)", "$1").alias("stands_for"),
        ),
    )
    shown = F.transform(
        pairs,
        lambda p: F.struct(
            p["alias"].alias("alias"),
            F.when(p["stands_for"].contains("("), F.lower(F.substring_index(p["stands_for"], "(", 1))).otherwise(p["stands_for"]).alias("stands_for"),
        ),
    )
    return items.select(
        *own_columns(log),
        "items",
        F.exists("items", lambda x: x == "*").alias("has_star"),
        F.exists("items", lambda x: x.contains(".*")).alias("has_prefixed_star"),
        shown.alias("aliases"),
    )


# --- outer query ------------------------------------------------------------------------


def outer_features(log: DataFrame) -> DataFrame:
    """Does the outer query group or sort, and its LIMIT (null if none or not readable)."""
    arms = F.exists("tokens", lambda t: (t["clause"] == "setop") & (t["depth"] == 0))

    def outer(t: Column) -> Column:
        # Inside the parentheses of one arm of several, a clause is that arm's own.
        return (t["depth"] == 0) & (t["plain"] == 0) & ((t["opener"] == -1) | ~arms)

    def any_of(word: str) -> Column:
        return F.exists("tokens", lambda t: (t["low"] == word) & outer(t))

    limit = F.try_element_at(F.filter("tokens", lambda t: (t["b1"] == "limit") & outer(t)), F.lit(-1))["tok"]
    return tokenized(log).select(
        *own_columns(log),
        any_of("group").alias("has_group_by"),
        any_of("order").alias("has_order_by"),
        limit.try_cast("bigint").alias("limit_value"),
    )


def outer_tables(log: DataFrame) -> DataFrame:
    """Tables of the outer FROM clause in order, with their aliases."""
    entries = F.filter(table_entries(F.col("tokens")), lambda e: (e["depth"] == 0) & (e["arm"] == 0))
    return tokenized(log).select(
        *own_columns(log),
        F.transform(entries, lambda e: F.struct(e["name"].alias("name"), e["alias"].alias("alias"))).alias("tables"),
    )


def has_outer_table(tables: Column, name: str) -> Column:
    return F.exists(tables, lambda e: e["name"] == name)


# --- structure --------------------------------------------------------------------------


def structure(log: DataFrame) -> DataFrame:
    """One row per scope: its depth, place among the scopes of that depth, and component names.

    Components: clause names per arm, ``nesting_<clause>`` per subquery, and the set operator.
    """
    base = tokenized(log).where("tokens IS NOT NULL")
    with_scopes = base.select(*own_columns(log), "tokens", "scopes", F.posexplode("scopes").alias("n", "scope"))
    mine = F.filter("tokens", lambda t: t["path"] == F.col("scope.path"))
    arms = F.greatest(F.coalesce(F.array_max(F.transform(mine, lambda t: t["arm"])), F.lit(0)), F.lit(0))
    directions = F.filter("tokens", _is_order_end)
    clause_names = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("arms")),
            lambda a: F.filter(
                F.array(
                    *[
                        F.when(
                            F.exists("mine", _in_clause(c, a)),
                            F.concat(
                                F.lit(c),
                                _order_suffix(a) if c == "orderby" else F.lit(""),
                                F.when(a > 0, F.concat(F.lit("_"), a.cast("string"))).otherwise(F.lit("")),
                            ),
                        )
                        for c in CLAUSE_LETTERS
                    ]
                ),
                lambda x: x.isNotNull(),
            ),
        )
    )
    nested = F.transform(
        F.filter("scopes", lambda s: s["parent"] == F.col("scope.path")),
        lambda s: F.concat(F.lit("nesting_"), F.when(s["clause"] == "on", "from").otherwise(s["clause"])),
    )
    operators = F.transform(
        F.filter("mine", lambda t: t["low"].isin("union", "intersect", "except") & (t["clause"] == "setop") & (t["plain"] == 0)),
        lambda t: F.concat(t["low"], F.when(t["n1"] == "all", F.lit("_all")).otherwise(F.lit(""))),
    )
    rows = (
        with_scopes.withColumn("mine", mine)
        .withColumn("_dirs", F.filter(directions, lambda t: t["path"] == F.col("scope.path")))
        .withColumn("arms", arms)
        .select(
            *own_columns(log),
            F.col("scope.depth").alias("depth"),
            F.col("n").alias("scope_id"),
            F.size(F.filter("scopes", lambda s: (s["depth"] == F.col("scope.depth")) & (F.array_position("scopes", s) <= F.col("n")))).alias("sibling"),
            clause_names.alias("clauses"),
            nested.alias("nestings"),
            operators.alias("set_operators"),
        )
    )
    return rows


def _is_order_end(t: Column) -> Column:
    """Last token of an ORDER BY item."""
    ends = t["n1"].isin(",", "limit", "offset", "union", "intersect", "except", ")", "", "nulls")
    return (t["clause"] == "orderby") & (t["plain"] == 0) & ends & ~t["low"].isin(",", "(", "order", "by", "first", "last")


def _order_suffix(arm: Column) -> Column:
    mine = F.filter("_dirs", lambda t: t["arm"] == arm)
    return F.concat(
        F.lit("_"), F.array_join(F.transform(mine, lambda t: F.when(t["low"] == "desc", "desc").otherwise("asc")), "_")
    )


def nesting_depth(log: DataFrame) -> DataFrame:
    deepest = F.array_max(F.transform("scopes", lambda s: s["depth"]))
    return tokenized(log).select(*own_columns(log), deepest.alias("depth"), (F.size("scopes") - 1).alias("subqueries"))


# --- operators --------------------------------------------------------------------------


def operator_of(t: Column) -> Column:
    """``struct<type, member>`` of an operator token, else null."""
    def found(kind: str, member: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(member) if isinstance(member, str) else member).alias("member"))

    low, b1, b2, n1, n2 = t["low"], t["b1"], t["b2"], t["n1"], t["n2"]
    operand_before = b1.rlike(r"""^[\w"'`.]+$|^\)$""") & ~b1.isin("select", "distinct", "by", "and", "or", "not", "where", "then", "else", "on", "having")
    join_words = F.trim(
        F.concat(
            F.when(b2.isin("left") & (b1 == "outer"), F.lit("left outer ")).otherwise(F.lit("")),
            F.when(b1.isin("left", "inner", "cross"), F.concat(b1, F.lit(" "))).otherwise(F.lit("")),
            F.lit("join"),
        )
    )
    in_from = t["clause"].isin("from")
    result = F.when((low == "join"), found("J", join_words)).when(
        (low == ",") & in_from & (t["plain"] == 0), found("J", "join")
    )
    result = result.when(low.isin(*AGGREGATES) & (n1 == "("), found("Ag", low))
    for token, member in COMPARISONS.items():
        result = result.when(low == token, found("C", member))
    result = result.when(low == "between", found("C", F.when(b1 == "not", "not_between").otherwise("between")))
    result = result.when((low == "and") & ~t["range_and"], found("Lo", "and")).when(low == "or", found("Lo", "or"))
    result = result.when(
        (low == "not") & ~n1.isin("in", "like", "ilike", "between", "null") & (b1 != "is"), found("Lo", "not")
    )
    result = result.when(low == "like", found("Li", F.when(b1 == "not", "not_like").otherwise("like")))
    result = result.when(low == "ilike", found("Li", "ilike"))
    for token, member in ARITHMETIC.items():
        result = result.when((low == token) & operand_before, found("Ar", member))
    result = result.when(low == "in", found("Me", F.when(b1 == "not", "nin").otherwise("in")))
    result = result.when((low == "is") & (n1 == "null"), found("Nu", "is null")).when(
        (low == "is") & (n1 == "not") & (n2 == "null"), found("Nu", "is not null")
    )
    result = result.when(low.isin(*UNARY_FUNCTIONS) & (n1 == "(") & ~b1.isin("union", "intersect", "except"), found("UnOp", low))
    return result.when(low.isin(*BINARY_FUNCTIONS) & (n1 == "("), found("BiOp", low))


def operator_entries(tokens: Column, move_on: bool = False) -> Column:
    """``array<struct<path, depth, arm, clause, type, member>>`` in text order.

    Chains of one logical operator count once, as one condition with many parts. With ``move_on``
    the ON conditions of joins count as WHERE conditions.
    """
    def clause(t: Column) -> Column:
        return F.when(t["clause"] == "on", F.lit("where" if move_on else "from")).otherwise(t["clause"])

    def chained(t: Column) -> Column:
        earlier = F.filter(
            tokens,
            lambda e: (e["i"] < t["i"]) & (e["path"] == t["path"]) & (e["opener"] == t["opener"]) & (e["clause"] == t["clause"])
            & (e["arm"] == t["arm"]) & (e["low"].isin("and", "or")) & ~e["range_and"],
        )
        return F.when(t["low"] == "or", F.exists(earlier, lambda e: e["low"] == "or")).otherwise(
            F.coalesce(F.try_element_at(earlier, F.lit(-1))["low"] == "and", F.lit(False))
        )

    found = F.transform(
        tokens,
        lambda t: F.struct(
            t["path"].alias("path"),
            t["depth"].alias("depth"),
            t["arm"].alias("arm"),
            clause(t).alias("clause"),
            operator_of(t).alias("op"),
            (t["low"].isin("and", "or") & ~t["range_and"] & chained(t)).alias("again"),
        ),
    )
    kept = F.filter(found, lambda o: o["op"].isNotNull() & ~o["again"])
    return held(
        tokens,
        F.transform(
            kept,
            lambda o: F.struct(
                o["path"].alias("path"), o["depth"].alias("depth"), o["arm"].alias("arm"), o["clause"].alias("clause"),
                o["op"]["type"].alias("type"), o["op"]["member"].alias("member"),
            ),
        ),
    )


def operators(log: DataFrame) -> DataFrame:
    """One row per operator occurrence: depth, scope, clause, type, member."""
    base = tokenized(log).where("tokens IS NOT NULL")
    return base.select(*own_columns(log), F.explode(operator_entries(F.col("tokens"))).alias("o")).select(
        *own_columns(log), "o.depth", F.col("o.path").alias("scope"), "o.clause", "o.type", "o.member"
    )


def operator_counts(log: DataFrame) -> DataFrame:
    return operators(log).groupBy(*own_columns(log), "clause", "type", "member").agg(F.count(F.lit(1)).alias("n"))


# --- categories and sizes -----------------------------------------------------------------


def _in_clause(name: str, arm: Column | None = None):
    def test(t: Column) -> Column:
        return (t["clause"] == name) if arm is None else (t["clause"] == name) & (t["arm"] == arm)

    return test


def _of_type(kind: str):
    return lambda o: o["type"] == kind


def _component_counts(kind: str) -> list[tuple[str, Column]]:
    if kind == "operators":
        return [(k, F.size(F.filter("_ops", _of_type(k)))) for k in OPERATOR_ORDER]
    counts = []
    for name, letter in CLAUSE_LETTERS.items():
        spots = F.filter("tokens", _in_clause(name))
        places = F.transform(spots, lambda t: F.struct(t["path"].alias("p"), t["arm"].alias("a")))
        counts.append((letter, F.size(F.array_distinct(places))))
    setops = F.filter("tokens", lambda t: t["low"].isin("union", "intersect", "except") & (t["clause"] == "setop") & (t["plain"] == 0))
    counts.append(("SO", F.size(setops)))
    counts.append(("N", F.size("scopes") - 1))
    return counts


def category(kind: str, form: str) -> Column:
    """Category text over ``structure`` or ``operators`` parts: name, binary or counter form."""
    counts = _component_counts(kind)
    if form == "name":
        return F.concat_ws("-", *[F.when(n > 0, F.lit(k)) for k, n in counts])
    if form == "binary":
        return F.concat(*[F.when(n > 0, "1").otherwise("0") for _, n in counts])
    if form == "counter":
        return F.concat_ws(".", *[n.cast("string") for _, n in counts])
    raise ValueError(f"category form {form!r} is not name, binary or counter")


def categories(log: DataFrame) -> DataFrame:
    """All category forms per query; null where the text is not readable."""
    base = tokenized(log).withColumn("_ops", operator_entries(F.col("tokens")))
    cols = [
        F.when(F.col("tokens").isNotNull(), category(kind, form)).alias(f"{kind}_{form}")
        for kind in ("structure", "operators")
        for form in ("name", "binary", "counter")
    ]
    return base.select(*own_columns(log), *cols).withColumn("category", F.concat("structure_name", F.lit("-"), "operators_name"))


def sizes(log: DataFrame) -> DataFrame:
    """Columns of the outer SELECT list (null for ``*``) and conditions of the outer WHERE.

    Conditions are counted with the AND and OR nodes that join them.
    """
    base = tokenized(log).withColumn("items", outer_select_items(F.col("tokens"))).withColumn(
        "_ops", operator_entries(F.col("tokens"))
    )
    conditions = F.filter("_ops", lambda o: (o["path"] == "/0/") & (o["arm"] == 0) & (o["clause"] == "where") & ~o["type"].isin("Ag", "Ar", "J"))
    return base.select(
        *own_columns(log),
        F.when(~F.exists("items", lambda x: x == "*"), F.size("items")).alias("columns_num"),
        F.when(F.col("tokens").isNotNull(), F.size(conditions)).alias("conditions_num"),
    )


# --- variables --------------------------------------------------------------------------


def _column_entries(tokens: Column, tables: Column) -> Column:
    """``array<struct<path, depth, clause, table, column, prefix>>`` with aliases resolved.

    A bare column of a scope with one table belongs to it; else its table stays null.
    """
    def entry(t: Column) -> Column:
        prefix = F.when(t["tok"].contains("."), unquoted(F.substring_index(t["tok"], ".", 1)))
        own = F.filter(tables, lambda e: (e["path"] == t["path"]) & (e["arm"] == t["arm"]))
        single = F.when(F.size(own) == 1, F.try_element_at(own, F.lit(1))["name"])
        return F.struct(
            t["path"].alias("path"),
            t["depth"].alias("depth"),
            t["clause"].alias("clause"),
            F.when(prefix.isNull(), single).otherwise(F.coalesce(owner_of(prefix, t["path"], tables), prefix)).alias("table"),
            unquoted(F.substring_index(t["tok"], ".", -1)).alias("column"),
            t["i"].alias("i"),
        )

    return F.transform(F.filter(tokens, is_column), entry)


def _with_tables(log: DataFrame) -> DataFrame:
    base = tokenized(log).where("tokens IS NOT NULL")
    base = base.withColumn("_tables", table_entries(F.col("tokens")))
    return base.withColumn("_columns", held(F.col("_tables"), _column_entries(F.col("tokens"), F.col("_tables"))))


def variables(log: DataFrame) -> DataFrame:
    """One row per table, column, value or alias used: ``depth, scope, kind, table_name, name``."""
    base = _with_tables(log)
    tables = F.transform(
        "_tables",
        lambda e: F.struct(
            e["depth"].alias("depth"), e["path"].alias("scope"), F.lit("tables").alias("kind"),
            F.lit(None).cast("string").alias("table_name"), e["name"].alias("name"),
        ),
    )
    columns = F.transform(
        "_columns",
        lambda c: F.struct(
            c["depth"].alias("depth"), c["path"].alias("scope"), F.lit("columns").alias("kind"),
            c["table"].alias("table_name"), c["column"].alias("name"),
        ),
    )
    values = F.transform(
        F.filter("tokens", lambda t: is_literal(t) & (t["clause"] != "limit")),
        lambda t: F.struct(
            t["depth"].alias("depth"), t["path"].alias("scope"), F.lit("values").alias("kind"),
            F.lit(None).cast("string").alias("table_name"), F.regexp_replace(signed(t), "^'|'$", "").alias("name"),
        ),
    )
    aliases = F.transform(
        F.filter("tokens", lambda t: is_name(t) & (is_alias(t) | bare_alias(t)) & (t["n1"] != "(")),
        lambda t: F.struct(
            t["depth"].alias("depth"), t["path"].alias("scope"), F.lit("aliases").alias("kind"),
            F.lit(None).cast("string").alias("table_name"), unquoted(t["tok"]).alias("name"),
        ),
    )
    entries = F.concat(tables, columns, values, aliases)
    return base.select(*own_columns(log), F.explode(entries).alias("v")).select(
        *own_columns(log), "v.depth", "v.scope", "v.kind", "v.table_name", "v.name"
    )


def column_equivalences(log: DataFrame) -> DataFrame:
    """Columns set equal by ``a = b``, both ways: ``column, equals``."""
    base = _with_tables(log)
    at = F.transform("_columns", lambda c: F.struct(c["i"].alias("i"), F.concat_ws(".", c["table"], c["column"]).alias("name")))
    pairs = F.filter(
        F.transform(
            F.filter("tokens", lambda t: t["low"].isin("=", "==")),
            lambda t: F.struct(
                F.try_element_at(F.filter("_at", lambda c: c["i"] == t["i"] - 1), F.lit(1))["name"].alias("a"),
                F.try_element_at(F.filter("_at", lambda c: c["i"] == t["i"] + 1), F.lit(1))["name"].alias("b"),
            ),
        ),
        lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"]),
    )
    both = base.withColumn("_at", at).select(*own_columns(log), held(F.col("_at"), pairs).alias("_p"))
    ways = F.concat("_p", F.transform("_p", lambda p: F.struct(p["b"].alias("a"), p["a"].alias("b"))))
    return both.select(*own_columns(log), F.explode(F.array_distinct(ways)).alias("e")).select(
        *own_columns(log), F.col("e.a").alias("column"), F.col("e.b").alias("equals")
    )


# --- filters, validity, repair ---------------------------------------------------------------


def filter_values(log: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Which column is compared with which literal, by which operator.

    ``columns(db_id, table_name, column)`` settles bare columns of queries with several tables.
    """
    base = _with_tables(log)

    def entry(t: Column) -> Column:
        listed = (t["plain"] > 0) & (F.get("_low", t["opener"] - 1) == "in")
        negated = F.get("_low", t["opener"] - 2) == "not"
        minus = signed(t) != t["tok"]
        before = F.when(minus, t["b2"]).otherwise(t["b1"])
        direct = before.isin(*FILTER_OPERATORS)
        not_like = (t["b1"] == "like") & (t["b2"] == "not")
        at = F.when(direct, t["i"] - F.when(not_like | minus, 3).otherwise(2)).when(
            listed & ~t["b1"].isin("=", "<", ">"), t["opener"] - F.when(negated, 3).otherwise(2)
        )
        op = F.when(direct, F.when(not_like, "not like").otherwise(before)).when(
            listed, F.when(negated, "not in").otherwise("in")
        )
        col = F.try_element_at(F.filter("_columns", lambda c: c["i"] == at), F.lit(1))
        return F.struct(
            col["table"].alias("table_name"),
            col["column"].alias("column"),
            op.alias("operator"),
            F.replace(F.regexp_replace(signed(t), "^'|'$", ""), F.lit("''"), F.lit("'")).alias("value"),
        )

    found = F.transform(F.filter("tokens", is_literal), entry)
    rows = (
        base.withColumn("_low", F.transform("tokens", lambda t: t["low"]))
        .select(*own_columns(log), "_tables", held(F.col("_columns"), F.filter(found, lambda v: v["column"].isNotNull())).alias("_v"))
        .select(*own_columns(log), "_tables", F.explode(F.array_distinct("_v")).alias("v"))
        .select(*own_columns(log), "_tables", "v.*")
    )
    if columns is None:
        return rows.drop("_tables")
    rows = cut_lineage(rows)
    named = rows.where("table_name IS NOT NULL").drop("_tables")
    bare = rows.where("table_name IS NULL").drop("table_name")
    known = columns.select(
        "db_id", F.col("table_name").alias("_t"), F.lower("table_name").alias("_tl"), F.lower("column").alias("_cl")
    )
    tables = F.array_distinct(F.transform("_tables", lambda e: F.lower(e["name"])))
    spread = bare.withColumn("_tl", F.explode_outer(tables)).withColumn("_cl", F.lower("column"))
    settled = (
        spread.join(known, ["db_id", "_tl", "_cl"], "left")
        .groupBy(*own_columns(log), "column", "operator", "value")
        .agg(F.min("_t").alias("table_name"))
    )
    return named.unionByName(settled)


def references(log: DataFrame) -> DataFrame:
    """Lower-case tables and columns every readable query refers to.

    ``used`` lists the tables of the query, for bare columns.
    """
    base = _with_tables(log)
    used = F.array_distinct(F.transform("_tables", lambda e: F.lower(e["name"])))
    entries = F.concat(
        F.transform("_tables", lambda e: F.struct(F.lower(e["name"]).alias("table_name"), F.lit(None).cast("string").alias("column"))),
        F.transform("_columns", lambda c: F.struct(F.lower(c["table"]).alias("table_name"), F.lower(c["column"]).alias("column"))),
    )
    outputs = F.transform(F.filter("tokens", lambda t: is_name(t) & (t["b1"] == "as")), lambda t: F.lower(unquoted(t["tok"])))
    return base.select(
        *own_columns(log), used.alias("used"), outputs.alias("outputs"), F.explode(F.array_distinct(entries)).alias("r")
    ).select(*own_columns(log), "used", "outputs", "r.table_name", "r.column")


def validity(log: DataFrame, columns: DataFrame) -> DataFrame:
    """``is_valid``: every table and column of the query exists in its database.

    A text that is not readable is not valid; without a ``db_id`` nothing is missing. Names given by AS in the query count as known columns.
    """
    refs = cut_lineage(references(log))
    known_tables = columns.select("db_id", F.lower("table_name").alias("table_name")).distinct()
    known = columns.select("db_id", F.lower("table_name").alias("table_name"), F.lower("column").alias("column")).distinct()
    tables = refs.where("db_id IS NOT NULL AND column IS NULL AND table_name IS NOT NULL")
    asked = refs.where("db_id IS NOT NULL AND column IS NOT NULL").where(~F.array_contains("outputs", F.col("column")))
    named = asked.where("table_name IS NOT NULL")
    bare = asked.where("table_name IS NULL").select("query_id", "db_id", "used", "column")
    # Nearly all queries may use one name, or miss one, so references are dealt and meet the rows of the catalog.
    no_table = dealt_join(tables, known_tables, ["db_id", "table_name"], ["query_id"], "left_anti")
    no_column = dealt_join(named, known, ["db_id", "table_name", "column"], ["query_id"], "left_anti")
    spread = bare.withColumn("table_name", F.explode("used"))
    found = dealt_join(spread, known, ["db_id", "table_name", "column"], ["query_id"], "left_semi").select(*bare.columns).distinct()
    nowhere = bare.join(by_shuffle(found), bare.columns, "left_anti")
    missing = no_table.select("query_id").unionByName(no_column.select("query_id")).unionByName(nowhere.select("query_id"))
    checked = (
        refs.select("query_id", F.lit(True).alias("_ok")).unionByName(missing.withColumn("_ok", F.lit(False)))
        .groupBy("query_id").agg(F.bool_and("_ok").alias("is_valid"))
    )
    return log.select(*own_columns(log)).join(by_shuffle(checked), "query_id", "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))


def first_valid(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """First valid text of ``candidates`` per question, else null."""
    spread = questions.select("question_id", "db_id", F.posexplode("candidates").alias("place", "sql"))
    spread = spread.withColumn("query_id", F.struct("question_id", "place"))
    best = (
        validity(spread, columns)
        .where("is_valid")
        .groupBy("question_id")
        .agg(F.min_by("sql", "place").alias("prediction"))
    )
    return questions.join(by_shuffle(best), "question_id", "left")


def _most_similar(unknown: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """Known names like each unknown one, with a score; the best ones are among them.

    A similarity join finds all known names within a radius. Names with a match are done; the others go on to the next radius, at last
    to one that any common letter meets. What has no letter in common with any name gets the smallest one.
    """
    columns = [*scope, "name", "known", "score"]
    longest = unknown.agg(F.max(F.length("span"))).unionByName(known.agg(F.max(F.length("norm"))).toDF("max(length(span))"))
    longest = max([1, *(r[0] for r in longest.collect() if r[0])])
    out = None
    for radius in [*[r for r in NAME_RADII if r * longest > 1], 1 / longest]:
        near = similar_pairs(unknown, known, radius, "levenshtein", same_first=False, within=scope)
        found = cut_lineage(unknown.join(near, [*scope, "span"]).join(known, [*scope, "norm"]).select(*columns))
        out = found if out is None else out.unionByName(found)
        unknown = cut_lineage(unknown.join(found.select(*scope, "name").distinct(), [*scope, "name"], "left_anti"))
        if unknown.isEmpty():
            return out
    smallest = known.groupBy(*scope).agg(F.min("known").alias("known"))
    return out.unionByName(unknown.join(smallest, scope).withColumn("score", F.lit(0.0)).select(*columns))


def repaired_names(log: DataFrame, columns: DataFrame) -> DataFrame:
    """Replace unknown table and column names by the most similar known name of the database.

    Each distinct unknown name of a database is matched once, by similarity joins of growing radius. Equal similarity goes to
    the smaller name. Whole name parts are replaced; literals and names declared in the query are left alone.
    """
    declared = F.transform(
        F.filter("tokens", lambda t: is_name(t) & ((t["b1"] == "as") | (t["clause"] == "with") & (t["n1"] == "as"))),
        lambda t: F.lower(unquoted(t["tok"])),
    )
    log = cut_lineage(tokenized(log))
    base = _with_tables(log).withColumn("_declared", declared)
    entries = F.concat(
        F.transform("_tables", lambda e: F.struct(F.lit("table").alias("kind"), e["name"].alias("name"))),
        F.transform("_columns", lambda c: F.struct(F.lit("column").alias("kind"), c["column"].alias("name"))),
    )
    entries = held(F.col("_declared"), F.filter(entries, lambda e: ~F.array_contains("_declared", F.lower(e["name"]))))
    names = base.select("db_id", F.explode(entries).alias("e")).select("db_id", "e.kind", "e.name").distinct()
    known = (
        columns.select("db_id", F.lit("table").alias("kind"), F.col("table_name").alias("known"))
        .union(columns.select("db_id", F.lit("column").alias("kind"), F.col("column")))
        .distinct()
    )
    unknown = names.join(known.withColumnRenamed("known", "name"), ["db_id", "kind", "name"], "left_anti")
    scope = ["db_id", "kind"]
    names_of = known.select(*scope, "known", F.lower("known").alias("norm"))
    unknown = cut_lineage(unknown.withColumn("span", F.lower("name")))
    scored = _most_similar(unknown, names_of, scope)
    fixes = scored.groupBy("db_id", "kind", "name").agg(
        F.min_by("known", F.struct((-F.col("score")).alias("s"), "known")).alias("fixed")
    )
    used = base.select("query_id", "db_id", F.explode(F.array_distinct(entries)).alias("e")).select("query_id", "db_id", "e.kind", "e.name")
    maps = (
        used.join(fixes, ["db_id", "kind", "name"])
        .groupBy("query_id")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "name"), "fixed"))).alias("fixes"))
    )
    joined = tokenized(log).join(maps, "query_id", "left")

    def fixed(kind: str, name: Column) -> Column:
        return F.coalesce(F.try_element_at("fixes", F.concat(F.lit(f"{kind}:"), unquoted(name))), name)

    def new(t: Column) -> Column:
        head, tail = F.substring_index(t["tok"], ".", 1), F.substring_index(t["tok"], ".", -1)
        dotted = t["tok"].contains(".")
        column = F.when(dotted, F.concat(fixed("table", head), F.lit("."), F.when(tail == "*", tail).otherwise(fixed("column", tail)))).otherwise(
            fixed("column", t["tok"])
        )
        return F.when(names_table(t), fixed("table", t["tok"])).when(
            is_name(t) & (is_column(t) | (t["tok"].endswith(".*"))) & ~is_function(t), column
        ).otherwise(t["tok"])

    return joined.select(
        *own_columns(log),
        F.when(F.col("fixes").isNull(), F.col("sql")).otherwise(rewritten(F.col("tokens"), new)).alias("repaired"),
    )
