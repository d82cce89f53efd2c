"""SQL text of a query log as tokens with scope, clause and place.

A log is ``(query_id, db_id, sql)``. Each text is cut by one regular expression and annotated by
one fold over its tokens, all inside its own row: a log of any size needs no shuffle for this, and
copies of one text cost no more than other rows. There is no grammar: a text counts as readable if
it opens with SELECT or WITH (also inside parentheses) and its parentheses and quotes close; others give null.

Token fields: ``i`` position, ``gap`` whitespace before, ``tok`` text, ``low`` lower case, ``path`` scope path (``/0/2/``),
``depth`` of the scope, ``arm`` of a set operator, ``clause``, ``plain`` parentheses opened in the
scope, ``opener`` position of the innermost ``(``, ``range_and`` for the AND of a BETWEEN, and the
neighbours ``b2 b1 n1 n2 n3``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.arrays import held, once, pinned

# Token forms, and the words that are not names.
LITERAL = r"'[^']*+(?:''[^']*+)*+'"
QUOTED = r'"[^"]*+"|`[^`]*+`'
NAME = rf"(?:[A-Za-z_]\w*+|{QUOTED})"
WORD = rf"{NAME}(?:\.(?:{NAME}|\*))*+"
NUMBER = r"(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?\d++)?+"
# A cast belongs to its type: one token that is no name.
CAST = (
    r"::\s*+[A-Za-z_]\w*+(?:\s++(?:precision|varying)(?!\w))?+(?:\s*+\(\s*+\d++(?:\s*+,\s*+\d++)?+\s*+\))?+(?:\s++with(?:out)?\s++time\s++zone(?!\w))?+(?:\[\])?+"
)
TOKEN = rf"{LITERAL}|{WORD}|{NUMBER}|{CAST}|<=|>=|<>|!=|\|\||==|\S"
# Comments count as white space between tokens.
GAP = r"(?:\s|--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+"
PIECE = rf"{GAP}(?:{TOKEN}|$)"

KEYWORDS = """
    all and any as asc between by case cast cross current_date current_timestamp date desc distinct else end escape
    except exists false first from full group having ilike in inner intersect interval is join last left like limit
    natural not null nulls offset on or order outer over partition recursive right select some then true union using
    values when where with
""".split()
CLAUSES = {
    "select": "select",
    "from": "from",
    "where": "where",
    "group": "groupby",
    "having": "having",
    "order": "orderby",
    "limit": "limit",
    "offset": "limit",
}
SET_OPERATORS = ["union", "intersect", "except"]


def cut(sql: Column) -> Column:
    """``array<struct<gap, tok, low>>``: tokens with the whitespace before them, without semicolons."""
    found = F.regexp_extract_all(sql, F.lit(PIECE), F.lit(0))
    gaps = F.transform(found, lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, f"^{GAP}", 0).alias("gap")))
    split = F.transform(gaps, lambda g: F.struct(g["gap"].alias("gap"), F.substr(g["piece"], F.length(g["gap"]) + 1).alias("tok")))
    lowered = F.transform(split, lambda p: F.struct(p["gap"].alias("gap"), p["tok"].alias("tok"), F.lower(p["tok"]).alias("low")))
    return F.filter(lowered, lambda p: ~p["tok"].isin(";", ""))


def with_neighbours(pieces: Column) -> Column:
    """Every token beside the two before and the three after it."""
    def near(i: Column, step: int) -> Column:
        return F.coalesce(F.get(pieces, i + step)["low"], F.lit(""))

    return F.transform(
        pieces,
        lambda p, i: F.struct(
            i.cast("int").alias("i"), p["gap"].alias("gap"), p["tok"].alias("tok"), p["low"].alias("low"),
            near(i, -2).alias("b2"), near(i, -1).alias("b1"), near(i, 1).alias("n1"), near(i, 2).alias("n2"), near(i, 3).alias("n3"),
        ),
    )


def _place(path, depth, arm, clause, plain, opener, between) -> Column:
    return F.struct(
        path.alias("path"),
        depth.cast("int").alias("depth"),
        arm.cast("int").alias("arm"),
        clause.alias("clause"),
        plain.cast("int").alias("plain"),
        opener.cast("int").alias("opener"),
        between.alias("between"),
    )


_PLACE_TYPE = "struct<path:string,depth:int,arm:int,clause:string,plain:int,opener:int,between:boolean>"
_PLACED_TYPE = f"struct<place:{_PLACE_TYPE},range_and:boolean>"
_SCOPE_TYPE = "struct<path:string,depth:int,clause:string,parent:string>"


def _step():
    def step(state: Column, piece: Column) -> Column:
        now, stack = state["now"], state["stack"]
        i, low, nxt = piece["i"], piece["low"], piece["n1"]
        opens, closes = low == "(", low == ")"
        # Parentheses around an arm of the outer query open no scope: (SELECT ..) UNION (SELECT ..).
        around = opens & (now["depth"] == 0) & (now["plain"] == 0) & now["clause"].isin("none", "setop") & nxt.isin("select", "with", "(")
        scope_opens = opens & ~around & nxt.isin("select", "with")
        inner_path = F.concat(now["path"], state["next"].cast("string"), F.lit("/"))
        popped = F.coalesce(F.get(stack, F.size(stack) - 1), now)

        top = now["plain"] == 0
        clause = now["clause"]
        clause = (
            F.when(top & low.isin(*SET_OPERATORS), F.lit("setop"))
            .when(top & (low == "with"), F.lit("with"))
            .when(now["clause"].isin("from", "on") & low.isin("on", "using"), F.lit("on"))
            .when(
                (now["clause"] == "on") & low.isin("join", "inner", "left", "right", "cross", "full", "natural"),
                F.lit("from"),
            )
        )
        for word, name in CLAUSES.items():
            clause = clause.when(top & (low == word), F.lit(name))
        clause = clause.otherwise(now["clause"])
        arm = F.when(top & low.isin(*SET_OPERATORS), now["arm"] + 1).otherwise(now["arm"])
        range_and = now["between"] & (low == "and")
        between = F.when(low == "between", F.lit(True)).when(low == "and", F.lit(False)).otherwise(now["between"])

        entered = F.when(
            scope_opens,
            _place(inner_path, now["depth"] + 1, F.lit(0), F.lit("select"), F.lit(0), i, F.lit(False)),
        ).otherwise(
            _place(now["path"], now["depth"], now["arm"], now["clause"], now["plain"] + F.when(around, 0).otherwise(1), i, F.lit(False))
        )

        def left(outer: Column) -> Column:
            arm_left = F.when(outer["path"] == now["path"], now["arm"]).otherwise(outer["arm"])
            return _place(outer["path"], outer["depth"], arm_left, outer["clause"], outer["plain"], outer["opener"], outer["between"])

        scope = F.struct(
            inner_path.alias("path"),
            (now["depth"] + 1).cast("int").alias("depth"),
            now["clause"].alias("clause"),
            now["path"].alias("parent"),
        )
        empty_scopes = F.array().cast(f"array<{_SCOPE_TYPE}>")

        def stepped(moved: Column) -> Column:
            after = F.when(opens, entered).when(closes, once(popped, left)).otherwise(moved)
            # A closing parenthesis belongs to the place outside it, like the opening one.
            shown = F.when(closes, popped).when(opens, now).otherwise(moved)
            placed = F.struct(shown.cast(_PLACE_TYPE).alias("place"), range_and.alias("range_and"))
            return F.struct(
                after.cast(_PLACE_TYPE).alias("now"),
                F.when(opens, F.concat(stack, F.array(now)))
                .when(closes, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
                .otherwise(stack)
                .cast(f"array<{_PLACE_TYPE}>")
                .alias("stack"),
                (state["next"] + F.when(scope_opens, 1).otherwise(0)).cast("int").alias("next"),
                (state["bad"] | (closes & (F.size(stack) == 0))).alias("bad"),
                F.concat(state["out"], F.array(placed.cast(_PLACED_TYPE))).alias("out"),
                F.when(scope_opens, F.concat(state["scopes"], F.array(scope.cast(_SCOPE_TYPE)))).otherwise(
                    F.concat(state["scopes"], empty_scopes)
                ).alias("scopes"),
            )

        return once(_place(now["path"], now["depth"], arm, clause, now["plain"], now["opener"], between), stepped)

    return step


def _token(piece: Column, placed: Column) -> Column:
    place = placed["place"]
    return F.struct(
        *[piece[c].alias(c) for c in ("i", "gap", "tok", "low")],
        *[place[c].alias(c) for c in ("path", "depth", "arm", "clause", "plain", "opener")],
        placed["range_and"].alias("range_and"),
        *[piece[c].alias(c) for c in ("b2", "b1", "n1", "n2", "n3")],
    )


def tokenized(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``tokens`` and ``scopes`` (root first); both null where the text is not readable.

    A log that has them already is returned as it is.
    """
    if "tokens" in log.columns:
        return log
    start = F.struct(
        _place(F.lit("/0/"), F.lit(0), F.lit(0), F.lit("none"), F.lit(0), F.lit(-1), F.lit(False)).cast(_PLACE_TYPE).alias("now"),
        F.array().cast(f"array<{_PLACE_TYPE}>").alias("stack"),
        F.lit(1).cast("int").alias("next"),
        F.lit(False).alias("bad"),
        F.array().cast(f"array<{_PLACED_TYPE}>").alias("out"),
        F.array(
            F.struct(
                F.lit("/0/").alias("path"),
                F.lit(0).cast("int").alias("depth"),
                F.lit(None).cast("string").alias("clause"),
                F.lit(None).cast("string").alias("parent"),
            ).cast(_SCOPE_TYPE)
        ).alias("scopes"),
    )
    pieces = pinned(log, "_cut", cut(F.col(sql)))
    pieces = pinned(pieces, "_near", with_neighbours(F.col("_cut")))
    stray = F.exists("_cut", lambda p: p["tok"].isin("'", '"', "`"))
    first = F.try_element_at(F.filter("_cut", lambda p: p["tok"] != "("), F.lit(1))["low"]
    could = F.col(sql).isNotNull() & F.coalesce(first, F.lit("")).isin("select", "with") & ~stray
    folded = pinned(pieces, "_f", F.when(could, F.aggregate("_near", start, _step())))
    whole = ~F.col("_f.bad") & (F.size("_f.stack") == 0)
    found = pinned(folded, "tokens", F.when(whole, F.zip_with("_near", "_f.out", _token)))
    return found.withColumn("scopes", F.when(whole, F.col("_f.scopes"))).drop("_f", "_cut", "_near")


def own_columns(log: DataFrame) -> list[str]:
    """Columns of the log without the token columns."""
    return [c for c in log.columns if c not in ("tokens", "scopes")]


def is_literal(t: Column) -> Column:
    return t["tok"].startswith("'") | t["tok"].rlike(r"^\.?\d")


def signed(t: Column) -> Column:
    """The text of a literal with the minus before it, where that is a sign and no subtraction."""
    starts = (t["b2"] == "") | t["b2"].isin(*KEYWORDS) | t["b2"].rlike("^[^\\w\"'`)]")
    return F.when((t["b1"] == "-") & starts & ~t["tok"].startswith("'"), F.concat(F.lit("-"), t["tok"])).otherwise(t["tok"])


def _type_word(t: Column) -> Column:
    """Words that name a type or a unit where they stand: EXTRACT(year FROM ..), INTERVAL '1' day, CAST(.. AS double precision), timestamp '..'."""
    unit = (t["b1"] == "(") & (t["b2"] == "extract") | (t["b2"] == "interval")
    second = t["low"].isin("precision", "varying") & t["b1"].isin("double", "character") | t["low"].isin("without", "time", "zone") & t["b1"].isin("timestamp", "time", "with", "without")
    return unit | second | t["low"].isin("timestamp", "time") & t["n1"].startswith("'")


def is_name(t: Column) -> Column:
    """A word that may name a table, column or alias."""
    return t["tok"].rlike(r'^[A-Za-z_"`]') & ~t["low"].isin(*KEYWORDS)


def is_function(t: Column) -> Column:
    return is_name(t) & (t["n1"] == "(") & ~t["tok"].rlike(r'^["`]')


def names_table(t: Column) -> Column:
    """A table after FROM, JOIN or a comma of the FROM clause."""
    return is_name(t) & (t["clause"] == "from") & t["b1"].isin("from", "join", ",") & (t["n1"] != "(")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, '["`]', "")


def table_alias(t: Column) -> Column:
    """The alias that follows a table name, or null."""
    bare = t["n1"].rlike('^[a-z_"`]') & ~t["n1"].isin(*KEYWORDS)
    return F.when(t["n1"] == "as", unquoted(t["n2"])).when(bare, unquoted(t["n1"]))


def is_alias(t: Column) -> Column:
    """A name right after AS, or right after a table or a closed subquery of the FROM clause."""
    after_name = (t["clause"] == "from") & ~t["b1"].isin("from", "join", ",", "(", "")
    return (t["b1"] == "as") & (t["plain"] == 0) | after_name


def table_entries(tokens: Column) -> Column:
    """``array<struct<path, depth, arm, name, alias>>`` of the tables of every scope."""
    return F.transform(
        F.filter(tokens, names_table),
        lambda t: F.struct(
            t["path"].alias("path"),
            t["depth"].alias("depth"),
            t["arm"].alias("arm"),
            unquoted(t["tok"]).alias("name"),
            table_alias(t).alias("alias"),
        ),
    )


def owner_of(prefix: Column, path: Column, tables: Column) -> Column:
    """The table an alias or name stands for, looked up from the inner scope outwards."""
    seen = F.filter(
        tables,
        lambda e: path.startswith(e["path"]) & ((e["alias"] == F.lower(prefix)) | (F.lower(e["name"]) == F.lower(prefix))),
    )
    nearest = F.array_max(F.transform(seen, lambda e: F.struct(F.length(e["path"]).alias("n"), e["name"].alias("name"))))
    return nearest["name"]


def is_column(t: Column) -> Column:
    """A name in a place where a column may stand."""
    in_list = t["clause"].isin("select", "where", "groupby", "having", "orderby", "on")
    return is_name(t) & in_list & ~is_function(t) & (t["b1"] != "as") & ~bare_alias(t) & ~t["tok"].endswith(".*") & ~_type_word(t)


def bare_alias(t: Column) -> Column:
    """A second name in a row in the SELECT list is an alias without AS, also after CASE .. END."""
    operand = t["b1"].rlike("^[a-z_\"`0-9'.:]|^\\)$") & ~t["b1"].isin(*KEYWORDS) | (t["b1"] == "end")
    return is_name(t) & (t["clause"] == "select") & (t["plain"] == 0) & (t["n1"] != "(") & operand & ~_type_word(t)
