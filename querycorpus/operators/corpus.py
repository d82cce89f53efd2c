"""Prepare question/SQL corpora: group, reshape, compose text, perturb, measure templates."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.arrays import held, pinned
from querycorpus.functions.scale import global_position
from querycorpus.functions.text import mark_names, md5_bucket

# Aggregates and comparisons of structured queries, by number.
STRUCTURED_AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
STRUCTURED_COMPARISONS = ["=", ">", "<", "OP"]


def grouped_by_query(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Collapse the rows of each (query, database): ``keys, column, n_distinct, place, value``.

    Every other column whose values are all equal in its group gives one row, place 0; other columns give one row
    per row of the group, in ``order``. Values are text; a null is a value like any other. Both decisions are made by
    aggregation over the whole group and places by range partitioning, so a group of any size has this one form.
    """
    rest = [c for c in df.columns if c not in keys]
    placed = global_position(df, keys, [F.col(c) for c in [*order, *rest]], "place")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rest])
    values = df.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, "c.column", "c.value").agg(F.lit(1).alias("_one"))
    counts = values.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"))
    # One row per group with a number per column meets the rows before they are spread into cells.
    counts = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("_counts"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = F.filter(cells, lambda c: (F.col("place") == 0) | (F.element_at("_counts", c["column"]) > 1))
    joined = placed.join(counts, same).select(*keys, "place", "_counts", F.explode(kept).alias("c"))
    return joined.select(*keys, "c.column", F.element_at("_counts", F.col("c.column")).alias("n_distinct"), "place", "c.value")


def datapoints(df: DataFrame, question: str, sql: str, db_id: str, order: list[str]) -> DataFrame:
    """One row per question of each (query, database): the first question of the whole group is ``nl_query`` of all its
    rows; ``nl_query_alt`` is the question at ``place`` 1, 2, .. and null at place 0, the row of the main question."""
    placed = global_position(df, [sql, db_id], [F.col(c) for c in [*order, question]], "place")
    first = placed.groupBy(F.col(sql).alias("_sql"), F.col(db_id).alias("_db")).agg(F.min_by(question, "place").alias("nl_query"))
    joined = placed.join(first, placed[sql].eqNullSafe(F.col("_sql")) & placed[db_id].eqNullSafe(F.col("_db")))
    alternative = F.when(F.col("place") > 0, F.col(question))
    return joined.select("nl_query", F.col(sql).alias("sql_query"), F.col(db_id).alias("db_id"), "place", alternative.alias("nl_query_alt"))


def renamed_split(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    names = names or {"dev": "val"}
    return df.replace(names, subset=["split"])


def question_pairs(df: DataFrame, question: str, sql: str, db_id: str) -> DataFrame:
    return df.select(F.col(question).alias("nl_query"), F.col(sql).alias("sql_query"), F.col(db_id).alias("db_id"))


def random_split(df: DataFrame, key: str, train_size: float = 0.8, seed: str = "") -> DataFrame:
    """Train/test split by a hash of the key: repeatable, and rows never change side."""
    bucket = md5_bucket(F.concat(F.lit(seed), F.col(key).cast("string")), 10_000)
    return df.withColumn("split", F.when(bucket < int(train_size * 10_000), "train").otherwise("test"))


def readable_structured(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Structured queries (column, aggregate, conditions by number) as SQL text with column names."""
    joined = queries.join(tables.select(F.col("id").alias("table_id"), "header"), "table_id")
    aggregates = F.array(*[F.lit(a) for a in STRUCTURED_AGGREGATES])
    comparisons = F.array(*[F.lit(c) for c in STRUCTURED_COMPARISONS])
    name = F.get("header", F.col("sql.sel"))
    selected = F.when(F.col("sql.agg") > 0, F.concat(F.get(aggregates, F.col("sql.agg")), F.lit("("), name, F.lit(")"))).otherwise(name)
    conditions = F.transform("sql.conds", lambda c: F.concat_ws(" ", F.get("header", c["i"]), F.get(comparisons, c["o"]), c["v"]))
    where = F.when(F.size("sql.conds") > 0, F.concat(F.lit(" WHERE "), F.array_join(conditions, " AND "))).otherwise("")
    return joined.withColumn("sql_text", F.concat(F.lit("SELECT "), selected, F.lit(" FROM table"), where)).drop("header")


def simple_web_table(df: DataFrame) -> DataFrame:
    """A nested web table as title, caption, header texts (first header row) and row texts."""
    return df.select(
        "tableId",
        F.col("pgTitle").alias("page_title"),
        F.col("sectionTitle").alias("section_title"),
        F.col("tableCaption").alias("caption"),
        F.transform(F.try_element_at(F.col("tableHeaders"), F.lit(1)), lambda c: c["text"]).alias("columns"),
        F.transform("tableData", lambda r: F.transform(r, lambda c: c["text"])).alias("rows"),
    )


# --- text fields and steps ------------------------------------------------------------------


def assembled(recipe: str) -> Column:
    """``{{datapoint.field}}`` marks of the recipe replaced by the fields of the row."""
    parts = re.split(r"\{\{datapoint\.(\w+)\}\}", recipe)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Callable[..., Step]] = {}


def step(name: str):
    """Register a factory of ``DataFrame -> DataFrame`` steps under a name."""
    def register(factory: Callable[..., Step]) -> Callable[..., Step]:
        STEPS[name] = factory
        return factory

    return register


@step("text_assemble")
def _assemble(recipe: str, dest_field: str) -> Step:
    return lambda df: df.withColumn(dest_field, assembled(recipe))


@step("copy_field")
def _copy(origin_field: str, dest_field: str) -> Step:
    return lambda df: df.withColumn(dest_field, F.col(origin_field))


@step("remove_extra_whitespace")
def _squeeze(source_field: str, dest_field: str | None = None) -> Step:
    from querycorpus.functions.text import squeeze

    return lambda df: df.withColumn(dest_field or source_field, squeeze(F.col(source_field)))


@step("lowercase_sql")
def _lower(field: str = "sql_query") -> Step:
    from querycorpus.operators.sqltext import lowercase_sql

    return lambda df: df.withColumn(field, lowercase_sql(F.col(field)))


@step("add_sql_whitespaces")
def _space(field: str = "sql_query") -> Step:
    from querycorpus.operators.sqltext import spaced_names

    return lambda df: df.withColumn(field, spaced_names(F.col(field)))


@step("remove_db_id")
def _strip(field: str = "prediction", separator: str = "|", expect_candidates: bool = False) -> Step:
    from querycorpus.operators.sqltext import strip_db_id

    if expect_candidates:
        return lambda df: df.withColumn("candidates", F.transform("candidates", lambda c: strip_db_id(c, separator)))
    return lambda df: df.withColumn(field, strip_db_id(F.col(field), separator))


@step("add_sql_asc_order_explicitly")
def _asc(field: str = "sql_query") -> Step:
    from querycorpus.operators.sqltext import explicit_order
    from querycorpus.operators.sqltokens import tokenized

    return lambda df: tokenized(df, field).withColumn(field, F.coalesce(explicit_order(F.col("tokens")), field)).drop("tokens", "scopes")


@step("sql_remove_table_aliases")
def _aliases(field: str = "sql_query") -> Step:
    from querycorpus.operators.sqltext import without_table_aliases
    from querycorpus.operators.sqltokens import tokenized

    return lambda df: tokenized(df, field).withColumn(field, F.coalesce(without_table_aliases(F.col("tokens")), field)).drop("tokens", "scopes")


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Apply named steps in order; Catalyst fuses the narrow ones into one projection."""
    unknown = [name for name, _ in steps if name not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known: {sorted(STEPS)}")
    return reduce(lambda d, s: d.transform(STEPS[s[0]](**s[1])), steps, df)


# --- prompts --------------------------------------------------------------------------------

INSTRUCTIONS = "Write one {database_type} query that answers the question, using only this schema:\n\n{database_schema}\n"
EXAMPLES = "### Examples:\n{examples}\n"
QUESTION = "### Input:\n{nl_query}\n"
# The layout of one shown example.
EXAMPLE = "#{number}.\n\n{schema}NL Question:\n{nl_query}\n\nSQL Query:\n{sql_query}\n\n"
EXAMPLE_SCHEMA = "Database Schema: {schema_text}\n"


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def with_examples(questions: DataFrame, examples: DataFrame, key: str, with_schema: bool = False) -> DataFrame:
    """Add the ordered ``examples`` of each question; ``examples`` has ``key, rank`` and at most k rows per key."""
    shown = ["rank", "nl_query", "sql_query"] + (["schema_text"] if with_schema else [])
    listed = examples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("examples"))
    return questions.join(listed, key, "left")


def prompts(
    questions: DataFrame,
    database_type: str = "PostgreSQL",
    few_shot: bool = False,
    with_schema: bool = False,
    instructions: str = INSTRUCTIONS,
    examples: str = EXAMPLES,
    question: str = QUESTION,
    example: str = EXAMPLE,
) -> DataFrame:
    """Add ``prompt``: instructions with the schema, numbered examples, the question."""
    values = {
        "database_type": F.lit(database_type),
        "database_schema": F.col("schema_text"),
        "nl_query": F.col("nl_query"),
    }

    def one(e: Column, i: Column) -> Column:
        shown = {"number": i.cast("string"), "nl_query": e["nl_query"], "sql_query": e["sql_query"]}
        if with_schema:
            shown["schema"] = _filled(EXAMPLE_SCHEMA, {"schema_text": e["schema_text"]})
        return _filled(example, {"schema": F.lit("")} | shown)

    parts = [_filled(instructions, values)]
    if few_shot:
        shown = F.coalesce(F.array_join(F.transform("examples", one), ""), F.lit(""))
        parts.append(_filled(examples, {"examples": shown}))
    parts.append(_filled(question, values))
    return questions.withColumn("prompt", F.concat(*parts))


def chats(
    questions: DataFrame,
    database_type: str = "PostgreSQL",
    few_shot: bool = False,
    with_schema: bool = False,
    instructions: str = INSTRUCTIONS,
    question: str = QUESTION,
) -> DataFrame:
    """Add ``chat``: system message, example turns, the question, as ``struct<role, content>``."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    values = {"database_type": F.lit(database_type), "database_schema": F.col("schema_text")}
    system = F.array(message("system", _filled(instructions, values)))
    asked = F.array(message("user", _filled(question, {"nl_query": F.col("nl_query")})))
    if not few_shot:
        return questions.withColumn("chat", F.concat(system, asked))

    def turns(e: Column) -> Column:
        schema = F.concat(F.lit("Database schema: "), e["schema_text"], F.lit("\n")) if with_schema else F.lit("")
        user = F.concat(schema, _filled(question, {"nl_query": e["nl_query"]}))
        answer = F.concat(F.lit("```sql\n"), e["sql_query"], F.lit("\n```"))
        return F.array(message("user", user), message("assistant", answer))

    given = F.flatten(F.transform("examples", turns))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return questions.withColumn("chat", F.concat(system, F.coalesce(given, empty), asked))


# --- value-linking records --------------------------------------------------------------------


def value_strings(values: Column) -> Column:
    """Value records as lower-case ``table.column.value`` texts."""
    return F.transform(values, lambda v: F.lower(F.concat_ws(".", v["table"], v["column"], v["value"])))


def textual_records(df: DataFrame) -> DataFrame:
    """Records that have values, all of them texts with a letter."""
    return df.where((F.size("values") > 0) & F.forall("values", lambda v: v["value"].rlike("[a-zA-Z]")))


def _value_words(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda v: F.filter(F.split(F.lower(v["value"]), r"\s+"), lambda w: w != "")))


def _misspelt(word: Column, draw: Callable[[str, Column], Column]) -> Column:
    """Insert a letter, or cut out what lies between two drawn places (they may cross)."""
    n = F.length(word)
    at = draw("place", n + 1).cast("int")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    letter = F.substring(F.lit(letters), draw("letter", F.lit(52)).cast("int") + 1, F.lit(1))
    inserted = F.concat(F.substring(word, F.lit(1), at), letter, F.substring(word, at + 1, n))
    head, tail = draw("head", n).cast("int"), draw("tail", n).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), head), F.substring(word, tail + 2, n))
    return F.when(n < 1, word).when(draw("kind", F.lit(2)) == 0, inserted).otherwise(cut)


def with_typos(df: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """Spelling errors in the value words of each question; only changed records stay.

    Every choice is a hash of (seed, key, word position), so a rerun gives the same text.
    """
    def changed(word: Column, i: Column) -> Column:
        def draw(what: str, n: Column) -> Column:
            text = F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), i.cast("string"), F.lit(what))
            return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n.cast("long"))

        return F.when(F.array_contains("_words", F.lower(word)), _misspelt(word, draw)).otherwise(word)

    base = pinned(df, "_words", _value_words(F.col("values")))
    text = held(F.col("_words"), F.array_join(F.transform(F.split(F.trim("question"), r"\s+"), changed), " "))
    return (
        base.withColumn("_new", text)
        .where(F.col("_new") != F.array_join(F.split(F.trim("question"), r"\s+"), " "))
        .withColumn("question", F.col("_new"))
        .drop("_new", "_words")
    )


def best_synonyms(lexicon: DataFrame) -> DataFrame:
    """The closest synonym of each word; equal similarity goes to the smaller synonym."""
    best = F.min_by("synonym", F.struct((-F.col("similarity")).alias("s"), "synonym"))
    return lexicon.where(F.lower("synonym") != F.col("word")).groupBy("word").agg(best.alias("synonym"))


def with_synonyms(df: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Value words replaced by their closest synonym, case kept; only changed records stay.

    Only the value words that occur in a question are looked up; they are joined back per record.
    """
    bare = "^[,.!?;:]+|[,.!?;:]+$"
    base = pinned(df, "_words", F.array_distinct(_value_words(F.col("values"))))
    base = pinned(base, "_said", F.split(F.trim("question"), r"\s+"))
    used = F.array_distinct(
        F.filter(
            F.transform("_said", lambda w: F.lower(F.regexp_replace(w, bare, ""))), lambda w: F.array_contains("_words", w)
        )
    )
    spread = base.select(key, F.explode(used).alias("word"))
    found = spread.join(best_synonyms(lexicon), "word").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "synonym"))).alias("_swap")
    )

    def new(word: Column) -> Column:
        stripped = F.regexp_replace(word, bare, "")
        other = F.element_at("_swap", F.lower(stripped))
        shown = F.when(word == F.lower(word), F.lower(other)).otherwise(
            F.concat(F.upper(F.substring(other, 1, 1)), F.lower(F.substring(other, F.lit(2), F.length(other))))
        )
        return F.when(other.isNotNull() & (shown != stripped), shown).otherwise(word)

    text = F.array_join(F.transform("_said", new), " ")
    return (
        base.join(found, key)
        .withColumn("_new", text)
        .where(F.col("_new") != F.array_join("_said", " "))
        .withColumn("question", F.col("_new"))
        .drop("_new", "_words", "_said", "_swap")
    )


def predictions_of_precision(truth: Column, predicted: Column, precision: float, key: Column, seed: str = "0") -> Column:
    """The truth padded with wrong predictions until its share is about ``precision``."""
    if not 0 < precision <= 1:
        raise ValueError("precision must be above 0 and at most 1")
    right = F.array_distinct(truth)
    if precision == 1:
        return right
    wanted = F.floor(F.size(truth) / F.lit(precision)).cast("int") - F.size(right)
    wrong = F.array_except(predicted, truth)
    drawn = F.transform(
        F.array_sort(
            F.transform(wrong, lambda w: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), w)).alias("h"), w.alias("w")))
        ),
        lambda s: s["w"],
    )
    return F.array_union(right, F.slice(drawn, F.lit(1), F.greatest(wanted, F.lit(0))))


def placeholder_companions(templates: DataFrame, key: str = "template_id", text: str = "text") -> DataFrame:
    """Placeholders of the templates and which occur together: ``placeholder, companion``.

    A placeholder that is always alone has one row with a null companion. Pairs are reduced per
    template first, so a placeholder of most templates is counted down before the shuffle.
    """
    marks = F.array_distinct(mark_names(F.col(text)))
    listed = templates.select(key, marks.alias("_m"))
    pairs = (
        listed.select("_m", F.explode("_m").alias("placeholder"))
        .select("placeholder", F.explode_outer(F.array_remove("_m", F.col("placeholder"))).alias("companion"))
        .distinct()
    )
    paired = pairs.where("companion IS NOT NULL")
    alone = pairs.where("companion IS NULL").join(paired.select("placeholder").distinct(), "placeholder", "left_anti")
    return paired.unionByName(alone)
