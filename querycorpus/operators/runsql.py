"""Run user queries on registered views and shape their results."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from querycorpus.functions.scale import cut_lineage
from querycorpus.functions.text import fill_marks

DEFAULT_LIMIT = 500
SERVICE_CAP = 60
DATE_PATTERN = r"^(\d{2,4}-\d{2}-\d{2,4})+"
DATE_INPUTS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd-MM-yyyy", "dd-MM-yy", "yy-MM-dd"]

#: What a failing query raises; some failures inside of subqueries come as they left the JVM.
FAILURES = (PySparkException, Py4JJavaError)

_SKIPPED = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", re.S)
_QUOTED = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'", re.S)
_MARK = re.compile(r"\{(.*?)\}")
_STARTERS = {"select", "with", "values", "table"}
_WRITERS = {"insert", "delete", "update", "merge", "from", "select", "values", "table"}


def require_read_only(sql: str) -> None:
    """Refuse anything but one query, before Spark sees it (``spark.sql`` runs commands at once).

    A statement that opens with SELECT, VALUES or TABLE is a query. After WITH the first
    keyword outside the parentheses of the named queries decides.
    """
    bare = _SKIPPED.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise ValueError("only one statement is accepted")
    words = re.findall(r"\w+|[()]", bare.lower())
    first = next((w for w in words if w != "("), "")
    if first == "with":
        depth, first = 0, ""
        for word in words[1:]:
            depth += {"(": 1, ")": -1}.get(word, 0)
            if depth == 0 and word in _WRITERS:
                first = word
                break
        if not first:
            first = "select" if bare.startswith("(") else ""
    if first not in _STARTERS:
        raise ValueError("only queries are accepted; pass read_only=False for other statements")


def run_query(
    spark: SparkSession,
    sql: str,
    limit: int = DEFAULT_LIMIT,
    random_order: bool = False,
    seed: int | None = None,
    fix_dates: bool = False,
    date_format: str = "dd/MM/yyyy",
    read_only: bool = True,
) -> DataFrame:
    """Run a query; ``limit`` of -1 or 0 means no cap. The user's own LIMIT stays in force."""
    if read_only:
        require_read_only(sql)
    result = spark.sql(sql)
    if random_order:
        result = result.orderBy(F.rand(seed) if seed is not None else F.rand())
    if limit not in (-1, 0):
        result = result.limit(limit)
    return reformat_dates(result, date_format) if fix_dates else result


def capped(spark: SparkSession, sql: str, cap: int = SERVICE_CAP) -> DataFrame:
    """The smaller of the user's own LIMIT and ``cap`` (Catalyst combines the two limits)."""
    require_read_only(sql)
    return spark.sql(sql).limit(cap)


def reformat_dates(df: DataFrame, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Rewrite the columns in which every value looks like a date; one pass decides for all."""
    names = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, StringType | DateType | TimestampType | TimestampNTZType)
    ]
    if not names:
        return df
    checks = [
        F.bool_and(F.coalesce(F.col(f"`{n}`").cast("string").rlike(DATE_PATTERN), F.lit(False))).alias(f"_{i}")
        for i, n in enumerate(names)
    ]
    verdict = df.agg(*checks).first()
    dated = {n for i, n in enumerate(names) if verdict[i]}

    def shown(field) -> Column:
        c = F.col(f"`{field.name}`")
        if field.name not in dated:
            return c
        if isinstance(field.dataType, StringType):
            c = reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(c, F.lit(p)) for p in DATE_INPUTS])
        return F.date_format(c, date_format).alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def without_marked_columns(df: DataFrame, marker: str = "sk_id") -> DataFrame:
    return df.drop(*[c for c in df.columns if marker in c])


def with_companion_key(source: DataFrame, selection: list[str], trigger: str, key: str) -> DataFrame:
    """Project ``selection``; add ``key`` when a trigger column is shown and the key is not."""
    shown = list(selection)
    if key not in shown and any(trigger in c for c in shown):
        shown.append(key)
    return source.select(*shown)


def filled_templates(templates: DataFrame, values: DataFrame) -> DataFrame:
    """Every template with every value map of its template id: ``template_id, filled``."""
    return templates.join(values, "template_id").select(
        "template_id", fill_marks(F.col("sql"), F.col("marks")).alias("filled")
    )


def _parts(sql: str) -> list[tuple[str, bool]]:
    """The text in turn outside and inside of quotes (these without their quotes); comments are blanks."""
    out, at = [("", False)], 0
    for m in _QUOTED.finditer(sql):
        outside = out[-1][0] + sql[at : m.start()]
        if m.group().startswith("'"):
            out[-1:] = [(outside, False), (m.group()[1:-1], True), ("", False)]
        else:
            out[-1] = (outside + " ", False)
        at = m.end()
    return [*out[:-1], (out[-1][0] + sql[at:], False)]


def _kind(mark: Column, quoted: bool) -> Column:
    """How a mark can be a column: the type of its literal, or "=" and its text if it must be part of the query."""
    if quoted:
        return F.when(mark.rlike(r"['\\]"), F.concat(F.lit("="), mark)).when(mark.isNotNull(), "text")
    digits = F.length(F.regexp_replace(mark, r"\D", ""))
    scale = F.length(F.substring_index(mark, ".", -1))
    return (
        F.when(mark.rlike(r"^[+-]?\d{1,9}$"), "int")
        .when(mark.rlike(r"^[+-]?\d{10,18}$"), "bigint")
        .when(mark.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$") & (digits <= 38), F.concat(F.lit("decimal("), digits.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(mark.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), "double")
        .otherwise(F.concat(F.lit("="), mark))
    )


def _joined_form(parts: list[tuple[str, bool]], kinds: dict[tuple[str, bool], str], column: dict[str, str]) -> str:
    """The query with its marks as columns, or as text where they must be."""
    out = []
    for text, quoted in parts:
        pieces = _MARK.split(text)
        shown = [pieces[0]]
        for name, after in zip(pieces[1::2], pieces[2::2]):
            kind = kinds[name, quoted]
            if kind.startswith("="):
                shown[-1] += kind[1:] + after
            else:
                shown += [column[name] if quoted else f"CAST({column[name]} AS {kind})", after]
        if not quoted:
            out.append("".join(shown))
        elif len(shown) == 1:
            out.append(f"'{shown[0]}'")
        else:
            out.append("concat(" + ", ".join(x if i % 2 else f"'{x}'" for i, x in enumerate(shown)) + ")")
    return "".join(out).rstrip().rstrip(";")


def _can_be_query(sql: str) -> bool:
    """False if a template is a command whatever its marks hold."""
    if sql.lstrip(" (\n\t").startswith("{"):
        return True
    try:
        require_read_only(_MARK.sub("x", sql))
    except ValueError:
        return False
    return True


def _status_of(spark: SparkSession, sql: str) -> str:
    try:
        require_read_only(sql)
        return "rows" if spark.sql(sql).limit(1).collect() else "empty"
    except (*FAILURES, ValueError):
        return "error"


def _without_repeats(spark: SparkSession, body: str, view: str) -> str:
    """The query as one that brings each value that the fillings are compared with once, so that its rows are neither broadcast nor
    shuffled; as it is, where that would take one more join with the marks (they are not compared by plain equality)."""
    if f"{view}." not in body:
        return body
    shorter = f"SELECT DISTINCT 1 FROM ({body}\n) _rows"

    def joins(query: str) -> int:
        return len(re.findall("Join|CartesianProduct", spark.sql(f"EXPLAIN SELECT filled FROM {view} WHERE EXISTS ({query})").first()[0]))

    try:
        return shorter if joins(shorter) <= joins(body) else body
    except PySparkException:
        return body


def _statuses(spark: SparkSession, fillings: DataFrame, body: str, view: str, depth: int = 0) -> DataFrame:
    """``filled, status`` of fillings that share one query. If it fails for all at once, halves are tried, down to single fillings,
    whose own text decides; so e failing ones among n cost about e * log2(n) more jobs."""
    fillings.createOrReplaceTempView(view)
    try:
        found = cut_lineage(spark.sql(f"SELECT filled FROM {view} WHERE EXISTS ({body})"))
        rows = fillings.select("filled").join(found.withColumn("status", F.lit("rows")), "filled", "left")
        return rows.select("filled", F.coalesce("status", F.lit("empty")).alias("status"))
    except FAILURES:
        few = [r["filled"] for r in fillings.select("filled").limit(2).collect()]
        if len(few) < 2:
            return spark.createDataFrame([(x, _status_of(spark, x)) for x in few], "filled string, status string")
    finally:
        spark.catalog.dropTempView(view)
    # Fillings differ in their 128 bits, so that halving ends.
    bits = F.conv(F.substring(F.md5("filled"), depth // 4 + 1, 1), 16, 10).cast("int")
    side = F.pmod(F.shiftright(bits, depth % 4), F.lit(2))
    halves = [cut_lineage(fillings.where(side == b)) for b in (0, 1)]
    return reduce(DataFrame.unionByName, [_statuses(spark, half, body, view, depth + 1) for half in halves if not half.isEmpty()])


def audit_templates(spark: SparkSession, templates: list[tuple[int, str]], values: DataFrame) -> DataFrame:
    """Status of every filling of every template: ``template_id, filled, status`` with ``rows``, ``empty`` or ``error``, as if each
    filled text ran by itself.

    ``values`` holds ``(template_id, marks)`` with one map per filling, as many as there may be; a filling that lacks a mark is an error.
    Marks that are literals become columns of the values and a template runs once for all fillings of the same literal types; fillings
    for which the query has a row are found by a semi-join. Marks that are names or expressions, or that hold quotes, are part of the
    query, which then runs once for each of their different texts. An error belongs to the fillings that cause it: see ``_statuses``.
    A template whose query can't be joined so (a LIMIT or aggregate around a mark, say) is refused; ``audit_queries`` runs such
    texts one by one.
    """
    out = []
    for template_id, sql in templates:
        parts = _parts(sql)
        uses = sorted({(name, quoted) for text, quoted in parts for name in _MARK.findall(text)})
        names = sorted({name for name, _ in uses})
        own = values.where(F.col("template_id") == template_id).select("marks", fill_marks(F.lit(sql), F.col("marks")).alias("filled"))
        own = own.select(F.coalesce("filled", F.lit(sql)).alias("filled"), "marks").dropDuplicates(["filled"])
        kinds = F.array(*[_kind(F.col("marks")[name], quoted) for name, quoted in uses]).cast("array<string>")
        own = cut_lineage(own.select("filled", kinds.alias("kinds"), *[F.col("marks")[n].alias(f"_mark_{i}") for i, n in enumerate(names)]))
        lacking = F.exists("kinds", lambda k: k.isNull())

        def failed(rows: DataFrame) -> DataFrame:
            return rows.select("filled", F.lit("error").alias("status"))

        found = [failed(own.where(lacking))]
        if not _can_be_query(sql):
            out.append(failed(own.where(~lacking)).select(F.lit(template_id).alias("template_id"), "filled", "status"))
            own = own.limit(0)
        for shape in own.where(~lacking).groupBy("kinds").agg(F.min("filled").alias("one")).collect():
            same = own.where(F.col("kinds") == F.array(*[F.lit(k) for k in shape["kinds"]]).cast("array<string>"))
            try:
                require_read_only(shape["one"])
                spark.sql(shape["one"])
            except (PySparkException, ValueError):
                found.append(failed(same))
                continue
            view = f"_fillings_{uuid.uuid4().hex}"
            body = _joined_form(parts, dict(zip(uses, shape["kinds"])), {n: f"{view}._mark_{i}" for i, n in enumerate(names)})
            same.createOrReplaceTempView(view)
            try:
                spark.sql(f"SELECT filled FROM {view} WHERE EXISTS ({body})")
            except PySparkException as error:
                raise ValueError(f"template {template_id} can't run for all its fillings at once: {str(error).splitlines()[0]}") from error
            found.append(_statuses(spark, same, _without_repeats(spark, body, view), view))
        out += [rows.select(F.lit(template_id).alias("template_id"), "filled", "status") for rows in found]
    return reduce(DataFrame.unionByName, out)


def audit_queries(spark: SparkSession, queries: list[str]) -> DataFrame:
    """Status of each query: ``rows``, ``empty`` or ``error``. Each query is a distributed job of its own that fetches at most
    one row, so this is for lists as long as a user writes; templates with many fillings go to ``audit_templates``."""
    return spark.createDataFrame([(sql, _status_of(spark, sql)) for sql in queries], "filled string, status string")
