"""Corpus preparation on events, conversations, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.operators import corpus as D
from querycorpus.plans.inputs import table


def _pipe(c):
    return F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))


def grouped_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"), F.length("props").cast("string").alias("db_id"), "event_id", "user_id", F.length("props").alias("width")
    )
    return D.grouped_by_query(rows, ["query", "db_id"], ["event_id"])


def grouped_datapoints(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query"), F.col("props").alias("db_id"), F.col("event_id").cast("string").alias("question"),
        F.col("event_id").alias("at"),
    )
    return D.datapoints(rows, "question", "query", "db_id", ["at"])


def hashed_split(spark, sf_dir):
    return D.random_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.8, "s")


def structured_queries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    condition = F.struct(F.lit(0).alias("i"), (F.col("p_size") % 3).alias("o"), F.col("p_name").alias("v"))
    conds = F.when(F.col("p_size") % 2 == 0, F.array(condition)).otherwise(F.array().cast("array<struct<i:int,o:int,v:string>>"))
    queries = part.select(
        "p_partkey", F.col("p_type").alias("table_id"),
        F.struct((F.col("p_size") % 3).alias("sel"), (F.col("p_size") % 6).alias("agg"), conds.alias("conds")).alias("sql"),
    )
    headers = part.select(F.col("p_type").alias("id"), F.array(F.lit("name"), F.lower("p_type"), F.lit("size")).alias("header")).distinct()
    return D.readable_structured(queries, headers).select("p_partkey", "sql_text")


def web_tables(spark, sf_dir):
    text = lambda c: F.struct(c.cast("string").alias("text"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x")
    )
    nested = lines.select(
        F.col("l_orderkey").alias("tableId"), F.lit("Orders").alias("pgTitle"), F.lit("Lines").alias("sectionTitle"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("tableCaption"),
        F.array(F.array(text(F.lit("line")), text(F.lit("part")))).alias("tableHeaders"),
        F.transform("x", lambda r: F.array(text(r["l_linenumber"]), text(r["l_partkey"]))).alias("tableData"),
    )
    rows = F.transform("rows", lambda r: F.concat_ws(":", r))
    return D.simple_web_table(nested).select("tableId", "caption", F.concat_ws("|", "columns").alias("columns"), F.concat_ws("|", rows).alias("rows"))


def stepped_text(spark, sf_dir):
    rows = D.question_pairs(table(spark, sf_dir, "conversations").withColumn("db", F.concat_ws("_", "conv_id", "turn")), "text", "role", "db")
    done = D.run_steps(
        rows,
        [
            ("remove_extra_whitespace", {"source_field": "nl_query"}),
            ("text_assemble", {"recipe": "{{datapoint.db_id}} | {{datapoint.sql_query}} : {{datapoint.nl_query}}", "dest_field": "model_input"}),
            ("copy_field", {"origin_field": "model_input", "dest_field": "prediction"}),
            ("remove_db_id", {}),
            ("add_sql_whitespaces", {"field": "db_id"}),
        ],
    )
    return done.select("nl_query", "sql_query", "db_id", "model_input", "prediction")


def _asked(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    questions = turns.select("qid", "conv_id", "turn", F.col("text").alias("nl_query"), F.upper("role").alias("schema_text"))
    earlier = turns.select("conv_id", F.col("turn").alias("rank"), F.col("text").alias("shown"), F.col("role").alias("sql_query"))
    wanted = questions.withColumn("rank", F.explode(F.array(F.col("turn") - 2, F.col("turn") - 1)))
    examples = wanted.join(earlier, ["conv_id", "rank"]).select("qid", "rank", F.col("shown").alias("nl_query"), "sql_query", "schema_text")
    return D.with_examples(questions, examples, "qid", with_schema=True)


def few_shot_prompts(spark, sf_dir):
    return D.prompts(_asked(spark, sf_dir), few_shot=True, with_schema=True).select("qid", "prompt")


def few_shot_chats(spark, sf_dir):
    chat = F.transform("chat", lambda m: F.concat(m["role"], F.lit(">"), m["content"]))
    return D.chats(_asked(spark, sf_dir), few_shot=True).select("qid", F.concat_ws("\n", chat).alias("chat"), F.size("chat").alias("n"))


def zero_shot_prompts(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    last = F.try_element_at(F.col("chat"), F.lit(-1))["content"]
    return D.chats(D.prompts(asked, "SQLite"), "SQLite").select("qid", "prompt", F.size("chat").alias("n"), last.alias("asked"))


def _records(spark, sf_dir):
    def value(column, text):
        return F.struct(F.lit("Part").alias("table"), F.lit(column).alias("column"), text.cast("string").alias("value"), F.lit("=").alias("condition"))

    named = F.array(value("p_name", F.col("p_name")), value("p_brand", F.col("p_brand")))
    sized = F.concat(named, F.array(value("p_size", F.col("p_size"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.concat(F.lit("Show "), F.initcap("p_name"), F.lit(", the one")).alias("question"),
        F.lit("star").alias("db_id"), F.when(F.col("p_size") % 3 == 0, sized).otherwise(named).alias("values"),
    )


def value_strings(spark, sf_dir):
    kept = D.textual_records(_records(spark, sf_dir))
    return kept.select("p_partkey", F.concat_ws("|", D.value_strings(F.col("values"))).alias("links"))


def misspelt_questions(spark, sf_dir):
    return D.with_typos(_records(spark, sf_dir), "p_partkey", "7").select("p_partkey", "question")


def synonym_questions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lexicon = part.groupBy(F.substring_index("p_name", " ", 1).alias("word"), F.lower("p_type").alias("synonym")).agg(
        F.round(F.avg("p_size"), 6).alias("similarity")
    )
    return D.with_synonyms(_records(spark, sf_dir), lexicon, "p_partkey").select("p_partkey", "question")


def padded_predictions(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_discount") < 0.05, part)).alias("truth"), F.collect_set(part).alias("pred")
    )
    padded = D.predictions_of_precision(F.col("truth"), F.col("pred"), 0.5, F.col("l_orderkey"))
    added = F.array_except("p", "truth")  # in the order drawn
    return lists.withColumn("p", padded).select(
        "l_orderkey", F.size("p").alias("n"), F.size(F.array_except("truth", "p")).alias("n_lost"), F.concat_ws("|", added).alias("added")
    )


def placeholder_pairs(spark, sf_dir):
    text = F.concat(F.lit("the {"), "p_brand", F.lit("}"), F.when(F.col("p_size") > 25, F.concat(F.lit(" of {"), "p_type", F.lit("} {"), "p_brand", F.lit("}"))).otherwise(""))
    templates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), text.alias("text"))
    return D.placeholder_companions(templates)


QUERIES = {
    f.__name__: f
    for f in [
        grouped_rows, grouped_datapoints, hashed_split, structured_queries, web_tables, stepped_text, few_shot_prompts, few_shot_chats,
        zero_shot_prompts, value_strings, misspelt_questions, synonym_questions, padded_predictions, placeholder_pairs,
    ]
}

_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SHOWN = """turns AS (SELECT *, conv_id * 1000 + turn AS qid FROM conversations),
    ex AS (SELECT q.qid, upper(q.role) AS schema_text, e.turn AS rank, e.text, e.role,
             row_number() OVER (PARTITION BY q.qid ORDER BY e.turn, e.text, e.role) - 1 AS k
           FROM turns q JOIN turns e ON q.conv_id = e.conv_id AND e.turn < q.turn AND e.turn >= q.turn - 2)"""
_HEAD = "'Write one {t} query that answers the question, using only this schema:' || chr(10) || chr(10) || upper(q.role) || chr(10)"
_ASK = "'### Input:' || chr(10) || q.text || chr(10)"
_W = ["Show", "initcap1", "initcap2", "the", "one"]


def _draw(i, what, n):
    return f"(CAST('0x' || substr(md5('7|' || p_partkey || '|{i}|{what}'), 1, 8) AS BIGINT) % ({n}))"


def _typo(word, i):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    n = f"length({word})"
    ins = f"substr({word}, 1, {_draw(i, 'place', n + ' + 1')}) || substr('{letters}', {_draw(i, 'letter', 52)} + 1, 1) || substr({word}, {_draw(i, 'place', n + ' + 1')} + 1)"
    cut = f"substr({word}, 1, {_draw(i, 'head', n)}) || substr({word}, {_draw(i, 'tail', n)} + 2)"
    return f"CASE WHEN {_draw(i, 'kind', 2)} = 0 THEN {ins} ELSE {cut} END"


_CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"

ORACLES = {
    "grouped_rows": """WITH e AS (SELECT event_type AS query, CAST(length(props) AS VARCHAR) AS db_id, event_id, user_id, length(props) AS width,
            row_number() OVER (PARTITION BY event_type, length(props) ORDER BY event_id) - 1 AS place FROM events),
        c AS (SELECT query, db_id, place, 'event_id' AS "column", CAST(event_id AS VARCHAR) AS value FROM e
              UNION ALL SELECT query, db_id, place, 'user_id', CAST(user_id AS VARCHAR) FROM e UNION ALL SELECT query, db_id, place, 'width', CAST(width AS VARCHAR) FROM e),
        n AS (SELECT query, db_id, "column", count(DISTINCT value) AS n_distinct FROM c GROUP BY ALL)
        SELECT query, db_id, "column", n_distinct, place, value FROM c JOIN n USING (query, db_id, "column") WHERE n_distinct > 1 OR place = 0""",
    "grouped_datapoints": """SELECT CAST(first_value(event_id) OVER w AS VARCHAR) AS nl_query, event_type AS sql_query, props AS db_id,
        row_number() OVER w - 1 AS place, CASE WHEN row_number() OVER w > 1 THEN CAST(event_id AS VARCHAR) END AS nl_query_alt
        FROM events WINDOW w AS (PARTITION BY event_type, props ORDER BY event_id)""",
    "hashed_split": """SELECT c_custkey, CASE WHEN CAST('0x' || substr(md5('s' || c_custkey), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'test' END AS split
        FROM customer""",
    "structured_queries": """SELECT p_partkey, 'SELECT ' || CASE p_size % 6 WHEN 0 THEN h WHEN 1 THEN 'MAX(' || h || ')' WHEN 2 THEN 'MIN(' || h || ')'
        WHEN 3 THEN 'COUNT(' || h || ')' WHEN 4 THEN 'SUM(' || h || ')' ELSE 'AVG(' || h || ')' END || ' FROM table' ||
        CASE WHEN p_size % 2 = 0 THEN ' WHERE name ' || CASE p_size % 3 WHEN 0 THEN '=' WHEN 1 THEN '>' ELSE '<' END || ' ' || p_name ELSE '' END AS sql_text
        FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'name' WHEN 1 THEN lower(p_type) ELSE 'size' END AS h FROM part)""",
    "web_tables": """SELECT l_orderkey AS tableId, 'order ' || l_orderkey AS caption, 'line|part' AS columns,
        string_agg(l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY l_orderkey""",
    "stepped_text": f"""SELECT t AS nl_query, role AS sql_query, conv_id || ' _ ' || turn AS db_id, conv_id || '_' || turn || ' | ' || role || ' : ' || t AS model_input,
        role || ' : ' || t AS prediction FROM (SELECT *, {_SQUEEZED} AS t FROM conversations)""",
    "few_shot_prompts": f"""WITH {_SHOWN}, l AS (SELECT qid, string_agg('#' || k || '.' || chr(10) || chr(10) || 'Database Schema: ' || schema_text || chr(10) ||
          'NL Question:' || chr(10) || text || chr(10) || chr(10) || 'SQL Query:' || chr(10) || role || chr(10) || chr(10), '' ORDER BY k) AS x FROM ex GROUP BY qid)
        SELECT q.qid, {_HEAD.replace('{t}', 'PostgreSQL')} || '### Examples:' || chr(10) || coalesce(x, '') || chr(10) || {_ASK} AS prompt
        FROM turns q LEFT JOIN l USING (qid)""",
    "few_shot_chats": f"""WITH {_SHOWN}, l AS (SELECT qid, count(*) AS n, string_agg('user>### Input:' || chr(10) || text || chr(10) || chr(10) ||
          'assistant>```sql' || chr(10) || role || chr(10) || '```' || chr(10), '' ORDER BY k) AS x FROM ex GROUP BY qid)
        SELECT q.qid, 'system>' || {_HEAD.replace('{t}', 'PostgreSQL')} || chr(10) || coalesce(x, '') || 'user>' || {_ASK} AS chat,
               CAST(2 + 2 * coalesce(n, 0) AS INT) AS n FROM turns q LEFT JOIN l USING (qid)""",
    "zero_shot_prompts": f"""SELECT conv_id * 1000 + turn AS qid, {_HEAD.replace('{t}', 'SQLite')} || {_ASK} AS prompt, 2 AS n, {_ASK} AS asked FROM conversations q""",
    "value_strings": "SELECT p_partkey, 'part.p_name.' || lower(p_name) || '|part.p_brand.' || lower(p_brand) AS links FROM part WHERE p_size % 3 <> 0",
    "misspelt_questions": f"""WITH w AS (SELECT p_partkey, {_CAP.format("split_part(p_name, ' ', 1)")} AS a, {_CAP.format("split_part(p_name, ' ', 2)")} || ',' AS b,
          split_part(p_name, ' ', 2) AS bare FROM part)
        SELECT p_partkey, 'Show ' || new || ' ' || b || ' the one' AS question FROM (SELECT *, {_typo('a', 1)} AS new FROM w) WHERE new <> a""",
    "synonym_questions": f"""WITH lex AS (SELECT split_part(p_name, ' ', 1) AS word, lower(p_type) AS synonym, round(avg(p_size), 6) AS s FROM part GROUP BY ALL),
        best AS (SELECT * FROM lex WHERE synonym <> word QUALIFY row_number() OVER (PARTITION BY word ORDER BY s DESC, synonym) = 1)
        SELECT p_partkey, 'Show ' || {_CAP.format('synonym')} || ' ' || {_CAP.format("split_part(p_name, ' ', 2)")} || ', the one' AS question
        FROM part JOIN best ON word = split_part(p_name, ' ', 1)""",
    "padded_predictions": """WITH o AS (SELECT l_orderkey, l_partkey, bool_or(l_discount < 0.05) AS true_one FROM lineitem GROUP BY ALL),
        r AS (SELECT *, count(*) FILTER (true_one) OVER (PARTITION BY l_orderkey) AS t,
                     row_number() OVER (PARTITION BY l_orderkey, true_one ORDER BY md5('0|' || l_orderkey || '|' || l_partkey)) AS k FROM o)
        SELECT l_orderkey, CAST(count(*) FILTER (true_one OR k <= t) AS INT) AS n, 0 AS n_lost,
               coalesce(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY k) FILTER (NOT true_one AND k <= t), '') AS added FROM r GROUP BY l_orderkey""",
    "placeholder_pairs": """WITH pairs AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part WHERE p_size > 25)
        SELECT b AS placeholder, t AS companion FROM pairs UNION ALL SELECT t, b FROM pairs
        UNION ALL SELECT DISTINCT p_brand, NULL FROM part WHERE p_brand NOT IN (SELECT b FROM pairs)""",
}
