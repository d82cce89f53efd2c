"""Value links, link scores, partial match and BLEU on derived pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.operators import linking as K
from querycorpus.operators import metrics as M
from querycorpus.plans.inputs import given, table, with_inputs


def _links(spark, sf_dir):
    values = K.pick_list(given(spark, sf_dir, "stored_values"))
    return K.best_links(K.value_matches(given(spark, sf_dir, "questions"), values, measure="levenshtein"))


def value_links(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "question_id", "table_name", "column", "value", "rank", "size", F.round("score", 6).alias("score")
    )


def nested_value_links(spark, sf_dir):
    nested = K.nested_links(_links(spark, sf_dir))
    labels = F.element_at(F.element_at("value_links", "part"), "p_label")
    return nested.select("question_id", F.size("value_links").alias("tables"), F.concat_ws("|", labels).alias("labels"))


def indel_links(spark, sf_dir):
    """Links by the insert/delete ratio, the default measure."""
    values = K.pick_list(given(spark, sf_dir, "stored_values"))
    found = K.value_matches(given(spark, sf_dir, "questions"), values)
    return K.best_links(found).select("question_id", "table_name", "column", "value", "rank", F.round("score", 6).alias("score"))


def _records(spark, sf_dir):
    name, brand = F.concat(F.lit("part.p_name."), "p_name"), F.concat(F.lit("part.p_brand."), "p_brand")
    size = F.concat(F.lit("part.p_size."), F.col("p_size").cast("string"))
    price = F.concat(F.lit("part.p_rate."), F.col("p_retailprice").cast("string"), F.lit("%"))
    truth = F.when(F.col("p_size") % 5 == 0, F.array(size, price)).when(F.col("p_size") % 5 == 1, F.array().cast("array<string>")).otherwise(
        F.array(name, brand, size)
    )
    pred = F.when(F.col("p_size") % 3 == 0, F.array(name, brand)).when(F.col("p_size") % 3 == 1, F.array(name, F.lit("part.p_brand.none"), size)).otherwise(
        F.array(size)
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), truth.alias("gt"), pred.alias("pred"))


def link_scores(spark, sf_dir):
    records = _records(spark, sf_dir)
    pairs = K.paired_records(records.select("idx", "gt"), records.select("idx", "pred"))
    both = K.link_scores(pairs).withColumn("kind", F.lit("all")).unionByName(K.link_scores(pairs, True).withColumn("kind", F.lit("textual")))
    names = ["inclusion", "precision", "column_recall", "recall"]
    return both.select("kind", "records", *[F.round(n, 6).alias(n) for n in names])


def link_mismatches(spark, sf_dir):
    return K.mismatches(_records(spark, sf_dir), True).select("idx", F.round("recall", 6).alias("recall"))


def partial_match(spark, sf_dir):
    pairs = given(spark, sf_dir, "sql_pairs").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    scores = M.partial_match(pairs)
    return scores.select("pair_id", *[F.round(c, 6).alias(c) for c in scores.columns if c != "pair_id"])


def variable_errors(spark, sf_dir):
    return M.variable_errors(given(spark, sf_dir, "sql_pairs").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def corpus_bleu(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    refs = F.array(F.replace("text", F.lit(" the "), F.lit(" a ")), F.replace("text", F.lit(" of "), F.lit(" on in ")))
    scored = M.corpus_bleu(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"), refs.alias("refs")))
    return scored.select("pred_len", "ref_len", *[F.round(c, 6).alias(c) for c in scored.columns if not c.endswith("_len")])


def list_overlap(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_tax") > 0.03, F.col("l_partkey"))).alias("b")
    )
    return lists.select("l_orderkey", F.round(M.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


QUERIES = {
    f.__name__: f
    for f in [value_links, nested_value_links, indel_links, link_scores, link_mismatches, partial_match, variable_errors, corpus_bleu, list_overlap]
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in [*K.STOP_WORDS, *K.COMMON_NAMES])
_MATCHED = f"""words AS (SELECT question_id, list_filter(string_split_regex(lower(question), '[''"()`,.?! ]+'), lambda w: w <> '') AS w FROM questions),
    spans AS (SELECT DISTINCT question_id, array_to_string(w[s:s + n - 1], ' ') AS span FROM words, range(1, 21) a(s), range(1, 7) b(n)
              WHERE s + n - 1 <= len(w)),
    scored AS (SELECT question_id, table_name, column_name, value, span, 1 - levenshtein(lower(value), span) / greatest(length(value), length(span)) AS score
               FROM spans, stored_values WHERE left(span, 1) = left(lower(value), 1) AND abs(length(span) - length(value)) <= 4
                 AND length(span) > 1 AND NOT regexp_matches(span, '^[0-9]+$') AND span NOT IN ({_STOP}) AND lower(value) NOT IN ({_STOP})),
    kept AS (SELECT question_id, table_name, column_name, value, max(score) AS score,
               CAST(max_by(length(span), score * 1000 + length(span)) AS INT) AS size
             FROM scored WHERE score >= 0.85 AND (score = 1 OR (value <> upper(value) AND column_name NOT LIKE '%name%')) GROUP BY ALL),
    links AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_name, column_name ORDER BY score DESC, size DESC, value) AS rank FROM kept)"""
# The longest common subsequence by rows of its table, one per letter of a value; the edit distance is never greater than the number
# of insertions and deletions, so it rules most pairs out beforehand.
_INDEL = f"""words AS (SELECT question_id, list_filter(string_split_regex(lower(question), '[''"()`,.?! ]+'), lambda w: w <> '') AS w FROM questions),
    spans AS (SELECT DISTINCT question_id, array_to_string(w[s:s + n - 1], ' ') AS span FROM words, range(1, 21) a(s), range(1, 7) b(n)
              WHERE s + n - 1 <= len(w)),
    pairs AS (SELECT norm, span FROM (SELECT DISTINCT lower(trim(value)) AS norm FROM stored_values), (SELECT DISTINCT span FROM spans)
              WHERE left(span, 1) = left(norm, 1) AND levenshtein(norm, span) <= 0.15 * (length(norm) + length(span)) + 1e-9
                AND length(span) > 1 AND NOT regexp_matches(span, '^[0-9]+$') AND span NOT IN ({_STOP}) AND norm NOT IN ({_STOP})),
    tables AS (SELECT norm, span, list_reduce(list_transform(string_split(norm, ''), lambda c: [unicode(c)]),
                 lambda above, c: list_reduce(list_transform(range(1, length(span) + 1), lambda j: [CAST(j AS INT)]),
                   lambda line, j: list_append(line, CASE WHEN unicode(span[j[1]]) = c[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], line[j[1]]) END), [0]),
                 list_transform(range(0, length(span) + 1), lambda j: 0)) AS bottom FROM pairs),
    scored AS (SELECT norm, span, 2.0 * bottom[-1] / (length(norm) + length(span)) AS score FROM tables),
    kept AS (SELECT question_id, table_name, column_name, value, max(score) AS score, CAST(max_by(length(span), score * 1000 + length(span)) AS INT) AS size
             FROM scored JOIN spans USING (span) JOIN stored_values ON lower(trim(value)) = norm
             WHERE score >= 0.85 - 1e-9 AND (score = 1 OR (value <> upper(value) AND column_name NOT LIKE '%name%')) GROUP BY ALL),
    links AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_name, column_name ORDER BY score DESC, size DESC, value) AS rank FROM kept)"""
_LISTS = """r AS (SELECT p_partkey AS idx,
      CASE WHEN p_size % 5 = 0 THEN ['part.p_size.' || p_size, 'part.p_rate.' || CAST(p_retailprice AS VARCHAR) || '%'] WHEN p_size % 5 = 1 THEN CAST([] AS VARCHAR[])
           ELSE ['part.p_name.' || p_name, 'part.p_brand.' || p_brand, 'part.p_size.' || p_size] END AS gt,
      CASE WHEN p_size % 5 IN (0, 1) THEN CAST([] AS VARCHAR[]) ELSE ['part.p_name.' || p_name, 'part.p_brand.' || p_brand] END AS txt,
      CASE p_size % 3 WHEN 0 THEN ['part.p_name.' || p_name, 'part.p_brand.' || p_brand]
           WHEN 1 THEN ['part.p_name.' || p_name, 'part.p_brand.none', 'part.p_size.' || p_size] ELSE ['part.p_size.' || p_size] END AS pred FROM part),
    f AS (SELECT 'all' AS kind, idx, gt AS t, pred, true AS counted FROM r UNION ALL SELECT 'textual', idx, txt, pred, len(txt) > 0 FROM r),
    g AS (SELECT *, len(list_filter(t, lambda v: list_contains(pred, v))) AS found,
            list_has_all(list_transform(pred, lambda v: split_part(v, '.', 2)), list_transform(t, lambda v: split_part(v, '.', 2))) AS cols FROM f)"""


def _bleu():
    w = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
    grams = lambda src: " UNION ALL ".join(
        f"SELECT id, r, {n} AS n, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT id, r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {src})" for n in range(1, 5)
    )
    return f"""WITH docs AS (SELECT doc_id AS id, text AS p, replace(text, ' the ', ' a ') AS a, replace(text, ' of ', ' on in ') AS b FROM documents),
      t AS (SELECT id, 0 AS r, {w.format('p')} AS w FROM docs UNION ALL SELECT id, 1, {w.format('a')} FROM docs UNION ALL SELECT id, 2, {w.format('b')} FROM docs),
      gr AS ({grams('t')}), c AS (SELECT id, r, n, g, count(*) AS c FROM gr GROUP BY ALL),
      m AS (SELECT id, n, g, max(c) AS most FROM c WHERE r > 0 GROUP BY ALL),
      x AS (SELECT c.n, sum(least(c.c, coalesce(m.most, 0))) AS hit, sum(c.c) AS total FROM c LEFT JOIN m ON c.id = m.id AND c.n = m.n AND c.g = m.g
            WHERE c.r = 0 GROUP BY c.n),
      l AS (SELECT id, max(CASE WHEN r = 0 THEN len(w) END) AS p, max(CASE WHEN r = 1 THEN len(w) END) AS a, max(CASE WHEN r = 2 THEN len(w) END) AS b FROM t GROUP BY id),
      s AS (SELECT CAST(sum(p) AS BIGINT) AS pred_len, CAST(sum(CASE WHEN abs(a - p) < abs(b - p) OR (abs(a - p) = abs(b - p) AND a <= b) THEN a ELSE b END) AS BIGINT) AS ref_len FROM l)
      SELECT pred_len, ref_len, round(CASE WHEN pred_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / pred_len) END * exp((SELECT avg(ln(hit / total)) FROM x)), 6) AS bleu,
        round(CASE WHEN pred_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / pred_len) END, 6) AS brevity_penalty,
        {', '.join(f'round((SELECT hit / total FROM x WHERE n = {n}), 6) AS precision_{n}' for n in range(1, 5))} FROM s"""


ORACLES = {
    "value_links": with_inputs(
        ["questions", "stored_values"],
        f"""WITH {_MATCHED} SELECT question_id, table_name, column_name AS "column", value, CAST(rank AS INT) AS rank, size, round(score, 6) AS score
            FROM links WHERE rank <= 2""",
    ),
    "indel_links": with_inputs(
        ["questions", "stored_values"],
        f"""WITH {_INDEL} SELECT question_id, table_name, column_name AS "column", value, CAST(rank AS INT) AS rank, round(score, 6) AS score
            FROM links WHERE rank <= 2""",
    ),
    "nested_value_links": with_inputs(
        ["questions", "stored_values"],
        f"""WITH {_MATCHED} SELECT question_id, CAST(count(DISTINCT table_name) AS INT) AS tables,
              coalesce(string_agg(CASE WHEN column_name = 'p_label' THEN value END, '|' ORDER BY rank), '') AS labels
            FROM links WHERE rank <= 2 GROUP BY question_id""",
    ),
    "link_scores": f"""WITH {_LISTS} SELECT kind, count(*) FILTER (counted) AS records,
        round(count(*) FILTER (counted AND found = len(t)) / count(*) FILTER (counted), 6) AS inclusion,
        round(sum(CASE WHEN counted THEN found ELSE 0 END) / sum(len(pred)), 6) AS precision,
        round(count(*) FILTER (counted AND cols) / count(*) FILTER (counted), 6) AS column_recall,
        round(sum(CASE WHEN counted AND len(t) > 0 THEN found / len(t) ELSE 0.0 END) / count(*) FILTER (counted), 6) AS recall FROM g GROUP BY kind""",
    "link_mismatches": f"WITH {_LISTS} SELECT idx, round(found / len(t), 6) AS recall FROM g WHERE kind = 'textual' AND counted AND found < len(t)",
    "partial_match": with_inputs(
        ["sql_pairs"],
        """SELECT pair_id, CAST(CASE template WHEN 6 THEN 0.0 WHEN 0 THEN 0.6 ELSE 1.0 END AS DOUBLE) AS structural_match,
             CAST(CASE template WHEN 6 THEN 0.0 WHEN 2 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS operators_match, CAST(CASE template WHEN 6 THEN 0.0 WHEN 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS variables_match,
             CAST(CASE template WHEN 6 THEN 0.0 WHEN 0 THEN 0.8 WHEN 2 THEN round(2.75 / 3, 6) ELSE 1.0 END AS DOUBLE) AS partial_match FROM sql_pairs""",
    ),
    "variable_errors": with_inputs(
        ["sql_pairs"], "SELECT 0 AS depth, 'columns' AS kind, 'FN' AS error, count(*) AS n FROM sql_pairs WHERE template = 0"
    ),
    "corpus_bleu": _bleu(),
    "list_overlap": """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey, max(l_quantity > 20) OVER w AS a, max(l_tax > 0.03) OVER w AS b FROM lineitem
          WINDOW w AS (PARTITION BY l_orderkey, l_partkey))
        SELECT l_orderkey, round(CASE WHEN count(*) FILTER (a OR b) = 0 THEN 1.0 ELSE count(*) FILTER (a AND b) / count(*) FILTER (a OR b) END, 6) AS jaccard
        FROM s GROUP BY l_orderkey""",
}
