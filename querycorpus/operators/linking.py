"""Link question words to stored values, and score such links.

Matching is a similarity join. The text of a question from each of its words on meets distinct values through an inverted index
of positional q-grams (``gramindex``); only for candidates are spans cut, of the lengths that the value allows, and scored. Words match
as they are written, a run of blanks as one, and joined by single blanks. A value whose first letter, after separators, is another one than that of the words
has no score; nothing else within the threshold is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.scale import by_shuffle, cut_lineage, top_k
from querycorpus.functions.text import edit_similarity, indel_similarity
from querycorpus.operators.gramindex import SEPARATOR, gram_index

# English words that are no values, words that need a perfect
# score, and names too common to link.
STOP_WORDS = """
    a about above after again against ain all am an and any are aren aren't as at be because been before being below
    between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few
    for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his
    how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself
    needn needn't nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she
    she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves then there
    these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where
    which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself
    yourselves
""".split()
COMMON_WORDS = ["no", "yes", "many"]
COMMON_NAMES = ["id"]
SEPARATORS = rf"{SEPARATOR}+"
NUMBER = r"^[+-]?(?:\d[\d,]*\.?\d*|\.\d+)(?:e[+-]?\d+)?$"
NUMERIC_LIKE = r"^[0-9\-/.,: ]*$|%$"
THRESHOLD = 0.85
TOP_K = 2

MEASURES = {"levenshtein": edit_similarity, "indel": indel_similarity}


def pick_list(values: DataFrame) -> DataFrame:
    """Distinct text values per column: ``table_name, column, value``."""
    return values.where("value IS NOT NULL").select("table_name", "column", "value").distinct()


def _linkable(c: Column) -> Column:
    return (F.length(c) > 1) & ~c.rlike(NUMBER) & ~c.isin(*STOP_WORDS, *COMMON_NAMES)


def question_tails(questions: DataFrame) -> DataFrame:
    """A question from each of its words on, as written but for runs of blanks, and with its words joined by blanks: ``question_id, text``."""
    words = F.filter(F.split(F.lower("question"), SEPARATORS), lambda w: w != "")
    trimmed = F.regexp_replace(F.regexp_replace(F.lower("question"), rf"^{SEPARATORS}|{SEPARATORS}\z", ""), " +", " ")
    written = F.split(trimmed, rf"(?<={SEPARATOR})(?!{SEPARATOR})")
    listed = questions.select("question_id", F.explode(F.array(F.struct(words.alias("w"), written.alias("p")))).alias("_q")).where(F.size("_q.w") > 0)
    starts = listed.select("question_id", "_q", F.explode(F.sequence(F.lit(1), F.size("_q.w"))).alias("_s"))
    texts = [F.array_join(F.slice(f"_q.{c}", F.col("_s"), F.size("_q.w")), joint) for c, joint in (("w", " "), ("p", ""))]
    return starts.select("question_id", F.explode(F.array(*texts)).alias("text")).distinct()


def similar_pairs(
    spans: DataFrame,
    values: DataFrame,
    theta: float = THRESHOLD,
    measure: str = "indel",
    same_first: bool = True,
    within: list[str] = (),
) -> DataFrame:
    """``span, norm, score`` for distinct spans and normalized values with score >= theta.

    ``within`` are columns both sides must share (a database, say); ``same_first`` asks for the same
    first letter after separators.
    """
    within = list(within)
    index = gram_index(values, theta, measure, same_first, within)
    found = index.candidates(index.wholes(spans.select(*within, F.col("span").alias("text")).distinct()))
    pairs = found.select(*within, F.col("piece").alias("span"), "norm")
    return pairs.withColumn("score", MEASURES[measure](F.col("norm"), F.col("span"))).where(F.col("score") >= theta - 1e-9)


def value_matches(
    questions: DataFrame, values: DataFrame, theta: float = THRESHOLD, measure: str = "indel"
) -> DataFrame:
    """Best match of every value found in a question: ``question_id, table_name, column, value, score, size``.

    ``size`` is the length of the matched words. Numbers, stop words and ``id`` never match; common
    words and all-capital values need a perfect score.
    """
    normal = F.lower(F.trim("value"))
    named = values.withColumn("norm", normal).where(_linkable(F.col("norm")))
    index = gram_index(named.select("norm"), theta, measure)
    tails = cut_lineage(index.tails(question_tails(questions)))
    low, high = index.lengths("norm")
    # Ends of whole words at a length that the value allows; the span runs from the start of the piece.
    ends = F.sequence(low, F.least(high, F.length("piece")))
    at_end = F.filter(ends, lambda n: F.substring(F.concat("piece", F.lit(" ")), n, F.lit(2)).rlike(rf"^(?!{SEPARATOR})[\s\S]{SEPARATOR}"))
    cut = index.candidates(tails).where(low <= F.length("piece")).select("piece", "norm", F.explode(at_end).alias("_n"))
    pairs = cut.select("piece", "norm", F.substring("piece", F.lit(1), F.col("_n")).alias("span")).where(_linkable(F.col("span")))
    pairs = pairs.withColumn("score", MEASURES[measure](F.col("norm"), F.col("span"))).where(F.col("score") >= theta - 1e-9)
    strict = F.col("span").isin(*COMMON_WORDS) | F.col("norm").isin(*COMMON_WORDS)
    pairs = pairs.where(~strict | (F.col("score") >= 1))
    capital = (F.col("value") == F.upper("value")) & (F.col("value") != F.lower("value"))
    best = F.max(F.struct("score", F.length("span").alias("size"))).alias("_b")
    kept = pairs.groupBy("piece", "norm").agg(best)
    found = kept.join(by_shuffle(named), "norm").where(~capital | (F.col("_b.score") >= 1))
    return (
        found.join(by_shuffle(tails.select("question_id", "piece").distinct()), "piece")
        .groupBy("question_id", "table_name", "column", "value")
        .agg(F.max("_b").alias("_b"))
        .select("question_id", "table_name", "column", "value", "_b.score", "_b.size")
    )


def best_links(matches: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best ``k`` values per question and column; ``name`` columns need a perfect score."""
    kept = matches.where(~F.col("column").contains("name") | (F.col("score") >= 1))
    order = [F.desc("score"), F.desc("size"), F.col("value")]
    return top_k(kept, ["question_id", "table_name", "column"], order, k)


def nested_links(links: DataFrame) -> DataFrame:
    """Links as table -> column -> values, at most k values per column."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
    columns = links.groupBy("question_id", "table_name", "column").agg(values.alias("values"))
    tables = columns.groupBy("question_id", "table_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "values")))).alias("columns")
    )
    return tables.groupBy("question_id").agg(
        F.map_from_entries(F.collect_list(F.struct("table_name", "columns"))).alias("value_links")
    )


# --- scores -----------------------------------------------------------------------------


def _columns(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.substring_index(v, ".", 2)))


def without_numeric(values: Column) -> Column:
    """Drop links whose value (all after the second dot) is only digits and signs, or ends in %."""
    return F.filter(
        values, lambda v: ~F.coalesce(F.substring(v, F.length(F.substring_index(v, ".", 2)) + 2, F.length(v)), F.lit("")).rlike(NUMERIC_LIKE)
    )


def record_scores(records: DataFrame, remove_values: bool = False) -> DataFrame:
    """Per record: found truths, recall, inclusion and column inclusion."""
    kept = without_numeric(F.col("gt")) if remove_values else F.col("gt")
    rows = records.withColumn("truth", kept)
    found = F.size(F.filter("truth", lambda v: F.array_contains("pred", v)))
    return rows.select(
        "idx",
        "truth",
        "pred",
        F.size("pred").alias("n_pred"),
        (F.lit(not remove_values) | (F.size("truth") > 0)).alias("counted"),
        found.alias("found"),
        F.when(F.size("truth") > 0, found / F.size("truth")).otherwise(0.0).alias("recall"),
        (found == F.size("truth")).alias("included"),
        (F.size(F.array_except(_columns(F.col("truth")), _columns(F.col("pred")))) == 0).alias("columns_included"),
    )


def link_scores(records: DataFrame, remove_values: bool = False) -> DataFrame:
    """Inclusion, precision, column recall and mean recall over all records, in one pass.

    Predictions of records without a truth left still count against precision.
    """
    rows = record_scores(records, remove_values)
    n = F.count(F.when(F.col("counted"), True))
    total = F.sum("n_pred")
    return rows.agg(
        n.alias("records"),
        (F.count(F.when(F.col("counted") & F.col("included"), True)) / F.when(n > 0, n)).alias("inclusion"),
        (F.sum(F.when(F.col("counted"), F.col("found")).otherwise(0)) / F.when(total > 0, total)).alias("precision"),
        (F.count(F.when(F.col("counted") & F.col("columns_included"), True)) / F.when(n > 0, n)).alias("column_recall"),
        (F.sum(F.when(F.col("counted"), F.col("recall")).otherwise(0.0)) / F.when(n > 0, n)).alias("recall"),
    ).fillna(0.0)


def mismatches(records: DataFrame, remove_values: bool = False) -> DataFrame:
    """Records whose truth is not all found."""
    return record_scores(records, remove_values).where("counted AND recall < 1").select("idx", "truth", "pred", "recall")


def paired_records(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth and predictions joined by record number; unequal numbers of records are an error."""
    if truth.count() != predicted.count():
        raise ValueError("truth and predictions must have the same number of records")
    return truth.join(predicted, "idx")
