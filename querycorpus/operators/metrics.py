"""Score predicted SQL against target SQL by parts, and texts against references.

Pairs are ``pair_id, prediction, target``. Both texts become one query log, its parts become
elements ``(pair_id, side, depth, sibling, element)``, and every score is a join of the two element
sets followed by small averages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querycorpus.functions.scale import by_shuffle, cut_lineage
from querycorpus.operators import sqltext as X
from querycorpus.operators.sqltokens import tokenized

SPOT = ["pair_id", "depth", "sibling"]


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def paired_log(pairs: DataFrame) -> DataFrame:
    """Both texts of every pair as a log of tokens, computed once; ``query_id`` keeps them apart."""
    sides = F.array(
        F.struct(F.lit("pred").alias("side"), F.col("prediction").alias("sql")),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("sql")),
    )
    log = pairs.select("pair_id", F.explode(sides).alias("s")).select(
        "pair_id", "s.side", F.concat_ws(":", "pair_id", "s.side").alias("query_id"), F.lit("").alias("db_id"), "s.sql"
    )
    return cut_lineage(tokenized(log))


def scopes_of(log: DataFrame) -> DataFrame:
    """Scopes of every query with their depth and place among the scopes of that depth."""
    rows = tokenized(log).where("tokens IS NOT NULL").select("pair_id", "side", "scopes", F.explode("scopes").alias("s"))
    before = F.filter("scopes", lambda x: (x["depth"] == F.col("s.depth")) & (F.array_position("scopes", x) < F.array_position("scopes", F.col("s"))))
    return rows.select("pair_id", "side", F.col("s.path").alias("scope"), "s.depth", F.size(before).alias("sibling"))


def _numbered(elements: DataFrame) -> DataFrame:
    """Tell equal elements of one scope apart by a running number; a scope is one query's text long."""
    w = Window.partitionBy("pair_id", "side", "depth", "sibling", "element").orderBy("element")
    n = F.row_number().over(w) - 1
    return elements.withColumn("element", F.concat_ws("/", "element", n.cast("string")))


def structural_elements(log: DataFrame) -> DataFrame:
    """Clause names with sort directions, nestings and set operators of every scope."""
    rows = X.structure(log)
    names = F.concat("clauses", "nestings", "set_operators")
    return _numbered(rows.select("pair_id", "side", "depth", "sibling", F.explode(names).alias("element")))


def operator_elements(log: DataFrame, scopes: DataFrame) -> DataFrame:
    """``operator_clause`` per occurrence, join conditions counted with WHERE."""
    base = tokenized(log).where("tokens IS NOT NULL")
    rows = base.select("pair_id", "side", F.explode(X.operator_entries(F.col("tokens"), move_on=True)).alias("o"))
    rows = rows.select("pair_id", "side", F.col("o.path").alias("scope"), F.concat_ws("_", "o.member", "o.clause").alias("element"))
    placed = rows.join(by_shuffle(scopes), ["pair_id", "side", "scope"])
    return _numbered(placed.select("pair_id", "side", "depth", "sibling", "element"))


def variable_elements(log: DataFrame, scopes: DataFrame) -> DataFrame:
    """Columns, tables and values; columns set equal in either query, directly or through others, share one name."""
    rows = X.variables(log).where("kind <> 'aliases'").drop("depth")
    name = F.when(F.col("kind") == "columns", F.lower(F.concat_ws(".", "table_name", "name"))).otherwise(F.col("name"))
    named = rows.select("pair_id", "side", "scope", "kind", name.alias("name"))
    pairs = X.column_equivalences(log).groupBy("pair_id").agg(
        F.collect_set(F.struct(F.lower("column").alias("a"), F.lower("equals").alias("b"))).alias("pairs")
    )

    def joined(classes: Column, p: Column) -> Column:
        """Merge the classes that hold an end of the pair, so that a = b and b = c make one class of three."""
        meets = lambda c: F.array_contains(c, p["a"]) | F.array_contains(c, p["b"])
        one = F.array_distinct(F.flatten(F.concat(F.array(F.array(p["a"], p["b"])), F.filter(classes, meets))))
        return F.concat(F.filter(classes, lambda c: ~meets(c)), F.array(one))

    merged_classes = F.aggregate("pairs", F.array().cast("array<array<string>>"), joined)
    classes = pairs.select("pair_id", F.explode(merged_classes).alias("_class")).select(
        "pair_id", F.array_min("_class").alias("_least"), F.explode("_class").alias("name"), F.lit("columns").alias("kind")
    )
    merged = named.join(by_shuffle(classes), ["pair_id", "kind", "name"], "left")
    merged = merged.withColumn("name", F.least("name", F.coalesce("_least", "name")))
    placed = merged.join(by_shuffle(scopes), ["pair_id", "side", "scope"])
    return _numbered(placed.select("pair_id", "side", "depth", "sibling", F.concat_ws("/", "kind", "name").alias("element")))


def _sides(elements: DataFrame) -> DataFrame:
    """One row per element and spot with a flag per side."""
    return elements.groupBy(*SPOT, "element").agg(
        F.max((F.col("side") == "pred").cast("int")).alias("in_pred"), F.max((F.col("side") == "target").cast("int")).alias("in_target")
    )


def component_scores(elements: DataFrame, spots: DataFrame, name: str) -> DataFrame:
    """Jaccard per spot, mean over the siblings of a depth, mean over depths."""
    counts = _sides(elements).groupBy(*SPOT).agg(
        F.count(F.when((F.col("in_pred") == 1) & (F.col("in_target") == 1), True)).alias("_both"), F.count(F.lit(1)).alias("_any")
    )
    scored = spots.join(by_shuffle(counts), SPOT, "left").withColumn(
        "_s", F.when(F.coalesce("_any", F.lit(0)) == 0, 1.0).otherwise(F.col("_both") / F.col("_any"))
    )
    per_depth = scored.groupBy("pair_id", "depth").agg(F.avg("_s").alias("_s"))
    return per_depth.groupBy("pair_id").agg(F.avg("_s").alias(name))


def partial_match(pairs: DataFrame) -> DataFrame:
    """Structural, operator and variable match and their mean; a text that cannot be read scores 0."""
    log = paired_log(pairs)
    scopes = scopes_of(log)
    readable = scopes.groupBy("pair_id").agg(F.count_distinct("side").alias("_n")).where("_n = 2").select("pair_id")
    spots = scopes.select(*SPOT).distinct().join(by_shuffle(readable), "pair_id", "left_semi")
    scores = pairs.select("pair_id")
    parts = {
        "structural_match": structural_elements(log),
        "operators_match": operator_elements(log, scopes),
        "variables_match": variable_elements(log, scopes),
    }
    for name, elements in parts.items():
        scores = scores.join(by_shuffle(component_scores(elements, spots, name)), "pair_id", "left")
    scores = scores.fillna(0.0, list(parts))
    total = sum(F.col(n) for n in parts) / len(parts)
    return scores.withColumn("partial_match", total)


def variable_errors(pairs: DataFrame) -> DataFrame:
    """Missed (FN) and invented (FP) columns, tables and values per depth, over all pairs."""
    log = paired_log(pairs)
    scopes = scopes_of(log)
    rows = _sides(variable_elements(log, scopes)).where("in_pred <> in_target")
    kind = F.substring_index("element", "/", 1)
    error = F.when(F.col("in_pred") == 1, "FP").otherwise("FN")
    return rows.groupBy("depth", kind.alias("kind"), error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def match_means(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    names = ["structural_match", "operators_match", "variables_match", "partial_match"]
    return scores.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("pairs"))


# --- BLEU ------------------------------------------------------------------------------


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _clipped_matches(texts: list[list[str]], max_n: int) -> Iterator[tuple[int, int]]:
    """For n = 1, 2, ..: n-grams of the first text that another one holds too, each at most as often as there; and all n-grams of it.

    The n-grams of all texts are numbered exactly: one of n words is the pair of one of n - 1 words and the word after it.
    """
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = words
    for n in range(1, max_n + 1):
        if len(words) < n:
            yield 0, 0
            continue
        if n > 1:
            grams = np.unique(grams[:-1] * len(number) + words[n - 1 :], return_inverse=True)[1]
        # A gram that runs from one text into the next is none.
        inside = owner[: len(grams)] == owner[n - 1 :]
        kinds = int(grams.max()) + 1
        counts = np.bincount(owner[: len(grams)][inside] * kinds + grams[inside], minlength=len(texts) * kinds).reshape(len(texts), kinds)
        yield int(np.minimum(counts[0], counts[1:].max(axis=0, initial=0)).sum()), int(counts[0].sum())


def _matched(max_n: int):
    """Sums of a partition: (n, hit, all) per n; for n = 0 the lengths of closest references and of predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((max_n + 1, 2), np.int64)
        for batch in batches:
            for prediction, refs in zip(batch["prediction"].to_pylist(), batch["refs"].to_pylist()):
                texts = [_WORD.findall(t) for t in [prediction or "", *(r for r in refs or [] if r is not None)]]
                sums[0] += min(((abs(len(r) - len(texts[0])), len(r)) for r in texts[1:]), default=(0, 0))[1], len(texts[0])
                for n, found in enumerate(_clipped_matches(texts, max_n), 1):
                    sums[n] += found
        yield pa.RecordBatch.from_arrays([pa.array(range(max_n + 1), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["n", "hit", "all"])

    return run


def corpus_bleu(df: DataFrame, max_n: int = 4) -> DataFrame:
    """Corpus BLEU of ``prediction, refs``: one row with the score and its parts.

    Words are split at spaces, there is no smoothing, and the closest reference length counts (the shorter on a tie). A null
    prediction is an empty text, a null reference none. All that is counted lies in one row of ``df``, so nothing is shuffled
    but ``max_n + 1`` sums per partition.
    """
    texts = df.select(F.col("prediction").cast("string").alias("prediction"), F.col("refs").cast("array<string>").alias("refs"))
    sums = texts.mapInArrow(_matched(max_n), "n int, hit long, all long").groupBy("n").agg(F.sum("hit").alias("hit"), F.sum("all").alias("all"))

    def of(n: int, c: Column) -> Column:
        return F.max(F.when(F.col("n") == n, c))

    share = F.col("hit") / F.nullif(F.col("all"), F.lit(0))
    both = sums.agg(
        of(0, F.col("all")).alias("pred_len"),
        of(0, F.col("hit")).alias("ref_len"),
        *[F.coalesce(of(n, share), F.lit(0.0)).alias(f"precision_{n}") for n in range(1, max_n + 1)],
    )
    precisions = [F.col(f"precision_{n}") for n in range(1, max_n + 1)]
    penalty = F.when(F.col("pred_len") > F.col("ref_len"), 1.0).otherwise(
        F.when(F.col("pred_len") > 0, F.exp(1 - F.col("ref_len") / F.col("pred_len"))).otherwise(0.0)
    )
    mean_log = sum(F.log(p) for p in precisions) / max_n
    return both.select(
        F.when(F.array_min(F.array(*precisions)) > 0, penalty * F.exp(mean_log)).otherwise(0.0).alias("bleu"),
        penalty.alias("brevity_penalty"),
        "pred_len",
        "ref_len",
        *precisions,
    )
