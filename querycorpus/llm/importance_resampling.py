"""Resampling towards a target distribution by importance weights over hashed word runs.

Weights come from an array of gains, one per bucket. The draw keeps the documents of highest perturbed weight (Gumbel noise
from a hash makes it a draw without replacement). Its cutoff is found by weighted medians of medians: each partition gives the
median of its remaining keys, weighted by their number; the weighted median of these splits off a guaranteed fraction, until the
key at the wanted rank is exact. Only the winners are sorted.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import global_position
from querycorpus.llm.common import documents, written

BUCKETS = 10_000
#: Word signs are digits, letters and all beyond ASCII; A-Z are lower-cased; every other byte parts words.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST = -(2**63)


def features(text: str | None, n: int) -> tuple[list[bytes], int]:
    """All runs of 1 to n words, and the number of words."""
    words = (text or "").encode().translate(_SIGNS).split()
    runs = words if n == 1 else [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return runs, len(words)


def buckets_of(found: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % np.uint32(buckets)


def _counted(n: int, buckets: int):
    """Feature counts of a partition per bucket: one array however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(buckets_of(features(text.as_py(), n)[0], buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket. At most ``buckets`` sums reach the driver."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(n, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed ratio of target to source, per bucket."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weighed(gains: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, weights = [], [], []
            for text in batch["text"]:
                found, count = features(text.as_py(), n)
                sizes.append(len(found))
                words.append(count)
                weights.append(int(gains[buckets_of(found, len(gains))].sum()))
            arrays = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_features", "n_words", "weight"])

    return run


def noise(seed: int) -> Column:
    """floor(-1000 * ln(-ln u)) with u from a hash of doc_id; a null doc_id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


# --- selection ----------------------------------------------------------------------------

#: A key is (score, -doc_id, -row): larger is better, all keys differ.
KEY = ["k1", "k2", "k3"]


def _above(bound: tuple[int, int, int], equal: bool) -> Column:
    """Keys above a bound, or also the bound itself."""
    a, b, c = (F.col(k) for k in KEY)
    last = c >= bound[2] if equal else c > bound[2]
    return (a > bound[0]) | ((a == bound[0]) & ((b > bound[1]) | ((b == bound[1]) & last)))


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower median of the keys of a partition and their number."""
    held = list(batches)
    keys = [np.concatenate([np.zeros(0, np.int64), *(batch[k].to_numpy() for batch in held)]) for k in KEY]
    n = len(keys[0])
    if n:
        middle = (n - 1) // 2
        # Only rows with the median's first number need an order among themselves.
        first = np.partition(keys[0], middle)[middle]
        below, same = int((keys[0] < first).sum()), np.flatnonzero(keys[0] == first)
        at = same[np.lexsort((keys[2][same], keys[1][same]))[middle - below]]
        arrays = [pa.array([int(k[at])], pa.int64()) for k in keys] + [pa.array([n], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, [*KEY, "n", "part"])


def cutoff_key(keys: DataFrame, wanted: int, total: int, finish: int = 1000) -> tuple[int, int, int] | None:
    """The key of rank ``wanted`` from the top among ``total`` distinct keys; None if nothing is wanted.

    A round needs the medians (one row per partition on the driver: three numbers and a count) and one count. At least half of the
    partitions, by weight, lie on either side of the pivot with half of their keys, so each round discards a quarter of the
    remaining keys at least. The last ``finish`` keys are ordered as they are.
    """
    low, high, left, rank = None, None, total, wanted
    if wanted <= 0:
        return None
    while True:
        rest = keys
        if low is not None:
            rest = rest.where(_above(low, False))
        if high is not None:
            rest = rest.where(~_above(high, True))
        if left <= finish:
            return tuple(rest.orderBy(*[F.desc(k) for k in KEY]).select(*KEY).limit(rank).agg(F.min(F.struct(*KEY)).alias("k")).first()["k"])
        medians = sorted(((r["k1"], r["k2"], r["k3"]), r["n"]) for r in rest.select(*KEY).mapInArrow(_medians, "k1 long, k2 long, k3 long, n long, part int").collect())
        passed, pivot = 0, medians[-1][0]
        for key, n in medians:
            passed += n
            if 2 * passed >= left:
                pivot = key
                break
        better = rest.where(_above(pivot, False)).count()
        if better == rank - 1:
            return pivot
        if better >= rank:
            low, left = pivot, better
        else:
            high, left, rank = pivot, left - better - 1, rank - better - 1


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20, finish: int = 1000) -> DataFrame:
    """Weigh documents by how much likelier the target makes their words, and draw ``percent`` of them.

    Returns per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, 3... of the drawn, else null).

    * Features are runs of 1 to n words; all rows of both tables are counted. A null or empty text has none and weight 0.
    * Of the N rows with at least ``least_words`` words floor(percent * N / 100) are drawn: highest scores first, ties to the smaller
      doc_id, then (repeated or null doc_id, null last) by the place of the row in the scored table.
    * Other columns are not read. Without rows in ``docs`` there are none; an empty target gives every bucket its smoothed gain.

    The gains are ``buckets`` numbers, a fixed size. Scores are written once; selection reads three numbers per eligible row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = gains_of(bucket_counts(texts, n, buckets), bucket_counts(target, n, buckets))
    scored = texts.mapInArrow(_weighed(gains, n), "doc_id long, n_features long, n_words long, weight long")
    scored = written(scored.withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = F.col("n_words") >= least_words
    # Not -doc_id: the smallest long has no negative. Null comes last.
    keys = scored.where(eligible).select(F.col("score").alias("k1"), F.coalesce(F.bitwise_not("doc_id"), F.lit(LEAST)).alias("k2"), F.bitwise_not("row").alias("k3"))
    total = keys.count()
    cutoff = cutoff_key(keys, percent * total // 100, total, finish)
    columns = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    marked = scored.select("*", F.col("score").alias("k1"), F.coalesce(F.bitwise_not("doc_id"), F.lit(LEAST)).alias("k2"), F.bitwise_not("row").alias("k3"))
    won = eligible & _above(cutoff, True)
    ranked = global_position(marked.where(won).select(*columns, *KEY), [], [F.desc(k) for k in KEY], "_position")
    drawn = ranked.select(*columns, (F.col("_position") + 1).alias("rank"))
    return drawn.unionByName(marked.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
# The SQL side computes crc32 of each distinct word byte by byte from the table that its polynomial gives.
ORACLES = {
    "op13_importance_resampling": r"""
        WITH crc AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))),
        words AS (
            SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        bytes AS (
            SELECT w, list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substring(hex(encode(w)), 2 * k + 1, 2))::BIGINT) AS b
            FROM (SELECT DISTINCT w FROM words)),
        named AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM bytes, crc),
        counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN named USING (w) GROUP BY bucket),
        sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, sums),
        weights AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS w FROM words JOIN named USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
        scores AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
                   coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weights ON id = doc_id),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN r <= 10 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
        FROM scores LEFT JOIN ranked USING (doc_id)
    """
}
