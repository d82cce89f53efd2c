"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import documents, labelled, labels, remainder

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "upper", "digits", "symbols", "stops", "commas", "exclamations",
    "distinct_words", "repeated_words", "distinct_lines", "short_words", "beyond_ascii", "blanks", "compressed",
]
_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123), *range(128, 256)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[*b" \t\n\x0b\x0c\r"]] = 4
_KIND[[*b"#$%&*+/<=>@\\^_`{|}~"]] = 5


def features(text: str | None) -> np.ndarray:
    """Figures of the whole text; an empty text has zeros."""
    data = (text or "").encode()
    out = np.zeros(len(FEATURES))
    if not data:
        return out
    n, words, lines = len(data), data.split(), data.split(b"\n")
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kind = np.bincount(_KIND, byte, 6)
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out[:] = [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), kind[1] / max(1, kind[1] + kind[2]), kind[3] / n, kind[5] / n,
        (byte[46] + byte[33] + byte[63]) / w, byte[44] / w, byte[33] / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines),
        (sizes <= 1).sum() / w, byte[128:].sum() / n, kind[4] / n, len(zlib.compress(data, 1)) / n,
    ]
    return out


@dataclass
class AdditiveModel:
    """``intercept`` + a table entry for each feature's bin + an entry for each chosen pair of coarse bins, through a logistic."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _value(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values per bin of a tree that cuts the ordered bins where the gain is greatest."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gains = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
        at = int(gains.argmax()) + 1
        if gains[at - 1] > 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])
    return np.full(len(g), _value(g.sum(), h.sum(), ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one on each axis of a table of bins."""
    best, values = -1.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, values
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
    c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
    d_g, d_h = cg[-1, -1] - a_g - b_g - c_g, ch[-1, -1] - a_h - b_h - c_h
    gains = sum(x**2 / (y + ridge) for x, y in ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h))) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    for part, x, y in ((np.s_[: i + 1, : j + 1], a_g, a_h), (np.s_[: i + 1, j + 1 :], b_g, b_h), (np.s_[i + 1 :, : j + 1], c_g, c_h), (np.s_[i + 1 :, j + 1 :], d_g, d_h)):
        values[part] = _value(x[i, j], y[i, j], ridge)
    return float(gains[i, j]), values


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a small step of a shallow tree on the present residuals, so that
    none takes the part of another; then the same for the pairs with the greatest gain on what is left."""
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(x.shape[1])]
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(base / (1 - base))), quantiles(bins), [], quantiles(coarse_bins), [], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(set(y.tolist())) < 2:
        return model
    place = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, at in enumerate(place):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * np.clip(_tree(np.bincount(at, g, size), np.bincount(at, h, size), 2, ridge), -4, 4)
            model.tables[f] += step
            logit += step[at]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.coarse)]

    def table(f: int, g_index: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g_index]) + 1)
        return np.bincount(rough[f] * shape[1] + rough[g_index], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(table(a, b, g), table(a, b, h), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * np.clip(_quadrants(table(a, b, g), table(a, b, h), ridge)[1], -4, 4)
            model.pair_tables[k] += step
            logit += step[rough[a], rough[b]]
    return model


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([features(t) for t in batch["text"].to_pylist()]) if batch.num_rows else np.zeros((0, len(FEATURES)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], lists], ["doc_id", "y", "features"])


def learn_quality(docs: DataFrame, marks: DataFrame, max_rows: int = 20_000) -> AdditiveModel | None:
    """A model of ``marks.quality`` from at most ``max_rows`` labelled documents whose crc32(doc_id) mod 4 is not 2; None without any."""
    sample = labelled(docs, marks, "quality", 4, 2, True, max_rows).mapInArrow(_with_features, "doc_id long, y int, features array<double>")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_rows).collect()
    return fit_additive(np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows], np.float64)) if rows else None


def scorer(model: AdditiveModel | None):
    """A column function: text to score. Without a model nothing is known against a text: 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            known = model is not None and len(some)
            yield pd.Series(model.scores(np.stack([features(t) for t in some])) if known else np.ones(len(some)))

    return score


def score_quality(docs: DataFrame, marks: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """Score every whole text by the model: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only the text enters a score. Null text: empty, scored like any other. A null doc_id counts as held out.
    Rows with one doc_id are scored each by its own text. Without labels: score 1. With labels of one class: its smoothed share.
    Other columns are not read; no rows give none.
    """
    score = scorer(learn_quality(docs, marks, max_rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, marks: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    return docs.where(scorer(learn_quality(docs, marks, max_rows))(F.col("text").cast("string")) >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
