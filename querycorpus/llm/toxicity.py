"""Toxicity by the nearest labelled examples under TF-IDF cosine, found exactly through a block-max inverted index."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import Memo, documents, labelled, labels, per_worker, remainder

MARKS = string.punctuation + "“”„«»‘’…–—¡¿"
STEMS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """The bare word and its beginnings, marked by a star."""
    bare = word.strip(MARKS)
    return [bare, *(bare[:n] + "*" for n in STEMS if len(bare) > n)] if len(bare) > 2 else []


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            counts[y].update({t for word in set(text.lower().split()) for t in terms_of(word)})
        names = list(counts[0] | counts[1])
        columns = [pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])


def telling_terms(sample: DataFrame, least: int, max_terms: int, significance: float) -> list[str]:
    """Terms that occur more often in toxic examples than chance allows, by the likelihood ratio; at most ``max_terms``."""
    totals = sample.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    n1, n0 = (float(v or 0) for v in totals.first())
    if not n1 or not n0:
        return []
    counts = sample.select("text", "y").mapInArrow(_class_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, share = F.col("a"), F.col("b"), n1 / (n1 + n0)
    ratio = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    chosen = counts.where((a >= least) & (a / n1 > b / n0)).withColumn("ratio", ratio).where(F.col("ratio") >= significance)
    return [r["term"] for r in chosen.orderBy(F.desc("ratio"), "term").limit(max_terms).collect()]


class Vectors:
    """Sparse TF-IDF vectors of length 1. All words without a chosen term together are one more term, the last; its weight for each
    word is ``rest``. So two vectors are near when their texts have the same terms at about the same density, however long they are."""

    def __init__(self, terms: list[str], idf: np.ndarray | None = None, rest: float = 1.0) -> None:
        self.idf, self.rest = idf, rest
        number = {t: i for i, t in enumerate(terms)}

        def found(word: str) -> bytes:
            return np.array([number[t] for t in terms_of(word) if t in number], "<u4").tobytes()

        # The counting and the scoring of the same terms share one memo of words.
        self.words = per_worker(f"terms {hash((*terms,))}", lambda: Memo(found, 250_000))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(terms, their counts, number of words)"""
        words = (text or "").lower().split()
        found = b"".join(map(self.words.__getitem__, words))
        return *(np.unique(np.frombuffer(found, "<u4"), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))), len(words)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        terms, counts, words = self.counts(text)
        if not words:
            return terms, counts.astype(np.float64)
        terms, weights = np.append(terms, len(self.idf)), np.append(counts * self.idf[terms], self.rest * words)
        return terms, weights / np.sqrt((weights**2).sum())


def _document_frequencies(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total, rows = Vectors(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch["text"].to_pylist():
                total[vectors.counts(text)[0]] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int64()), pa.array([rows, *total[used].tolist()], pa.int64())], ["term", "n"])

    return run


class BlockMaxIndex:
    """Postings of labelled examples in blocks, ordered by their heaviest telling terms and the weight of the rest; each term knows the greatest weight it
    has in a block. A block is opened only if the sum of these bounds can reach the k-th best similarity found so far."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], width: int, block: int = 32) -> None:
        lead = [int(t[w[:-1].argmax()]) if len(t) > 1 else width for t, w in examples]
        rest = [float(w[-1]) if len(w) else 0.0 for _, w in examples]
        self.order = np.lexsort((np.arange(len(examples)), rest, lead))
        self.size = len(examples)
        sizes = [len(t) for t, _ in examples]
        owner = np.repeat(self.places(), sizes)
        term = np.concatenate([t for t, _ in examples]).astype(np.int64) if examples else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in examples]) if examples else np.zeros(0)
        by = np.lexsort((owner, term))
        self.owner, self.weight = owner[by], weight[by]
        run = term[by] * (len(examples) // block + 1) + self.owner // block
        self.run_start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        self.run_end = np.r_[self.run_start[1:], len(run)].astype(np.int64)
        self.run_block = self.owner[self.run_start] // block
        self.run_max = np.maximum.reduceat(self.weight, self.run_start) if len(run) else np.zeros(0)
        self.term_start = np.searchsorted(term[by][self.run_start], np.arange(width + 1))
        self.blocks = len(examples) // block + 1
        self.opened = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k most similar examples with a similarity over 0; ties go to the earlier example of the index."""
        starts, ends = self.term_start[terms], self.term_start[terms + 1]
        widths = ends - starts
        if not widths.sum():
            return np.zeros(0, np.int64), np.zeros(0)
        runs = np.repeat(starts - np.r_[0, np.cumsum(widths)[:-1]], widths) + np.arange(widths.sum())
        query = np.repeat(weights, widths)
        bounds = np.bincount(self.run_block[runs], self.run_max[runs] * query, self.blocks)
        waiting = np.argsort(-bounds, kind="stable")
        waiting = waiting[: np.count_nonzero(bounds)]
        scores, top, floor, step = np.zeros(self.size), np.zeros(0), 0.0, 4
        blocks, open_now = self.run_block[runs], np.zeros(self.blocks, bool)
        while len(waiting) and bounds[waiting[0]] >= floor - 1e-12:
            some, waiting = waiting[:step], waiting[step:]
            some = some[bounds[some] >= floor - 1e-12]
            step *= 2
            self.opened += len(some)
            open_now[some] = True
            chosen = open_now[blocks]
            open_now[some] = False
            first = self.run_start[runs[chosen]]
            lengths = self.run_end[runs[chosen]] - first
            at = np.repeat(first - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            owners = self.owner[at]
            np.add.at(scores, owners, self.weight[at] * np.repeat(query[chosen], lengths))
            if leave_out >= 0:
                scores[leave_out] = 0
            # The scores of an opened block are final.
            top = np.append(top, scores[np.unique(owners)])
            if len(top) > k:
                top = np.partition(top, -k)[-k:]
            if len(top) == k:
                floor = top.min()
        found = np.flatnonzero(scores)
        best = found[np.lexsort((found, -scores[found]))[:k]]
        return self.order[best], scores[best]

    def places(self) -> np.ndarray:
        """Each example's place in the index."""
        spots = np.empty(self.size, np.int64)
        spots[self.order] = np.arange(self.size)
        return spots


@dataclass
class ToxicityModel:
    """Terms and their weights, the indexed examples, and the fitted line from vote to score."""

    terms: list[str]
    idf: np.ndarray
    rest: float
    examples: list[tuple[np.ndarray, np.ndarray]]
    ids: list[int]
    toxic: np.ndarray
    base: float
    k: int
    line: tuple[float, float]

    def start(self) -> None:
        if "index" not in self.__dict__:
            self.__dict__["index"] = BlockMaxIndex(self.examples, len(self.terms) + 1)
            self.__dict__["vectors"] = Vectors(self.terms, self.idf, self.rest)
            self.__dict__["plain"] = None

    def vote(self, near: np.ndarray, similarity: np.ndarray, prior: float = 5.0) -> float:
        """Share of toxic neighbours, each weighted by its inverse distance, with a little of the base rate."""
        weights = 1 / (1.02 - similarity)
        return float(((weights * self.toxic[near]).sum() + prior * self.base) / (weights.sum() + prior))

    def evidence(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        self.start()
        terms, weights = self.vectors(text)
        if len(terms) == 1 and self.plain is not None:  # texts without any telling term all have the same vector
            return self.plain
        near, similarity = self.index.nearest(terms, weights, self.k)
        found = self.calibrated(self.vote(near, similarity)), near, similarity
        if len(terms) == 1:
            self.plain = found
        return found

    def calibrated(self, vote: float) -> float:
        z = np.log(vote / (1 - vote)) if 0 < vote < 1 else (30.0 if vote >= 1 else -30.0)
        return float(1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * z, -30, 30))))


def _fit_line(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic line through (vote in log odds, label), with a little ridge towards the vote itself.

    Labels are smoothed to (n + 1) / (n + 2) of their class and steps are halved until they gain, so the line stays finite where
    votes separate the classes or are all alike; then the score is about the base rate.
    """
    toxic = y.sum()
    target = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (len(y) - toxic + 2))
    x, start = np.stack([np.ones_like(z), z], 1), np.array([0.0, 1.0])

    def loss(w: np.ndarray) -> float:
        line = x @ w
        return float((np.logaddexp(0, line) - target * line).sum() + 0.05 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (target - p) - 0.1 * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
        while (better := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if not better < now - 1e-9:
            break
        w, now = w + step, better
    return float(w[0]), max(float(w[1]), 0.0)


def learn_toxicity(docs: DataFrame, marks: DataFrame, max_rows: int = 12_000, k: int = 15, least: int = 5, max_terms: int = 4096, significance: float = 24.0) -> ToxicityModel | None:
    """A model from at most ``max_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0, with document frequencies over all of ``docs``.
    Equal texts count once as examples."""
    sample = labelled(docs, marks, "toxic", 5, 0, True, max_rows).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    terms = telling_terms(sample, least, max_terms, significance)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_document_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in found}
    df = np.array([counts.get(i, 0) for i in range(len(terms))], np.float64)
    idf = np.log((counts.get(-1, 0) + 1) / (df + 1)) + 1

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors(terms)
        for batch in batches:
            rows = [make.counts(t) for t in batch["text"].to_pylist()]
            columns = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], *columns, pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "y", "terms", "counts", "words"])

    schema = "doc_id long, y int, terms array<long>, counts array<long>, words long"
    rows = sample.select("doc_id", "text", "y").mapInArrow(term_counts, schema).orderBy("doc_id", "y").limit(max_rows).collect()
    if not rows:
        return None
    # A typical toxic example has as much weight in its telling terms as in all its words.
    sums = [(idf[np.array(r["terms"], np.int64)] * r["counts"], r["words"]) for r in rows if r["y"] and r["terms"]]
    rest = float(np.median([np.sqrt((w**2).sum()) / n for w, n in sums])) if sums else 1.0
    examples = []
    for r in rows:
        weights = np.append(idf[np.array(r["terms"], np.int64)] * r["counts"], rest * r["words"])
        examples.append((np.append(r["terms"], len(terms)).astype(np.int64), weights / np.sqrt((weights**2).sum())) if r["words"] else (np.zeros(0, np.int64), np.zeros(0)))
    base = (sum(r["y"] for r in rows) + 0.5) / (len(rows) + 1)
    model = ToxicityModel(terms, idf, rest, examples, [r["doc_id"] for r in rows], np.array([r["y"] for r in rows], np.float64), base, k, (0.0, 1.0))
    model.start()
    # Each example is judged by the others. Examples without telling terms are all alike: one of each class is judged.
    places, votes, plain = model.index.places(), [], {}
    for i, (t, w) in enumerate(examples):
        known = plain.get(model.toxic[i]) if len(t) < 2 else None
        votes.append(known if known is not None else model.vote(*model.index.nearest(t, w, k, int(places[i]))))
        if len(t) == 1:
            plain[model.toxic[i]] = votes[-1]
    z = np.clip(np.array(votes), 1e-6, 1 - 1e-6)
    model.line = _fit_line(np.log(z / (1 - z)), model.toxic)
    for name in ("index", "vectors", "plain"):
        model.__dict__.pop(name)
    return model


def scorer(model: ToxicityModel | None):
    """A column function: text to score. Without a model nothing is known against a text: 0."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([model.evidence(text)[0] if model else 0.0 for text in some], dtype="float64")

    return score


def explainer(model: ToxicityModel | None):
    """A column function: text to (score, neighbours), the evidence."""

    @F.pandas_udf("score double, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>")
    def explained(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            scores, evidence = [], []
            for text in some:
                value, near, similarity = model.evidence(text) if model else (0.0, (), ())
                scores.append(value)
                evidence.append([{"doc_id": model.ids[i], "similarity": float(s), "toxic": int(model.toxic[i])} for i, s in zip(near, similarity, strict=True)])
            yield pd.DataFrame({"score": scores, "neighbours": pd.Series(evidence, dtype=object)})

    return explained


def score_toxicity(docs: DataFrame, marks: DataFrame, threshold: float = 0.5, evidence: bool = True, **settings) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted and, with ``evidence``, neighbours.

    A text's terms are its words and their beginnings, limited to those that tell toxic examples from others; it is compared with all
    indexed examples. Null or empty text, or one without such terms: no neighbours, the calibrated base rate. A null doc_id counts as held out.
    Rows with one doc_id are scored each by its own text. Without labels: 0; with one class: its smoothed share. Other columns are not read.
    """
    model = learn_toxicity(docs, marks, **settings)
    text = F.col("text").cast("string")
    found = explainer(model)(text) if evidence else F.struct(scorer(model)(text).alias("score"))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
    held_out = F.coalesce(remainder(5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["neighbours"] if evidence else []))


def drop_toxic(docs: DataFrame, marks: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    return docs.where(scorer(learn_toxicity(docs, marks, **settings))(F.col("text").cast("string")) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir), evidence=False)


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
