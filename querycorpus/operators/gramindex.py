"""Candidates of a similarity join from an inverted index of positional q-grams.

A value within the threshold of a probe shares a known number of its q-grams with it, near their places. The index therefore holds
only some of the grams of a value, the rarest first: as many as leave out fewer than the shared ones. A probe brings all its
grams; a pair is a candidate if enough of the value's indexed grams are met at a place that the threshold allows. Values are indexed
by classes of length (doubling), each with its own q, and a probe is cut to what a class can use: no key is made per length, piece
or shift, so the work grows with the letters of a text, however long the values are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from querycorpus.functions.scale import by_shuffle

#: Between words.
SEPARATOR = r"""['"()`,.?! ]"""
LARGEST_Q = 3
COUNTERS = 65_536
EPS = 1e-6


@dataclass(frozen=True)
class Threshold:
    """What a similarity of at least ``theta`` allows between a value of L letters and a probe.

    Letters of the value that are missing (or replaced) cost ``lost`` each, letters of the probe that are new cost ``new`` each; together
    at most ``budget`` * L.
    """

    theta: float
    measure: str

    @property
    def budget(self) -> float:
        return (1 - self.theta) * (1 if self.measure == "levenshtein" else 2)

    @property
    def lost(self) -> float:
        return 1.0 if self.measure == "levenshtein" else 2 - self.theta

    @property
    def new(self) -> float:
        return self.theta

    def shared(self, length, q):
        """Grams of the value that surely survive: a lost letter spoils q of them, a new one q - 1. For numbers and columns."""
        spoiled = self.budget * length * self._worst(q) + EPS
        return length - q + 1 - (F.floor(spoiled) if isinstance(length, Column) else int(spoiled))

    def _worst(self, q):
        both = q / self.lost, (q - 1) / self.new
        return F.greatest(*both) if isinstance(q, Column) else max(both)

    def back(self, length: Column) -> Column:
        return F.floor(self.budget / self.lost * length + EPS)

    def ahead(self, length: Column) -> Column:
        return F.floor(self.budget / self.new * length + EPS)

    @property
    def shortest(self) -> float:
        """Length of the shortest probe as part of the value's; the longest is the inverse."""
        return self.theta if self.measure == "levenshtein" else self.theta / (2 - self.theta)


def length_class(text: str) -> Column:
    """1 for up to 2 letters, then k for 2^(k-1) + 1 to 2^k."""
    return F.length(F.bin(F.greatest(F.length(text) - 1, F.lit(0))))


def class_bounds(k: int) -> tuple[int, int]:
    return (1 if k == 1 else (1 << (k - 1)) + 1), 1 << k


def gram_size(limits: Threshold, k: int) -> int:
    """The longest grams of which even the shortest values of a class share two."""
    return next((q for q in range(LARGEST_Q, 1, -1) if limits.shared(class_bounds(k)[0], q) >= 2), 1)


def _grams(text: str, q: Column) -> Column:
    """(gram, place) of all grams of a text, exploded."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: i <= F.length(text) - q + 1)
    return F.explode(F.transform(places, lambda i: F.struct(F.substring(F.col(text), i, q).alias("gram"), i.alias("at"))))


def _first(text: str, same_first: bool) -> Column:
    """The first letter of the first word."""
    return F.regexp_extract(text, rf"(?!{SEPARATOR})[\s\S]", 0) if same_first else F.lit("")


@dataclass(frozen=True)
class GramIndex:
    """Indexed values: within, norm, class, first, gram, at, need (grams to be met). ``sizes``: q by class."""

    rows: DataFrame
    limits: Threshold
    sizes: dict[int, int]
    same_first: bool
    within: tuple[str, ...]

    def q(self) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in self.sizes.items() for x in pair]), F.col("class"))

    def tails(self, texts: DataFrame) -> DataFrame:
        """``text`` cut to whole words for each class it can serve: columns as before and class, piece."""
        rows = texts.withColumn("class", F.explode(F.array(*[F.lit(k) for k in self.sizes])))
        low, high = self._reach()
        cut = F.regexp_replace(F.substring(F.col("text"), F.lit(1), high + 1), rf"{SEPARATOR}++(?:(?!{SEPARATOR})[\s\S])*+\z", "")
        rows = rows.withColumn("piece", F.when(F.length("text") > high, cut).otherwise(F.col("text")))
        return rows.where((F.length("piece") >= low) & (F.length("piece") <= high))

    def _reach(self) -> tuple[Column, Column]:
        """Shortest and longest probe for a class."""
        least = F.when(F.col("class") == 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.col("class") - 1) + 1)
        return (
            F.greatest(F.lit(1), F.ceil(least * self.limits.shortest - EPS)).cast("int"),
            F.floor(F.pow(F.lit(2.0), F.col("class")) / self.limits.shortest + EPS).cast("int"),
        )

    def wholes(self, texts: DataFrame) -> DataFrame:
        """``text`` as it is, for each class that holds values like it."""
        rows = texts.withColumn("class", F.explode(F.array(*[F.lit(k) for k in self.sizes]))).withColumn("piece", F.col("text"))
        low, high = self._reach()
        return rows.where((F.length("piece") >= low) & (F.length("piece") <= high))

    def candidates(self, probes: DataFrame) -> DataFrame:
        """(within, piece, norm) that share enough grams; ``probes`` has within, class and piece."""
        asked = probes.select(*self.within, "class", "piece").distinct()
        spelled = asked.select(*self.within, "class", "piece", _first("piece", self.same_first).alias("first"), _grams("piece", self.q()).alias("g"))
        spelled = spelled.select(*self.within, "class", "piece", "first", F.col("g.gram").alias("gram"), F.col("g.at").alias("_at"))
        length = F.length("norm")
        near = (F.col("_at") - F.col("at")).between(-self.limits.back(length), self.limits.ahead(length))
        met = spelled.join(by_shuffle(self.rows), [*self.within, "class", "first", "gram"]).where(near)
        hits = met.groupBy(*self.within, "piece", "norm").agg(F.size(F.collect_set("at")).alias("_hits"), F.first("need").alias("need"))
        return hits.where(F.col("_hits") >= F.col("need")).select(*self.within, "piece", "norm")

    def lengths(self, norm: str) -> tuple[Column, Column]:
        """Shortest and longest probe for a value."""
        length = F.length(norm)
        return F.ceil(length * self.limits.shortest - EPS), F.floor(length / self.limits.shortest + EPS)


def gram_index(values: DataFrame, theta: float, measure: str, same_first: bool = True, within: list[str] = ()) -> GramIndex:
    """Index the distinct ``norm`` (and ``within`` columns) of ``values``; null and empty ones are left out.

    How rare a gram is comes from 65,536 hashed counters, the only broadcast side (of fixed size): any choice of grams is complete, rare
    ones are only quicker.
    """
    if not 0 < theta <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    limits = Threshold(theta, measure)
    listed = values.select(*within, "norm").where(F.length("norm") > 0).distinct().withColumn("class", length_class("norm"))
    # At most one row per power of two.
    sizes = {k: gram_size(limits, k) for k in sorted(r["class"] for r in listed.select("class").distinct().collect())}
    index = GramIndex(listed, limits, sizes or {1: 1}, same_first, tuple(within))
    q = index.q()
    grams = listed.select("*", q.alias("_q"), _grams("norm", q).alias("g")).select(*within, "norm", "class", "_q", "g.gram", "g.at")
    grams = grams.withColumn("_counter", F.pmod(F.xxhash64("gram"), F.lit(COUNTERS)).cast("int"))
    seen = F.broadcast(grams.groupBy("_counter").agg(F.count(F.lit(1)).alias("_seen")))
    shared = limits.shared(F.length("norm"), F.col("_q"))
    need = F.ceil(shared / 2).cast("int")
    order = Window.partitionBy(*within, "norm").orderBy("_seen", "gram", "at")
    chosen = grams.join(seen, "_counter").withColumn("_place", F.row_number().over(order))
    chosen = chosen.where(F.col("_place") <= F.length("norm") - F.col("_q") + 1 - shared + need)
    rows = chosen.select(*within, "norm", "class", _first("norm", same_first).alias("first"), "gram", "at", need.alias("need"))
    return GramIndex(rows, limits, index.sizes, same_first, tuple(within))
