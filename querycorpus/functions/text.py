"""Small column expressions over text shared by several operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(c: Column) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_last_s(c: Column) -> Column:
    return F.regexp_replace(c, "s$", "")


def simple_name(c: Column) -> Column:
    """Name form used for key inference: no final s, no underscores, lower case."""
    return F.lower(F.regexp_replace(without_last_s(c), "_", ""))


def md5_bucket(c: Column, buckets: int) -> Column:
    """Repeatable bucket in [0, buckets) from the first 8 hex digits of the md5."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - levenshtein / longer length``; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, a row of its table at a time as the bits of one number."""

    def length(one: str | None, two: str | None) -> int | None:
        if one is None or two is None:
            return None
        places: dict[str, int] = {}
        for i, letter in enumerate(one):
            places[letter] = places.get(letter, 0) | 1 << i
        full = (1 << len(one)) - 1
        row = full
        for letter in two:
            met = row & places.get(letter, 0)
            row = (row + met | row - met) & full
        return len(one) - row.bit_count()

    return pd.Series([length(one, two) for one, two in zip(a, b)], dtype="Int32")


def indel_similarity(a: Column, b: Column) -> Column:
    """``2 * common subsequence / total length``: insertions and deletions only."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_subsequence(a, b) / total)


def fill_marks(template: Column, values: Column) -> Column:
    """Replace every ``{name}`` in the template by the map entry of that name."""
    return F.aggregate(
        F.map_entries(values),
        template,
        lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def mark_names(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{(.*?)\}"), F.lit(1))
