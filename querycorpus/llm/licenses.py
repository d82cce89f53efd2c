"""Licence notices by the Dice coefficient of word bigrams with templates. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.arrays import pinned
from querycorpus.llm.common import documents

# Short notices and opening sentences of public licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words_of(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ", -1)


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def nested_in(name: str, templates: dict[str, str], percent: int) -> list[tuple[str, int]]:
    """(longer template, word offset) of each longer template that holds this one as a passage."""
    own, found = set(template_bigrams(templates[name])), []
    n = len(template_words(templates[name]))
    for other, text in templates.items():
        words = template_words(text)
        for at in range(len(words) - n + 1 if len(words) > n else 0):
            part = set(template_bigrams(" ".join(words[at : at + n])))
            if 200 * len(own & part) >= percent * (len(own) + len(part)):
                found.append((other, at))
                break
    return found


def _bigrams(words: Column, start: Column, stop: Column) -> Column:
    """Distinct bigrams that begin at the words from ``start`` to ``stop``."""
    return F.array_distinct(F.transform(F.sequence(start, stop), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))


def _matches(found: Column, size: Column, bigrams: Column, percent: int) -> Column:
    return 200 * F.size(F.array_intersect(found, bigrams)) >= percent * (F.size(found) + size)


def _passages(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """Passages that no line and not the whole text shows: doc_id, license, similarity, n, place. Narrow: everything is decided in the row.

    A window with 2 |A and B| / (|A| + |B|) >= p holds p / (2 - p) of the template's bigrams, so texts with fewer go at once.
    """
    kind = "array<struct<license:string,size:int,n:int,bigrams:array<string>,longer:array<struct<at:int,size:int,n:int,bigrams:array<string>>>>>"
    sets = {name: template_bigrams(text) for name, text in templates.items()}
    length = {name: len(template_words(text)) for name, text in templates.items()}
    listed = F.array(*[
        F.struct(
            F.lit(name), F.lit(len(b)), F.lit(length[name]), F.array(*map(F.lit, b)),
            F.array(*[F.struct(F.lit(at), F.lit(len(sets[o])), F.lit(length[o]), F.array(*map(F.lit, sets[o]))) for o, at in nested_in(name, templates, percent)]),
        )
        for name, b in sets.items()
    ]).cast(kind)
    known = sorted({b for bigrams in sets.values() for b in bigrams})
    leading = sorted({b.split()[0] for b in known})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = pinned(rows, "words", words_of(F.col("text"))).where(F.size("words") > 1)
    pair = lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1))
    places = F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.element_at("words", i).isin(leading) & pair(i).isin(known))
    rows = pinned(rows, "hits", places).where(F.size("hits") > 0)
    rows = pinned(rows, "own", F.array_distinct(F.transform("hits", pair)))
    able = F.filter(listed, lambda t: (F.size("words") > t["n"]) & (F.size(F.array_intersect("own", t["bigrams"])) * (200 - percent) >= percent * t["size"]))
    rows = rows.select("doc_id", "text", "words", "hits", F.explode(able).alias("t"))

    # Windows of the template's number of words, from each of its bigrams; the last ones end with the text.
    starts = F.array_distinct(F.transform(F.filter("hits", lambda i: F.array_contains("t.bigrams", pair(i))), lambda i: F.least(i, F.size("words") - F.col("t.n") + 1)))
    rows = pinned(rows, "starts", starts)
    scored = F.transform("starts", lambda s: F.struct(s.alias("s"), _bigrams(F.col("words"), s, s + F.col("t.n") - 2).alias("b")))
    scored = F.transform(scored, lambda w: F.struct(w["s"].alias("s"), F.size(F.array_intersect(w["b"], "t.bigrams")).alias("shared"), (F.size(w["b"]) + F.col("t.size")).alias("total")))
    rows = pinned(rows, "windows", F.filter(scored, lambda w: 200 * w["shared"] >= percent * w["total"])).where(F.size("windows") > 0)

    # A passage of a longer template is no passage of the shorter one in it.
    def inside(s: Column, o: Column) -> Column:
        first = F.greatest(F.lit(1), F.least(s - o["at"], F.size("words") - o["n"] + 1))
        return _matches(_bigrams(F.col("words"), first, F.least(first + o["n"] - 2, F.size("words") - 1)), o["size"], o["bigrams"], percent)

    rows = pinned(rows, "free", F.filter("windows", lambda w: ~F.exists("t.longer", lambda o: inside(w["s"], o)))).where(F.size("free") > 0).drop("windows")
    # Nor is what a line or the whole text shows by itself.
    rows = rows.where(~_matches(_bigrams(F.col("words"), F.lit(1), F.size("words") - 1), F.col("t.size"), F.col("t.bigrams"), percent))
    cut = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("place"), F.filter(words_of(line), lambda w: w != "").alias("w")))
    rows = pinned(rows, "lines", F.filter(cut, lambda line: F.size(line["w"]) > 0)).drop("text")
    rows = pinned(rows, "place_of", F.flatten(F.transform("lines", lambda line: F.transform(line["w"], lambda _: line["place"]))))
    long = F.filter("lines", lambda line: F.size(line["w"]) > 1)
    shown = F.filter(long, lambda line: _matches(_bigrams(line["w"], F.lit(1), F.size(line["w"]) - 1), F.col("t.size"), F.col("t.bigrams"), percent))
    rows = pinned(rows, "shown", F.transform(shown, lambda line: line["place"])).drop("lines")
    apart = F.filter("free", lambda w: ~F.exists("shown", lambda p: p.between(F.element_at("place_of", w["s"]), F.element_at("place_of", w["s"] + F.col("t.n") - 1))))
    rows = pinned(rows, "apart", F.array_sort(apart)).where(F.size("apart") > 0)
    # Overlapping windows are one passage, which begins with the best of them.
    share = lambda w: 2.0 * w["shared"] / w["total"]
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"), F.lit(0).alias("first"), F.lit(0.0).alias("top"), F.lit(0.0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        new = w["s"] >= a["stop"]
        better = (a["n"] == 0) | ((a["n"] == 1) & ~new & (share(w) > a["top"]))
        return F.struct(
            F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(new, w["s"] + F.col("t.n")).otherwise(a["stop"]).alias("stop"),
            F.when(better, w["s"]).otherwise(a["first"]).alias("first"), F.when(better, share(w)).otherwise(a["top"]).alias("top"), F.greatest(a["best"], share(w)).alias("best"),
        )

    rows = pinned(rows, "f", F.aggregate("apart", none, step))
    return rows.select("doc_id", F.col("t.license").alias("license"), F.col("f.best").alias("similarity"), F.col("f.n").alias("n"), F.element_at("place_of", F.col("f.first")).alias("place"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """Documents that hold a licence notice: doc_id, license, similarity (best Dice), n_units, first_place.

    Units are the lines of a text (place 0, 1, ..), the whole text if it has several lines (place -1), and windows of as many words as a template
    has, across lines, from each of the template's bigrams (place: the line of the first word). Windows count where no line or whole text
    shows the template, overlapping ones as one unit, and not within a passage of a longer template that holds the shorter. A unit matches a template if
    2 |A and B| / (|A| + |B|) >= ``percent`` / 100 over sets of word bigrams. Only sizes from p / (2 - p) to (2 - p) / p of a template's can
    match: units are pruned by their numbers of words and of distinct words (n distinct words make n - 1 distinct bigrams at least) before any
    bigram is built, templates by their sizes before any set is intersected. Narrow up to the last grouping of the few matches.

    * Null or empty text, and units of fewer than two words: no match. Templates of fewer than two words are refused.
    * Rows with one doc_id (or without one) are reported together. Ties in similarity give one row per licence.
    * Other columns are not read; no rows give none.
    """
    sets = {name: template_bigrams(text) for name, text in (templates or TEMPLATES).items()}
    if not all(sets.values()):
        raise ValueError("a template needs two words at least")
    low, high = percent, 200 - percent  # |A| / |B| from low / high to high / low
    least, most = min(map(len, sets.values())), max(map(len, sets.values()))
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in sets.items()])

    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("place"), F.col("text").cast("string").alias("unit")))).otherwise(F.array())
    units = F.concat(F.transform(lines, lambda line, i: F.struct(i.alias("place"), line.alias("unit"))), whole)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(units).alias("u"))
    rows = pinned(rows.select("doc_id", "u.place", "u.unit"), "words", words_of(F.col("unit"))).drop("unit")
    rows = rows.where((F.size("words") > 1) & ((F.size("words") - 1) * high >= least * low))
    rows = rows.where((F.size(F.array_distinct("words")) - 1) * low <= most * high)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    rows = pinned(rows, "bigrams", F.array_distinct(pairs)).drop("words")
    fits = F.filter(listed, lambda t: (F.size("bigrams") * high >= t["size"] * low) & (F.size("bigrams") * low <= t["size"] * high))
    rows = rows.select("doc_id", "place", "bigrams", F.explode(fits).alias("t"))
    rows = pinned(rows, "shared", F.size(F.array_intersect("bigrams", "t.bigrams"))).withColumn("total", F.size("bigrams") + F.col("t.size"))
    rows = rows.where(200 * F.col("shared") >= percent * F.col("total"))
    found = rows.select("doc_id", F.col("t.license").alias("license"), (2.0 * F.col("shared") / F.col("total")).alias("similarity"), F.lit(1).alias("n"), "place")
    found = found.unionByName(_passages(docs, templates or TEMPLATES, percent))
    return found.groupBy("doc_id", "license").agg(F.max("similarity").alias("similarity"), F.sum("n").alias("n_units"), F.min("place").cast("long").alias("first_place"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


_VALUES = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in template_bigrams(text))) for name, text in TEMPLATES.items())
QUERIES = {"op7_licenses": op7_licenses}
ORACLES = {
    "op7_licenses": f"""
        WITH t(license, tb) AS (VALUES {_VALUES}),
        d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        units AS (SELECT doc_id, unnest(l) AS unit, unnest(range(len(l))) AS place FROM d UNION ALL SELECT doc_id, text, -1 FROM d WHERE len(l) > 1),
        words AS (SELECT doc_id, place, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
        sets AS (SELECT doc_id, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
        hits AS (SELECT doc_id, license, place, len(list_intersect(b, tb)) AS shared, len(b) + len(tb) AS total FROM sets, t
                 WHERE len(b) * 120 >= len(tb) * 80 AND len(b) * 80 <= len(tb) * 120)
        SELECT doc_id, license, max(2.0 * shared / total) AS similarity, count(*) AS n_units, min(place) AS first_place
        FROM hits WHERE 200 * shared >= 80 * total GROUP BY ALL
    """
}
