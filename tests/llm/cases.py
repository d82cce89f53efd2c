"""Awkward rows that every operator gets: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random
import re

from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnop"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def texts(seed=3, n=60):
    """(doc_id, text) with families of copies, changed copies, shared lines and odd texts."""
    rng, rows = random.Random(seed), []
    shared = [words(rng, 9) for _ in range(4)]
    for i in range(n):
        body = "\n".join([words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5))] + ([rng.choice(shared)] if i % 3 == 0 else []))
        rows.append((i * 3 + 1, body))
        if i % 7 == 0:
            rows.append((i * 3 + 2, body))
        if i % 5 == 0:
            parts = body.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            rows.append((i * 3 + 3, " ".join(parts)))
    long = words(rng, 6000)
    odd = [None, "", " \n\t ", "\n\n", "one", "two words", "ÄÖÜ ß é é 漢字 　x", "UPPER Lower UPPER lower", long, long + " tail", "a" * 70_000, "<|endoftext|> x<|endoftext|>", "it's  I'll\r\n 12,5% \x1c\x85"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows with extra columns named like the operators' own."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in ("score", "kept", "shard", "slot", "h1", "key", "n_chars", "_row", "rep", "ids", "length", "drops", "n_lines"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("lang", F.lit(None).cast("string"))


def empty(spark, schema="doc_id long, text string"):
    return frame(spark, [], schema)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(ids, linked):
    """Smallest id reachable, by brute force over all pairs."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}
