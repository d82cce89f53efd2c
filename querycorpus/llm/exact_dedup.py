"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage
from querycorpus.llm.common import documents, written

BLANKS = b" \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_points(data: bytes, smallest: int, average_bits: int, largest: int) -> list[int]:
    """Ends of the chunks of ``data``. A cut depends on the eight bytes before it and on the last cut."""
    n = len(data)
    if n <= smallest * 2:
        return [n]
    window = np.frombuffer(data, np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        window = window[:-step] | (window[step:] << np.uint64(8 * step))
    found = (np.flatnonzero((window * MIX) >> np.uint64(64 - average_bits) == 0) + 8).tolist()
    ends, last = [], 0
    for cut in [*found, n]:
        while cut - last > largest:
            last += largest
            ends.append(last)
        if cut - last >= smallest or cut == n:
            ends.append(cut)
            last = cut
    return ends if ends[-1] == n else [*ends, n]


def chunks_of(data: bytes, sizes: tuple[int, int, int]) -> list[bytes]:
    start, out = 0, []
    for end in cut_points(data, *sizes):
        out.append(data[start:end])
        start = end
    return out


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


def _recipes(sizes: tuple[int, int, int], digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, shas, recipes = [], [], []
            for text in batch["text"].to_pylist():
                data = _normal(text)
                points.append(len(text or ""))
                shas.append(hashlib.sha256(data).hexdigest())
                recipes.append([hashlib.blake2b(c, digest_size=digest_bytes).digest() for c in chunks_of(data, sizes)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(points, pa.int64()), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.binary()))],
                ["doc_id", "n_points", "text_sha256", "recipe"],
            )

    return run


def _chunks(sizes: tuple[int, int, int], digest_bytes: int, wanted: bool):
    """(digest, content) of each chunk, once per batch; with ``wanted`` also the place: (text_sha256, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, contents, shas, places, seen = [], [], [], [], set()
            for text in batch["text"].to_pylist():
                data = _normal(text)
                sha = hashlib.sha256(data).hexdigest() if wanted else ""
                for place, chunk in enumerate(chunks_of(data, sizes)):
                    if not wanted and chunk in seen:
                        continue
                    seen.add(chunk)
                    digests.append(hashlib.blake2b(chunk, digest_size=digest_bytes).digest())
                    contents.append(chunk)
                    shas.append(sha)
                    places.append(place)
            arrays = [pa.array(digests, pa.binary()), pa.array(contents, pa.binary())]
            names = ["digest", "content"]
            if wanted:
                arrays += [pa.array(shas, pa.string()), pa.array(places, pa.int32())]
                names += ["text_sha256", "place"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _verified(recipes: DataFrame, texts: DataFrame, sizes: tuple[int, int, int], digest_bytes: int) -> DataFrame:
    """Recipes whose identifiers stand for one content each.

    Contents are compared, not only digests: chunks are grouped by (digest, content) with map-side
    combining, so each content travels at most once per task however often it occurs. A digest with two
    contents gets a number appended per content.
    """
    contents = texts.mapInArrow(_chunks(sizes, digest_bytes, False), "digest binary, content binary").groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))
    doubtful = cut_lineage(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    if doubtful.isEmpty():
        return recipes
    placed = texts.mapInArrow(_chunks(sizes, digest_bytes, True), "digest binary, content binary, text_sha256 string, place int")
    placed = placed.join(doubtful, "digest", "left_semi").distinct()
    numbers = placed.select("digest", "content").distinct().select("digest", "content", F.sha2("content", 256).alias("number"))
    renamed = placed.join(numbers, ["digest", "content"]).select("text_sha256", "place", F.concat("digest", F.to_binary("number", F.lit("hex"))).alias("name"))
    exploded = recipes.select("text_sha256", "recipe").dropDuplicates(["text_sha256"]).select("text_sha256", F.posexplode("recipe").alias("place", "digest"))
    patched = (
        exploded.join(renamed, ["text_sha256", "place"], "left")
        .groupBy("text_sha256")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("name", "digest").alias("name")))), lambda x: x["name"]).alias("recipe"))
    )
    return recipes.drop("recipe").join(patched, "text_sha256")


def exact_duplicates(docs: DataFrame, smallest: int = 1024, average_bits: int = 11, largest: int = 16_384, digest_bytes: int = 16) -> DataFrame:
    """Group documents whose texts are equal after deleting ASCII white space.

    A text becomes an ordered list of chunk identifiers (its recipe); lists are compared in place of texts.
    Returns per row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    * The row with the most code points in its original text stays; ties go to the smallest doc_id.
    * A null text is an empty text; all empty texts form one group (one empty chunk).
    * A null doc_id sorts last: such a row is named as keep_id only (as null) if it is strictly longest.
      Repeated rows with one doc_id count separately in group_size and share the decision.
    * Other columns of ``docs`` are not read; a table without rows gives none.
    """
    sizes = (smallest, average_bits, largest)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = written(
        texts.mapInArrow(_recipes(sizes, digest_bytes), "doc_id long, n_points long, text_sha256 string, recipe array<binary>"), "recipes"
    )
    recipes = _verified(recipes, texts.select("text"), sizes, digest_bytes)
    groups = recipes.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("doc_id", F.struct("n_points", -F.col("doc_id"))).alias("keep_id"),
    )
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """
}
