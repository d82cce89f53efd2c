"""Embeddings: encode texts, reduce, keep in tables, find nearest neighbours.

Neighbour search is exact and prunes by the triangle inequality in a tree of cells. Each filter value has a tree of its own; a cell
with more than ``LEAF`` items is split by some of its items as pivots, level by level, so the tree grows with the items. A cell knows
its pivot and its least and largest distance from it. A first round scores every query against its nearest leaves, which bounds its
k-th distance; a second one scores it against every leaf that begins within the bound. Neighbouring leaves lie together in blocks of items,
queries of one home block in blocks of queries, and a pair of blocks is one group of bounded size: a query is sent once to a block, not once
to each of its leaves, and a block of items once to a block of queries. Where nothing can be pruned n items and m queries move
n * m / BLOCK vectors twice. Each group returns only k rows per query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage, top_k
from querycorpus.sources.sinks import append_unique, read_if_complete

LEAF = 2048
FAN = 64
MAX_DEPTH = 8
BLOCK_ITEMS = 8192
BLOCK_QUERIES = 1024
#: Items and queries of a pair of blocks, which one task scores leaf by leaf and CHUNK queries at a time.
BLOCK = 32_768
CHUNK = 1024
SCORE_DIGITS = 9
SLACK = 1e-7


# --- encoding ---------------------------------------------------------------------------


def hashed_vector(text: Column, dims: int = 32) -> Column:
    """Counts of hashed words; an empty or null text gives zeros. Words are runs of ASCII letters, digits and _; a word's place is
    its md5 (the first 8 hex digits) modulo ``dims``, looked up once per word and worker."""
    split = re.compile("[^a-z0-9_]+")
    places: dict[str, int] = {}

    def place(word: str) -> int:
        if word not in places:
            if len(places) > 500_000:
                places.clear()
            places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims
        return places[word]

    @F.pandas_udf("array<double>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            words = [[w for w in split.split((t or "").lower()) if w] for t in some]
            rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
            at = np.fromiter((place(w) for ws in words for w in ws), np.int64, len(rows))
            table = np.bincount(rows * dims + at, minlength=len(words) * dims).reshape(len(words), dims)
            yield pd.Series(list(table.astype(np.float64)))

    return counted(text)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(F.transform(v, lambda x: x.cast("float")))


def encode_items(
    items: DataFrame, key: str, sentences: str, encoder: Callable[[Column], Column] | None = None, dims: int = 32
) -> DataFrame:
    """One row per sentence of every item in order; null sentences count as empty text.

    ``encoder`` maps a text column to a vector column, for instance an iterator ``pandas_udf``
    around a model; the default counts hashed words.
    """
    rows = items.select(key, F.posexplode_outer(sentences).alias("place", "sentence"))
    rows = rows.withColumn("sentence", F.coalesce("sentence", F.lit(""))).where("place IS NOT NULL")
    if encoder:
        return rows.withColumn("embedding", encoder(F.col("sentence")))
    counted = rows.select("*", F.explode(F.array(hashed_vector(F.col("sentence"), dims))).alias("_v"))
    return counted.withColumn("embedding", unit_vector(F.col("_v"))).drop("_v")


def regrouped(encoded: DataFrame, key: str) -> DataFrame:
    """Ordered list of sentence vectors per item; a list is as long as the item had sentences."""
    listed = F.sort_array(F.collect_list(F.struct("place", "embedding")))
    return encoded.groupBy(key).agg(F.transform(listed, lambda s: s["embedding"]).alias("embeddings"))


def reduced(df: DataFrame, column: str, target: int) -> DataFrame:
    """PCA to ``target`` dimensions on centred vectors; unchanged if target >= min(rows, dims)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = df.select(F.size(column).alias("n")).first()
    dims = first["n"] if first else 0
    if target >= min(df.limit(target + 1).count(), dims):
        return df
    vectors = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=target, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn(column, vector_to_array("_p", "float32")).drop("_v", "_c", "_p")


# --- vector tables -----------------------------------------------------------------------


def store_vectors(rows: DataFrame, path: str, key: str, embedding: str, dims: int, stored_keys: str = "error") -> None:
    """Append rows to a vector table after checking key, embedding column and dimension."""
    if embedding not in rows.columns:
        raise ValueError(f"column {embedding} is missing")
    if key not in rows.columns or key == embedding:
        raise ValueError("the key must be a column other than the embedding")
    wrong = rows.where(F.col(embedding).isNull() | (F.size(embedding) != dims)).limit(1)
    if not wrong.isEmpty():
        raise ValueError(f"every embedding must have {dims} numbers")
    append_unique(rows, path, key, stored_keys)


def is_filled(spark, path: str) -> bool:
    stored = read_if_complete(spark, path)
    return stored is not None and not stored.isEmpty()


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complex payload columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def unpacked(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def vectors_of(keys: DataFrame, items: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """The stored vector of every key, null if absent."""
    return keys.join(items.select(key, embedding), key, "left")


# --- neighbours ---------------------------------------------------------------------------


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.asarray(vectors.tolist(), dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _assigned(fan_out: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """The child cell of each item of a block, with its distance from the pivot."""
    if items.empty or fan_out.empty:
        return pd.DataFrame({"item_id": [], "vec": [], "node": [], "dist": []})
    fan_out = fan_out.sort_values("place")
    d = _distances(_unit(items["vec"]), _unit(fan_out["vec"]))
    child = d.argmin(axis=1)
    return pd.DataFrame(
        {"item_id": items["item_id"], "vec": items["vec"], "node": fan_out["child"].to_numpy()[child], "dist": d[np.arange(len(d)), child]}
    )


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns under fresh identities, so that a table can be grouped beside one it comes from."""
    return df.select(*[F.col(c).alias(f"{c}_") for c in df.columns]).toDF(*df.columns)


def _measured(cells: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Distances of the queries of a block from the pivots of a cell's children."""
    if cells.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "node": [], "d": [], "n": [], "near": [], "far": []})
    d = _distances(_unit(queries["vec"]), _unit(cells["vec"])).ravel()
    known = {c: np.tile(cells[c].to_numpy(), len(queries)) for c in ("node", "n", "near", "far")}
    return pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy(), len(cells)), "d": d, **known})


FOUND = "query_id long, item_id long, similarity double"
_FOUND = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])
_NO_ID = np.iinfo(np.int64).max


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists."""
    lists = column.combine_chunks()
    rows = len(lists)
    if len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _numbers(column: pa.ChunkedArray, missing: float) -> np.ndarray:
    return column.fill_null(missing).to_numpy()


def _block_top_k(k: int, exclude_same: bool):
    """Nearest items of one block for the queries of one block, each against the cells it names.

    Products in single precision leave out what lies beyond a query's ``least`` similarity by more than their error; what is left is scored
    in double precision, and the k-th of it is the new ``least``.
    """
    wanted = k + int(exclude_same)

    def best(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(items) or not len(queries):
            return _FOUND.empty_table()
        items = items.sort_by("cell")
        cell, ids, there = items["cell"].to_numpy(), _numbers(items["item_id"], _NO_ID), _vectors(items["vec"])
        asking, mine = queries["query_id"].to_numpy(), _vectors(queries["vec"])
        least = _numbers(queries["least"], -np.inf).copy()
        short_there, short_mine = there.astype(np.float32), mine.astype(np.float32)
        error = (there.shape[1] + 4) * 1.2e-7 + 2 * 10.0**-SCORE_DIGITS
        named = queries["cells"].combine_chunks()
        row = np.repeat(np.arange(len(asking)), np.diff(named.offsets.to_numpy()))
        visited = named.flatten().to_numpy()
        order = np.argsort(visited, kind="stable")
        row, visited = row[order], visited[order]
        top_score, top_item = np.full((len(asking), k), -np.inf), np.zeros((len(asking), k), np.int64)
        for here in np.unique(visited):
            a, b = np.searchsorted(cell, [here, here + 1])
            visitors = row[slice(*np.searchsorted(visited, [here, here + 1]))]
            for start in range(0, len(visitors) if b > a else 0, CHUNK):
                some = visitors[start : start + CHUNK]
                short = short_mine[some] @ short_there[a:b].T
                low = least[some]
                unknown = np.flatnonzero(np.isneginf(low))
                if len(unknown) and b - a > wanted:
                    low[unknown] = np.partition(short[unknown], b - a - wanted, axis=1)[:, b - a - wanted]
                at, col = np.nonzero(short >= (low - error)[:, None])
                score = np.round(np.einsum("ij,ij->i", mine[some[at]], there[a + col]), SCORE_DIGITS)
                kept = np.isfinite(score)
                if exclude_same:
                    kept &= asking[some[at]] != ids[a + col]
                if not kept.any():
                    continue
                at, col, score = at[kept], a + col[kept], score[kept]
                old = np.flatnonzero(np.bincount(at, minlength=len(some)))
                held_at, held_place = np.nonzero(np.isfinite(top_score[some[old]]))
                at = np.append(at, old[held_at])
                score = np.append(score, top_score[some[old]][held_at, held_place])
                col = np.append(col, top_item[some[old]][held_at, held_place])
                order = np.lexsort((ids[col], -score, at))
                at, score, col = at[order], score[order], col[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                first = place < k
                top_score[some[old]], spot = -np.inf, (some[at[first]], place[first])
                top_score[spot], top_item[spot] = score[first], col[first]
                least[some[old]] = np.maximum(least[some[old]], top_score[some[old], k - 1])
        at, place = np.nonzero(np.isfinite(top_score))
        item = ids[top_item[at, place]]
        return pa.table([pa.array(asking[at]), pa.array(item, mask=item == _NO_ID), pa.array(top_score[at, place])], schema=_FOUND)

    return best


VISITS = "query_id long, vec {kind}, least double, root string, super int, home int, sub int, cells array<int>"
BLOCKS = "root string, super int, home int, sub int"


def _visits(wanted: int, nearest_only: bool = False, blocks_only: bool = False):
    """The cells that the queries of a block go to, by block of items: those that begin within the bound of the k-th distance, or the nearest
    ones that hold ``wanted`` items together. ``home`` is the block of the nearest cell. ``blocks_only``: just the blocks that any query goes to."""
    block_kinds = {"root": pa.string(), "super": pa.int32(), "home": pa.int32(), "sub": pa.int32()}

    def run(cells: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec": queries["vec"].type, "least": pa.float64(), **block_kinds, "cells": pa.list_(pa.int32())}
        schema = pa.schema(list((block_kinds if blocks_only else kinds).items()))
        if not len(cells) or not len(queries):
            return schema.empty_table()
        cells = cells.sort_by("cell")
        number, block, n = (cells[c].to_numpy() for c in ("cell", "super", "n"))
        near, far = _numbers(cells["near"], 0.0), _numbers(cells["far"], 2.0)
        split = cells["vec"].is_valid().to_numpy()
        pivots = _vectors(cells["vec"].filter(pa.array(split))) if split.any() else None
        mine, least = _vectors(queries["vec"]), _numbers(queries["least"], -np.inf)
        bound = np.where(np.isfinite(least), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.where(np.isfinite(least), least, 0.0)) + 4 * 10.0**-SCORE_DIGITS) + SLACK, np.inf)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out, used = [], np.zeros(len(first), bool)
        for start in range(0, len(mine), CHUNK):
            some = mine[start : start + CHUNK]
            d = np.zeros((len(some), len(n)))
            if pivots is not None:
                d[:, split] = _distances(some, pivots)
            if nearest_only:
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                goes = np.zeros(d.shape, bool)
                np.put_along_axis(goes, order, before < wanted, axis=1)
                home = block[order[:, 0]]
            else:
                low = np.where(split, np.maximum(0.0, np.maximum(d - far, near - d)), 0.0)
                goes = low <= bound[start : start + CHUNK, None]
                home = queries["home"].to_numpy()[start : start + CHUNK]
            visits = np.add.reduceat(goes.astype(np.int32), first, axis=1)
            used |= visits.any(axis=0)
            if blocks_only:
                continue
            at, group = np.nonzero(visits)
            _, cell = np.nonzero(goes)  # by query and then by cell, as the blocks are
            ends = np.append(0, np.cumsum(visits[at, group])).astype(np.int32)
            rows = queries.take(pa.array(start + at))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[cell].astype(np.int32)))
            columns = [rows[c] for c in ("query_id", "vec", "least", "root")]
            columns += [pa.array(block[first][group].astype(np.int32)), pa.array(home[at].astype(np.int32)), rows["sub"], lists]
            out.append(pa.table(columns, names=schema.names).cast(schema))
        if blocks_only:
            gone = block[first][used].astype(np.int32)
            one = queries.take(pa.array(np.zeros(len(gone), np.int64)))
            return pa.table([one["root"], pa.array(gone), one["home"], one["sub"]], names=schema.names).cast(schema)
        return pa.concat_tables(out)

    return run


class CellTree:
    """Items by leaf cell, and the cells of each level with their parents.

    ``placed``: item_id, vec, node. ``levels``: node (parent), child, vec (pivot), n, near, far. Only the number of levels is known to
    the driver. ``fan`` pivots of a cell are its items of smallest hash.
    """

    def __init__(self, items: DataFrame, leaf: int, fan: int) -> None:
        self.levels: list[DataFrame] = []
        kind = items.schema["vec"].dataType.simpleString()
        done, rest = None, items
        for depth in range(MAX_DEPTH + 1):
            sizes = cut_lineage(rest.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
            if depth == 0:
                self.roots = sizes
            large = sizes.where(F.col("n") > leaf)
            if depth == MAX_DEPTH or large.isEmpty():
                self.placed = rest if done is None else done.unionByName(rest)
                return
            settled = rest.join(large, "node", "left_anti")
            done = settled if done is None else done.unionByName(settled)
            width = F.greatest(F.lit(2), F.least(F.lit(fan), F.ceil(2 * F.col("n") / leaf))).cast("int")
            large = large.withColumn("width", width).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int"))
            inside = rest.join(large, "node")
            seeds = top_k(inside, ["node"], [F.md5(F.col("item_id").cast("string")), F.col("item_id")], fan).where("rank <= width")
            pivots = cut_lineage(seeds.select("node", "blocks", "vec", F.col("rank").alias("place"), F.concat_ws("/", "node", "rank").alias("child")))
            dealt = inside.select("item_id", "vec", "node", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block"))
            spread = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            assigned = _renamed(spread).groupBy("node", "block").cogroup(dealt.groupBy("node", "block")).applyInPandas(
                _assigned, f"item_id long, vec {kind}, node string, dist double"
            )
            assigned = cut_lineage(assigned)
            cells = assigned.groupBy(F.col("node").alias("child")).agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"))
            self.levels.append(cut_lineage(pivots.select("node", "child", "vec").join(cells, "child")))
            rest = assigned.drop("dist")


def _cells(tree: CellTree) -> DataFrame:
    """One row per leaf, or per part of a leaf that is too large: root, super (block of items), cell (number in its tree), node, part of
    ``parts``, n, and vec (pivot), near, far, which are null for a tree that is one leaf. Neighbouring leaves share a block."""
    unknown = "CAST(NULL AS DOUBLE)"
    pivots = tree.placed.limit(0).select("node", "vec", F.expr(unknown).alias("near"), F.expr(unknown).alias("far"))
    for level in tree.levels:
        pivots = pivots.unionByName(level.select(F.col("child").alias("node"), "vec", "near", "far"))
    sizes = tree.placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int"))
    rows = sizes.join(pivots, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("n", F.ceil(F.col("n") / F.col("parts"))).withColumn("root", F.regexp_replace("node", r"(/\d+)+$", ""))
    order = Window.partitionBy("root").orderBy("node", "part")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut_lineage(rows.withColumn("super", F.floor(before / BLOCK).cast("int")).withColumn("cell", F.row_number().over(order) - 1))


def _wider(distance: Column) -> Column:
    """A distance bound that also holds what the rounding of similarities makes equal."""
    return F.sqrt(distance * distance + 4 * 10.0**-SCORE_DIGITS) + SLACK


def _frontier(tree: CellTree, asked: DataFrame, k: int, probes: int | None) -> DataFrame:
    """(query_id, node, d, n, low): leaves that can hold one of the k nearest, or near ones only with ``probes``.

    ``high`` is a distance within which all items of a cell lie: the cells of smallest ``high`` with k items together bound the k-th
    distance, and cells that begin beyond the bound are left.
    """
    unknown = F.lit(None).cast("double")
    open_cells = asked.join(tree.roots, "node").select("query_id", "node", F.lit(0.0).alias("d"), "n", F.lit(0.0).alias("low"), F.lit(2.0).alias("high"))
    for level in tree.levels:
        split = level.select("node").distinct()
        stay = open_cells.join(split, "node", "left_anti")
        deeper = open_cells.join(split, "node").select("query_id", "node")
        q_block = F.pmod(F.xxhash64("query_id"), F.lit(asked_blocks(tree, asked))).cast("int")
        left = deeper.join(asked.select("query_id", "vec"), "query_id").withColumn("q_block", q_block)
        right = level.select(F.col("node").alias("parent"), F.col("child").alias("node"), "vec", "n", "near", "far")
        right = right.join(left.select(F.col("node").alias("parent"), "q_block").distinct(), "parent")
        measured = _renamed(right).groupBy("parent", "q_block").cogroup(left.groupBy("node", "q_block")).applyInPandas(
            _measured, "query_id long, node string, d double, n long, near double, far double"
        )
        low = F.greatest(F.lit(0.0), F.col("d") - F.col("far"), F.col("near") - F.col("d"))
        both = stay.unionByName(measured.select("query_id", "node", "d", "n", low.alias("low"), (F.col("d") + F.col("far")).alias("high")))
        if probes is not None:
            open_cells = cut_lineage(top_k(both, ["query_id"], [F.col("d"), F.col("node")], probes).drop("rank"))
            continue
        order = Window.partitionBy("query_id").orderBy("high", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        enough = both.withColumn("_sum", F.sum("n").over(order))
        bound = F.min(F.when(F.col("_sum") >= k, F.col("high")).otherwise(unknown)).over(Window.partitionBy("query_id"))
        kept = enough.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("low") <= _wider(F.col("_bound"))))
        open_cells = cut_lineage(kept.drop("_sum", "_bound"))
    return open_cells


def asked_blocks(tree: CellTree, asked: DataFrame) -> int:
    """Number of blocks of queries, counted once per search."""
    if not hasattr(tree, "q_blocks"):
        tree.q_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    return tree.q_blocks


def nearest(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "item_id",
    query_key: str = "query_id",
    embedding: str = "embedding",
    filters: list[str] = (),
    exclude_same: bool = False,
    probes: int | None = None,
    leaf: int = LEAF,
    fan: int = FAN,
) -> DataFrame:
    """``query_id, item_id, similarity, rank``: the k most similar items of every query by cosine.

    ``filters`` are columns that must be equal on both sides; each of their values has a tree of its own. ``exclude_same`` leaves out the
    item with the query's own key. Zero vectors are not comparable and take no part. The result is exact; ``probes=n`` keeps only
    the n nearest cells of each level instead. Equal scores go to the smaller key.
    """
    usable = F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    root = (F.to_json(F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(filters)])) if filters else F.lit("")).alias("node")
    mine = items.select(F.col(key).cast("long").alias("item_id"), root, F.col(embedding).alias("vec")).where(usable)
    asked = queries.select(F.col(query_key).cast("long").alias("query_id"), root, F.col(embedding).alias("vec")).where(usable)
    wanted = k + int(exclude_same)
    # Of equal vectors only the k smallest keys can be among the k nearest (one more with exclude_same).
    mine = cut_lineage(top_k(mine, ["node", "vec"], [F.col("item_id")], wanted).drop("rank"))
    asked = cut_lineage(asked)
    tree = CellTree(mine, leaf, fan)
    cells = _cells(tree)
    own = cells.select(F.col("node").alias("_leaf"), "part", "parts", "root", "super", "cell")
    there = (F.col("node") == F.col("_leaf")) & (F.pmod(F.xxhash64("item_id"), F.col("parts")) == F.col("part"))
    placed = cut_lineage(tree.placed.join(own, there).select("item_id", "vec", "root", "super", "cell"))
    visited = VISITS.format(kind=asked.schema["vec"].dataType.simpleString())

    def sub_blocks(rows: DataFrame, group: list[str]) -> DataFrame:
        """Rows with ``sub``, so that a group has about BLOCK of them in each."""
        sizes = cut_lineage(rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_subs")))
        return rows.join(sizes, group).withColumn("sub", F.pmod(F.xxhash64("query_id"), F.col("_subs")).cast("int")).drop("_subs")

    def going(rows: DataFrame, group: list[str], **options: bool) -> DataFrame:
        """The visits of the queries in blocks of ``group``; the cells of a tree go to each of its blocks of queries."""
        spread = cells.select("root", "super", "cell", "n", "vec", "near", "far").join(rows.select(*group).distinct(), "root")
        run = _visits(wanted, **options)
        return _renamed(spread).groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(run, BLOCKS if "blocks_only" in options else visited)

    def search(visits: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
        """Score visits: equi-joined groups of one block of items and one block of queries."""
        right = placed.join(blocks.select(*group), ["root", "super"])
        scored = _renamed(right).groupBy(*group).cogroup(visits.groupBy(*group)).applyInArrow(_block_top_k(k, exclude_same), FOUND)
        return top_k(scored, ["query_id"], [F.desc("similarity"), F.col("item_id")], k)

    if probes is not None:
        # Queries by the leaves that are left of the cells nearest on each level.
        frontier = _frontier(tree, asked, wanted, probes).select("query_id", "node")
        kept = frontier.join(cells.select("node", "root", "super", "cell"), "node").groupBy("query_id", "root", "super").agg(F.collect_set("cell").alias("cells"))
        visits = kept.join(asked.select("query_id", "vec"), "query_id").withColumn("least", F.lit(None).cast("double"))
        visits = cut_lineage(sub_blocks(visits, ["root", "super"]))
        return search(visits, visits.select("root", "super", "sub").distinct(), ["root", "super", "sub"])

    no_bound = F.lit(None).cast("double").alias("least")
    # A repeated key stands for each of its vectors.
    known = asked.select("query_id", F.col("node").alias("root")).join(asked.select("query_id", "vec"), "query_id").select("query_id", "vec", no_bound, "root")
    if tree.levels:
        hashed = cut_lineage(sub_blocks(known, ["root"]))
        near = cut_lineage(going(hashed, ["root", "sub"], nearest_only=True).drop("sub"))
        near = sub_blocks(near, ["root", "super"])
        first = search(near, near.select("root", "super", "sub").distinct(), ["root", "super", "sub"])
        least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
        at_home = near.where("super = home").select("query_id", "vec", "root", "home")
        known = at_home.join(least, "query_id", "left").select("query_id", "vec", "least", "root", "home")
    else:
        known = known.withColumn("home", F.lit(0))
    group = ["root", "home", "sub"]
    known = cut_lineage(sub_blocks(known, ["root", "home"]))
    blocks = cut_lineage(going(known, group, blocks_only=True))
    return search(going(known, group), blocks, ["root", "super", "home", "sub"])


def similar_examples(
    questions: DataFrame,
    pool: DataFrame,
    k: int,
    key: str,
    embedding: str = "embedding",
    same_db: str | None = None,
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Pool rows most like each question, never the question itself.

    A question uses its stored vector if the pool has it, else ``encoder`` on its text.
    """
    stored = pool.select(key, F.col(embedding).alias("_stored"))
    known = questions.join(stored, key, "left")
    vector = F.col("_stored")
    if embedding in questions.columns:
        vector = F.coalesce("_stored", embedding)
    elif encoder is not None:
        vector = F.coalesce("_stored", encoder(F.col("nl_question")))
    asked = known.withColumn(embedding, vector).where(F.col(embedding).isNotNull())
    return nearest(pool, asked, k, key, key, embedding, [same_db] if same_db else [], exclude_same=True)
