"""Near duplicates of vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import written
from querycorpus.llm.components import components, local_roots

NODE = ["label", "rep", "h"]


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centre and ``count`` rotations of the unit vectors of ``sample``. Each starts at random and is turned until the
    sample lies close to the corners of the cube (alternating signs and orthogonal Procrustes), so that its sign bits are balanced."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(0)
    data, rng, out = unit - centre, np.random.default_rng(seed), []
    for _ in range(count):
        rotation = np.linalg.qr(rng.normal(size=(data.shape[1], data.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(data.T @ np.where(data @ rotation >= 0, 1.0, -1.0))
            rotation = left @ right
        out.append(rotation)
    return centre, out


def table_plan(rows: int, similarity: float, miss: float) -> tuple[int, int]:
    """(bits, tables): keys grow with the logarithm of the rows, so that a bucket stays small; tables grow with the bits, so that two
    vectors at the similarity share no key with a chance of at most ``miss``."""
    bits = max(12, min(24, math.ceil(math.log2(max(rows, 1) / 4))))
    same = (1 - math.acos(min(1.0, similarity)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def equal_bits(sample: np.ndarray, labels: np.ndarray, similarity: float, pairs: int = 2000, seed: int = 7) -> list[np.ndarray]:
    """For each label the chance of an equal sign bit, after centring, of pairs at exactly the similarity: a vector of the sample and a
    partner turned towards another vector of its label, or anywhere."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre, rng, out = unit.mean(0), np.random.default_rng(seed), []
    for label in np.unique(labels):
        own = unit[labels == label]
        one, two = own[rng.integers(0, len(own), pairs)], own[rng.integers(0, len(own), pairs)]
        two = np.where(np.arange(pairs)[:, None] % 2 == 0, two, rng.normal(size=one.shape))
        across = two - (two * one).sum(1, keepdims=True) * one
        size = np.linalg.norm(across, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-9
        one, across = one[ok], across[ok] / size[ok]
        partner = similarity * one + math.sqrt(max(0.0, 1 - similarity**2)) * across
        a, b = one - centre, partner - centre
        norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        cosine = np.divide((a * b).sum(1), norms, out=np.zeros(len(a)), where=norms > 0)
        if len(cosine):
            out.append(1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi)
    return out


def centred_plan(rows: int, equal: list[np.ndarray], similarity: float, miss: float) -> tuple[int, int]:
    """(bits, tables): ``table_plan`` where centring leaves the angles as they are, else as many tables as the pairs of the worst label need.
    Shorter keys need fewer tables but fill their buckets; the cheapest of both is taken, down to no bits: one bucket, all compared."""
    bits, tables = table_plan(rows, similarity, miss)

    def missed(width: int, count: int) -> float:
        return max(float(((1 - p**width) ** count).mean()) for p in equal)

    if not equal or missed(bits, tables) <= miss:
        return bits, tables
    plans = []
    for width in range(bits, 0, -1):
        low, high = 1, 1
        while high < 1 << 20 and missed(width, high) > miss:
            low, high = high, high * 2
        while low < high:
            half = (low + high) // 2
            low, high = (low, half) if missed(width, half) <= miss else (half + 1, high)
        if missed(width, high) <= miss:
            plans.append((high * (1 + rows / 2**width / 256), -width, high))
    _, width, count = min([*plans, (1 + rows / 256, 0, 1)])
    return -width, count


#: What codes the vectors of one length: centre, rotations side by side, bits of a key, tables.
Plan = tuple[np.ndarray, np.ndarray, int, int]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles are divided by their greatest component; others stay as they are."""
    top = np.abs(x).max(1, keepdims=True, initial=0.0)
    return np.where((top > 1e100) | (top < 1e-100), x / top, x)


def _table_keys(plans: dict[int, Plan]):
    """Add the length ``d`` of each vector and its key in every table of the plan of that length; without a plan all share key 0."""

    def coded(x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in plans:
            return np.zeros((len(x), 1), np.int64)
        centre, turned, bits, tables = plans[x.shape[1]]
        x = _scaled(x)
        signs = ((x / np.linalg.norm(x, axis=1, keepdims=True) - centre) @ turned >= 0).reshape(len(x), tables, bits)
        return signs @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch["embedding"].flatten().to_numpy(zero_copy_only=False), np.float64)
            sizes = batch["embedding"].value_lengths().to_numpy().astype(np.int64)
            ends, counts = np.cumsum(sizes), np.array([plans[d][3] if d in plans else 1 for d in sizes.tolist()], np.int64)
            key_ends = np.cumsum(counts)
            keys = np.empty(key_ends[-1], np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                found = coded(values[(ends[own] - d)[:, None] + np.arange(d)])
                keys[(key_ends[own] - found.shape[1])[:, None] + np.arange(found.shape[1])] = found
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, key_ends], pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), lists], [*batch.schema.names, "d", "keys"])

    return run


def _plans(usable: DataFrame, similarity: float, miss: float, sample_rows: int, plain_rows: int) -> dict[int, Plan]:
    """A plan for each length that more than ``plain_rows`` vectors have, learned on its share of ``sample_rows`` vectors."""
    lengths = usable.groupBy(F.size("embedding").alias("d")).count().where(F.col("count") > plain_rows).orderBy("d").collect()
    plans = {}
    for d, count in lengths:
        own = usable.where(F.size("embedding") == d).select("vec_id", "label", "embedding")
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample_rows // len(lengths), 256)).collect()
        known = _scaled(np.array([r["embedding"] for r in sample], np.float64))
        bits, tables = centred_plan(count, equal_bits(known, np.array([r["label"] for r in sample]), similarity), similarity, miss)
        centre, rotations = learn_rotations(known, max(1, math.ceil(bits * tables / d)))
        plans[d] = centre, np.hstack(rotations)[:, : bits * tables], bits, tables
    return plans


def _compared(similarity: float):
    """Rows come sorted by bucket and block pair. For each, compare all vectors of the two blocks at once; give a row for each
    vector with links: how many it has that are first met in this table, and the root of its links here. Never pairs."""

    def block(rows: dict[str, np.ndarray]) -> list[tuple]:
        n = len(rows["rep"])
        x = _scaled(np.stack(rows["embedding"]).astype(np.float64))
        norms = np.linalg.norm(x, axis=1)
        i, j = rows["i"][0], rows["j"][0]
        across = np.ones(n, bool) if i == j else rows["block"] == i
        near = (x @ x.T) / np.outer(norms, norms) >= similarity
        np.fill_diagonal(near, False)
        if i != j:
            near &= across[:, None] != across[None, :]
        if not near.any():
            return []
        keys = np.stack(rows["keys"])
        table = int(np.flatnonzero(keys[0] == rows["key"][0])[0])
        counts = np.zeros(n, np.int64)
        for start in range(0, n, 256):
            one, two = np.nonzero(near[start : start + 256])
            one += start
            first = ~(keys[one, :table] == keys[two, :table]).any(1)
            np.add.at(counts, one[first], rows["copies"][two[first]])
        rep, root = rows["rep"], local_roots(near)
        return [(rows["label"][k], rep[k], rows["h"][k], counts[k], rep[root[k]]) for k in np.flatnonzero(near.any(1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], [*NODE, "links", "root"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch[c].to_numpy() for c in ("label", "d", "key", "i", "j")], 1)
            edges = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            starts = [0, *edges.tolist(), batch.num_rows]
            found: list[tuple] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                name = tuple(names[a])
                if name != last and held:
                    found += block(_columns(held))
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
            yield put(found)
        if held:
            yield put(block(_columns(held)))

    return run


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    out = {c: table[c].to_numpy() for c in ("label", "rep", "h", "copies", "key", "i", "j", "block")}
    return out | {c: table[c].to_pylist() for c in ("embedding", "keys")}


def near_vectors(vectors: DataFrame, similarity: float = 0.98, miss: float = 0.002, sample_rows: int = 20_000, block_rows: int = 1024) -> DataFrame:
    """Link vectors of one label by cosine in double precision and group them.

    Returns per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    1. Equal vectors of a label become one node with a number of copies.
    2. Rotations are learned on at most ``sample_rows`` vectors, the only bounded step; every vector is coded and entered in every table.
       Each length of vectors has its own plan; vectors of a length that at most ``block_rows`` have are all compared.
    3. A bucket holds the vectors of a label and length with equal key in one table. Buckets of two or more are compared exactly, in block pairs of at
       most about 2 x ``block_rows`` vectors; a link is counted in the first table where its ends meet. Only counts and roots leave a task.
    4. Roots are closed to components.

    A link at exactly the similarity is missed with a chance of about ``miss``; closer ones less. Centring widens the angles of vectors with a
    common direction, so bits and tables are planned by the angles of sample pairs after it, for the label with the worst.

    * Label null, vector null, empty or zero, with null, NaN or infinite components: linked with nothing, its own
      component. Vectors of different lengths have no cosine, so no link. Floats are read as they are, other numbers as doubles. A row without vec_id has a null component and is kept.
    * Rows with one vec_id count separately in n_links and share a component. Other columns are not read; no rows give none.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    usable = rows.where("label is not null and vec_id is not null and size(embedding) > 0").where(finite).where(F.exists("embedding", lambda x: x != 0))
    usable = usable.withColumn("h", F.xxhash64("embedding"))
    nodes = usable.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    plans = _plans(usable, similarity, miss, sample_rows, block_rows)
    schema = f"label long, h long, embedding {kind}, rep long, copies long, d int, keys array<long>"
    coded = written(nodes.mapInArrow(_table_keys(plans), schema), "vector_codes")

    entries = coded.select(*NODE, "d", F.explode("keys").alias("key"))
    sizes = entries.groupBy("label", "d", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    full = entries.join(sizes, ["label", "d", "key"]).withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("long"))
    full = full.withColumn("block", F.pmod(F.xxhash64("rep", "h"), F.col("blocks")))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = full.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(coded.drop("d"), NODE)
    group = ["label", "d", "key", "i", "j"]
    full = full.select(*group, "rep", "h", "copies", "block", "embedding", "keys").repartition(*group).sortWithinPartitions(*group)
    parts = written(full.mapInArrow(_compared(similarity), "label long, rep long, h long, links long, root long"), "vector_links")

    counts = parts.groupBy(*NODE).agg(F.sum("links").alias("links"))
    marked = usable.join(coded.select(*NODE, "embedding", "copies"), ["label", "h", "embedding"]).select("vec_id", *NODE, "copies").join(counts, NODE, "left")
    marked = written(marked.select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_counts")
    links = parts.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # A repeated vec_id ties the nodes it stands in.
    twice = marked.where("vec_id <> rep").join(marked.where("vec_id = rep").select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(twice)).withColumnRenamed("node", "rep")
    linked = marked.join(found, "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    whole = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rest = rows.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & whole)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
        r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, l.b FROM r JOIN l ON r.seen = l.a),
        c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
    """
}
