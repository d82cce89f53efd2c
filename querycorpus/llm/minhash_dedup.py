"""Near duplicates of texts: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import Memo, documents, per_worker, written
from querycorpus.llm.components import components, local_roots

ODD = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def banding(percent: int, bins: int, miss: float) -> tuple[int, int]:
    """(bands, rows): the widest bands by which a pair at the threshold is missed with a chance of at most ``miss``."""
    for rows in range(12, 1, -1):
        if (1 - (percent / 100) ** rows) ** (bins // rows) <= miss:
            return bins // rows, rows
    return bins, 1


class Sketcher:
    """Shingle sets, their one-permutation signatures and band keys."""

    def __init__(self, words: int, bands: int, rows: int) -> None:
        self.words, self.bands, self.rows, self.bins = words, bands, rows, bands * rows
        self.hashes = Memo(lambda w: xxhash.xxh3_64_digest(w), 250_000)
        self.starts = np.array([-(-(b << 64) // self.bins) for b in range(self.bins)], np.uint64)
        self.stops = np.append(self.starts[1:] - np.uint64(1), np.uint64(2**64 - 1))
        self.probes = np.random.default_rng(11).integers(0, self.bins, (16 * self.bins, self.bins))
        self.multipliers = scrambled(np.arange(1, rows + 1, dtype=np.uint64) * ODD[1]) | np.uint64(1)
        self.salts = scrambled(np.arange(1, bands + 1, dtype=np.uint64) * ODD[2])

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word runs; fewer words than a run: one hash of them all."""
        digests = b"".join(map(self.hashes.__getitem__, (text or "").encode().lower().split()))
        words = np.frombuffer(digests, ">u8").astype(np.uint64)
        run = min(self.words, len(words))
        if not run:
            return words
        total = np.full(len(words) - run + 1, run, np.uint64) * ODD[7]
        for i in range(run):
            total += words[i : len(words) - run + 1 + i] * ODD[i % 7] * np.uint64(2 * (i // 7) + 1)
        return np.unique(scrambled(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Least hash of each bin. An empty bin takes over that of the first filled bin in its own random order of bins,
        the same order for all sets."""
        at = np.minimum(np.searchsorted(shingles, self.starts), len(shingles) - 1)
        signature = shingles[at]
        filled = (signature >= self.starts) & (signature <= self.stops)
        empty, start = np.flatnonzero(~filled), 0
        while len(empty):
            probes = self.probes[start : start + 32, empty]
            hits = filled[probes]
            first = hits.argmax(0)
            found = hits[first, np.arange(len(empty))]
            signature[empty[found]] = signature[probes[first[found], np.flatnonzero(found)]]
            empty, start = empty[~found], start + 32
            if start >= len(self.probes):
                signature[empty] = shingles[0]
                break
        return signature

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(self.bands, self.rows)
        return scrambled((rows * self.multipliers).sum(1, dtype=np.uint64) ^ self.salts).view(np.int64)


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = per_worker(f"sketcher {words} {bands} {rows}", lambda: Sketcher(words, bands, rows))
        for batch in batches:
            sizes, first, second, keys, ends = [], [], [], [], [0]
            for text in batch["text"].to_pylist():
                found = sketcher.shingles(text)
                sizes.append(len(found))
                print128 = xxhash.xxh3_128_intdigest(found.tobytes())
                first.append((print128 >> 64) - (1 << 63))
                second.append((print128 & (2**64 - 1)) - (1 << 63))
                if len(found):
                    keys.append(sketcher.keys(found))
                ends.append(ends[-1] + (bands if len(found) else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                ["doc_id", "n_shingles", "f1", "f2", "keys"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = per_worker(f"sketcher {words} 1 1", lambda: Sketcher(words, 1, 1))
        for batch in batches:
            sets = [sketcher.shingles(text).tobytes() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch["one"].to_pylist(), batch["two"].to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_linked(percent), "a long, b long").distinct()


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        nodes = np.repeat(batch["node"].to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets) if sets else nodes)], ["node", "shingle"])


def _compared(percent: int):
    """Rows come sorted by family and block pair. All sets of two blocks are compared at once; each node with links gets the root
    of its links here. Never pairs."""

    def block(rows: pa.Table) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        sizes, nodes, own = np.array([len(x) for x in sets]), rows["node"].to_numpy(), rows["block"].to_numpy()
        names, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = uses > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = np.repeat(np.arange(len(sets)), sizes)[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[a:b], column[a:b] - start] = 1
            both += part @ part.T
        near = np.zeros(both.shape, bool)
        for start in range(0, len(sets), 256):
            strip = both[start : start + 256].astype(np.int64)
            near[start : start + 256] = 100 * strip >= percent * (sizes[start : start + 256, None] + sizes[None, :] - strip)
        np.fill_diagonal(near, False)
        if rows["i"][0] != rows["j"][0]:
            near &= own[:, None] != own[None, :]
        root = local_roots(near)
        return [(int(nodes[k]), int(nodes[root[k]])) for k in np.flatnonzero(root != np.arange(len(root)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch[c].to_numpy() for c in ("family", "i", "j")], 1)
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if tuple(names[a]) != last and held:
                    found += block(pa.Table.from_batches(held))
                    held = []
                last = tuple(names[a])
                held.append(batch.slice(a, b - a))
            yield put(found)
        if held:
            yield put(block(pa.Table.from_batches(held)))

    return run


def _rest(starred: DataFrame, linked: DataFrame, sets: DataFrame, percent: int, block_shingles: int, block_texts: int) -> DataFrame | None:
    """Links that the stars have missed: of members that are not linked with the centre of their bucket.

    A node with too many shingles that no other node here holds can't be linked with any and goes. Buckets that still have unlinked
    members are joined to families by their members; a family's sets are compared in pairs of blocks inside the tasks.
    """
    apart = written(starred.where("rep <> centre").join(linked.select(F.col("a").alias("rep"), F.col("b").alias("centre")), ["rep", "centre"], "left_anti")
                    .join(linked.select(F.col("a").alias("centre"), F.col("b").alias("rep")), ["rep", "centre"], "left_anti").select("key", "rep"), "unlinked_members")
    here = written(starred.join(apart.select("key").distinct(), "key", "left_semi").select("key", "rep", "n"), "open_members")
    nodes = here.groupBy("rep").agg(F.max("n").alias("n"))
    several = sets.groupBy(F.col("node").alias("rep")).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")  # of a repeated doc_id
    held = sets.join(nodes.select(F.col("rep").alias("node")), "node", "left_semi").mapInArrow(_shingles_of, "node long, shingle long")
    private = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses"), F.min("node").alias("rep")).where("uses = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("private"))
    shared = F.col("n") - F.coalesce("private", F.lit(0))
    able = nodes.join(private, "rep", "left").join(several, "rep", "left").where(F.col("texts").isNotNull() | (100 * shared >= percent * F.col("n")))
    able = written(able.select("rep", "n"), "able_members")
    keys = apart.join(able, "rep", "left_semi").select("key").distinct()
    here = here.join(keys, "key", "left_semi").join(able.select("rep"), "rep", "left_semi")
    hubs = here.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    ties = written(here.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "family_ties")
    if ties.isEmpty():
        return None
    # A repeated doc_id brings all its texts into a block, so it counts with all of them.
    families = components(ties).select(F.col("component").alias("family"), F.col("node").alias("rep")).join(able, "rep").join(several, "rep", "left")
    parts = F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.sum(F.coalesce("texts", F.lit(1))) / block_texts))
    blocks = families.groupBy("family").agg(parts.cast("long").alias("blocks"))
    placed = families.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("rep").alias("node"))
    group = ["family", "i", "j"]
    full = placed.join(sets, "node").select(*group, "block", "node", "shingles").repartition(*group).sortWithinPartitions(*group)
    return full.mapInArrow(_compared(percent), "a long, b long")


def _links(texts: DataFrame, nodes: DataFrame, again: DataFrame, words: int, percent: int, block_shingles: int, block_texts: int) -> DataFrame:
    """Components of ``nodes(rep, n, keys)`` as (node, component); ``again`` holds links known beforehand."""
    entries = nodes.select("rep", "n", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(entries.join(sizes, "key"), "bucket_members")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    # The centre of a bucket is the member that meets the most others over all buckets: the source of a family of copies.
    centres = members.join(weights, "rep").groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("c"))
    starred = members.join(centres, "key").select("key", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("m"))
    starred = written(starred, "starred_members")
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")  # else the sizes alone rule the link out
    pairs = starred.where("rep <> centre").where(fits).select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "node long, shingles binary"), "shingle_sets")
    linked = written(_confirmed(pairs, sets, percent), "links")
    rest = _rest(starred, linked, sets, percent, block_shingles, block_texts)
    linked = linked.unionByName(again)
    return components(linked if rest is None else linked.unionByName(rest))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bins: int = 256, miss: float = 1e-6, block_shingles: int = 150_000, block_texts: int = 1024
) -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more, and group them.

    Returns per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).
    Words are runs without ASCII white space, A-Z lower-cased; shingles are compared by 64-bit hashes of whole texts.

    1. Documents of equal sets become one node.
    2. A node's signature (at most ``bins`` bins) is cut into bands; a pair at the threshold shares no band with a chance of at most ``miss``.
    3. Members of a bucket are compared with the bucket's centre only, on their full sets. So that no link between two members is lost
       where one of them is not linked with the centre, the members of such buckets are compared in blocks of about ``block_shingles``
       shingles and ``block_texts`` texts at most, on average, inside the tasks; no pairs leave them.
    4. Links are closed to components.

    * Null, empty or blank text: no shingles, linked with nothing. Fewer words than a shingle: the whole sequence is one.
    * A row without doc_id is linked with nothing: component_id null, kept true.
    * Rows with one doc_id are one document with several texts: links of any of them hold for all.
    * Other columns are not read; no rows give none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, rows = banding(percent, bins, miss)
    sketches = written(texts.mapInArrow(_sketches(words, bands, rows), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    mapped = sketches.select("doc_id", "n_shingles", "f1", "f2").join(nodes.select("f1", "f2", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), ["f1", "f2"], "left")
    mapped = written(mapped.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "mapped")
    again = mapped.where("doc_id <> rep").join(mapped.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    again = again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = _links(texts, nodes, again, words, percent, block_shingles, block_texts).withColumnRenamed("node", "rep")
    out = mapped.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}
ORACLES = {
    "op6_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT node, l.b FROM r JOIN l ON r.seen = l.a),
        c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON node = doc_id LEFT JOIN n USING (doc_id)
    """
}
