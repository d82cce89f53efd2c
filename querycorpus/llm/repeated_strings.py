"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix sort by bucket pointers starts from buckets of equal q-grams, orders a bucket by the identifiers of the buckets that
stand at later offsets, and uses each refined identifier again in further refinements. Here identifiers are names by value
(64-bit, so that tasks agree on them without talking): the name of 2d bytes combines the names of d bytes at offsets 0 and d.
Three things keep the work far below one sort row per byte:

* Anchors. Of each run of ``width`` neighbouring offsets the one with the least q-gram name is an anchor, with
  q = length - width + 1. Equal strings of ``length`` bytes have an anchor at the same place, so only anchors (about 2 of 257
  offsets) are put into buckets, each with the run of starts that chose it.
* A bucket with one member is done. A run of starts is refined by the names of what surrounds it: its core (bytes that all its
  strings hold) and its whole (bytes that any of them holds). Equal wholes repeat altogether and go on as one member.
* Only buckets whose members differ are refined further: runs are cut into quarters, down to single starts, where core and
  whole are the string itself.

Strings count as equal if the names of core and whole are (128 bits, built from different pieces).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import documents, written

LENGTH = 400
CUT = 4
SEGMENT = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
#: Buckets with more members are refined by Spark rounds, smaller ones inside a task.
LARGE_BUCKET = 512
#: Keys with more than this part of all rows are joined by broadcast; there are fewer than this many.
HEAVY_KEYS = 1000
LEAST = -(2**63)

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def joined_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two named things in a row."""
    x = a * _ONE
    x += b
    x ^= x >> np.uint64(32)
    x *= _TWO
    x ^= x >> np.uint64(29)
    return x


_BYTES = joined_name(joined_name(np.arange(1, 257, dtype=np.uint64), np.uint64(3)), np.uint64(7))


@dataclass(frozen=True)
class Sizes:
    """``length`` of the strings sought, ``width`` of a run of starts, ``piece``: bytes with a name of their own."""

    length: int

    @property
    def width(self) -> int:
        width = 1
        while width * CUT * 3 <= self.length * 2:
            width *= CUT
        return width

    @property
    def gram(self) -> int:
        return self.length - self.width + 1

    @property
    def piece(self) -> int:
        return 1 << (self.gram.bit_length() - 1)


def piece_names(data: np.ndarray, piece: int) -> np.ndarray:
    """Names of the ``piece`` bytes at each offset, by doubling."""
    names, size = _BYTES[data], 1
    while size < piece:
        names = joined_name(names[:-size], names[size:])
        size *= 2
    return names


def named(names: np.ndarray, piece: int, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Name of the bytes from start to end: the pieces at later offsets one after another, the last one ending at the end."""
    out = joined_name(mark.astype(np.uint64), (end - start).astype(np.uint64))
    at = start.copy()
    while (going := at + piece <= end).any():
        out = np.where(going, joined_name(out, names[np.minimum(at, len(names) - 1)]), out)
        at += piece
    return joined_name(out, names[end - piece])


def run_names(names: np.ndarray, sizes: Sizes, anchor, first, last, offset, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names (core, whole) of the starts ``offset`` to ``offset + size - 1`` bytes before their anchors, in texts from first to last."""
    start, end = np.maximum(first, anchor - (offset + size - 1)), np.minimum(last, anchor - offset + sizes.length)
    core = named(names, sizes.piece, anchor - offset, anchor - (offset + size - 1) + sizes.length, offset)
    # How much the text's bounds cut off tells which starts exist.
    return core, named(names, sizes.piece, start, end, (anchor - start) * (1 << 20) + offset)


def find_anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: Sizes):
    """Anchors of texts side by side in ``data``: (text number, anchor, least start, largest start), and the piece names."""
    width = sizes.width
    data = np.concatenate([data, np.zeros(2 * sizes.length + width, np.uint8)])
    names = piece_names(data, sizes.piece)
    rest = sizes.gram - sizes.piece
    grams = joined_name(names[: len(names) - rest], names[rest:])
    keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size < width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    lengths = last - first
    text = np.repeat(np.arange(len(first)), lengths)
    start = np.arange(len(text))
    fits = start + sizes.length <= last[text]
    start, text = start[fits], text[fits]
    chosen = (keys[start] & PLACE).astype(np.int64)
    new = np.concatenate([np.ones(min(1, len(start)), bool), (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(start)]])[: len(at)] - 1
    return text[at], chosen[at], start[at], start[ends], names


def _segments(texts: list[bytes], sizes: Sizes) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (text number, from, to, owned from): whole short texts, long texts in overlapping parts."""
    group, held, margin = [], 0, 2 * sizes.width + sizes.length
    for i, text in enumerate(texts):
        if len(text) < sizes.length:
            continue
        for at in range(0, len(text), SEGMENT):
            part = (i, max(0, at - margin), min(len(text), at + SEGMENT + margin), at)
            if group and held + part[2] - part[1] > SEGMENT + 2 * margin:
                yield group
                group, held = [], 0
            group.append(part)
            held += part[2] - part[1]
    if group:
        yield group


RUNS = "c long, u long, d long, h long, a int, lo int, hi int"


def _runs(sizes: Sizes):
    """One row per anchor: names of core and whole, the text (d, h), the anchor and the starts that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["text"]]
            d, h = batch["d"].to_numpy(), batch["h"].to_numpy()
            for group in _segments(texts, sizes):
                number, begin, end, owned = (np.array(x, np.int64) for x in zip(*group))
                data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b, _ in group), np.uint8)
                last = np.cumsum(end - begin)
                first = last - (end - begin)
                part, anchor, low, high, names = find_anchors(data, first, last, sizes)
                shift = begin[part] - first[part]
                mine = (anchor + shift >= owned[part]) & (anchor + shift < owned[part] + SEGMENT)
                part, anchor, low, high, shift = (x[mine] for x in (part, anchor, low, high, shift))
                core, whole = run_names(names, sizes, anchor, first[part], last[part], np.zeros_like(anchor), sizes.width)
                text = number[part]
                arrays = [core.view(np.int64), whole.view(np.int64), d[text], h[text], *((x + shift).astype(np.int32) for x in (anchor, low, high))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["c", "u", "d", "h", "a", "lo", "hi"])

    return run


# --- buckets -------------------------------------------------------------------------------


def _met(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows with the columns of their key (``keys`` has its number of rows, n). Heavy keys are broadcast: those with more than
    total / HEAVY_KEYS rows, fewer than HEAVY_KEYS; so no task of the other join gets more rows of one key than that."""
    bound = total // HEAVY_KEYS + 1
    heavy, light = F.broadcast(keys.where(F.col("n") > bound)), keys.where(F.col("n") <= bound)
    return rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(light, on))


def refined(runs: DataFrame, reference: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Group runs by the name of their core and split these buckets by the name of the whole.

    Returns the runs whose whole occurs again, and one member per kind of whole (``reference`` columns, c, bucket size n) of the
    buckets that hold several kinds. Buckets with one member are dropped.
    """
    total = runs.count()
    buckets = runs.groupBy("c").agg(F.count(F.lit(1)).alias("n"), (F.min("u") != F.max("u")).alias("mixed")).where("n > 1")
    met = written(_met(runs, written(buckets, f"{name}_buckets"), ["c"], total), f"{name}_runs")
    mixed = met.where("mixed").withColumnRenamed("n", "bucket_n")
    kinds = mixed.groupBy("c", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*reference)).alias("member"), F.first("bucket_n").alias("bucket_n"))
    kinds = written(kinds, f"{name}_kinds")
    again = _met(mixed, kinds.where("n > 1").select("c", "u", "n"), ["c", "u"], total)
    repeated = met.where("NOT mixed").select(*runs.columns).unionByName(again.select(*runs.columns))
    return repeated, kinds.select("c", F.col("bucket_n").alias("n"), "member.*")


def _quarters(offset: np.ndarray, size: int, *others: np.ndarray):
    """Each run cut into CUT runs of ``size`` starts."""
    parts = (offset[:, None] + np.arange(CUT)[None, :] * size).ravel()
    return parts, *(np.repeat(x, CUT) for x in others)


class Windows:
    """Windows (all bytes that the strings of a run hold) side by side, with their names."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, sizes: Sizes) -> None:
        self.sizes, windows = sizes, [w.as_py() for w in batch["window"]]
        ends = np.cumsum([len(w) for w in windows])
        self.first, self.last = ends - [len(w) for w in windows], ends
        data = np.frombuffer(b"".join(windows) + bytes(2 * sizes.length), np.uint8)
        self.names = piece_names(data, sizes.piece)
        self.shift = self.first - batch["begin"].to_numpy()  # from places in the text to places in ``names``
        self.anchor, self.low, self.high = (batch[c].to_numpy() + self.shift for c in ("a", "lo", "hi"))

    def cut(self, row: np.ndarray, offset: np.ndarray, size: int):
        """The quarters that still hold a start: (row, offset, core, whole, least start, largest start), starts as places in the text."""
        offset, row = _quarters(offset, size, row)
        low, high = np.maximum(self.low[row], self.anchor[row] - offset - size + 1), np.minimum(self.high[row], self.anchor[row] - offset)
        held = low <= high
        row, offset, low, high = row[held], offset[held], low[held], high[held]
        core, whole = run_names(self.names, self.sizes, self.anchor[row], self.first[row], self.last[row], offset, size)
        return row, offset, core, whole, low - self.shift[row], high - self.shift[row]


def _settled(sizes: Sizes):
    """Refine whole buckets inside a task; input is sorted by bucket. Gives the repeated bytes (d, h, s, e)."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        windows, found = Windows(table, sizes), []
        d, h = table["d"].to_numpy(), table["h"].to_numpy()
        row, offset, size = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64), sizes.width
        while size > 1 and len(row):
            size //= CUT
            row, offset, core, whole, low, high = windows.cut(row, offset, size)
            order = np.lexsort((whole, core))
            row, offset, core, whole, low, high = (x[order] for x in (row, offset, core, whole, low, high))
            new_core = np.concatenate([np.ones(min(1, len(core)), bool), core[1:] != core[:-1]])
            new_kind = new_core | np.concatenate([np.ones(min(1, len(core)), bool), whole[1:] != whole[:-1]])
            kind, bucket = np.cumsum(new_kind) - 1, np.cumsum(new_core) - 1
            again = np.bincount(kind)[kind] > 1
            found.append((d[row[again]], h[row[again]], low[again], high[again] + sizes.length))
            going = new_kind & (np.bincount(bucket[new_kind])[bucket] > 1)
            row, offset = row[going], offset[going]
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["d", "h", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            # All before the last bucket of the batch is complete.
            buckets = batch["c"].to_numpy()
            cut = int(np.flatnonzero(buckets != buckets[-1])[-1]) + 1 if len(buckets) and buckets[0] != buckets[-1] else 0
            if held and rows > 4 * LARGE_BUCKET and (cut or held[-1]["c"][-1].as_py() != buckets[0]):
                yield settle([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield settle(held)

    return run


def _cut_runs(sizes: Sizes, size: int):
    """Rows (c, u, rid, offset, d, h, lo, hi) of the quarters of the runs listed in ``offsets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4 * LARGE_BUCKET):
                batch = whole_batch.slice(at, 4 * LARGE_BUCKET)
                lists = batch["offsets"].to_pylist()
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                row, offset, core, whole, low, high = Windows(batch, sizes).cut(row, np.array([o for x in lists for o in x], np.int64), size)
                own = [batch[c].to_numpy()[row] for c in ("rid", "d", "h")]
                arrays = [core.view(np.int64), whole.view(np.int64), own[0], offset.astype(np.int32), own[1], own[2], low.astype(np.int32), high.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["c", "u", "rid", "offset", "d", "h", "lo", "hi"])

    return run


def _windows(sizes: Sizes):
    """The bytes around the anchors of a text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for d, h, text, members in zip(batch["d"].to_pylist(), batch["h"].to_pylist(), batch["text"], batch["members"]):
                data = (text.as_py() or "").encode()
                for m in members.as_py():
                    begin = max(0, m["a"] - sizes.width + 1)
                    rows.append((m["c"], m["n"], d, h, m["a"], m["lo"], m["hi"], begin, data[begin : m["a"] + sizes.length]))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
        columns = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["c", "n", "d", "h", "a", "lo", "hi", "begin", "window"])

    return run


def repeated_bytes(texts: DataFrame, length: int = LENGTH, large: int = LARGE_BUCKET) -> DataFrame:
    """(d, h, s, e): ranges of the texts (d, h, text) that strings of ``length`` bytes cover which start elsewhere, too.

    Ranges of a text overlap and together hold each such byte.
    """
    sizes = Sizes(length)
    as_ranges = ["d", "h", F.col("lo").cast("long").alias("s"), (F.col("hi") + length).cast("long").alias("e")]
    runs = written(texts.mapInArrow(_runs(sizes), RUNS), "runs")
    repeated, members = refined(runs, ["d", "h", "a", "lo", "hi"], "runs")
    out = repeated.select(*as_ranges)
    lists = members.groupBy("d", "h").agg(F.collect_list(F.struct("c", "n", "a", "lo", "hi")).alias("members"))
    windows = texts.join(lists, ["d", "h"]).mapInArrow(_windows(sizes), "c long, n long, d long, h long, a int, lo int, hi int, begin int, window binary")
    windows = written(windows.withColumn("rid", F.monotonically_increasing_id()), "windows")
    small = windows.where(F.col("n") <= large)
    out = out.unionByName(small.repartition("c").sortWithinPartitions("c").mapInArrow(_settled(sizes), "d long, h long, s long, e long"))
    open_runs, size = windows.where(F.col("n") > large).select("rid", F.array(F.lit(0)).alias("offsets")), sizes.width
    while size > 1 and not open_runs.isEmpty():
        size //= CUT
        asked = windows.join(open_runs, "rid")
        cut = written(asked.mapInArrow(_cut_runs(sizes, size), "c long, u long, rid long, offset int, d long, h long, lo int, hi int"), f"runs_{size}")
        repeated, members = refined(cut, ["rid", "offset"], f"runs_{size}")
        out = out.unionByName(repeated.select(*as_ranges))
        open_runs = written(members.groupBy("rid").agg(F.collect_list("offset").alias("offsets")), f"open_{size}")
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _removed(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, starts, ends in zip(batch["doc_id"].to_pylist(), batch["text"], batch["s"], batch["e"]):
                data = (text.as_py() or "").encode()
                spans = merged(list(zip(starts.as_py() or [], ends.as_py() or [])))
                at, kept = 0, []
                for start, end in spans:
                    kept.append(data[at:start])
                    at = end
                rest = b"".join([*kept, data[at:]])
                span_rows = [{"start": s, "end": e} for s, e in spans]
                rows.append((doc_id, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), span_rows, rest if keep else None))
                held += len(data) if keep else 0
                if held > 1 << 24:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        columns = list(zip(*rows)) or [()] * 7
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def without_repeated_strings(docs: DataFrame, length: int = LENGTH, large: int = LARGE_BUCKET, keep: bool = True) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts anywhere else, in the same text or another one.

    Returns per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (start, end), kept (the remaining
    bytes, which may part a character; null with ``keep=False``).

    * Texts are UTF-8; matches never cross texts. All copies go: strings are judged on the input. Texts shorter than ``length`` stay.
    * A null text is an empty text. Rows count one by one: repeated rows, also with null or equal doc_id, repeat each other.
    * Other columns are not read; a table without rows gives none. ``length`` is 6 at least.
    """
    if length < 6:
        raise ValueError("length must be 6 at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LEAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranges = repeated_bytes(texts.drop("doc_id").where(F.octet_length("text") >= length), length, large)
    lists = ranges.groupBy("d", "h").agg(F.collect_list(F.struct("s", "e")).alias("r")).select("d", "h", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"
    return texts.join(lists, ["d", "h"], "left").select("doc_id", "text", "s", "e").mapInArrow(_removed(keep), schema)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_strings(documents(spark, sf_dir), keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op12_suffix_array_dedup": op12_suffix_array_dedup}
ORACLES = {
    "op12_suffix_array_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        starts AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 800)) AS s FROM (SELECT doc_id, x, unnest(range(n - 399)) AS p FROM t WHERE n >= 400)),
        again AS (SELECT doc_id, p FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
        new AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, true) AS first FROM again),
        runs AS (SELECT doc_id, p, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM new),
        spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 400 AS e FROM runs GROUP BY doc_id, run),
        gaps AS (
            SELECT doc_id, x, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a FROM spans JOIN t USING (doc_id)
            UNION ALL
            SELECT doc_id, x, n, coalesce((SELECT max(e) FROM spans WHERE spans.doc_id = t.doc_id), 0) FROM t),
        kept AS (SELECT doc_id, coalesce(string_agg(substring(x, 2 * a + 1, 2 * (s - a)), '' ORDER BY a), '') AS rest FROM gaps GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
        FROM t JOIN kept USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
    """
}
