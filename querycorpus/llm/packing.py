"""Packing texts into training windows with lexical neighbours from a sharded BM25 index."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from querycorpus.llm.bpe import vocabulary_text
from querycorpus.llm.common import Memo, documents, per_worker, release, written

#: The vocabulary's splitter for Latin-1 letters (\xaa \xb5 \xba and \xc0 on are letters, \xb2 \xb3 \xb9 \xbc-\xbe numbers): the kind of each
#: letter. A piece is a run of letters, one number, a shortened word such as 's, or a run of others.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _letters in (
    (_SPACE, "[\t-\r \x85\xa0]"),
    (_LETTER, "[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]"),
    (_NUMBER, "[0-9\xb2\xb3\xb9\xbc-\xbe]"),
):
    _KIND[[i for i in range(256) if re.match(_letters, chr(i))]] = _kind


def plain(text: str) -> bytes | None:
    """The text if it has Latin-1 letters only and nothing that could be a special token, a byte a letter."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"<|" in data else data


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces of lower-case Latin-1 letters begin, and the pieces."""
    data = np.append(data, np.full(3, ord(" "), np.uint8))
    kind = _KIND[data]
    new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER))
    quotes = np.flatnonzero((data[:-3] == ord("'")) & new[:-3])
    one, two = data[quotes + 1], data[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = np.isin(one * np.int64(256) + two, [256 * a + b for a, b in (b"re", b"ve", b"ll")])
    new[quotes[short | long] + 1] = False
    new[quotes[short] + 2] = new[quotes[long] + 3] = True
    bounds = np.flatnonzero(new)
    lengths, inside = np.diff(bounds, append=len(data)), kind[bounds] != _SPACE
    ends = np.append(0, np.cumsum(lengths[inside])).astype(np.int32)
    return bounds[inside], pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[kind != _SPACE])])


MAX_SHARDS = 20_000
#: Texts taken together; a batch of Spark's with all of its ids would be several times as much memory.
TEXTS = 2_048
PLACED = "doc_id long, start long, length long, crc long, doc_tokens long, rare long, second long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Words:
    """Ids of whole texts by the tokenizer. This kind of vocabulary drops white space and no token spans it, so texts are cut into pieces
    and each distinct piece is tokenized once per worker, many in one call: every piece ends with a token that closes a word. A piece
    has a number, by which its ids are found in one array, so that a text costs a few array operations and no look-up of each piece.
    Texts of other letters, or with special tokens, are cut at blanks only and their words tokenized whole."""

    def __init__(self, model: str, limit: int = 350_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        # Pieces are lower-case and cut already: the same vocabulary without the normalizer and the splitter.
        self.merging = self._whole(model)
        self.merging.normalizer = normalizers.Sequence([])
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model, self.limit = model, limit
        self.words = Memo(self._ids, 50_000)
        spec = json.loads(model)["model"]
        self.closing = np.zeros(self.merging.get_vocab_size(with_added_tokens=True) + 1, bool)
        suffix = spec.get("end_of_word_suffix") or "\0"
        self.closing[[i for name, i in spec["vocab"].items() if name.endswith(suffix)]] = True
        self._forget()

    @staticmethod
    def _whole(model: str) -> Tokenizer:
        out = Tokenizer.from_str(model)
        out.no_truncation()
        out.no_padding()
        return out

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return self._whole(self.model)

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[bytes], line: int = 100) -> None:
        found, sizes = [self.ids], []
        for start in range(0, len(missing), 200 * line):
            some = b" ".join(missing[start : start + 200 * line]).decode("latin-1").split(" ")
            lines = [" ".join(some[k : k + line]) for k in range(0, len(some), line)]
            ids = np.array([i for e in self.merging.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = [np.frombuffer(self._ids(p), "<u4") for p in some]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        self.numbers.update(zip(missing, range(len(self.numbers), len(self.numbers) + len(missing)), strict=True))
        self.ids, self.ends = np.concatenate(found), np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes)))

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in groups of a few million letters."""
        group: list[bytes | str] = []
        held = 0
        for text in texts:
            data = plain(text or "")
            group.append(text if data is None else data)
            held += len(group[-1])
            if held > 2_000_000:
                yield from self._flushed(group)
                group, held = [], 0
        yield from self._flushed(group)

    def _flushed(self, group: list[bytes | str]) -> Iterator[np.ndarray]:
        # Long pieces have many ids, so what is held is bounded by ids as well.
        if len(self.numbers) > self.limit or len(self.ids) > 16 * self.limit:
            self._forget()
        simple = [x for x in group if isinstance(x, bytes)]
        starts, pieces = pieces_of(_LOWER[np.frombuffer(b"\n".join(simple), np.uint8)])
        coded = pieces.dictionary_encode()
        used = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.numbers.get, used, repeat(-1)), np.int64, len(used))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = len(self.numbers) + np.arange(len(new))
            self._learn([used[i] for i in new.tolist()])
        number = number[coded.indices.to_numpy()]
        ends = self.ends[number + 1]
        sizes = ends - self.ends[number]
        upto = np.append(0, np.cumsum(sizes))
        place = np.repeat((ends - upto[1:]).astype(np.int32), sizes)
        place += np.arange(upto[-1], dtype=np.int32)
        ids = self.ids[place]
        lengths = np.array([len(x) + 1 for x in simple], np.int64)
        bounds = upto[np.searchsorted(starts, np.append(0, np.cumsum(lengths)))].tolist()
        n = 0
        for entry in group:
            if isinstance(entry, str):
                yield np.frombuffer(b"".join(map(self.words.__getitem__, entry.replace("\n", " ").split(" "))), "<u4")
            else:
                yield ids[bounds[n] : bounds[n + 1]]
                n += 1


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenized(model, window: int, end: int, keep_ids: bool):
    """Whole windows of long texts and one tail of each text. A tail carries its two latest tokens of the vocabulary's order of merges
    (its rarest words, as a rule), by which tails with common subjects come into one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(f"words {hash(model.value)}", lambda: Words(model.value))
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            out: list[tuple] = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), words.many(batch["text"].to_pylist()), strict=True):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                n = len(ids)
                for start in range(0, n, window):
                    piece = ids[start : start + window]
                    top = np.partition(piece, -2)[-2:] if len(piece) > 1 else np.array([0, 0])
                    whole = len(piece) == window
                    data = piece.astype("<u2" if piece.max() < 65_536 else "<u4").tobytes() if keep_ids or not whole else None
                    out.append((doc_id, start, len(piece), crc32(piece) if whole else None, n, int(top[1]), int(top[0]), data))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [c.split()[0] for c in PLACED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def unpacked(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4").astype(np.int32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        for data, length in zip(batch["ids"].to_pylist(), batch["length"].to_pylist(), strict=True):
            found = unpacked(data, length)
            if found.max() >= len(counts):
                counts = np.append(counts, np.zeros(found.max() + 1 - len(counts), np.int64))
            counts[found] += 1  # a token that the tail repeats is set to the same number, so it counts once
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["token", "n"])


class Index:
    """BM25 inverted index of a shard of tails. Postings hold finished weights; a token that more than one in 50 tails has is kept as a
    dense row of weights instead (adding up a row costs about a fiftieth of as many postings), so that a query over all of its tokens stays cheap.
    Dense rows lie in strips of ``strip`` tails, so that the rows of a query are added up in the cache. Tails that are used up leave the
    index from time to time (``narrow``); the scores of the others don't change."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float, end: int, k1: float = 1.2, b: float = 0.75, strip: int = 512) -> None:
        lengths = np.array([len(t) for t in tails], np.int64)
        width, self.size, self.strip = len(idf), len(tails), strip
        self.members = np.arange(self.size)
        kind = np.int32 if self.size * width < 2**31 else np.int64
        keys = np.concatenate(tails, dtype=kind, casting="unsafe")
        keys += np.repeat((np.arange(self.size) * width).astype(kind), lengths)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(first, len(keys))).astype(np.int32)
        keys = keys[first]
        owner, token = (keys // width).astype(np.int32), (keys % width).astype(np.int32)
        inside = token != end
        owner, token, counts = owner[inside], token[inside], counts[inside]
        del keys, first, inside
        weight = idf[token] * counts * (k1 + 1) / (counts + k1 * (1 - b + b * lengths[owner] / average))
        held = np.bincount(token, minlength=width)
        common = np.flatnonzero(held > self.size / 50)
        place = np.full(width, -1, np.int32)
        place[common] = np.arange(len(common))
        self.dense = np.zeros((-(-self.size // strip), len(common), strip), np.float32)
        often = place[token] >= 0
        self.dense[owner[often] // strip, place[token[often]], owner[often] % strip] = weight[often]
        # The tokens of each tail: rows of ``dense``, and tokens that have postings.
        self.rows, self.row_starts = place[token[often]], np.searchsorted(owner[often], np.arange(self.size + 1))
        token, owner, weight = token[~often], owner[~often], weight[~often]
        self.token, self.token_starts = token, np.searchsorted(owner, np.arange(self.size + 1))
        order = np.argsort(token.astype(np.uint16) if width <= 65_536 else token, kind="stable")
        self.post, self.weight = owner[order].astype(np.int64), weight[order]
        self.starts = np.append(0, np.cumsum(np.where(place < 0, held, 0)))

    def narrow(self, unused: np.ndarray) -> None:
        """Take the used tails out of dense rows and postings."""
        left = np.flatnonzero(unused[self.members])
        number = np.full(len(self.members), -1)
        number[left] = np.arange(len(left))
        strips = -(-len(left) // self.strip)
        dense = np.zeros((strips, self.dense.shape[1], self.strip), np.float32)
        for k in range(strips):
            some = left[k * self.strip : (k + 1) * self.strip]
            dense[k, :, : len(some)] = self.dense[some // self.strip, :, some % self.strip].T
        post = number[self.post]
        kept = post >= 0
        self.starts = np.append(0, np.cumsum(kept))[self.starts]
        self.dense, self.post, self.weight, self.members = dense, post[kept], self.weight[kept], self.members[left]

    def scores(self, tail: int) -> np.ndarray:
        """BM25 of every member of the index for all tokens of the query tail."""
        query = self.token[self.token_starts[tail] : self.token_starts[tail + 1]]
        runs = [slice(a, b) for a, b in zip(self.starts[query].tolist(), self.starts[query + 1].tolist(), strict=True) if a < b]
        rows = self.rows[self.row_starts[tail] : self.row_starts[tail + 1]]
        found = np.zeros((len(self.dense), self.strip), np.float32)
        for k, part in enumerate(self.dense):
            np.add.reduce(part.take(rows, axis=0), axis=0, out=found[k])
        found = found.ravel()[: len(self.members)]
        if runs:
            found = found + np.bincount(np.concatenate([self.post[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), len(self.members))
        return found

    def neighbours(self, tail: int, unused: np.ndarray, first: int = 64) -> Iterator[int]:
        """Unused tails that share a token with the query tail, best first. A window rarely takes more than the ``first`` ones (and those tied
        with them), so the others are sorted only when they are asked for. A tail that is used stays so."""
        free = unused[self.members]
        if free.sum() < 0.8 * len(free):
            self.narrow(unused)
            free = unused[self.members]
        members, scores = self.members, self.scores(tail) * free
        if len(scores) > first:
            early = np.flatnonzero(scores >= max(np.partition(scores, -first)[-first], np.finfo(np.float32).tiny))
            yield from members[early[np.argsort(-scores[early], kind="stable")]].tolist()
            scores[early] = 0
        found = np.flatnonzero(scores)
        yield from members[found[np.argsort(-scores[found], kind="stable")]].tolist()


def _packed(frequencies, count: int, average: float, window: int, end: int, block_tails: int, keep_ids: bool):
    """Pack one shard: blocks of tails one after another; an unfilled window goes on into the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the words of the stage before
        df = frequencies.value
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        sequence = TaskContext.get().partitionId() << 40
        room = window
        out: list[tuple] = []

        def put(row: tuple, ids: np.ndarray | None, start: int, length: int, at: int, crc: int | None = None) -> None:
            part = None if ids is None else ids[start : start + length]
            data = None if part is None or not keep_ids else part.astype("<u4").tobytes()
            out.append((row[0], row[1] + start, length, crc32(part) if crc is None else crc, row[2], at, window - room if crc is None else 0, data))

        def block(rows: list[tuple], tails: list[np.ndarray]) -> None:
            nonlocal sequence, room
            index, unused = Index(tails, idf, average, end), np.ones(len(tails), bool)
            taken, following = np.zeros(len(tails), np.int64), 0

            def take(k: int) -> None:
                """As much of tail k as fits; what is left opens the next window."""
                nonlocal sequence, room
                length = min(room, len(tails[k]) - int(taken[k]))
                put(rows[k], tails[k], int(taken[k]), length, sequence)
                taken[k] += length
                unused[k] = taken[k] < len(tails[k])
                room -= length
                if not room:
                    sequence, room = sequence + 1, window

            seed = 0
            while True:
                while following < len(tails) and not unused[following]:
                    following += 1
                if not unused[seed]:
                    if following == len(tails):
                        return
                    seed = following
                take(seed)
                while unused[seed]:
                    take(seed)
                opened = sequence
                last = seed
                for k in index.neighbours(seed, unused):
                    if sequence != opened:
                        break
                    take(k)
                    last = k
                seed = last

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PIECE.split(", ")])
            out.clear()
            return batch

        rows: list[tuple] = []
        tails: list[np.ndarray] = []
        whole = (1 << 39) + sequence
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "length", "crc", "ids")]
            for doc_id, start, tokens, length, crc, data in zip(*columns, strict=True):
                if crc is not None:
                    put((doc_id, start, tokens), unpacked(data, length) if keep_ids else None, 0, length, whole, crc)
                    whole += 1
                    continue
                rows.append((doc_id, start, tokens))
                tails.append(unpacked(data, length))
                if len(tails) == block_tails:
                    block(rows, tails)
                    rows, tails = [], []
            yield flush()
        if tails:
            block(rows, tails)
        yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    window: int = 2048,
    end: int = 1,
    block_tails: int = 8192,
    shard_tails: int = 6144,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack all texts into windows of ``window`` tokens: per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``keep_ids``, ids (little-endian unsigned 32-bit).

    Whole windows of a long text stay together; its tail is packed with its lexical neighbours. Tails are range partitioned by their rarest
    tokens into shards. As a rule a shard is one BM25 index (document frequencies over all tails); one that came out larger has several, of at
    most ``block_tails`` tails. The seed of a window is the next unused tail; it is scored against the whole index by all of its tokens, and
    its unused neighbours fill the window in the order of their scores. The last one is cut and its rest seeds the next window.
    Only the last window of a shard is padded.

    * Null or empty text: only the end token. Without common tokens a window is filled by the next unused tail.
    * doc_id may be null or repeated (each row is packed by itself); ties are broken by the shard's order.
    * Other columns are not read; no rows give none.
    """
    spark = docs.sparkSession
    model = vocabulary_text(spark, path or public_tokenizers.path("word_bpe_49k.json"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = written(texts.mapInArrow(_tokenized(model, window, end, keep_ids), PLACED), "tokens")
    tails = tokens.where("crc is null")
    count, total = tails.agg(F.count(F.lit(1)), F.sum("length")).first()
    # One number for each token of the vocabulary, over all tails.
    frequencies = tails.select("ids", "length").mapInArrow(_document_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(int(frequencies["token"].max() if len(frequencies) else 0) + 1, np.float64)
    table[frequencies["token"].to_numpy(np.int64)] = frequencies["n"].to_numpy(np.float64)
    # A shard streams its tails block by block, so beyond MAX_SHARDS tasks shards grow instead of their number.
    shards = max(1, min(MAX_SHARDS, math.ceil(count / shard_tails)))
    order = ["rare", "second", "doc_id", "start"]
    placed = tokens.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    pack = _packed(spark.sparkContext.broadcast(table), count, (total or 1) / max(count, 1), window, end, block_tails, keep_ids)
    out = placed.mapInArrow(pack, PIECE)
    return out if keep_ids else out.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), keep_ids=False)


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
