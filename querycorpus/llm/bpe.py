"""Byte-level BPE by a backtracking encoder, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querycorpus.llm.common import Memo, documents, per_worker

#: White space as the vocabulary's splitter sees it.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
#: The splitter's pattern for words of ASCII and Latin-1 letters, which need no call of the library.
COMMON = re.compile(" ?[a-zA-ZÀ-ÖØ-öø-ÿ0-9.,;:!?-]+")
PIECES = re.compile(" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[.,;:!?-]+")


class Encoder:
    """Exact BPE of one vocabulary without replaying merges.

    A piece is covered from the left by longest tokens found by one Aho-Corasick pass. A token is taken only if
    it is compatible with the one before it: the two tokens alone would be encoded as themselves. If none of
    the shorter tokens at a place is compatible, the encoder goes back one token. Sequences of pairwise
    compatible tokens are what the merges give, and each place is given up at most once, so the time is linear.
    """

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.names = [""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.names[i] = name
        self.pretokenizer = Tokenizer.from_str(model).pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Tokens are compared by the rank of the merge that makes them; single bytes come first.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        singles = sorted(n for n in vocabulary if n not in made)
        order = singles + [a + b for a, b in merges]
        rank = {name: i for i, name in enumerate(order)}
        self.ids = [vocabulary[name] for name in order]
        self.lengths = [len(name) for name in order]
        self.halves = [(i, i) for i in range(len(singles))] + [(rank[a], rank[b]) for a, b in merges]
        self.joined = {(rank[a], rank[b]): rank[a + b] for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(order):
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(order)
        for i, name in enumerate(order):
            for n in range(len(name) - 1, 0, -1):
                if name[:n] in rank:
                    self.shorter[i] = rank[name[:n]]
                    break
        self.pairs = Memo(self._compatible, 1_000_000)
        self.pieces = Memo(self._common, 400_000)
        self.words = Memo(self._word, 800_000)
        self._offset_table(vocabulary)

    def _offset_table(self, vocabulary: dict[str, int]) -> None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.letters = {b: letter for letter, b in letters.items()}
        texts = [b""] * max([len(self.names), *(i + 1 for i in self.special.values())])
        for name, i in vocabulary.items():
            texts[i] = bytes(letters[c] for c in name)
        for name, i in self.special.items():
            texts[i] = name.encode()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the border between two neighbouring tokens: walk down both sides of it, undoing
        the later merge first; a merge across the border that comes before the one undone would have won."""
        left, right = pair
        halves, joined = self.halves, self.joined
        bound = len(halves)
        while True:
            across = joined.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                bound = left
                left = halves[left][1]
                if left != bound:
                    continue
                bound = right + 1
                right = halves[right][0]
                if right + 1 == bound:
                    return True
            else:
                bound = right + 1
                right = halves[right][0]
                if right + 1 != bound:
                    continue
                bound = left
                left = halves[left][1]
                if left == bound:
                    return True

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, given in the letters of the vocabulary."""
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - lengths[token]] = token  # ends rise, so the last one is the longest
        open_ends = bytearray(b"\x01") * (len(piece) + 1)
        taken: list[int] = []
        place, token = 0, longest[0]
        while place < len(piece):
            while token >= 0 and not (open_ends[place + lengths[token]] and (not taken or pairs[taken[-1], token])):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                place += lengths[token]
                token = longest[place] if place < len(piece) else -1
            elif taken:
                open_ends[place] = 0
                token = taken.pop()
                place -= lengths[token]
            else:
                raise ValueError(f"letters outside the vocabulary: {piece!r}")
        return [self.ids[t] for t in taken]

    def _word(self, word: str) -> bytes:
        if COMMON.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(word)))
        return b"".join(self._packed(piece) for piece, _ in self.pretokenizer.pre_tokenize_str(word))

    def _packed(self, piece: str) -> bytes:
        ids = self.piece(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _common(self, piece: str) -> bytes:
        return self._packed(piece.encode().decode("latin-1").translate(self.letters))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become their ids."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes, block: int = 1 << 18) -> str:
        """Text of ids: runs of the byte table, gathered block by block. Broken sequences become U+FFFD."""
        all_ids, out = np.frombuffer(ids, "<u4"), []
        for start in range(0, len(all_ids), block):
            some = all_ids[start : start + block]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.offsets[some] - (ends - sizes), sizes)
            out.append(self.blob[np.arange(len(shift)) + shift].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


def encoder_of(model: str) -> Encoder:
    """One encoder per vocabulary and worker."""
    return per_worker(f"encoder {hash(model)}", lambda: Encoder(model))


def vocabulary_text(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB), read once on the driver; executors need no copy of it."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _encoded(model: Broadcast, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            counts, id_shas, text_shas, all_ids = [], [], [], []
            for text in batch["text"].to_pylist():
                ids = encoder.encode(text or "")
                counts.append(len(ids) // 4)
                id_shas.append(hashlib.sha256(ids).hexdigest())
                text_shas.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                all_ids.append(ids if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(id_shas), pa.array(text_shas), pa.array(all_ids, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return run


def encode_texts(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids
    (little-endian unsigned 32-bit integers in a binary column).

    Narrow: one row in, one row out, in the same partition. Null text: empty, no tokens. Strings of special tokens in a text
    become their ids, as the library does by default. doc_id may be null or repeated; other columns are not read.
    Words are memoised per worker in a bounded table.
    """
    model = vocabulary_text(docs.sparkSession, path or public_tokenizers.path("byte_bpe_50k.json"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_encoded(model, keep_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if keep_ids else out.drop("ids")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids: null text."""
    model = vocabulary_text(encoded.sparkSession, path or public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir), keep_ids=False)


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
