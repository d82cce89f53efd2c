import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querycorpus.llm import bpe, packing, sharding


@pytest.fixture(scope="module")
def byte_level():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return bpe.Encoder(file.read()), Tokenizer.from_file(path)


def test_ids_equal_the_library_on_random_texts(byte_level):
    encoder, library = byte_level
    rng = random.Random(5)
    letters = "aabbé÷× -19  \n\t'sSt́ß漢\x1c\x85　.,!<|>🙂\x00"
    for i in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + ("<|endoftext|>x" if i % 50 == 0 else "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text
        assert encoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_encoded_rows(spark, byte_level):
    rows = [*cases.texts(), (None, "no id"), (1, "again"), (1, "again")]
    got = bpe.encode_texts(cases.frame(spark, rows))
    found = got.collect()
    assert len(found) == len(rows)
    by = {(r["doc_id"], r["n_tokens"], r["ids"] and bytes(r["ids"])) for r in found}
    for i, text in rows:
        ids = byte_level[1].encode(text or "", add_special_tokens=False).ids
        assert (i, len(ids), np.array(ids, "<u4").tobytes()) in by
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode_ids(got).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    assert bpe.encode_texts(cases.empty(spark)).count() == 0


def test_broken_sequences_decode_like_the_library(byte_level):
    encoder, library = byte_level
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 50_257, 12)
        assert encoder.decode(ids.astype("<u4").tobytes(), block=5) == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("settings", [{}, {"window": 64, "block_tails": 8, "shard_tails": 30}])
def test_packing_keeps_every_id_once(spark, settings):
    rows = [*cases.texts(), (77_777, "it's NAÏVE I'll 3.14 <|endoftext|> x")]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack_documents(cases.frame(spark, rows), **settings).collect()
    window = settings.get("window", 2048)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, text in rows:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(docs[i], key=lambda p: p["start"]):
            piece = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"], bytes(p["ids"])) == (at, len(ids), zlib.crc32(piece.tobytes()), piece.tobytes())
            at += p["length"]
        assert at == len(ids)
    open_windows = 0
    for ps in sequences.values():
        ends = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == ends
            ends += p["length"]
        assert ends <= window
        open_windows += ends < window
    tails = sum(1 for p in pieces if p["start"] == 0)
    assert open_windows <= -(-tails // settings.get("shard_tails", 8192))


def test_word_ids_by_arrays_equal_the_library():
    """Pieces cut and coded a group at a time: shortened words, numbers, letters beyond ASCII, texts that go to the library whole, and a memo
    that is emptied between groups. What is held has a bound in ids, so long pieces count as well."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        words, library = packing.Words(file.read(), limit=50), Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = "abstrvemldSTRVEMLD''''  \n\t19.,!²¼½µªºßÀéÿ÷×\x85\xa0\x1c\x00-<|漢"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", None, "'", "''s", "it'll've't'", "x'r", "ab" * 400, "<|endoftext|>"]
    for group in (texts[:1000], texts[1000:], texts):
        for text, ids in zip(group, words.many(group), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    one = packing.Words(library.to_str(), limit=50)
    for k in range(20):
        list(one.many(["xqz" * 500 + "a" * k]))
        assert len(one.ids) <= 16 * one.limit + 1500


def test_packing_takes_the_nearest_tail_first():
    tails = [np.array(t) for t in ([5, 6, 7, 1], [90, 91, 92, 1], [5, 6, 8, 1], [5, 90, 93, 1], [1])]
    index = packing.Index(tails, np.ones(100), 4.0, 1)
    assert list(index.neighbours(0, np.ones(5, bool) & (np.arange(5) != 0))) == [2, 3]
    assert list(index.neighbours(4, np.ones(5, bool))) == []


def test_index_scores_all_tokens_as_brute_force():
    """Every tail of a block against every other one: the index gives the BM25 over all tokens, frequent and rare ones, so its ten best are the true ones."""
    draw = np.random.default_rng(5)
    tails = [np.append(np.minimum(draw.zipf(1.3, draw.integers(0, 60)) + 1, 399), 1) for _ in range(300)]
    sets = [set(t.tolist()) - {1} for t in tails]
    df = np.array([sum(t in s for s in sets) for t in range(400)])
    idf, average = np.log(1 + (len(tails) - df + 0.5) / (df + 0.5)), float(np.mean([len(t) for t in tails]))
    index = packing.Index(tails, idf, average, 1, strip=64)
    assert index.dense.shape[1] and len(index.post)
    for q in range(len(tails)):
        want = np.zeros(len(tails))
        for d, tail in enumerate(tails):
            for t in sets[q] & sets[d]:
                n = int((tail == t).sum())
                want[d] += idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tail) / average))
        assert np.allclose(index.scores(q), want, rtol=1e-5, atol=1e-5)
        if q % 20:
            continue
        used = packing.Index(tails, idf, average, 1, strip=64)
        for share in (0.9, 0.6, 0.3, 0.01):  # used tails leave the index; what is left has the same scores
            unused = np.arange(len(tails)) * 7 % 300 < share * 300
            best = list(used.neighbours(q, unused, 5))
            assert sorted(best) == np.flatnonzero((want > 0) & unused).tolist()
            assert np.all(np.diff(want[best]) <= 1e-5)
        assert len(used.members) < 10


def test_packing_of_odd_tables(spark):
    assert packing.pack_documents(cases.empty(spark)).count() == 0
    got = packing.pack_documents(cases.frame(spark, [(None, None), (3, ""), (3, "")])).collect()
    assert [(r["length"], r["doc_tokens"]) for r in got] == [(1, 1)] * 3 and sorted(r["offset"] for r in got) == [0, 1, 2]


def test_shards_are_exact_and_whole(spark):
    rows = [*cases.texts(), (None, None), (1, "x"), (1, "x")]
    got = sharding.shuffle_into_shards(cases.frame(spark, rows).withColumn("m", F.map_from_arrays(F.array("text"), F.array("doc_id")) if False else F.lit(1)), shards=7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert sharding.shuffle_into_shards(cases.empty(spark)).count() == 0


def test_communication_matrix_is_uniform():
    counts, capacities = np.array([6, 0, 3]), np.array([4, 5])
    draws = Counter()
    for seed in range(4000):
        m = sharding.communication_matrix(counts, capacities, seed)
        assert m.sum(1).tolist() == counts.tolist() and m.sum(0).tolist() == capacities.tolist()
        draws[int(m[0, 0])] += 1
    # P(k of the first six rows among four places of nine) is hypergeometric.
    from math import comb

    for k in range(1, 5):
        assert abs(draws[k] / 4000 - comb(4, k) * comb(5, 6 - k) / comb(9, 6)) < 0.03


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_rows_of_the_matrix_drawn_one_by_one(fan):
    """Rows that partitions draw alone fit together, and each number has the mean and the variance of a uniform shuffle."""
    counts, capacities = np.array([5, 0, 17, 40, 8, 30, 0]), np.array([34, 33, 33])
    ends, drawn = np.cumsum(counts), []
    for seed in range(1500):
        m = np.stack([sharding.partition_row(ends, capacities, seed, p, fan) for p in range(len(counts))])
        assert (m.sum(1) == counts).all() and (m.sum(0) == capacities).all() and (m >= 0).all()
        drawn.append(m)
    n = counts.sum()
    share = capacities[None] / n
    variance = counts[:, None] * share * (1 - share) * (n - counts[:, None]) / (n - 1)
    assert np.allclose(np.mean(drawn, 0), counts[:, None] * share, atol=0.4)
    assert np.allclose(np.var(drawn, 0), variance, rtol=0.2, atol=1e-9)
    assert (sharding.partition_row(np.array([100]), capacities, 1, 0) == capacities).all()
