import random

import cases
import numpy as np
import pytest

from querycorpus.llm import embedding_dedup, minhash_dedup
from querycorpus.llm.components import components


def linked_texts(rows, k, percent):
    sets = {i: cases.shingles(t, k) for i, t in rows}
    found = cases.groups(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    return {i: (len(sets[i]), found[i]) for i in sets}


def family(seed, n, length, most):
    """Copies of a text with up to ``most`` changed words: many are linked with the source, some only with each other."""
    rng = random.Random(seed)
    base = [cases.words(rng, 1) for _ in range(length)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(most)):
            text[rng.randrange(length)] = cases.words(rng, 1)
        rows.append((50_000 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "percent", "settings"), [(5, 80, {}), (3, 85, {"block_shingles": 500})])
def test_texts_match_brute_force(spark, k, percent, settings):
    rows = [*cases.texts(n=40), *family(1, 50, 120, 9), (60_000, "short one"), (60_001, "Short  ONE"), (60_002, "short")]
    got = minhash_dedup.near_duplicates(cases.frame(spark, rows), words=k, percent=percent, **settings).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_texts(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_that_a_star_misses_are_found(spark):
    """A chain: each text shares most words with the next only, and all share band keys of few bins."""
    rng = random.Random(4)
    stream = [cases.words(rng, 1) for _ in range(400)]
    rows = [(i, " ".join(stream[4 * i : 4 * i + 60])) for i in range(60)]
    got = minhash_dedup.near_duplicates(cases.frame(spark, rows), words=2, percent=75, bins=64, block_shingles=300).collect()
    assert {r["component_id"] for r in got} == {0} == {c for _, c in linked_texts(rows, 2, 75).values()}


def test_texts_of_repeated_and_missing_ids(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(7, a), (7, b), (9, a), (8, b), (None, a), (None, None), (3, None), (3, None)]
    got = minhash_dedup.near_duplicates(cases.frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("3", "3", True), ("3", "3", True), ("7", "7", True), ("7", "7", True), ("8", "7", False), ("9", "7", False), ("None", "None", True), ("None", "None", True)
    ]
    assert minhash_dedup.near_duplicates(cases.empty(spark)).count() == 0


def test_densified_bins_collide_as_often_as_the_sets_overlap():
    sketcher, rng = minhash_dedup.Sketcher(1, 256, 1), np.random.default_rng(3)
    for size, shared in ((10, 8), (60, 45), (2000, 1600)):
        rates = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 2 * size - shared).astype(np.uint64)
            one, two = np.unique(both[:size]), np.unique(both[size - shared :])
            rates.append((sketcher.signature(one) == sketcher.signature(two)).mean())
        assert abs(np.mean(rates) - shared / (2 * size - shared)) < 0.04


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_vectors_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((n, (base + rng.normal(size=16) * 0.06).astype(np.float32).tolist(), label))
                n += 1
        rows.append((n, rows[-1][1], label))
        rows.append((n + 1, [2 * x for x in rows[-1][1]], label))
        n += 2
    usable = list(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 4]
    rows += [(n + i, x, 1) for i, x in enumerate(odd)] + [(n + 20, usable[0][1], None)]
    df = cases.frame(spark, rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, block_rows=block_rows).collect()}
    x, y = np.array([r[1] for r in usable], np.float64), np.array([r[2] for r in usable])
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T / np.outer(size, size) >= 0.98) & (y[:, None] == y[None])
    np.fill_diagonal(near, False)
    want = cases.groups([r[0] for r in usable], lambda a, b: near[a, b])
    assert near.sum() > 100 and len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert found <= near.sum() and found >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in want)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.98 * len(want)
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["kept"] for r in rows[len(usable) :])


def test_vectors_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(cases.empty(spark, kind)).count() == 0
    got = embedding_dedup.near_vectors(cases.frame(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (4, [2.0, 4.0], 0)], kind)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("1", 2, "1", True), ("1", 2, "1", True), ("4", 2, "1", False), ("None", 0, "None", True)]


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_vectors_of_every_length_in_doubles(spark, block_rows):
    """Lengths are linked each by itself; doubles keep what floats lose, at the threshold and beyond their range."""
    rng, vectors = np.random.default_rng(3), []
    for d in (3, 3, 8, 20):
        for _ in range(8):
            base = rng.normal(size=d)
            vectors += [base + rng.normal(size=d) * 0.01 for _ in range(3)]
    vectors += [np.ones(5)] * 5
    angle = np.arccos(0.98)
    turns = (1, 1 - 1e-12, 1 + 1e-9)
    vectors += [np.array([1.0, 0.0])] + [np.array([np.cos(angle * t), np.sin(angle * t)]) for t in turns]
    vectors += [1e200 * np.ones(4), 1e-200 * np.ones(4)]
    df = cases.frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, block_rows=block_rows).collect()}

    def near(i, j):
        a, b = (v / np.abs(v).max() for v in (vectors[i], vectors[j]))
        return i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98

    n = len(vectors)
    links = [sum(near(i, j) for j in range(n)) for i in range(n)]
    want = cases.groups(list(range(n)), near)
    found = [got[i]["n_links"] for i in range(n)]
    assert all(f <= w for f, w in zip(found, links, strict=True)) and sum(found) >= 0.98 * sum(links)
    assert sum(got[i]["component_id"] == want[i] for i in range(n)) >= 0.98 * n
    assert found[96:101] == [4] * 5 and found[-2:] == [1, 1] and not near(101, 104) and near(101, 103)


@pytest.mark.parametrize("common", [0.0, 0.5, 0.9])
def test_vectors_with_a_common_direction(spark, common):
    """Pairs at the threshold are found whatever the mean: sqrt(common) is its length."""
    rng, d, n = np.random.default_rng(12), 64, 1500
    mean = rng.normal(size=d)
    mean *= np.sqrt(common) / np.linalg.norm(mean)
    own = rng.normal(size=(n, d))
    one = mean + np.sqrt(1 - common) * own / np.linalg.norm(own, axis=1, keepdims=True)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rng.normal(size=(n, d))
    other -= (other * one).sum(1, keepdims=True) * one
    cosine = 0.98001
    two = cosine * one + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    x = np.vstack([one, two]).astype(np.float32).astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.outer(size, size) >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() >= 2 * n * 0.99
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = sum(r["n_links"] for r in embedding_dedup.near_vectors(df).collect())
    assert 0.994 * near.sum() <= found <= near.sum()


def test_blocks_are_bounded_by_texts(spark, monkeypatch):
    """A family of short texts fills few shingles, but many rows of the comparison."""
    rng = random.Random(6)
    stream = [cases.words(rng, 1) for _ in range(700)]
    rows = [(i, " ".join(stream[2 * i : 2 * i + 20])) for i in range(300)]
    sizes = []
    whole = minhash_dedup._compared

    def watched(percent):
        run = whole(percent)

        def checked(batches):
            def passed():
                for batch in batches:
                    places = list(zip(*(batch[c].to_pylist() for c in ("family", "i", "j")), strict=True))
                    assert max((places.count(p) for p in set(places)), default=0) <= 120
                    yield batch

            yield from run(passed())

        sizes.append(percent)
        return checked

    monkeypatch.setattr(minhash_dedup, "_compared", watched)
    got = minhash_dedup.near_duplicates(cases.frame(spark, rows), words=2, percent=75, bins=64, block_texts=32).collect()
    assert sizes == [75] and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_texts(rows, 2, 75)
