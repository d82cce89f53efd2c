import random
import re

import pytest

from querycorpus.operators import gramindex as G
from querycorpus.operators import linking as K
from querycorpus.operators import sqltext as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    return row[-1]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b, measure):
    return 1 - lev(a, b) / max(len(a), len(b)) if measure == "levenshtein" else 2 * lcs(a, b) / (len(a) + len(b))


def changed(rng, text, rate, letters):
    return "".join(rng.choice([c + rng.choice(letters), "", rng.choice(letters)]) if rng.random() < rate else c for c in text)


@pytest.mark.parametrize(("measure", "theta", "same_first"), [("indel", 0.85, True), ("indel", 0.6, False), ("levenshtein", 0.85, False), ("levenshtein", 0.3, False), ("indel", 1.0, True)])
def test_similarity_join_equals_brute_force(spark, measure, theta, same_first):
    """Lengths of 1 to 80 letters, few letters, changes at any place; columns that both sides must share."""
    rng = random.Random(int(theta * 100))
    values = {(rng.choice("xy"), "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 80])))) for _ in range(160)}
    spans = {(d, changed(rng, v, rng.choice([0, 0.05, 0.15, 0.3]), "abcdé")) for d, v in sorted(values)}
    spans |= {(d, v[: rng.randrange(1, len(v) + 1)]) for d, v in sorted(values)}
    got = K.similar_pairs(
        spark.createDataFrame(sorted(spans), "db string, span string"), spark.createDataFrame(sorted(values), "db string, norm string"), theta, measure, same_first, ["db"]
    )
    want = {
        (d, s, v) for d, s in spans for e, v in values
        if d == e and s and (not same_first or s[0] == v[0]) and similarity(s, v, measure) >= theta - 1e-9
    }
    assert {(r["db"], r["span"], r["norm"]) for r in got.collect()} == want and len(want) > 40


@pytest.mark.parametrize("measure", ["levenshtein", "indel"])
def test_question_links_equal_brute_force(spark, measure):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    values = sorted({" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 6, 12, 20]))) for _ in range(70)})
    questions = []
    for i in range(25):
        parts = [rng.choice(words) for _ in range(rng.randrange(6))] + [changed(rng, rng.choice(values), rng.choice([0, 0.04, 0.1]), "abcdefgh ")]
        questions.append((i, " ".join([*parts, *(rng.choice(words) for _ in range(rng.randrange(5)))]).upper() + "?"))
    questions += [(100, None), (101, ""), (102, "?!"), (103, "abc")]
    got = K.value_matches(
        spark.createDataFrame(questions, "question_id long, question string"),
        spark.createDataFrame([("t", "c", v) for v in [*values, None, "", "12"]], "table_name string, column string, value string"), measure=measure,
    )

    def linkable(x):
        return len(x) > 1 and not re.search(K.NUMBER, x) and x not in K.STOP_WORDS and x not in K.COMMON_NAMES

    want = {}
    for i, q in questions:
        w = [x for x in re.split(K.SEPARATORS, (q or "").lower()) if x]
        for span in {" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}:
            for v in values:
                if linkable(span) and linkable(v) and span[0] == v[0]:
                    score = similarity(span, v, measure)
                    if score >= 0.85 - 1e-9:
                        want[i, v] = max(want.get((i, v), (0, 0)), (round(score, 9), len(span)))
    assert {(r["question_id"], r["value"]): (round(r["score"], 9), r["size"]) for r in got.collect()} == want and len(want) > 25


@pytest.mark.parametrize("measure", ["levenshtein", "indel"])
def test_values_with_separators_are_linked(spark, measure):
    """A value links where it stands word for word, whatever separates its words; its first letter is sought after separators."""
    values = ["p.o. box", "(new) bolt & nut", "st. ives", "o'neil street", "U.S.-A", "hot  ring", "hot ring", "'n' or (m), again", "cold bolt"]
    questions = ["Is the P.O. box full?", "a (NEW) bolt & nut, or none", "in St. Ives.", "o'neil street!", "the U.S.-A is", "one hot  ring", "hot ring's price", "say 'n' or (m), again",
                 "it. (old bolt).", "", None, "...", "hot, ring"]
    got = K.value_matches(
        spark.createDataFrame([*enumerate(questions)], "question_id long, question string"), spark.createDataFrame([("t", "c", v) for v in values], "table_name string, column string, value string"), measure=measure,
    )

    def first(x):
        return re.sub(f"^{K.SEPARATORS}", "", x)[0]

    want = {}
    for i, q in enumerate(questions):
        q = re.sub(" +", " ", q or "")
        words = [(m.start(), m.end()) for m in re.finditer(r"""[^'"()`,.?! ]+""", q.lower())]
        for a, b in ((a, b) for a in range(len(words)) for b in range(a, len(words))):
            for span in {q.lower()[words[a][0] : words[b][1]], " ".join(q.lower()[x:y] for x, y in words[a : b + 1])}:
                for v in values:
                    score = similarity(span, v.lower(), measure)
                    if len(span) > 1 and first(v.lower()) == span[0] and score >= (1 if v.isupper() else 0.85) - 1e-9:
                        want[i, v] = max(want.get((i, v), (0, 0)), (round(score, 9), len(span)))
    assert {(r["question_id"], r["value"]): (round(r["score"], 9), r["size"]) for r in got.collect()} == want
    assert {(i, v) for i, v in enumerate(values[:7])} <= want.keys() and (7, values[7]) in want and want[0, "p.o. box"] == (1, 8) and (8, "cold bolt") not in want


def test_nothing_to_index(spark):
    values = spark.createDataFrame([("t", "c", None)], "table_name string, column string, value string")
    assert K.value_matches(spark.createDataFrame([(1, "some words")], "question_id long, question string"), values).count() == 0
    with pytest.raises(ValueError):
        G.gram_index(spark.createDataFrame([("a",)], "norm string"), 0, "indel")


def test_keys_grow_with_letters_only(spark):
    """A value of 20 words has no more index rows than letters, and a question brings its grams once per class."""
    value = " ".join(f"word{i}" for i in range(20))
    index = G.gram_index(spark.createDataFrame([(value,)], "norm string"), 0.85, "indel")
    assert index.rows.count() < len(value)
    probes = index.tails(spark.createDataFrame([(value + " and so on",)], "text string"))
    assert probes.count() == 1 and index.candidates(probes).count() == 1


def test_far_names_go_on_to_a_larger_radius(spark):
    known = [("d", "column", n) for n in ["customer_key", "order_date", "q", "zz"]] + [("e", "column", "bbb"), ("e", "column", "ccc")]
    names = [("d", "column", n) for n in ["custmer_key", "odate", "zx", "order", "77"]] + [("e", "column", "xyz")]
    got = L._most_similar(
        spark.createDataFrame(names, "db_id string, kind string, name string").selectExpr("*", "lower(name) AS span"),
        spark.createDataFrame(known, "db_id string, kind string, known string").selectExpr("*", "lower(known) AS norm"), ["db_id", "kind"],
    ).collect()
    for db, _, name in names:
        scores = sorted((-similarity(name, k, "levenshtein"), k) for d, _, k in known if d == db)
        mine = sorted((-r["score"], r["known"]) for r in got if r["name"] == name and r["db_id"] == db)
        assert (round(mine[0][0], 9), mine[0][1]) == (round(scores[0][0], 9), scores[0][1])
