import random
import re
import textwrap
import zlib

import cases
import numpy as np
import pytest

from querycorpus.llm import licenses, quality, toxicity

INSULTS = ["grumblesnout", "mudwhistle", "sourboots"]


def marked_rows(n=600):
    """Clean prose, prose with insults at some density, and shouted junk."""
    rng, rows, marks = random.Random(9), [], []
    pool = [cases.words(rng, 1) for _ in range(400)]
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.randrange(20, 200))]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text[rng.randrange(len(text))] = rng.choice(INSULTS) + rng.choice(["", "y", "ing"])
        body = " ".join(text) + "."
        rows.append((i, body if good else body.upper().replace(" ", "!! ")))
        if i % 10 != 9:
            marks.append((i, int(good), int(toxic)))
    return rows, [*marks, (5_000_000, 1, 0), (3, None, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def marked(spark):
    rows, marks = marked_rows()
    odd = [r for r in cases.texts() if r[0] >= 1000] + [(None, rows[0][1]), (7, "repeated id")]
    return rows, odd, cases.frame(spark, rows + odd), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def rest(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_quality_on_held_out_rows(marked):
    rows, odd, docs, marks = marked
    got = quality.score_quality(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or rest(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 1) for r in held]) > 0.97
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_toxicity_on_held_out_rows(marked):
    rows, odd, docs, marks = marked
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or rest(r["doc_id"], 5) == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and 10 < r["doc_id"] < 600 and r["doc_id"] % 4 != 1]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    caught = next(r for r in held if r["doc_id"] % 5 == 0)
    assert caught["neighbours"] and {n["toxic"] for n in caught["neighbours"]} == {1}
    similar = [n["similarity"] for n in caught["neighbours"]]
    assert similar == sorted(similar, reverse=True)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_scores_without_labels_or_rows(spark, marked, label):
    score = quality.score_quality if label == "quality" else toxicity.score_toxicity
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(marked[2], none).collect()} == {1.0 if label == "quality" else 0.0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in score(marked[2], one).collect()} == {1 if label == "quality" else 0}
    assert score(cases.empty(spark), marked[3]).count() == 0


def test_model_is_its_tables():
    """Scores are sums of table entries, and an interaction alone is learnt by a pair."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.97
    row = x[5]
    by_hand = model.intercept + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
    by_hand += model.pair_tables[0][np.searchsorted(model.coarse[0], row[0], side="right"), np.searchsorted(model.coarse[1], row[1], side="right")]
    assert abs(by_hand - model.logits(x[5:6])[0]) < 1e-9


def test_features_of_odd_texts():
    assert not quality.features(None).any() and not quality.features("").any()
    for _, text in cases.texts():
        assert np.isfinite(quality.features(text)).all()


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    width, examples = 40, []
    for _ in range(500):
        terms = np.append(np.sort(rng.choice(width, rng.integers(0, 6), replace=False)), width)
        weights = rng.random(len(terms)) + 0.01
        examples.append((terms, weights / np.sqrt((weights**2).sum())))
    examples.append((np.zeros(0, np.int64), np.zeros(0)))
    index = toxicity.BlockMaxIndex(examples, width + 1, block=8)
    dense = np.zeros((len(examples), width + 1))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    for i in range(200):
        terms, weights = examples[i]
        near, similarity = index.nearest(terms, weights, 7)
        want = dense @ dense[i]
        assert np.allclose(similarity, np.sort(want)[::-1][:7]) and np.allclose(want[near], similarity)
    assert index.opened < 200 * index.blocks * 0.9
    assert not len(index.nearest(np.zeros(0, np.int64), np.zeros(0), 3)[0])


def dice_brute(rows, percent=80):
    sets = {n: set(licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES.items()}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        for place, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), unit)).split()
            own = set(zip(words, words[1:], strict=False))
            own = {f"{a} {b}" for a, b in own}
            for name, template in sets.items():
                if own and 200 * len(own & template) >= percent * (len(own) + len(template)):
                    best, n, first = out.get((i, name), (0, 0, place))
                    out[i, name] = (max(best, 2 * len(own & template) / (len(own) + len(template))), n + 1, min(first, place))
    return out


def test_licenses_match_brute_force(spark):
    notes = list(licenses.TEMPLATES.values())
    rows = [*cases.texts(), *((5000 + i, "Intro line.\n" + t.upper() + "\nEnd") for i, t in enumerate(notes))]
    rows += [(6000, notes[1].replace(", ", ",\n")), (6001, "Licensed under the MIT License"), (6002, "all RIGHTS reserved all rights reserved"), (6003, notes[3] + "\n" + notes[2])]
    got = {(r["doc_id"], r["license"]): (r["similarity"], r["n_units"], r["first_place"]) for r in licenses.scan_licenses(cases.frame(spark, rows)).collect()}
    want = dice_brute(rows)
    assert got == want and {n for _, n in got} == set(licenses.TEMPLATES)
    assert licenses.scan_licenses(cases.empty(spark)).count() == 0
    plan = licenses.scan_licenses(cases.frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="two words"):
        licenses.scan_licenses(cases.frame(spark, rows), {"x": "one"})


WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def test_licenses_within_lines_and_across_them(spark):
    wrapped = textwrap.fill(licenses.TEMPLATES["mit-grant"], 78)
    mit = f"MIT License\n\nCopyright (c) 2020 Example Inc.\n\n{wrapped}\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n" + textwrap.fill(WARRANTY, 78)
    prose = "We hope that the reader of this page finds the way to the river and back. " * 20
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Example Inc. All rights reserved."), (3, prose + "This project is Released under the MIT License. " + prose),
        (4, prose + textwrap.fill(licenses.TEMPLATES["apache-2.0-header"], 30) + "\n" + prose), (5, prose), (6, "Released under the MIT License.\n" + prose + "released under the\nMIT license"),
        (7, prose + "All rights reserved. " + prose + "\nAll rights\nreserved.\n"), (8, "x.\n" + licenses.TEMPLATES["gpl-3.0-header"] + " All rights reserved.\n" + prose),
    ]
    got = {(r["doc_id"], r["license"]): (round(r["similarity"], 6), r["n_units"], r["first_place"]) for r in licenses.scan_licenses(cases.frame(spark, rows)).collect()}
    assert got.pop((8, "gpl-3.0-header"))[1:] == (1, 1) and got.pop((8, "lgpl-2.1-header"))[1:] == (1, 1)
    assert got == {
        (1, "mit-grant"): (1.0, 1, 4), (2, "all-rights-reserved"): (1.0, 1, 0), (3, "mit-notice"): (1.0, 1, 0), (4, "apache-2.0-header"): (1.0, 1, 0),
        (6, "mit-notice"): (1.0, 2, 0), (7, "all-rights-reserved"): (1.0, 2, 0), (8, "all-rights-reserved"): (1.0, 1, 1),
    }


def test_calibration_stays_finite():
    """Votes that are all alike give the base rate; votes that part the classes give scores on their sides."""
    for share in (0.168, 0.02, 0.5):
        y = (np.arange(1000) < 1000 * share).astype(float)
        line = toxicity._fit_line(np.full(1000, -2.2), y)
        score = 1 / (1 + np.exp(-(line[0] + line[1] * -2.2)))
        assert abs(score - share) < 0.01 and np.abs(line).max() < 20
    z, y = np.r_[np.full(900, -3.0), np.full(100, 2.0)], np.r_[np.zeros(900), np.ones(100)]
    line = toxicity._fit_line(z, y)
    scores = 1 / (1 + np.exp(-(line[0] + line[1] * z)))
    assert scores[0] < 0.05 and scores[-1] > 0.9 and abs(scores.mean() - 0.1) < 0.01
    rng = np.random.default_rng(3)
    z = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.5 * z)))).astype(float)
    line = toxicity._fit_line(z, y)
    assert abs(line[0] - 0.5) < 0.2 and abs(line[1] - 1.5) < 0.3


def test_few_toxic_labels_give_the_base_rate(spark):
    """No word tells the five toxic texts from the rest: every score is about their share."""
    rows = [(i, f"common words here {'abcdefghij'[i % 10]}") for i in range(100)]
    marks = [(i, 1, int(i % 20 == 1)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()]
    assert len(scores) == 100 and all(0.01 < s < 0.12 for s in scores)
