import hashlib
import math
import random
import re
import zlib
from collections import Counter

import cases
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querycorpus.llm import fill_in_middle as fim
from querycorpus.llm import importance_resampling as dsir


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle_brute(doc_id, text, rate=90, spm=20):
    text = text or ""
    digest = sha(f"1:{'null' if doc_id is None else doc_id}")
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (len(text), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (len(text), "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (len(text), "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


@pytest.mark.parametrize(("rate", "spm"), [(90, 20), (100, 100), (100, 0), (0, 0)])
def test_outputs_match_brute_force(spark, rate, spm):
    rows = [*cases.texts(), (None, "no id at all"), (7, "again"), (7, "again"), (8, "x <P> y"), (9, "<S"), (10, "<P<<S"), (11, ">M>S><")]
    got = fim.fill_in_middle(cases.frame(spark, rows), rate=rate, spm=spm).collect()
    want = Counter((i, *middle_brute(i, t, rate, spm), sha(t or "")) for i, t in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored_sha256"]) for r in got) == want
    assert all(r["output_sha256"] == sha(r["output"]) for r in got)


def test_descriptors_stand_for_the_output(spark):
    rows = cases.texts()
    texts = dict(rows)
    for r in fim.fill_in_middle(cases.frame(spark, rows)).collect():
        buffers = (texts[r["doc_id"]] or "", "<P><S><M>")
        assert "".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]) == r["output"]
        assert len(r["pieces"]) <= 6
    assert all(r["output"] is None for r in fim.fill_in_middle(cases.frame(spark, rows), outputs=False).collect())


def test_no_rows_and_bad_sentinels(spark):
    assert fim.fill_in_middle(cases.empty(spark)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P>", "<P>x", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(cases.empty(spark), marks=marks)


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>aé漢\n"), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_any_arrangement_is_undone(text, seed, form):
    if any(m in text for m in fim.SENTINELS):
        return
    rng = random.Random(seed)
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2))
    whole = [(fim.TEXT, 0, len(text))]
    pieces = fim.arranged(fim.split(whole, cuts), fim.FORMS[form], fim.SENTINELS)
    output = fim.rendered(pieces, (text, "<P><S><M>"))
    back = fim.restored(output, fim.FORMS[form], fim.SENTINELS)
    assert fim.rendered(back, (output, "")) == text and fim.streamed(back, (output, "")) == sha(text)
    assert fim.streamed(pieces, (text, "<P><S><M>")) == sha(output)


def test_split_keeps_every_offset():
    pieces = [(0, 5, 3), (1, 0, 2), (0, 0, 5)]
    for a in range(11):
        for b in range(a, 11):
            parts = fim.split(pieces, [a, b])
            assert len(parts) == 3
            spelled = [[(buffer, start + i) for buffer, start, n in part for i in range(n)] for part in parts]
            assert sum(spelled, []) == [(buffer, start + i) for buffer, start, n in pieces for i in range(n)]
            assert [len(s) for s in spelled] == [a, b - a, 10 - b]


def resampled_brute(rows, target, n, buckets, percent, least):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s = Counter(b for _, t in rows for b in found(t))
    t = Counter(b for x in target for b in found(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out, drawn = [], []
    for i, text in rows:
        h = int(sha(f"2024:{'null' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in found(text))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found(text)), weight, score, None])
        if len(words(text)) >= least:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("n", "percent", "finish"), [(1, 10, 1), (1, 50, 3), (2, 33, 1), (3, 100, 2), (1, 0, 1)])
def test_draws_match_brute_force(spark, n, percent, finish):
    rows = [*cases.texts(n=90), (None, cases.words(random.Random(1), 30))]
    target = [cases.words(random.Random(i), 40) for i in range(6)] + [None, ""]
    got = dsir.resampled(cases.frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n=n, percent=percent, finish=finish, buckets=500, least_words=8)
    assert Counter(map(tuple, got.collect())) == resampled_brute(rows, target, n, 500, percent, 8)


def test_cutoff_is_exact_with_ties(spark):
    """One score holds most rows; the second and third number decide."""
    rng = random.Random(2)
    keys = [(5 if rng.random() < 0.8 else rng.randrange(10), rng.randrange(-3, 3), i) for i in range(400)]
    frame = spark.createDataFrame(keys, "k1 long, k2 long, k3 long").repartition(7)
    order = sorted(keys, reverse=True)
    for wanted in (1, 2, 57, 200, 399, 400):
        assert tuple(dsir.cutoff_key(frame, wanted, 400, finish=1)) == order[wanted - 1]
    assert dsir.cutoff_key(frame, 0, 400) is None


def test_repeated_ids_are_drawn_once_each(spark):
    text = " ".join("word" for _ in range(25))
    got = dsir.resampled(cases.frame(spark, [(3, text)] * 10 + [(None, text)] * 10), spark.createDataFrame([("word",)], "text string"), percent=30, finish=1)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == [1, 2, 3, 4, 5, 6]
    nothing = spark.createDataFrame([], "text string")
    assert dsir.resampled(cases.empty(spark), nothing).count() == 0
    assert {r["weight"] for r in dsir.resampled(cases.frame(spark, [(1, "")]), nothing).collect()} == {0}
