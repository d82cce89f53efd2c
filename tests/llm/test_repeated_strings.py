import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pytest

from querycorpus.llm import repeated_strings as rs


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        cover = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                cover[p : p + length] = 1
        kept = bytes(b for b, c in zip(t, cover) if not c)
        edges = np.diff(np.concatenate([[0], cover]))
        out.append((i, len(t), len(t) - len(kept), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return Counter(out)


def found(spark, rows, length, large=512):
    got = rs.without_repeated_strings(cases.frame(spark, rows), length=length, large=large).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got)


@pytest.mark.parametrize(("length", "large"), [(400, 512), (40, 512), (40, 1), (100, 2)])
def test_awkward_rows_match_brute_force(spark, length, large):
    rows = [r for r in cases.texts() if len(r[1] or "") < 20_000]
    assert found(spark, rows, length, large) == brute(rows, length)


@pytest.mark.parametrize(("length", "large", "seed"), [(8, 512, 1), (8, 1, 2), (25, 3, 3), (25, 512, 4), (70, 1, 5)])
def test_few_letters_match_brute_force(spark, length, large, seed):
    """Short alphabets, periods, tandem repeats, copies with single changed letters, passages at either end."""
    rng = random.Random(seed)
    passage = "".join(rng.choice("ab") for _ in range(length * 2))
    rows = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = "".join(rng.choice("ab") for _ in range(rng.randrange(length * 6)))
        elif kind == 1:
            text = "ab" * rng.randrange(length * 2) + "é"
        elif kind == 2:
            text = "".join(rng.choice("abcdefgh") for _ in range(length)) + passage + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(length)))
        elif kind == 3:
            text = passage[: rng.randrange(len(passage))] + str(i)
        elif kind == 4:
            text = str(i) + passage[rng.randrange(len(passage)) :]
        else:
            letters = list((rows[rng.randrange(len(rows))][1] or "x") + "q")
            letters[rng.randrange(len(letters))] = "Z"
            text = "".join(letters)
        rows.append((i, text))
    assert found(spark, rows, length, large) == brute(rows, length)


def test_repeated_rows_and_missing_ids(spark):
    text = cases.words(random.Random(9), 40)
    other = cases.words(random.Random(10), 40)
    rows = [(None, text), (None, text), (5, other), (5, other), (6, cases.words(random.Random(11), 40)), (None, None), (7, "")]
    assert found(spark, rows, 60) == brute(rows, 60)
    assert rs.without_repeated_strings(cases.empty(spark)).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh") for _ in range(5000))
    data = [(1, a.encode()), (2, (a[1000:3000] + "x" + a[100:400]).encode()), (3, b"ab" * 2000)]
    sizes = rs.Sizes(40)
    results = []
    for segment in (1 << 18, 300):
        monkeypatch.setattr(rs, "SEGMENT", segment)
        seen = []
        for group in rs._segments([t for _, t in data], sizes):
            number, begin, end, owned = (np.array(x) for x in zip(*group))
            joined = np.frombuffer(b"".join(data[i][1][s:e] for i, s, e, _ in group), np.uint8)
            last = np.cumsum(end - begin)
            first = last - (end - begin)
            part, anchor, low, high, names = rs.find_anchors(joined, first, last, sizes)
            core, whole = rs.run_names(names, sizes, anchor, first[part], last[part], np.zeros_like(anchor), sizes.width)
            shift = begin[part] - first[part]
            for row in zip(number[part], anchor + shift, low + shift, high + shift, core, whole, owned[part]):
                if row[6] <= row[1] < row[6] + segment:
                    seen.append(tuple(int(x) for x in row[:6]))
        results.append(sorted(seen))
        assert len(seen) == len({r[:2] for r in seen})
    assert results[0] == results[1]
