import hashlib
import random
from collections import defaultdict

import cases
import pytest

from querycorpus.llm import exact_dedup, line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def normal(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def exact_brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append((-len(t or ""), i))
    return {i: (min(by[normal(t)])[1], len(by[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_duplicates_match_brute_force(spark, digest_bytes):
    """With digests of one byte nearly all chunks collide, and contents decide."""
    rows = [*cases.texts(), (2000, " ".join("same" for _ in range(3000))), (2001, "  ".join("same" for _ in range(3000)))]
    got = exact_dedup.exact_duplicates(cases.frame(spark, rows), digest_bytes=digest_bytes, smallest=16, average_bits=4, largest=256).collect()
    want = exact_brute(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got) and len(got) == len(rows)


def test_exact_duplicates_without_ids_and_rows(spark):
    rows = [(None, "a b"), (5, "ab"), (5, "ab"), (7, "a  b"), (None, None)]
    got = sorted(exact_dedup.exact_duplicates(cases.frame(spark, rows)).collect(), key=str)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [("5", "7", 4, False), ("5", "7", 4, False), ("7", "7", 4, True), ("None", "7", 4, False), ("None", "None", 1, True)]
    assert exact_dedup.exact_duplicates(cases.empty(spark)).count() == 0


def test_cuts_follow_the_content():
    data = random.Random(1).randbytes(40_000)
    one = set(exact_dedup.chunks_of(data, (64, 8, 4096)))
    two = set(exact_dedup.chunks_of(b"in front" + data, (64, 8, 4096)))
    assert b"".join(exact_dedup.chunks_of(data, (64, 8, 4096))) == data
    assert len(one & two) > 0.8 * len(one)


def lines_brute(rows):
    keys, owner = {}, {}
    for i, t in rows:
        keys[i] = [("".join(c.lower() if c in line_dedup.UPPER else c for c in line.strip(BLANKS)), line) for line in (t or "").split("\n")]
        for k, _ in keys[i]:
            owner[k] = min(i, owner.get(k, i))
    out = {}
    for i, lines in keys.items():
        kept = [line for k, line in lines if len(k) < 10 or owner[k] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (6, 2)])
def test_lines_match_brute_force(spark, batches, fanout):
    rows = [*cases.texts(), (3000, "  SOME repeated Line \nnew\nsome repeated line"), (2999, "x\nSome Repeated line\t"), (3001, "some repeated line\n")]
    got = line_dedup.dedup_lines(cases.frame(spark, rows), batches=batches, fanout=fanout).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == lines_brute(rows)
    assert all(r["shard"] == "x" for r in got)


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(4, "the very same line"), (4, "another long line\nthe very same line"), (None, "the very same line\nend"), (9, "another long line"), (2, None)]
    got = line_dedup.dedup_lines(cases.frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"], r["kept_text"]) for r in got) == [("2", 0, ""), ("4", 0, "another long line\nthe very same line"), ("4", 0, "the very same line"), ("9", 1, ""), ("None", 1, "end")]
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.range(b * 10, b * 10 + 15).selectExpr("id as h1", "id * 3 as h2", f"{b}L as doc_id"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["owner"]) for r in runs.seen().collect()} == {(i, min(i // 10, 4) if i < 50 and i % 10 >= 5 or i < 10 or i >= 50 else i // 10 - 1) for i in range(55)}
    runs.close()


def test_lines_use_no_python(spark):
    plan = line_dedup.dedup_lines(cases.frame(spark, cases.texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
