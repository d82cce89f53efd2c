import os

import itertools
import random
import time

from querycorpus.operators import compare as C


def close(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return abs(a - b) <= C.ATOL + C.RTOL * abs(b)


def key(v):
    return (v is not None, isinstance(v, str), v if v is not None else 0)


def brute(pred, target, p_cols, t_cols, order_matters):
    """Verdict by trying every mapping of the narrower side."""
    if not pred and not target:
        return "equal"
    if len(pred) != len(target):
        return "different"
    if p_cols == t_cols and all(close(a, b) for p, t in zip(pred, target) for a, b in zip(p, t)):
        return "equal"

    def agree(pc, tc):
        p, t = [[r[c] for c in pc] for r in pred], [[r[c] for c in tc] for r in target]
        if not order_matters:
            p, t = sorted(p, key=lambda r: [key(v) for v in r]), sorted(t, key=lambda r: [key(v) for v in r])
        return all(close(a, b) for x, y in zip(p, t) for a, b in zip(x, y))

    n = min(p_cols, t_cols)
    for pc in itertools.permutations(range(p_cols), n):
        for tc in itertools.combinations(range(t_cols), n):
            if agree(pc, tc):
                return "equal" if p_cols == t_cols else "columns_superset" if p_cols > t_cols else "columns_subset"
    if any(agree([a], [b]) for a in range(p_cols) for b in range(t_cols)):
        return "columns_intersect"
    return "different"


def verdicts(spark, cases):
    cells, pairs = [], []
    for i, (pred, target, p_cols, t_cols, order) in enumerate(cases):
        pairs.append((i, order, len(pred), p_cols, len(target), t_cols))
        for side, rows in (("pred", pred), ("target", target)):
            for r, row in enumerate(rows):
                for c, v in enumerate(row):
                    text = isinstance(v, str)
                    cells.append((i, side, r, c, float(v) if v is not None and not text else None, v if text else None))
    df = spark.createDataFrame(cells, C.CELLS)
    shape = spark.createDataFrame(pairs, "pair_id long, order_matters boolean, pred_rows long, pred_cols int, target_rows long, target_cols int")
    return {r["pair_id"]: r["verdict"] for r in C.compare_results(df, shape).collect()}


def test_verdicts_match_brute_force(spark):
    rng = random.Random(5)
    cases = []
    for n in range(240):
        p_cols = rng.randint(1, 3)
        rows = rng.randint(0, 4)
        value = lambda: rng.choice([None, 1, 2, 3, "a", "b"])
        pred = [[value() for _ in range(p_cols)] for _ in range(rows)]
        target = [list(r) for r in pred]
        t_cols = p_cols
        if rng.random() < 0.4:
            order = rng.sample(range(p_cols), p_cols)
            target = [[r[c] for c in order] for r in target]
        if rng.random() < 0.5:
            rng.shuffle(target)
        if rng.random() < 0.3:
            target, t_cols = [r + [value()] for r in target], t_cols + 1
        elif rng.random() < 0.3 and t_cols > 1:
            target, t_cols = [r[1:] for r in target], t_cols - 1
        if rng.random() < 0.3 and target:
            target[0][0] = value()
        if rng.random() < 0.3:
            target = [[v * (1 + 1e-8) if isinstance(v, int) else v for v in r] for r in target]
        if rng.random() < 0.1 and target:
            target.pop()
        cases.append((pred, target, p_cols, t_cols, rng.random() < 0.3))
    got = verdicts(spark, cases)
    wrong = [(c, got[i], brute(*c)) for i, c in enumerate(cases) if got[i] != brute(*c)]
    assert not wrong, wrong[:3]
    assert len(set(got.values())) == 5


def test_twin_columns_and_empty_results(spark):
    cases = [
        ([[1, 1, 2], [3, 3, 4]], [[4, 3, 3], [2, 1, 1]], 3, 3, False),
        ([], [], 1, 4, True),
        ([[1, 2], [2, 1]], [[1, 1], [2, 2]], 2, 2, False),
        ([[1]], [[1.0000001]], 1, 1, True),
        ([[None, 5]], [[5, None]], 2, 2, False),
        ([["a"], ["a"], ["b"]], [["a"], ["b"], ["b"]], 1, 1, False),
    ]
    got = verdicts(spark, cases)
    assert [got[i] for i in range(6)] == ["equal", "equal", "columns_intersect", "equal", "equal", "different"]


def test_kept_results_hold_their_order(spark, tmp_path):
    """An ordered result of several files of different sizes comes back in its order, and equal ordered queries score equal."""
    store = C.ResultStore(str(tmp_path))
    sql = "SELECT id, repeat('x', CAST(id % 40 AS INT)) AS pad FROM range(3000000) ORDER BY id DESC"
    kept = store.get_or_run(spark, "d", sql, lambda: spark.sql(sql))
    files = [f for f in os.listdir(store.path("d", sql)) if f.startswith("part-")]
    assert len(files) > 1 and kept.columns == ["id", "pad"]
    assert [r["id"] for r in kept.limit(5).collect()] == list(range(2999999, 2999994, -1))
    placed = C.with_row_index(store.get_placed(spark, "d", sql), "at", store.ROW)
    assert placed.where("at + id <> 2999999").isEmpty()
    short = sql.replace("3000000", "300000")
    cells, runs = C.run_pairs(spark, [(1, "d", short, short), (2, "d", short.replace(" DESC", ""), short), (3, "d", "SELECT 1 AS a, 2 AS a", "SELECT 1, 2")], store)
    assert {r["pair_id"]: r["verdict"] for r in C.execution_scores(cells, runs).collect()} == {1: "equal", 2: "different", 3: "equal"}


def test_wide_results_of_equal_values_are_mapped_in_seconds(spark):
    """Twelve columns that all hold the same twelve values; columns and rows of one side are permuted, and once one row is changed."""
    rng = random.Random(12)
    n = 12
    columns = [rng.sample(range(n), n) for _ in range(n)]
    order, rows = rng.sample(range(n), n), rng.sample(range(n), n)
    cells, pairs = [], []
    for pair in (1, 2):
        for c in range(n):
            for r in range(n):
                cells.append((pair, "target", r, c, float(columns[c][r]), None))
                cells.append((pair, "pred", r, c, float(columns[order[c]][rows[r]]), None))
        pairs.append((pair, False, n, n, n, n))
    # Swap two values inside one column: every column stays a permutation, the rows do not agree any more.
    where = [i for i, x in enumerate(cells) if x[:2] == (2, "pred") and x[3] == 0][:2]
    a, b = where
    cells[a], cells[b] = (*cells[a][:4], cells[b][4], None), (*cells[b][:4], cells[a][4], None)
    kinds = "pair_id long, order_matters boolean, pred_rows long, pred_cols long, target_rows long, target_cols long"
    started = time.time()
    got = {r["pair_id"]: r["verdict"] for r in C.compare_results(spark.createDataFrame(cells, C.CELLS), spark.createDataFrame(pairs, kinds)).collect()}
    assert got == {1: "equal", 2: "columns_intersect"}
    assert time.time() - started < 60


def test_twelve_near_columns_a_side(spark):
    """All columns agree within the tolerance, in any order of columns: one mapping is tried, not 12!."""
    rng = random.Random(6)
    base = [rng.random() * 100 for _ in range(40)]
    wide = [[x + rng.uniform(-1e-7, 1e-7) for _ in range(12)] for x in base]
    shuffled = [[x + rng.uniform(-1e-7, 1e-7) for _ in range(12)] for x in base]
    rng.shuffle(shuffled)
    # Each column alone agrees, rows never do: no two columns keep their rows together.
    columns = [[x + rng.uniform(-1e-7, 1e-7) for x in rng.sample(base, len(base))] for _ in range(12)]
    torn = [list(r) for r in zip(*columns)]
    # Different columns whose rows are only moved and slightly changed: products leave the right mapping.
    own = [[rng.random() * 50 for _ in range(40)] for _ in range(3)]
    three = [list(r) for r in zip(*[[x + rng.uniform(-1e-8, 1e-8) for x in col] for col in own * 4])]
    moved = [[row[(j * 5) % 12] + rng.uniform(-1e-8, 1e-8) for j in range(12)] for row in three]
    rng.shuffle(moved)
    started = time.time()
    got = verdicts(spark, [(wide, shuffled, 12, 12, False), (torn, wide, 12, 12, False), (three, moved, 12, 12, False), (wide, torn, 12, 12, True)])
    assert got == {0: "equal", 1: "columns_intersect", 2: "equal", 3: "columns_intersect"} or got[3] == "different"
    assert got[0] == "equal" and got[1] == "columns_intersect" and got[2] == "equal"
    assert time.time() - started < 120


def test_matching_and_products():
    assert C._matching({1: {5, 6}, 2: {5}, 3: {6, 7}}) == {1: 6, 2: 5, 3: 7}
    assert C._matching({1: {5}, 2: {5}}) is None
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.uniform(-9, 9), rng.uniform(-900, 900)) for _ in range(rng.randrange(1, 30))]
        near = [tuple(x + rng.uniform(-1, 1) * (C.ATOL + C.RTOL * abs(x)) for x in r) for r in rows]
        stats = [(sum(a * b for a, b in t), sum(abs(a * b) for a, b in t), sum(abs(a) + abs(b) for a, b in t), len(t)) for t in (near, rows)]
        assert C._products_agree(stats[0], stats[1], stats[1], C.ATOL, C.RTOL)


def test_pairs_run_side_by_side(spark, tmp_path):
    """A hundred pairs of which many share a query: each distinct text runs once, errors stay with their pair."""
    from querycorpus.sources.sinks import ResultStore

    spark.range(30).selectExpr("id", "id % 7 AS k").createOrReplaceTempView("numbers")
    items = []
    for i in range(100):
        pred = None if i == 7 else "SELECT nope FROM numbers" if i == 9 else f"SELECT id, k FROM numbers WHERE k = {i % 5}"
        items.append((i, "d", pred, f"SELECT k, id FROM numbers WHERE k = {i % 4} ORDER BY id" if i % 3 else f"SELECT id, k FROM numbers WHERE k = {i % 5}"))
    store = ResultStore(str(tmp_path / "store"))
    cells, runs = C.run_pairs(spark, items, store)
    got = {r["pair_id"]: r for r in C.execution_scores(cells, runs).collect()}
    assert len(got) == 100 and got[7]["exec_error"] == "no prediction" and got[9]["exec_error"].startswith("pred: ")
    for i in range(100):
        if i not in (7, 9):
            same = i % 3 == 0 or i % 5 == i % 4
            assert (got[i]["verdict"] in ("equal", "columns_intersect")) if same else got[i]["verdict"] != "equal", i
            assert got[i]["exec"] == int(got[i]["verdict"] == "equal")
    assert len([p for p in (tmp_path / "store").iterdir() if not p.name.startswith("cells-")]) == 9
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("cells-")]) == 1
