"""Compare the results of predicted and target queries, many pairs in one job.

A result is a set of cells ``(pair_id, side, row_idx, col_idx, num, str)`` with side ``pred``
or ``target``: numbers of any type in ``num``, everything else as text in ``str``, null in
neither. ``pairs`` holds one row per pair: ``pair_id, order_matters, pred_rows, pred_cols,
target_rows, target_cols``.

Verdicts: ``equal``, ``columns_superset`` / ``columns_subset`` (every column of the narrower
result stands in the wider one), ``columns_intersect`` (some columns agree), ``different``.

No step holds a result in one task. Exact agreement is decided by hash sums that combine on the
map side; only columns that agree up to the tolerance are ranked, by range partitioning.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from querycorpus.functions.scale import by_shuffle, cut_lineage, dealt_join, global_position
from querycorpus.sources.sinks import ResultStore

# Absolute and relative tolerance of the comparison.
ATOL = 1e-5
RTOL = 1e-5

#: Results whose cells are written together.
CELL_GROUP = 16
CELLS = "pair_id long, side string, row_idx long, col_idx int, num double, str string"


def with_row_index(df: DataFrame, name: str = "row_idx", place: str | None = None) -> DataFrame:
    """Number rows from 0 with one count per partition and no sort: in their present order, or in that of ``place``, a column
    of ``monotonically_increasing_id`` that was stored with the rows."""
    marked = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id())) if place is None else df.withColumnRenamed(place, "_m")
    part = F.shiftright("_m", 33)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so this window is as long as the input has partitions.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.col("_m") - F.shiftleft(F.shiftright("_m", 33), 33)
    joined = marked.withColumn("_p", part).join(shift, "_p")
    return joined.withColumn(name, (inside + F.col("_shift")).cast("long")).drop("_m", "_p", "_shift")


def result_cells(df: DataFrame, pair_id: int, side: str, place: str | None = None) -> DataFrame:
    """A query result as cells; every cell is null, a number or a text. ``place`` names the column that holds the row order, if it was stored."""
    fields = [f for f in df.schema if f.name != place]
    names = [*[f"c{i}" for i in range(len(fields))], *([place] if place else [])]
    indexed = with_row_index(df.toDF(*names), "_row", place)
    cells = []
    for i, field in enumerate(fields):
        c = F.col(f"c{i}")
        numeric = isinstance(field.dataType, NumericType)
        number = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if numeric else c.cast("string")
        cells.append(F.struct(F.lit(i).alias("col_idx"), number.alias("num"), text.alias("str")))
    return indexed.select("_row", F.explode(F.array(*cells)).alias("_c")).select(
        F.lit(pair_id).cast("long").alias("pair_id"),
        F.lit(side).alias("side"),
        F.col("_row").alias("row_idx"),
        "_c.col_idx",
        "_c.num",
        "_c.str",
    )


def close(a: Column, b: Column, atol: float = ATOL, rtol: float = RTOL) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def same_cell(p: Column, t: Column, atol: float, rtol: float) -> Column:
    """Null-safe equality of two ``struct<num, str>`` cells within the tolerance."""
    numbers = p["num"].isNotNull() & t["num"].isNotNull()
    return F.when(numbers, close(p["num"], t["num"], atol, rtol)).otherwise(
        p["num"].eqNullSafe(t["num"]) & p["str"].eqNullSafe(t["str"])
    )


def _hash_sum(*parts: Column) -> Column:
    """Order-free fingerprint of rows: sums of 24-bit slices of two hashes, 96 bits in all.

    Long sums combine on the map side and cannot overflow below 2**39 rows.
    """
    mask, sums = F.lit((1 << 24) - 1).cast("long"), []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *parts)
        sums += [F.sum(h.bitwiseAND(mask)), F.sum(F.shiftright(h, 24).bitwiseAND(mask))]
    return F.concat_ws("/", *[x.cast("string") for x in sums])


def _positionally_equal(cells: DataFrame, pairs: DataFrame, candidates: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Pairs of one width whose cells agree at every place.

    Columns that agree exactly are known by their fingerprints; only number columns that may agree
    within the tolerance are compared cell by cell.
    """
    same_place = candidates.where("pc = tc")
    diagonal = same_place.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and("placed").alias("_all"),
        F.bool_and(F.col("placed") | (F.col("n_num") > 0)).alias("_near"),
    )
    shaped = pairs.where("pred_cols = target_cols").join(diagonal, "pair_id").where("_n = pred_cols")
    sure = shaped.where("_all").select("pair_id")
    maybe = shaped.where("_near AND NOT _all").select("pair_id")
    columns = same_place.where("NOT placed").join(maybe, "pair_id", "left_semi").select("pair_id", F.col("pc").alias("col_idx"))
    if columns.isEmpty():
        return sure
    mine = cells.join(columns, ["pair_id", "col_idx"], "left_semi")
    spot = ["pair_id", "row_idx", "col_idx"]
    p = mine.where("side = 'pred'").select(*spot, F.struct("num", "str").alias("p"))
    t = mine.where("side = 'target'").select(*spot, F.struct("num", "str").alias("t"))
    ok = F.coalesce(same_cell(F.col("p"), F.col("t"), atol, rtol), F.lit(False)) & F.col("t").isNotNull()
    near = p.join(by_shuffle(t), spot, "left").groupBy("pair_id").agg(F.bool_and(ok).alias("_ok")).where("_ok")
    return sure.unionByName(near.select("pair_id"))


def column_summaries(cells: DataFrame) -> DataFrame:
    """Per column: counts, extremes, sums and two fingerprints (with and without row order)."""
    return cells.groupBy("pair_id", "side", "col_idx").agg(
        F.count("num").alias("n_num"),
        F.count("str").alias("n_str"),
        F.min("num").alias("min_num"),
        F.max("num").alias("max_num"),
        F.coalesce(F.sum("num"), F.lit(0.0)).alias("sum_num"),
        F.coalesce(F.sum(F.abs("num")), F.lit(0.0)).alias("abs_num"),
        _hash_sum(F.col("str")).alias("str_hash"),
        _hash_sum(F.col("num"), F.col("str")).alias("free_hash"),
        _hash_sum(F.col("row_idx"), F.col("num"), F.col("str")).alias("placed_hash"),
    )


def _candidates(summaries: DataFrame, pairs: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Column pairs whose summaries allow agreement. Every true pair passes this test."""
    keys = ["pair_id", "n_num", "n_str", "str_hash"]
    rest = ["col_idx", "min_num", "max_num", "sum_num", "abs_num", "free_hash", "placed_hash"]
    p = summaries.where("side = 'pred'").select(*keys, *[F.col(c).alias(f"p_{c}") for c in rest])
    t = summaries.where("side = 'target'").select(*keys, *[F.col(c).alias(f"t_{c}") for c in rest])
    room = F.col("n_num") * atol + rtol * F.col("t_abs_num") + 1e-9 * (F.col("t_abs_num") + F.col("p_abs_num"))
    fits = (
        close(F.col("p_min_num"), F.col("t_min_num"), atol, rtol)
        & close(F.col("p_max_num"), F.col("t_max_num"), atol, rtol)
        & (F.abs(F.col("p_sum_num") - F.col("t_sum_num")) <= room)
    )
    joined = p.join(t, keys).join(pairs.select("pair_id", "order_matters"), "pair_id")
    exact = F.when(F.col("order_matters"), F.col("p_placed_hash") == F.col("t_placed_hash")).otherwise(
        F.col("p_free_hash") == F.col("t_free_hash")
    )
    return joined.where((F.col("n_num") == 0) | fits).select(
        "pair_id",
        "order_matters",
        "n_num",
        F.col("p_col_idx").alias("pc"),
        F.col("t_col_idx").alias("tc"),
        F.col("p_placed_hash").alias("p_same"),
        F.col("t_placed_hash").alias("t_same"),
        (F.col("p_placed_hash") == F.col("t_placed_hash")).alias("placed"),
        exact.alias("exact"),
    )


def _verified(cells: DataFrame, doubtful: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Candidates whose cells agree within the tolerance, place by place.

    The place is the row where order matters, else the rank of the value in its column.
    """
    involved = (
        doubtful.select("pair_id", "order_matters", F.lit("pred").alias("side"), F.col("pc").alias("col_idx"))
        .union(doubtful.select("pair_id", "order_matters", F.lit("target"), "tc"))
        .distinct()
    )
    mine = dealt_join(cells, involved, ["pair_id", "side", "col_idx"], ["row_idx"])
    ordered = mine.where("order_matters").withColumn("place", F.col("row_idx"))
    free = global_position(
        mine.where("NOT order_matters"),
        ["pair_id", "side", "col_idx"],
        [F.col("num"), F.col("str"), F.col("row_idx")],
        "place",
    )
    placed = ordered.unionByName(free).select("pair_id", "side", "col_idx", "place", F.struct("num", "str").alias("v"))
    p = placed.where("side = 'pred'").select("pair_id", F.col("col_idx").alias("pc"), "place", F.col("v").alias("p"))
    t = placed.where("side = 'target'").select("pair_id", F.col("col_idx").alias("tc"), "place", F.col("v").alias("t"))
    both = dealt_join(p, doubtful.select("pair_id", "pc", "tc"), ["pair_id", "pc"], ["place"]).join(by_shuffle(t), ["pair_id", "tc", "place"], "left")
    ok = F.coalesce(same_cell(F.col("p"), F.col("t"), atol, rtol), F.lit(False))
    return (
        both.groupBy("pair_id", "pc", "tc")
        .agg(F.bool_and(F.col("t").isNotNull() & ok).alias("_ok"))
        .where("_ok")
        .select("pair_id", "pc", "tc")
    )


def _pair_prints(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """What two columns hold together, row by row: ``pair_id, side, c, d, print, xy, axy, ax, n``, both ways round.

    ``print`` is a fingerprint of the exact values. ``xy`` is the sum of products; with the sums of absolute products (``axy``) and
    values (``ax``) it shows whether rows can agree within a tolerance, whatever their order. A text counts as a number made of its
    hash, a null as 0. Only for pairs of results in which a column has several partners and the order does not matter.
    """
    free = edges.where("NOT order_matters")
    several = free.groupBy("pair_id", "pc").count().where("count > 1").select("pair_id").distinct()
    free = free.join(several, "pair_id", "left_semi")
    involved = free.select("pair_id", F.lit("pred").alias("side"), F.col("pc").alias("col_idx")).union(free.select("pair_id", F.lit("target"), "tc")).distinct()
    number = F.coalesce(F.col("num"), F.pmod(F.xxhash64("str"), F.lit(1_000_003)) / 1_000_003.0)
    number = F.when(F.col("num").isNull() & F.col("str").isNull(), 0.0).otherwise(number)
    rows = (
        cells.join(several, "pair_id", "left_semi")
        .join(involved, ["pair_id", "side", "col_idx"], "left_semi")
        .groupBy("pair_id", "side", "row_idx")
        .agg(F.collect_list(F.struct("col_idx", F.xxhash64("num", "str").alias("h"), number.alias("v"))).alias("v"))
    )
    pairs = F.flatten(
        F.transform(
            "v",
            lambda a: F.transform("v", lambda b: F.struct(a["col_idx"].alias("c"), b["col_idx"].alias("d"), a["h"].alias("x"), b["h"].alias("y"), a["v"].alias("v"), b["v"].alias("w"))),
        )
    )
    both = rows.select("pair_id", "side", F.explode(F.filter(pairs, lambda p: p["c"] != p["d"])).alias("p"))
    product = F.col("p.v") * F.col("p.w")
    return both.groupBy("pair_id", "side", "p.c", "p.d").agg(
        _hash_sum(F.col("p.x"), F.col("p.y")).cast("string").alias("print"),
        F.sum(product).alias("xy"),
        F.sum(F.abs(product)).alias("axy"),
        F.sum(F.abs("p.v") + F.abs("p.w")).alias("ax"),
        F.count(F.lit(1)).alias("n"),
    )


def _products_agree(one: tuple, two: tuple, target: tuple, atol: float, rtol: float) -> bool:
    """Whether sums of products can belong to rows that agree within the tolerance: each row changes its product by so much at most."""
    xy, other, (_, axy, ax, n) = one[0], two[0], target
    room = (atol + atol * rtol) * ax + (2 * rtol + rtol * rtol + 1e-9) * axy + atol * atol * n
    return not abs(xy - other) > room  # sums that are not finite tell nothing


def _matching(options: dict[int, set[int]]) -> dict[int, int] | None:
    """A partner of its own for every column, by augmenting paths; None if there is no such choice."""
    owner: dict[int, int] = {}

    def placed(column: int, seen: set[int]) -> bool:
        for b in sorted(options[column]):
            if b not in seen:
                seen.add(b)
                if b not in owner or placed(owner[b], seen):
                    owner[b] = column
                    return True
        return False

    return {c: b for b, c in owner.items()} if all(placed(c, set()) for c in sorted(options)) else None


def _mappings_of(edges: pd.DataFrame, known: dict[tuple[str, int, int], tuple], atol: float = ATOL, rtol: float = RTOL) -> Iterator[tuple[list[int], list[int], int]]:
    """Ways to give every column of the narrower side a partner of its own, one after another.

    Where the order of rows matters, columns agree place by place, so any matching will do and one is given. Else a choice is
    carried on to the other columns: two columns go only to two partners that hold the same values together (exact columns), or
    whose products allow it (columns within the tolerance), and what is left must have a matching. Columns that are equal row
    by row stand for each other, so only one of their orders is tried.
    """
    first = edges.iloc[0]
    flip = first["pred_cols"] > first["target_cols"]
    need = int(min(first["pred_cols"], first["target_cols"]))
    near, far = ("tc", "pc") if flip else ("pc", "tc")
    near_same, far_same = ("t_same", "p_same") if flip else ("p_same", "t_same")
    near_side, far_side = ("target", "pred") if flip else ("pred", "target")
    options: dict[int, set[int]] = {}
    for a, b in zip(edges[near], edges[far]):
        options.setdefault(int(a), set()).add(int(b))
    if len(options) < need:
        return
    kind_near = dict(zip(edges[near].astype(int), edges[near_same]))
    kind_far = dict(zip(edges[far].astype(int), edges[far_same]))
    exact = {(int(a), int(b)): bool(e) for a, b, e in zip(edges[near], edges[far], edges["exact"])}

    def fits(a: int, b: int, c: int, d: int) -> bool:
        mine, other = known.get((near_side, a, c)), known.get((far_side, b, d))
        if mine is None or other is None:
            return True
        if exact[a, b] and exact[c, d]:
            return mine[0] == other[0]
        return _products_agree(mine[1:], other[1:], (mine if flip else other)[1:], atol, rtol)

    def extend(left: dict[int, set[int]], used: dict[int, int]) -> Iterator[dict[int, int]]:
        if not left:
            yield dict(used)
            return
        column = min(left, key=lambda c: (len(left[c]), c))
        tried = set()
        for b in sorted(left[column]):
            twins = [used[a] for a in used if kind_near[a] == kind_near[column]]
            if kind_far[b] in tried or any(b < o for o in twins) and all(o in options[column] for o in twins):
                continue
            tried.add(kind_far[b])
            rest = {c: {d for d in ds if d != b and fits(column, b, c, d)} for c, ds in left.items() if c != column}
            if _matching(rest) is not None:
                used[column] = b
                yield from extend(rest, used)
                del used[column]

    whole = _matching(options)
    if whole is None:
        return
    for found in [whole] if first["order_matters"] else extend(options, {}):
        pairs = sorted(found.items(), key=lambda ab: (not exact[ab], ab))
        n_exact = sum(exact[ab] for ab in pairs)
        a, b = [x for x, _ in pairs], [y for _, y in pairs]
        yield (b, a, n_exact) if flip else (a, b, n_exact)


def _enumerate(skip: int, take: int, atol: float, rtol: float):
    def some(edges: pd.DataFrame, prints: pd.DataFrame) -> pd.DataFrame:
        held = zip(prints["side"], prints["c"], prints["d"], zip(prints["print"], prints["xy"], prints["axy"], prints["ax"], prints["n"]))
        known = {(s, int(c), int(d)): x for s, c, d, x in held}
        ways = islice(_mappings_of(edges, known, atol, rtol) if len(edges) else [], skip, skip + take + 1)
        rows = [(edges["pair_id"].iloc[0], i, p, t, n, bool(edges["order_matters"].iloc[0])) for i, (p, t, n) in enumerate(ways)]
        more = len(rows) > take
        return pd.DataFrame([(*r, more) for r in rows[:take]], columns=["pair_id", "mapping", "p_cols", "t_cols", "n_exact", "order_matters", "more"])

    return some


def _wholly_equal(edges: DataFrame, cells: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Pairs with a mapping of all columns of the narrower side under which the rows agree.

    The rows of the first mapping of each pair are compared; only where they differ and there are others the next ones follow, eight
    times as many each round. Groups hold column pairs, not rows: as many as two result widths allow.
    """
    prints = cut_lineage(_pair_prints(cells, edges).withColumnRenamed("pair_id", "of"))
    schema = "pair_id long, mapping int, p_cols array<int>, t_cols array<int>, n_exact int, order_matters boolean, more boolean"
    out, skip, take = None, 0, 1
    while True:
        full = cut_lineage(edges.groupBy("pair_id").cogroup(prints.groupBy("of")).applyInPandas(_enumerate(skip, take, atol, rtol), schema))
        found = full.where("order_matters").select("pair_id").union(_jointly_equal(cells, full.where("NOT order_matters"), atol, rtol))
        undecided = full.where("more").select("pair_id").distinct()
        if undecided.isEmpty():
            return found if out is None else out.union(found)
        found = cut_lineage(found.distinct())
        out = found if out is None else out.union(found)
        edges = cut_lineage(edges.join(undecided, "pair_id", "left_semi").join(found, "pair_id", "left_anti"))
        if edges.isEmpty():
            return out
        skip, take = skip + take, take * 8


def _jointly_equal(cells: DataFrame, mappings: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Mappings under which the rows of both sides agree as a whole, whatever their order."""
    rows = (
        cells.join(mappings.select("pair_id").distinct(), "pair_id", "left_semi")
        .groupBy("pair_id", "side", "row_idx")
        .agg(F.map_from_entries(F.collect_list(F.struct("col_idx", F.struct("num", "str")))).alias("_vals"))
    )
    cols = F.when(F.col("side") == "pred", F.col("p_cols")).otherwise(F.col("t_cols"))
    picked = dealt_join(rows, mappings, ["pair_id"], ["row_idx"]).select(
        "pair_id",
        "mapping",
        "side",
        "row_idx",
        "n_exact",
        (F.col("n_exact") == F.size("p_cols")).alias("exact"),
        F.transform(cols, lambda c: F.element_at("_vals", c)).alias("vals"),
    )
    sums = (
        picked.where("exact")
        .groupBy("pair_id", "mapping")
        .pivot("side", ["pred", "target"])
        .agg(_hash_sum(F.col("vals")))
    )
    by_hash = sums.where("pred = target").select("pair_id")
    near = picked.where("NOT exact")
    if near.isEmpty():
        return by_hash.distinct()
    firm = F.slice("vals", F.lit(1), F.col("n_exact"))
    loose = F.slice("vals", F.col("n_exact") + 1, F.size("vals"))
    keyed = near.select("pair_id", "mapping", "side", "row_idx", firm.alias("firm"), loose.alias("loose"))
    placed = global_position(
        keyed, ["pair_id", "mapping", "side"], [F.col("firm"), F.col("loose"), F.col("row_idx")], "place"
    )
    p = placed.where("side = 'pred'").select("pair_id", "mapping", "place", F.concat("firm", "loose").alias("p"))
    t = placed.where("side = 'target'").select("pair_id", "mapping", "place", F.concat("firm", "loose").alias("t"))
    same = F.forall(
        F.arrays_zip(F.col("p"), F.col("t")), lambda z: F.coalesce(same_cell(z["p"], z["t"], atol, rtol), F.lit(False))
    )
    ranked = (
        p.join(by_shuffle(t), ["pair_id", "mapping", "place"], "left")
        .groupBy("pair_id", "mapping")
        .agg(F.bool_and(F.col("t").isNotNull() & F.coalesce(same, F.lit(False))).alias("_ok"))
        .where("_ok")
        .select("pair_id")
    )
    return by_hash.union(ranked).distinct()


def compare_results(
    cells: DataFrame, pairs: DataFrame, atol: float = ATOL, rtol: float = RTOL, loose: bool = False
) -> DataFrame:
    """``pair_id, verdict`` for all pairs.

    ``loose`` labels any partial agreement of unequal widths superset or subset; by default
    that needs every column of the narrower result.
    """
    both_empty = (F.col("pred_rows") == 0) & (F.col("target_rows") == 0)
    rows_differ = F.col("pred_rows") != F.col("target_rows")
    alike = pairs.where(~both_empty & ~rows_differ)
    mine = cells.join(alike.select("pair_id"), "pair_id", "left_semi")
    candidates = cut_lineage(_candidates(column_summaries(mine), alike, atol, rtol))
    equal = cut_lineage(_positionally_equal(cells, alike, candidates, atol, rtol))
    open_pairs = alike.join(equal, "pair_id", "left_anti")

    candidates = candidates.join(equal, "pair_id", "left_anti")
    doubtful = candidates.where("NOT exact AND n_num > 0")
    sure = candidates.where("exact")
    if not doubtful.isEmpty():
        checked = _verified(cells, doubtful, atol, rtol)
        sure = sure.unionByName(doubtful.join(checked, ["pair_id", "pc", "tc"], "left_semi"))
    widths = open_pairs.select("pair_id", "pred_cols", "target_cols")
    edges = cut_lineage(sure.join(widths, "pair_id"))
    whole = _wholly_equal(edges, mine, atol, rtol)

    label = (
        pairs.join(equal.withColumn("_equal", F.lit(True)), "pair_id", "left")
        .join(whole.distinct().withColumn("_whole", F.lit(True)), "pair_id", "left")
        .join(edges.select("pair_id").distinct().withColumn("_some", F.lit(True)), "pair_id", "left")
    )
    wider = F.when(F.col("pred_cols") > F.col("target_cols"), "columns_superset").when(
        F.col("pred_cols") < F.col("target_cols"), "columns_subset"
    )
    partial = F.coalesce(wider, F.lit("columns_intersect")) if loose else F.lit("columns_intersect")
    return label.select(
        "pair_id",
        F.when(both_empty | F.col("_equal"), "equal")
        .when(rows_differ, "different")
        .when(F.col("_whole"), F.coalesce(wider, F.lit("equal")))
        .when(F.col("_some"), partial)
        .otherwise("different")
        .alias("verdict"),
    )


def execution_flags(verdicts: DataFrame) -> DataFrame:
    """The four 0/1 scores of a verdict; a null verdict (failed or missing query) scores zero."""
    def flag(*accepted: str) -> Column:
        return F.coalesce(F.col("verdict").isin(*accepted), F.lit(False)).cast("int")

    return verdicts.select(
        "*",
        flag("equal").alias("exec"),
        flag("equal", "columns_subset", "columns_superset", "columns_intersect").alias("only_common"),
        flag("equal", "columns_subset").alias("subset"),
        flag("equal", "columns_superset").alias("superset"),
    )


def pair_shapes(cells: DataFrame) -> DataFrame:
    """Row and column numbers per pair and side, from the cells of non-empty results."""
    sides = cells.groupBy("pair_id", "side").agg(
        F.count(F.when(F.col("col_idx") == 0, True)).alias("rows"), (F.max("col_idx") + 1).alias("cols")
    )
    return sides.groupBy("pair_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0)).alias(f"{s}_{c}")
            for s in ("pred", "target")
            for c in ("rows", "cols")
        ]
    )


def run_pairs(
    spark: SparkSession, items: list[tuple[int, str, str | None, str]], store: ResultStore, limit: int = 0, workers: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Run the two queries of every ``(pair_id, db_id, prediction, target)``.

    Each distinct query of a database runs once, ``workers`` of them side by side (shared fairly if the session's scheduler is fair), and its
    result is kept in ``store`` with its row order. The cells of results are written once per distinct query, ``CELL_GROUP`` results to a
    write, and meet their pairs in a join. Only times, widths and error texts come to the driver. Times hold what queries wait for
    each other; ``workers=1`` measures them one after another. Returns the cells of all results and one row per pair.
    """
    from querycorpus.operators.runsql import FAILURES, run_query

    texts = list(dict.fromkeys((db_id, sql) for _, db_id, pred, target in items for sql in (target, pred) if sql is not None))

    @inheritable_thread_target(spark)
    def ran(number: int) -> tuple[float | None, int | None, str | None]:
        db_id, sql = texts[number]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"pairs-{number % workers}")
        started = time.time()
        try:
            store.keep(spark, db_id, sql, lambda: run_query(spark, sql, limit))
            return time.time() - started, len(store.get_placed(spark, db_id, sql).columns) - 1, None
        except (*FAILURES, ValueError) as failure:
            return None, None, (str(failure).splitlines() or [type(failure).__name__])[0]

    @inheritable_thread_target(spark)
    def celled(group: list[int]) -> str:
        parts = [result_cells(store.get_placed(spark, *texts[n]), n, "", store.ROW) for n in group]
        path = f"{store.root}/cells-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, parts).write.parquet(path)
        return path

    with ThreadPoolExecutor(workers) as pool:
        runs = dict(zip(texts, pool.map(ran, range(len(texts)))))
        good = [n for n, text in enumerate(texts) if runs[text][2] is None and runs[text][1]]
        paths = list(pool.map(celled, [good[i : i + CELL_GROUP] for i in range(0, len(good), CELL_GROUP)]))
    number, meta, used = {text: n for n, text in enumerate(texts)}, [], []
    for pair_id, db_id, pred, target in items:
        got = {side: runs[db_id, sql] if sql is not None else (None, None, "no prediction") for side, sql in (("target", target), ("pred", pred))}
        errors = [e if e == "no prediction" else f"{side}: {e}" for side, (_, _, e) in got.items() if e]
        used += [(number[db_id, sql], pair_id, side) for side, sql in (("target", target), ("pred", pred)) if sql is not None]
        meta.append((pair_id, pred, target, got["pred"][1], got["target"][1], got["target"][0], got["pred"][0], errors[0] if errors else None))
    schema = (
        "pair_id long, prediction string, target string, pred_cols int, target_cols int,"
        " target_exec_time double, pred_exec_time double, exec_error string"
    )
    stored = spark.read.schema(CELLS).parquet(*paths) if paths else spark.createDataFrame([], CELLS)
    places = spark.createDataFrame(used, "_number long, pair_id long, side string")
    numbered = stored.withColumnRenamed("pair_id", "_number").drop("side")
    # ``places`` comes from the driver and has two rows a pair; by its few numbers the cells of a result would meet in one task.
    cells = numbered.join(F.broadcast(places), "_number").select("pair_id", "side", "row_idx", "col_idx", "num", "str")
    return cells, spark.createDataFrame(meta, schema)


def execution_scores(cells: DataFrame, runs: DataFrame, loose: bool = False) -> DataFrame:
    """Verdict and flags of every pair; order matters if the target's outer query sorts."""
    from querycorpus.operators.sqltext import outer_features

    sorts = outer_features(runs.select(F.col("pair_id").alias("query_id"), F.col("target").alias("sql"))).select(
        F.col("query_id").alias("pair_id"), F.coalesce("has_order_by", F.lit(False)).alias("order_matters")
    )
    shapes = pair_shapes(cells).select("pair_id", "pred_rows", "target_rows")
    usable = (
        runs.where("exec_error IS NULL")
        .join(sorts, "pair_id")
        .join(shapes, "pair_id", "left")
        .fillna(0, ["pred_rows", "target_rows"])
        .select("pair_id", "order_matters", "pred_rows", "pred_cols", "target_rows", "target_cols")
    )
    verdicts = compare_results(cells, usable, loose=loose)
    return execution_flags(runs.join(verdicts, "pair_id", "left"))


def score_means(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means of the flags and times (times over pairs that ran) and the number of errors."""
    return scores.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("exec", "only_common", "subset", "superset")],
        F.avg("target_exec_time").alias("target_exec_time"),
        F.avg("pred_exec_time").alias("pred_exec_time"),
        F.count("exec_error").alias("errors"),
        F.count(F.lit(1)).alias("pairs"),
    )


def same_multiset(a: Column, b: Column) -> Column:
    """Equality of two lists whatever their order, duplicates counted."""
    return F.sort_array(a).eqNullSafe(F.sort_array(b))
