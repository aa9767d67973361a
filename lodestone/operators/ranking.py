"""Similarity ranking: blocked all-pairs products, rank counting, top-k, and retrieval metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import dot, l2
from lodestone.operators.quantiles import selected
from lodestone.plans.staging import stage

BLOCK = 1024
SUPER = 16
PIECE = 256
EDGES = 2048
CLOSE = 1 << 14
LEAF, MANY = 512, 8
VALUES = 1 << 22
SIDE = 1 << 16
PAIRS = 1 << 18
CELLS = 4096
KS = (1, 5, 10)


def _blocks(rows: DataFrame, columns: list[str], key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows gathered to blocks of about ``size``: (name, an array by column); and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    put = rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    gathered = put.groupBy(name).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return gathered.select(name, *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in columns]), n


def _grid(left: DataFrame, n_left: int, left_name: str, right: DataFrame, n_right: int, right_name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells of a grid in which every block of the left meets every block of the right.

    A cell takes up to SUPER blocks of either side, so that each side is copied once for every SUPER blocks of the other; with few
    blocks cells are smaller, so that there is one for every core.
    """
    across = math.isqrt(max(0, left.sparkSession.sparkContext.defaultParallelism - 1)) + 1
    s = max(1, min(SUPER, -(-max(n_left, n_right) // across)))
    rows, columns = -(-n_left // s), -(-n_right // s)
    put = lambda frame, cell: frame.withColumn("cell", F.explode(cell))
    return (
        put(left, F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.floor(F.col(left_name) / s) * columns + j)),
        put(right, F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: i * columns + F.floor(F.col(right_name) / s))),
    )


def _matrix(rows: object) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in rows])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec, grp) with vec scaled to length 1."""
    return vectors.select("id", l2("vec").alias("vec"), "grp")


def relevant_similarities(unit: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (q, r) with both vectors present: q, r, qvec, qgrp, rgrp, sim (12 places)."""
    q = unit.select(F.col("id").alias("q"), F.col("vec").alias("qvec"), F.col("grp").alias("qgrp"))
    r = unit.select(F.col("id").alias("r"), F.col("vec").alias("rvec"), F.col("grp").alias("rgrp"))
    return edges.select("q", "r").join(q, "q").join(r, "r").select("q", "r", "qvec", "qgrp", "rgrp", F.round(dot("qvec", "rvec"), 12).alias("sim"))


def _ones(matrix: np.ndarray) -> np.ndarray:
    """How many of each row are true; eight columns are added up at a time, in the bytes of one number."""
    whole = matrix.shape[1] // 8 * 8
    out = np.count_nonzero(matrix[:, whole:], axis=1)
    for i in range(0, whole, 8 * 255):  # a byte holds 255
        lanes = np.ascontiguousarray(matrix[:, i : min(i + 8 * 255, whole)]).view(np.uint64).sum(axis=1)
        out += lanes.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)
    return out


def _places(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every column of ``ids`` that is the row's wanted id; ``order`` sorts ids."""
    low, high = np.searchsorted(ids, wanted, "left", order), np.searchsorted(ids, wanted, "right", order)
    row = np.repeat(np.arange(len(wanted)), high - low)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return row, order[low[row] + nth]


def _zeros_before(ids: np.ndarray, mine: np.ndarray, target: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How many of ``ids`` (sorted), all of cosine 0, come before each target of cosine ``best``; the query and the target don't count."""
    low, high = np.searchsorted(ids, target), np.searchsorted(ids, target, "right")
    own = np.searchsorted(ids, mine, "right") - np.searchsorted(ids, mine)
    less, equal = best < 0, best == 0
    return less * (len(ids) - (high - low)) + equal * low - own * (less | equal & (mine < target))


def ranks_in_cell(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """q, r, rank_all, rank_group: for each edge how many items of a cell come before its relevant item, in either scope.

    Products in single precision tell all but those within their error bound of the relevant item's cosine; these are computed again.
    Where the query or the item is a zero vector the cosine is 0 and nothing is computed: their ids are counted.
    """
    out = []
    blocks = []
    for x in items.itertuples(index=False):
        ids, matrix = np.asarray(x.cb_id), _matrix(x.cb_vec)
        blocks.append((ids, np.argsort(ids, kind="stable"), np.asarray(x.cb_grp), matrix, matrix.astype(np.float32).T, ~matrix.any(axis=1)))
    for row in queries.itertuples(index=False):
        at = np.repeat(np.arange(len(row.eb_q)), [len(x) for x in row.eb_r])
        q, group_of = np.asarray(row.eb_q)[at], np.asarray(row.eb_qgrp)[at]
        r, star = np.concatenate(row.eb_r), np.concatenate(row.eb_sim)
        r_inside = np.concatenate(row.eb_rgrp) == group_of
        vectors_of = _matrix(row.eb_qvec)
        single, no_direction = vectors_of.astype(np.float32), ~vectors_of.any(axis=1)[at]
        slack = (vectors_of.shape[1] + 8) * 2.0**-23  # of unit vectors: rounding of both, of the sum and of the bounds
        rank_all, rank_group = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for ids, in_order, group, matrix, turned, zero in blocks:
            rough = single @ turned
            sets = [(np.flatnonzero(~no_direction), zero)] if zero.any() else []
            if no_direction.any():
                sets.append((np.flatnonzero(no_direction), np.ones(len(ids), bool)))
            for which, known in sets:
                rank_all[which] += _zeros_before(np.sort(ids[known]), q[which], r[which], star[which])
                for g in pd.unique(group_of[which]):
                    of = which[r_inside[which] & (group_of[which] == g)]
                    rank_group[of] += _zeros_before(np.sort(ids[known & (group == g)]), q[of], r[of], star[of])
            for i in range(0, len(q), EDGES):  # however many relevant items the queries have
                e = slice(i, i + EDGES)
                s, mine, target, best = rough[at[e]], q[e], r[e], star[e]
                # The query and the relevant item itself are nobody's betters.
                for wanted in (mine, target):
                    s[_places(ids, in_order, wanted)] = np.nan
                s[:, zero] = np.nan
                s[no_direction[e]] = np.nan
                above = s > (best + slack).astype(np.float32)[:, None]
                maybe = s >= (best - slack).astype(np.float32)[:, None]
                clear = _ones(above)
                close = np.flatnonzero(_ones(maybe) > clear)
                edge, column = np.nonzero(maybe[close] & ~above[close])
                edge = close[edge]
                exact = np.zeros(len(edge))
                for k in range(0, len(edge), CLOSE):  # however many items are equal
                    exact[k : k + CLOSE] = np.einsum("ij,ij->i", vectors_of[at[e][edge[k : k + CLOSE]]], matrix[column[k : k + CLOSE]])
                exact = np.round(exact, 12)
                better = (exact > best[edge]) | (exact == best[edge]) & (ids[column] < target[edge])
                edge, column = edge[better], column[better]
                rank_all[e] += clear + np.bincount(edge, minlength=len(mine))
                inner, own_group = r_inside[e], group_of[e]
                among = inner[edge] & (group[column] == own_group[edge])
                rank_group[e] += np.bincount(edge[among], minlength=len(mine)) + np.where(inner, 0, np.searchsorted(ids, target, sorter=in_order))
                for g in pd.unique(own_group):
                    of, members = np.flatnonzero(own_group == g), np.flatnonzero(group == g)
                    near, far = of[inner[of]], of[~inner[of]]
                    rank_group[i + near] += _ones(above[np.ix_(near, members)])
                    if len(far) and len(members):  # items of the group come before, of the others (q too) those with smaller ids
                        others = np.sort(ids[members])
                        own = np.searchsorted(others, mine[far], "right") - np.searchsorted(others, mine[far])
                        rank_group[i + far] += len(others) - own - np.searchsorted(others, target[far]) + own * (mine[far] < target[far])
        out.append(pd.DataFrame({"q": q, "r": r, "rank_all": rank_all, "rank_group": rank_group}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "r": [], "rank_all": [], "rank_group": []})


def rank_counts(vectors: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ranks (from 0) of relevant items: q, r, rank_all among all others, rank_group when only items of q's group count.

    Order is (similarity descending, id). In the group scope every item outside the group, and q itself, is masked: masked items
    come after all others, in order of id. A query's vector moves once with all its relevant items (in pieces of PIECE); out of a
    cell of the grid comes a count for each edge, never a similarity.
    """
    unit = unit_vectors(vectors)
    sims = relevant_similarities(unit, edges)
    piece = F.floor((F.row_number().over(Window.partitionBy("q").orderBy("r")) - 1) / PIECE)
    lists = [F.collect_list(F.struct("r", "rgrp", "sim")).alias("e"), F.first("qvec").alias("qvec"), F.first("qgrp").alias("qgrp")]
    asks = sims.withColumn("piece", piece).groupBy("q", "piece").agg(*lists).select("q", "piece", "qvec", "qgrp", F.col("e.r").alias("r"), F.col("e.rgrp").alias("rgrp"), F.col("e.sim").alias("sim"))
    left, n_left = _blocks(asks, ["q", "qvec", "qgrp", "r", "rgrp", "sim"], "q", block, "eb")
    right, n = _blocks(unit, ["id", "vec", "grp"], "id", block, "cb")

    a, b = _grid(left, n_left, "eb", right, n, "cb")
    met = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(ranks_in_cell, "q long, r long, rank_all long, rank_group long")
    return met.groupBy("q", "r").agg(F.sum("rank_all").alias("rank_all"), F.sum("rank_group").alias("rank_group"))


def nearest_in_cell(asked: pd.DataFrame, items: pd.DataFrame, k: int, same_group: bool = False, exclude_self: bool = True) -> pd.DataFrame:
    """q, c, sim: the k nearest items of each query within a cell; ties by id."""
    out = []
    blocks = [(np.asarray(x.cb_id), np.asarray(x.cb_grp), _matrix(x.cb_vec).T) for x in items.itertuples(index=False)]
    for row in asked.itertuples(index=False):
        q, group_of, vectors_of = np.asarray(row.qb_id), np.asarray(row.qb_grp), _matrix(row.qb_vec)
        at, found_id, found_sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(q), np.finfo(float).min)  # similarity of each query's k-th so far
        for ids, group, matrix in blocks:
            sims = np.fmax(vectors_of @ matrix, -np.inf)  # NaN is nearest to none
            if exclude_self:
                own = np.flatnonzero(np.isin(q, ids))
                sims[own] = np.where(ids[None, :] == q[own, None], -np.inf, sims[own])
            if same_group:
                sims = np.where(group[None, :] == group_of[:, None], sims, -np.inf)
            if not len(at) and len(ids) > k:
                least = np.maximum(least, np.round(np.partition(sims, -k, axis=1)[:, -k], 12))
            # Only what reaches the k-th so far is rounded and sorted; ties do, and are told by id.
            row, column = np.nonzero(sims >= least[:, None] - 1e-12)
            at, found_id, found_sim = np.concatenate([at, row]), np.concatenate([found_id, ids[column]]), np.concatenate([found_sim, np.round(sims[row, column], 12)])
            order = np.lexsort((found_id, -found_sim, at))
            order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]
            at, found_id, found_sim = at[order], found_id[order], found_sim[order]
            full = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
            least[at[full]] = found_sim[full]
        out.append(pd.DataFrame({"q": q[at], "c": found_id, "sim": found_sim}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "sim": []})


def top_k(queries: DataFrame, vectors: DataFrame, k: int, same_group: bool = False, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """The k nearest by cosine of each query (id, vec, grp): q, c, sim, place (from 1); ties by id. A cell of the grid hands on at
    most k rows a query."""
    left, n_left = _blocks(unit_vectors(queries), ["id", "vec", "grp"], "id", block, "qb")
    right, n = _blocks(unit_vectors(vectors), ["id", "vec", "grp"], "id", block, "cb")

    best = lambda asked, items: nearest_in_cell(asked, items, k, same_group, exclude_self)
    a, b = _grid(left, n_left, "qb", right, n, "cb")
    found = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(best, "q long, c long, sim double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def packed(vectors: DataFrame) -> DataFrame:
    """``vec`` as it travels: in ``short`` (and null in ``vec``) where single precision holds it exactly."""
    single = F.col("vec").cast("array<float>")
    exact = single.cast("array<double>") == F.col("vec")
    return vectors.withColumns({"short": F.when(exact, single), "vec": F.when(exact, None).otherwise(F.col("vec"))})


def _unpacked(rows: pd.DataFrame) -> np.ndarray:
    """Vectors of ``packed`` rows, or of rows with ``vec`` alone, scaled to length 1; one shorter than 1e-12 is left as it is."""
    matrix = _matrix(rows["short"].where(rows["short"].notna(), rows["vec"]) if "short" in rows else rows["vec"])
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length < 1e-12, 1.0, length)[:, None]


def pairs_in_cells(batches: Iterator[pd.DataFrame], pairs: int = PAIRS) -> Iterator[pd.DataFrame]:
    """q, c, sim of all pairs that meet in cells (scope, i, j), whose rows (``packed``) come in order of cell and part.

    Part i is held; as part j streams by, each pair is handed on in both directions, some ``pairs`` at a time. In a cell of one part
    (i = j) rows meet those before them.
    """
    cell, held = None, []

    def met(ids: np.ndarray, matrix: np.ndarray, others: np.ndarray, turned: np.ndarray, both: bool) -> Iterator[pd.DataFrame]:
        step = max(1, pairs // len(others))
        for low in range(0, len(ids), step):
            mine = ids[low : low + step]
            s = np.round(matrix[low : low + step] @ turned, 12)
            apart = others[None, :] != mine[:, None]
            x, y, sim = np.repeat(mine, apart.sum(1)), np.broadcast_to(others, s.shape)[apart], s[apart]
            yield pd.DataFrame({"q": x, "c": y, "sim": sim})
            if both:
                yield pd.DataFrame({"q": y, "c": x, "sim": sim})

    for batch in batches:
        for key, rows in batch.groupby(["scope", "i", "j", "part"], sort=False):
            if key[:3] != cell:
                cell, held = key[:3], []
            ids, matrix = rows["id"].to_numpy(), _unpacked(rows)
            _, i, j, part = key
            if part == j:
                for others, turned in held:
                    yield from met(ids, matrix, others, turned, True)
            if i == j:
                yield from met(ids, matrix, ids, matrix.T, False)
            if part == i:
                held.append((ids, matrix.T))


def all_pairs(vectors: DataFrame, same_group: bool = False, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """Cosine of every ordered pair of different items: q, c, sim. Quadratic by nature.

    Items are dealt to parts of about ``side``, in the group scope each group to its own; any two parts meet in one cell, so an item is
    copied once for each part of its scope. A task holds one part and a piece of the pairs, whatever the size of a group.
    """
    every = packed(vectors.select("id", "vec", "grp").where("id is not null"))
    if same_group:
        every = every.where("grp is not null")
    scoped = every.select("id", "short", "vec", (F.col("grp") if same_group else F.lit(0)).cast("long").alias("scope"))
    # With few items parts are smaller, so that there is a cell for every core.
    across = math.isqrt(max(0, 2 * every.sparkSession.sparkContext.defaultParallelism - 1)) + 1
    n = F.count(F.lit(1))
    sizes = scoped.groupBy("scope").agg(F.greatest(F.ceil(n / side), F.least(F.lit(across), F.ceil(n / block))).alias("parts"))
    cells = sizes.agg(F.sum(F.expr("parts * (parts + 1) div 2"))).first()[0] or 1
    put = scoped.join(sizes, "scope").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    copied = put.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = copied.select("scope", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "short", "vec")
    ordered = met.repartition(min(4 * cells, CELLS), "scope", "i", "j").sortWithinPartitions("scope", "i", "j", "part")
    return ordered.mapInPandas(pairs_in_cells, "q long, c long, sim double")


def _upper_half(blocks: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The blocks twice, with the cells of a grid of which only one of two mirrored cells is there."""
    across = math.isqrt(max(0, 2 * blocks.sparkSession.sparkContext.defaultParallelism - 1)) + 1
    s = max(1, min(SUPER, -(-n // across)))
    k, at = -(-n // s), F.floor(F.col(name) / s)
    row = F.explode(F.transform(F.sequence(at, F.lit(k - 1).cast("long")), lambda j: at * k + j))
    column = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), at), lambda i: i * k + at))
    return blocks.withColumn("cell", row), blocks.withColumn("cell", column)


def pair_quantiles(vectors: DataFrame, qs: list[float], block: int = BLOCK, parts: int = 4096, small: int = 4096) -> list[float | None]:
    """Exact quantiles of the cosines (12 places) of all unordered pairs of different rows; None with fewer than two.

    A cell of the grid hands on a histogram of its cosines, at most ``parts`` rows for each range that is still open; ranges that hold a
    wanted rank are split anew until they are small. Pairs themselves stay within the cells, and each pair of blocks meets once.
    """
    blocks, n = _blocks(unit_vectors(vectors).withColumn("at", F.monotonically_increasing_id()), ["at", "vec"], "id", block, "b")
    left, right = _upper_half(stage(blocks, "blocks"), n, "b")
    met = left.groupBy("cell").cogroup(right.groupBy("cell"))

    def counted(ranges: list[tuple[float, float, bool]]) -> list:
        """Bins (range, order, n, low, high) of the cosines within each range; value by value where it is small."""

        def count(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
            sums: dict[tuple[int, float], list] = {}
            for x in rows.itertuples(index=False):
                a, first = _matrix(x.b_vec), np.asarray(x.b_at)
                for y in columns.itertuples(index=False):
                    if x.b <= y.b:
                        sims = np.round(a @ _matrix(y.b_vec).T, 12)
                        flat = np.sort(sims[first[:, None] < np.asarray(y.b_at)[None, :]] if x.b == y.b else sims.ravel())
                        for i, (low, high, each) in enumerate(ranges):
                            part = flat[np.searchsorted(flat, low, "left") : np.searchsorted(flat, high, "right")]
                            number = part if each else np.minimum(parts - 1, np.floor((part - low) / (high - low) * parts))
                            keys, at, ns = np.unique(number, return_index=True, return_counts=True)
                            for key, begin, size in zip(keys.tolist(), at.tolist(), ns.tolist()):
                                old = sums.get((i, key), [0, np.inf, -np.inf])
                                sums[i, key] = [old[0] + size, min(old[1], part[begin]), max(old[2], part[begin + size - 1])]
            return pd.DataFrame([(i, k, *v) for (i, k), v in sums.items()], columns=["i", "part", "n", "low", "high"]).astype({"i": "int32", "part": float, "n": "int64", "low": float, "high": float})

        bins = met.applyInPandas(count, "i int, part double, n long, low double, high double")
        return bins.groupBy("i", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()

    def recount(still: list) -> dict:
        rows = counted([(low, high, size <= small) for _, low, high, _, size, _ in still])
        return {i: [(r["part"], r["n"], r["low"], r["high"]) for r in rows if r["i"] == i] for i in range(len(still))}

    first = [(r["part"], r["n"], r["low"], r["high"]) for r in counted([(-1.0 - 1e-9, 1.0 + 1e-9, False)])]
    return selected({0: first}, {0: qs}, recount)[0]


def met_in_groups(asks: DataFrame, items: DataFrame, ask_columns: list[str], item_columns: list[str], count: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK, values: int = 0) -> DataFrame:
    """What ``count`` makes of blocks of asks (columns ``lb_...``) and of items (``rb_...``) of one group ``g``, a struct.

    Groups lie in blocks by a hash of their first columns, and a group's blocks meet in the cells of a grid of its own, of SUPER blocks either
    side: a large group has many cells. With ``values`` a side of a cell has up to four times as many blocks, as long as their vectors ``vec``
    hold no more numbers than that, so that short vectors are copied less often.
    """

    def gathered(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        wide = F.greatest(F.lit(1), F.least(F.lit(4 * SUPER), F.floor(values / F.max(F.size("vec")) / block))) if values else F.lit(SUPER)
        sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias(f"{name}_n"), wide.alias(f"{name}_wide"))
        put = rows.join(sizes, "g").withColumn(name, F.pmod(F.xxhash64(columns[0]), F.col(f"{name}_n")))
        keys = ["g", name, f"{name}_n", f"{name}_wide"]
        return put.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows")).select(*keys, *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in columns])

    left, right = gathered(asks, ask_columns, "lb"), gathered(items, item_columns, "rb")
    width = lambda side, name: side.select("g", F.ceil(F.col(f"{name}_n") / F.col(f"{name}_wide")).alias(f"{name}_cells")).distinct()
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(width(right, "rb"), "g").withColumn("i", F.floor(F.col("lb") / F.col("lb_wide"))).withColumn("j", cells("rb_cells"))
    b = right.join(width(left, "lb"), "g").withColumn("j", F.floor(F.col("rb") / F.col("rb_wide"))).withColumn("i", cells("lb_cells"))
    a, b = (side.withColumn("cell", F.struct("g", "i", "j")).drop("g") for side in (a, b))
    return a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(count, schema)


def standing_in_group(vectors: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (pair, x, s) with below, n and total: of the cosines of x to the others of its group, how many are less than s, how many there
    are, and their sum. ``pair`` is unique. Cells hand on a row for each pair of theirs."""
    unit = unit_vectors(vectors).select("id", "vec", F.struct("grp").alias("g"))
    asks = pairs.select("pair", F.col("x").alias("id"), "s").join(unit, "id")

    def count(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = [(np.asarray(y.rb_id), _matrix(y.rb_vec).T) for y in items.itertuples(index=False)]
        for x in asked.itertuples(index=False):
            own, star, vectors_of = np.asarray(x.lb_id), np.asarray(x.lb_s), _matrix(x.lb_vec)
            below, n, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own))
            for ids, matrix in blocks:
                s, other = np.round(vectors_of @ matrix, 12), ids[None, :] != own[:, None]
                below += ((s < star[:, None]) & other).sum(1)
                n += other.sum(1)
                total += np.where(other, s, 0.0).sum(1)
            out.append(pd.DataFrame({"pair": np.asarray(x.lb_pair), "below": below, "n": n, "total": total}))
        return pd.concat(out) if out else pd.DataFrame({"pair": [], "below": [], "n": [], "total": []})

    met = met_in_groups(asks, unit, ["pair", "id", "s", "vec"], ["id", "vec"], count, "pair long, below long, n long, total double", block)
    sums = met.groupBy("pair").agg(F.sum("below").alias("below"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return pairs.join(sums, "pair")


def _near(matrix: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of the rows in parts of at most ``most`` that lie near each other, by halves along the widest axis."""
    done, still = [], [np.arange(len(matrix))]
    while still:
        part = still.pop()
        if len(part) <= most:
            done.append(part)
            continue
        rows = matrix[part]
        order = np.argpartition(rows[:, np.argmax(np.ptp(rows, axis=0))], len(part) // 2)
        still += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return done


def places_in_cell(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """g, id, before: how many items of a cell come before each query's own target.

    Items lie in parts near each other; a part whose items are all nearer than the target, or all farther, by its centre and radius is counted
    as a whole. In the others single precision tells all but those within its error bound, which are computed again.
    """
    if not len(asked) or not len(items):
        return pd.DataFrame({"g": [], "id": [], "before": []})
    joined = lambda frame, c: np.concatenate([np.asarray(x) for x in frame[c]])
    ids, others, matrix = joined(items, "rb_id"), joined(items, "rb_mate"), np.concatenate([_matrix(x) for x in items["rb_vec"]])
    own_ids, mates, stars, vectors_of = joined(asked, "lb_id"), joined(asked, "lb_mate"), joined(asked, "lb_s"), np.concatenate([_matrix(x) for x in asked["lb_vec"]])
    mated = len(np.intersect1d(mates, others)) > 0
    parts = []
    for part in _near(matrix, LEAF):
        part = part[np.argsort(others[part], kind="stable")]
        parts.append((ids[part], others[part], matrix[part], matrix[part].astype(np.float32).T.copy()))
    centre = np.stack([m.mean(0) for _, _, m, _ in parts])
    radius = np.array([np.sqrt(((m - c) ** 2).sum(1).max()) for c, (_, _, m, _) in zip(centre, parts)])
    sizes = np.array([len(x[0]) for x in parts])
    slack = (matrix.shape[1] + 8) * 2.0**-23
    before = np.zeros(len(own_ids), np.int64)
    for block in _near(vectors_of, BLOCK):
        u, star, mate, own = vectors_of[block], stars[block], mates[block], own_ids[block]
        single, high, low, found = u.astype(np.float32), (star + slack).astype(np.float32), (star - slack).astype(np.float32), np.zeros(len(block), np.int64)
        toward = u @ centre.T
        full = toward - radius > (star + 2 * slack)[:, None]
        split = ~full & (toward + radius >= (star - 2 * slack)[:, None])
        found += full @ sizes
        for n, (of, mate_of, exactly, turned) in enumerate(parts):
            if mated:
                rows = np.flatnonzero(full[:, n])
                found[rows] -= np.searchsorted(mate_of, mate[rows], "right") - np.searchsorted(mate_of, mate[rows])
            rows = np.flatnonzero(split[:, n])
            if not len(rows):
                continue
            rough = single[rows] @ turned
            above, maybe = rough > high[rows, None], rough >= low[rows, None]
            clear = _ones(above)
            unclear = _ones(maybe) - clear
            many = np.flatnonzero(unclear > MANY)  # of maps with few events most cosines are alike
            if len(many):
                own_star = star[rows[many], None]
                sims = u[rows[many]] @ exactly.T
                above[many] = (sims > own_star + 5e-13) | (sims >= own_star - 5e-13) & (of < own[rows[many], None])
                clear[many] = _ones(above[many])
            found[rows] += clear
            if mated:
                for m in np.intersect1d(mate[rows], mate_of):
                    with_mates = np.flatnonzero(mate[rows] == m)
                    found[rows[with_mates]] -= _ones(above[with_mates, np.searchsorted(mate_of, m) : np.searchsorted(mate_of, m, "right")])
            few = np.flatnonzero((unclear > 0) & (unclear <= MANY))
            if len(few):
                row, column = np.nonzero(maybe[few] & ~above[few])
                row = rows[few[row]]
                exact = np.round(np.einsum("ij,ij->i", u[row], exactly[column]), 12)
                better = ((exact > star[row]) | (exact == star[row]) & (of[column] < own[row])) & (of[column] != own[row]) & (mate[row] != mate_of[column])
                found += np.bincount(row[better], minlength=len(found))
        before[block] = found
    return pd.DataFrame({"g": [g for x in asked["lb_g"] for g in x], "id": own_ids, "before": before})


def identity_ranks(queries: DataFrame, targets: DataFrame, groups: list[str] | str, entity: str, mate: str | None = None, block: int = BLOCK) -> DataFrame:
    """(groups, entity, place): place of each entity's own target among all targets of its group, by rank counting; with ``mate`` those
    that are the query's equal in it don't count (where it is null, all do).

    Entities (numbers) on one side only, and those with a vector that isn't finite, have no row. A cell of a group's grid hands on one count
    for each query.
    """
    groups = [groups] if isinstance(groups, str) else groups
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Codes, so that a null mate equals nobody's.
    side = lambda df, alone: df.where(finite).select(F.struct(*groups).alias("g"), F.col(entity).alias("id"), l2("vec").alias("vec"), (F.coalesce(F.col(mate).cast("long"), F.lit(alone)) if mate else F.lit(alone)).cast("long").alias("mate"))
    q, t = side(queries, -1), side(targets, -2)
    own = q.join(t.select("g", "id", F.col("vec").alias("b")), ["g", "id"]).select("g", "id", "vec", "mate", F.round(dot("vec", "b"), 12).alias("s"))

    kind = own.schema["g"].dataType.simpleString()
    met = met_in_groups(own, t, ["id", "g", "vec", "mate", "s"], ["id", "vec", "mate"], places_in_cell, f"g {kind}, id {own.schema['id'].dataType.simpleString()}, before long", block, VALUES)
    return met.groupBy("g", "id").agg((F.sum("before") + 1).alias("place")).select("g.*", F.col("id").alias(entity), "place")


def query_metrics(ranks: DataFrame, rank: str) -> DataFrame:
    """Metrics of each query from the ranks (from 0) of its relevant items: hit_1, hit_5, hit_10, recall_10, mrr, ap."""
    placed = ranks.withColumn("j", F.row_number().over(Window.partitionBy("q").orderBy(rank)))
    first = F.min(rank)
    return placed.groupBy("q").agg(
        *[(first < k).cast("double").alias(f"hit_{k}") for k in KS],
        F.avg((F.col(rank) < 10).cast("double")).alias("recall_10"), (1 / (first + 1)).alias("mrr"), F.avg(F.col("j") / (F.col(rank) + 1)).alias("ap"),
    )


def relevance_edges(pairs: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Distinct (q, r) in both directions from pairs (x, y), without loops, both ends in the pool (id) if one is given."""
    if pool is not None:
        pairs = pairs.join(pool.select(F.col("id").alias("x")), "x", "left_semi").join(pool.select(F.col("id").alias("y")), "y", "left_semi")
    both = pairs.select(F.col("x").alias("q"), F.col("y").alias("r")).unionByName(pairs.select(F.col("y").alias("q"), F.col("x").alias("r")))
    return both.where("q <> r").distinct()


def discounted(place: str = "place") -> Column:
    """The weight 1 / log2(place + 1) of a place from 1."""
    return 1 / F.log2(F.col(place) + 1)
