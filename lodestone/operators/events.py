"""Ordered event logs: features of sequences, grids, networks and possession.

An action log has action_id, player, team, game, period, t, type, ok, x0, y0, x1, y1. Its order is (game, period, t,
action_id); nothing relies on the order of the input. All sequence features are windows by game, so they share one shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, stage

ORDER = ("period", "t", "action_id")
LENGTH, WIDTH = 105.0, 68.0


def in_game() -> Window:
    return Window.partitionBy("game").orderBy(*ORDER)


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of rows where a condition holds, among those where ``among`` does; 0 when there are none."""
    top = F.count_if(condition if among is None else condition & among)
    return F.coalesce(F.try_divide(top, F.count(F.lit(1)) if among is None else F.count_if(among)), F.lit(0.0))


def pressing(actions: DataFrame, reach: int = 19, seconds: int = 5) -> DataFrame:
    """Each defensive action with the latest action of another team before it: action_id, player, dt, won.

    The latest opponent action is the row before the current run of one team's actions, so a running count of runs finds it in
    one pass for any number of teams; it counts if at most ``reach`` rows back, later in time, and was an opponent's loss.
    """
    w = in_game()
    run = F.sum(F.when(F.col("team") == F.lag("team").over(w), 0).otherwise(1)).over(w)
    rows = actions.withColumn("n", F.row_number().over(w)).withColumn("run", run).withColumn("prev", F.lag(F.struct("t", "ok", "period")).over(w))
    first = Window.partitionBy("game", "run").orderBy("n")
    back = rows.withColumn("opponent", F.first("prev").over(first)).withColumn("from", F.first("n").over(first) - 1)
    near = (F.col("type") == "tackle") & F.col("opponent").isNotNull() & (F.col("n") - F.col("from") <= reach)
    dt = F.when(F.col("opponent.period") == F.col("period"), F.col("t") - F.col("opponent.t"))
    return back.where(near).select("action_id", "player", dt.alias("dt"), (~F.col("opponent.ok")).alias("after_loss"), F.coalesce(dt.between(1, seconds), F.lit(False)).alias("quick"))


def bigrams(actions: DataFrame) -> DataFrame:
    """Successive actions of one player in one game: player, first, second."""
    w = in_game()
    nxt = actions.select("player", F.col("type").alias("first"), F.lead("type").over(w).alias("second"), F.lead("player").over(w).alias("who"))
    return nxt.where("who = player").select("player", "first", "second")


def receivers(actions: DataFrame) -> DataFrame:
    """Successful passes with the next action's player, if of the same team and another player: game, src, dst, n."""
    w = in_game()
    nxt = actions.select("game", "team", "type", "ok", F.col("player").alias("src"), F.lead("player").over(w).alias("dst"), F.lead("team").over(w).alias("dteam"))
    met = nxt.where("type = 'pass' and ok and dteam = team and dst <> src")
    return met.groupBy("game", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pass_degree(edges: DataFrame) -> DataFrame:
    """Weighted out and in share of each player's game network, averaged over the games in which they are a node."""
    out = edges.groupBy("game", F.col("src").alias("player")).agg(F.sum("n").alias("o"))
    into = edges.groupBy("game", F.col("dst").alias("player")).agg(F.sum("n").alias("i"))
    total = edges.groupBy("game").agg(F.sum("n").alias("total"))
    both = out.join(into, ["game", "player"], "full").join(total, "game")
    ratio = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)) / F.col("total"))
    return both.groupBy("player").agg(ratio("o").alias("out_share"), ratio("i").alias("in_share"), F.count(F.lit(1)).alias("games"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient in each game's undirected network (0 under two neighbours), averaged over games."""
    link = edges.select("game", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree, tri = triangles(link, "game")
    c = F.when(F.col("d") > 1, 2 * F.coalesce("tri", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return degree.join(tri, ["game", "node"], "left").groupBy(F.col("node").alias("player")).agg(F.avg(c).alias("clustering"))


def triangles(links: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(keys, node, d) and (keys, node, tri) of undirected links (keys, a, b), each there once: neighbours, and triangles that a node is in
    (no row for none).

    Links point from the end with fewer neighbours to the other (ties by id), so that of m links no node sends out more than the root of
    2 m, however many neighbours it has: the lists that meet are short, and a hub's neighbours are never paired.
    """
    links = stage(links.select(*keys, "a", "b"), "links")
    degree = stage(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(*keys, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d")), "degree")
    ends = lambda end, name: degree.select(*keys, F.col("node").alias(end), F.col("d").alias(name))
    both = links.join(ends("a", "da"), [*keys, "a"]).join(ends("b", "db"), [*keys, "b"])
    down = F.struct("da", "a") < F.struct("db", "b")
    out = stage(both.select(*keys, F.when(down, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(down, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    lists = out.groupBy(*keys, "u").agg(F.collect_list("v").alias("next"))
    met = out.join(lists, [*keys, "u"]).join(lists.select(*keys, F.col("u").alias("v"), F.col("next").alias("beyond")), [*keys, "v"])
    thirds = met.withColumn("w", F.array_intersect("next", "beyond")).where(F.size("w") > 0)
    shares = F.concat(F.array(F.struct(F.col("u").alias("node"), F.size("w").alias("n")), F.struct(F.col("v").alias("node"), F.size("w").alias("n"))), F.transform("w", lambda w: F.struct(w.alias("node"), F.lit(1).alias("n"))))
    return degree, thirds.select(*keys, F.explode(shares).alias("x")).groupBy(*keys, F.col("x.node").alias("node")).agg(F.sum("x.n").alias("tri"))


def _betweenness(src: np.ndarray, dst: np.ndarray) -> dict[int, float]:
    """Normalised betweenness of a small directed graph without weights: shortest paths counted from each node, and each
    node's share of them summed from the farthest back."""
    nodes = np.unique(np.concatenate([src, dst]))
    index = {v: i for i, v in enumerate(nodes.tolist())}
    n = len(nodes)
    adjacent = np.zeros((n, n), bool)
    adjacent[[index[v] for v in src.tolist()], [index[v] for v in dst.tolist()]] = True
    np.fill_diagonal(adjacent, False)
    total = np.zeros(n)
    for s in range(n):
        layers, paths, seen = [np.array([s])], np.zeros(n), np.zeros(n, bool)
        paths[s], seen[s] = 1, True
        while len(layers[-1]):
            flow = paths[layers[-1]] @ adjacent[layers[-1]]
            nxt = np.flatnonzero((flow > 0) & ~seen)
            paths[nxt], seen[nxt] = flow[nxt], True
            layers.append(nxt)
        credit = np.zeros(n)
        for near, far in zip(reversed(layers[:-2]), reversed(layers[1:-1])):
            credit[near] += paths[near] * (adjacent[np.ix_(near, far)] @ ((1 + credit[far]) / paths[far]))
        credit[s] = 0
        total += credit
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return dict(zip(nodes.tolist(), (total * scale).tolist()))


def betweenness(edges: DataFrame, most: int = 512, sources: int = 4096, rows: int = 50_000_000) -> DataFrame:
    """Mean over games of betweenness in the game's pass network. Games of at most ``most`` players are settled in a task each; larger ones
    by tables of levels, for ``sources`` at first and then for as many at a time as should reach ``rows`` rows."""
    edges = stage(edges.select("game", "src", "dst").where("src <> dst").distinct(), "passes")
    nodes = edges.select("game", F.col("src").alias("node")).union(edges.select("game", "dst")).distinct()
    sizes = stage(nodes.groupBy("game").agg(F.count(F.lit(1)).alias("n")), "sizes")

    def by_game(group: pd.DataFrame) -> pd.DataFrame:
        found = _betweenness(group["src"].to_numpy(), group["dst"].to_numpy())
        return pd.DataFrame({"player": list(found), "b": list(found.values())})

    found = edges.join(sizes.where(F.col("n") <= most).select("game"), "game").groupBy("game").applyInPandas(by_game, "player long, b double")
    large = sizes.where(F.col("n") > most)
    if not large.isEmpty():
        credit = betweenness_by_levels(edges.join(large.select("game"), "game"), nodes.join(large.select("game"), "game"), sources, rows)
        scaled = nodes.join(large, "game").join(credit, ["game", "node"], "left")
        found = found.unionByName(scaled.select(F.col("node").alias("player"), (F.coalesce("credit", F.lit(0.0)) / F.greatest(F.lit(1), (F.col("n") - 1) * (F.col("n") - 2))).alias("b")))
    return found.groupBy("player").agg(F.avg("b").alias("betweenness"))


SLOTS = 1 << 20  # sources are taken by ranges of a hash


def betweenness_by_levels(edges: DataFrame, nodes: DataFrame, sources: int = 4096, rows: int = 50_000_000) -> DataFrame:
    """(game, node, credit): shortest paths through each node, as a share of those between their ends, over all pairs of ends.

    About ``sources`` nodes are the sources of the first round. How many rows they reach tells how many sources a round may have, so that it
    writes about ``rows`` rows: sparse networks of any size are settled in few rounds. Frontiers are tables (game, source, node, paths), one for each level, each made from
    the one before by a join; then credits are summed level by level back to the sources. Every level is written, so that no task holds a
    network and a lost executor costs one level.
    """
    edges, nodes = stage(edges, "edges"), stage(nodes, "nodes")
    nodes = nodes.withColumn("at", F.pmod(F.xxhash64("game", "node"), F.lit(SLOTS)))
    n, parts, begin = nodes.count(), [], 0
    while begin < SLOTS and n:
        end = min(SLOTS, begin + max(1, min(SLOTS, SLOTS * sources // n)))
        own = nodes.where((F.col("at") >= begin) & (F.col("at") < end))
        levels = [stage(own.select("game", F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "level")]
        seen = levels[0]
        while not levels[-1].isEmpty():
            ahead = levels[-1].join(edges.withColumnRenamed("src", "node"), ["game", "node"]).groupBy("game", "source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            levels.append(stage(ahead.join(seen.select("game", "source", "node"), ["game", "source", "node"], "left_anti"), "level"))
            seen = seen.unionByName(levels[-1])
        begin, reach = end, seen.count() / max(1, levels[0].count())
        sources = max(sources, int(rows / max(1.0, reach)))
        credits = []
        far = levels[-2].select("game", "source", "node", "paths", F.lit(0.0).alias("credit"))
        for level in reversed(levels[:-2]):
            credits.append(far)
            share = far.select("game", "source", F.col("node").alias("dst"), ((1 + F.col("credit")) / F.col("paths")).alias("share"))
            back = share.join(edges, ["game", "dst"]).groupBy("game", "source", F.col("src").alias("node")).agg(F.sum("share").alias("share"))
            near = level.join(back, ["game", "source", "node"], "left")
            far = stage(near.select("game", "source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("credit")), "credit")
        if credits:  # the sources themselves get none
            parts.append(stage(functools.reduce(DataFrame.unionByName, credits).groupBy("game", "node").agg(F.sum("credit").alias("credit")), "credits"))
            discard(*credits[1:], far)
        discard(*levels)
    if not parts:
        return nodes.select("game", "node", F.lit(0.0).alias("credit"))
    return functools.reduce(DataFrame.unionByName, parts).groupBy("game", "node").agg(F.sum("credit").alias("credit"))


def followed(actions: DataFrame) -> DataFrame:
    """Actions with flags: shot_creating (a successful pass, cross or dribble with a shot of the same team within three rows and
    no other team in between) and pre_assist (pass, pass, successful shot in successive rows of one team)."""
    w = in_game()
    ahead = [F.struct(F.lead("type", k).over(w).alias("type"), F.lead("team", k).over(w).alias("team"), F.lead("ok", k).over(w).alias("ok")) for k in (1, 2, 3)]
    rows = actions.select("action_id", "player", "team", "type", "ok", *[a.alias(f"a{k}") for k, a in enumerate(ahead, 1)])
    shot = lambda k: F.col(f"a{k}.type") == "shot"
    mine = lambda k: F.col(f"a{k}.team") == F.col("team")
    soon = mine(1) & (shot(1) | (mine(2) & (shot(2) | (mine(3) & shot(3)))))
    creating = F.col("ok") & F.col("type").isin("pass", "cross", "dribble") & F.coalesce(soon, F.lit(False))
    pre = (F.col("type") == "pass") & mine(1) & (F.col("a1.type") == "pass") & mine(2) & shot(2) & F.col("a2.ok")
    return rows.select("action_id", "player", creating.alias("shot_creating"), F.coalesce(pre, F.lit(False)).alias("pre_assist"))


def cell(x: Column, y: Column, nx: int, ny: int, length: float = LENGTH, width: float = WIDTH) -> Column:
    """Flat index of a grid cell, with y counted from the top; positions outside go to the border cells."""
    clip = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), v.cast("int")))
    return (ny - 1 - clip(y / width * ny, ny)) * nx + clip(x / length * nx, nx)


MOVES = ("pass", "dribble", "cross")


def threat_surface(actions: DataFrame, nx: int = 16, ny: int = 12, most_rounds: int = 100, eps: float = 1e-5, most_cells: int = 4096) -> DataFrame:
    """Expected threat by cell: cell, xt, by value iteration xt = p_shot p_goal + p_move sum_to P(to) xt(to).

    P(to) counts successful moves, over all moves from the cell. Spark counts the actions by cell and pair of cells; what it
    hands on has at most a row for each cell and each pair of cells of the grid, so the iteration itself runs on the driver.
    """
    if nx * ny > most_cells:
        raise ValueError(f"a grid of {nx * ny} cells is larger than {most_cells}")
    start, end = cell(F.col("x0"), F.col("y0"), nx, ny), cell(F.col("x1"), F.col("y1"), nx, ny)
    moving, shooting = F.col("type").isin(*MOVES), F.col("type") == "shot"
    rows = actions.where(moving | shooting).where(~F.isnan("x0") & ~F.isnan("y0")).select(start.alias("cell"), F.when(moving & F.col("ok"), end).alias("to"), moving.alias("m"), "ok")
    counts = rows.groupBy("cell", "to").agg(F.count_if("m").alias("moves"), F.count_if(~F.col("m")).alias("shots"), F.count_if(~F.col("m") & F.col("ok")).alias("goals")).toPandas()
    n = nx * ny
    at = counts["cell"].to_numpy(int)
    total = lambda c: np.bincount(at, counts[c].to_numpy(float), n)
    moves, shots, goals = total("moves"), total("shots"), total("goals")
    every = np.maximum(moves + shots, 1)
    landed = counts["to"].notna().to_numpy()
    step = np.zeros((n, n))
    np.add.at(step, (at[landed], counts["to"][landed].to_numpy(int)), counts["moves"][landed].to_numpy(float))
    step *= (1 / every)[:, None]  # p_move / moves
    xt = np.zeros(n)
    for _ in range(most_rounds):
        before, xt = xt, goals / every + step @ xt
        if np.abs(xt - before).max() < eps:
            break
    seen = np.flatnonzero(moves + shots)
    return actions.sparkSession.createDataFrame([(int(c), float(xt[c])) for c in seen], "cell int, xt double")


def rated(actions: DataFrame, surface: DataFrame, nx: int = 16, ny: int = 12) -> DataFrame:
    """Actions with ``gain``, the threat at the end less that at the start of successful moves, null for others; cells that the
    surface doesn't have count as 0. The surface has at most a row for each cell."""
    at = actions.withColumn("c0", cell(F.col("x0"), F.col("y0"), nx, ny)).withColumn("c1", cell(F.col("x1"), F.col("y1"), nx, ny))
    v0 = surface.select(F.col("cell").alias("c0"), F.col("xt").alias("v0"))
    v1 = surface.select(F.col("cell").alias("c1"), F.col("xt").alias("v1"))
    both = at.join(F.broadcast(v0), "c0", "left").join(F.broadcast(v1), "c1", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.withColumn("v0", zero(F.col("v0"))).withColumn("gain", F.when(F.col("type").isin(*MOVES) & F.col("ok"), zero(F.col("v1")) - F.col("v0"))).drop("c0", "c1", "v1")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y) in order, by monotone chains; under three distinct points, those."""
    xy = sorted(set(map(tuple, points.tolist())))
    if len(xy) < 3:
        return np.array(xy).reshape(-1, 2)

    def chain(rows: list[tuple]) -> list:
        out: list = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(xy) + chain(xy[::-1]))


def area(corners: np.ndarray) -> float:
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2) if len(corners) > 2 else 0.0


def hull_areas(actions: DataFrame, length: float = 105.8, width: float = 68.7, few: int = 64) -> DataFrame:
    """player, hull_share: area of the hull of start points over the field's. A player with many points in a batch hands on their hull's corners,
    others their points as they are; these are sorted by player, and a stream of batches holds one open player at a time."""

    def runs(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Players in order, where each begins, and the points."""
        players, xy = batch["player"].to_numpy(), batch[["x0", "y0"]].to_numpy(float)
        order = np.argsort(players, kind="stable")
        return players[order], np.flatnonzero(np.diff(players[order], prepend=players[order[:1]] - 1)), xy[order]

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                players, begin, xy = runs(batch)
                size = np.diff(begin, append=len(players))
                found = [(players[b], hull(xy[b : b + n])) for b, n in zip(begin[size > few], size[size > few])]
                left = np.repeat(size <= few, size)
                who = np.concatenate([players[left], *[np.full(len(c), p) for p, c in found]])
                points = np.concatenate([xy[left], *[c for _, c in found]])
                yield pd.DataFrame({"player": who, "x0": points[:, 0], "y0": points[:, 1]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the corners so far of the last player, who may go on in the next batch
        share = lambda found: pd.DataFrame({"player": [p for p, _ in found], "hull_share": [area(c) / (length * width) for _, c in found]})
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(batch):
                players, begin, xy = runs(batch)
                found = [(players[b], hull(xy[b:e])) for b, e in zip(begin, [*begin[1:], len(players)])]
                rest = pd.DataFrame({"player": found[-1][0], "x0": found[-1][1][:, 0], "y0": found[-1][1][:, 1]})
                if len(found) > 1:
                    yield share(found[:-1])
        if rest is not None:
            yield share([(rest["player"].iloc[0], rest[["x0", "y0"]].to_numpy(float))])

    points = actions.where(F.col("player").isNotNull() & ~F.isnan("x0") & ~F.isnan("y0")).select("player", "x0", "y0")
    sorted_by = points.mapInPandas(corners, "player long, x0 double, y0 double").repartition("player").sortWithinPartitions("player")
    return sorted_by.mapInPandas(whole, "player long, hull_share double")
