"""Queries on the ordered action log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import r6
from lodestone.operators import events as E
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SQL
from lodestone.plans.registry import query

W = "WINDOW w AS (PARTITION BY game ORDER BY period, t, action_id)"


@query("action_counts", SQL + """ SELECT player, count(*) AS n, count(DISTINCT game) AS matches_played, count(*) FILTER (type = 'pass') AS passes, count(*) FILTER (type = 'pass' AND ok) AS passes_ok,
 count(*) FILTER (type = 'shot') AS shots, count(*) FILTER (type = 'shot' AND ok) AS goals, count(*) FILTER (type IN ('tackle', 'dribble')) AS duels, round(avg(x0) - 1e-9, 6) AS avg_x, round(avg(y0) - 1e-9, 6) AS avg_y, round(stddev_samp(x0), 6) AS std_x, round(stddev_samp(y0), 6) AS std_y FROM actions GROUP BY player""")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two-place values often end in a five at the seventh place; a billionth less, they round alike in any engine."""
    kind = lambda *k: F.col("type").isin(*k)
    return B.actions(spark, sf_dir).groupBy("player").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("game").alias("matches_played"), F.count_if(kind("pass")).alias("passes"), F.count_if(kind("pass") & F.col("ok")).alias("passes_ok"),
        F.count_if(kind("shot")).alias("shots"), F.count_if(kind("shot") & F.col("ok")).alias("goals"), F.count_if(kind("tackle", "dribble")).alias("duels"),
        r6(F.avg("x0") - 1e-9).alias("avg_x"), r6(F.avg("y0") - 1e-9).alias("avg_y"), r6(F.stddev_samp("x0")).alias("std_x"), r6(F.stddev_samp("y0")).alias("std_y"),
    )


def _shares(name: str, among: str, spec: dict[str, tuple[str, str]], extra: str = ""):
    """A query of shares: column -> (condition, among), both in SQL that either engine reads."""
    cols = ", ".join(f"round(CASE WHEN count(*) FILTER ({a}) = 0 THEN 0 ELSE count(*) FILTER (({c}) AND ({a})) * 1.0 / count(*) FILTER ({a}) END, 6) AS {k}" for k, (c, a) in spec.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.actions(spark, sf_dir).groupBy("player").agg(*[r6(E.share(F.expr(c), F.expr(a))).alias(k) for k, (c, a) in spec.items()])

    run.__name__ = name
    run.__module__ = __name__
    return query(name, SQL + f" SELECT player, {cols} FROM actions GROUP BY player")(run)


MOVING, PASS, LEN = "type in ('pass', 'dribble', 'cross')", "type = 'pass'", "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
spatial_rates = _shares("spatial_rates", "all", {
    "final_third": ("x0 > 70", "true"), "own_third": ("x0 < 35", "true"), "in_box": ("x0 > 89.3 and y0 > 14.2 and y0 < 54.5", "true"),
    "left_half_space": ("y0 < 25", "true"), "right_half_space": ("y0 > 45", "true"), "centre": ("y0 >= 25 and y0 <= 45", "true"), "shots_in_box": ("x0 > 89.3 and y0 > 14.2 and y0 < 54.5", "type = 'shot'"),
})
pass_direction = _shares("pass_direction", "passes", {
    "progressive": ("x1 - x0 > 10 and ok", PASS), "forward": ("x1 - x0 > 5", PASS), "backward": ("x1 - x0 < -5", PASS), "lateral": ("abs(x1 - x0) <= 5", PASS),
    "long": (f"{LEN} > 25", PASS), "short": (f"{LEN} < 10", PASS), "into_final_third": ("x0 <= 70 and x1 > 70", PASS), "carry_progressive": ("x1 - x0 > 10", "type = 'dribble'"),
})
zonal_temporal = _shares("zonal_temporal", "all", {
    "left": ("y0 < 22.67", "true"), "right": ("y0 > 45.33", "true"), "late": ("t > 4500", "true"), "first_half": ("period = 1", "true"), "late_shots": ("t > 4500", "type = 'shot'"),
})


@query("per_match_rates", SQL + """, c AS (SELECT player, count(DISTINCT game) AS m, count(*) AS n, count(*) FILTER (type = 'pass') AS p, count(*) FILTER (type = 'shot') AS s, count(*) FILTER (type = 'shot' AND ok) AS g, count(*) FILTER (type = 'tackle') AS tk, count(*) FILTER (type = 'dribble') AS d FROM actions GROUP BY player)
 SELECT player, round(p * 1.0 / m, 6) AS passes_pm, round(s * 1.0 / m, 6) AS shots_pm, round(tk * 1.0 / m, 6) AS tackles_pm, round(d * 1.0 / m, 6) AS dribbles_pm, round(CASE WHEN s = 0 THEN 0 ELSE g * 1.0 / s END, 6) AS goals_per_shot, round(CASE WHEN p = 0 THEN 0 ELSE s * 1.0 / p END, 6) AS shots_per_pass, round(ln(1 + m), 6) AS log_matches FROM c""")
def per_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = action_counts(spark, sf_dir).join(B.actions(spark, sf_dir).groupBy("player").agg(F.count_if(F.col("type") == "tackle").alias("tackles"), F.count_if(F.col("type") == "dribble").alias("dribbles")), "player")
    per = lambda a, b: r6(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    return counts.select(
        "player", *[per(c, "matches_played").alias(f"{c}_pm") for c in ("passes", "shots", "tackles", "dribbles")],
        per("goals", "shots").alias("goals_per_shot"), per("shots", "passes").alias("shots_per_pass"), r6(F.log1p("matches_played")).alias("log_matches"),
    )


HEAT = ", h AS (SELECT player, least(7, greatest(0, trunc(y0 / 68.7 * 8)))::INT * 12 + least(11, greatest(0, trunc(x0 / 105.8 * 12)))::INT AS bin, count(*) AS n FROM actions GROUP BY ALL)"


def heatmap(actions: DataFrame, across: int = 12, down: int = 8, *by: str) -> DataFrame:
    """player, by, bin, n, share over a grid; bins without actions have no row."""
    clip = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), v.cast("int")))
    at = clip(F.col("y0") / 68.7 * down, down) * across + clip(F.col("x0") / 105.8 * across, across)
    counts = actions.where(~F.isnan("x0") & ~F.isnan("y0")).groupBy("player", *by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("player", *by)))


@query("heatmap_hist", SQL + HEAT + " SELECT player, bin, n, round(n * 1.0 / sum(n) OVER (PARTITION BY player), 6) AS share FROM h")
def heatmap_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap(B.actions(spark, sf_dir)).withColumn("share", r6("share"))


BI = ", nx AS (SELECT player, type AS first, lead(type) OVER w AS second, lead(player) OVER w AS who FROM actions " + W + "), bi AS (SELECT player, first, second FROM nx WHERE who = player)"


@query("action_bigrams", SQL + BI + """, top AS (SELECT first, second FROM bi GROUP BY ALL ORDER BY count(*) DESC, first, second LIMIT 15), tot AS (SELECT player, count(*) AS total FROM bi GROUP BY player)
 SELECT player, first || '_' || second AS bigram, count(*) AS n, round(count(*) * 1.0 / total, 6) AS share FROM bi JOIN top USING (first, second) JOIN tot USING (player) GROUP BY player, first, second, total""")
def action_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's share of the fifteen most frequent bigrams, among all of the player's bigrams."""
    counts = E.bigrams(B.actions(spark, sf_dir)).groupBy("player", "first", "second").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("first", "second").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "first", "second").limit(15).select("first", "second")
    shares = counts.withColumn("total", F.sum("n").over(Window.partitionBy("player"))).join(F.broadcast(top), ["first", "second"])
    return shares.select("player", F.concat_ws("_", "first", "second").alias("bigram"), "n", r6(F.col("n") / F.col("total")).alias("share"))


@query("action_entropy", SQL + ", c AS (SELECT player, type, count(*) AS n FROM actions GROUP BY ALL), p AS (SELECT player, n * 1.0 / sum(n) OVER (PARTITION BY player) AS p FROM c) SELECT player, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY player")
def action_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.actions(spark, sf_dir).groupBy("player", "type").agg(F.count(F.lit(1)).alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("player")))
    return p.groupBy("player").agg(r6(-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


EDGES = ", nx AS (SELECT game, team, type, ok, player AS src, lead(player) OVER w AS dst, lead(team) OVER w AS dteam FROM actions " + W + "), ed AS (SELECT game, src, dst, count(*) AS n FROM nx WHERE type = 'pass' AND ok AND dteam = team AND dst <> src GROUP BY ALL)"


@query("pass_edges", SQL + EDGES + " SELECT * FROM ed")
def pass_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.receivers(B.actions(spark, sf_dir))


@query("pass_degree", SQL + EDGES + """, nd AS (SELECT game, src AS player, n AS o, 0 AS i FROM ed UNION ALL SELECT game, dst, 0, n FROM ed), tot AS (SELECT game, sum(n) AS total FROM ed GROUP BY game),
 g AS (SELECT player, game, sum(o) * 1.0 / total AS o, sum(i) * 1.0 / total AS i FROM nd JOIN tot USING (game) GROUP BY player, game, total) SELECT player, round(avg(o), 6) AS out_share, round(avg(i), 6) AS in_share, count(*) AS games FROM g GROUP BY player""")
def pass_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pass_degree(E.receivers(B.actions(spark, sf_dir))).select("player", r6("out_share").alias("out_share"), r6("in_share").alias("in_share"), "games")


@query("pass_betweenness", SQL.replace("WITH actions", "WITH RECURSIVE actions") + EDGES + """, el AS (SELECT DISTINCT game, src, dst FROM ed), nn AS (SELECT DISTINCT game, v FROM (SELECT game, src AS v FROM el UNION ALL SELECT game, dst FROM el)),
 bf(game, s, v, d, p) USING KEY (game, s, v) AS (SELECT game, v, v, 0, 1.0::DOUBLE FROM nn UNION (SELECT b.game, b.s, e.dst, b.d + 1, sum(b.p) FROM bf b JOIN el e ON e.game = b.game AND e.src = b.v
   WHERE NOT EXISTS (SELECT 1 FROM recurring.bf r WHERE r.game = b.game AND r.s = b.s AND r.v = e.dst) GROUP BY b.game, b.s, e.dst, b.d)),
 cr AS (SELECT a.game, a.v, sum(a.p * c.p / st.p) AS credit FROM bf a JOIN bf c ON c.game = a.game AND c.s = a.v JOIN bf st ON st.game = a.game AND st.s = a.s AND st.v = c.v AND st.d = a.d + c.d WHERE a.d > 0 AND c.d > 0 GROUP BY a.game, a.v),
 nz AS (SELECT game, count(*) AS n FROM nn GROUP BY game) SELECT v AS player, round(avg(coalesce(credit, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END), 9) AS betweenness FROM nn JOIN nz USING (game) LEFT JOIN cr USING (game, v) GROUP BY v""")
def pass_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.betweenness(E.receivers(B.actions(spark, sf_dir))).withColumn("betweenness", F.round("betweenness", 9))


@query("pass_clustering", SQL + EDGES + """, l AS (SELECT DISTINCT game, least(src, dst) AS a, greatest(src, dst) AS b FROM ed), s AS (SELECT * FROM l UNION ALL SELECT game, b, a FROM l), d AS (SELECT game, a, count(*) AS d FROM s GROUP BY ALL),
 t AS (SELECT x.game, x.a, count(*) AS tri FROM s x JOIN s y ON x.game = y.game AND x.a = y.a AND x.b < y.b JOIN l ON l.game = x.game AND l.a = x.b AND l.b = y.b GROUP BY ALL)
 SELECT a AS player, round(avg(CASE WHEN d > 1 THEN 2.0 * coalesce(tri, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN t USING (game, a) GROUP BY a""")
def pass_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clustering(E.receivers(B.actions(spark, sf_dir))).withColumn("clustering", r6("clustering"))


@query("pressing", SQL + f""", a AS (SELECT *, row_number() OVER w AS n, lag(team) OVER w AS lt FROM actions {W}), o AS (SELECT a.*, b.n AS bn, b.t AS bt, b.ok AS bok, b.period AS bp, row_number() OVER (PARTITION BY a.action_id ORDER BY b.n DESC) AS k
 FROM a JOIN a b ON a.game = b.game AND b.team <> a.team AND b.n < a.n AND a.n - b.n <= 19 WHERE a.type = 'tackle'), p AS (SELECT player, CASE WHEN bp = period THEN t - bt END AS dt, NOT bok AS after_loss FROM o WHERE k = 1)
 SELECT player, count(*) AS actions, count(*) FILTER (dt > 0 AND after_loss) AS after_losses, count(*) FILTER (dt BETWEEN 1 AND 600 AND after_loss) AS quick, round(CASE WHEN count(*) FILTER (dt > 0 AND after_loss) = 0 THEN 0 ELSE count(*) FILTER (dt BETWEEN 1 AND 600 AND after_loss) * 1.0 / count(*) FILTER (dt > 0 AND after_loss) END, 6) AS rate FROM p GROUP BY player""")
def pressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defensive actions after an opponent's loss, and those within ten minutes (the events are sparse) as counter-presses."""
    found = E.pressing(B.actions(spark, sf_dir), seconds=600)
    later = (F.col("dt") > 0) & F.col("after_loss")
    return found.groupBy("player").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(later).alias("after_losses"), F.count_if(F.col("quick") & F.col("after_loss")).alias("quick"),
        r6(F.coalesce(F.try_divide(F.count_if(F.col("quick") & F.col("after_loss")), F.count_if(later)), F.lit(0.0))).alias("rate"),
    )


@query("shot_creating", SQL + f""", a AS (SELECT *, lead(team, 1) OVER w AS t1, lead(team, 2) OVER w AS t2, lead(team, 3) OVER w AS t3, lead(type, 1) OVER w AS y1_, lead(type, 2) OVER w AS y2_, lead(type, 3) OVER w AS y3_ FROM actions {W})
 SELECT player, count(*) AS n FROM a WHERE ok AND type IN ('pass', 'cross', 'dribble') AND t1 = team AND (y1_ = 'shot' OR (t2 = team AND (y2_ = 'shot' OR (t3 = team AND y3_ = 'shot')))) GROUP BY player""")
def shot_creating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.followed(B.actions(spark, sf_dir)).where("shot_creating").groupBy("player").agg(F.count(F.lit(1)).alias("n"))


@query("pre_assists", SQL + f""", a AS (SELECT *, lead(team, 1) OVER w AS t1, lead(team, 2) OVER w AS t2, lead(type, 1) OVER w AS y1_, lead(type, 2) OVER w AS y2_, lead(ok, 2) OVER w AS o2 FROM actions {W})
 SELECT player, count(*) AS n FROM a WHERE type = 'pass' AND y1_ = 'pass' AND t1 = team AND t2 = team AND y2_ = 'shot' AND o2 GROUP BY player""")
def pre_assists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.followed(B.actions(spark, sf_dir)).where("pre_assist").groupBy("player").agg(F.count(F.lit(1)).alias("n"))


CELL = "(11 - least(11, greatest(0, trunc({y} / 68.0 * 12)))::INT) * 16 + least(15, greatest(0, trunc({x} / 105.0 * 16)))::INT"
XT = ", m AS (SELECT " + CELL.format(x="x0", y="y0") + " AS c0, " + CELL.format(x="x1", y="y1") + """ AS c1, type, ok FROM actions WHERE type IN ('pass', 'dribble', 'cross', 'shot')),
 base AS (SELECT c0 AS cell, count(*) FILTER (type <> 'shot') * 1.0 / count(*) AS pm, count(*) FILTER (type <> 'shot') AS moves, CASE WHEN count(*) FILTER (type = 'shot') = 0 THEN 0 ELSE count(*) FILTER (type = 'shot' AND ok) * 1.0 / count(*) END AS gain FROM m GROUP BY c0),
 st AS (SELECT c0 AS cell, c1 AS nxt, pm * count(*) / moves AS p FROM m JOIN base ON cell = c0 WHERE type <> 'shot' AND ok GROUP BY c0, c1, pm, moves),
 it(k, cell, xt) AS (SELECT 0, cell, 0.0::DOUBLE FROM base UNION ALL SELECT a.k, a.cell, a.gain + coalesce(f.flow, 0) FROM
  (SELECT DISTINCT it.k + 1 AS k, base.cell, base.gain FROM it, base WHERE it.k < 100) a LEFT JOIN (SELECT st.cell, sum(p * it.xt) AS flow FROM st JOIN it ON it.cell = st.nxt GROUP BY st.cell) f ON f.cell = a.cell),
 dk AS (SELECT b.k, max(abs(b.xt - a.xt)) AS d FROM it a JOIN it b ON b.cell = a.cell AND b.k = a.k + 1 GROUP BY b.k), xt AS (SELECT cell, xt FROM it WHERE k = (SELECT coalesce(min(k) FILTER (d < 1e-5), 100) FROM dk))"""
XT_SQL = SQL.replace("WITH actions", "WITH RECURSIVE actions") + XT


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threat_surface(B.actions(spark, sf_dir))


@query("xt_surface", XT_SQL + " SELECT cell::BIGINT AS cell, round(xt, 6) AS xt FROM xt")
def xt_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir).select(F.col("cell").cast("long").alias("cell"), r6("xt").alias("xt"))


RATED = XT + ", ra AS (SELECT a.*, coalesce(v0.xt, 0) AS v0, CASE WHEN a.type IN ('pass', 'dribble', 'cross') AND a.ok THEN coalesce(v1.xt, 0) - coalesce(v0.xt, 0) END AS gain FROM actions a LEFT JOIN xt v0 ON v0.cell = " + CELL.format(x="x0", y="y0") + " LEFT JOIN xt v1 ON v1.cell = " + CELL.format(x="x1", y="y1") + ")"
RATED_SQL = SQL.replace("WITH actions", "WITH RECURSIVE actions") + RATED


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rated(B.actions(spark, sf_dir), surface(spark, sf_dir))


@query("xt_rate", RATED_SQL + " SELECT action_id, round(gain, 6) AS gain FROM ra WHERE gain IS NOT NULL")
def xt_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).where("gain is not null").select("action_id", r6("gain").alias("gain"))


@query("xt_features", RATED_SQL + """ SELECT player, round(coalesce(sum(gain) FILTER (gain > 0), 0) / count(DISTINCT game), 6) AS xt_per_match, round(avg(gain), 6) AS xt_mean, round(coalesce(sum(gain) FILTER (gain > 0 AND type = 'pass'), 0), 6) AS pass_gain, round(coalesce(sum(gain) FILTER (gain > 0 AND type = 'dribble'), 0), 6) AS carry_gain,
 round(coalesce(sum(gain) FILTER (gain < 0), 0), 6) AS loss, round(stddev_samp(gain), 6) AS gain_std FROM ra GROUP BY player""")
def xt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = lambda c: r6(F.coalesce(F.sum(F.when(c, F.col("gain"))), F.lit(0.0)))
    g = F.col("gain")
    return rated(spark, sf_dir).groupBy("player").agg(
        r6(F.coalesce(F.sum(F.when(g > 0, g)), F.lit(0.0)) / F.countDistinct("game")).alias("xt_per_match"), r6(F.avg("gain")).alias("xt_mean"),
        up((g > 0) & (F.col("type") == "pass")).alias("pass_gain"), up((g > 0) & (F.col("type") == "dribble")).alias("carry_gain"), up(g < 0).alias("loss"), r6(F.stddev_samp("gain")).alias("gain_std"),
    )


@query("vaep_proxy", RATED_SQL + """ SELECT player, round(coalesce(sum(gain) FILTER (gain > 0), 0), 6) AS offensive, round(coalesce(sum(v0) FILTER (type = 'tackle' AND ok), 0), 6) AS defensive,
 round((coalesce(sum(gain) FILTER (gain > 0), 0) + coalesce(sum(v0) FILTER (type = 'tackle' AND ok), 0)) / count(*), 6) AS mean_value FROM ra GROUP BY player""")
def vaep_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gain")
    off = F.coalesce(F.sum(F.when(g > 0, g)), F.lit(0.0))
    deff = F.coalesce(F.sum(F.when((F.col("type") == "tackle") & F.col("ok"), F.col("v0"))), F.lit(0.0))
    return rated(spark, sf_dir).groupBy("player").agg(r6(off).alias("offensive"), r6(deff).alias("defensive"), r6((off + deff) / F.count(F.lit(1))).alias("mean_value"))


GAME_COUNTS = {"pass": "type = 'pass'", "shot": "type = 'shot'", "tackle": "type = 'tackle'", "goal": "type = 'shot' AND ok"}


@query("consistency", SQL + ", g AS (SELECT player, game, " + ", ".join(f"count(*) FILTER ({c}) AS {k}_" for k, c in GAME_COUNTS.items()) + " FROM actions GROUP BY ALL) SELECT player, " + ", ".join(f"round(coalesce(stddev_samp({k}_), 0), 6) AS {k}_std, round(quantile_cont({k}_, 0.75) - quantile_cont({k}_, 0.25), 6) AS {k}_iqr" for k in GAME_COUNTS) + " FROM g GROUP BY player")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of passes, shots, tackles and goals over a player's games; a player of one game has none."""
    by = B.actions(spark, sf_dir).groupBy("player", "game").agg(*[F.count_if(F.expr(c)).alias(k) for k, c in GAME_COUNTS.items()])
    iqr = lambda c: r6(F.percentile(c, 0.75) - F.percentile(c, 0.25))
    return by.groupBy("player").agg(*[x for c in GAME_COUNTS for x in (r6(F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias(f"{c}_std"), iqr(c).alias(f"{c}_iqr"))])


@query("hull_area")
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hull_areas(B.actions(spark, sf_dir))


ZONE = "CASE WHEN shots = 0 AND passes < 2 THEN 'Keeper' WHEN x < 40 AND y < 23 THEN 'Left back' WHEN x < 40 AND y > 45 THEN 'Right back' WHEN x < 40 THEN 'Centre back' WHEN x > 60 AND shots >= 2 THEN 'Attacking midfielder' WHEN x > 60 THEN 'Winger' ELSE 'Midfielder' END"


@query("zone_case", SQL + f", z AS (SELECT player, avg(x0) AS x, avg(y0) AS y, count(*) FILTER (type = 'shot') AS shots, count(*) FILTER (type = 'pass') AS passes FROM actions GROUP BY player) SELECT player, {ZONE} AS zone FROM z")
def zone_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered choice by mean position; strikers count as attacking midfielders."""
    z = B.actions(spark, sf_dir).groupBy("player").agg(F.avg("x0").alias("x"), F.avg("y0").alias("y"), F.count_if(F.col("type") == "shot").alias("shots"), F.count_if(F.col("type") == "pass").alias("passes"))
    x, y, shots = F.col("x"), F.col("y"), F.col("shots")
    zone = (
        F.when((shots == 0) & (F.col("passes") < 2), "Keeper").when((x < 40) & (y < 23), "Left back").when((x < 40) & (y > 45), "Right back").when(x < 40, "Centre back")
        .when((x > 60) & (shots >= 2), "Striker").when(x > 60, "Winger").otherwise("Midfielder")
    )
    return z.select("player", F.when(zone == "Striker", "Attacking midfielder").otherwise(zone).alias("zone"))




def frames(actions: DataFrame, reach: int = 3) -> DataFrame:
    """Freeze frames: each action with tokens (x, y, actor, mate) of the actor first, then of the actions around it."""
    around = E.in_game().rowsBetween(-reach, reach)
    own = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("actor"), F.lit(0).alias("mate"))
    near = F.collect_list(F.struct("action_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "team")).over(around)
    rows = actions.select("action_id", "player", "season", "game", "team", own.alias("own"), near.alias("near"))
    others = F.transform(F.filter("near", lambda a: a["action_id"] != F.col("action_id")), lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), F.lit(0).alias("actor"), (a["team"] == F.col("team")).cast("int").alias("mate")))
    return rows.select("action_id", "player", "season", "game", F.concat(F.array("own"), others).alias("tokens"))


TOKENS = f""", nb AS (SELECT *, row_number() OVER w AS n FROM actions {W}), tk AS (SELECT a.action_id, a.player, a.season, a.game, b.x0 AS x, b.y0 AS y, CASE WHEN a.action_id = b.action_id THEN 1 ELSE 0 END AS actor, CASE WHEN a.action_id <> b.action_id AND a.team = b.team THEN 1 ELSE 0 END AS mate
 FROM nb a JOIN nb b ON a.game = b.game AND b.n BETWEEN a.n - 3 AND a.n + 3)"""


@query("freeze_frames", SQL + TOKENS + " SELECT action_id, count(*)::INT AS n, sum(mate)::BIGINT AS mates, round(sum(x), 6) AS sx FROM tk GROUP BY action_id")
def freeze_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(B.actions(spark, sf_dir))
    total = lambda field: F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t[field])
    return f.select("action_id", F.size("tokens").alias("n"), total("mate").cast("long").alias("mates"), r6(total("x")).alias("sx"))


@query("drop_team", SQL + TOKENS + " SELECT action_id, round(sum(CASE WHEN mate = 1 THEN 0 ELSE x END), 6) AS sx, round(sum(CASE WHEN mate = 1 THEN 0 ELSE y END), 6) AS sy FROM tk GROUP BY action_id")
def drop_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = without_mates(frames(B.actions(spark, sf_dir)))
    total = lambda field: r6(F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t[field]))
    return f.select("action_id", total("x").alias("sx"), total("y").alias("sy"))


def without_mates(f: DataFrame) -> DataFrame:
    """Team mates' tokens zeroed, as padding is."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("actor"), F.lit(0).alias("mate"))
    return f.withColumn("tokens", F.transform("tokens", lambda t: F.when(t["mate"] == 1, zero).otherwise(t)))


CHANNEL = "CASE WHEN actor = 1 THEN 0 WHEN mate = 1 THEN 1 ELSE 2 END"


@query("token_heatmap", SQL + TOKENS + f", h AS (SELECT season, player, {CHANNEL} AS channel, " + CELL.format(x="x", y="y") + " AS cell, count(*) AS n FROM tk GROUP BY ALL) SELECT season, player, channel, cell::BIGINT AS cell, round(n * 1.0 / sum(n) OVER (PARTITION BY season, player, channel), 6) AS share FROM h")
def token_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shares(frames(B.actions(spark, sf_dir)), "season", "player").select("season", "player", "channel", F.col("cell").cast("long").alias("cell"), r6("share").alias("share"))


def token_shares(f: DataFrame, *keys: str) -> DataFrame:
    """Three channels (actor, mates, opponents) of shares by grid cell for each profile."""
    t = f.select(*keys, F.explode("tokens").alias("t")).select(*keys, F.when(F.col("t.actor") == 1, 0).when(F.col("t.mate") == 1, 1).otherwise(2).alias("channel"), E.cell(F.col("t.x"), F.col("t.y"), 16, 12).alias("cell"))
    counts = t.groupBy(*keys, "channel", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "channel")))
