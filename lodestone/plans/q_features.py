"""The feature pipeline in its width: all counts, rates and shares of a player in one pass, by season too, and every table side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import r6
from lodestone.operators import events as E
from lodestone.operators import vectors as V
from lodestone.plans import bindings as B
from lodestone.plans import q_events as Q
from lodestone.plans.bindings import SQL
from lodestone.plans.registry import REGISTRY, query
from lodestone.plans.staging import table

#: Finer kinds of action and the body part, in SQL that either engine reads.
KIND = """CASE type WHEN 'tackle' THEN CASE action_id % 4 WHEN 0 THEN 'interception' WHEN 1 THEN 'clearance' WHEN 2 THEN 'foul' ELSE 'tackle' END
 WHEN 'dribble' THEN CASE action_id % 3 WHEN 0 THEN 'take_on' WHEN 1 THEN 'bad_touch' ELSE 'carry' END
 WHEN 'cross' THEN CASE action_id % 5 WHEN 0 THEN 'corner' WHEN 1 THEN 'freekick' WHEN 2 THEN 'throw_in' ELSE 'cross' END
 WHEN 'pass' THEN CASE action_id % 9 WHEN 0 THEN 'keeper_save' WHEN 1 THEN 'keeper_claim' WHEN 2 THEN 'goalkick' ELSE 'pass' END ELSE type END"""
BODY = "CASE WHEN action_id % 6 = 0 THEN 'head' ELSE 'foot' END"
DX, BOX_START, BOX_END = "(x1 - x0)", "(x0 > 89.3 AND y0 > 14.2 AND y0 < 54.5)", "(x1 > 89.3 AND y1 > 14.2 AND y1 < 54.5)"
LENGTH = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"

#: count -> condition.
COUNTS: dict[str, str] = {
    "actions": "true", "passes": "kind = 'pass'", "passes_ok": "kind = 'pass' AND ok", "tackles": "kind = 'tackle'", "tackles_ok": "kind = 'tackle' AND ok",
    "shots": "kind = 'shot'", "goals": "kind = 'shot' AND ok", "carries": "kind = 'carry'", "take_ons": "kind = 'take_on'", "crosses": "kind = 'cross'", "crosses_ok": "kind = 'cross' AND ok",
    "interceptions": "kind = 'interception'", "clearances": "kind = 'clearance'", "fouls": "kind = 'foul'", "keeper_actions": "kind IN ('keeper_save', 'keeper_claim')",
    "foot_actions": "body = 'foot'", "head_actions": "body = 'head'", "forward_third": "x0 > 70", "defensive_third": "x0 < 35", "bad_touches": "kind = 'bad_touch'",
    "corners": "kind = 'corner'", "freekicks": "kind = 'freekick'", "throw_ins": "kind = 'throw_in'", "keeper_saves": "kind = 'keeper_save'", "keeper_claims": "kind = 'keeper_claim'", "goalkicks": "kind = 'goalkick'",
    "final_third_passes": "kind = 'pass' AND x0 > 70", "final_third_passes_ok": "kind = 'pass' AND x0 > 70 AND ok", "progressive_passes": f"kind = 'pass' AND ok AND {DX} > 10",
    "passes_into_box": f"kind = 'pass' AND ok AND {BOX_END}", "carries_into_final_third": "kind = 'carry' AND x0 <= 70 AND x1 > 70", "carries_into_box": f"kind = 'carry' AND {BOX_END} AND NOT {BOX_START}",
    "forward_passes": f"kind = 'pass' AND {DX} > 5", "backward_passes": f"kind = 'pass' AND {DX} < -5", "lateral_passes": f"kind = 'pass' AND abs({DX}) <= 5",
    "long_passes": f"kind = 'pass' AND {LENGTH} > 25", "short_passes": f"kind = 'pass' AND {LENGTH} < 10", "progressive_carries": f"kind = 'carry' AND {DX} > 10",
    "left_space": "y0 < 25", "right_space": "y0 > 45", "central": "y0 >= 25 AND y0 <= 45", "in_box": BOX_START, "late": "t > 4500", "first_half": "period = 1", "late_shots": "t > 4500 AND kind = 'shot'", "shots_in_box": f"kind = 'shot' AND {BOX_START}",
}
#: mean -> expression over actions; a billionth less, since means of two-place values often end in a five at the seventh place.
MEANS: dict[str, str] = {
    "avg_x": "avg(x0) - 1e-9", "avg_y": "avg(y0) - 1e-9", "std_x": "coalesce(stddev_samp(x0), 0)", "std_y": "coalesce(stddev_samp(y0), 0)", "avg_end_x": "avg(x1) - 1e-9", "avg_end_y": "avg(y1) - 1e-9",
    "avg_pass_length": f"coalesce(avg(CASE WHEN kind = 'pass' THEN {LENGTH} END), 0)",
}
PER_MATCH = (
    "actions", "passes", "tackles", "shots", "goals", "crosses", "interceptions", "clearances", "fouls", "keeper_actions", "carries", "take_ons", "final_third_passes", "progressive_passes", "passes_into_box",
    "carries_into_final_third", "bad_touches", "carries_into_box", "corners", "freekicks", "throw_ins", "keeper_saves", "keeper_claims", "goalkicks",
)
#: ratio -> (numerator, denominator) over the counts; 0 where the denominator is.
RATIOS: dict[str, tuple[str, str]] = {
    "actions_per_minute": ("actions", "matches * 90"), "pass_completion": ("passes_ok", "passes"), "tackle_success": ("tackles_ok", "tackles"), "cross_accuracy": ("crosses_ok", "crosses"),
    "final_third_completion": ("final_third_passes_ok", "final_third_passes"), "turnover_rate": ("(fouls + bad_touches + passes - passes_ok)", "actions"), "aerial_share": ("head_actions", "actions"),
    "shot_conversion": ("goals", "shots"), "dribble_success": ("take_ons", "(take_ons + fouls)"), "foot_share": ("foot_actions", "(foot_actions + head_actions)"), "head_share": ("head_actions", "(foot_actions + head_actions)"),
    "forward_third_share": ("forward_third", "actions"), "defensive_third_share": ("defensive_third", "actions"), "defensive_pm": ("(tackles + interceptions + clearances)", "matches"),
    "forward_pass_share": ("forward_passes", "passes"), "backward_pass_share": ("backward_passes", "passes"), "lateral_pass_share": ("lateral_passes", "passes"), "long_pass_share": ("long_passes", "passes"), "short_pass_share": ("short_passes", "passes"),
    "progressive_carry_share": ("progressive_carries", "carries"), "left_share": ("left_space", "actions"), "right_share": ("right_space", "actions"), "central_share": ("central", "actions"), "box_share": ("in_box", "actions"),
    "late_share": ("late", "actions"), "first_half_share": ("first_half", "actions"), "late_shot_share": ("late_shots", "shots"), "shots_in_box_share": ("shots_in_box", "shots"),
} | {f"{c}_pm": (c, "matches") for c in PER_MATCH}


def player_features(actions: DataFrame, *keys: str) -> DataFrame:
    """All counts, means and ratios by ``keys``: one aggregation over the log, then columns of its result."""
    detailed = actions.select("*", F.expr(KIND).alias("kind"), F.expr(BODY).alias("body"))
    wide = detailed.groupBy(*keys).agg(
        F.countDistinct("game").alias("matches"), *[F.expr(f"count(*) FILTER (WHERE {c})").alias(n) for n, c in COUNTS.items()], *[r6(F.expr(e)).alias(n) for n, e in MEANS.items()],
    )
    return wide.select("*", *[r6(F.expr(f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)")).alias(n) for n, (a, b) in RATIOS.items()], r6(F.log1p("matches")).alias("log_matches"))


def features_sql(*keys: str) -> str:
    """A subquery of the same, over ``actions``."""
    by = ", ".join(keys)
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in COUNTS.items())
    means = ", ".join(f"round({e}, 6) AS {n}" for n, e in MEANS.items())
    ratios = ", ".join(f"round(CASE WHEN {b} = 0 THEN 0 ELSE ({a}) * 1.0::DOUBLE / ({b}) END, 6) AS {n}" for n, (a, b) in RATIOS.items())
    return f"(SELECT *, {ratios}, round(ln(1 + matches), 6) AS log_matches FROM (SELECT {by}, count(DISTINCT game) AS matches, {counts}, {means} FROM (SELECT *, {KIND} AS kind, {BODY} AS body FROM actions) GROUP BY {by}))"


@query("player_stats", SQL + " SELECT * FROM " + features_sql("player"))
def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fifty counts, means and spreads, twenty-four rates a match and thirty shares of each player, from one shuffle."""
    return player_features(B.actions(spark, sf_dir), "player")


def bigram_shares(actions: DataFrame, top: int, *keys: str) -> DataFrame:
    """(keys, player, bigrams): each player's shares of the ``top`` most frequent bigrams, found anew for every value of the keys, in
    order of frequency."""
    w = E.in_game()
    pairs = actions.select(*keys, "player", F.concat_ws("_", "type", F.lead("type").over(w)).alias("bigram"), F.lead("player").over(w).alias("who")).where("who = player")
    counts = pairs.groupBy(*keys, "player", "bigram").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("all"), "bigram")) if keys else F.row_number().over(Window.orderBy(F.desc("all"), "bigram"))
    best = counts.groupBy(*keys, "bigram").agg(F.sum("n").alias("all")).withColumn("k", place).where(F.col("k") <= top).select(*keys, "bigram", "k")  # a row for each kind of bigram
    whole = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "player")))
    held = whole.join(best, [*keys, "bigram"]).groupBy(*keys, "player")
    return held.agg(*[r6(F.coalesce(F.max(F.when(F.col("k") == k, F.col("n") / F.col("total"))), F.lit(0.0))).alias(f"bigram_{k}") for k in range(1, top + 1)])


def bigrams_sql(top: int, *keys: str) -> str:
    by = "".join(f"{k}, " for k in keys)
    over = f"PARTITION BY {', '.join(keys)} " if keys else ""
    shares = ", ".join(f"round(coalesce(max(CASE WHEN k = {k} THEN n * 1.0 / total END), 0), 6) AS bigram_{k}" for k in range(1, top + 1))
    on = " AND ".join(f"b.{c} = c.{c}" for c in (*keys, "bigram"))
    return f"""(WITH p AS (SELECT {by}player, type || '_' || lead(type) OVER w AS bigram, lead(player) OVER w AS who FROM actions {Q.W}), c AS (SELECT {by}player, bigram, count(*) AS n FROM p WHERE who = player GROUP BY ALL),
 b AS (SELECT {by}bigram, row_number() OVER ({over}ORDER BY sum(n) DESC, bigram) AS k FROM c GROUP BY {by}bigram), t AS (SELECT *, sum(n) OVER (PARTITION BY {by}player) AS total FROM c)
 SELECT {''.join(f'c.{k}, ' for k in keys)}c.player, {shares} FROM t c JOIN b ON {on} WHERE k <= {top} GROUP BY {''.join(f'c.{k}, ' for k in keys)}c.player)"""


@query("season_stats", SQL + f" SELECT a.*, {', '.join(f'coalesce(bigram_{k}, 0) AS bigram_{k}' for k in range(1, 6))} FROM {features_sql('season', 'player')} a LEFT JOIN {bigrams_sql(5, 'season')} b ON b.season = a.season AND b.player = a.player")
def season_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline by season: the season is one more key of every group, and the frequent bigrams are found by season."""
    a = B.actions(spark, sf_dir)
    both = player_features(a, "season", "player").join(bigram_shares(a, 5, "season"), ["season", "player"], "left")
    return both.fillna(0.0, [f"bigram_{k}" for k in range(1, 6)])


#: Registered feature tables that are set side by side, with the columns taken; they get the table's name in front.
TABLES: dict[str, tuple[str, ...]] = {
    "player_stats": ("matches", *COUNTS, *MEANS, *RATIOS, "log_matches"), "action_entropy": ("entropy",), "pass_degree": ("out_share", "in_share"), "pass_clustering": ("clustering",), "pressing": ("actions", "after_losses", "quick", "rate"),
    "consistency": tuple(f"{c}_{s}" for c in ("pass", "shot", "tackle", "goal") for s in ("std", "iqr")), "shot_creating": ("n",), "pre_assists": ("n",), "vaep_proxy": ("offensive", "defensive", "mean_value"),
}
BIGRAMS = tuple(f"bigram_{k}" for k in range(1, 16))


def _concat_sql() -> str:
    parts = [(f"({REGISTRY[n][1]})", n, cols) for n, cols in TABLES.items()] + [(f"({SQL} SELECT * FROM {bigrams_sql(15)})", "top", BIGRAMS)]
    shown = ", ".join(f"coalesce(t{i}.{c}, 0) AS {n}_{c}" for i, (_, n, cols) in enumerate(parts) for c in cols)
    joins = " ".join(f"LEFT JOIN {q} t{i} ON t{i}.player = c_custkey" for i, (q, _, _) in enumerate(parts))
    return f"SELECT c_custkey AS entity, {shown} FROM customer {joins}"


@query("feature_concat", _concat_sql())
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities with the columns of every feature table, 0 where a table lacks them; joins on one key, so a shuffle each."""
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    parts = [(REGISTRY[n][0](spark, sf_dir), n, cols) for n, cols in TABLES.items()] + [(bigram_shares(B.actions(spark, sf_dir), 15), "top", BIGRAMS)]
    for part, name, cols in parts:
        out = out.join(part.select(F.col("player").alias("entity"), *[F.col(c).alias(f"{name}_{c}") for c in cols]), "entity", "left")
    return out.fillna(0)


#: zone -> features that may be named as strengths there.
POOLS: dict[str, tuple[str, ...]] = {
    "back": ("tackles_pm", "interceptions_pm", "clearances_pm", "tackle_success", "pass_completion", "passes_pm", "progressive_passes_pm"),
    "middle": ("passes_pm", "pass_completion", "progressive_passes_pm", "tackles_pm", "interceptions_pm", "carries_pm", "passes_into_box_pm", "final_third_passes_pm"),
    "front": ("shots_pm", "goals_pm", "shot_conversion", "take_ons_pm", "crosses_pm", "passes_into_box_pm", "carries_into_box_pm", "box_share"),
}
ZONE_OF = "CASE WHEN avg_x < 49 THEN 'back' WHEN avg_x <= 56 THEN 'middle' ELSE 'front' END"
NAMED = tuple(sorted({f for fs in POOLS.values() for f in fs}))
STRENGTHS = f""", ps AS (SELECT *, {ZONE_OF} AS zone FROM {features_sql('player')}), sl AS (UNPIVOT (SELECT player, zone, {', '.join(f'{f}::DOUBLE AS {f}' for f in NAMED)} FROM ps) ON {', '.join(NAMED)} INTO NAME feature VALUE value),
 sp AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0) / count(*) OVER (PARTITION BY feature) AS pct FROM sl),
 pl AS (SELECT * FROM (VALUES {', '.join(f"('{z}', '{f}')" for z, fs in POOLS.items() for f in fs)}) v(zone, feature)),
 ts AS (SELECT player, zone, feature, pct, row_number() OVER (PARTITION BY player ORDER BY round(pct, 9) DESC, feature DESC) AS k FROM sp JOIN pl USING (zone, feature))"""


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_features(B.actions(spark, sf_dir), "player").withColumn("zone", F.expr(ZONE_OF))


def strengths(players: DataFrame, spark: SparkSession, most: int = 3) -> DataFrame:
    """player, zone, feature, pct, k: the best features of each player by percentile, of those that the zone's pool allows."""
    rows = players.select(F.col("player").alias("id"), "zone", *[F.col(f).cast("double").alias(f) for f in NAMED])
    ranks = V.percentile_ranks(rows.drop("zone"), list(NAMED)).join(rows.select("id", "zone"), "id")
    pool = spark.createDataFrame([(z, f) for z, fs in POOLS.items() for f in fs], "zone string, feature string")
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("pct", 9)), F.desc("feature")))
    return ranks.join(F.broadcast(pool), ["zone", "feature"]).withColumn("k", k).where(F.col("k") <= most).select(F.col("id").alias("player"), "zone", "feature", "pct", "k")


@query("top_strengths", SQL + STRENGTHS + " SELECT player, zone, feature, round(pct, 6) AS pct, k FROM ts WHERE k <= 3")
def top_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strengths(zoned(spark, sf_dir), spark).withColumn("pct", r6("pct"))


@query("style_labels", SQL + f", ps AS (SELECT * FROM {features_sql('player')}) SELECT player, CASE WHEN foot_share >= 0.9 THEN 'feet almost only' WHEN foot_share >= 0.8 THEN 'mostly with the feet' ELSE 'often with the head' END AS foot, CASE WHEN avg_x < 35 THEN 'own third' WHEN avg_x <= 70 THEN 'middle third' ELSE 'final third' END AS third FROM ps")
def style_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the share of actions with the foot, and of the mean place along the field."""
    p = player_features(B.actions(spark, sf_dir), "player")
    foot = F.when(F.col("foot_share") >= 0.9, "feet almost only").when(F.col("foot_share") >= 0.8, "mostly with the feet").otherwise("often with the head")
    return p.select("player", foot.alias("foot"), F.when(F.col("avg_x") < 35, "own third").when(F.col("avg_x") <= 70, "middle third").otherwise("final third").alias("third"))
