"""Queries of templated text, snippets, intents and hybrid reranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import r6
from lodestone.operators import ranking as R
from lodestone.operators import vectors as V
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SQL, TOP_SQL
from lodestone.plans.q_eval import graded
from lodestone.plans.q_features import STRENGTHS, strengths, zoned
from lodestone.plans.registry import query
from lodestone.plans.staging import table

FOUR = ("passes", "shots", "tackles", "dribbles")
SNIPPET_SQL = "CASE WHEN length({s}) > 300 THEN substr({s}, 1, 300) || '...' ELSE {s} END".format(s="array_to_string(list_slice(string_split(replace(text, chr(10), ' '), '. '), 1, 2), '. ')")
FT = STRENGTHS + """, fc AS (SELECT player, count(*) AS n, count(DISTINCT game) AS games, count(*) FILTER (type = 'pass') AS passes, count(*) FILTER (type = 'pass' AND ok) AS passes_ok, count(*) FILTER (type = 'shot') AS shots, count(*) FILTER (type = 'shot' AND ok) AS goals,
 count(*) FILTER (type = 'tackle') AS tackles, count(*) FILTER (type = 'dribble') AS dribbles, count(*) FILTER (type = 'cross') AS crosses, avg(x0) AS ax, avg(y0) AS ay FROM actions GROUP BY player),
 fn AS (SELECT fc.*, coalesce(c_name, 'Player ' || player) AS name, coalesce(c_mktsegment, 'NONE') AS role FROM fc LEFT JOIN customer ON c_custkey = player),
 fp AS (""" + " UNION ALL ".join(f"SELECT player, role, '{f}' AS f, {f}::DOUBLE AS v FROM fn" for f in FOUR) + """),
 fr AS (SELECT player, role, f, 100.0 * (rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0) / count(*) OVER (PARTITION BY f) AS p,
  100.0 * (rank() OVER (PARTITION BY role, f ORDER BY v) + (count(*) OVER (PARTITION BY role, f, v) - 1) / 2.0) / count(*) OVER (PARTITION BY role, f) AS a FROM fp),
 fd AS (SELECT player, f, row_number() OVER (PARTITION BY player ORDER BY round(gap, 9) DESC, f) AS k FROM (SELECT player, f, p - avg(p) OVER (PARTITION BY role, f) AS gap FROM fr)),
 fw AS (SELECT player, """ + ", ".join(f"max(p) FILTER (f = '{f}') AS p_{f}, max(a) FILTER (f = '{f}') AS a_{f}" for f in FOUR) + """ FROM fr GROUP BY player),
 tz AS (SELECT player, zone, max(feature) FILTER (k = 1) AS s1, max(feature) FILTER (k = 2) AS s2, max(feature) FILTER (k = 3) AS s3, max(pct) FILTER (k = 1) AS t1 FROM ts WHERE k <= 3 GROUP BY player, zone),
 bi AS (SELECT doc_id, max(""" + SNIPPET_SQL + """) AS bio FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
 ft AS (SELECT fn.*, fw.* EXCLUDE (player), tz.* EXCLUDE (player), fd.f AS differs, bio FROM fn JOIN fw USING (player) JOIN tz USING (player) JOIN fd ON fd.player = fn.player AND fd.k = 1 LEFT JOIN bi ON doc_id = fn.player)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each player: counts, percentiles of four of them among all and within the role, the count that sets the player apart
    from the role, the zone's three strengths, name, role, and a bio where there is a document."""
    kind = lambda k, ok=None: F.count_if((F.col("type") == k) & F.col("ok") if ok else F.col("type") == k)
    counts = B.actions(spark, sf_dir).groupBy("player").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("game").alias("games"), kind("pass").alias("passes"), kind("pass", True).alias("passes_ok"), kind("shot").alias("shots"), kind("shot", True).alias("goals"),
        kind("tackle").alias("tackles"), kind("dribble").alias("dribbles"), kind("cross").alias("crosses"), F.avg("x0").alias("ax"), F.avg("y0").alias("ay"),
    )
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), "c_name", "c_mktsegment")
    c = counts.join(names, "player", "left").withColumn("name", F.coalesce("c_name", F.concat(F.lit("Player "), "player"))).withColumn("role", F.coalesce("c_mktsegment", F.lit("NONE")))
    rows = c.select(F.col("player").alias("id"), "role", *[F.col(f).cast("double").alias(f) for f in FOUR])
    ranks = V.percentile_ranks(rows, list(FOUR), "role").withColumnRenamed("pct", "a").join(V.percentile_ranks(rows.drop("role"), list(FOUR)).select("id", "feature", F.col("pct").alias("p")), ["id", "feature"])
    means = ranks.groupBy("role", "feature").agg(F.avg("p").alias("mean"))
    apart = V.first_by(ranks.join(means, ["role", "feature"]), ["id"], [F.desc(F.round(F.col("p") - F.col("mean"), 9)), F.col("feature")]).select(F.col("id").alias("player"), F.col("feature").alias("differs"))
    wide = ranks.groupBy(F.col("id").alias("player")).agg(*[F.max(F.when(F.col("feature") == f, F.col(x))).alias(f"{x}_{f}") for f in FOUR for x in ("p", "a")])
    best = strengths(zoned(spark, sf_dir), spark).groupBy("player", "zone").agg(*[F.max(F.when(F.col("k") == k, F.col("feature"))).alias(f"s{k}") for k in (1, 2, 3)], F.max(F.when(F.col("k") == 1, F.col("pct"))).alias("t1"))
    bios = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.col("doc_id").alias("player")).agg(F.max(snipped(F.col("text"))).alias("bio"))
    return c.join(wide, "player").join(apart, "player").join(best, "player").join(bios, "player", "left")


def snipped(text: Column) -> Column:
    """First two sentences on one line, cut at 300 characters."""
    s = F.array_join(F.slice(F.split(F.regexp_replace(text, "\n", " "), r"\. "), 1, 2), ". ")
    return F.when(F.length(s) > 300, F.concat(F.substring(s, 1, 300), F.lit("..."))).otherwise(s)


def _n(e: str) -> str:
    return f"CAST(CAST(floor({e}) AS BIGINT) AS STRING)"


def _level(p: str) -> str:
    return f"CASE WHEN {p} >= 90 THEN 'among the very best' WHEN {p} >= 75 THEN 'well above most' WHEN {p} >= 50 THEN 'better than half' WHEN {p} >= 25 THEN 'below the middle' ELSE 'near the bottom' END"


THIRD = "CASE WHEN ax < 35 THEN 'the own third' WHEN ax <= 70 THEN 'midfield' ELSE 'the final third' END"
PROFILE = ("name || ':'", "CASE WHEN shots >= 5 THEN 'shooter;' END", "CASE WHEN passes >= 15 THEN 'distributor;' END", "CASE WHEN tackles >= 10 THEN 'ball winner;' END", "CASE WHEN dribbles >= 15 THEN 'carrier;' END", f"'plays in ' || {THIRD}")
COMPARATIVE = ("name || ' compared with all others:'", f"'passing is ' || {_level('p_passes')} || ','", f"'shooting is ' || {_level('p_shots')} || ','", f"'tackling is ' || {_level('p_tackles')} || '.'")
ROLES = {"BUILDING": "builds play from the back", "AUTOMOBILE": "drives forward with the ball", "MACHINERY": "keeps the side ticking", "HOUSEHOLD": "guards the own half"}
#: variant -> pieces of text, each an expression that is null where the piece is left out.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "scouting": ("name || ' has taken part in ' || " + _n("games") + " || ' games with ' || " + _n("n") + " || ' actions.'", f"'Most of them start in ' || {THIRD} || '.'", "CASE WHEN shots > 0 THEN 'Of ' || " + _n("shots") + " || ' shots, ' || " + _n("goals") + " || ' went in.' END", "CASE WHEN passes_ok * 2 >= passes AND passes > 0 THEN 'More than half of the passes arrive.' END"),
    "comparative": COMPARATIVE,
    "profile": PROFILE,
    "strengths": ("name || ' stands out for ' || replace(s1, '_', ' ') || ', ahead of ' || " + _n("t1") + " || ' % of all.'", "CASE WHEN s3 IS NOT NULL THEN 'Next come ' || replace(s2, '_', ' ') || ' and ' || replace(s3, '_', ' ') || '.' END"),
    "statistical": ("name || ' |'", *[f"CASE WHEN {c} > 0 THEN '{c} ' || {_n(f'10.0 * {c} / games')} || '/10 games' END" for c in ("passes", "shots", "goals", "tackles", "dribbles", "crosses")]),
    "nl_role": (
        "name || CASE zone WHEN 'back' THEN ' defends in the last line' WHEN 'middle' THEN ' links the lines' ELSE ' attacks the box' END || ' and ' || CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE 'fills several roles' END || ':'",
        _n("10.0 * passes / games") + " || ' passes and ' || " + _n("10.0 * tackles / games") + " || ' tackles in ten games,'", "CASE WHEN passes > 0 THEN " + _n("100.0 * passes_ok / passes") + " || ' % of the passes arrive.' ELSE 'hardly a pass.' END",
    ),
    "archetype": ("CASE WHEN role = 'NONE' THEN concat_ws(' ', " + ", ".join(PROFILE) + ") ELSE 'A ' || lower(role) || ' type, set apart by ' || differs || ': ahead of ' || " + _n("CASE differs " + " ".join(f"WHEN '{f}' THEN p_{f}" for f in FOUR) + " END") + " || ' % of all and of ' || " + _n("CASE differs " + " ".join(f"WHEN '{f}' THEN a_{f}" for f in FOUR) + " END") + " || ' % of the type.' END",),
    "comparative_archetype": ("CASE WHEN role = 'NONE' THEN concat_ws(' ', " + ", ".join(COMPARATIVE) + ") ELSE 'Among ' || lower(role) || ' types, passing is ' || " + _level("a_passes") + " || ', shooting is ' || " + _level("a_shots") + " || ', tackling is ' || " + _level("a_tackles") + " || '.' END",),
    "pressing_profile": ("name || ' makes ' || " + _n("10.0 * tackles / games") + " || ' tackles in ten games,'", _level("p_tackles") + " || '.'", "CASE WHEN ax > 52.5 THEN 'The pressing starts high.' ELSE 'The pressing starts deep.' END"),
    "creative_profile": ("name || ' plays ' || " + _n("10.0 * (passes + crosses) / games") + " || ' passes and crosses in ten games.'", "CASE WHEN crosses > passes THEN 'Crosses come before passes.' END", "CASE WHEN dribbles > shots THEN 'Dribbles often lead on.' END"),
    "bio_hybrid": ("CASE WHEN bio IS NOT NULL THEN bio || ' ' || name || ' has ' || " + _n("n") + " || ' actions in ' || " + _n("games") + " || ' games.' END",),
}


def _described(variant: str):
    text = "concat_ws(' ', " + ", ".join(TEMPLATES[variant]) + ")"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return described(features(spark, sf_dir), variant)

    run.__module__, run.__name__ = __name__, f"descriptions_{variant}"
    return query(f"descriptions_{variant}", SQL + FT + f" SELECT player, '{variant}' AS text_type, {text} AS text_content FROM ft WHERE {text} <> ''")(run)


def described(rows: DataFrame, *variants: str) -> DataFrame:
    """player, text_type, text_content of features, in one pass for all variants; a variant without a text gives no row."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("text_type"), F.expr("concat_ws(' ', " + ", ".join(TEMPLATES[v]) + ")").alias("text_content")) for v in variants or TEMPLATES]))
    return rows.select("player", each.alias("t")).select("player", "t.*").where("text_content <> ''")


DESCRIBED = {v: _described(v) for v in TEMPLATES}


@query("descriptions_all", SQL + FT + ", al AS (" + " UNION ALL ".join(f"SELECT player, '{v}' AS text_type, concat_ws(' ', {', '.join(p)}) AS t FROM ft" for v, p in TEMPLATES.items()) + ") SELECT text_type, count(*) AS n, sum(length(t))::BIGINT AS chars FROM al WHERE t <> '' GROUP BY text_type")
def descriptions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(features(spark, sf_dir)).groupBy("text_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text_content").cast("long")).alias("chars"))


@query("snippet", "WITH s AS (SELECT doc_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), '. '), 1, 2), '. ') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 300 THEN substr(s, 1, 300) || '...' ELSE s END AS snippet FROM s")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snipped(F.col("text")).alias("snippet"))


@query("query_prefix", "SELECT 'query' AS kind, item_id AS id, 'search_query: ' || text AS input FROM benchmark UNION ALL SELECT 'passage', doc_id, text FROM documents WHERE text IS NOT NULL")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs: queries carry a prefix, passages don't."""
    asked = table(spark, sf_dir, "benchmark").select(F.lit("query").alias("kind"), F.col("item_id").alias("id"), F.concat(F.lit("search_query: "), "text").alias("input"))
    return asked.unionByName(table(spark, sf_dir, "documents").where("text is not null").select(F.lit("passage").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("input")))


#: Skill intents and the patterns that tell them, on lower-cased text.
SKILLS = {
    "aerial": ("aerial", "header", "heads the ball", "dominant in the air", "wins aerial"),
    "set_piece": ("set.piece", "free.?kick", "corner", "dead.?ball", "delivery"),
    "dribbler": ("dribbl", "take.?on", "1.on.1", "one.on.one", "beat.?man", "carries"),
    "box_to_box": ("box.to.box", "b2b", "covers ground", "end.to.end", "both ends"),
    "long_range_passer": ("long.range pass", "long pass", "switching play", "diagonal"),
    "penalty_box_scorer": ("penalty.box", "goal.?scor", "poacher", "tap.?in", "clinical finish"),
    "presser": ("press", "counter.?press", "gegenpres", "high.?press", "intensity"),
    "creator": ("creat", "chance.?creat", "assist", "key pass", "through ball", "final ball"),
    "deep_distributor": ("distribut", "deep.?lying", "dictate", "metronome", "pass.?master"),
    "sweeper_keeper": ("sweeper.?keeper", "rush.?out", "command.?area"),
}
WISHES = ("wins every header", "takes the corners", "can beat a man one on one", "runs from box to box", "likes the diagonal ball", "is a poacher", "works with intensity", "finds the final ball", "sets the tempo like a metronome", "will rush out of goal", "is calm and loyal")


def _wishes_sql() -> str:
    said = "[" + ", ".join(f"'{w}'" for w in WISHES) + "]"
    return f"SELECT c_custkey AS id, lower('Someone like ' || c_name || ' who ' || {said}[1 + c_custkey % {len(WISHES)}] || ' and ' || {said}[1 + (c_custkey // {len(WISHES)}) % {len(WISHES)}]) AS t FROM customer"


@query("skill_intents", f"WITH w AS ({_wishes_sql()}) " + " UNION ALL ".join(f"SELECT id, '{i}' AS intent FROM w WHERE " + " OR ".join(f"regexp_matches(t, '{p}')" for p in ps) for i, ps in SKILLS.items()))
def skill_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills that a scouting wish names; a wish for each customer, in words of its own."""
    said, k = F.array(*map(F.lit, WISHES)), F.col("c_custkey")
    wish = F.concat(F.lit("Someone like "), "c_name", F.lit(" who "), F.get(said, k % len(WISHES)), F.lit(" and "), F.get(said, F.floor(k / len(WISHES)) % len(WISHES)))
    return intents_of(table(spark, sf_dir, "customer").select(k.alias("id"), wish.alias("t")), "id", "t", SKILLS)


def _word(w: str) -> str:
    return f"(^|[^a-z]){w}([^a-z]|$)"


#: intent -> patterns on lower-cased text.
INTENTS = {
    "licence": (_word("licensed?"), _word("gpl")), "contact": ("@", _word("phone")), "table": (r" \| ",), "shouting": ("!!",),
    "english": (_word("the"), _word("and")), "german": (_word("der"), _word("und")),
}


@query("parse_intents", "WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS intent FROM l WHERE " + " OR ".join(f"regexp_matches(t, '{p}')" for p in ps) for i, ps in INTENTS.items()) + ") SELECT doc_id, intent FROM m")
def parse_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def intents_of(texts: DataFrame, key: str, text: str, intents: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, intent) for every intent one of whose patterns is found; all intents in one pass over the texts."""
    low = F.lower(text)

    def any_of(patterns: tuple[str, ...]) -> Column:
        found = low.rlike(patterns[0])
        for p in patterns[1:]:
            found = found | low.rlike(p)
        return found

    found = F.array_compact(F.array(*[F.when(any_of(ps), F.lit(i)) for i, ps in (intents or INTENTS).items()]))
    return texts.select(key, F.explode(found).alias("intent"))


#: Names of the card's places, in order.
CARD = (
    "clearances", "crosses", "cross_accuracy", "corners", "free_kicks", "take_ons", "take_on_success", "carries_final_third", "carries_box", "actions", "defensive_actions", "forward_third_share",
    "covered_area", "progressive_passes", "pass_length", "final_third_passes", "goals", "shots", "shot_conversion", "box_share", "pressing_actions", "counterpressing", "tackles", "interceptions",
    "shots_created", "passes_into_box", "threat_gained", "passes", "pass_completion", "keeper_actions", "keeper_claims", "goal_kicks",
)
#: The card's features that tell how much of a skill an item has.
SKILL_FEATURES = {
    "aerial": ("clearances",),
    "set_piece": ("crosses", "cross_accuracy", "corners", "free_kicks"),
    "dribbler": ("take_ons", "take_on_success", "carries_final_third", "carries_box"),
    "box_to_box": ("actions", "defensive_actions", "forward_third_share", "covered_area"),
    "long_range_passer": ("progressive_passes", "pass_length", "final_third_passes"),
    "penalty_box_scorer": ("goals", "shots", "shot_conversion", "box_share"),
    "presser": ("pressing_actions", "counterpressing", "tackles", "interceptions"),
    "creator": ("shots_created", "passes_into_box", "threat_gained", "final_third_passes"),
    "deep_distributor": ("passes", "pass_completion", "pass_length", "progressive_passes"),
    "sweeper_keeper": ("keeper_actions", "keeper_claims", "goal_kicks"),
}
_SAID = "[" + ", ".join(f"'{w}'" for w in WISHES) + "]"
_PLACES = ", ".join(f"('{i}', {CARD.index(f) + 1})" for i, fs in SKILL_FEATURES.items() for f in fs)
INT = TOP_SQL + f""", cd AS (SELECT q, c, s FROM top WHERE place <= 50 AND q % 20 = 0),
 wi AS (SELECT q, 'Someone like item ' || q || ' who ' || {_SAID}[1 + q % {len(WISHES)}] || ' and ' || {_SAID}[1 + (q // {len(WISHES)}) % {len(WISHES)}] AS wish FROM (SELECT DISTINCT q FROM cd)),
 il AS (""" + " UNION ALL ".join(f"SELECT q, '{i}' AS intent FROM wi WHERE " + " OR ".join(f"regexp_matches(lower(wish), '{p}')" for p in ps) for i, ps in SKILLS.items()) + f"""),
 qi AS (SELECT q, intent, f FROM il JOIN (VALUES {_PLACES}) v(intent, f) USING (intent)),
 fv AS (SELECT cd.q, c, intent, vec[f] AS x, avg(vec[f]) OVER (PARTITION BY cd.q, f) AS m, stddev_pop(vec[f]) OVER (PARTITION BY cd.q, f) AS sd FROM cd JOIN vecs ON id = c JOIN qi ON qi.q = cd.q),
 iv AS (SELECT q, c, intent, avg((x - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END) AS z FROM fv GROUP BY q, c, intent), sk AS (SELECT q, c, avg(z) AS skill FROM iv GROUP BY q, c),
 nm AS (SELECT q, c, CASE WHEN max(skill) OVER w - min(skill) OVER w < 1e-12 THEN 0 ELSE (skill - min(skill) OVER w) / (max(skill) OVER w - min(skill) OVER w) END AS skill FROM sk WINDOW w AS (PARTITION BY q))"""


def candidates(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    return R.top_k(v.where("id % 20 = 0"), v, k)


def wishes(found: DataFrame) -> DataFrame:
    """(q, wish): what each query asks for, in words."""
    said, q = F.array(*map(F.lit, WISHES)), F.col("q")
    wish = F.concat(F.lit("Someone like item "), q, F.lit(" who "), F.get(said, q % len(WISHES)), F.lit(" and "), F.get(said, F.floor(q / len(WISHES)) % len(WISHES)))
    return found.select("q").distinct().select("q", wish.alias("wish"))


def skill_scores(found: DataFrame, asked: DataFrame, cards: DataFrame, features: Mapping[str, Sequence[str]], names: Sequence[str]) -> DataFrame:
    """(q, c, skill) for candidates (q, c) and intents (q, intent): the named features of each intent, read from cards (id, vec),
    standardised over the query's candidates, their mean by intent, the mean over intents, scaled to 0..1 among the candidates. Intents
    without features count for nothing; a query without intents has no rows."""
    places = F.create_map(*[x for i, fs in features.items() for x in (F.lit(i), F.array(*[F.lit(names.index(f)) for f in fs]))])
    wanted = asked.select("q", "intent", F.explode(F.try_element_at(places, F.col("intent"))).alias("f"))
    x = found.select("q", "c").join(wanted, "q").join(cards.select(F.col("id").alias("c"), "vec"), "c").select("q", "c", "intent", "f", F.get("vec", F.col("f")).alias("x"))
    over = Window.partitionBy("q", "f")
    sd = F.stddev_pop("x").over(over)
    z = x.withColumn("z", (F.col("x") - F.avg("x").over(over)) / F.when(sd < 1e-8, 1.0).otherwise(sd))
    skill = z.groupBy("q", "c", "intent").agg(F.avg("z").alias("z")).groupBy("q", "c").agg(F.avg("z").alias("skill"))
    return skill.withColumn("skill", scaled("skill"))


def skills(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """(q, c, skill): how much of what a query's wish names each candidate has."""
    return skill_scores(found, intents_of(wishes(found), "q", "wish", SKILLS), B.vectors(spark, sf_dir), SKILL_FEATURES, CARD)


def scaled(column: str) -> Column:
    w = Window.partitionBy("q")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high - low < 1e-12, 0.0).otherwise((F.col(column) - low) / (high - low))


@query("intent_scores", INT + " SELECT q, c, round(skill, 6) AS skill FROM nm")
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir, candidates(spark, sf_dir).select("q", "c")).withColumn("skill", r6("skill"))


RERANK = INT + """, dn AS (SELECT q, c, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS dense FROM cd WINDOW w AS (PARTITION BY q)),
 fs AS (SELECT dn.q, dn.c, CASE WHEN skill IS NULL THEN dense ELSE 0.625 * dense + 0.375 * skill END AS score FROM dn LEFT JOIN nm USING (q, c)),
 rr AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, c) AS place FROM fs)"""


def reranked(spark: SparkSession, sf_dir: str, alpha: float = 0.625) -> DataFrame:
    """q, c, score, place: fifty nearest, scored by alpha times the scaled similarity and 1 - alpha times the skill."""
    found = candidates(spark, sf_dir)
    both = found.withColumn("dense", scaled("sim")).join(skills(spark, sf_dir, found.select("q", "c")), ["q", "c"], "left")
    score = F.when(F.col("skill").isNull(), F.col("dense")).otherwise(alpha * F.col("dense") + (1 - alpha) * F.col("skill"))
    scored = both.select("q", "c", score.alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "c")))


@query("hybrid_rerank", RERANK + " SELECT q, c, round(score, 6) AS score, place FROM rr WHERE place <= 10")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).where("place <= 10").withColumn("score", r6("score"))


@query("wish_ranking", RERANK + f""", fn AS (SELECT * FROM (VALUES {", ".join(f"({k + 1}, '{n}')" for k, n in enumerate(CARD))}) v(f, name)),
 wf AS (SELECT q, list_sort(list(DISTINCT intent)) AS intents, list_sort(list(DISTINCT name)) AS features FROM qi JOIN fn USING (f) GROUP BY q)
 SELECT rr.q, wish, array_to_string(coalesce(intents, []), ',') AS intents, array_to_string(coalesce(features, []), ',') AS features, c, round(score, 6) AS score, place FROM rr JOIN wi ON wi.q = rr.q LEFT JOIN wf ON wf.q = rr.q WHERE place <= 10""")
def wish_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a wish in words to ten ranked items: its intents, the features they look at, and each item's score and place."""
    top = reranked(spark, sf_dir).where("place <= 10")
    asked = wishes(top)
    names = F.flatten(F.collect_set(F.try_element_at(F.create_map(*[x for i, fs in SKILL_FEATURES.items() for x in (F.lit(i), F.array(*map(F.lit, fs)))]), F.col("intent"))))
    told = intents_of(asked, "q", "wish", SKILLS).groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("intents"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("features"))
    whole = top.join(asked, "q").join(told, "q", "left")
    return whole.select("q", "wish", F.coalesce("intents", F.lit("")).alias("intents"), F.coalesce("features", F.lit("")).alias("features"), "c", r6("score").alias("score"), "place")


@query("rerank_ndcg", RERANK + """, n AS (SELECT grp, count(*) AS n FROM units GROUP BY grp), w AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS d FROM (SELECT unnest(range(1, 11)) AS k)),
 h AS (SELECT q, a.grp AS qg, sum(CASE WHEN b.grp = a.grp THEN 3.0 WHEN b.grp = (a.grp + 1) % 10 THEN 1.0 ELSE 0.0 END / log2(place + 1)) AS dcg FROM rr JOIN units a ON a.id = q JOIN units b ON b.id = c WHERE place <= 10 GROUP BY q, a.grp),
 i AS (SELECT h.q, dcg, least(10, a.n - 1) AS n3, coalesce(b.n, 0) AS n1 FROM h JOIN n a ON a.grp = h.qg LEFT JOIN n b ON b.grp = (h.qg + 1) % 10)
 SELECT q, round(dcg / (3 * coalesce(w3.d, 0) + coalesce(w1.d, 0) - coalesce(w3.d, 0)), 6) AS ndcg FROM i LEFT JOIN w w3 ON w3.k = n3 LEFT JOIN w w1 ON w1.k = least(10, n3 + n1)""")
def rerank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = B.vectors(spark, sf_dir).select("id", "grp")
    top = reranked(spark, sf_dir).where("place <= 10").join(groups.select(F.col("id").alias("q"), F.col("grp").alias("qg")), "q").join(groups.select(F.col("id").alias("c"), F.col("grp").alias("cg")), "c")
    return graded(top, groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))


GAIN = "sum(CASE WHEN b.grp = a.grp THEN 3.0 WHEN b.grp = (a.grp + 1) % 10 THEN 1.0 ELSE 0.0 END / log2(place + 1))"


@query("rerank_deltas", RERANK + f""", n AS (SELECT grp, count(*) AS n FROM units GROUP BY grp), w AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS d FROM (SELECT unnest(range(1, 11)) AS k)),
 hr AS (SELECT q, a.grp AS qg, {GAIN} AS dcg FROM rr JOIN units a ON a.id = q JOIN units b ON b.id = c WHERE place <= 10 GROUP BY q, a.grp), hd AS (SELECT q, {GAIN} AS dcg FROM top JOIN units a ON a.id = q JOIN units b ON b.id = c WHERE place <= 10 AND q % 20 = 0 GROUP BY q),
 i AS (SELECT hr.q, hr.dcg AS r, hd.dcg AS d, least(10, a.n - 1) AS n3, coalesce(b.n, 0) AS n1 FROM hr JOIN hd USING (q) JOIN n a ON a.grp = hr.qg LEFT JOIN n b ON b.grp = (hr.qg + 1) % 10),
 e AS (SELECT q, r / (3 * coalesce(w3.d, 0) + coalesce(w1.d, 0) - coalesce(w3.d, 0)) AS r, i.d / (3 * coalesce(w3.d, 0) + coalesce(w1.d, 0) - coalesce(w3.d, 0)) AS d FROM i LEFT JOIN w w3 ON w3.k = n3 LEFT JOIN w w1 ON w1.k = least(10, n3 + n1))
 (SELECT 'improved' AS part, q, round(r - d, 6) AS value FROM e ORDER BY round(r - d, 9) DESC, q LIMIT 5) UNION ALL (SELECT 'worst', q, round(r, 6) FROM e ORDER BY round(r, 9), q LIMIT 5) UNION ALL SELECT 'category', q % 3, round(avg(r - d), 6) FROM e GROUP BY q % 3""")
def rerank_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking gains over the dense order in nDCG@10: the five queries that gain most, the five worst, and means by category."""
    v = B.vectors(spark, sf_dir)
    groups = v.select("id", "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    named = lambda found: found.join(groups.select(F.col("id").alias("q"), F.col("grp").alias("qg")), "q").join(groups.select(F.col("id").alias("c"), F.col("grp").alias("cg")), "c")
    after = graded(named(reranked(spark, sf_dir).where("place <= 10")), sizes, False).select("q", F.col("ndcg").alias("r"))
    before = graded(named(candidates(spark, sf_dir, 10)), sizes, False).select("q", F.col("ndcg").alias("d"))
    e = after.join(before, "q").select("q", "r", (F.col("r") - F.col("d")).alias("delta"))
    best = e.orderBy(F.desc(F.round("delta", 9)), "q").limit(5).select(F.lit("improved").alias("part"), "q", r6("delta").alias("value"))
    worst = e.orderBy(F.round("r", 9), "q").limit(5).select(F.lit("worst").alias("part"), "q", r6("r").alias("value"))
    return best.unionByName(worst).unionByName(e.groupBy((F.col("q") % 3).alias("q")).agg(r6(F.avg("delta")).alias("value")).select(F.lit("category").alias("part"), "q", "value"))
