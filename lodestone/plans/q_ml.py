"""Queries of fitted vector-space operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import r6, uniform
from lodestone.operators import models as M
from lodestone.operators import ranking as R
from lodestone.plans import bindings as B
from lodestone.plans.bindings import TOP_SQL
from lodestone.plans.q_events import heatmap
from lodestone.plans.q_pairs import match_features as games
from lodestone.plans.registry import query
from lodestone.plans.staging import stage, table


def out(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key, F.posexplode("vec").alias("pos", "value")).select(key, F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("zca_whiten")
def zca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening fitted to the gallery, applied to it and to the queries alike."""
    v = B.vectors(spark, sf_dir)
    return out(M.whitened(v, M.zca(v)))


@query("pca_repr")
def pca_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(M.principal(B.vectors(spark, sf_dir), 32))


def heat_vectors(actions: DataFrame, across: int = 12, down: int = 8) -> DataFrame:
    """(id, vec): each player's shares over a grid of the field, zeros counted."""
    shares = heatmap(actions, across, down)
    filled = shares.groupBy(F.col("player").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"))
    return filled.select("id", F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))).alias("vec"))


@query("heatmap_pca")
def heatmap_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(M.principal(heat_vectors(B.actions(spark, sf_dir)), 15))


@query("nmf_repr")
def nmf_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative factors of the heat maps of players with forty actions or more that aren't held out; all players get weights."""
    a = B.actions(spark, sf_dir)
    many = a.groupBy(F.col("player").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 40")
    v = heat_vectors(a)
    taught = v.join(many, "id", "left_semi").where(uniform(F.lit("nmf"), "id") >= 0.2)
    return out(M.factor_weights(v, M.fit_factors(taught, 24)))


@query("player_vectors")
def player_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location heat maps by action type on a fine grid, factored by type, with the type's weights side by side: player, type, pos, value."""
    kinds = ["pass", "dribble", "cross", "shot", "tackle"]
    shares = heatmap(B.actions(spark, sf_dir).where(F.col("type").isin(kinds)), 50, 50, "type")
    cells = shares.groupBy(F.col("player").alias("id"), F.col("type").alias("kind")).agg(F.collect_list(F.struct("bin", "share")).alias("c"))
    v = stage(cells.select("id", "kind", F.col("c.bin").alias("at"), F.col("c.share").alias("value")), "cells")
    weights = M.sparse_factor_weights(v, M.fit_sparse_factors(v, 50 * 50, 4, kinds, rounds=10))
    return weights.select(F.col("id").alias("player"), F.col("kind").alias("type"), F.posexplode("vec").alias("pos", "value")).select("player", "type", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


TFIDF = r"""WITH w AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 x AS (SELECT id, term, tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) AS w FROM tf JOIN df USING (term)), l AS (SELECT id, sqrt(sum(w * w)) AS len FROM x GROUP BY id)"""


@query("tfidf_repr", TFIDF + " SELECT id, term, round(w / len, 6) AS weight FROM x JOIN l USING (id) WHERE len > 0")
def tfidf_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", r6("weight"))


@query("linear_probe")
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 by class, and accuracy and macro F1 of all (label "*"), on held-out vectors."""
    v = B.vectors(spark, sf_dir).withColumn("held", uniform(F.lit("lp"), "id") < 0.3)
    said = stage(M.probe(v.where("not held"), v.where("held"), "grp"), "probed")
    by = M.confusion_metrics(said)
    whole = M.overall_metrics(said).select(F.lit("*").alias("label"), F.col("n").alias("support"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("precision"), F.col("macro_f1").alias("f1"))
    return by.select("label", "support", "recall", "precision", "f1").unionByName(whole)


@query("probe_metrics", TOP_SQL + """, s AS (SELECT qg AS label, cg AS predicted FROM top WHERE place = 1), a AS (SELECT label, count(*) AS support, count(*) FILTER (label = predicted) AS hits FROM s GROUP BY label), c AS (SELECT predicted AS label, count(*) AS called FROM s GROUP BY predicted),
 m AS (SELECT label, support, hits * 1.0 / support AS recall, coalesce(hits * 1.0 / called, 0) AS precision FROM a LEFT JOIN c USING (label)) SELECT label, support, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END, 6) AS f1 FROM m""")
def probe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics from predictions; here the nearest neighbour's label stands for the prediction."""
    v = B.vectors(spark, sf_dir)
    g = v.select("id", "grp")
    said = R.top_k(v, v, 1).join(g.select(F.col("id").alias("q"), F.col("grp").alias("label")), "q").join(g.select(F.col("id").alias("c"), F.col("grp").alias("predicted")), "c")
    return M.confusion_metrics(said).select("label", "support", *[r6(c).alias(c) for c in ("recall", "precision", "f1")])


@query("match_outcome")
def match_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a game from both teams' vectors, against the majority; with fewer than ten games all figures are 0."""
    g = games(spark, sf_dir).select(F.col("game").alias("id"), F.array("home_x", "home_y", "away_x", "away_y").alias("vec"), "outcome")
    n = g.count()
    if n < 10:
        return spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("majority"))
    held = g.withColumn("held", uniform(F.lit("mo"), "id") < 0.3)
    said = M.probe(held.where("not held"), held.where("held"), "outcome")
    accuracy = said.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    top = held.where("held").groupBy("outcome").count().agg((F.max("count") / F.sum("count")).alias("majority"))
    return accuracy.join(F.broadcast(top))
