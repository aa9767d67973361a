"""How the library's logical tables are made from the given ones, and the same in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import doubles
from lodestone.plans.staging import table

#: Start of a WITH clause: logical tables in SQL. Each query's SQL goes on with a comma or a SELECT.
SQL = """WITH actions AS (
 SELECT event_id AS action_id, user_id AS player, datediff('day', DATE '2024-01-01', CAST(ts AS DATE))::BIGINT AS game, CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period,
  ((hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS t, user_id % 2 AS team,
  CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'dribble' WHEN 'purchase' THEN 'shot' WHEN 'error' THEN 'tackle' ELSE 'cross' END AS type,
  value >= 20 AS ok, floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5.0)::BIGINT AS season, event_id % 5 AS competition,
  (value * 7) % 105 AS x0, (value * 11) % 68 AS y0, (value * 21) % 105 AS x1, (value * 33) % 68 AS y1, row_number() OVER () AS ignored FROM events),
vecs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label AS grp FROM embeddings),
units AS (SELECT id, grp, list_transform(vec, lambda x: x / CASE WHEN sqrt(list_dot_product(vec, vec)) < 1e-12 THEN 1 ELSE sqrt(list_dot_product(vec, vec)) END) AS vec FROM vecs),
pairs AS (SELECT x, y FROM (SELECT vec_id AS x, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings) WHERE y IS NOT NULL AND x % 3 <> 0
 UNION ALL SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
edges AS (SELECT DISTINCT q, r FROM (SELECT x AS q, y AS r FROM pairs UNION ALL SELECT y, x FROM pairs) WHERE q <> r)"""

SIMS = SQL + """,
sims AS (SELECT a.id AS q, b.id AS c, a.grp AS qg, b.grp AS cg, round(list_dot_product(a.vec, b.vec), 12) AS s FROM units a, units b),
orders AS (SELECT q, c, qg, cg, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN c = q THEN 1 ELSE 0 END, s DESC, c) - 1 AS rank_all,
  row_number() OVER (PARTITION BY q ORDER BY CASE WHEN c = q OR qg <> cg THEN 1 ELSE 0 END, CASE WHEN c = q OR qg <> cg THEN 0 ELSE -s END, c) - 1 AS rank_group FROM sims),
ranks AS (SELECT e.q, e.r, rank_all, rank_group FROM edges e JOIN orders o ON e.q = o.q AND e.r = o.c),
long_ranks AS (SELECT q, r, 'all' AS scope, rank_all AS rank FROM ranks UNION ALL SELECT q, r, 'group', rank_group FROM ranks),
placed AS (SELECT *, row_number() OVER (PARTITION BY scope, q ORDER BY rank) AS j FROM long_ranks),
per_query AS (SELECT scope, q, CAST(min(rank) < 1 AS DOUBLE) AS hit_1, CAST(min(rank) < 5 AS DOUBLE) AS hit_5, CAST(min(rank) < 10 AS DOUBLE) AS hit_10,
  avg(CAST(rank < 10 AS DOUBLE)) AS recall_10, 1.0 / (min(rank) + 1) AS mrr, avg(j / (rank + 1.0)) AS ap FROM placed GROUP BY scope, q)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered action log from the events table."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("player"), day.alias("game"), F.when(F.hour("ts") < 12, 1).otherwise(2).alias("period"),
        (F.hour("ts") % 12 * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("t"), (F.col("user_id") % 2).alias("team"),
        F.when(kind == "view", "pass").when(kind == "click", "dribble").when(kind == "purchase", "shot").when(kind == "error", "tackle").otherwise("cross").alias("type"),
        (F.col("value") >= 20).alias("ok"), F.floor(day / 5.0).cast("long").alias("season"), (F.col("event_id") % 5).alias("competition"),
        (F.col("value") * 7 % 105).alias("x0"), (F.col("value") * 11 % 68).alias("y0"), (F.col("value") * 21 % 105).alias("x1"), (F.col("value") * 33 % 68).alias("y1"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec array<double>, grp) from the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("vec"), F.col("label").alias("grp"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs (x, y): neighbours within a label, and a few across labels."""
    e = table(spark, sf_dir, "embeddings")
    follows = e.select(F.col("vec_id").alias("x"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("y"))
    near = e.select((F.col("vec_id") - 1).alias("x"), F.col("vec_id").alias("y")).where("x % 50 = 0 and x >= 0")
    return follows.where("y is not null and x % 3 <> 0").unionByName(near.join(e.select(F.col("vec_id").alias("x")), "x", "left_semi"))


#: Methods compared: the vectors themselves, their first half, and random ones.
METHODS = ("full", "half", "random")

#: Nearest others of each vector, by place.
TOP_SQL = SIMS + ", top AS (SELECT q, c, qg, cg, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS place FROM sims WHERE q <> c)"
