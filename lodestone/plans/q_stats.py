"""Queries of graph clusters and clustered inference."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import r6
from lodestone.operators import inference as I
from lodestone.operators import ranking as R
from lodestone.operators.graph import connected_components
from lodestone.operators.quantiles import exact_quantiles
from lodestone.operators.resampling import tree_sql
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SIMS, SQL
from lodestone.plans.q_vectors import RANDOM, method_vectors
from lodestone.plans.registry import query
from lodestone.plans.staging import scratch_path, scratch_root, stage, table
from lodestone.sources.store import KeyedTable, reused

#: A sparse graph with many components: every third vector is linked within its label, by blocks of twenty ids.
LINKS = ", gl AS (SELECT id AS a, lead(id) OVER (PARTITION BY grp, id // 100 ORDER BY id) AS b FROM units), gr AS (SELECT a, b FROM gl WHERE b IS NOT NULL UNION SELECT b, a FROM gl WHERE b IS NOT NULL)"
COMP = SQL.replace("WITH actions", "WITH RECURSIVE actions") + LINKS + """, cc(node, comp) AS (SELECT a, a FROM gr UNION SELECT gr.b, cc.comp FROM cc JOIN gr ON gr.a = cc.node AND cc.comp < gr.b), co AS (SELECT node, min(comp) AS component FROM (SELECT node, comp FROM cc UNION ALL SELECT b, least(a, b) FROM gr) GROUP BY node)"""


def links(spark: SparkSession, sf_dir: str, pool: Column | None = None) -> DataFrame:
    v = B.vectors(spark, sf_dir).select("id", "grp", F.floor(F.col("id") / 100).alias("part"), (F.lit(0) if pool is None else pool).alias("pool"))
    return v.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("grp", "part", "pool").orderBy("id")).alias("dst")).where("dst is not null")


def clusters(spark: SparkSession, sf_dir: str, pool: Column | None = None) -> DataFrame:
    """(q, cluster): the component (within the pool, if one is given), or -q-1 for a query without links."""
    found = connected_components(links(spark, sf_dir, pool)).select(F.col("node").alias("q"), F.col("component"))
    return B.vectors(spark, sf_dir).select(F.col("id").alias("q")).join(found, "q", "left").select("q", F.coalesce("component", -F.col("q") - 1).alias("cluster"))


CLUSTER = COMP + ", cl AS (SELECT id AS q, coalesce(component, -id - 1) AS cluster FROM units LEFT JOIN co ON node = id)"


@query("components", COMP + " SELECT node, component FROM co")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(links(spark, sf_dir))


@query("cluster_sizes", CLUSTER + " SELECT cluster, count(*) AS n FROM cl GROUP BY cluster ORDER BY n DESC, cluster LIMIT 12")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(12)


# Metrics by method: the average precision of each query under each method of the registry, in both scopes.
def _method_sql(name: str, vec: str) -> str:
    return f"""{name}_u AS (SELECT id, grp, {vec} AS w FROM vecs),
{name}_n AS (SELECT id, grp, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS vec FROM {name}_u),
{name}_s AS (SELECT a.id AS q, b.id AS c, a.grp AS qg, b.grp AS cg, round(list_dot_product(a.vec, b.vec), 12) AS s FROM {name}_n a, {name}_n b),
{name}_o AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN c = q THEN 1 ELSE 0 END, s DESC, c) - 1 AS rank_all,
 row_number() OVER (PARTITION BY q ORDER BY CASE WHEN c = q OR qg <> cg THEN 1 ELSE 0 END, CASE WHEN c = q OR qg <> cg THEN 0 ELSE -s END, c) - 1 AS rank_group FROM {name}_s),
{name}_r AS (SELECT e.q, 'all' AS scope, rank_all AS rank FROM edges e JOIN {name}_o o ON e.q = o.q AND e.r = o.c UNION ALL SELECT e.q, 'group', rank_group FROM edges e JOIN {name}_o o ON e.q = o.q AND e.r = o.c),
{name}_p AS (SELECT scope, q, avg(j / (rank + 1.0)) AS ap, 1.0 / (min(rank) + 1) AS mrr FROM (SELECT *, row_number() OVER (PARTITION BY scope, q ORDER BY rank) AS j FROM {name}_r) GROUP BY scope, q)"""


DIFF = CLUSTER + ", " + _method_sql("fu", "vec") + ", " + _method_sql("ha", "vec[1:32]") + """,
df AS (SELECT a.scope, a.q, cluster, a.ap - b.ap AS value, a.ap AS ap_full, b.ap AS ap_half FROM fu_p a JOIN ha_p b USING (scope, q) JOIN cl USING (q))"""


def average_precision(found: DataFrame) -> DataFrame:
    """scope, q, ap, mrr from ranks in both scopes."""
    both = found.select("q", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"rank_{s}").alias("rank")) for s in ("all", "group")])).alias("x")).select("q", "x.*")
    placed = both.withColumn("j", F.row_number().over(Window.partitionBy("scope", "q").orderBy("rank")))
    return placed.groupBy("scope", "q").agg(F.avg(F.col("j") / (F.col("rank") + 1)).alias("ap"), (1 / (F.min("rank") + 1)).alias("mrr"))


def method_metrics(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """method, scope, q, ap, mrr."""
    v = method_vectors(spark, sf_dir, method).select("id", "vec", "grp")
    found = R.rank_counts(v, R.relevance_edges(B.pairs(spark, sf_dir)))
    return average_precision(found).withColumn("method", F.lit(method))


def diffs(spark: SparkSession, sf_dir: str, a: str = "full", b: str = "half") -> DataFrame:
    """scope, q, cluster, value: a's average precision less b's, staged since several statistics read it."""
    left = method_metrics(spark, sf_dir, a).select("scope", "q", F.col("ap").alias("ap_full"))
    right = method_metrics(spark, sf_dir, b).select("scope", "q", F.col("ap").alias("ap_half"))
    both = left.join(right, ["scope", "q"]).join(clusters(spark, sf_dir), "q")
    return stage(both.select("scope", "q", "cluster", (F.col("ap_full") - F.col("ap_half")).alias("value"), "ap_full", "ap_half"), "diffs")


#: Replicates of the bootstraps, as registered. Their SQL is for at most 1,024 units in a group.
REPLICATES = 10_000
PB = """, un AS (SELECT scope, value AS total, 1 AS n, row_number() OVER (PARTITION BY scope ORDER BY q) - 1 AS idx, count(*) OVER (PARTITION BY scope) AS k FROM df)""" + tree_sql("mn", "un", "scope", REPLICATES, "pb") + """,
 pb AS (SELECT scope, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(1, 2.0 * least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) / count(*)) AS p_raw FROM mn GROUP BY scope)"""
BB = """, bu AS (SELECT scope, total, n, row_number() OVER (PARTITION BY scope ORDER BY cluster) - 1 AS idx, count(*) OVER (PARTITION BY scope) AS k FROM (SELECT scope, cluster, sum(value) AS total, count(*) AS n FROM df GROUP BY scope, cluster))""" + tree_sql("bm", "bu", "scope", REPLICATES, "bb") + """,
 bb AS (SELECT scope, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(1, 2.0 * (least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) + 1) / (count(*) + 1)) AS p FROM bm GROUP BY scope)"""


@query("paired_bootstrap", DIFF + PB + ", me AS (SELECT scope, avg(value) AS mean FROM df GROUP BY scope) SELECT scope, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p_raw, 6) AS p FROM me JOIN pb USING (scope)")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.paired_bootstrap(diffs(spark, sf_dir), REPLICATES, "pb", "scope")
    return found.select("scope", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"), r6("p_raw").alias("p"))


@query("block_bootstrap", DIFF + BB + ", me AS (SELECT scope, avg(value) AS mean FROM df GROUP BY scope) SELECT scope, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM me JOIN bb USING (scope)")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.block_bootstrap(diffs(spark, sf_dir), REPLICATES, "bb", "scope")
    return found.select("scope", *[r6(c).alias(c) for c in ("mean", "low", "high", "p")])


@query("clustered_ci", (DIFF + BB).replace("sum(value) AS total", "sum(ap_full) AS total") + ", me AS (SELECT scope, avg(ap_full) AS mean FROM df GROUP BY scope) SELECT scope, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM me JOIN bb USING (scope)")
def clustered_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = diffs(spark, sf_dir).withColumn("value", F.col("ap_full"))
    return I.block_bootstrap(values, REPLICATES, "bb", "scope").select("scope", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query("mean_ci", (DIFF + PB).replace("value AS total, 1 AS n", "ap_full AS total, 1 AS n") + ", me AS (SELECT scope, avg(ap_full) AS mean FROM df GROUP BY scope) SELECT scope, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM me JOIN pb USING (scope)")
def mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = diffs(spark, sf_dir).withColumn("value", F.col("ap_full"))
    return I.paired_bootstrap(values, REPLICATES, "pb", "scope").select("scope", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query("naive_vs_block", DIFF + PB + BB + " SELECT scope, round(pb.high - pb.low, 6) AS naive_width, round(bb.high - bb.low, 6) AS block_width FROM pb JOIN bb USING (scope)")
def naive_vs_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffs(spark, sf_dir)
    a = I.paired_bootstrap(d, REPLICATES, "pb", "scope").select("scope", r6(F.col("high") - F.col("low")).alias("naive_width"))
    return a.join(I.block_bootstrap(d, REPLICATES, "bb", "scope").select("scope", r6(F.col("high") - F.col("low")).alias("block_width")), "scope")


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of a t value, by Simpson's rule over the density."""
    area = f"(SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs({t}) * i / 2000.0, 2) / ({df}), -(({df}) + 1) / 2.0)) FROM (SELECT unnest(range(0, 2001)) AS i)) * abs({t}) / 6000.0"
    return f"(1 - 2 * {area} * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()))"


#: Quantiles .975 and .8 of the t distribution for each df of ``dfs``, from a cumulated density.
TQ = """, tg AS (SELECT df, i * 1e-4 AS x, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + i * i * 1e-8 / df, -(df + 1) / 2.0) AS f FROM dfs, (SELECT unnest(range(0, 60001)) AS i)),
 th AS (SELECT df, x, f, sum(f) OVER w * 1e-4 - f * 0.5e-4 AS c FROM tg WINDOW w AS (PARTITION BY df ORDER BY x)), tk AS (SELECT df, x, c - first_value(f) OVER w * 0.5e-4 AS c FROM th WINDOW w AS (PARTITION BY df ORDER BY x)),
 tl AS (SELECT df, x, c, lag(c) OVER (PARTITION BY df ORDER BY x) AS b FROM tk), tq AS (SELECT df, max(CASE WHEN b < 0.475 AND c >= 0.475 THEN x - 1e-4 * (c - 0.475) / (c - b) END) AS t975, max(CASE WHEN b < 0.3 AND c >= 0.3 THEN x - 1e-4 * (c - 0.3) / (c - b) END) AS t80 FROM tl GROUP BY df)"""


def tested_sql(source: str, *keys: str) -> str:
    """CTEs that test ``source`` (keys, cluster, value) by block bootstrap (xb: mean, low, high, p_block) and cluster t (xt: by_cluster,
    se, clusters, t, p_t)."""
    by = ", ".join(keys)
    return f""", xc AS (SELECT {by}, cluster, sum(value) AS total, count(*) AS n, avg(value) AS m FROM {source} GROUP BY {by}, cluster), xi AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cluster) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS k FROM xc)""" + tree_sql("xm", "xi", by, REPLICATES, "bb") + f""",
 xq AS (SELECT {by}, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(1, 2.0 * (least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) + 1) / (count(*) + 1)) AS p_block FROM xm GROUP BY {by}),
 xb AS (SELECT * FROM (SELECT {by}, sum(total) / sum(n) AS mean, sum(n)::BIGINT AS n FROM xc GROUP BY {by}) JOIN xq USING ({by})),
 xs AS (SELECT {by}, avg(m) AS by_cluster, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS clusters FROM xc GROUP BY {by}), xt AS (SELECT *, by_cluster / se AS t, {t_p_sql('by_cluster / se', 'clusters - 1')} AS p_t FROM xs)"""


def tested(values: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean, low, high, p_block, by_cluster, se, clusters, t, p_t, mde, power of (keys, cluster, value)."""
    boot = I.block_bootstrap(values, REPLICATES, "bb", *keys).withColumnRenamed("p", "p_block")
    by = I.cluster_t(values, *keys).withColumnsRenamed({"mean": "by_cluster", "p": "p_t"})
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(boot, list(keys)).join(by, list(keys))


CT = ", cm AS (SELECT scope, cluster, avg(value) AS m FROM df GROUP BY scope, cluster), ct AS (SELECT scope, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS clusters FROM cm GROUP BY scope)"


@query("cluster_t", DIFF + CT + " SELECT scope, round(mean, 6) AS mean, round(se, 6) AS se, clusters, round(mean / se, 6) AS t, round(" + t_p_sql("mean / se", "clusters - 1") + ", 6) AS p FROM ct")
def cluster_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_t(diffs(spark, sf_dir), "scope").select("scope", r6("mean").alias("mean"), r6("se").alias("se"), "clusters", r6("t").alias("t"), r6("p").alias("p"))


@query("mde", DIFF + CT + ", dfs AS (SELECT DISTINCT clusters - 1 AS df FROM ct)" + TQ + " SELECT scope, round(se, 6) AS se, round(" + t_p_sql("mean / se", "clusters - 1") + ", 6) AS p, round((t975 + t80) * se, 6) AS mde FROM ct JOIN tq ON df = clusters - 1")
def mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_t(diffs(spark, sf_dir), "scope").select("scope", r6("se").alias("se"), r6("p").alias("p"), r6("mde").alias("mde"))


@query("power")
def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_t(diffs(spark, sf_dir), "scope").select("scope", "mean", "power")


HOLM_P = ", tests AS (SELECT l_returnflag || l_linestatus AS name, round((sum(l_quantity) % 97) / 970.0, 6)::DOUBLE AS p FROM lineitem GROUP BY 1)"


@query("holm", SQL + HOLM_P + ", s AS (SELECT *, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS threshold FROM tests) SELECT name, p, round(threshold, 6) AS threshold, min(CASE WHEN p <= threshold THEN 1 ELSE 0 END) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM s")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.round((F.sum("l_quantity").cast("double") % 97) / 970, 6).alias("p"))
    return I.holm(sums).select("name", "p", r6("threshold").alias("threshold"), "rejected")


@query("tost", DIFF + BB + " SELECT scope, low > -0.2 AND high < 0.2 AS equivalent, low > -0.005 AND high < 0.005 AS equivalent_narrow FROM bb")
def tost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.block_bootstrap(diffs(spark, sf_dir), REPLICATES, "bb", "scope")
    low, high = F.col("low"), F.col("high")
    return found.select("scope", I.equivalent(low, high, 0.2).alias("equivalent"), I.equivalent(low, high).alias("equivalent_narrow"))


ALL_METHODS = CLUSTER + RANDOM + ", " + ", ".join(_method_sql(n, v) for n, v in (("fu", "vec"), ("ha", "vec[1:32]"))) + ", " + _method_sql("ra", "vec").replace("FROM vecs)", "FROM (SELECT rv.id, rv.vec, vecs.grp FROM rv JOIN vecs USING (id)))") + """,
ms AS (SELECT 'full' AS method, * FROM fu_p UNION ALL SELECT 'half', * FROM ha_p UNION ALL SELECT 'random', * FROM ra_p)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods' metrics with each query's cluster, written once."""
    parts = [method_metrics(spark, sf_dir, m) for m in B.METHODS]
    return stage(parts[0].unionByName(parts[1]).unionByName(parts[2]).join(clusters(spark, sf_dir), "q"), "methods")


@query("method_ranking", ALL_METHODS + " SELECT scope, method, round(avg(ap), 6) AS map, row_number() OVER (PARTITION BY scope ORDER BY round(avg(ap), 9) DESC, method) AS place FROM ms GROUP BY scope, method")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metrics(spark, sf_dir).groupBy("scope", "method").agg(F.avg("ap").alias("map"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(F.round("map", 9)), "method"))).withColumn("map", r6("map"))


ANCHORED = ", d AS (SELECT x.method, x.scope, cl.cluster, y.ap - x.ap AS value FROM ms x JOIN ms y ON y.method = 'full' AND y.scope = x.scope AND y.q = x.q JOIN cl ON cl.q = x.q WHERE x.method <> 'full')"


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, scope, cluster, value: what the full vectors gain over each other method."""
    m = metrics(spark, sf_dir)
    anchor = m.where("method = 'full'").select("scope", "q", F.col("ap").alias("anchor"))
    return m.where("method <> 'full'").join(anchor, ["scope", "q"]).select("method", "scope", "cluster", (F.col("anchor") - F.col("ap")).alias("value"))


@query("vs_anchor", ALL_METHODS + ANCHORED + tested_sql("d", "method", "scope") + " SELECT method, scope, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p_block, 6) AS p_block, round(by_cluster, 6) AS by_cluster, clusters, round(t, 6) AS t, round(p_t, 6) AS p_t FROM xb JOIN xt USING (method, scope)")
def vs_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method against the anchor, by block bootstrap and by cluster t."""
    found = tested(anchored(spark, sf_dir), "method", "scope")
    return found.select("method", "scope", *[r6(c).alias(c) for c in ("mean", "low", "high", "p_block", "by_cluster")], "clusters", r6("t").alias("t"), r6("p_t").alias("p_t"))


@query("method_spread", ALL_METHODS + ANCHORED + """, m AS (SELECT scope, method, avg(ap) AS v FROM ms GROUP BY scope, method), sp AS (SELECT scope, max(v) - max(CASE WHEN method = 'random' THEN v END) AS spread FROM m GROUP BY scope),
 c AS (SELECT method, scope, cluster, avg(value) AS m FROM d GROUP BY ALL), ct AS (SELECT method, scope, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS clusters FROM c GROUP BY ALL), dfs AS (SELECT DISTINCT clusters - 1 AS df FROM ct)""" + TQ + """,
 dm AS (SELECT scope, method, mean, (t975 + t80) * se AS mde FROM ct JOIN tq ON df = clusters - 1) SELECT scope, round(spread, 6) AS spread, round(quantile_cont(mde, 0.5), 6) AS median_mde, count(*) FILTER (abs(mean) >= mde) AS n_detectable, count(*) AS n_compared FROM dm JOIN sp USING (scope) GROUP BY scope, spread""")
def method_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best method less random, the median least detectable effect of the comparisons with the anchor, and how many of these exceed it."""
    m = metrics(spark, sf_dir)
    means = m.groupBy("scope", "method").agg(F.avg("ap").alias("v"))
    spread = means.groupBy("scope").agg(r6(F.max("v") - F.max(F.when(F.col("method") == "random", F.col("v")))).alias("spread"))
    anchor = m.where("method = 'full'").select("scope", "q", F.col("ap").alias("anchor"))
    values = m.where("method <> 'full'").join(anchor, ["scope", "q"]).select("method", "scope", "cluster", (F.col("anchor") - F.col("ap")).alias("value"))
    by = I.cluster_t(values, "method", "scope").groupBy("scope").agg(r6(F.percentile("mde", 0.5)).alias("median_mde"), F.count_if(F.abs("mean") >= F.col("mde")).alias("n_detectable"), F.count(F.lit(1)).alias("n_compared"))
    return spread.join(by, "scope")


COMPARISONS = (("full", "random"), ("full", "half"), ("half", "random"))
FAMILY = ALL_METHODS + """, c AS (SELECT * FROM (VALUES ('full', 'random'), ('full', 'half'), ('half', 'random')) v(a, b)), l AS (SELECT method, scope, q, 'ap' AS metric, ap AS v FROM ms UNION ALL SELECT method, scope, q, 'mrr', mrr FROM ms),
 d AS (SELECT a, b, x.scope, x.metric, cluster, x.v - y.v AS value FROM c JOIN l x ON x.method = a JOIN l y ON y.method = b AND y.scope = x.scope AND y.q = x.q AND y.metric = x.metric JOIN cl ON cl.q = x.q)"""


@query("comparison_family", FAMILY + tested_sql("d", "a", "b", "scope", "metric") + """, h AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY scope, metric) AS m FROM xb JOIN xt USING (a, b, scope, metric) WINDOW w AS (PARTITION BY scope, metric ORDER BY p_t, a || '-' || b)), g AS (SELECT *, 0.05 / (m - i + 1) AS threshold FROM h)
 SELECT a, b, scope, metric, n, round(mean, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, round(p_block, 6) AS p_block, round(by_cluster, 6) AS by_cluster, round(p_t, 6) AS p_t, round(threshold, 6) AS threshold, min(CASE WHEN p_t <= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY scope, metric ORDER BY p_t, a || '-' || b ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM g""")
def comparison_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparison by scope and metric: block bootstrap, cluster t, and a step-down correction within scope and metric."""
    long = metrics(spark, sf_dir).unpivot(["method", "scope", "q", "cluster"], ["ap", "mrr"], "metric", "v")
    family = spark.createDataFrame(list(COMPARISONS), "a string, b string")
    x, y = long.select(F.col("method").alias("a"), "scope", "q", "metric", "cluster", F.col("v").alias("va")), long.select(F.col("method").alias("b"), "scope", "q", "metric", F.col("v").alias("vb"))
    both = x.join(F.broadcast(family), "a").join(y, ["b", "scope", "q", "metric"]).select("a", "b", "scope", "metric", "cluster", (F.col("va") - F.col("vb")).alias("value"))
    found = tested(stage(both, "family"), "a", "b", "scope", "metric").withColumn("name", F.concat_ws("-", "a", "b"))
    return I.holm(found, "name", "p_t", 0.05, "scope", "metric").select("a", "b", "scope", "metric", "n", r6("mean").alias("diff"), *[r6(c).alias(c) for c in ("low", "high", "p_block", "by_cluster", "p_t", "threshold")], "rejected")


GROUPS = """, vx AS (SELECT id, grp, vec[1] AS x FROM vecs), vt AS (SELECT quantile_cont(x, 1 / 3.0) AS lo, quantile_cont(x, 2 / 3.0) AS hi FROM vx), gv AS (SELECT id, 'label' AS kind, grp::VARCHAR AS part FROM vx UNION ALL SELECT id, 'value', CASE WHEN x <= lo THEN 'low' WHEN x <= hi THEN 'mid' ELSE 'high' END FROM vx, vt),
 g AS (SELECT scope, kind, part, q, value FROM df JOIN gv ON id = q), gn AS (SELECT scope, kind, part, value AS total, 1 AS n, row_number() OVER (PARTITION BY scope, kind, part ORDER BY q) - 1 AS idx, count(*) OVER (PARTITION BY scope, kind, part) AS k FROM g)""" + tree_sql("gm", "gn", "scope, kind, part", REPLICATES, "pb") + """,
 gi AS (SELECT scope, kind, part, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM gm GROUP BY ALL)"""


@query("heterogeneity", DIFF + GROUPS + " SELECT scope, kind, part, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT scope, kind, part, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM g GROUP BY ALL) JOIN gi USING (scope, kind, part) WHERE kind = 'value' OR n >= 20")
def heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference within each label of twenty queries or more, and within each third of a value, with intervals."""
    v = B.vectors(spark, sf_dir).select(F.col("id").alias("q"), "grp", F.col("vec")[0].alias("x"))
    low, high = exact_quantiles(v, {"x": [1 / 3, 2 / 3]})["x"]
    third = F.when(F.col("x") <= low, "low").when(F.col("x") <= high, "mid").otherwise("high")
    parts = v.select("q", F.lit("label").alias("kind"), F.col("grp").cast("string").alias("part")).unionByName(v.select("q", F.lit("value").alias("kind"), third.alias("part")))
    d = stage(diffs(spark, sf_dir).join(parts, "q").select("scope", "kind", "part", "q", "value"), "parts")
    keys = ("scope", "kind", "part")
    by = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.stddev_samp("value")).alias("std"))
    found = by.join(I.paired_bootstrap(d, REPLICATES, "pb", *keys), list(keys)).where("kind = 'value' or n >= 20")
    return found.select(*keys, "n", r6("mean").alias("mean"), "std", r6("low").alias("low"), r6("high").alias("high"))


@query("fair_compare", DIFF + CT + BB + ", me AS (SELECT scope, avg(value) AS pooled FROM df GROUP BY scope) SELECT scope, round(pooled, 6) AS pooled, round(mean, 6) AS by_cluster, round(p, 6) AS p_block, round(" + t_p_sql("mean / se", "clusters - 1") + ", 6) AS p_t, pooled > 0 AND p < 0.05 AND " + t_p_sql("mean / se", "clusters - 1") + " < 0.05 AS beats FROM me JOIN bb USING (scope) JOIN ct USING (scope)")
def fair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both targets side by side: the mean pooled over queries and the mean of cluster means; a win needs a gain and both tests below 0.05."""
    found = tested(diffs(spark, sf_dir), "scope")
    beats = (F.col("mean") > 0) & (F.col("p_block") < 0.05) & (F.col("p_t") < 0.05)
    return found.select("scope", r6("mean").alias("pooled"), r6("by_cluster").alias("by_cluster"), r6("p_block").alias("p_block"), r6("p_t").alias("p_t"), beats.alias("beats"))


def _pooled(sql: str) -> str:
    """The same within two disjoint pools, by parity of the id: candidates, edges and links of one pool only."""
    sql = re.sub(r"FROM (\w+)_n a, \1_n b", r"FROM \1_n a JOIN \1_n b ON a.id % 2 = b.id % 2", sql)
    return sql.replace("UNION ALL SELECT y, x FROM pairs) WHERE q <> r)", "UNION ALL SELECT y, x FROM pairs) WHERE q <> r AND q % 2 = r % 2)").replace("PARTITION BY grp, id // 100 ", "PARTITION BY grp, id // 100, id % 2 ")


POOL_ROWS = """, d AS (SELECT x.q % 2 AS pool, x.method, x.scope, cl.cluster, y.ap - x.ap AS value FROM ms x JOIN ms y ON y.method = 'full' AND y.scope = x.scope AND y.q = x.q JOIN cl ON cl.q = x.q WHERE x.method <> 'full')"""


@query("pool_replication", _pooled(ALL_METHODS) + POOL_ROWS + tested_sql("d", "pool", "method", "scope") + """, pr AS (SELECT * FROM xb JOIN xt USING (pool, method, scope)), ph AS (SELECT pool, min(CASE WHEN method = 'half' AND scope = 'group' THEN CASE WHEN mean >= -0.001 THEN 1 ELSE 0 END WHEN method = 'random' AND scope = 'all' THEN CASE WHEN mean > 0 AND p_block < 0.05 THEN 1 ELSE 0 END END) = 1 AS holds FROM pr GROUP BY pool)
 SELECT pool, method, scope, n, clusters, round(mean, 6) AS diff, round(p_block, 6) AS p_block, round(p_t, 6) AS p_t, holds FROM pr JOIN ph USING (pool)""")
def pool_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparisons with the anchor within two disjoint pools, components found anew in each.

    The pattern holds in a pool if the half vectors don't beat the full ones within groups, and the full ones beat random ones.
    """
    edges, parts = R.relevance_edges(B.pairs(spark, sf_dir)), []
    for pool in (0, 1):
        own = edges.where((F.col("q") % 2 == pool) & (F.col("r") % 2 == pool))
        for method in B.METHODS:
            v = method_vectors(spark, sf_dir, method).where(F.col("id") % 2 == pool).select("id", "vec", "grp")
            parts.append(average_precision(R.rank_counts(v, own)).select(F.lit(method).alias("method"), "scope", "q", "ap"))
    every = functools.reduce(DataFrame.unionByName, parts).join(clusters(spark, sf_dir, F.col("id") % 2), "q")
    m = stage(every.withColumn("pool", F.col("q") % 2), "pools")
    anchor = m.where("method = 'full'").select("scope", "q", F.col("ap").alias("anchor"))
    values = stage(m.where("method <> 'full'").join(anchor, ["scope", "q"]).select("pool", "method", "scope", "cluster", (F.col("anchor") - F.col("ap")).alias("value")), "pooled")
    found = stage(tested(values, "pool", "method", "scope"), "replicated")
    ok = F.when((F.col("method") == "half") & (F.col("scope") == "group"), F.col("mean") >= -0.001).when((F.col("method") == "random") & (F.col("scope") == "all"), (F.col("mean") > 0) & (F.col("p_block") < 0.05))
    return found.join(found.groupBy("pool").agg(F.bool_and(ok).alias("holds")), "pool").select("pool", "method", "scope", "n", "clusters", r6("mean").alias("diff"), r6("p_block").alias("p_block"), r6("p_t").alias("p_t"), "holds")


@query("seed_upsert", """WITH o AS (SELECT o_custkey AS seed, o_orderkey AS ord, o_totalprice::DOUBLE AS v FROM orders), k AS (SELECT seed, max_by(v, ord) AS v FROM o GROUP BY seed)
 SELECT count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, bool_and(v > 0) AS all_positive, count(*) FILTER (v < 150000) AS n_below FROM k""")
def seed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by seed, merged into a stored table as they come (here in two parts), the last of each seed counting; then in summary."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").cast("double").alias("v"))
    results = KeyedTable(spark, scratch_path(spark, "results"), ["seed"], 8)
    early = F.col("ord") % 7 < 3
    for rows in (o.where(early), o.where(~early)):
        known = results.read()
        # A later part may hold an older result of a seed; the one that counts is chosen before it is merged.
        results.upsert(rows if known is None else rows.unionByName(known.join(rows.select("seed").distinct(), "seed", "left_semi")), "ord")
    return results.read().agg(F.count(F.lit(1)).alias("seeds"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), F.bool_and(F.col("v") > 0).alias("all_positive"), F.count_if(F.col("v") < 150000).alias("n_below"))


@query("stored_representation", "SELECT user_id AS player, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stored_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by player and kind, built from the log at the first call and read from the stored table at the next."""
    log = f"{sf_dir}/events.parquet"

    def build() -> DataFrame:
        return spark.read.parquet(log).groupBy(F.col("user_id").alias("player"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))

    return reused(spark, scratch_root(spark), "by_kind", build, [log], version=1)
