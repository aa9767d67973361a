"""Queries of the retrieval evaluation: ranks, metrics, nearest neighbours, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import dot, l2, r6
from lodestone.operators import ranking as R
from lodestone.operators.quantiles import exact_quantiles
from lodestone.operators.ranking import identity_ranks
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SIMS, SQL, TOP_SQL
from lodestone.plans.registry import query
from lodestone.plans.staging import stage, table

NAMES = ("hit_1", "hit_5", "hit_10", "recall_10", "mrr", "ap")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_counts(B.vectors(spark, sf_dir), R.relevance_edges(B.pairs(spark, sf_dir)))


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, q and the metrics, for both scopes from one pass over the blocks."""
    return scoped(ranks(spark, sf_dir))


def scoped(found: DataFrame) -> DataFrame:
    """scope, q and the metrics of ranks in both scopes, which are read once."""
    both = found.select("q", F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.col("rank_all").alias("rank")), F.struct(F.lit("group").alias("scope"), F.col("rank_group").alias("rank")))).alias("x")).select("q", "x.*")
    placed = both.withColumn("j", F.row_number().over(Window.partitionBy("scope", "q").orderBy("rank")))
    first = F.min("rank")
    return placed.groupBy("scope", "q").agg(
        *[(first < k).cast("double").alias(f"hit_{k}") for k in R.KS], F.avg((F.col("rank") < 10).cast("double")).alias("recall_10"),
        (1 / (first + 1)).alias("mrr"), F.avg(F.col("j") / (F.col("rank") + 1)).alias("ap"),
    )


def _rounded(prefix: str = "") -> str:
    return ", ".join(f"round(avg({prefix}{n}), 4) AS {n}" for n in NAMES)


@query("evaluate_submission", SIMS + f" SELECT scope, count(*) AS n_queries, (SELECT count(*) FROM units) AS pool_size, {_rounded()} FROM per_query GROUP BY scope")
def evaluate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = B.vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("pool_size"))
    report = per_query(spark, sf_dir).groupBy("scope").agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(n), 4).alias(n) for n in NAMES])
    return report.join(F.broadcast(pool)).select("scope", "n_queries", "pool_size", *NAMES)


@query("retrieval_metrics", SIMS + " SELECT q, r, rank_all, rank_group FROM ranks")
def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(spark, sf_dir)


@query("per_query_metrics", SIMS + ", u AS (UNPIVOT (SELECT scope, q, hit_1, hit_5, hit_10, recall_10, mrr, ap FROM per_query) ON hit_1, hit_5, hit_10, recall_10, mrr, ap INTO NAME metric VALUE value) SELECT scope, q, metric, round(value, 6) AS value FROM u")
def per_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_query(spark, sf_dir).unpivot(["scope", "q"], list(NAMES), "metric", "value").withColumn("value", r6("value"))


@query("heldout_metrics", SIMS + f" SELECT scope, count(*) AS n, {_rounded()} FROM per_query WHERE ('0x' || substr(md5('held|' || q), 1, 8))::BIGINT / 4294967296.0 < 0.3 GROUP BY scope")
def heldout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.functions.columns import uniform

    tests = B.vectors(spark, sf_dir).select(F.col("id").alias("q")).where(uniform(F.lit("held"), "q") < 0.3)
    return per_query(spark, sf_dir).join(tests, "q", "left_semi").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in NAMES])


@query("masked_pool_map", """WITH e2 AS (SELECT * FROM embeddings WHERE vec_id % 4 <> 1) """ + "," + SIMS.replace("embeddings", "e2").removeprefix("WITH") + f" SELECT scope, count(*) AS n, {_rounded()} FROM per_query GROUP BY scope")
def masked_pool_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only covered items count: as queries, as relevants and as candidates. Pairs are those of the covered items."""
    covered = B.vectors(spark, sf_dir).where("id % 4 <> 1")
    follows = covered.select(F.col("id").alias("x"), F.lead("id").over(Window.partitionBy("grp").orderBy("id")).alias("y")).where("y is not null and x % 3 <> 0")
    near = covered.select((F.col("id") - 1).alias("x"), F.col("id").alias("y")).where("x % 50 = 0 and x >= 0").join(covered.select(F.col("id").alias("x")), "x", "left_semi")
    found = R.rank_counts(covered, R.relevance_edges(follows.unionByName(near), covered))
    return scoped(found).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in NAMES])


@query("cosine_all_pairs", SIMS + " SELECT q, c, round(s, 6) AS sim FROM sims WHERE q <> c")
def cosine_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.all_pairs(B.vectors(spark, sf_dir)).withColumn("sim", r6("sim"))


@query("cosine_within_group", SIMS + " SELECT q, c, round(s, 6) AS sim FROM sims WHERE q <> c AND qg = cg")
def cosine_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.all_pairs(B.vectors(spark, sf_dir), same_group=True).withColumn("sim", r6("sim"))


TOP = TOP_SQL


@query("knn_topk", TOP + " SELECT q, c, round(s, 6) AS sim, place FROM top WHERE place <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    return R.top_k(v, v, 10).withColumn("sim", r6("sim"))


@query("vector_search", TOP + " SELECT q, c, round(s, 6) AS sim, place FROM top WHERE place <= 5 AND q % 20 = 0")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a query text's vector; the rest of the gallery is searched."""
    v = B.vectors(spark, sf_dir)
    return R.top_k(v.where("id % 20 = 0"), v, 5).withColumn("sim", r6("sim"))


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    groups = v.select("id", "grp")
    return R.top_k(v, v, k).join(groups.select(F.col("id").alias("q"), F.col("grp").alias("qg")), "q").join(groups.select(F.col("id").alias("c"), F.col("grp").alias("cg")), "c")


@query("within_zone_knn", TOP + " SELECT coalesce(qg, -1) AS grp, count(*) AS n, round(avg(CAST(qg = cg AS DOUBLE)), 6) AS agreement FROM top WHERE place <= 5 GROUP BY ROLLUP (qg)")
def within_zone_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(spark, sf_dir, 5).select(F.col("qg").alias("grp"), (F.col("qg") == F.col("cg")).cast("double").alias("same"))
    return near.rollup("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("same")).alias("agreement")).fillna(-1, "grp")


@query("zone_match", TOP + " SELECT q, round(avg(CAST(cg IN (qg, (qg + 1) % 10) AS DOUBLE)), 6) AS match_rate FROM top WHERE place <= 10 GROUP BY q")
def zone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the top ten whose label is in the query's expected set: its own label and the next."""
    expected = F.array("qg", ((F.col("qg") + 1) % 10))
    return neighbours(spark, sf_dir, 10).groupBy("q").agg(r6(F.avg(F.array_contains(expected, F.col("cg")).cast("double"))).alias("match_rate"))


@query("ndcg_binary", TOP + """, h AS (SELECT q, place, CASE WHEN qg = cg THEN 1.0 ELSE 0.0 END AS rel FROM top WHERE place <= 10),
 i AS (SELECT q, rel, place, row_number() OVER (PARTITION BY q ORDER BY rel DESC, place) AS ideal FROM h)
 SELECT q, round(CASE WHEN sum(rel) = 0 THEN 0 ELSE sum(rel / log2(place + 1)) / sum(rel / log2(ideal + 1)) END, 6) AS ndcg FROM i GROUP BY q""")
def ndcg_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@10 with label match as relevance; the ideal order is that of the ten retrieved."""
    hits = neighbours(spark, sf_dir, 10).withColumn("rel", (F.col("qg") == F.col("cg")).cast("double"))
    ideal = hits.withColumn("ideal", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rel"), "place")))
    gain, best = F.sum(F.col("rel") * R.discounted()), F.sum(F.col("rel") * R.discounted("ideal"))
    return ideal.groupBy("q").agg(r6(F.coalesce(F.try_divide(gain, best), F.lit(0.0))).alias("ndcg"))


GRADED = """, n AS (SELECT grp, count(*) AS n FROM units GROUP BY grp), w AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS d FROM (SELECT unnest(range(1, 11)) AS k)),
 h AS (SELECT q, qg, sum(CASE WHEN cg = qg THEN 3.0 WHEN cg = (qg + 1) % 10 THEN 1.0 ELSE 0.0 END / log2(place + 1)) AS dcg FROM top WHERE place <= 10 GROUP BY q, qg),
 i AS (SELECT h.q, dcg, least(10, a.n - 1) AS n3, coalesce(b.n, 0) AS n1 FROM h JOIN n a ON a.grp = h.qg LEFT JOIN n b ON b.grp = (h.qg + 1) % 10)
"""


@query("ndcg_graded", TOP + GRADED + """ SELECT q, round(dcg / (3 * coalesce(w3.d, 0) + coalesce(w1.d, 0) - coalesce(w3.d, 0)), 6) AS ndcg FROM i LEFT JOIN w w3 ON w3.k = n3 LEFT JOIN w w1 ON w1.k = least(10, n3 + n1)""")
def ndcg_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@10 with grades 3 (same label), 1 (next label) and 0; the ideal is over the whole gallery, from counts of grades."""
    sizes = B.vectors(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return graded(neighbours(spark, sf_dir, 10), sizes)


def graded(near: DataFrame, sizes: DataFrame, rounded: bool = True) -> DataFrame:
    """q, ndcg of neighbours (q, qg, cg, place) with grades 3, 1, 0, given the sizes of the labels."""
    grade = F.when(F.col("cg") == F.col("qg"), 3.0).when(F.col("cg") == (F.col("qg") + 1) % 10, 1.0).otherwise(0.0)
    dcg = near.groupBy("q", "qg").agg(F.sum(grade * R.discounted()).alias("dcg"))
    a, b = sizes.select(F.col("grp").alias("qg"), F.col("n").alias("n3")), sizes.select(F.col("grp").alias("next"), F.col("n").alias("n1"))
    known = dcg.join(F.broadcast(a), "qg").withColumn("next", (F.col("qg") + 1) % 10).join(F.broadcast(b), "next", "left")
    weight = lambda k: F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: i <= k), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    n3 = F.least(F.lit(10), F.col("n3") - 1)
    top = weight(n3)
    ideal = 3 * top + weight(F.least(F.lit(10), n3 + F.coalesce("n1", F.lit(0)))) - top
    ndcg = F.col("dcg") / ideal
    return known.select("q", (r6(ndcg) if rounded else ndcg).alias("ndcg"))


@query("cross_modal_recall", SIMS + """, t AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS place FROM sims WHERE q % 5 = 0 AND c <> q)
 SELECT round(avg(h1), 6) AS recall_1, round(avg(h5), 6) AS recall_5, round(avg(h10), 6) AS recall_10, count(*) AS n FROM (SELECT q, max(CAST(n AND place <= 1 AS DOUBLE)) AS h1,
 max(CAST(n AND place <= 5 AS DOUBLE)) AS h5, max(CAST(n AND place <= 10 AS DOUBLE)) AS h10 FROM (SELECT q, place, q % 7 = c % 7 AS n FROM t WHERE place <= 10) GROUP BY q)""")
def cross_modal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector stands for a text; a hit is a gallery item of the same name (id modulo 7; names repeat)."""
    v = B.vectors(spark, sf_dir)
    near = R.top_k(v.where("id % 5 = 0"), v, 10)
    hit = (F.col("q") % 7 == F.col("c") % 7)
    by_query = near.groupBy("q").agg(*[F.max((hit & (F.col("place") <= k)).cast("double")).alias(f"h{k}") for k in R.KS])
    return by_query.agg(*[r6(F.avg(f"h{k}")).alias(f"recall_{k}") for k in R.KS], F.count(F.lit(1)).alias("n"))


@query("alignment_score", SQL + """, p AS (SELECT round(list_dot_product(a.vec, b.vec), 12) AS s FROM pairs JOIN units a ON a.id = x JOIN units b ON b.id = y)
 SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS low, round(max(s), 6) AS high, round(stddev_pop(s), 6) AS std, round(avg(CAST(s > 0.5 AS DOUBLE)), 6) AS over_half FROM p""")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of paired vectors in summary."""
    sims = stage(paired_cosines(spark, sf_dir), "cosines")
    return sims.agg(
        r6(F.avg("s")).alias("mean"), r6(F.lit(exact_quantiles(sims, {"s": [0.5]})["s"][0])).alias("median"), r6(F.min("s")).alias("low"), r6(F.max("s")).alias("high"),
        r6(F.stddev_pop("s")).alias("std"), r6(F.avg((F.col("s") > 0.5).cast("double"))).alias("over_half"),
    )


def paired_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = R.unit_vectors(B.vectors(spark, sf_dir))
    a, b = unit.select(F.col("id").alias("x"), F.col("vec").alias("a"), "grp"), unit.select(F.col("id").alias("y"), F.col("vec").alias("b"))
    return B.pairs(spark, sf_dir).join(a, "x").join(b, "y").select("x", "y", "grp", F.round(dot("a", "b"), 12).alias("s"))


@query("label_validity", SIMS + """, p AS (SELECT x, y, s AS sxy FROM pairs JOIN sims ON q = x AND c = y),
 v AS (SELECT x, y, sxy, avg(CAST(s < sxy AS DOUBLE)) AS below, avg(s) AS other FROM p JOIN sims ON q = x AND c <> x AND qg = cg GROUP BY x, y, sxy HAVING count(*) >= 5)
 SELECT count(*) AS n, round(avg(below), 6) AS percentile, round(avg(CAST(below > 0.5 AS DOUBLE)), 6) AS over_half, round(avg(sxy), 6) AS cos_pair, round(avg(other), 6) AS cos_group FROM v""")
def label_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a pair's cosine stands among the cosines of its first item to all of its group; a pair that is there twice counts once."""
    known = paired_cosines(spark, sf_dir).select("x", "y", "s").distinct().withColumn("pair", F.monotonically_increasing_id())
    by_pair = R.standing_in_group(B.vectors(spark, sf_dir), stage(known, "known")).select("s", (F.col("below") / F.col("n")).alias("below"), (F.col("total") / F.col("n")).alias("other"), "n")
    ok = by_pair.where("n >= 5")
    return ok.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("below")).alias("percentile"), r6(F.avg((F.col("below") > 0.5).cast("double"))).alias("over_half"), r6(F.avg("s")).alias("cos_pair"), r6(F.avg("other")).alias("cos_group"))


@query("pairwise_cosine", SQL + """, p AS (SELECT list_dot_product(a.vec, b.vec) AS r, round(list_dot_product(a.vec, b.vec), 12) AS s FROM units a JOIN units b ON a.id < b.id)
 SELECT round(avg(r), 6) AS mean_all, round(min(s), 6) AS low, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75, round(max(s), 6) AS high FROM p""")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs in closed form, from the sum of the vectors; their quantiles from histograms of the pairs of blocks."""
    v = B.vectors(spark, sf_dir)
    unit = R.unit_vectors(v)
    sums = unit.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    mean = sums.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("ss")) / (F.max("n") * (F.max("n") - 1))).alias("mean_all"))
    found = R.pair_quantiles(v, [0.0, 0.25, 0.5, 0.75, 1.0])
    return mean.select(r6("mean_all").alias("mean_all"), *[r6(F.lit(x)).alias(c) for x, c in zip(found, ("low", "q25", "q50", "q75", "high"))])


@query("query_deltas", SIMS + """, d AS (SELECT q, max(ap) FILTER (scope = 'group') - max(ap) FILTER (scope = 'all') AS delta, max(ap) FILTER (scope = 'all') AS ap FROM per_query GROUP BY q)
 (SELECT 'improved' AS part, q, round(delta, 6) AS value FROM d ORDER BY round(delta, 9) DESC, q LIMIT 5) UNION ALL (SELECT 'worst', q, round(ap, 6) FROM d ORDER BY round(ap, 9), q LIMIT 5)
 UNION ALL SELECT 'category', q % 3, round(avg(ap), 6) FROM d GROUP BY q % 3""")
def query_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five queries that gain most from the group scope, the five worst, and means by category of query."""
    by = per_query(spark, sf_dir).groupBy("q").pivot("scope", ["all", "group"]).agg(F.max("ap"))
    d = by.select("q", (F.col("group") - F.col("all")).alias("delta"), F.col("all").alias("ap"))
    best = d.orderBy(F.desc(F.round("delta", 9)), "q").limit(5).select(F.lit("improved").alias("part"), "q", r6("delta").alias("value"))
    worst = d.orderBy(F.round("ap", 9), "q").limit(5).select(F.lit("worst").alias("part"), "q", r6("ap").alias("value"))
    means = d.groupBy((F.col("q") % 3).alias("q")).agg(r6(F.avg("ap")).alias("value")).select(F.lit("category").alias("part"), "q", "value")
    return best.unionByName(worst).unionByName(means)


SUBMISSION = """, sub AS (SELECT row_number() OVER (ORDER BY c_custkey) AS ord, CASE WHEN c_custkey % 3 <> 0 AND c_custkey // 3 % 4 <> 0 THEN c_custkey // 3 END AS id, 'n' || (c_custkey // 2) AS name, [c_acctbal::DOUBLE, c_custkey % 7] AS vec FROM customer)"""


@query("align_submission", SQL + SUBMISSION + """, by_id AS (SELECT id, max_by(vec, ord) AS vec FROM sub WHERE id IS NOT NULL GROUP BY id), by_name AS (SELECT name, min_by(vec, ord) AS vec FROM sub GROUP BY name)
 SELECT u.id, round(coalesce(i.vec, n.vec, [0.0, 0.0])[1], 6) AS v0, round(coalesce(i.vec, n.vec, [0.0, 0.0])[2], 6) AS v1, CASE WHEN i.vec IS NOT NULL THEN 'id' WHEN n.vec IS NOT NULL THEN 'name' ELSE 'none' END AS matched
 FROM units u LEFT JOIN by_id i ON i.id = u.id LEFT JOIN by_name n ON n.name = 'n' || u.id""")
def align_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool items take a submission's vector by id (the last of repeated rows), else by name (the first), else zeros."""
    c = table(spark, sf_dir, "customer")
    sub = c.select(
        F.col("c_custkey").alias("ord"), F.when((F.col("c_custkey") % 3 != 0) & (F.expr("c_custkey div 3") % 4 != 0), F.expr("c_custkey div 3")).alias("id"),
        F.concat(F.lit("n"), F.expr("c_custkey div 2")).alias("name"), F.array(F.col("c_acctbal").cast("double"), (F.col("c_custkey") % 7).cast("double")).alias("vec"),
    )
    by_id = sub.where("id is not null").groupBy("id").agg(F.max_by("vec", "ord").alias("iv"))
    by_name = sub.groupBy("name").agg(F.min_by("vec", "ord").alias("nv"))
    pool = B.vectors(spark, sf_dir).select("id", F.concat(F.lit("n"), "id").alias("name"))
    v = F.coalesce("iv", "nv", F.array(F.lit(0.0), F.lit(0.0)))
    return pool.join(by_id, "id", "left").join(by_name, "name", "left").select(
        "id", r6(v[0]).alias("v0"), r6(v[1]).alias("v1"), F.when(F.col("iv").isNotNull(), "id").when(F.col("nv").isNotNull(), "name").otherwise("none").alias("matched")
    )


@query("identity_retrieval", SQL + """, h AS (SELECT season, player, CASE WHEN game % 2 = 0 THEN 'a' ELSE 'b' END AS side, avg(x0) AS f0, avg(y0) AS f1, avg(x1) AS f2, avg(y1) AS f3 FROM actions GROUP BY ALL),
 m AS (SELECT *, sqrt(f0*f0+f1*f1+f2*f2+f3*f3) AS n FROM h), s AS (SELECT a.season, a.player AS q, b.player AS c, round((a.f0*b.f0+a.f1*b.f1+a.f2*b.f2+a.f3*b.f3)/(a.n*b.n), 12) AS s FROM m a JOIN m b ON a.season = b.season AND a.side = 'a' AND b.side = 'b'),
 k AS (SELECT season, q, c, row_number() OVER (PARTITION BY season, q ORDER BY s DESC, c) AS place FROM s)
 SELECT season, count(*) AS n, round(avg(CAST(place = 1 AS DOUBLE)), 6) AS top1, round(avg(1.0 / place), 6) AS mrr FROM k WHERE q = c GROUP BY season""")
def identity_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each season, find each player's odd-day profile from the even-day one."""
    a = B.actions(spark, sf_dir)
    profile = a.groupBy("season", "player", (F.col("game") % 2 == 0).alias("even")).agg(F.array(*[F.avg(c) for c in ("x0", "y0", "x1", "y1")]).alias("vec"))
    return identity_ranks(profile.where("even"), profile.where("not even"), ["season"], "player").groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("place") == 1).cast("double"))).alias("top1"), r6(F.avg(1 / F.col("place"))).alias("mrr")
    )


_FILED = SIMS.replace("list_transform(embedding, lambda x: x::DOUBLE) AS vec", "list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 4 THEN 0.0 ELSE x::DOUBLE END) AS vec")


@query("submission_report", _FILED + f" SELECT scope, count(*) AS n_queries, (SELECT count(*) FROM units) AS pool_size, (SELECT round(avg(CASE WHEN vec_id % 9 = 4 THEN 0.0 ELSE 1.0 END), 4) FROM embeddings) AS coverage, {_rounded()} FROM per_query GROUP BY scope")
def submission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission end to end: a CSV file with a row for each entity is loaded by its extension, its columns are found and aligned
    with the pool (zeros where it has none), evaluated, and the report is written as JSON and read back."""
    from lodestone.operators import vectors as V
    from lodestone.sources.files import load, scratch_path, write_csv, write_report

    pool = B.vectors(spark, sf_dir)
    path = write_csv(V.vector_to_wide(pool.where("id % 9 <> 4"), "id", 64), scratch_path(spark, "submission") + ".csv")
    filed = load(spark, path, "id long, " + ", ".join(f"f{i} double" for i in range(64)))
    own = V.wide_to_vector(filed, "id", "f").withColumnRenamed("vec", "filed")
    aligned = pool.select("id", "grp").join(own, "id", "left")
    vectors = aligned.select("id", F.coalesce("filed", F.array_repeat(F.lit(0.0), 64)).alias("vec"), "grp")
    found = R.rank_counts(vectors, R.relevance_edges(B.pairs(spark, sf_dir)))
    report = scoped(found).groupBy("scope").agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(n), 4).alias(n) for n in NAMES])
    covered = aligned.agg(F.count(F.lit(1)).alias("pool_size"), F.round(F.avg(F.col("filed").isNotNull().cast("double")), 4).alias("coverage"))
    full = report.join(F.broadcast(covered)).select("scope", "n_queries", "pool_size", "coverage", *NAMES)
    return load(spark, write_report(full, scratch_path(spark, "report") + ".json"), "scope string, n_queries long, pool_size long, coverage double, " + ", ".join(f"{n} double" for n in NAMES))
