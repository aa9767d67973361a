"""Queries on vectors, cleansing, predicates and lookups."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import l2, r6, sanitized
from lodestone.operators import ranking as R
from lodestone.operators import vectors as V
from lodestone.operators.quantiles import exact_quantiles
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SQL, TOP_SQL
from lodestone.plans.registry import query
from lodestone.plans.staging import stage, table

LONG = " SELECT id, pos - 1 AS pos, round(vec[pos], 6) AS value FROM (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS pos FROM x)"


def out(df: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("id",)
    return V.long(df, *keys).select(*keys, F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


CUST = ", cust AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::DOUBLE END AS bal, c_nationkey::DOUBLE AS nation, c_mktsegment AS seg, length(c_mktsegment)::DOUBLE AS seg_len FROM customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("double")).alias("bal"),
        F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("seg"), F.length("c_mktsegment").cast("double").alias("seg_len"),
    )


@query("wide_to_vector", SQL + CUST + ", x AS (SELECT id, [nation, id % 7, id % 13] AS vec FROM cust)" + LONG)
def wide_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = customers(spark, sf_dir).select("id", (F.col("id") % 13).alias("card_10"), F.col("nation").alias("card_0"), (F.col("id") % 7).alias("card_2"), "name")
    return out(V.wide_to_vector(wide, "id", "card_"))


@query("vector_to_wide", SQL + " SELECT id, " + ", ".join(f"round(vec[{i + 1}], 6) AS f{i}" for i in range(64)) + " FROM vecs")
def vector_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.vector_to_wide(B.vectors(spark, sf_dir), "id", 64)
    return wide.select("id", *[r6(f"f{i}").alias(f"f{i}") for i in range(64)])


@query("sanitize_vec", SQL + """, d AS (SELECT id, [CASE WHEN id % 7 = 0 THEN 'nan'::DOUBLE ELSE vec[1] * 400 END, CASE WHEN id % 11 = 0 THEN 'inf'::DOUBLE ELSE vec[2] END, CASE WHEN id % 13 = 0 THEN '-inf'::DOUBLE ELSE vec[3] END] AS v FROM vecs),
 e AS (SELECT id, unnest(v) AS a, unnest(range(3)) AS pos FROM d) SELECT id, pos, round(CASE WHEN isnan(a) THEN 0 ELSE least(50, greatest(-50, a)) END, 6) AS clipped, round(CASE WHEN isnan(a) OR isinf(a) THEN 0 ELSE a END, 6) AS zeroed FROM e""")
def sanitize_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lambda m, bad, x: F.when(F.col("id") % m == 0, F.lit(float(bad))).otherwise(x)
    v = F.col("vec")
    dirty = B.vectors(spark, sf_dir).select("id", F.array(odd(7, "nan", v[0] * 400), odd(11, "inf", v[1]), odd(13, "-inf", v[2])).alias("vec"))
    both = dirty.select("id", F.arrays_zip(sanitized("vec").alias("a"), sanitized("vec", None).alias("b")).alias("z"))
    return both.select("id", F.posexplode("z").alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), r6("z.a").alias("clipped"), r6("z.b").alias("zeroed"))


@query("impute_policy", SQL + CUST + ", m AS (SELECT quantile_cont(bal, 0.5) AS b FROM cust) SELECT id, round(coalesce(bal, b), 6) AS bal, CASE WHEN seg_len > 9 THEN 7.0 ELSE seg_len END AS seg_len, 1.5::DOUBLE AS absent FROM cust, m")
def impute_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = customers(spark, sf_dir).withColumn("seg_len", F.when(F.col("seg_len") <= 9, F.col("seg_len")))
    filled = V.imputed(holes, {"bal": "median", "seg_len": 7.0, "absent": 1.5})
    return filled.select("id", r6("bal").alias("bal"), "seg_len", "absent")


@query("impute_global_mean", SQL + CUST + ", g AS (SELECT avg(v) AS g FROM (SELECT unnest(vec) AS v FROM vecs)), x AS (SELECT c.id, coalesce(v.vec, list_transform(range(64), lambda i: g)) AS vec FROM cust c LEFT JOIN vecs v ON v.id = c.id, g)" + LONG)
def impute_global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(V.filled_by_global_mean(customers(spark, sf_dir).select("id"), B.vectors(spark, sf_dir), "id", 64))


@query("attach_vectors", SQL + CUST + ", x AS (SELECT c.id, list_concat([CASE WHEN v.id IS NULL THEN 0.0 ELSE 1.0 END], coalesce(v.vec, list_transform(range(64), lambda i: 0.0::DOUBLE))) AS vec FROM cust c LEFT JOIN vecs v ON v.id = c.id)" + LONG)
def attach_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by id, zeros where there is none; position 0 says whether one was found."""
    got = V.attached(customers(spark, sf_dir).select("id"), B.vectors(spark, sf_dir), "id")
    found = F.array(F.col("vec").isNotNull().cast("double"))
    return out(got.select("id", F.concat(found, F.coalesce("vec", F.array_repeat(F.lit(0.0), 64))).alias("vec")))


@query("l2_normalize", SQL + ", x AS (SELECT id, vec FROM units)" + LONG)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(R.unit_vectors(B.vectors(spark, sf_dir)))


STATS = """, f AS (SELECT id, vec, unnest(range(1, 65)) AS pos FROM vecs), st AS (SELECT pos, avg(vec[pos]) AS m, stddev_pop(vec[pos]) AS s, count(*) AS n FROM f WHERE id % 5 <> 0 GROUP BY pos)"""


@query("zscore", SQL + STATS + " SELECT id, f.pos - 1 AS pos, round((vec[f.pos] - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS value FROM f JOIN st USING (pos)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    return out(V.zscored(v, V.column_stats(v.where("id % 5 <> 0"))))


@query("card_norm_stats", SQL + STATS + " SELECT pos - 1 AS pos, round(m, 6) AS mean, round(s, 6) AS std, n, 'f' || (pos - 1) AS feature_name, 64 AS card_dim FROM st")
def card_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stats that a model file holds, written to JSON and read back."""
    from lodestone.sources.files import read_stats, write_stats

    stats = V.column_stats(B.vectors(spark, sf_dir).where("id % 5 <> 0"))
    names = F.transform(F.sequence(F.lit(0), F.size("mean") - 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    back = read_stats(spark, write_stats(stats.withColumn("feature_names", names).withColumn("card_dim", F.size("mean"))))
    flat = back.select("card_dim", F.posexplode(F.arrays_zip("mean", "std", "n", "feature_names")).alias("pos", "z"))
    return flat.select(F.col("pos").cast("long").alias("pos"), r6("z.mean").alias("mean"), r6("z.std").alias("std"), F.col("z.n").alias("n"), F.col("z.feature_names").alias("feature_name"), F.col("card_dim").cast("int").alias("card_dim"))


@query("variance_prune", SQL + STATS + ", k AS (SELECT pos, row_number() OVER (ORDER BY pos) AS p FROM st WHERE s > 0.124) SELECT id, p - 1 AS pos, round(vec[pos], 6) AS value FROM f JOIN k USING (pos)")
def variance_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    return out(V.pruned(v, V.column_stats(v.where("id % 5 <> 0")), 0.124))


NORM = "list_transform({v}, lambda a: a / CASE WHEN sqrt(list_dot_product({v}, {v})) < 1e-12 THEN 1 ELSE sqrt(list_dot_product({v}, {v})) END)"


@query("fuse_blocks", SQL + f", b AS (SELECT id, {NORM.format(v='vec[1:16]')} AS a, list_transform({NORM.format(v='vec[17:64]')}, lambda t: t * 0.5) AS b FROM vecs), c AS (SELECT id, list_concat(a, b) AS w FROM b), x AS (SELECT id, {NORM.format(v='w')} AS vec FROM c)" + LONG)
def fuse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir)
    return out(v.select("id", V.fused((F.slice("vec", 1, 16), 1.0), (F.slice("vec", 17, 48), 0.5)).alias("vec")))


@query("truncate_dims", SQL + f", x AS (SELECT id, {NORM.format(v='vec[1:32]')} AS vec FROM vecs)" + LONG)
def truncate_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(B.vectors(spark, sf_dir).select("id", V.truncated("vec", 32).alias("vec")))


RANDOM = """, r AS (SELECT id, unnest(range(64)) AS d FROM vecs), rn AS (SELECT id, list(sqrt(-2 * ln(1 - ('0x' || substr(md5('0|r|' || id || '|' || d), 1, 8))::BIGINT / 4294967296.0)) * cos(2 * 3.141592653589793 * (('0x' || substr(md5('0|a|' || id || '|' || d), 1, 8))::BIGINT / 4294967296.0)) ORDER BY d) AS v FROM r GROUP BY id),
 rv AS (SELECT id, list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS vec FROM rn)"""


@query("random_floor", SQL + RANDOM + ", x AS (SELECT * FROM rv)" + LONG)
def random_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(V.random_vectors(B.vectors(spark, sf_dir), 64))


def method_vectors(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """The registry of methods: name -> (id, vec, grp)."""
    from lodestone.sources.files import load, scratch_path, write_parquet

    v = B.vectors(spark, sf_dir)
    filed = lambda: load(spark, write_parquet(v.withColumn("vec", F.slice("vec", 33, 32)), scratch_path(spark, "method")))
    made = {"full": lambda: v, "half": lambda: v.withColumn("vec", F.slice("vec", 1, 32)), "random": lambda: V.random_vectors(v, 64).join(v.select("id", "grp"), "id"), "file": filed}
    return made[method]()


@query("method_table", SQL + RANDOM + """, mt AS (SELECT 'full' AS method, id, vec FROM vecs UNION ALL SELECT 'half', id, vec[1:32] FROM vecs UNION ALL SELECT 'random', id, vec FROM rv UNION ALL SELECT 'file', id, vec[33:64] FROM vecs) SELECT method, id, unnest(range(len(vec))) AS pos, round(unnest(vec), 6) AS value FROM mt""")
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's vectors; one comes from a file."""
    every = functools.reduce(DataFrame.unionByName, [method_vectors(spark, sf_dir, m).select(F.lit(m).alias("method"), "id", "vec") for m in (*B.METHODS, "file")])
    return every.select("method", "id", F.posexplode("vec").alias("pos", "value")).select("method", "id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


SEASONS = """, sv AS (SELECT player AS id, season, team AS zone, count(*) AS n, [avg(x0), avg(y0), avg(x1 - x0), avg(CAST(ok AS DOUBLE))] AS vec FROM actions GROUP BY ALL)"""


def season_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, season, zone, n, vec of four features from the action log."""
    a = B.actions(spark, sf_dir)
    features = F.array(F.avg("x0"), F.avg("y0"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("ok").cast("double")))
    return a.groupBy(F.col("player").alias("id"), "season", F.col("team").alias("zone")).agg(F.count(F.lit(1)).alias("n"), features.alias("vec"))


@query("eb_shrink", SQL + SEASONS + """, f AS (SELECT id, season, zone, n, unnest(vec) AS v, unnest(range(4)) AS pos FROM sv), m AS (SELECT zone, pos, avg(v) AS m FROM f WHERE id % 4 <> 0 GROUP BY zone, pos)
 SELECT id, season, pos, round((n * v + 5 * m) / (n + 5), 6) AS value FROM f JOIN m USING (zone, pos)""")
def eb_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(V.shrunk(season_vectors(spark, sf_dir), "zone", "n", F.col("id") % 4 != 0), "id", "season")


@query("career_vector", SQL + SEASONS + f""", f AS (SELECT id, n, unnest(vec) AS v, unnest(range(4)) AS pos FROM sv), m AS (SELECT id, pos, avg(v) AS m FROM f GROUP BY id, pos), c AS (SELECT id, list(m ORDER BY pos) AS w FROM m GROUP BY id),
 t AS (SELECT id, sum(n) AS n FROM sv GROUP BY id), x AS (SELECT id, {NORM.format(v='w')} AS vec FROM c) SELECT id, n::BIGINT AS n, pos - 1 AS pos, round(vec[pos], 6) AS value FROM (SELECT id, vec, unnest(range(1, 5)) AS pos FROM x) JOIN t USING (id)""")
def career_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = season_vectors(spark, sf_dir)
    career = V.mean_vectors(s, "id").join(s.groupBy("id").agg(F.sum("n").alias("n")), "id")
    return out(career.withColumn("vec", l2("vec")), "id", "n")


@query("majority_label", SQL + ", c AS (SELECT player AS id, competition AS label, count(*) AS n FROM actions GROUP BY ALL) SELECT id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.actions(spark, sf_dir).groupBy(F.col("player").alias("id"), F.col("competition").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return V.first_by(counts, ["id"], [F.desc("n"), "label"])


@query("primary_category", SQL + ", c AS (SELECT o_custkey AS id, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY ALL) SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, category) AS k FROM c) WHERE k = 1")
def primary_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("category")).count()
    return V.first_by(counts, ["id"], [F.desc("count"), "category"]).drop("count")


@query("dedupe_first", "SELECT o_custkey, o_orderkey, round(o_totalprice::DOUBLE, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = V.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", r6(F.col("o_totalprice").cast("double")).alias("price"))


@query("min_support", SQL + " SELECT player, count(*) AS n, count(DISTINCT game) AS games FROM actions GROUP BY player HAVING count(DISTINCT game) >= 5 AND count(*) >= 20")
def min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.actions(spark, sf_dir).groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("game").alias("games")).where("games >= 5 and n >= 20")


@query("text_nonblank", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' AND text IS NOT NULL")
def text_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^ \n\t]")).select("doc_id", F.length("text").cast("long").alias("n"))


LEAGUES = {0: "North", 1: "South", 2: "East", 3: "West"}


@query("league_label", SQL + " SELECT competition, CASE competition WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' ELSE 'Other' END AS league, count(*) AS n FROM actions GROUP BY ALL")
def league_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in LEAGUES.items() for x in pair])
    code = F.col("competition").cast("int")
    return B.actions(spark, sf_dir).groupBy("competition").agg(F.count(F.lit(1)).alias("n")).select("competition", F.coalesce(F.try_element_at(names, code), F.lit("Other")).alias("league"), "n")


@query("pool_split", "SELECT CASE WHEN coalesce(r_name IN ('EUROPE', 'ASIA'), false) THEN 'A' ELSE 'B' END AS pool, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 6 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two regions are pool A; all others, and those whose region isn't known, pool B."""
    places = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    top = F.coalesce(F.col("r_name").isin("EUROPE", "ASIA"), F.lit(False))
    return c.groupBy(F.when(top, "A").otherwise("B").alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query("value_terciles", SQL + CUST + ", q AS (SELECT quantile_cont(bal, 0.333) AS a, quantile_cont(bal, 0.666) AS b, count(bal) AS n FROM cust) SELECT id, CASE WHEN n <= 60 OR bal IS NULL THEN 'none' WHEN bal <= a THEN 'low' WHEN bal <= b THEN 'mid' ELSE 'high' END AS tercile FROM cust, q")
def value_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    low, high = exact_quantiles(c, {"bal": [0.333, 0.666]})["bal"]
    few = c.agg(F.count("bal").alias("n"))
    place = F.when((F.col("n") <= 60) | F.col("bal").isNull(), "none").when(F.col("bal") <= low, "low").when(F.col("bal") <= high, "mid").otherwise("high")
    return c.join(F.broadcast(few)).select("id", place.alias("tercile"))


@query("age_at", "SELECT o_orderkey AS id, round(datediff('day', TRY_CAST(substr(s, 1, 10) AS DATE), DATE '2020-07-01') / 365.25, 6) AS age FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00' END AS s FROM orders)")
def age_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of 365.25 days from a date text to 2020-07-01; null where the text is no date."""
    s = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00")))
    born = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r6(F.datediff(F.lit("2020-07-01").cast("date"), born) / 365.25).alias("age"))


#: query -> (holders, attribute), conditions on the parts table.
ATTRIBUTES = {
    "small and cheap": ("p_size <= 25", "p_retailprice < 1100"), "large and dear": ("p_size > 25", "p_retailprice >= 1300"),
    "small by brand": ("p_size <= 25", "p_brand like '%1'"), "large by brand": ("p_size > 25", "p_brand like '%3'"), "mid price of odd size": ("p_size % 2 = 1", "p_retailprice between 1000 and 1400"),
    "first brands": ("p_brand < 'Brand#3'", "p_size <= 10"), "last brands": ("p_brand >= 'Brand#4'", "p_size > 40"), "named early": ("p_name < 'n'", "p_retailprice < 1200"), "dear and tiny": ("p_retailprice >= 1300", "p_size <= 5"), "none such": ("p_size > 1000", "p_retailprice > 0"),
}


def _attributes_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{q}' AS query, p_partkey AS id, {p} AS holds, {p} AND {a} AS fits FROM part" for q, (p, a) in ATTRIBUTES.items())


@query("attr_queries", f"SELECT query, count(*) FILTER (holds) AS n_holders, count(*) FILTER (fits) AS n_fits FROM ({_attributes_sql()}) GROUP BY query")
def attr_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_table(table(spark, sf_dir, "part")).groupBy("query").agg(F.count_if("holds").alias("n_holders"), F.count_if("fits").alias("n_fits"))


def attribute_table(parts: DataFrame) -> DataFrame:
    """query, id, holds (has the position), fits (and the attribute): all predicates in one pass over the parts."""
    each = F.array(*[F.struct(F.lit(q).alias("query"), F.expr(p).alias("holds"), F.expr(f"{p} and {a}").alias("fits")) for q, (p, a) in ATTRIBUTES.items()])
    return parts.select(F.col("p_partkey").alias("id"), F.explode(each).alias("a")).select("id", "a.*")


@query("attr_lift", TOP_SQL + f""", att AS ({_attributes_sql()}), g AS (SELECT DISTINCT query, dense_rank() OVER (ORDER BY query) - 1 AS q FROM att),
 base AS (SELECT query, avg(CASE WHEN holds THEN CAST(fits AS DOUBLE) END) AS base FROM att WHERE id IN (SELECT id FROM units) GROUP BY query),
 hit AS (SELECT g.query, avg(CASE WHEN coalesce(fits, false) THEN 1.0 ELSE 0.0 END) AS p10 FROM top JOIN g ON g.q = top.q LEFT JOIN att ON att.query = g.query AND att.id = top.c WHERE place <= 10 GROUP BY g.query)
 SELECT query, round(p10, 6) AS p10, round(base, 6) AS base, round(CASE WHEN base > 0 THEN p10 / base END, 6) AS lift FROM hit JOIN base USING (query)""")
def attr_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute precision in the ten nearest of each query's vector, against the attribute's rate among holders. Parts are reduced to those
    that count before a row is made for each query; the table of all attributes is never a side of a join."""
    v, parts = B.vectors(spark, sf_dir), table(spark, sf_dir, "part")
    names = spark.createDataFrame([(i, q) for i, q in enumerate(sorted(ATTRIBUTES))], "q long, query string")
    near = stage(R.top_k(v.join(F.broadcast(names.select(F.col("q").alias("id"))), "id", "left_semi"), v, 10).join(F.broadcast(names), "q").select("query", F.col("c").alias("id")), "near")
    few = parts.join(F.broadcast(near.select(F.col("id").alias("p_partkey")).distinct()), "p_partkey", "left_semi")  # ten for each query at most
    hit = near.join(attribute_table(few).hint("merge"), ["query", "id"], "left").groupBy("query").agg(F.avg(F.coalesce(F.col("fits"), F.lit(False)).cast("double")).alias("p10"))
    own = parts.join(v.select(F.col("id").alias("p_partkey")).hint("merge"), "p_partkey", "left_semi")
    base = attribute_table(own).groupBy("query").agg(F.avg(F.when(F.col("holds"), F.col("fits").cast("double"))).alias("base"))
    return hit.join(base, "query").select("query", r6("p10").alias("p10"), r6("base").alias("base"), r6(F.when(F.col("base") > 0, F.try_divide("p10", "base"))).alias("lift"))


PCT = """, fl AS (UNPIVOT (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal::DOUBLE AS bal, (c_custkey % 17)::DOUBLE AS k17 FROM customer) ON bal, k17 INTO NAME feature VALUE value),
 pr AS (SELECT id, seg, feature, value, 100.0 * (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0) / count(*) OVER (PARTITION BY feature) AS pct FROM fl)"""


def percentiles(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").cast("double").alias("bal"), (F.col("c_custkey") % 17).cast("double").alias("k17"))
    return V.percentile_ranks(rows.select("id", *by, "bal", "k17"), ["bal", "k17"], *by)


@query("pct_rank", SQL + PCT + " SELECT id, feature, round(pct, 6) AS pct FROM pr")
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(spark, sf_dir).select("id", "feature", r6("pct").alias("pct"))


@query("pct_repr", SQL + PCT + ", ps AS (SELECT id, seg, feature, 100.0 * (rank() OVER (PARTITION BY seg, feature ORDER BY value) + (count(*) OVER (PARTITION BY seg, feature, value) - 1) / 2.0) / count(*) OVER (PARTITION BY seg, feature) AS pct FROM fl) SELECT id, seg, feature, round(pct, 6) AS pct FROM ps")
def pct_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(spark, sf_dir, "seg").select("id", "seg", "feature", r6("pct").alias("pct"))


@query("pctile_labels", SQL + PCT + " SELECT id, feature, CASE WHEN pct >= 90 THEN 'elite' WHEN pct >= 75 THEN 'strong' WHEN pct >= 50 THEN 'above average' WHEN pct >= 25 THEN 'below average' ELSE 'low' END AS phrase, CASE WHEN value < 35 THEN 'own third' WHEN value <= 70 THEN 'middle third' ELSE 'final third' END AS third FROM pr")
def pctile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pct")
    phrase = F.when(p >= 90, "elite").when(p >= 75, "strong").when(p >= 50, "above average").when(p >= 25, "below average").otherwise("low")
    third = F.when(F.col("value") < 35, "own third").when(F.col("value") <= 70, "middle third").otherwise("final third")
    return percentiles(spark, sf_dir).select("id", "feature", phrase.alias("phrase"), third.alias("third"))


@query("card_value_repr", SQL + """, val AS (SELECT c_name AS name, sum(o_totalprice)::DOUBLE AS total, sum(o_totalprice)::DOUBLE / count(*) AS rate, 100.0 * count(*) / sum(o_totalprice)::DOUBLE AS per_100 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name),
 m AS (SELECT avg(rate) AS m1, stddev_pop(rate) AS s1, avg(total) AS m2, stddev_pop(total) AS s2, avg(per_100) AS m3, stddev_pop(per_100) AS s3 FROM val),
 x AS (SELECT c_custkey AS id, list_concat(u.vec, list_transform([coalesce((rate - m1) / s1, 0), coalesce((total - m2) / s2, 0), coalesce((per_100 - m3) / s3, 0)], lambda z: z * sqrt(64 / 3.0))) AS vec FROM customer JOIN vecs u ON u.id = c_custkey LEFT JOIN val ON name = c_name, m)""" + LONG)
def card_value_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card with value columns beside it: summed by name, rated by game and by hundred, standardised over the names that have any,
    zero for the others, and weighted to the card's size."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    val = value_by_name(c, o).withColumn("per_100", 100.0 * F.col("n") / F.col("total"))
    kinds = ("rate", "total", "per_100")
    stats = val.agg(*[f(k).alias(f"{n}_{k}") for k in kinds for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = F.array(*[F.coalesce((F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}"), F.lit(0.0)) * F.lit((64 / 3) ** 0.5) for k in kinds])
    card = B.vectors(spark, sf_dir).select("id", "vec")
    joined = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(card, "id").join(val, "name", "left").join(F.broadcast(stats))
    return out(joined.select("id", F.concat("vec", z).alias("vec")))


def value_by_name(c: DataFrame, o: DataFrame) -> DataFrame:
    both = c.select("c_custkey", F.col("c_name").alias("name")).join(o, F.col("o_custkey") == F.col("c_custkey"))
    sums = both.groupBy("name").agg(F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("rate", F.col("total") / F.col("n"))


@query("vaep_rollup", "SELECT c_name AS name, round(sum(o_totalprice)::DOUBLE, 6) AS total, count(*) AS n, round(sum(o_totalprice)::DOUBLE / count(*), 6) AS rate FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def vaep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = value_by_name(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    return rolled.select("name", r6("total").alias("total"), "n", r6("rate").alias("rate"))
