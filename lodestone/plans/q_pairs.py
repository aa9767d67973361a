"""Queries of lookups, splits, training pairs, seasons, identity protocols, and label mining."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import dot, norm, r6, uniform
from lodestone.operators import inference as I
from lodestone.operators import ranking as R
from lodestone.operators import samples as S
from lodestone.operators.encoders import SetEncoder, encoded, factor_encoder, heatmap_encoder
from lodestone.operators.models import fit_factors
from lodestone.operators.names import closest
from lodestone.operators.quantiles import exact_quantiles
from lodestone.operators.resampling import tree_sql
from lodestone.operators import vectors as V
from lodestone.plans import bindings as B
from lodestone.plans.bindings import SQL
from lodestone.plans.numbering import numbered
from lodestone.plans.q_vectors import SEASONS, season_vectors
from lodestone.plans.registry import query
from lodestone.plans.staging import discard, stage, table

U = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"


@query("map_entities", "SELECT o_custkey AS ext_id, min_by(o_orderkey, o_orderkey) AS first_row, max_by(o_orderpriority, o_orderkey) AS last_sub FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def map_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External id to gallery row, the first winning; its sub-position, the last winning."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return o.groupBy(F.col("o_custkey").alias("ext_id")).agg(F.min("o_orderkey").alias("first_row"), F.max_by("o_orderpriority", "o_orderkey").alias("last_sub"))


POOL = ", fl AS (SELECT id, CASE id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN 'False' WHEN 3 THEN ' True ' ELSE 'no' END AS flag FROM units), ro AS (SELECT id AS row, CASE WHEN id % 10 = 1 THEN id - 1 ELSE id END AS player FROM fl WHERE lower(trim(flag)) = 'true'), lw AS (SELECT player, max(row) AS row FROM ro GROUP BY player), mp AS (SELECT x, y FROM pairs)"


@query("relevance_edges", SQL + POOL + " SELECT DISTINCT q, r FROM (SELECT a.row AS q, b.row AS r FROM mp JOIN lw a ON a.player = x JOIN lw b ON b.player = y UNION ALL SELECT b.row, a.row FROM mp JOIN lw a ON a.player = x JOIN lw b ON b.player = y) WHERE q <> r")
def relevance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of player ids resolved to gallery rows. A row is in the gallery if its flag is the text "true" in any case; of rows
    that share a player (here every tenth and the one after it) the last one counts."""
    k = F.col("id") % 5
    flag = F.when(k == 0, "TRUE").when(k == 1, "true").when(k == 2, "False").when(k == 3, " True ").otherwise("no")
    rows = B.vectors(spark, sf_dir).select("id", flag.alias("flag")).where(F.lower(F.trim("flag")) == "true").select((F.col("id") - (F.col("id") % 10 == 1).cast("int")).alias("player"), F.col("id").alias("row"))
    last = rows.groupBy("player").agg(F.max("row").alias("row"))
    at = lambda name: last.select(F.col("player").alias(name), F.col("row").alias(f"row_{name}"))
    return R.relevance_edges(B.pairs(spark, sf_dir).join(at("x"), "x").join(at("y"), "y").select(F.col("row_x").alias("x"), F.col("row_y").alias("y")))


@query("enrich_gallery", "SELECT c_custkey AS id, n_name AS team, r_name AS league FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small dimensions (a row for each nation and region) are broadcast by Spark itself when they are small."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("c_custkey").alias("id"), F.col("n_name").alias("team"), F.col("r_name").alias("league"))


@query("text_vector_pairs", SQL + " SELECT doc_id, id, grp, length(text)::BIGINT AS n, round(vec[1], 6) AS first FROM documents JOIN vecs ON id = doc_id WHERE text <> ''")
def text_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text <> ''")
    both = d.join(B.vectors(spark, sf_dir), F.col("doc_id") == F.col("id"))
    return both.select("doc_id", "id", "grp", F.length("text").cast("long").alias("n"), r6(F.col("vec")[0]).alias("first"))


@query("attach_labels", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").fillna(-1, "quality")


@query("split_semi_anti", f"WITH v AS (SELECT c_custkey FROM customer WHERE {U.format(key=chr(39) + 'val|' + chr(39) + ' || c_custkey')} < 0.3) SELECT 'val' AS part, count(*) AS n FROM orders WHERE o_custkey IN (SELECT * FROM v) UNION ALL SELECT 'train', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM v)")
def split_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).where(uniform(F.lit("val"), "o_custkey") < 0.3)
    o = table(spark, sf_dir, "orders").select("o_custkey")
    count = lambda how, name: o.join(val, "o_custkey", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count("left_semi", "val").unionByName(count("left_anti", "train"))


@query("external_attrs", "SELECT s_suppkey AS id, n_name AS country, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0)::DOUBLE, 6) AS quantity FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, n_name")
def external_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("n"), F.sum("l_quantity").cast("double").alias("q"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(sums, "s_suppkey", "left")
    return s.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("country"), F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("q", F.lit(0.0))).alias("quantity"))


SP = ", sr AS (SELECT id, zone, n, vec, dense_rank() OVER (ORDER BY season) AS s, season FROM sv)"


def ranked_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season vectors with the season's place in the global order of seasons; seasons are few, their list is one small window."""
    s = season_vectors(spark, sf_dir)
    order = s.select("season").distinct().withColumn("s", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("season")))
    return s.join(F.broadcast(order), "season")


COS = "round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 12)"
TEMPORAL = SEASONS + SP + f", tp AS (SELECT a.id, a.season, {COS} AS s FROM sr a JOIN sr b ON a.id = b.id AND b.s = a.s + 1)"


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each entity's vectors in successive seasons of the global order."""
    s = ranked_seasons(spark, sf_dir)
    b = s.select("id", (F.col("s") - 1).alias("s"), F.col("vec").alias("next"))
    return s.join(b, ["id", "s"]).select("id", "season", F.round(dot("vec", "next") / (norm("vec") * norm("next")), 12).alias("s"))


@query("temporal_pairs", SQL + TEMPORAL + " SELECT id, season, round(s, 6) AS sim FROM tp")
def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal(spark, sf_dir).select("id", "season", r6("s").alias("sim"))


@query("temporal_consistency", SQL + TEMPORAL + " SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(avg(CAST(s > 0.8 AS DOUBLE)), 6) AS over, count(DISTINCT id) AS players, count(*) AS pairs FROM tp")
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stage(temporal(spark, sf_dir), "temporal")
    return t.agg(r6(F.avg("s")).alias("mean"), r6(F.lit(exact_quantiles(t, {"s": [0.5]})["s"][0])).alias("median"), r6(F.avg((F.col("s") > 0.8).cast("double"))).alias("over"), F.countDistinct("id").alias("players"), F.count(F.lit(1)).alias("pairs"))


@query("temporal_lag", SQL + SEASONS + f", b AS (SELECT id, season, vec, lag(vec) OVER (PARTITION BY id ORDER BY season) AS prev FROM sv), x AS (SELECT id, season, round(list_dot_product(vec, prev) / sqrt(list_dot_product(vec, vec) * list_dot_product(prev, prev)), 6) AS sim FROM b WHERE prev IS NOT NULL) SELECT * FROM x")
def temporal_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine to the season before that the entity has, adjacent or not."""
    s = season_vectors(spark, sf_dir).withColumn("prev", F.lag("vec").over(Window.partitionBy("id").orderBy("season"))).where("prev is not null")
    return s.select("id", "season", r6(dot("vec", "prev") / (norm("vec") * norm("prev"))).alias("sim"))


EMA_SQL = SQL.replace("WITH actions", "WITH RECURSIVE actions") + SEASONS + SP + """, em(id, s, season, e) AS (SELECT id, s, season, vec[1] FROM sr a WHERE NOT EXISTS (SELECT 1 FROM sr b WHERE b.id = a.id AND b.s = a.s - 1)
 UNION ALL SELECT sr.id, sr.s, sr.season, 0.75 * sr.vec[1] + 0.25 * em.e FROM em JOIN sr ON sr.id = em.id AND sr.s = em.s + 1)"""


def ema(spark: SparkSession, sf_dir: str, alpha: float = 0.75) -> DataFrame:
    """Running blend alpha x + (1 - alpha) blend before over successive seasons, starting anew after a gap: id, s, season, vec."""
    s = ranked_seasons(spark, sf_dir)
    run = F.col("s") - F.row_number().over(Window.partitionBy("id").orderBy("s"))
    runs = s.withColumn("run", run).groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct("s", "season", "vec"))).alias("rows"))
    blend = lambda acc, r: F.concat(acc, F.array(F.when(F.size(acc) == 0, r["vec"]).otherwise(F.zip_with(r["vec"], F.element_at(acc, -1), lambda x, e: alpha * x + (1 - alpha) * e))))
    folded = runs.withColumn("vecs", F.aggregate("rows", F.expr("cast(array() as array<array<double>>)"), blend))
    return folded.select("id", F.explode(F.arrays_zip("rows", "vecs")).alias("z")).select("id", "z.rows.s", "z.rows.season", F.col("z.vecs").alias("vec"))



@query("entity_split", f"SELECT c_custkey AS id, row_number() OVER (ORDER BY {U.format(key=chr(39) + 'es|' + chr(39) + ' || c_custkey')}, c_custkey) <= greatest(1, floor((SELECT count(*) FROM customer) * 0.3)) AS held_out FROM customer")
def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entity_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 0.3, "es")


@query("stratified_split", f"SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {U.format(key=chr(39) + 'st|' + chr(39) + ' || c_custkey')}, c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.3) AS test FROM customer")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), "id", "label", 0.3, "st")


HELD = f"{U.format(key=chr(39) + 'te|' + chr(39) + ' || {c}')} < 0.3"


@query("train_edges", SQL + " SELECT q, r FROM edges WHERE NOT " + HELD.format(c="q") + " AND NOT " + HELD.format(c="r"))
def train_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.vectors(spark, sf_dir).select("id").where(uniform(F.lit("te"), "id") < 0.3)
    return S.train_edges(R.relevance_edges(B.pairs(spark, sf_dir)), held).select("q", "r")


@query("false_negative_mask", SQL + f", b AS (SELECT id, floor((row_number() OVER (ORDER BY {U.format(key=chr(39) + 'fn|' + chr(39) + ' || id')}, id) - 1) / 32)::BIGINT AS batch FROM units) SELECT x.batch, q AS a, r AS b FROM edges JOIN b x ON x.id = q JOIN b y ON y.id = r WHERE x.batch = y.batch")
def false_negative_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.false_negatives(B.vectors(spark, sf_dir).select("id"), R.relevance_edges(B.pairs(spark, sf_dir)), 32, "fn")


TX = ", tx AS (SELECT doc_id, doc_id % 15 AS id FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id): documents as texts of the entities of the action log."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 15).alias("id"))


@query("weighted_pair_sample", SQL + SEASONS + TX + f", sp AS (SELECT id, season, sum(n) OVER (PARTITION BY id ORDER BY season) * 1.0 / sum(n) OVER (PARTITION BY id) AS hi, n * 1.0 / sum(n) OVER (PARTITION BY id) AS w FROM sv) SELECT doc_id, season FROM (SELECT *, {U.format(key=chr(39) + 'wp|' + chr(39) + ' || doc_id')} AS u FROM tx) JOIN sp USING (id) WHERE u >= hi - w AND u < hi")
def weighted_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text gets one of its entity's seasons, with chances in proportion to the season's events."""
    return S.weighted_choice(texts(spark, sf_dir), season_vectors(spark, sf_dir).select("id", "season", "n"), "id", "n", uniform(F.lit("wp"), "doc_id"), "season").select("doc_id", "season")


PICK = "row_number() OVER (PARTITION BY id ORDER BY " + U.format(key="'{seed}|' || doc_id") + ", doc_id)"


@query("cross_season_pairs", SQL + SEASONS + TX + ", m AS (SELECT id FROM sv GROUP BY id HAVING count(DISTINCT season) >= 2), p AS (SELECT doc_id, id, " + PICK.format(seed="cs") + " AS k FROM tx WHERE id IN (SELECT id FROM m)) SELECT doc_id, id, season FROM p JOIN sv USING (id) WHERE k <= 2 ORDER BY " + U.format(key="'cap|' || doc_id || '|' || season") + ", doc_id, season LIMIT 10000")
def cross_season_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drawn texts of each entity with two seasons or more, with all its seasons; of all pairs a sample of 10,000 at most, drawn by
    hash."""
    s = season_vectors(spark, sf_dir).select("id", "season")
    many = s.groupBy("id").agg(F.countDistinct("season").alias("n")).where("n >= 2")
    k = F.row_number().over(Window.partitionBy("id").orderBy(uniform(F.lit("cs"), "doc_id"), "doc_id"))
    every = texts(spark, sf_dir).join(many, "id", "left_semi").withColumn("k", k).where("k <= 2").join(s, "id").select("doc_id", "id", "season")
    return every.orderBy(uniform(F.lit("cap"), "doc_id", "season"), "doc_id", "season").limit(10_000)


SHIFT = EMA_SQL.replace("SELECT id, s, season, vec[1] FROM sr a", "SELECT id, s, season, vec FROM sr a").replace("0.75 * sr.vec[1] + 0.25 * em.e", "list_transform(range(1, 5), lambda i: 0.75 * sr.vec[i] + 0.25 * em.e[i])")


@query("season_ema", SHIFT + " SELECT id, season, unnest(range(4)) AS pos, round(unnest(e), 6) AS value FROM em")
def season_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ema(spark, sf_dir).select("id", "season", F.posexplode("vec").alias("pos", "value")).select("id", "season", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("season_shift_pairs", SHIFT + TX + ", pk AS (SELECT doc_id, id, " + PICK.format(seed="ss") + " AS k FROM tx WHERE " + U.format(key="'val|' || id") + " >= 0.2), al AS (SELECT a.id, a.season, doc_id, b.e FROM em a JOIN em b ON b.id = a.id AND b.s = a.s + 1 JOIN pk ON pk.id = a.id AND k = 1), od AS (SELECT *, row_number() OVER (ORDER BY " + U.format(key="'sc|' || id || '|' || season") + ", id, season) - 1 AS i FROM al) SELECT id, season, doc_id, unnest(range(4)) AS pos, round(unnest(e), 6) AS value FROM od WHERE i < floor(0.3 * (SELECT count(*) FROM tx))")
def season_shift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn text of a training entity with the blended vector of the season after; in number at most three tenths of all texts,
    drawn by hash."""
    e, own = ema(spark, sf_dir), texts(spark, sf_dir)
    after = e.select("id", (F.col("s") - 1).alias("s"), F.col("vec").alias("next"))
    k = F.row_number().over(Window.partitionBy("id").orderBy(uniform(F.lit("ss"), "doc_id"), "doc_id"))
    one = own.where(uniform(F.lit("val"), "id") >= 0.2).withColumn("k", k).where("k = 1").select("id", "doc_id")
    every = e.join(after, ["id", "s"]).join(one, "id").select("id", "season", "doc_id", "next").withColumn("u", uniform(F.lit("sc"), "id", "season"))
    most = own.agg(F.floor(0.3 * F.count(F.lit(1))).alias("most"))
    drawn = numbered(every, "u", "id", "season", name="i").join(F.broadcast(most)).where("i < most")
    return drawn.select("id", "season", "doc_id", F.posexplode("next").alias("pos", "value")).select("id", "season", "doc_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("texts_per_entity", "SELECT source AS entity, doc_id // 100 AS part, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, text)) AS texts_md5 FROM documents GROUP BY ALL")
def texts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each entity as lists in order; a list spans a hundred ids, so that a frequent entity has many lists and none is long."""
    return text_lists(table(spark, sf_dir, "documents"), "source", 100).select(
        "entity", "part", F.size("items").cast("long").alias("n"), F.array_join(F.expr("transform(items, x -> cast(x.id as string))"), ",").alias("ids"), F.md5(F.array_join(F.expr("transform(items, x -> x.text)"), "\n")).alias("texts_md5"),
    )


def text_lists(docs: DataFrame, entity: str, span: int) -> DataFrame:
    """entity, part, items: array of (id, text) in order of id, for each ``span`` ids."""
    items = F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))))
    return docs.groupBy(F.col(entity).alias("entity"), F.floor(F.col("doc_id") / span).alias("part")).agg(items.alias("items"))


@query("corpus_summary", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, min(length(text))::BIGINT AS low, max(length(text))::BIGINT AS high, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(n)).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.countDistinct("source").alias("sources"))


@query("all_text_union", "SELECT text_type, count(*) AS n FROM (SELECT 'description' AS text_type, text FROM documents UNION ALL SELECT 'raw', text FROM benchmark) GROUP BY text_type")
def all_text_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("description").alias("text_type"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("raw").alias("text_type"), "text")).groupBy("text_type").agg(F.count(F.lit(1)).alias("n"))


EXPORT = SQL + ", pos AS (SELECT id, CASE WHEN id % 4 <> 0 THEN 'p' || grp END AS sub FROM units)"


@query("export_pairs", EXPORT + " SELECT q AS player_x_id, r AS player_y_id, coalesce(a.sub, b.sub, '?') AS sub_position FROM edges LEFT JOIN pos a ON a.id = q LEFT JOIN pos b ON b.id = r")
def export_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed label pairs, written as CSV and as Parquet, and read back from the CSV."""
    from lodestone.sources.files import load, scratch_path, write_csv, write_parquet

    sub = B.vectors(spark, sf_dir).select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), "grp")).alias("sub"))
    x, y = sub.select(F.col("id").alias("q"), F.col("sub").alias("sx")), sub.select(F.col("id").alias("r"), F.col("sub").alias("sy"))
    out = R.relevance_edges(B.pairs(spark, sf_dir)).join(x, "q", "left").join(y, "r", "left").select(F.col("q").alias("player_x_id"), F.col("r").alias("player_y_id"), F.coalesce("sx", "sy", F.lit("?")).alias("sub_position"))
    out = stage(out, "export")
    write_parquet(out, scratch_path(spark, "pairs"))
    return load(spark, write_csv(out, scratch_path(spark, "pairs") + ".csv"), "player_x_id long, player_y_id long, sub_position string")


@query("export_players", EXPORT + " SELECT id AS player_id, id IN (SELECT q FROM edges WHERE q % 2 = 0) AS is_query, true AS in_gallery FROM units WHERE id IN (SELECT q FROM edges)")
def export_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = R.relevance_edges(B.pairs(spark, sf_dir))
    ends = edges.select(F.col("q").alias("player_id")).union(edges.select("r")).distinct()
    gallery = B.vectors(spark, sf_dir).select(F.col("id").alias("player_id"), F.lit(True).alias("g"))
    asked = edges.select(F.col("q").alias("player_id")).where("player_id % 2 = 0").distinct().withColumn("a", F.lit(True))
    return ends.join(gallery, "player_id", "left").join(asked, "player_id", "left").select("player_id", F.coalesce("a", F.lit(False)).alias("is_query"), F.coalesce("g", F.lit(False)).alias("in_gallery"))


@query("export_manifest", EXPORT + " SELECT (SELECT count(*) FROM edges) AS n_pairs, count(*) AS n_players, count(*) FILTER (id IN (SELECT q FROM edges WHERE q % 2 = 0)) AS n_queries FROM units WHERE id IN (SELECT q FROM edges)")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.relevance_edges(B.pairs(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_pairs"))
    flags = export_players(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_players"), F.sum(F.col("is_query").cast("long")).alias("n_queries"))
    return n.join(F.broadcast(flags))


@query("scan_csv_players", "SELECT c_custkey AS player_id, round(c_acctbal::DOUBLE, 2) AS height_in_cm, c_mktsegment AS foot FROM customer")
def scan_csv_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External players written as CSV and scanned with an explicit schema."""
    from lodestone.sources.files import load, scratch_path, write_csv

    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.round(F.col("c_acctbal").cast("double"), 2).alias("height_in_cm"), F.col("c_mktsegment").alias("foot"))
    return load(spark, write_csv(p, scratch_path(spark, "players") + ".csv"), "player_id long, height_in_cm double, foot string")


MOVES = """, mv AS (SELECT l_suppkey AS club, l_partkey AS player, p_brand AS pos, l_returnflag = 'R' AS left_club, (extract(year FROM l_shipdate) * 2 + CASE WHEN extract(month FROM l_shipdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS win FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("mine_replacements", SQL + MOVES + ", ga AS (SELECT ps FROM (SELECT l_partkey AS ps, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 25) SELECT DISTINCT a.player AS x, b.player AS y, a.pos FROM mv a JOIN mv b ON a.club = b.club AND a.pos = b.pos AND a.left_club AND NOT b.left_club AND b.win - a.win IN (0, 1) AND a.player <> b.player WHERE a.player IN (FROM ga) AND b.player IN (FROM ga)")
def mine_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A club loses x and signs y for the same position in the same or the next half-year; both in the gallery, here the parts that
    are traded 25 times or more.

    The band is an equality join: departures are listed under both windows that they can meet.
    """
    lines = table(spark, sf_dir, "lineitem")
    gallery = lines.groupBy(F.col("l_partkey").alias("player")).agg(F.count(F.lit(1)).alias("n")).where("n >= 25").select("player")
    line = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pos")), "l_partkey")
    win = (F.year("l_shipdate") * 2 + F.when(F.month("l_shipdate") > 6, 1).otherwise(0)).alias("win")
    moves = line.select(F.col("l_suppkey").alias("club"), F.col("l_partkey").alias("player"), "pos", (F.col("l_returnflag") == "R").alias("left_club"), win).join(gallery, "player", "left_semi")
    out = moves.where("left_club").select("club", "pos", F.col("player").alias("x"), F.explode(F.array("win", F.col("win") + 1)).alias("win")).distinct()
    into = moves.where("not left_club").select("club", "pos", F.col("player").alias("y"), "win").distinct()
    return out.join(into, ["club", "pos", "win"]).where("x <> y").select("x", "y", "pos").distinct()


FUZZY = """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '') WHEN c_custkey % 3 = 1 THEN upper(c_name) WHEN c_custkey % 5 = 0 THEN left(c_name, length(c_name) - 2) || 'x' WHEN c_custkey % 5 = 1 THEN 'Mr' || c_name ELSE c_name END AS name FROM customer),
 b AS (SELECT c_custkey AS ref, c_name AS name FROM customer), ex AS (SELECT id, ref, 'exact' AS method, 0 AS d FROM a JOIN b USING (name)), re AS (SELECT id, lower(name) AS name FROM a WHERE id NOT IN (SELECT id FROM ex)),
 fu AS (SELECT id, ref, 'fuzzy' AS method, levenshtein(re.name, lower(b.name)) AS d FROM re, b WHERE levenshtein(re.name, lower(b.name)) <= 2),
 be AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS k FROM fu) SELECT id, ref, method, d::INT AS d FROM ex UNION ALL SELECT id, ref, method, d::INT FROM be WHERE k = 1"""


@query("fuzzy_match", FUZZY)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched exactly first; the rest, in small letters, with the nearest known name within two edits."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_name")
    noted = F.when(k % 3 == 0, F.regexp_replace(n, "#", "")).when(k % 3 == 1, F.upper(n)).when(k % 5 == 0, F.concat(n.substr(F.lit(1), F.length(n) - 2), F.lit("x"))).when(k % 5 == 1, F.concat(F.lit("Mr"), n)).otherwise(n)
    a, b = c.select(k.alias("id"), noted.alias("name")), c.select(k.alias("ref"), n.alias("known"))
    exact = a.join(b.hint("merge"), F.col("name") == F.col("known")).select("id", "ref", F.lit("exact").alias("method"), F.lit(0).alias("d"))
    rest = stage(a.join(exact.hint("merge"), "id", "left_anti").select("id", F.lower("name").alias("name")), "unresolved")
    small = b.select("ref", F.lower("known").alias("known"))
    near = closest(rest, small.select(F.col("known").alias("name")))
    first = small.groupBy("known").agg(F.min("ref").alias("ref"))
    best = V.first_by(rest.join(near.hint("merge"), "name").join(first.hint("merge"), "known"), ["id"], ["d", "ref"]).select("id", "ref", F.lit("fuzzy").alias("method"), "d")
    return exact.unionByName(best)


GAMES = """, nm AS (SELECT game, team, CASE WHEN action_id % 10 = 0 THEN 'unknown' ELSE 'club ' || team END AS name, count(*) AS n FROM actions GROUP BY ALL), mj AS (SELECT game, team, name FROM (SELECT *, row_number() OVER (PARTITION BY game, team ORDER BY n DESC, name) AS k FROM nm) WHERE k = 1),
 gs AS (SELECT DISTINCT game, 'club ' || (game % 2) AS home, 'club ' || (1 - game % 2) AS away FROM actions), gm AS (SELECT game, team, count(*) FILTER (type = 'shot' AND ok) AS goals FROM actions GROUP BY ALL), pv AS (SELECT game, team, player, avg(x0) AS fx, avg(y0) AS fy FROM actions GROUP BY ALL),
 tv AS (SELECT game, team, avg(fx) AS fx, avg(fy) AS fy, count(*) AS n FROM pv GROUP BY game, team HAVING count(*) >= 3), sd AS (SELECT tv.*, goals, name FROM tv JOIN gm USING (game, team) JOIN mj USING (game, team))"""


@query("majority_names", SQL + GAMES + " SELECT game, team, name FROM mj")
def majority_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority_name(named_actions(spark, sf_dir), "game", "team")


def named_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the name of the team as it was noted down, which now and then is missing."""
    return B.actions(spark, sf_dir).withColumn("name", F.when(F.col("action_id") % 10 == 0, "unknown").otherwise(F.concat(F.lit("club "), "team")))


def majority_name(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, name): the most frequent name of each, the first of equals."""
    return V.first_by(rows.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n")), list(keys), [F.desc("n"), F.col("name")]).select(*keys, "name")


@query("match_features", SQL + GAMES + """ SELECT gs.game, round(h.fx, 6) AS home_x, round(h.fy, 6) AS home_y, round(a.fx, 6) AS away_x, round(a.fy, 6) AS away_y, CASE WHEN h.goals > a.goals THEN 'home' WHEN h.goals < a.goals THEN 'away' ELSE 'draw' END AS outcome
 FROM gs JOIN sd h ON h.game = gs.game AND h.name = gs.home JOIN sd a ON a.game = gs.game AND a.name = gs.away""")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of both teams (three players each at least) and the outcome of each game. Which team played at home follows from
    its most frequent name in the game's log."""
    a = named_actions(spark, sf_dir)
    player = a.groupBy("game", "team", "player").agg(F.avg("x0").alias("fx"), F.avg("y0").alias("fy"))
    team = player.groupBy("game", "team").agg(F.avg("fx").alias("fx"), F.avg("fy").alias("fy"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    goals = a.groupBy("game", "team").agg(F.count_if((F.col("type") == "shot") & F.col("ok")).alias("goals"))
    both = team.join(goals, ["game", "team"]).join(majority_name(a, "game", "team"), ["game", "team"])
    games = a.select("game", F.concat(F.lit("club "), F.col("game") % 2).alias("home"), F.concat(F.lit("club "), 1 - F.col("game") % 2).alias("away")).distinct()
    side = lambda name: both.select("game", F.col("name").alias(name), r6("fx").alias(f"{name}_x"), r6("fy").alias(f"{name}_y"), F.col("goals").alias(f"{name}_goals"))
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "home").when(F.col("home_goals") < F.col("away_goals"), "away").otherwise("draw")
    return games.join(side("home"), ["game", "home"]).join(side("away"), ["game", "away"]).select("game", "home_x", "home_y", "away_x", "away_y", outcome.alias("outcome"))


SH = f"""WITH ev AS (SELECT event_id, user_id AS player, 0 AS tourn FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY {U.format(key=chr(39) + 'sh|' + chr(39) + ' || event_id')}, event_id) AS i, count(*) OVER (PARTITION BY player) AS n FROM ev)
 SELECT event_id, player, CASE WHEN i <= least(n // 2, 200) THEN 'q' ELSE 't' END AS side FROM s WHERE n // 2 >= 10 AND i <= least(n // 2, 200) + 200"""


@query("split_half", SH)
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("player"))
    return S.split_half(e, ["player"], "event_id", "sh")


@query("event_cap", f"SELECT event_id, user_id AS player FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {U.format(key=chr(39) + 'ec|' + chr(39) + ' || event_id')}, event_id) AS i FROM events) WHERE i <= 600")
def event_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 600 random events of each player."""
    return S.capped(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("player")), ["player"], "event_id", "ec")


@query("split_samematch", SQL + f""", sz AS (SELECT player, game, count(*) AS n FROM actions GROUP BY ALL), f AS (SELECT player, game FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY n DESC, game) AS k FROM sz) WHERE k = 1),
 s AS (SELECT action_id, player, game, row_number() OVER (PARTITION BY player ORDER BY {U.format(key=chr(39) + 'sm|' + chr(39) + ' || action_id')}, action_id) AS i, count(*) OVER (PARTITION BY player) AS n FROM actions JOIN f USING (player, game)) SELECT action_id, player, game, CASE WHEN i <= least(n // 2, 200) THEN 'q' ELSE 't' END AS side FROM s WHERE n // 2 >= 2 AND i <= least(n // 2, 200) + 200""")
def split_samematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of each player's game with the most actions; the events are sparse, so two a side suffice."""
    a = B.actions(spark, sf_dir).select("action_id", "player", "game")
    return S.split_same_match(a, ["player"], "game", "action_id", "sm", least=2).select("action_id", "player", "game", "side")


@query("split_crossmatch", SQL + """, s AS (SELECT action_id, player, game, CASE WHEN (dense_rank() OVER (PARTITION BY player ORDER BY game) - 1) % 2 = 0 THEN 'q' ELSE 't' END AS side FROM actions),
 r AS (SELECT *, row_number() OVER (PARTITION BY player, side ORDER BY game, action_id) AS i, count(*) OVER (PARTITION BY player, side) AS n FROM s), o AS (SELECT player FROM r WHERE i = 1 GROUP BY player HAVING count(*) = 2 AND min(n) >= 10) SELECT action_id, player, side FROM r JOIN o USING (player) WHERE i <= 200""")
def split_crossmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.actions(spark, sf_dir).select("action_id", "player", "game")
    return S.split_cross_match(a, ["player"], "game", ["game", "action_id"]).select("action_id", "player", "side")


PROT = SQL + f""", a2 AS (SELECT *, competition AS tourn FROM actions), sh AS (SELECT *, row_number() OVER (PARTITION BY tourn, player ORDER BY {U.format(key=chr(39) + 'lp|' + chr(39) + ' || action_id')}, action_id) AS i, count(*) OVER (PARTITION BY tourn, player) AS n FROM a2),
 s1 AS (SELECT 'split_half' AS protocol, tourn, player, CASE WHEN i <= least(n // 2, 200) THEN 'q' ELSE 't' END AS side, x0, y0, x1, y1 FROM sh WHERE n // 2 >= 3 AND i <= least(n // 2, 200) + 200),
 gs AS (SELECT tourn, player, game FROM (SELECT *, row_number() OVER (PARTITION BY tourn, player ORDER BY n DESC, game) AS k FROM (SELECT tourn, player, game, count(*) AS n FROM a2 GROUP BY ALL)) WHERE k = 1),
 sm AS (SELECT a2.*, row_number() OVER (PARTITION BY tourn, player ORDER BY {U.format(key=chr(39) + 'lq|' + chr(39) + ' || action_id')}, action_id) AS i, count(*) OVER (PARTITION BY tourn, player) AS n FROM a2 JOIN gs USING (tourn, player, game)),
 s3 AS (SELECT 'same_match' AS protocol, tourn, player, CASE WHEN i <= least(n // 2, 200) THEN 'q' ELSE 't' END AS side, x0, y0, x1, y1 FROM sm WHERE n // 2 >= 1 AND i <= least(n // 2, 200) + 200),
 cm AS (SELECT *, CASE WHEN (dense_rank() OVER (PARTITION BY tourn, player ORDER BY game) - 1) % 2 = 0 THEN 'q' ELSE 't' END AS side FROM a2), cn AS (SELECT *, count(*) OVER (PARTITION BY tourn, player, side) AS n, row_number() OVER (PARTITION BY tourn, player, side ORDER BY game, action_id) AS place FROM cm), ok AS (SELECT tourn, player FROM cn GROUP BY tourn, player HAVING count(DISTINCT side) = 2 AND min(n) >= 3),
 s2 AS (SELECT 'cross_match' AS protocol, tourn, player, side, x0, y0, x1, y1 FROM cn JOIN ok USING (tourn, player) WHERE place <= 200), al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT 'cross_no_mates', tourn, player, side, x0, y0, x1, y1 FROM s2),
 v AS (SELECT protocol, tourn, player, side, count(*) AS events, [avg(x0), avg(y0), avg(x1), avg(y1)] AS vec FROM al GROUP BY ALL),
 ss AS (SELECT a.protocol, a.tourn, a.player AS q, b.player AS c, a.events + b.events AS events, {COS} AS s FROM v a JOIN v b ON a.protocol = b.protocol AND a.tourn = b.tourn AND a.side = 'q' AND b.side = 't' WHERE a.protocol <> 'cross_no_mates' OR a.player = b.player OR a.player % 2 <> b.player % 2),
 rk AS (SELECT protocol, tourn, q, c, events, row_number() OVER (PARTITION BY protocol, tourn, q ORDER BY s DESC, c) AS place FROM ss), own AS (SELECT protocol, tourn, q, place, events FROM rk WHERE q = c),
 un AS (SELECT protocol, CAST(place = 1 AS DOUBLE) AS total, 1 AS n, row_number() OVER (PARTITION BY protocol ORDER BY tourn || '|' || q) - 1 AS idx, count(*) OVER (PARTITION BY protocol) AS k FROM own)"""
INTERVALS = tree_sql("mn", "un", "protocol", 2000, "t1") + """,
 ti AS (SELECT protocol, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM mn GROUP BY protocol), tp AS (SELECT protocol, count(*) AS n, avg(total) AS top1 FROM un GROUP BY protocol)"""


EVENT = ["x0", "y0", "x1", "y1"]


def protocol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protocol, tourn, player, team, side and the event's columns: the events that stand on each side under three protocols."""
    a = B.actions(spark, sf_dir).withColumn("tourn", F.col("competition"))
    keys, every = ["tourn", "player"], 200
    cross = S.split_cross_match(a, keys, "game", ["game", "action_id"], every, 3)
    sides = {"split_half": S.split_half(a, keys, "action_id", "lp", every, 3), "same_match": S.split_same_match(a, keys, "game", "action_id", "lq", every, 1), "cross_match": cross}
    return functools.reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("protocol"), *keys, "team", "side", *EVENT) for name, x in sides.items()])


def protocol_profiles(rows: DataFrame, encoder: SetEncoder | None = None, columns: list[str] = EVENT) -> DataFrame:
    """protocol, tourn, player, team, side, vec, events, written to disk: ``encoder`` makes a vector of a side's events, their means if none is
    given."""
    keys = ["protocol", "tourn", "player", "team", "side"]
    if encoder is None:
        own = rows.dropna(subset=columns).groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("vec"), F.count(F.lit(1)).alias("events"))
    else:
        own = encoded(rows, keys, columns, encoder)
    return stage(own, "profiles")


def places_of(profiles: DataFrame, counted: bool = False) -> DataFrame:
    """protocol, tourn, player, place, and events of both sides if ``counted``."""
    keys = ["protocol", "tourn", "player"]
    apart = profiles.where("protocol = 'cross_match'").withColumn("protocol", F.lit("cross_no_mates"))
    vec = profiles.unionByName(apart).withColumn("mate", F.when(F.col("protocol") == "cross_no_mates", F.col("team")))
    found = R.identity_ranks(vec.where("side = 'q'"), vec.where("side = 't'"), ["protocol", "tourn"], "player", "mate")
    return found.join(vec.groupBy(*keys).agg(F.sum("events").alias("events")), keys) if counted else found


def protocol_places(rows: DataFrame, encoder: SetEncoder | None = None, columns: list[str] = EVENT, counted: bool = False) -> DataFrame:
    """protocol, tourn, player, place, and events of both sides if ``counted``: identity ranks under four protocols, in one pass. Halves of all
    events; halves of the game with the most events; even and odd games; the same with the query's teammates out of the gallery. At most 200
    events a side."""
    return places_of(protocol_profiles(rows, encoder, columns), counted)


@query("leakage_encoders")
def leakage_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocols over three encoders: means of events, heat maps of where they begin, and weights of eight factors of such maps."""
    heat = heatmap_encoder(12, 8)
    a = B.actions(spark, sf_dir)
    basis = fit_factors(encoded(a, ["player"], ["x0", "y0"], heat), 8)
    encoders = {"mean": (None, EVENT), "heatmap": (heat, ["x0", "y0"]), "factors": (factor_encoder(heat, basis), ["x0", "y0"])}
    rows = stage(protocol_rows(spark, sf_dir), "sides")  # drawn once for all encoders
    parts = []
    for name, (encoder, columns) in encoders.items():  # one after the other, so that the disk holds one encoder's profiles and copies
        profiles = protocol_profiles(rows, encoder, columns)
        by = places_of(profiles).groupBy(F.lit(name).alias("encoder"), "protocol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(_hit())).alias("top1"), r6(F.avg(1 / F.col("place"))).alias("mrr"))
        parts.append(stage(by, "encoder"))
        discard(profiles)
    discard(rows)
    return functools.reduce(DataFrame.unionByName, parts)


@query("leakage_protocols", PROT + ", pl AS (SELECT tourn, count(DISTINCT player) AS players FROM a2 GROUP BY tourn) SELECT protocol, tourn, count(*) AS n, round(avg(CAST(place = 1 AS DOUBLE)), 6) AS top1, round(avg(1.0 / place), 6) AS mrr, players - count(*) AS skipped, round(sum(events) / 2.0 / count(*), 6) AS events_a_side FROM own JOIN pl USING (tourn) GROUP BY protocol, tourn, players")
def leakage_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by protocol and tournament, the players that a protocol has to skip, and the mean number of events on a side."""
    players = B.actions(spark, sf_dir).groupBy(F.col("competition").alias("tourn")).agg(F.countDistinct("player").alias("players"))
    by = protocol_places(protocol_rows(spark, sf_dir), counted=True).groupBy("protocol", "tourn").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(_hit())).alias("top1"), r6(F.avg(1 / F.col("place"))).alias("mrr"), r6(F.sum("events") / 2.0 / F.count(F.lit(1))).alias("events_a_side"))
    return by.join(players, "tourn").select("protocol", "tourn", "n", "top1", "mrr", (F.col("players") - F.col("n")).alias("skipped"), "events_a_side")


def _hit() -> Column:
    return (F.col("place") == 1).cast("double")


@query("identity_agg", PROT + ", g AS (SELECT protocol, tourn, round(avg(CAST(place = 1 AS DOUBLE)), 3) AS top1, count(*) AS n FROM own GROUP BY GROUPING SETS ((protocol, tourn), (protocol))) SELECT protocol, coalesce(tourn, -1) AS tourn, n, round(top1, 3) AS top1 FROM g UNION ALL SELECT protocol, -2, count(*), round(avg(top1), 6) FROM g WHERE tourn IS NOT NULL GROUP BY protocol")
def identity_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by tournament, pooled (tourn -1), and the mean of the tournaments' rounded figures (tourn -2)."""
    p = protocol_places(protocol_rows(spark, sf_dir)).withColumn("hit", _hit())
    sets = p.groupingSets([["protocol", "tourn"], ["protocol"]], "protocol", "tourn").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 3).alias("top1"))
    by = stage(sets, "grouping")
    macro = by.where("tourn is not null").groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("top1")).alias("top1")).withColumn("tourn", F.lit(-2).cast("long"))
    return by.fillna(-1, "tourn").unionByName(macro)


def top1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protocol, n, top1, low, high: pooled accuracy with a bootstrap interval over entities."""
    p = stage(protocol_places(protocol_rows(spark, sf_dir)).select("protocol", F.concat_ws("|", "tourn", "player").alias("q"), _hit().alias("value")), "places")
    return p.groupBy("protocol").agg(F.count(F.lit(1)).alias("n")).join(I.paired_bootstrap(p, 2000, "t1", "protocol"), "protocol").select("protocol", "n", F.col("mean").alias("top1"), "low", "high")


@query("top1_interval", PROT + INTERVALS + " SELECT protocol, n, round(top1, 6) AS top1, round(low, 6) AS low, round(high, 6) AS high FROM tp JOIN ti USING (protocol)")
def top1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top1_intervals(spark, sf_dir).select("protocol", "n", *[r6(c).alias(c) for c in ("top1", "low", "high")])


@query("leakage_verdict", PROT + INTERVALS + """, m AS (SELECT max(top1) FILTER (protocol = 'split_half') AS a, max(low) FILTER (protocol = 'split_half') AS a_low, max(top1) FILTER (protocol = 'cross_match') AS b, max(high) FILTER (protocol = 'cross_match') AS b_high, max(top1) FILTER (protocol = 'same_match') AS c FROM tp JOIN ti USING (protocol))
 SELECT round(a - b, 6) AS delta, b_high < a_low AS disjoint, b_high < a_low AND a - b > 0.25 AS collapses, CASE WHEN b >= 0.5 THEN 'identity' WHEN b >= 0.3 THEN 'partial' ELSE 'leakage' END AS verdict, CASE WHEN c >= 0.5 AND b < 0.3 THEN 'confirmed' ELSE 'inconclusive' END AS control FROM m""")
def leakage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drop from halves to other games, whether it is a collapse (intervals apart and over 0.25), what the rest means, and the
    control: within one game accuracy stays high."""
    of = lambda p, c: F.max(F.when(F.col("protocol") == p, F.col(c)))
    m = top1_intervals(spark, sf_dir).agg(of("split_half", "top1").alias("a"), of("split_half", "low").alias("a_low"), of("cross_match", "top1").alias("b"), of("cross_match", "high").alias("b_high"), of("same_match", "top1").alias("c"))
    apart, drop = F.col("b_high") < F.col("a_low"), F.col("a") - F.col("b")
    verdict = F.when(F.col("b") >= 0.5, "identity").when(F.col("b") >= 0.3, "partial").otherwise("leakage")
    return m.select(r6(drop).alias("delta"), apart.alias("disjoint"), (apart & (drop > 0.25)).alias("collapses"), verdict.alias("verdict"), F.when((F.col("c") >= 0.5) & (F.col("b") < 0.3), "confirmed").otherwise("inconclusive").alias("control"))
