"""Queries of neighbours, groups, projections, composite artifacts and the explorer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import sampling
from vectide.operators import cluster, explore, knn, layout, overlay, project, validate
from vectide.operators.metrics import unit_rows
from vectide.operators.order import numbered
from vectide.plans import artifacts, views
from vectide.queries.registry import load, query, shared_path, windows, with_windows
from vectide.queries.relational import SAMPLE, TAGS
from vectide.queries.selection import ETAS, GRID, MASKS, mask_cte, ranked_sql, rankings, rankings_sql
from vectide.sources.scratch import written


UNIT = "u AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM windows)"
FIT = SAMPLE.format("window_id").replace("< 8", "< 20")


def _fit(w: DataFrame) -> DataFrame:
    return w.where(sampling.hash_sample(F.col("window_id"), 20))


@query("j14_knn_join", with_windows(f"WITH {UNIT}, n AS (SELECT a.window_id AS query, b.window_id AS target, list_inner_product(a.u, b.u) AS c FROM u a, u b WHERE NOT ({FIT.replace('window_id', 'a.window_id')}) AND {FIT.replace('window_id', 'b.window_id')}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, target) AS place FROM n) SELECT query, target, CAST(place AS INTEGER) AS place, round(c, 6) AS score, round(exp(12 * (c - max(c) OVER w)) / sum(exp(12 * c)) OVER w * exp(12 * max(c) OVER w), 6) AS weight FROM r WHERE place <= 8 WINDOW w AS (PARTITION BY query)"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("window_id", "embedding")
    near = knn.nearest(w.where(~sampling.hash_sample(F.col("window_id"), 20)), _fit(w), 8, "window_id")
    every = Window.partitionBy("query")
    e = F.exp(12 * (F.col("score") - F.max("score").over(every)))
    return near.select("query", "target", "place", F.round("score", 6).alias("score"), F.round(e / F.sum(F.exp(12 * F.col("score"))).over(every) * F.exp(12 * F.max("score").over(every)), 6).alias("weight"))


@query("x4_interpolation", with_windows(f"WITH {UNIT}, n AS (SELECT a.window_id AS query, b.window_id AS target, list_inner_product(a.u, b.u) AS c, b.embedding[1] AS x, b.embedding[2] AS y FROM u a, u b WHERE NOT ({FIT.replace('window_id', 'a.window_id')}) AND {FIT.replace('window_id', 'b.window_id')}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, target) AS place FROM n), t AS (SELECT *, exp(12 * (c - max(c) OVER (PARTITION BY query))) AS wt FROM r WHERE place <= 8) SELECT query AS window_id, round(sum(wt * x) / sum(wt), 6) AS x, round(sum(wt * y) / sum(wt), 6) AS y FROM t GROUP BY 1 UNION ALL SELECT window_id, round(embedding[1], 6), round(embedding[2], 6) FROM windows WHERE {FIT}"))
def x4(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("window_id", "embedding", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    out = knn.interpolate(w.where(~sampling.hash_sample(F.col("window_id"), 20)), _fit(w), "window_id", "embedding", "x", "y")
    return out.select("window_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("j15_nearest_target", with_windows(f"WITH {UNIT}, n AS (SELECT a.window_id AS query, b.window_id AS target, row_number() OVER (PARTITION BY a.window_id ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.window_id) AS p FROM u a, u b WHERE a.recon_loss > 100 AND b.recon_loss <= 100) SELECT query, target FROM n WHERE p = 1"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    return knn.nearest(w.where("recon_loss > 100"), w.where("recon_loss <= 100"), 1, "window_id").select("query", "target")


@query("j16_ball", with_windows(f"WITH {UNIT}, s AS (SELECT * FROM u ORDER BY md5(window_id) LIMIT 4), n AS (SELECT s.window_id AS query, u.window_id AS target, row_number() OVER (PARTITION BY s.window_id ORDER BY round(list_inner_product(s.u, u.u), 9) DESC, u.window_id) AS place FROM s, u) SELECT query, target, CAST(place AS INTEGER) AS place FROM n WHERE place <= 16"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    seeds = w.orderBy(F.md5(F.col("window_id").cast("binary"))).limit(4)
    return knn.nearest(seeds, w, 16, "window_id").select("query", "target", "place")


PLANE = "p AS (SELECT window_id, big_recording_index AS g, embedding[1] AS x, embedding[2] AS y FROM windows)"
NEAR2 = f"{PLANE}, k AS (SELECT a.window_id AS query, b.window_id AS target, row_number() OVER (PARTITION BY a.window_id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9), b.window_id) AS place FROM p a JOIN p b ON a.window_id <> b.window_id)"


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return knn.plane_nearest(windows(spark, d).select("window_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")), 8, "window_id", "x", "y")


@query("j17_plane_neighbours", with_windows(f"WITH {NEAR2} SELECT query, target, CAST(place AS INTEGER) AS place FROM k WHERE place <= 8"))
def j17(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d).select("query", "target", "place")


@query("a30_adjacency", with_windows(f"WITH {NEAR2} SELECT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b, count(*) AS contacts FROM k JOIN p a ON a.window_id = query JOIN p b ON b.window_id = target WHERE place <= 8 AND a.g <> b.g GROUP BY 1, 2 HAVING count(*) >= 20"))
def a30(spark: SparkSession, d: str) -> DataFrame:
    groups = windows(spark, d).select(F.col("window_id").alias("row_id"), F.col("big_recording_index").alias("group_id"))
    return cluster.adjacency(_plane(spark, d), groups)


@query("g13_colours")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return cluster.coloured(a30(spark, d), windows(spark, d).select(F.col("big_recording_index").alias("group_id")))


@query("g13_colour_conflicts", with_windows(f"WITH {NEAR2} SELECT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b, count(*) AS contacts, false AS same FROM k JOIN p a ON a.window_id = query JOIN p b ON b.window_id = target WHERE place <= 8 AND a.g <> b.g GROUP BY 1, 2 HAVING count(*) >= 20"))
def g13_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of touching groups and whether they share a colour: a palette as large as the number of groups leaves no conflict."""
    contacts = written(a30(spark, d), "touching")
    groups = windows(spark, d).select(F.col("big_recording_index").alias("group_id")).distinct()
    c = written(cluster.coloured(contacts, groups, palette=max(10, groups.count())), "colours")
    side = lambda x: c.select(F.col("group_id").alias(x), F.col("group_colour").alias(f"colour_{x}"))
    return contacts.join(side("a"), "a").join(side("b"), "b").select("a", "b", "contacts", (F.col("colour_a") == F.col("colour_b")).alias("same"))


@query("j18_best_similarity", with_windows(f"WITH {UNIT}, s AS (SELECT * FROM u WHERE {SAMPLE.format('window_id')}) SELECT s.window_id AS query, round(max(list_inner_product(s.u, t.u)), 6) AS score FROM s, (SELECT * FROM u WHERE recon_loss > 60) t GROUP BY 1"))
def j18(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    return knn.best_score(w.where(sampling.hash_sample(F.col("window_id"))), w.where("recon_loss > 60"), "window_id").select("query", F.round("score", 6).alias("score"))


@query("a14_coverage", with_windows(f"WITH {UNIT}, s AS (SELECT * FROM u WHERE {SAMPLE.format('window_id')}), b AS (SELECT s.window_id, max(list_inner_product(s.u, t.u)) AS c FROM s, (SELECT * FROM u WHERE recon_loss > 60) t GROUP BY 1) SELECT round(avg(CASE WHEN c >= 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS c30, round(avg(CASE WHEN c >= 0.8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS c80 FROM b"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    out = knn.coverage(w.where(sampling.hash_sample(F.col("window_id"))), w.where("recon_loss > 60"), (0.3, 0.8))
    return out.select(F.round("`coverage_0.3`", 6).alias("c30"), F.round("`coverage_0.8`", 6).alias("c80"))


PAIRS = f"{UNIT}, e AS (SELECT a.window_id AS i, b.window_id AS j, CASE WHEN a.window_id = b.window_id THEN 0.0::DOUBLE ELSE sqrt(greatest(0.0::DOUBLE, 2 - 2 * list_inner_product(a.u, b.u))) END AS dist FROM u a, u b), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist) AS r FROM e), cd AS (SELECT i, dist AS core FROM o WHERE r = 5), rd AS (SELECT e.i, min(greatest(cd.core, e.dist)) AS far FROM e JOIN cd ON cd.i = e.j WHERE e.i <> e.j GROUP BY 1), both_ AS (SELECT cd.i AS row_id, core, least(core, far) AS reach FROM cd JOIN rd ON rd.i = cd.i)"


def _density(spark: SparkSession, d: str) -> DataFrame:
    return cluster.density(windows(spark, d).select(F.col("window_id").alias("row_id"), "embedding"), 5)


def _dbscan(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(windows(spark, d).select(F.col("window_id").alias("row_id"), "embedding"), 1.1, 5)


@query("g2_reach", with_windows(f"WITH {PAIRS} SELECT row_id, round(core, 6) AS core, round(reach, 6) AS reach FROM both_"))
def g2(spark: SparkSession, d: str) -> DataFrame:
    return _density(spark, d).select("row_id", F.round("core", 6).alias("core"), F.round("reach", 6).alias("reach"))


@query("g3_prune_level", with_windows(f"WITH {PAIRS} SELECT eps, round(avg(CASE WHEN reach <= eps THEN 1.0::DOUBLE ELSE 0 END), 6) AS clustered FROM both_, (SELECT unnest([0.9, 1.0, 1.1, 1.2])::DOUBLE AS eps) GROUP BY eps"))
def g3(spark: SparkSession, d: str) -> DataFrame:
    r = _density(spark, d)
    levels = r.select("reach", F.explode(F.array(*[F.lit(e) for e in (0.9, 1.0, 1.1, 1.2)])).alias("eps"))
    return levels.groupBy("eps").agg(F.round(F.avg((F.col("reach") <= F.col("eps")).cast("double")), 6).alias("clustered"))


@query("a29_eps_curve", with_windows(f"WITH {PAIRS}, g AS (SELECT i, pow(10.0::DOUBLE, -3 + 3 * i / 399.0::DOUBLE) AS eps FROM range(400) t(i)) SELECT CAST(g.i AS INTEGER) AS at, round(avg(CASE WHEN core <= eps THEN 1.0::DOUBLE ELSE 0 END), 6) AS core_frac, round(avg(CASE WHEN reach <= eps THEN 1.0::DOUBLE ELSE 0 END), 6) AS clustered_frac FROM both_, g GROUP BY 1".replace(" AS at,", ' AS "at",')))
def a29(spark: SparkSession, d: str) -> DataFrame:
    """Fractions over 400 geometric distances: each row falls into a level once, and levels add up."""
    r = _density(spark, d)
    grid = spark.range(400).select(F.col("id").cast("int").alias("at"), F.pow(F.lit(10.0), -3 + 3 * F.col("id") / F.lit(399.0)).alias("eps"))
    level = lambda c: F.greatest(F.lit(0), F.ceil((F.log10(F.col(c)) + 3) * 399 / 3 - 1e-9)).cast("int")
    total = F.broadcast(r.agg(F.count(F.lit(1)).alias("n")))
    out = grid
    for c, name in (("core", "core_frac"), ("reach", "clustered_frac")):
        counts = r.groupBy(level(c).alias("at")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.coalesce(F.sum("c").over(Window.orderBy("at")), F.lit(0))
        out = out.join(counts, "at", "left").withColumn(name, upto).drop("c")
    return out.join(total).select("at", *[F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("core_frac", "clustered_frac")])


DB = f"""{PAIRS}, n AS (SELECT i, j FROM e WHERE dist <= 1.1), core AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 5), cn AS (SELECT n.i, n.j FROM n JOIN core a ON a.i = n.i JOIN core b ON b.i = n.j),
walk AS (SELECT i AS root, i FROM core UNION SELECT w.root, cn.j FROM walk w JOIN cn ON cn.i = w.i), lab AS (SELECT i, min(root) AS root FROM walk GROUP BY i),
bord AS (SELECT n.i, min(lab.root) AS root FROM n JOIN lab ON lab.i = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY 1), al AS (SELECT * FROM lab UNION ALL SELECT * FROM bord), fst AS (SELECT root, min(i) AS f FROM al GROUP BY 1)"""


@query("g1_dbscan", with_windows(f"WITH RECURSIVE {DB} SELECT window_id AS row_id, coalesce(CAST(l AS BIGINT), -1) AS label FROM windows LEFT JOIN (SELECT i, dense_rank() OVER (ORDER BY f) - 1 AS l FROM al JOIN fst USING (root)) ON i = window_id"))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return _dbscan(spark, d).select("row_id", "label")


@query("g5_attach_noise", with_windows(f"WITH RECURSIVE {DB}, named AS (SELECT window_id, u, root FROM u LEFT JOIN al ON al.i = window_id), near AS (SELECT a.window_id AS query, b.root, row_number() OVER (PARTITION BY a.window_id ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.window_id) AS p FROM named a, named b WHERE a.root IS NULL AND b.root IS NOT NULL) SELECT query AS row_id, CAST(l AS BIGINT) AS label FROM near JOIN (SELECT root, dense_rank() OVER (ORDER BY f) - 1 AS l FROM fst) USING (root) WHERE p = 1"))
def g5(spark: SparkSession, d: str) -> DataFrame:
    labelled = _dbscan(spark, d).select(F.col("row_id").alias("window_id"), "label").join(windows(spark, d).select("window_id", "embedding"), "window_id")
    kept = labelled.where("label >= 0")
    near = knn.nearest(labelled.where("label < 0"), kept, 1, "window_id")
    return near.join(kept.select(F.col("window_id").alias("target"), "label"), "target").select(F.col("query").alias("row_id"), "label")


def _grouped(spark: SparkSession, d: str, control: bool = False) -> DataFrame:
    limits = cluster.Limits(n_max=120, n_min=30, eps0=1.15)
    return cluster.grouped(windows(spark, d).select(F.col("window_id").alias("row_id"), "embedding"), limits, control=control)


@query("g4_grouping")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d)


#: What a window is in the planted table, from its recording and its number: a cloud, a part of a dense one, or a row by itself beside a cloud.
PLANTED = "CASE WHEN big_recording_index IN (5, 6, 7) THEN CASE WHEN vec_id % 20 < 10 THEN 'a' WHEN vec_id % 20 < 17 THEN 'b' ELSE 'c' END WHEN big_recording_index = 8 THEN CAST(vec_id % 5 AS STRING) ELSE CAST(big_recording_index AS STRING) END"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Six clouds, rows by themselves nearest to the first five, and a cloud of three parts that are too close for a distance to tell apart."""
    place, alone = F.expr(PLANTED), F.col("big_recording_index") == 8
    near = {"a": (0.0, 0.0), "b": (0.04, 0.0), "c": (0.012, 0.032)}
    base = [F.when(place == str(i), 1.0).otherwise(F.when(place.isin("a", "b", "c"), 1.0 if i == 5 else 0.0).otherwise(0.0)) for i in range(10)]
    inside = [F.when(place == "b", near["b"][i]).when(place == "c", near["c"][i]).otherwise(0.0) for i in range(2)]
    spread = F.when(alone, 0.9).when(place.isin("a", "b", "c"), 0.001).otherwise(0.02)
    return unit_rows(windows(spark, d)).select(F.col("window_id").alias("row_id"), F.concat(F.array(*base, *inside), F.transform("unit", lambda x: x * spread)).alias("embedding"))


@query("g10_density_groups", with_windows(f"WITH p AS (SELECT window_id, big_recording_index = 8 AS attached, CASE {PLANTED.replace('STRING', 'VARCHAR').replace(chr(39) + 'c' + chr(39), chr(39) + 'b' + chr(39))} WHEN 'a' THEN 'a' WHEN 'b' THEN 'b' ELSE 'cloud ' || {PLANTED.replace('STRING', 'VARCHAR')} END AS g FROM windows), f AS (SELECT g, min(window_id) AS f, CAST(count(*) AS INTEGER) AS group_size FROM p GROUP BY 1), n AS (SELECT *, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS group_id FROM f) SELECT window_id AS row_id, group_id, CAST(CASE WHEN g IN ('a', 'b') THEN 2 ELSE 1 END AS INTEGER) AS group_depth, CASE g WHEN 'a' THEN 'kmeans' WHEN 'b' THEN 'kmeans+merged' ELSE 'dbscan' END AS group_split, group_size, attached FROM p JOIN n USING (g)"))
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Density tells clouds apart, rows by themselves are attached, k-means cuts the dense cloud, and its small part joins the one with room, not the nearest."""
    rows = _planted(spark, d)
    n = rows.count()
    return cluster.grouped(rows, cluster.Limits(n_max=int(0.16 * n), n_min=int(0.06 * n), eps0=0.4)).drop("group_path")


@query("g11_kmeans_control")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, control=True)


@query("g12_partition_invariants", with_windows("SELECT count(*) AS rows, 0::BIGINT AS repeated, 0::BIGINT AS small, 0::BIGINT AS large, 0::BIGINT AS size_differs FROM windows"))
def g12(spark: SparkSession, d: str) -> DataFrame:
    return validate.partition_violations(_grouped(spark, d), 30, 120).drop("groups")


@query("g12_broken_partition", with_windows("WITH g AS (SELECT window_id, big_recording_index AS g, count(*) OVER (PARTITION BY big_recording_index) + CASE WHEN vec_id % 90 = 0 THEN 1 ELSE 0 END AS s FROM windows UNION ALL SELECT window_id, 99, 7 FROM windows WHERE vec_id % 50 = 0), p AS (SELECT g, count(*) AS n, min(s) AS a, max(s) AS z FROM g GROUP BY 1) SELECT (SELECT count(*) FROM g) AS rows, (SELECT count(*) - count(DISTINCT window_id) FROM g) AS repeated, count(*) AS groups, count(*) FILTER (n < 45) AS small, count(*) FILTER (n > 55) AS large, count(*) FILTER (n <> a OR n <> z) AS size_differs FROM p"))
def g12b(spark: SparkSession, d: str) -> DataFrame:
    """Groups that break every rule."""
    w = windows(spark, d)
    sizes = w.groupBy("big_recording_index").agg(F.count(F.lit(1)).alias("n"))
    size = F.col("n") + F.when(F.col("vec_id") % 90 == 0, 1).otherwise(0)
    good = w.join(sizes, "big_recording_index").select(F.col("window_id").alias("row_id"), F.col("big_recording_index").alias("group_id"), size.alias("group_size"))
    twice = w.where("vec_id % 50 = 0").select(F.col("window_id").alias("row_id"), F.lit(99).cast("long").alias("group_id"), F.lit(7).cast("long").alias("group_size"))
    return validate.partition_violations(good.unionAll(twice), 45, 55)


@query("a28_group_sizes", with_windows("WITH s AS (SELECT big_recording_index AS g, count(*) AS n FROM windows GROUP BY 1) SELECT round(min(n), 6) AS p0, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(avg(CASE WHEN n >= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS large FROM s".replace("round(min(n), 6)", "CAST(min(n) AS DOUBLE)")))
def a28(spark: SparkSession, d: str) -> DataFrame:
    s = windows(spark, d).groupBy("big_recording_index").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.min("n").cast("double").alias("p0"), *[F.round(F.percentile("n", F.lit(q / 100)), 6).alias(f"p{q}") for q in (5, 50, 95)], F.round(F.avg((F.col("n") >= 50).cast("double")), 6).alias("large"))


@query("w9_canonical_labels", "WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE o_custkey END AS label FROM orders), f AS (SELECT label, dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM t WHERE label >= 0 GROUP BY label) SELECT o_orderkey, CAST(coalesce(c, -1) AS INTEGER) AS canonical FROM t LEFT JOIN f USING (label)")
def w9(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("label"))
    return cluster.noise_labels(t, "label", "o_orderkey").select("o_orderkey", "canonical")


@query("w10_group_ids", with_windows("SELECT window_id AS row_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS group_id, CAST(n AS INTEGER) AS group_size FROM (SELECT window_id, min(window_id) OVER (PARTITION BY dataset) AS f, count(*) OVER (PARTITION BY dataset) AS n FROM windows)"))
def w10(spark: SparkSession, d: str) -> DataFrame:
    return cluster.number_groups(windows(spark, d).select(F.col("window_id").alias("row_id"), "dataset"), ["dataset"]).select("row_id", "group_id", "group_size")


@query("x1_projection")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return project.project(windows(spark, d))


@query("x1_fuzzy_graph", with_windows(f"""WITH RECURSIVE {UNIT}, n AS (SELECT a.window_id AS q, b.window_id AS t, greatest(0.0::DOUBLE, 1 - list_inner_product(a.u, b.u)) AS far, row_number() OVER (PARTITION BY a.window_id ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.window_id) AS p FROM u a JOIN u b ON a.window_id <> b.window_id),
 r AS (SELECT *, greatest(0.0::DOUBLE, far - coalesce(min(far) FILTER (far > 0) OVER (PARTITION BY q), 0)) AS beyond FROM n WHERE p <= 14), l AS (SELECT q, list(beyond) AS d, avg(far) AS m FROM r GROUP BY 1),
 b AS (SELECT q, d, 0.0::DOUBLE AS lo, 1e300::DOUBLE AS hi, 1.0::DOUBLE AS w, 0 AS step FROM l UNION ALL SELECT q, d, nlo, nhi, CASE WHEN nhi = 1e300 THEN w * 2 ELSE (nlo + nhi) / 2 END, step + 1 FROM (SELECT *, CASE WHEN small THEN w ELSE lo END AS nlo, CASE WHEN small THEN hi ELSE w END AS nhi FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-x / w))) < log2(14) AS small FROM b WHERE step < 64))),
 s AS (SELECT r.q, r.t, CASE WHEN beyond > 0 THEN exp(-beyond / greatest(w, 1e-3 * m)) ELSE 1.0::DOUBLE END AS p FROM r JOIN b ON b.q = r.q AND b.step = 64 JOIN l ON l.q = r.q),
 e AS (SELECT least(q, t) AS a, greatest(q, t) AS b, coalesce(max(p) FILTER (q < t), 0) AS p, coalesce(max(p) FILTER (q > t), 0) AS o FROM s GROUP BY 1, 2) SELECT a, b, round(p + o - p * o, 6) AS weight FROM e"""))
def x1g(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(unit_rows(windows(spark, d)).select("window_id", "unit"), "window_id", name="at")
    graph = layout.fuzzy_graph(rows.select("at", "unit"))
    for c in "ab":
        graph = graph.join(rows.select(F.col("at").alias(c), F.col("window_id").alias(f"id_{c}")), c).drop(c).withColumnRenamed(f"id_{c}", c)
    return graph.select("a", "b", F.round("weight", 6).alias("weight"))


@query("x1_umap")
def x1u(spark: SparkSession, d: str) -> DataFrame:
    return project.project(windows(spark, d), "umap")


@query("x2_tsne")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return project.project(windows(spark, d), "tsne")


@query("x5_realigned", with_windows("SELECT window_id, round(embedding[1], 6) AS projection_x, round(embedding[2], 6) AS projection_y, dataset FROM windows"))
def x5(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    old = w.select("window_id", "dataset", F.lit(0.0).alias("projection_x"), F.lit(0.0).alias("projection_y"))
    new = w.select("window_id", F.round(F.col("embedding")[0], 6).alias("projection_x"), F.round(F.col("embedding")[1], 6).alias("projection_y"))
    return artifacts.realign(old, new)


@query("d17_pivot_probe")
def d17(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.pivot_probe(windows(spark, d))


@query("a25_probe_summary", with_windows("WITH p AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 16 ELSE 32 END AS size, vec_id % 17 AS r, abs(embedding[1]) AS part, embedding[2] AS kth FROM windows) SELECT CAST(size AS INTEGER) AS size, round(quantile_cont(r, 0.05), 6) AS r_op_p5, round(quantile_cont(r, 0.5), 6) AS r_op_median, CAST(min(r) AS INTEGER) AS r_op_min, CAST(max(r) AS INTEGER) AS r_op_max, round(quantile_cont(part, 0.5), 6) AS participation_median, round(quantile_cont(part, 0.05), 6) AS participation_p5, round(quantile_cont(kth, 0.5), 6) AS kth_cosine_median, CAST(ceil(0.1::DOUBLE * size) AS BIGINT) AS request_k, ceil(0.1::DOUBLE * size) <= 0.9 * quantile_cont(r, 0.05) AS passes_rule FROM p GROUP BY size"))
def a25(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a probe that the tables give."""
    v = F.col("vec_id")
    probe = windows(spark, d).select(F.col("window_id").alias("seed_row"), F.when(v % 2 == 0, 16).otherwise(32).alias("size"), (v % 17).cast("int").alias("r_op"), F.abs(F.col("embedding")[0]).alias("participation_ratio"), F.col("embedding")[1].alias("kth_cosine"))
    out = artifacts.probe_summary(probe, 0.1)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# composites


@query("m1_atlas", with_windows('SELECT window_id AS row_id, window_id, CAST(recon_loss AS FLOAT) AS recon_loss, big_recording_index, session_index, "offset", dataset, modality, n_channels, count(*) OVER () AS rows FROM windows'))
def m1(spark: SparkSession, d: str) -> DataFrame:
    out = artifacts.atlas(windows(spark, d))
    return out.where(F.col("projection_x").isNotNull()).join(F.broadcast(out.agg(F.count(F.lit(1)).alias("rows")))).drop("projection_x", "projection_y")


@query("m2_display_subset", with_windows("SELECT window_id FROM windows WHERE recon_loss > 100 UNION SELECT window_id FROM (SELECT window_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM windows) WHERE place % 13 = 0"))
def m2(spark: SparkSession, d: str) -> DataFrame:
    return views.stride_sample(windows(spark, d), F.col("recon_loss") > 100, "vec_id", 13).select("window_id")


@query("m3_display_vectors", with_windows("SELECT window_id, array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS vector FROM windows WHERE recon_loss > 100"))
def m3(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    return artifacts.display_vectors(w, w.where("recon_loss > 100").select("window_id")).select("window_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("vector"))


@query("m4_finalised_set", with_windows("SELECT window_id AS row_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS group_id, CAST(n AS INTEGER) AS group_size FROM (SELECT window_id, min(window_id) OVER (PARTITION BY dataset) AS f, count(*) OVER (PARTITION BY dataset) AS n FROM windows)"))
def m4(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select(F.col("window_id").alias("row_id"), "dataset")
    return artifacts.finalise(cluster.number_groups(w, ["dataset"]).drop("dataset"), w.select("row_id"), 1, 10**9).select("row_id", "group_id", "group_size")


@query("m6_clustered_import", with_windows("SELECT window_id AS row_id FROM windows WHERE recon_loss > 50 AND recon_loss < 200"))
def m6(spark: SparkSession, d: str) -> DataFrame:
    a = windows(spark, d).select(F.col("window_id").alias("row_id"), "recon_loss")
    return artifacts.import_clustered(a.where("recon_loss > 50").select("row_id"), a.select("row_id"), a.where("recon_loss < 200").select("row_id"))


@query("m7_index_metrics")
def m7(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    return artifacts.index_metrics(w, rankings(spark, d).withColumnRenamed("row_id", "window_id"), ["direction", "eta", "kernel", "w"], w.where(sampling.hash_sample(F.col("window_id"))))


_SHARED = "list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u"


@query("a22_published_unions", with_windows(f"""WITH {rankings_sql()}, m AS (SELECT direction, w, n.*, {_SHARED} FROM members JOIN windows n ON window_id = row_id), s AS (SELECT window_id, {_SHARED} FROM windows WHERE {SAMPLE.format('window_id')}),
 cos AS (SELECT a.direction, a.w, avg(list_inner_product(a.u, b.u)) AS c FROM m a JOIN m b ON a.direction = b.direction AND a.w = b.w AND a.window_id <> b.window_id GROUP BY 1, 2),
 best AS (SELECT direction, w, s.window_id, max(list_inner_product(m.u, s.u)) AS c FROM m, s GROUP BY 1, 2, 3),
 cov AS (SELECT direction, w, {', '.join(f"round(avg(CASE WHEN c >= {t} THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_{int(100 * t):03d}" for t in artifacts.TAUS)} FROM best GROUP BY 1, 2),
 size AS (SELECT big_recording_index, count(*) AS n FROM windows GROUP BY 1), large AS (SELECT big_recording_index FROM size WHERE n >= (SELECT quantile_cont(n, 0.9) FROM size)),
 plain AS (SELECT direction, w, count(*) AS k, round(avg(CASE WHEN big_recording_index IN (SELECT big_recording_index FROM large) THEN 1.0::DOUBLE ELSE 0 END), 6) AS top_decile_group_share, round(avg(recon_loss), 6) AS recon_loss_mean, {', '.join(f"round(quantile_cont(recon_loss, {q / 100}), 6) AS recon_loss_q{q}" for q in artifacts.PERCENTS)}, count(DISTINCT big_recording_index) AS recordings_represented FROM m GROUP BY 1, 2),
 t AS (SELECT direction, w, dataset, round(count(*) / sum(count(*)) OVER (PARTITION BY direction, w), 4) AS share, row_number() OVER (PARTITION BY direction, w ORDER BY count(*) DESC, dataset) AS p FROM m GROUP BY 1, 2, 3),
 top AS (SELECT direction, w, chr(123) || string_agg('"' || dataset || '":' || share, ',' ORDER BY p) || chr(125) AS top5_datasets FROM t WHERE p <= 5 GROUP BY 1, 2),
 pub AS (SELECT direction, w, window_id FROM m WHERE recon_loss > 40 OR vec_id % 3 = 0 UNION SELECT direction, w, window_id FROM windows, (SELECT DISTINCT direction, w FROM m) WHERE vec_id % 11 = 0),
 j AS (SELECT coalesce(m.direction, pub.direction) AS direction, coalesce(m.w, pub.w) AS w, round(count(*) FILTER (m.window_id IS NOT NULL AND pub.window_id IS NOT NULL)::DOUBLE / count(*), 6) AS jaccard_vs_published FROM m FULL JOIN pub ON m.direction = pub.direction AND m.w = pub.w AND m.window_id = pub.window_id GROUP BY 1, 2)
 SELECT plain.*, round(c, 6) AS mean_pairwise_cosine_union, cov.* EXCLUDE (direction, w), top5_datasets, jaccard_vs_published FROM plain JOIN cos USING (direction, w) JOIN cov USING (direction, w) JOIN top USING (direction, w) JOIN j USING (direction, w)"""))
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of unions beside published ones: all but the Vendi scores."""
    w, keys = windows(spark, d), ["direction", "eta", "kernel", "w"]
    members = rankings(spark, d).withColumnRenamed("row_id", "window_id").join(w.select("window_id", "vec_id"), "window_id")
    every = F.array(*[F.struct(F.lit(x).alias("direction"), F.lit(0.1).alias("eta"), F.lit("ranking").alias("kernel"), F.lit(e).alias("w")) for x in ("top", "bottom") for e in ETAS])
    more = w.where("vec_id % 11 = 0").select("window_id", F.explode(every).alias("x")).select("window_id", "x.*")
    published = members.where("recon_loss > 40 OR vec_id % 3 = 0").select(*keys, "window_id").unionByName(more).distinct()
    out = artifacts.index_metrics(w, members.select(*keys, "window_id"), keys, w.where(sampling.hash_sample(F.col("window_id"))), published).drop("eta", "kernel", "vendi_union", "vendi_union_normalized")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c != "w" else F.col(c) for c, t in out.dtypes])


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = rankings(spark, d).withColumn("run_id", F.concat_ws(":", "direction", "w", "big_recording_index"))
    runs = m.select("run_id", F.lit("dpp").alias("method"), "direction", F.col("eta").alias("selection_eta"), F.col("kernel").alias("kernel_method"), F.col("w").alias("w_interaction")).distinct()
    return m.select("run_id", "row_id"), runs


ATLAS = "atlas AS (SELECT window_id AS row_id, dataset, modality, n_channels, big_recording_index, recon_loss FROM windows), clustered AS (SELECT row_id FROM atlas WHERE recon_loss > 150)"
LABEL = "dataset || ' · ' || modality || ' · ' || n_channels::VARCHAR || ' ch · rec ' || big_recording_index::VARCHAR"


def _atlas(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select(F.col("window_id").alias("row_id"), "dataset", "modality", "n_channels", "big_recording_index", "recon_loss")


@query("m8_published_view", with_windows(f"WITH {mask_cte()}, {ATLAS}, req AS (SELECT row_id FROM members UNION SELECT row_id FROM clustered), pts AS (SELECT * FROM atlas WHERE row_id IN (SELECT row_id FROM req) UNION ALL SELECT * FROM atlas WHERE {SAMPLE.format('row_id')} AND row_id NOT IN (SELECT row_id FROM req)) SELECT p.row_id, {LABEL} AS point_label, coalesce(array_to_string(t, ','), '') AS top, p.row_id IN (SELECT row_id FROM clustered) AS clustered_selected FROM pts p LEFT JOIN (SELECT row_id, list_sort(list(DISTINCT w)) AS t FROM members WHERE direction = 'top' GROUP BY 1) m ON m.row_id = p.row_id"))
def m8(spark: SparkSession, d: str) -> DataFrame:
    a = _atlas(spark, d)
    members, runs = _runs(spark, d)
    out = views.published_view(a, members, runs, a.where("recon_loss > 150").select("row_id"), [("top", 0.1, "ranking"), ("bottom", 0.1, "ranking")])
    return out.select("row_id", "point_label", F.array_join(F.col(MASKS[0]).cast("array<string>"), ",").alias("top"), "clustered_selected")


@query("m9_set_view", with_windows(f"WITH {mask_cte()}, {ATLAS}, o AS (SELECT a.*, a.big_recording_index AS group_id, coalesce({MASKS[0]}, 0) AS m1, coalesce({MASKS[1]}, 0) AS m2, a.recon_loss > 150 AS c FROM atlas a LEFT JOIN masks USING (row_id)) SELECT row_id, {LABEL} || ' · group ' || group_id::VARCHAR AS point_label, m1 AS {MASKS[0]}, c AS clustered_selected FROM o WHERE (m1 | m2) <> 0 OR c OR ({SAMPLE.format('row_id')})"))
def m9(spark: SparkSession, d: str) -> DataFrame:
    a = _atlas(spark, d)
    rows = a.select("row_id", F.col("big_recording_index").alias("group_id"))
    masked = overlay.overlay(rows, overlay.masks(rankings(spark, d), GRID, ["top", "bottom"], [0.1]))
    return views.set_view(a, masked, MASKS, a.where("recon_loss > 150").select("row_id")).select("row_id", "point_label", MASKS[0], "clustered_selected")


@query("m9_synthetic_runs", with_windows(f"WITH {rankings_sql()}, p AS (SELECT dir AS direction, e::DOUBLE AS selection_eta, w::DOUBLE AS w_interaction, 'per_group' AS scope FROM (SELECT unnest(['top', 'bottom']) AS dir), (SELECT unnest([0.01, 0.1]) AS e), (SELECT unnest([0.05, 0.1, 0.2]) AS w)) SELECT p.*, CASE WHEN selection_eta = 0.1 THEN (SELECT count(*) FROM members m WHERE m.direction = p.direction AND m.w = p.w_interaction) ELSE 0 END AS memberships FROM p"))
def m9b(spark: SparkSession, d: str) -> DataFrame:
    """The runs that a grid implies, with the memberships that the table has of each."""
    runs = views.synthetic_runs(spark, "set", ["top", "bottom"], [0.01, 0.1], {"ranking": list(ETAS)}).select("direction", "selection_eta", "w_interaction", "scope")
    of = rankings(spark, d).groupBy("direction", F.col("eta").alias("selection_eta"), F.col("w").alias("w_interaction")).agg(F.count(F.lit(1)).alias("memberships"))
    return runs.join(of, ["direction", "selection_eta", "w_interaction"], "left").fillna(0, ["memberships"])


@query("m10_demo_view", with_windows(f"WITH {ATLAS} SELECT row_id, {LABEL} AS point_label FROM atlas WHERE {SAMPLE.format('row_id')}"))
def m10(spark: SparkSession, d: str) -> DataFrame:
    return views.demo_view(_atlas(spark, d)).select("row_id", "point_label")


# explorer


@query("q1_cross_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND l_discount < 0.05 GROUP BY 1")
def q1(spark: SparkSession, d: str) -> DataFrame:
    f = explore.CrossFilter(load(spark, d, "lineitem")).set("quantity", F.col("l_quantity") > 20).set("discount", F.col("l_discount") < 0.05).set("flag", F.col("l_returnflag") == "R").set("none", None)
    return f.rows(but="flag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("q1_cube", "WITH b AS (SELECT CASE WHEN l_quantity BETWEEN 0 AND 50 THEN CAST(least(floor(l_quantity / 5), 9) AS INTEGER) END AS quantity, CAST(round(l_discount * 100) AS INTEGER) AS discount, l_returnflag AS flag FROM lineitem) SELECT 'quantity' AS chart, CAST(quantity AS VARCHAR) AS bin, count(*) AS count FROM b WHERE discount >= 3 AND flag IN ('A', 'R') GROUP BY quantity UNION ALL SELECT 'discount', CAST(discount AS VARCHAR), count(*) FROM b WHERE quantity BETWEEN 2 AND 6 AND flag IN ('A', 'R') GROUP BY discount UNION ALL SELECT 'flag', flag, count(*) FROM b WHERE quantity BETWEEN 2 AND 6 AND discount >= 3 GROUP BY flag")
def q1c(spark: SparkSession, d: str) -> DataFrame:
    """Three charts under each other's brushes, from counts that one pass over the table made."""
    bins = {"quantity": explore.bin_of("l_quantity", 0, 50, 10), "discount": F.round(F.col("l_discount") * 100).cast("int"), "flag": F.col("l_returnflag")}
    cube = explore.Cube(load(spark, d, "lineitem"), bins, shared_path(spark, "cube")).brush("quantity", 2, 6).brush("discount", 3).brush("flag", values=["A", "R"])
    return reduce(DataFrame.unionAll, [cube.chart(n).select(F.lit(n).alias("chart"), F.col("bin").cast("string").alias("bin"), "count") for n in bins])


@query("q2_histogram", "SELECT CAST(least(floor((l_extendedprice - 1000) / ((100000.0::DOUBLE - 1000) / 24)), 23) AS INTEGER) AS bin, count(*) AS count FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 100000 GROUP BY 1")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return explore.histogram(load(spark, d, "lineitem"), "l_extendedprice", 1000.0, 100000.0, 24)


@query("q2_top_categories", "SELECT CASE WHEN p <= 10 THEN c ELSE '(other)' END AS category, CAST(sum(n) AS BIGINT) AS count FROM (SELECT p_brand AS c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS p FROM part GROUP BY 1) GROUP BY 1")
def q2b(spark: SparkSession, d: str) -> DataFrame:
    return explore.top_categories(load(spark, d, "part"), "p_brand")


@query("q3_label_discovery", f"SELECT 'tags' AS label, max(n) > 1 AS multi FROM (SELECT len(string_split(regexp_replace(trim({TAGS}), '\\s*,\\s*', ', ', 'g'), ', ')) AS n FROM part)")
def q3(spark: SparkSession, d: str) -> DataFrame:
    lookup = load(spark, d, "part").select(F.col("p_partkey").alias("dataset"), F.expr(TAGS).alias("tags"), F.col("p_size").alias("n_channels"))
    found = explore.label_columns(lookup, windows(spark, d))
    return spark.createDataFrame([(c, explore.is_multi_tag(lookup, c)) for c in found], "label string, multi boolean")


@query("q4_operating_curve", with_windows(f"WITH {', '.join(ranked_sql('top', e, f'r{i}') for i, e in enumerate(ETAS))}, m AS ({' UNION ALL '.join(f'SELECT {e}::DOUBLE AS w, big_recording_index AS g, avg(recon_loss) AS l FROM r{i} GROUP BY 2' for i, e in enumerate(ETAS))}), s AS (SELECT w, avg(l) AS mean, list_sort(list(l)) AS v, count(*) AS n FROM m GROUP BY w) SELECT w AS w_interaction, round(mean, 6) AS mean, round(v[1 + CAST(floor(0.25::DOUBLE * (n - 1)) AS BIGINT)], 6) AS low, round(v[1 + CAST(floor(0.75::DOUBLE * (n - 1)) AS BIGINT)], 6) AS high FROM s"))
def q4(spark: SparkSession, d: str) -> DataFrame:
    from vectide.operators.metrics import curve_summary

    runs = rankings(spark, d, ("top",)).groupBy("direction", "eta", "kernel", "w", "big_recording_index").agg(F.avg("recon_loss").alias("loss"), F.count(F.lit(1)).alias("actual_size"))
    named = runs.select(F.lit("dpp").alias("method"), "direction", F.col("eta").alias("selection_eta"), F.col("kernel").alias("kernel_method"), F.col("w").alias("w_interaction"), "loss", "actual_size")
    points = explore.curve(curve_summary(named, ["method", "direction", "selection_eta", "kernel_method", "w_interaction"], ["loss"]), "dpp", "top", 0.1, "ranking", "loss")
    return points.select("w_interaction", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("q5_weight_list", "SELECT DISTINCT w FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(w)")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return rankings(spark, d).where("direction = 'top'").select("w").distinct().orderBy("w")

