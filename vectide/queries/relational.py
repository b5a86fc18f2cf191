"""Queries of sources, projections, joins, aggregates, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.functions import sampling, text
from vectide.operators import validate
from vectide.operators.order import numbered
from vectide.queries.registry import both, load, query, shared_path, windows, with_windows
from vectide.schema import SELECTIONS, conform
from vectide.sources import publish, readers, sinks

# sources


@query("s1_parquet_scan", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL")
def s1(spark: SparkSession, d: str) -> DataFrame:
    t = readers.read_table(spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_linestatus", "l_quantity"])
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("s2_projected_source", with_windows('SELECT window_id, big_recording_index, session_index, "offset", recon_loss FROM windows'))
def s2(spark: SparkSession, d: str) -> DataFrame:
    w = readers.select_columns(windows(spark, d), ["window_id", "big_recording_index", "session_index", "offset", "recon_loss", "embedding"])
    return validate.require_source(w, 64).drop("embedding")


META_SQL = "SELECT n_nationkey AS big_recording_index, n_name AS dataset, r_name AS modality, CAST(200 + 200 * (n_nationkey % 2) AS DOUBLE) AS sampling_rate, CAST(19 + n_nationkey AS BIGINT) AS n_channels FROM nation JOIN region ON n_regionkey = r_regionkey"


def metadata(spark: SparkSession, d: str) -> DataFrame:
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("big_recording_index"), F.col("n_name").alias("dataset"), F.col("r_name").alias("modality"), (200 + 200 * (F.col("n_nationkey") % 2)).cast("double").alias("sampling_rate"), (19 + F.col("n_nationkey")).cast("long").alias("n_channels"))


@query("s3_metadata", META_SQL)
def s3(spark: SparkSession, d: str) -> DataFrame:
    return readers.require_metadata(metadata(spark, d))


both("s4_pruned_read", "SELECT l_shipdate IS NOT NULL AS shipped, round(avg(l_discount), 6) AS discount FROM «lineitem» GROUP BY 1", "lineitem")


@query("s5_bounded_batches", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def s5(spark: SparkSession, d: str) -> DataFrame:
    from vectide.streaming.batches import running_totals

    return running_totals(spark, f"{d}/events.parquet", "event_type", "value", shared_path(spark, "batches"))


@query("s6_shard_routing", with_windows("SELECT big_recording_index, count(*) AS n, round(sum(recon_loss), 6) AS loss FROM windows WHERE big_recording_index IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1"))
def s6(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.write_table(windows(spark, d).select("big_recording_index", "window_id", "recon_loss"), shared_path(spark, "shards"), ["big_recording_index"])
    keys = load(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("int").alias("big_recording_index"))
    return readers.read_shards(spark, path, "big_recording_index", keys).groupBy(F.col("big_recording_index").cast("long").alias("big_recording_index")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("recon_loss"), 6).alias("loss"))


both("s7_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1", "events", "SELECT from_json(props, 'k bigint').k AS k, count(*) AS n FROM {events} GROUP BY 1")


@query("s9_manifest", with_windows("SELECT count(*) AS total, 0::BIGINT AS empty, 0::BIGINT AS spaced, 0::BIGINT AS unsorted FROM windows"))
def s9(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, windows(spark, d).select("window_id", F.col("window_id").alias("value")))


DIRTY = "CASE WHEN vec_id % 50 = 7 THEN '' WHEN vec_id % 50 = 9 THEN window_id || ' ' WHEN vec_id % 50 = 11 THEN 'a' || window_id ELSE window_id END"


@query("s9_dirty_manifest", with_windows(f"WITH l AS (SELECT window_id, {DIRTY} AS v FROM windows), n AS (SELECT v, lag(v) OVER (ORDER BY window_id) AS before FROM l) SELECT count(*) AS total, count(*) FILTER (v = '') AS empty, count(*) FILTER (contains(v, ' ')) AS spaced, count(*) FILTER (v <= before) AS unsorted FROM n"))
def s9d(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are empty, hold white space, or are out of order."""
    return _manifest(spark, windows(spark, d).select("window_id", F.expr(DIRTY).alias("value")))


def _manifest(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Problems of a written manifest of ``value`` in the order of window_id."""
    path = shared_path(spark, "manifest")
    lines.orderBy("window_id").select("value").write.text(path)
    # order of lines is that of files and of places in them
    written_ = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("at"))
    return readers.manifest_problems(written_, "value", "at")


@query("s12_describe", "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, column_name FROM (DESCRIBE lineitem)")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return readers.describe(load(spark, d, "lineitem")).select("ordinal", "column_name")


both("s13_row_count", "SELECT count(*) AS n FROM «orders»", "orders")


@query("s14_synthetic", "SELECT i AS row_id, concat_ws('_-_', CAST(i // 120 AS VARCHAR), CAST((i // 40) % 3 AS VARCHAR), CAST((i % 40) * 2000 AS VARCHAR)) AS window_id, i // 120 AS big_recording_index, (i // 40) % 3 AS session_index, (i % 40) * 2000 AS \"offset\", 'dataset_' || substr('abcde', CAST((i // 120) % 5 AS INTEGER) + 1, 1) AS dataset FROM range((SELECT count(*) FROM orders)) t(i)")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """As many windows as there are orders."""
    return readers.synthetic_windows(spark, load(spark, d, "orders").count()).select("row_id", "window_id", "big_recording_index", "session_index", "offset", "dataset")


# projections and predicates

both("p1_public_columns", 'SELECT window_id AS row_id, window_id, CAST(recon_loss AS FLOAT) AS recon_loss, big_recording_index, session_index, "offset", dataset, modality, n_channels FROM windows', "windows",
     "SELECT window_id AS row_id, window_id, CAST(recon_loss AS FLOAT) AS recon_loss, big_recording_index, session_index, offset, dataset, modality, n_channels FROM {windows}")


@query("p2_conform", with_windows("SELECT CAST(NULL AS VARCHAR) AS run_id, window_id AS row_id, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS DOUBLE) AS marginal_logdet_gain, CAST(NULL AS DOUBLE) AS utility, CAST(recon_loss AS FLOAT) AS recon_loss FROM windows"))
def p2(spark: SparkSession, d: str) -> DataFrame:
    return conform(windows(spark, d).withColumnRenamed("window_id", "row_id"), SELECTIONS)


@query("p3_point_label", with_windows("SELECT window_id, dataset || ' · ' || modality || ' · ' || n_channels::VARCHAR || ' ch · rec ' || big_recording_index::VARCHAR AS point_label, dataset || ' · ' || modality || ' · ' || n_channels::VARCHAR || ' ch · rec ' || big_recording_index::VARCHAR || ' · group ' || session_index::VARCHAR AS group_label FROM windows"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("dataset", "modality", "n_channels", "big_recording_index")]
    return windows(spark, d).select("window_id", text.point_label(*c).alias("point_label"), text.point_label(*c, F.col("session_index")).alias("group_label"))


@query("p4_channel_bucket", with_windows("SELECT CASE WHEN n_channels IN (19, 21, 22, 125, 128, 129) THEN n_channels::VARCHAR || ' ch' WHEN n_channels <= 64 THEN 'Others LO (≤ 64 ch)' ELSE 'Others HI (> 64 ch)' END AS channel_group, count(*) AS n FROM windows GROUP BY 1"))
def p4(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).groupBy(text.channel_bucket(F.col("n_channels")).alias("channel_group")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_predicate_set", with_windows("SELECT name, n AS count FROM (SELECT count(*) FILTER (n_channels = 19) AS \"19 ch\", count(*) FILTER (n_channels = 21) AS \"21 ch\", count(*) FILTER (n_channels = 22) AS \"22 ch\", count(*) FILTER (n_channels <= 64 AND n_channels NOT IN (19, 21, 22)) AS \"Others LO (≤ 64 ch)\", count(*) FILTER (n_channels = 125) AS \"125 ch\", count(*) FILTER (n_channels = 128) AS \"128 ch\", count(*) FILTER (n_channels = 129) AS \"129 ch\", count(*) FILTER (n_channels > 64 AND n_channels NOT IN (125, 128, 129)) AS \"Others HI (> 64 ch)\" FROM windows) UNPIVOT (n FOR name IN (COLUMNS(*)))"))
def p5(spark: SparkSession, d: str) -> DataFrame:
    from vectide.operators.explore import predicate_counts

    return predicate_counts(windows(spark, d), text.channel_predicates(F.col("n_channels")))


@query("p6_modality", with_windows("SELECT window_id, modality FROM windows WHERE modality = 'AFRICA' OR modality = 'ASIA'"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).where((F.col("modality") == "AFRICA") | (F.col("modality") == "ASIA")).select("window_id", "modality")


@query("p7_exclude", "SELECT * EXCLUDE (c_name) FROM customer")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").drop("c_name")


both("p8_replace_column", "SELECT c_custkey, round(c_acctbal * 2, 6) AS c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM «customer»", "customer")
both("p9_mask_filter", "SELECT o_orderkey, o_totalprice FROM «orders» WHERE o_orderstatus = 'F' AND o_totalprice > 1000", "orders")


@query("p10_list_membership", with_windows("SELECT window_id FROM windows WHERE list_contains([big_recording_index, n_channels], 22)"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).where(F.array_contains(F.array("big_recording_index", "n_channels"), F.lit(22).cast("long"))).select("window_id")


TAGS = "replace(p_name, ' ', ' ,  ')"


@query("p11_tag_membership", f"WITH t AS (SELECT p_partkey, regexp_replace(trim({TAGS}), '\\s*,\\s*', ', ', 'g') AS tags FROM part), f AS (SELECT min(tag) AS tag FROM (SELECT unnest(string_split(tags, ', ')) AS tag FROM t)) SELECT p_partkey, tags FROM t WHERE list_contains(string_split(tags, ', '), (SELECT tag FROM f))")
def p11(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "part").select("p_partkey", text.canonical_tags(F.expr(TAGS)).alias("tags"))
    first = t.select(F.explode(F.split("tags", text.TAG_SEPARATOR)).alias("tag")).agg(F.min("tag")).first()[0]
    return t.where(text.has_tag(F.col("tags"), first))


both("p12_bit_test", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE ((l_suppkey >> 3) & 1) = 1", "lineitem", "SELECT l_orderkey, l_linenumber, l_suppkey FROM {lineitem} WHERE (shiftright(l_suppkey, 3) & 1) = 1")


@query("p13_any_mask", "SELECT l_orderkey, l_partkey FROM lineitem WHERE ((l_partkey % 4) | (l_suppkey % 4)) <> 0")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where(sampling.any_mask([F.col("l_partkey") % 4, F.col("l_suppkey") % 4])).select("l_orderkey", "l_partkey")


@query("p14_group_filter", with_windows("SELECT window_id FROM windows WHERE big_recording_index = greatest(0, least((SELECT max(big_recording_index) FROM windows), 99))"))
def p14(spark: SparkSession, d: str) -> DataFrame:
    from vectide.plans.views import clamp_group

    w = windows(spark, d)
    groups = w.agg(F.max("big_recording_index") + 1).first()[0]
    return w.where(F.col("big_recording_index") == clamp_group(99, groups)).select("window_id")


SAMPLE = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 100 < 8"


@query("p15_hash_sample", f"SELECT o_orderkey FROM orders WHERE {SAMPLE.format('CAST(o_orderkey AS VARCHAR)')}")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where(sampling.hash_sample(F.col("o_orderkey"))).select("o_orderkey")


@query("p16_stride_sample", with_windows("SELECT window_id, true AS required FROM windows WHERE recon_loss > 100 UNION ALL SELECT window_id, false FROM (SELECT window_id, recon_loss, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM windows) WHERE place % 13 = 0 AND NOT recon_loss > 100"))
def p16(spark: SparkSession, d: str) -> DataFrame:
    from vectide.plans.views import stride_sample

    return stride_sample(windows(spark, d), F.col("recon_loss") > 100, "vec_id", 13).select("window_id", "required")


@query("p17_parse_ids", with_windows("SELECT window_id, CAST(regexp_extract(window_id, '^(-?\\d+)_-_(-?\\d+)_-_(-?\\d+)$', 1) AS BIGINT) AS recording, CAST(regexp_extract(window_id, '^(-?\\d+)_-_(-?\\d+)_-_(-?\\d+)$', 2) AS BIGINT) AS session, CAST(regexp_extract(window_id, '^(-?\\d+)_-_(-?\\d+)_-_(-?\\d+)$', 3) AS BIGINT) AS \"offset\" FROM windows"))
def p17(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("window_id", text.parse_window_id(F.col("window_id")).alias("p")).select("window_id", "p.recording", "p.session", "p.offset")


both("p19_null_test", "SELECT c_custkey, (o_custkey IS NOT NULL) AS has_order FROM «customer» LEFT JOIN (SELECT DISTINCT o_custkey FROM «orders») o ON c_custkey = o_custkey", "customer orders")


@query("p20_mask_name", "SELECT DISTINCT 'dpp_top_eta_' || lpad(CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR), 3, '0') || '_' || CASE WHEN l_returnflag = 'A' THEN 'additive' ELSE 'multiplicative' END AS name FROM lineitem")
def p20(spark: SparkSession, d: str) -> DataFrame:
    kernel = F.when(F.col("l_returnflag") == "A", "additive").otherwise("multiplicative")
    return load(spark, d, "lineitem").select(text.mask_column("top", F.col("l_discount"), kernel).alias("name")).distinct()


# joins


@query("j1_strict_metadata_join", with_windows(f"m AS (SELECT * FROM ({META_SQL})) SELECT window_id, m.sampling_rate, m.n_channels AS channels FROM windows JOIN m USING (big_recording_index)".replace("m AS (", "WITH m AS (", 1)))
def j1(spark: SparkSession, d: str) -> DataFrame:
    m = metadata(spark, d).select(F.col("big_recording_index").cast("long").alias("big_recording_index"), "sampling_rate", F.col("n_channels").alias("channels"))
    return validate.require_joined(windows(spark, d).select("window_id", "big_recording_index"), m, "big_recording_index").select("window_id", "sampling_rate", "channels")


both("j2_left_lookup", "SELECT n_name, s_suppkey FROM «nation» LEFT JOIN (SELECT * FROM «supplier» WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey", "nation supplier")
both("j3_inner_with_union", "SELECT c.c_custkey, c.c_name FROM «customer» c INNER JOIN (SELECT o_custkey AS c_custkey FROM «orders» WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM «orders» WHERE o_totalprice > 400000) m ON c.c_custkey = m.c_custkey", "customer orders")
both("j4_members_runs", "SELECT l_orderkey, l_linenumber, o_orderdate FROM «lineitem» INNER JOIN «orders» ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'", "lineitem orders")
both("j5_left_joins_coalesce", "SELECT c_custkey, coalesce(n, 0) AS orders, (k IS NOT NULL) AS supplied FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN (SELECT s_suppkey AS k FROM supplier) ON k = c_custkey", "customer orders supplier",
     "SELECT c_custkey, coalesce(n, 0) AS orders, (k IS NOT NULL) AS supplied FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN (SELECT s_suppkey AS k FROM {supplier}) ON k = c_custkey")
both("j6_overlay_join", "SELECT p_partkey, p_brand, count(*) AS n FROM «part» INNER JOIN «lineitem» ON p_partkey = l_partkey GROUP BY p_partkey, p_brand", "part lineitem")
both("j7_anti", "SELECT count(*) AS n FROM «customer» WHERE NOT EXISTS (SELECT 1 FROM «orders» WHERE o_custkey = c_custkey)", "customer orders")
both("j8_semi_in_or", "SELECT count(*) AS n FROM «lineitem» WHERE l_quantity > 45 OR l_orderkey IN (SELECT o_orderkey FROM «orders» WHERE o_orderstatus = 'P')", "lineitem orders")


@query("j9_semi_residual", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j9(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("j10_aligned_join", with_windows("SELECT window_id, dataset, recon_loss FROM windows"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    return validate.require_aligned(w.select("window_id", "dataset"), w.select("window_id", "recon_loss"), "window_id")


@query("j11_row_to_group", with_windows("SELECT window_id AS row_id, session_index AS group_id, count(*) OVER (PARTITION BY session_index) AS group_size FROM windows"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    rows = windows(spark, d).select(F.col("window_id").alias("row_id"), F.col("session_index").alias("group_id"))
    return validate.require_aligned(rows.select("row_id"), rows, "row_id").join(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "group_id")


@query("j12_null_safe_match", "WITH a AS (SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS k, p_brand AS b, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber END AS k, count(*) AS m FROM lineitem GROUP BY ALL) SELECT a.k, b, n, m FROM a JOIN t ON a.k IS NOT DISTINCT FROM t.k")
def j12(spark: SparkSession, d: str) -> DataFrame:
    from vectide.operators.metrics import null_safe_join

    a = load(spark, d, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("k"), F.col("p_brand").alias("b")).groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    t = load(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linenumber")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    return null_safe_join(a, t, ["k"])


@query("j13_hit_counts", "WITH ids AS (SELECT o_custkey AS row_id, count(*) AS times FROM orders GROUP BY 1), h AS (SELECT c_custkey AS row_id, count(*) AS hits FROM customer GROUP BY 1) SELECT CAST(sum(times) AS BIGINT) AS ids, count(*) FILTER (hits IS NULL) AS missing, count(*) FILTER (hits > 1) AS several, count(*) FILTER (times > 1) AS repeated FROM ids LEFT JOIN h USING (row_id)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return validate.hit_counts(load(spark, d, "orders").select(F.col("o_custkey").alias("row_id")), load(spark, d, "customer").select(F.col("c_custkey").alias("row_id")))


both("j20_scalar_subquery", "SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM «customer») AS customers FROM «orders» GROUP BY o_orderpriority", "orders customer")

# aggregates

both("a1_group_sizes", "SELECT o_custkey, count(*) AS n FROM «orders» GROUP BY o_custkey", "orders")


@query("a2_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


both("a3_filtered_counts", "SELECT l_shipdate IS NULL AS unshipped, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) AS parts FROM «lineitem» GROUP BY 1", "lineitem")
both("a4_pivot_lists", "SELECT l_linenumber, list_sort(list(DISTINCT l_tax) FILTER (WHERE l_returnflag = 'A')) AS a, list_sort(list(DISTINCT l_tax) FILTER (WHERE l_returnflag = 'R')) AS r FROM lineitem GROUP BY l_linenumber", "lineitem",
     "SELECT l_linenumber, sort_array(collect_set(l_tax) FILTER (WHERE l_returnflag = 'A')) AS a, sort_array(collect_set(l_tax) FILTER (WHERE l_returnflag = 'R')) AS r FROM {lineitem} GROUP BY l_linenumber")


@query("a5_tags", f"WITH t AS (SELECT string_split(regexp_replace(trim({TAGS}), '\\s*,\\s*', ', ', 'g'), ', ') AS l FROM part WHERE p_name IS NOT NULL AND p_name <> '') SELECT tag, max(n) AS tag_count FROM (SELECT unnest(l) AS tag, CAST(len(l) AS INTEGER) AS n FROM t) GROUP BY tag")
def a5(spark: SparkSession, d: str) -> DataFrame:
    from vectide.operators.explore import tag_counts

    return tag_counts(load(spark, d, "part").select(F.expr(TAGS).alias("tags")), "tags")


both("a6_group_count", "SELECT CAST(max(big_recording_index) + 1 AS BIGINT) AS groups FROM «windows»")
both("a15_top_decile", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT quantile_cont(n, 0.9) AS cut FROM s) SELECT round(avg(CASE WHEN n >= cut THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM orders JOIN s USING (o_custkey), c", "orders",
     "WITH s AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1), c AS (SELECT percentile(n, 0.9D) AS cut FROM s) SELECT round(avg(CASE WHEN n >= (SELECT cut FROM c) THEN 1.0D ELSE 0.0D END), 6) AS share FROM {orders} o JOIN s ON s.o_custkey = o.o_custkey")
both("a16_top_shares", "SELECT dataset, round(CAST(n AS DOUBLE) / t, 4) AS share, p AS place FROM (SELECT dataset, count(*) AS n, sum(count(*)) OVER () AS t, CAST(row_number() OVER (ORDER BY count(*) DESC, dataset) AS INTEGER) AS p FROM «windows» GROUP BY dataset) x WHERE p <= 5")
both("a17_represented", "SELECT count(DISTINCT big_recording_index) AS recordings, count(DISTINCT session_index) AS groups FROM «windows» WHERE recon_loss > 50")
both("a31_counts_by_method", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM «orders»", "orders")

# windows, sort, sets

@query("w7_global_order", with_windows("SELECT window_id, CAST(row_number() OVER (ORDER BY window_id) AS INTEGER) AS at FROM windows"))
def w7(spark: SparkSession, d: str) -> DataFrame:
    return numbered(windows(spark, d).select("window_id"), "window_id").select("window_id", (F.col("number") + 1).cast("int").alias("at"))


both("w8_neighbours", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM «orders»", "orders")
both("o1_order_nulls_first", "SELECT n_name, s_suppkey FROM «nation» LEFT JOIN (SELECT * FROM «supplier» WHERE s_acctbal > 8000) s ON s_nationkey = n_nationkey ORDER BY s_suppkey NULLS FIRST, n_name", "nation supplier")


@query("o2_limit", f"SELECT o_orderkey FROM orders WHERE {SAMPLE.format('CAST(o_orderkey AS VARCHAR)')} ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100, o_orderkey LIMIT 1760000")
def o2(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey").where(sampling.hash_sample(F.col("o_orderkey")))
    return o.orderBy(sampling.hash_bucket(F.col("o_orderkey")), "o_orderkey").limit(1_760_000)


both("o3_stable_sort", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000), o_orderkey) AS INTEGER) AS at FROM «orders»", "orders")
both("o4_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM «lineitem») x WHERE r <= 3", "lineitem")
both("o5_sorted_stream", "SELECT window_id FROM «windows» ORDER BY window_id")
both("o6_distinct_sorted", "SELECT DISTINCT l_tax FROM «lineitem» ORDER BY l_tax", "lineitem")
both("u1_union", "SELECT o_custkey AS k FROM «orders» UNION SELECT c_custkey FROM «customer»", "orders customer")
both("u2_union_all", "SELECT s_name AS name FROM «supplier» UNION ALL SELECT c_name FROM «customer»", "supplier customer")


@query("u3_union_by_name", "SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u3(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return s.unionByName(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


both("u4_distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM «lineitem»", "lineitem")
both("u5_intersect_except", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM «customer» INTERSECT SELECT o_custkey FROM «orders») a UNION ALL SELECT 'left', count(*) FROM (SELECT c_custkey FROM «customer» EXCEPT SELECT o_custkey FROM «orders») b", "customer orders")

# scalar families

both("f_string", "SELECT c_custkey, trim(c_name) || ':' || CAST(c_nationkey AS VARCHAR) AS a, regexp_replace(c_name, '[0-9]+', '#', 'g') AS b, string_split(c_name, '#')[1] AS c, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS d FROM customer", "customer",
     "SELECT c_custkey, trim(c_name) || ':' || CAST(c_nationkey AS STRING) AS a, regexp_replace(c_name, '[0-9]+', '#') AS b, split(c_name, '#')[0] AS c, lpad(CAST(c_nationkey AS STRING), 4, '0') AS d FROM {customer}")
both("f_math", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(ceil(0.07::DOUBLE * l_quantity) AS BIGINT) AS c, round_even(l_quantity / 2, 0) AS r, round(exp(l_discount) + ln(l_quantity) + sqrt(l_extendedprice), 4) AS m, greatest(least(l_tax, 0.05::DOUBLE), 0.01::DOUBLE) AS k FROM lineitem", "lineitem",
     "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(ceil(0.07D * l_quantity) AS BIGINT) AS c, bround(l_quantity / 2, 0) AS r, round(exp(l_discount) + ln(l_quantity) + sqrt(l_extendedprice), 4) AS m, greatest(least(l_tax, 0.05D), 0.01D) AS k FROM {lineitem}")
both("f_array", "SELECT vec_id, round(list_inner_product(embedding, embedding), 6) AS dot, list_contains(CAST([big_recording_index] AS BIGINT[]), 3) AS three, len(embedding) AS n FROM windows", "windows",
     "SELECT vec_id, round(aggregate(zip_with(embedding, embedding, (x, y) -> x * y), 0.0D, (s, x) -> s + x), 6) AS dot, array_contains(array(big_recording_index), 3L) AS three, CAST(size(embedding) AS BIGINT) AS n FROM {windows}")
both("f_bit", "SELECT l_suppkey & 7 AS a, CAST(bit_or(1::BIGINT << CAST(l_linenumber AS INTEGER)) AS BIGINT) AS m, CAST(bit_count(bit_or(1::BIGINT << CAST(l_linenumber AS INTEGER))) AS INTEGER) AS n FROM lineitem GROUP BY 1", "lineitem",
     "SELECT l_suppkey & 7 AS a, bit_or(shiftleft(1L, CAST(l_linenumber AS INT))) AS m, CAST(bit_count(bit_or(shiftleft(1L, CAST(l_linenumber AS INT)))) AS INT) AS n FROM {lineitem} GROUP BY 1")
both("f_hash", "SELECT c_custkey, sha256(c_name) AS s, md5(c_name) AS m FROM customer", "customer", "SELECT c_custkey, sha2(c_name, 256) AS s, md5(c_name) AS m FROM {customer}")
both("f_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, to_json(struct_pack(user := user_id, kind := event_type)) AS j FROM events", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, to_json(named_struct('user', user_id, 'kind', event_type)) AS j FROM {events}")
both("f_null", "SELECT c_custkey, coalesce(s_name, 'none') AS s, s_name IS NULL AS absent FROM «customer» LEFT JOIN «supplier» ON s_suppkey = c_custkey", "customer supplier")


@query("k2_publication", "SELECT s_suppkey AS k, 'supplier' AS side, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, 'customer', c_acctbal FROM customer WHERE c_nationkey < 12")
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of one version: a publication from another version's tables is refused, and a reader of the version before keeps it."""
    base = shared_path(spark, "published")
    s, c = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")), load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    publish.publish({"supplier": s, "customer": c.where("c_nationkey < 12")}, base)
    found = publish.read(spark, base, "supplier", "customer")
    try:
        publish.publish({"supplier": s.limit(0), "customer": c.limit(0)}, base, expected="another")
    except ContractError:
        pass
    publish.publish({"supplier": s.where("k < 0")}, base, expected=publish.version(spark, base))
    publish.clean(spark, base)
    return found[0].select("k", F.lit("supplier").alias("side"), "balance").unionAll(found[1].select("k", F.lit("customer").alias("side"), "balance"))


@query("p18_names", "SELECT c_custkey AS k, c_mktsegment || '''s `own`' AS v FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 7 AND c_acctbal > 0.1::DOUBLE")
def p18(spark: SparkSession, d: str) -> DataFrame:
    """SQL text from names and values that hold quotes, dots, blanks and backslashes."""
    column, key = "it's `the` segment; --", "key.of customer"
    c = load(spark, d, "customer").select(F.col("c_custkey").alias(key), F.concat("c_mktsegment", F.lit("'s `own`")).alias(column), F.concat(F.lit("a\\b\n'"), F.col("c_nationkey").cast("string")).alias("path"), "c_acctbal")
    view = text.view_name(f"customers of '{shared_path(spark, 'x')}'")
    c.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT {text.quoted(key)} AS k, {text.quoted(column)} AS v FROM {text.quoted(view)} WHERE {text.quoted(column)} <> {text.literal("BUILDING's `own`")} AND path <> {text.literal("a\\b\n'7")} AND c_acctbal > {text.literal(0.1)} AND {text.quoted(key)} > {text.literal(-(2**63))}")
    finally:
        spark.catalog.dropTempView(view)


@query("k10_views", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """CREATE OR REPLACE and DROP of views around a query."""
    load(spark, d, "orders").where("o_orderstatus = 'F'").createOrReplaceTempView("vectide_orders")
    out = spark.table("vectide_orders").agg(F.count(F.lit(1)).alias("n"))
    spark.catalog.dropTempView("vectide_orders")
    return out


@query("k5_export", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """An exported view, read back from each format: all agree."""
    view = load(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_mktsegment")
    base = shared_path(spark, "export")
    back = [spark.read.csv(sinks.export(view, f"{base}/csv", "csv"), header=True, schema="c_custkey long, c_mktsegment string"), spark.read.json(sinks.export(view, f"{base}/jsonl", "jsonl"), schema="c_custkey long, c_mktsegment string"), spark.read.json(sinks.export(view, f"{base}/json", "json"), schema="c_custkey long, c_mktsegment string"), spark.read.parquet(sinks.export(view, f"{base}/parquet", "parquet"))]
    out = back[0]
    for b in back[1:]:
        out = out.intersect(b)
    return out


@query("k1_atomic_write", "SELECT s_suppkey, s_acctbal FROM supplier")
def k1(spark: SparkSession, d: str) -> DataFrame:
    base = shared_path(spark, "tables")
    s = load(spark, d, "supplier")
    sinks.write_tables({f"{base}-a": s.select("s_suppkey"), f"{base}-b": s.select("s_suppkey", "s_acctbal")})
    return spark.read.parquet(f"{base}-a").join(spark.read.parquet(f"{base}-b"), "s_suppkey")
