"""Queries of rankings, baselines, diverse subsets, metrics and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import dot
from vectide.operators import allocate, dpp, metrics, overlay, quantiles, ranking, validate
from vectide.plans import compare, jobs, selections
from vectide.queries.registry import load, query, shared_path, windows, with_windows
from vectide.sources import sinks

R6 = "round({0}, 6) AS {1}"


def ranked_sql(direction: str, eta: float, name: str = "ranked", table: str = "windows") -> str:
    """A CTE of the rows a ranking selects: rank, n."""
    order = "DESC" if direction == "top" else "ASC"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY big_recording_index ORDER BY recon_loss {order}, window_id) - 1 AS rank, count(*) OVER (PARTITION BY big_recording_index) AS n FROM {table})
  WHERE rank < greatest(1, least(n, CAST(ceil({eta}::DOUBLE * n) AS BIGINT))))"""


UTIL = "CASE WHEN max({v}) OVER w = min({v}) OVER w THEN 1.0::DOUBLE ELSE ({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w) END"


@query("w1_ranking_order", with_windows("SELECT window_id, CAST(row_number() OVER (PARTITION BY big_recording_index ORDER BY recon_loss ASC, window_id) - 1 AS INTEGER) AS rank FROM windows"))
def w1(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(windows(spark, d), "big_recording_index", "bottom", eta=1.0).select("window_id", "rank")


@query("w2_topk_ratio_per_group", with_windows(f"WITH {ranked_sql('top', 0.1)} SELECT big_recording_index, window_id, CAST(rank AS INTEGER) AS rank FROM ranked"))
def w2(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.1).select("big_recording_index", "window_id", "rank")


@query("w3_fixed_candidates", with_windows("SELECT big_recording_index, window_id, CAST(r - 1 AS INTEGER) AS rank, round(least(n, 7)::DOUBLE / n, 6) AS eta FROM (SELECT *, row_number() OVER (PARTITION BY big_recording_index ORDER BY recon_loss DESC, window_id) AS r, count(*) OVER (PARTITION BY big_recording_index) AS n FROM windows) WHERE r <= 7"))
def w3(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.rank(windows(spark, d), "big_recording_index", "top", candidate_k=7)
    return out.select("big_recording_index", "window_id", "rank", F.round(F.least(F.col("group_rows"), F.lit(7)).cast("double") / F.col("group_rows"), 6).alias("eta"))


@query("w4_global_ranking", with_windows("SELECT window_id, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY recon_loss, window_id) AS r, count(*) OVER () AS n FROM windows) WHERE r <= CAST(ceil(0.05::DOUBLE * n) AS BIGINT)"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(windows(spark, d), None, "bottom", eta=0.05).select("window_id", "rank")


@query("w5_zero_based_rank", with_windows(f"WITH {ranked_sql('bottom', 0.03)} SELECT big_recording_index, CAST(min(rank) AS INTEGER) AS first, CAST(max(rank) AS INTEGER) AS last FROM ranked GROUP BY 1"))
def w5(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(windows(spark, d), "big_recording_index", "bottom", eta=0.03).groupBy("big_recording_index").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


@query("w6_utility", with_windows(f"WITH {ranked_sql('bottom', 0.1)}, pool AS (SELECT window_id, {UTIL.format(v='(-recon_loss)')} AS p FROM windows WINDOW w AS (PARTITION BY big_recording_index)), s AS (SELECT window_id, {UTIL.format(v='(-recon_loss)')} AS u FROM ranked WINDOW w AS (PARTITION BY big_recording_index)) SELECT s.window_id, round(u, 6) AS utility, round(p, 6) AS pool_utility FROM s JOIN pool USING (window_id)"))
def w6(spark: SparkSession, d: str) -> DataFrame:
    pool = ranking.with_utility(windows(spark, d), ["big_recording_index"], "bottom", name="pool_utility")
    out = ranking.with_utility(ranking.rank(pool, "big_recording_index", "bottom", eta=0.1), ["big_recording_index"], "bottom")
    return out.select("window_id", F.round("utility", 6).alias("utility"), F.round("pool_utility", 6).alias("pool_utility"))


QUANTS = ", ".join(f"round(quantile_cont(recon_loss, {q / 100}), 6) AS recon_loss_q{q}" for q in ranking.PERCENTS)


@query("a7_loss_summary", with_windows(f"WITH {ranked_sql('top', 0.1)}, u AS (SELECT *, {UTIL.format(v='recon_loss')} AS utility FROM ranked WINDOW w AS (PARTITION BY big_recording_index)) SELECT big_recording_index, round(avg(recon_loss), 6) AS mean_recon_loss, round(median(recon_loss), 6) AS median_recon_loss, min(recon_loss) AS min_recon_loss, max(recon_loss) AS max_recon_loss, round(avg(utility), 6) AS mean_utility, {QUANTS} FROM u GROUP BY 1"))
def a7(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the tenth of highest loss of each recording, its utilities and loss summary."""
    top = ranking.with_utility(ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.1), ["big_recording_index"], "top")
    out = ranking.loss_summary(top, ["big_recording_index"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and not c.startswith(("min_", "max_")) else F.col(c) for c, t in out.dtypes])


@query(
    "a7_any_size",
    "WITH l AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, l_linenumber AS line, l_extendedprice AS price, CASE WHEN l_linenumber < 7 THEN l_quantity END AS quantity FROM lineitem), "
    "g AS (SELECT flag, line, count(*) AS n, round(quantile_cont(price, 0.01), 6) AS price_q1, round(median(price), 6) AS price_q50, round(quantile_cont(price, 0.99), 6) AS price_q99, list_sort(list(price)) AS p, list_sort(list(quantity) FILTER (WHERE quantity IS NOT NULL)) AS q FROM l GROUP BY 1, 2) "
    "SELECT flag, line, n, price_q1, price_q50, price_q99, p[1 + CAST(floor(0.25::DOUBLE * (len(p) - 1)) AS BIGINT)] AS price_low25, CASE WHEN len(q) > 0 THEN q[1 + CAST(floor(0.75::DOUBLE * (len(q) - 1)) AS BIGINT)] END AS quantity_low75 FROM g",
)
def a7_any_size(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics by digits: no task may sort more than 500 rows of a group. Null keys are keys, a group without values has null."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rows = load(spark, d, "lineitem").select(flag.alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("quantity"))
    at = {"price_q1": 0.01, "price_q50": 0.5, "price_q99": 0.99}
    wanted = {name: ("price", q, "linear") for name, q in at.items()} | {"price_low25": ("price", 0.25, "lower"), "quantity_low75": ("quantity", 0.75, "lower")}
    out = quantiles.summarise(rows, ["flag", "line"], [F.count(F.lit(1)).alias("n")], wanted, held=500)
    return out.select("flag", "line", "n", *[F.round(c, 6).alias(c) for c in at], "price_low25", "quantity_low75")


# allocation and baselines


def _sizes(spark: SparkSession, d: str, key: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col(key).alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


@query("d1_proportional", "SELECT o_custkey AS group_id, count(*) AS n, greatest(1, least(count(*), CAST(ceil(0.07::DOUBLE * count(*)) AS BIGINT))) AS k FROM orders GROUP BY 1")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return allocate.proportional(_sizes(spark, d, "o_custkey"), 0.07)


def flat_sql(key: str, eta: float) -> str:
    return f"""WITH s AS (SELECT {key} AS group_id, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(round_even({eta}::DOUBLE * sum(n), 0) AS BIGINT) AS target, max(n) AS m FROM s),
l AS (SELECT max(v) AS level FROM (SELECT unnest(generate_series(1, (SELECT m FROM t))) AS v) WHERE (SELECT sum(least(n, v)) FROM s) <= (SELECT target FROM t)),
r AS (SELECT (SELECT target FROM t) - (SELECT sum(least(n, (SELECT level FROM l))) FROM s) AS rest),
o AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS p FROM s WHERE n > (SELECT level FROM l))
SELECT s.group_id, n, CAST(least(n, (SELECT level FROM l)) + CASE WHEN p <= (SELECT rest FROM r) THEN 1 ELSE 0 END AS BIGINT) AS k FROM s LEFT JOIN o ON s.group_id = o.group_id"""


@query("d2_flat_few_groups", flat_sql("o_orderpriority", 0.15))
def d2(spark: SparkSession, d: str) -> DataFrame:
    return allocate.flat(_sizes(spark, d, "o_orderpriority"), 0.15)


@query("d2_flat_many_groups", flat_sql("o_custkey", 0.3))
def d2b(spark: SparkSession, d: str) -> DataFrame:
    return allocate.flat(_sizes(spark, d, "o_custkey"), 0.3)


@query("d3_stratified_baseline", with_windows("SELECT big_recording_index, window_id, CAST(r - 1 AS INTEGER) AS rank, 1.0::DOUBLE AS utility FROM (SELECT *, row_number() OVER (PARTITION BY big_recording_index ORDER BY md5('29|' || window_id), window_id) AS r, count(*) OVER (PARTITION BY big_recording_index) AS n FROM windows) WHERE r <= greatest(1, least(n, CAST(ceil(0.1::DOUBLE * n) AS BIGINT)))"))
def d3(spark: SparkSession, d: str) -> DataFrame:
    return ranking.stratified(windows(spark, d), "big_recording_index", 0.1, 29).select("big_recording_index", "window_id", "rank", "utility")


@query("d3_numpy_baseline")
def d3b(spark: SparkSession, d: str) -> DataFrame:
    return ranking.numpy_stratified(windows(spark, d), "big_recording_index", 0.1, 29)


# diverse subsets


def greedy_sql(kernel: str, w: float, eta: float = 0.1, direction: str = "top", pool: str = "windows", more: str = "", given: str = "") -> str:
    """Greedy selection as a recursive query over residuals and factors: an independent check."""
    sign = "" if direction == "top" else "-"
    mult = kernel == "multiplicative"
    start = f"wt * wt * (1.0 + 1e-6::DOUBLE)" if mult else f"ut + 1e-6::DOUBLE + {w}::DOUBLE * (1.0 + 1e-6::DOUBLE)"  # noqa: F541
    cosine = "(list_inner_product(x, wx) / (nrm * wn) + CASE WHEN id = wid THEN 1e-6::DOUBLE ELSE 0 END)"
    entry = f"wt * wwt * {cosine}" if mult else f"(CASE WHEN id = wid THEN ut + 1e-6::DOUBLE ELSE 0 END + {w}::DOUBLE * {cosine})"
    return f"""WITH RECURSIVE {more} base AS (SELECT window_id AS id, big_recording_index AS g, embedding AS x, {sign}recon_loss AS loss FROM {pool}),
 u AS (SELECT *, CASE WHEN max(loss) OVER p = min(loss) OVER p THEN 1.0::DOUBLE ELSE (loss - min(loss) OVER p) / (max(loss) OVER p - min(loss) OVER p) END AS ut, {given or f"greatest(1, least(count(*) OVER p, CAST(ceil({eta}::DOUBLE * count(*) OVER p) AS BIGINT)))"} AS k FROM base WINDOW p AS (PARTITION BY g)),
 q AS (SELECT id, g, k, x, ut, sqrt(list_inner_product(x, x)) AS nrm, exp({w}::DOUBLE * (ut - 1.0)) AS wt FROM u),
 st AS (SELECT g, id, k, x, nrm, wt, ut, {start} AS r, []::DOUBLE[] AS c, false AS sel, 0 AS step, NULL::VARCHAR AS win, NULL::DOUBLE AS gain FROM q
  UNION ALL SELECT g, id, k, x, nrm, wt, ut, r - e * e, list_append(c, e), sel OR id = wid, step + 1, wid, ln(greatest(wr, 1e-6)) FROM (
   SELECT *, ({entry} - CASE WHEN step = 0 THEN 0 ELSE list_inner_product(c, wc) END) / sqrt(greatest(wr, 1e-6)) AS e FROM (
    SELECT *, o.id AS wid, o.r AS wr, o.c AS wc, o.x AS wx, o.wt AS wwt, o.nrm AS wn FROM (
     SELECT *, first_value({{'id': id, 'r': r, 'c': c, 'x': x, 'wt': wt, 'nrm': nrm}}) OVER (PARTITION BY g ORDER BY sel, round(ln(greatest(r, 1e-300)), 9) DESC, id) AS o FROM st WHERE step < k)))),
 chosen AS (SELECT DISTINCT g AS group_id, CAST(step - 1 AS INTEGER) AS rank, win AS row_id, round(gain, 6) AS gain FROM st WHERE step > 0)"""


def _selected(spark: SparkSession, d: str, kernel: str, w: float, direction: str = "top", eta: float = 0.1, **more) -> DataFrame:
    return dpp.select(windows(spark, d), "big_recording_index", [dpp.Point(kernel, w)], direction, eta, **more)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("group_id", "rank", "row_id", F.round("gain", 6).alias("gain"))


PICK = " SELECT group_id, rank, row_id, gain FROM chosen"


@query("d8_greedy_multiplicative", with_windows(greedy_sql("multiplicative", 4.0) + PICK))
def d8(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_selected(spark, d, "multiplicative", 4.0))


@query("d6_greedy_additive", with_windows(greedy_sql("additive", 1.0) + PICK))
def d6(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_selected(spark, d, "additive", 1.0))


ONE_GROUP = "(SELECT * REPLACE (CAST(7 AS BIGINT) AS big_recording_index) FROM windows)"


@query("d8_greedy_partitioned", with_windows(greedy_sql("multiplicative", 4.0, pool=ONE_GROUP, given="12") + PICK))
def d8p(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one group that is too large for a task: rows stay partitioned."""
    w = windows(spark, d).withColumn("big_recording_index", F.lit(7).cast("long"))
    given = w.groupBy(F.col("big_recording_index").alias("group_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(12))
    return _digest(dpp.select(w, "big_recording_index", [dpp.Point("multiplicative", 4.0)], "top", 0.1, allocation=given, max_workspace_gib=0.0))


@query("d7_greedy_bottom", with_windows(greedy_sql("additive", 30.0, 0.1, "bottom") + PICK))
def d7(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_selected(spark, d, "additive", 30.0, "bottom"))


@query("d10_tie_rule", with_windows(greedy_sql("multiplicative", 0.0) + PICK))
def d10(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_selected(spark, d, "multiplicative", 0.0))


@query("d13_candidate_pool", with_windows(greedy_sql("multiplicative", 4.0, 0.2, "top", "ranked", ranked_sql("top", 0.5) + ",") + PICK))
def d13(spark: SparkSession, d: str) -> DataFrame:
    pool = ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.5)
    return _digest(_selected(spark, d, "multiplicative", 4.0, "top", 0.2, pool=pool))


@query("d4_gram_row_sums", with_windows("WITH u AS (SELECT window_id, big_recording_index AS g, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM windows) SELECT a.window_id, round(sum(list_inner_product(a.u, b.u)) + 1e-6::DOUBLE, 5) AS total FROM u a JOIN u b ON a.g = b.g GROUP BY 1"))
def d4(spark: SparkSession, d: str) -> DataFrame:
    """Row sums of each group's cosine matrix, from its sum vector: no pairs."""
    u = metrics.unit_rows(windows(spark, d)).select("window_id", F.col("big_recording_index").alias("g"), "unit")
    return u.join(metrics.unit_sums(u, ["g"], "unit"), "g").select("window_id", F.round(dot(F.col("unit"), F.col("s")) + 1e-6, 5).alias("total"))


SWEEP = {"multiplicative": [0, 4, 64], "additive": [0.1, 1, 30]}


def _sweep_sql(columns: str) -> str:
    """``columns`` of each point's chosen rows, each point by its own recursive query."""
    return " UNION ALL ".join(f"SELECT '{k}' AS kernel, {w}::DOUBLE AS w, * FROM ({with_windows(greedy_sql(k, float(w)) + columns)})" for k, ws in SWEEP.items() for w in ws)


_MEMBERS = " SELECT group_id, rank, row_id, gain, round(ut, 6) AS utility, recon_loss FROM chosen JOIN u ON id = row_id JOIN windows ON window_id = row_id"


@query("d12_sweep_memberships", _sweep_sql(_MEMBERS))
def d12(spark: SparkSession, d: str) -> DataFrame:
    out = dpp.select(windows(spark, d), "big_recording_index", dpp.sweep(SWEEP), "top", 0.1)
    return out.select("kernel", "w", "group_id", "rank", "row_id", F.round("gain", 6).alias("gain"), F.round("utility", 6).alias("utility"), "recon_loss")


_RUNS = """, o AS (SELECT c.group_id, exp(c.gain) / s.r AS share, c.row_id FROM chosen c JOIN st s ON s.id = c.row_id AND s.step = 0),
 z AS (SELECT a.group_id, avg(list_inner_product(x.x, y.x) / (x.nrm * y.nrm)) AS mean_cosine FROM chosen a JOIN chosen b ON a.group_id = b.group_id AND a.row_id <> b.row_id JOIN q x ON x.id = a.row_id JOIN q y ON y.id = b.row_id GROUP BY 1)
 SELECT o.group_id, any_value(n.candidates) AS candidates, count(*) AS k, round(coalesce(any_value(z.mean_cosine), 1.0::DOUBLE), 6) AS mean_cosine, CAST(count(*) FILTER (share > 1e-4) AS INTEGER) AS operational_rank,
 CAST(count(*) FILTER (share <= 1e-5) AS INTEGER) AS n_degenerate, count(*) > count(*) FILTER (share > 1e-4) AS rank_limited
 FROM o JOIN (SELECT big_recording_index AS g, count(*) AS candidates FROM windows GROUP BY 1) n ON n.g = o.group_id LEFT JOIN z ON z.group_id = o.group_id GROUP BY 1"""


@query("d11_run_metrics", _sweep_sql(_RUNS))
def d11(spark: SparkSession, d: str) -> DataFrame:
    out = dpp.run_metrics(windows(spark, d), "big_recording_index", dpp.sweep(SWEEP), "top", 0.1)
    return out.select("kernel", "w", "group_id", "candidates", "k", F.round("mean_cosine", 6).alias("mean_cosine"), "operational_rank", "n_degenerate", "rank_limited")


FLAT = "s AS (SELECT big_recording_index AS g, count(*) AS n FROM windows GROUP BY 1), t AS (SELECT CAST(round_even(0.1::DOUBLE * sum(n), 0) AS BIGINT) AS target FROM s), l AS (SELECT max(v) AS level FROM (SELECT unnest(range(100000)) AS v) WHERE (SELECT sum(least(n, v)) FROM s) <= (SELECT target FROM t)), f AS (SELECT g AS gid, least(n, (SELECT level FROM l)) + CASE WHEN n > (SELECT level FROM l) AND count(*) FILTER (n > (SELECT level FROM l)) OVER (ORDER BY g) <= (SELECT target FROM t) - (SELECT sum(least(n, (SELECT level FROM l))) FROM s) THEN 1 ELSE 0 END AS fk FROM s),"


@query("d14_runs_with_allocation", with_windows(greedy_sql("additive", 1.0, more=FLAT, given="(SELECT fk FROM f WHERE gid = base.g)") + " SELECT group_id, rank, row_id, round(gain, 6) AS gain, count(*) OVER (PARTITION BY group_id) AS k FROM chosen WHERE group_id <> 1"))
def d14(spark: SparkSession, d: str) -> DataFrame:
    """Flat allocation over all groups; a sweep of all groups but one."""
    w = windows(spark, d)
    sizes = w.groupBy(F.col("big_recording_index").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    runs = dpp.sweep_runs(w, "big_recording_index", [dpp.Point("additive", 1.0)], "top", 0.1, allocation=allocate.flat(sizes, 0.1).where("group_id <> 1"))
    return dpp.members_of(runs).join(runs.select("group_id", "k"), "group_id").select("group_id", "rank", "row_id", F.round("gain", 6).alias("gain"), "k")


BUILD = {
    "rankings": [{"id": "top", "direction": "top", "scope": "per_recording", "selection_eta": 0.2}, {"id": "low", "direction": "bottom", "scope": "per_recording", "selection_eta": 0.1}],
    "dpp": [{"candidates": "top", "selection_eta": 0.1, "kernels": {"multiplicative": {"w_interaction": [4.0]}}}],
}


def _run_id_sql(text: str) -> str:
    before, after = text.split("-1234567")
    return f"substr(sha256('{before}' || big_recording_index || '{after}'), 1, 20)"


def build_sql() -> str:
    def ids(configuration: dict) -> str:
        return _run_id_sql(sinks.canonical_json({"source_fingerprint": "source", "configuration": {**configuration, "recording": -1234567}}))

    ranked = [f"SELECT {ids({'stage': 'ranking', 'definition': r})} AS run_id, '{r['id']}' AS config_id, 'ranking' AS method, NULL::DOUBLE AS w_interaction, big_recording_index, window_id, recon_loss, rank FROM r{i}" for i, r in enumerate(BUILD["rankings"])]
    s = BUILD["dpp"][0]
    ctes = ", ".join(ranked_sql(r["direction"], r["selection_eta"], f"r{i}") for i, r in enumerate(BUILD["rankings"]))
    swept = f"SELECT {ids({'stage': 'dpp', 'definition': s, 'candidates': 'top', 'kernel_method': 'multiplicative', 'w_interaction': 4.0})}, 'top:multiplicative', 'dpp', 4.0::DOUBLE, big_recording_index, window_id, recon_loss, rank FROM chosen JOIN windows ON window_id = row_id"
    return with_windows(greedy_sql("multiplicative", 4.0, more=ctes + ",") + f""", m AS ({' UNION ALL '.join([*ranked, swept])}),
 j AS (SELECT x.g, count(*) FILTER (a AND b)::DOUBLE / count(*) AS jaccard FROM (SELECT coalesce(r0.big_recording_index, c.group_id) AS g, r0.window_id IS NOT NULL AS a, c.row_id IS NOT NULL AS b FROM r0 FULL JOIN chosen c ON c.row_id = r0.window_id) x GROUP BY 1)
 SELECT run_id, config_id, method, w_interaction, big_recording_index, CAST(count(*) AS INTEGER) AS actual_size, round(avg(recon_loss), 6) AS mean_recon_loss, round(quantile_cont(recon_loss, 0.95), 6) AS recon_loss_q95, string_agg(window_id, ',' ORDER BY rank) AS members,
 round(any_value(CASE WHEN method = 'dpp' THEN jaccard END), 6) AS baseline_jaccard FROM m JOIN j ON j.g = big_recording_index GROUP BY ALL""")


@query("d14_selection_build", build_sql())
def d14b(spark: SparkSession, d: str) -> DataFrame:
    """Run rows of a whole configuration, with their members."""
    members, runs = selections.selections(windows(spark, d), BUILD, "source")
    of = members.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda x: x.row_id), ",").alias("members"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_recon_loss", "recon_loss_q95", "baseline_jaccard")]
    return runs.join(of, "run_id").select("run_id", "config_id", "method", "w_interaction", "big_recording_index", "actual_size", "members", *rounded)


@query("d18_sweep_curves", with_windows(f"WITH {ranked_sql('top', 0.2, 'r0')}, {ranked_sql('bottom', 0.1, 'r1')}, m AS (SELECT 'top' AS config_id, 'top' AS direction, 0.2::DOUBLE AS selection_eta, big_recording_index AS g, avg(recon_loss) AS l, count(*) AS c FROM r0 GROUP BY 4 UNION ALL SELECT 'low', 'bottom', 0.1, big_recording_index, avg(recon_loss), count(*) FROM r1 GROUP BY 4), s AS (SELECT config_id, direction, selection_eta, list_sort(list(l)) AS v, count(*) AS n, avg(c) AS size, avg(l) AS mean FROM m GROUP BY 1, 2, 3) SELECT config_id, direction, selection_eta, CAST(n AS INTEGER) AS recording_count, round(mean, 6) AS mean_recon_loss_mean, round((v[1 + (n - 1) // 2] + v[1 + n // 2]) / 2, 6) AS mean_recon_loss_median, round(v[1 + CAST(floor(0.25::DOUBLE * (n - 1)) AS BIGINT)], 6) AS mean_recon_loss_q25, round(v[1 + CAST(floor(0.75::DOUBLE * (n - 1)) AS BIGINT)], 6) AS mean_recon_loss_q75, round(size, 6) AS actual_size_mean FROM s"))
def d18(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks built, joined to one result, and its curves."""
    base = shared_path(spark, "sweep")
    tasks = {r["id"]: f"{base}/{r['id']}" for r in BUILD["rankings"]}
    for r in BUILD["rankings"]:
        selections.build(windows(spark, d), {"rankings": [r]}, "source", tasks[r["id"]])
    selections.aggregate(spark, tasks, base, BUILD, "source")
    out = spark.read.parquet(f"{base}/curve_summary.parquet")
    return out.select("config_id", "direction", "selection_eta", "recording_count", *[F.round(c, 6).alias(c) for c in ("mean_recon_loss_mean", "mean_recon_loss_median", "mean_recon_loss_q25", "mean_recon_loss_q75", "actual_size_mean")])


@query("d15_run_ids", with_windows("SELECT g AS group_id, w, substr(sha256('{\"configuration\":{\"definition\":{\"direction\":\"top\",\"eta\":0.1},\"recording\":' || g || ',\"stage\":\"dpp\",\"w\":' || w || '},\"source_fingerprint\":\"abc\"}'), 1, 20) AS run_id FROM (SELECT DISTINCT big_recording_index AS g FROM windows), (VALUES ('0.5'), ('1.5'), ('30.25')) t(w)"))
def d15(spark: SparkSession, d: str) -> DataFrame:
    """Run ids of all groups at three weights, made in the plan."""
    s = selections.Settings.of({}, "abc")
    groups = windows(spark, d).select(F.col("big_recording_index").alias("group_id")).distinct()
    ids = [F.struct(F.lit(str(w)).alias("w"), s.run_id(F.col("group_id"), stage="dpp", definition={"direction": "top", "eta": 0.1}, w=w).alias("run_id")) for w in (0.5, 1.5, 30.25)]
    return groups.select("group_id", F.explode(F.array(*ids)).alias("x")).select("group_id", "x.*")


@query("d16_workspace", with_windows("SELECT big_recording_index AS group_id, count(*) * 512 * 8 + 24 * count(*) * count(*) + 16 * CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT) * CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT) AS bytes FROM windows GROUP BY 1"))
def d16(spark: SparkSession, d: str) -> DataFrame:
    sizes = allocate.proportional(windows(spark, d).groupBy(F.col("big_recording_index").alias("group_id")).agg(F.count(F.lit(1)).alias("n")), 0.1)
    return sizes.select("group_id", dpp.workspace_bytes(F.col("n"), F.col("k")).alias("bytes"))


@query("d19_sweep_grid", with_windows("WITH s AS (SELECT count(*) AS n FROM windows GROUP BY big_recording_index), t AS (SELECT eta, count(*) AS runs, CAST(sum(greatest(1, least(n, CAST(ceil(eta * n) AS BIGINT)))) AS BIGINT) AS kept FROM s, (SELECT unnest([0.01, 0.03, 0.1])::DOUBLE AS eta) GROUP BY 1) SELECT direction || '_eta_' || lpad(CAST(CAST(round(eta * 100) AS INTEGER) AS VARCHAR), 3, '0') AS id, direction, eta, kernel, CAST(count(*) AS BIGINT) AS points, CAST(any_value(runs) * count(*) AS BIGINT) AS runs, CAST(any_value(kept) * count(*) AS BIGINT) AS memberships FROM (SELECT unnest(['top', 'bottom']) AS direction) a, t, (SELECT 'multiplicative' AS kernel, unnest(range(20)) AS i UNION ALL SELECT 'additive', unnest(range(17))) c GROUP BY 1, 2, 3, 4"))
def d19(spark: SparkSession, d: str) -> DataFrame:
    """The published grid over the table's groups: points, runs and memberships of each task and kernel."""
    rows = [(t["id"], t["direction"], t["eta"], k, len(ws)) for t in jobs.sweep_config()["tasks"] for k, ws in t["kernels"].items()]
    grid = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("id", "direction", "eta", "kernel", "points"), r, strict=True)]) for r in rows])
    sizes = windows(spark, d).groupBy("big_recording_index").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.withColumn("x", F.explode(grid)).select("n", "x.*").withColumn("points", F.col("points").cast("long")).groupBy("id", "direction", "eta", "kernel", "points").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.greatest(F.lit(1), F.least("n", F.ceil(F.col("eta") * F.col("n").cast("double")))).cast("long")).alias("kept"))
    return each.select("id", "direction", "eta", "kernel", "points", (F.col("groups") * F.col("points")).alias("runs"), (F.col("kept") * F.col("points")).alias("memberships"))


# metrics


@query("a9_vendi")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_vendi(windows(spark, d), "big_recording_index")


@query("a11_mean_cosine", with_windows("WITH u AS (SELECT window_id, big_recording_index AS g, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM windows) SELECT a.g AS big_recording_index, round(avg(list_inner_product(a.u, b.u)), 6) AS mean_cosine FROM u a JOIN u b ON a.g = b.g AND a.window_id <> b.window_id GROUP BY 1"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_cosine(windows(spark, d), ["big_recording_index"]).select("big_recording_index", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("a12_union_vendi")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return metrics.union_vendi(ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.1).withColumn("direction", F.lit("top")), ["direction"])


@query("a13_union_mean_cosine", with_windows(f"WITH {ranked_sql('top', 0.1)}, u AS (SELECT window_id, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM ranked) SELECT 'top' AS direction, round(avg(list_inner_product(a.u, b.u)), 6) AS mean_cosine FROM u a JOIN u b ON a.window_id <> b.window_id"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.1).withColumn("direction", F.lit("top"))
    return metrics.mean_cosine(top, ["direction"]).select("direction", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("a24_participation", with_windows("WITH u AS (SELECT big_recording_index AS g, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM windows), n AS (SELECT g, count(*)::DOUBLE AS n FROM u GROUP BY g) SELECT a.g AS big_recording_index, round(any_value(n) * any_value(n) / sum(list_inner_product(a.u, b.u) * list_inner_product(a.u, b.u)), 5) AS participation FROM u a JOIN u b ON a.g = b.g JOIN n ON n.g = a.g GROUP BY 1"))
def a24(spark: SparkSession, d: str) -> DataFrame:
    return metrics.participation(windows(spark, d), ["big_recording_index"]).select("big_recording_index", F.round("participation", 5).alias("participation"))


ETAS = (0.05, 0.1, 0.2)


def rankings(spark: SparkSession, d: str, directions: tuple[str, ...] = ("top", "bottom")) -> DataFrame:
    """Memberships of rankings at three shares, in the shape of a sweep's: direction, eta 0.1, kernel ranking, w the share."""
    w = windows(spark, d).select("window_id", "big_recording_index", "recon_loss")
    swept = ranking.rank_sweep(w, "big_recording_index", directions, ETAS)
    return swept.select("direction", F.lit(0.1).alias("eta"), F.lit("ranking").alias("kernel"), F.col("eta").alias("w"), F.col("window_id").alias("row_id"), "big_recording_index", "recon_loss")


def rankings_sql(directions: tuple[str, ...] = ("top", "bottom")) -> str:
    ctes = ", ".join(ranked_sql(x, e, f"r_{x}_{i}") for x in directions for i, e in enumerate(ETAS))
    rows = " UNION ALL ".join(f"SELECT '{x}' AS direction, 0.1::DOUBLE AS eta, 'ranking' AS kernel, {e}::DOUBLE AS w, window_id AS row_id, big_recording_index, recon_loss FROM r_{x}_{i}" for x in directions for i, e in enumerate(ETAS))
    return f"{ctes}, members AS ({rows})"


@query("a19_jaccard", with_windows(f"WITH {ranked_sql('top', 0.5, 'x')}, {ranked_sql('bottom', 0.6, 'y')} SELECT g AS big_recording_index, round(count(*) FILTER (a AND b)::DOUBLE / count(*), 6) AS jaccard FROM (SELECT coalesce(x.big_recording_index, y.big_recording_index) AS g, x.window_id IS NOT NULL AS a, y.window_id IS NOT NULL AS b FROM x FULL JOIN y ON x.window_id = y.window_id) GROUP BY 1"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    a, b = (ranking.rank(w, "big_recording_index", x, eta=e).withColumnRenamed("window_id", "row_id") for x, e in (("top", 0.5), ("bottom", 0.6)))
    return metrics.jaccard(a, b, ["big_recording_index"]).select("big_recording_index", F.round("jaccard", 6).alias("jaccard"))


@query("a20_baseline_jaccard", with_windows(greedy_sql("multiplicative", 4.0, more=ranked_sql("top", 0.1) + ",") + " SELECT coalesce(group_id, big_recording_index) AS group_id, round(count(*) FILTER (row_id IS NOT NULL AND window_id IS NOT NULL)::DOUBLE / count(*), 6) AS jaccard FROM chosen FULL JOIN ranked ON row_id = window_id GROUP BY 1"))
def a20(spark: SparkSession, d: str) -> DataFrame:
    base = ranking.rank(windows(spark, d), "big_recording_index", "top", eta=0.1).select(F.col("big_recording_index").alias("group_id"), F.col("window_id").alias("row_id"))
    return metrics.jaccard(_selected(spark, d, "multiplicative", 4.0), base, ["group_id"]).select("group_id", F.round("jaccard", 6).alias("jaccard"))


@query("a21_adjacent_jaccard", with_windows(f"WITH {rankings_sql(('top',))}, s AS (SELECT big_recording_index AS g, w, list(row_id) AS ids, row_number() OVER (PARTITION BY big_recording_index ORDER BY w) AS at FROM members GROUP BY 1, 2), j AS (SELECT a.g, a.at, len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(list_concat(a.ids, b.ids))) AS j FROM s a JOIN s b ON a.g = b.g AND b.at = a.at + 1), e AS (SELECT g, at, j FROM j UNION ALL SELECT g, at + 1, j FROM j) SELECT s.g AS big_recording_index, s.w, round(avg(j), 6) AS adjacent_jaccard FROM s LEFT JOIN e ON s.g = e.g AND s.at = e.at GROUP BY 1, 2".replace(" AS at ", " AS pos ").replace(".at", ".pos").replace("g, at,", "g, pos,").replace("g, at +", "g, pos +")))
def a21(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.adjacent_jaccard(rankings(spark, d, ("top",)), ["big_recording_index"])
    return out.select("big_recording_index", "w", F.round("adjacent_jaccard", 6).alias("adjacent_jaccard"))


@query("a23_unions", with_windows(f"WITH {rankings_sql()} SELECT direction, eta, kernel, w, count(*) AS k, count(DISTINCT big_recording_index) AS groups, round(avg(recon_loss), 6) AS loss FROM members GROUP BY ALL"))
def a23(spark: SparkSession, d: str) -> DataFrame:
    return rankings(spark, d).groupBy("direction", "eta", "kernel", "w").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("big_recording_index").alias("groups"), F.round(F.avg("recon_loss"), 6).alias("loss"))


GRID = {"ranking": list(ETAS)}
MASKS = ["dpp_top_eta_010_ranking", "dpp_bottom_eta_010_ranking"]


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return overlay.masks(rankings(spark, d), GRID, ["top", "bottom"], [0.1])


def mask_cte() -> str:
    bits = ", ".join(f"coalesce(bit_or(CASE WHEN direction = '{x}' THEN CAST(1 AS BIGINT) << CASE w " + " ".join(f"WHEN {e}::DOUBLE THEN {i}" for i, e in enumerate(ETAS)) + f" END END), 0) AS {m}" for x, m in zip(("top", "bottom"), MASKS, strict=True))
    return f"{rankings_sql()}, masks AS (SELECT row_id, {bits} FROM members GROUP BY row_id)"


@query("a26_masks", with_windows(f"WITH {mask_cte()} SELECT * FROM masks"))
def a26(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d)


@query("c4_bit_conservation", with_windows(f"WITH {mask_cte()} SELECT (SELECT CAST(sum(bit_count({MASKS[0]}) + bit_count({MASKS[1]})) AS BIGINT) FROM masks) AS bits, (SELECT count(*) FROM members) AS memberships"))
def c4(spark: SparkSession, d: str) -> DataFrame:
    m = rankings(spark, d)
    return overlay.conserved(_masked(spark, d), m)


@query("m5_overlay", with_windows(f"WITH {mask_cte()} SELECT window_id AS row_id, big_recording_index AS group_id, coalesce({MASKS[0]}, 0) AS {MASKS[0]}, coalesce({MASKS[1]}, 0) AS {MASKS[1]} FROM windows LEFT JOIN masks ON row_id = window_id"))
def m5(spark: SparkSession, d: str) -> DataFrame:
    rows = windows(spark, d).select(F.col("window_id").alias("row_id"), F.col("big_recording_index").alias("group_id"))
    return overlay.overlay(rows, _masked(spark, d))


@query("a27_identical_sets", with_windows(f"WITH {ranked_sql('top', 0.1, 'x')}, {ranked_sql('top', 0.1, 'y', '(SELECT * REPLACE (floor(recon_loss) AS recon_loss) FROM windows)')}, a AS (SELECT big_recording_index AS g, list_sort(list(window_id)) AS ids FROM x GROUP BY 1), b AS (SELECT big_recording_index AS g, list_sort(list(window_id)) AS ids FROM y GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (a.ids = b.ids) AS identical, bool_and(a.ids = b.ids) AS all_identical FROM a JOIN b USING (g)"))
def a27(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    sets = [ranking.rank(x, "big_recording_index", "top", eta=0.1).groupBy("big_recording_index").agg(F.sort_array(F.collect_list("window_id")).alias(n)) for x, n in ((w, "a"), (w.withColumn("recon_loss", F.floor("recon_loss").cast("double")), "b"))]
    return metrics.null_safe_join(*sets, ["big_recording_index"]).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.bool_and(F.col("a") == F.col("b")).alias("all_identical"))


def _published(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members and runs of rankings, and of the same rankings over whole losses, of which one group's highest are not published."""
    out = []
    for w, source in ((windows(spark, d), "a"), (windows(spark, d).withColumn("recon_loss", F.floor("recon_loss").cast("double")), "b")):
        m = ranking.rank_sweep(w.select("window_id", "big_recording_index", "recon_loss"), "big_recording_index", ("top", "bottom"), ETAS)
        about = {"config_id": F.col("direction"), "group_id": F.col("big_recording_index"), "w_interaction": F.when(F.col("eta") != 0.2, F.col("eta")), "kernel_method": F.when(F.col("direction") == "top", "additive"), "method": F.when(F.col("direction") == "top", "dpp").otherwise("ranking")}
        m = m.withColumns(about).withColumn("run_id", F.concat_ws(":", F.lit(source), "config_id", "group_id", F.coalesce(F.col("w_interaction").cast("string"), F.lit("none"))))
        m = m if source == "a" else m.where(~((F.col("direction") == "top") & (F.col("group_id") == 3)))
        out += [m.select("run_id", F.col("window_id").alias("row_id")), m.select("run_id", "method", *compare.RUN_KEY).distinct()]
    return tuple(out)


@query("a27_mismatches", with_windows(f"""WITH {rankings_sql()}, {rankings_sql().replace('r_', 's_').replace('FROM windows', 'FROM (SELECT * REPLACE (floor(recon_loss) AS recon_loss) FROM windows)').replace('members AS', 'theirs AS')},
 m AS (SELECT coalesce(a.direction, b.direction) AS config_id, coalesce(a.big_recording_index, b.big_recording_index) AS group_id, coalesce(a.w, b.w) AS w, count(*) FILTER (b.row_id IS NULL) AS only_here, count(*) FILTER (a.row_id IS NULL) AS only_published, count(*) AS n FROM members a FULL JOIN theirs b ON a.direction = b.direction AND a.w = b.w AND a.row_id = b.row_id GROUP BY 1, 2, 3),
 p AS (SELECT *, NOT (config_id = 'top' AND group_id = 3) AS is_published FROM m)
 SELECT config_id, group_id, CASE WHEN w <> 0.2 THEN w END AS w_interaction, CASE config_id WHEN 'top' THEN 'dpp:additive:w>0' ELSE 'ranking' END AS label, is_published, CASE WHEN is_published THEN only_here = 0 AND only_published = 0 END AS identical, CASE WHEN is_published THEN only_here END AS only_here, CASE WHEN is_published THEN only_published END AS only_published, CASE WHEN is_published THEN round((n - only_here - only_published) / n, 6) END AS jaccard FROM p"""))
def a27m(spark: SparkSession, d: str) -> DataFrame:
    """Every run beside its published one, with what they differ in."""
    out = compare.compare_runs(*_published(spark, d))
    return out.select("config_id", "group_id", "w_interaction", "label", "is_published", "identical", "only_here", "only_published", F.round("jaccard", 6).alias("jaccard"))


@query("a8_curve_summary", with_windows(f"WITH {rankings_sql()}, runs AS (SELECT direction, w, big_recording_index, avg(recon_loss) AS m, count(*) AS actual_size, list_sort(list(recon_loss)) AS l FROM members GROUP BY ALL), s AS (SELECT direction, CASE WHEN direction = 'top' THEN NULL ELSE w END AS w, list_sort(list(m)) AS v, count(*) AS n, avg(actual_size) AS size, avg(m) AS mean FROM runs GROUP BY ALL) SELECT direction, w, CAST(n AS INTEGER) AS recording_count, round(mean, 6) AS loss_mean, round((v[1 + (n - 1) // 2] + v[1 + n // 2]) / 2, 6) AS loss_median, round(v[1 + CAST(floor(0.25::DOUBLE * (n - 1)) AS BIGINT)], 6) AS loss_q25, round(v[1 + CAST(floor(0.75::DOUBLE * (n - 1)) AS BIGINT)], 6) AS loss_q75, round(size, 6) AS actual_size_mean FROM s".replace("GROUP BY ALL), s AS", "GROUP BY direction, w, big_recording_index), s AS").replace("FROM runs GROUP BY ALL", "FROM runs GROUP BY 1, 2")))
def a8(spark: SparkSession, d: str) -> DataFrame:
    runs = rankings(spark, d).groupBy("direction", "w", "big_recording_index").agg(F.avg("recon_loss").alias("loss"), F.count(F.lit(1)).alias("actual_size"))
    out = metrics.curve_summary(runs.withColumn("w", F.when(F.col("direction") == "bottom", F.col("w"))), ["direction", "w"], ["loss"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c != "w" else F.col(c) for c, t in out.dtypes])


@query("a18_rank_limited", " UNION ALL ".join(f"SELECT '{k}' AS kernel, {w}::DOUBLE AS w, count(*) FILTER (limited) AS limited FROM ({with_windows(greedy_sql(k, float(w), 0.3) + ' SELECT c.group_id, count(*) > count(*) FILTER (exp(c.gain) / s.r > 1e-4) AS limited FROM chosen c JOIN st s ON s.id = c.row_id AND s.step = 0 GROUP BY 1')})" for k, w in (("additive", 1.0), ("multiplicative", 0.0))))
def a18(spark: SparkSession, d: str) -> DataFrame:
    """More rows are asked for than vectors have dimensions, so the multiplicative kernel runs out of directions."""
    runs = dpp.run_metrics(windows(spark, d), "big_recording_index", [dpp.Point("additive", 1.0), dpp.Point("multiplicative", 0.0)], "top", 0.3)
    return runs.groupBy("kernel", "w").agg(F.count_if("rank_limited").alias("limited"))


# validation


@query("c1_source_contract", with_windows("SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64) AS bad_width, count(*) FILTER (NOT isfinite(recon_loss)) AS bad_loss, 0::BIGINT AS bad_vector, count(*) FILTER (list_inner_product(embedding, embedding) <= 0) AS zero_vector, 0::BIGINT AS unparsed, (SELECT count(*) FROM (SELECT window_id FROM windows GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, 0::BIGINT AS id_mismatch FROM windows"))
def c1(spark: SparkSession, d: str) -> DataFrame:
    return validate.source_violations(windows(spark, d), 64)


@query("c2_public_artifact", with_windows("SELECT 0 AS has_vectors, count(*) AS rows, count(*) FILTER (NOT isfinite(recon_loss)) AS bad_recon_loss FROM windows"))
def c2(spark: SparkSession, d: str) -> DataFrame:
    return validate.artifact_violations(windows(spark, d).drop("embedding"))


@query("c3_membership_contract", with_windows(f"WITH {ranked_sql('top', 0.1)}, m AS (SELECT big_recording_index AS g, window_id || CASE WHEN rank = 1 THEN 'x' ELSE '' END AS row_id FROM ranked), r AS (SELECT g, count(*) + CASE WHEN g % 2 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN g % 3 = 0 THEN 0.5::DOUBLE WHEN g % 3 = 1 THEN 1.0 ELSE 1e6 END AS vendi, count(*) AS members FROM m GROUP BY 1) SELECT (SELECT count(*) FROM m WHERE row_id NOT IN (SELECT window_id FROM windows)) AS outside, count(*) FILTER (size <> members) AS size_differs, count(*) FILTER (vendi < 1 OR vendi > size) AS vendi_outside FROM r"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    """Members outside the atlas, sizes and scores that are wrong on purpose."""
    w = windows(spark, d)
    g = F.col("big_recording_index")
    members = ranking.rank(w, "big_recording_index", "top", eta=0.1).select(g.cast("string").alias("run_id"), F.concat("window_id", F.when(F.col("rank") == 1, "x").otherwise("")).alias("row_id"), g)
    runs = members.groupBy("run_id", "big_recording_index").agg(F.count(F.lit(1)).alias("n")).select("run_id", (F.col("n") + F.when(g % 2 == 0, 1).otherwise(0)).alias("actual_size"), F.when(g % 3 == 0, 0.5).when(g % 3 == 1, 1.0).otherwise(1e6).alias("vendi_score"))
    return validate.run_violations(members, runs, w.select(F.col("window_id").alias("row_id")))


@query("c7_population", with_windows("WITH o AS (SELECT CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN window_id || 'x' WHEN vec_id % 3 = 0 THEN (SELECT min(window_id) FROM windows) ELSE window_id END AS id FROM windows WHERE recon_loss > 50) SELECT count(*) AS total, count(DISTINCT id) AS unique_ids, count(*) FILTER (id IS NULL) AS null_ids, count(*) FILTER (id IS NULL OR id NOT IN (SELECT window_id FROM windows)) AS missing, (SELECT count(*) FROM windows) AS atlas_rows FROM o"))
def c7(spark: SparkSession, d: str) -> DataFrame:
    """An overlay with null, unknown and repeated ids."""
    w = windows(spark, d)
    first = F.broadcast(w.agg(F.min("window_id").alias("first")))
    v = F.col("vec_id")
    ids = w.where("recon_loss > 50").join(first).select(F.when(v % 7 == 0, None).when(v % 5 == 0, F.concat("window_id", F.lit("x"))).when(v % 3 == 0, F.col("first")).otherwise(F.col("window_id")).alias("row_id"))
    return validate.population_check(ids, w.select(F.col("window_id").alias("row_id")))


@query("k6_manifest_merge", with_windows("SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM windows UNION ALL SELECT 'recordings', CAST(count(DISTINCT big_recording_index) AS VARCHAR) FROM windows UNION ALL SELECT 'stage', 'two'"))
def k6(spark: SparkSession, d: str) -> DataFrame:
    """Two stages add what they know of the table; the later one's value stays."""
    w, path = windows(spark, d), f"{shared_path(spark, 'manifest')}.json"
    sinks.merge_manifest(spark, path, {"rows": w.count(), "stage": "one"})
    merged = sinks.merge_manifest(spark, path, {"recordings": w.select("big_recording_index").distinct().count(), "stage": "two"})
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(merged.items())], "key string, value string")
