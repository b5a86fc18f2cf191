"""The jobs as registered queries: each runs twice into a new folder and returns its whole output as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import selection_release, text_catalogue
from vectide.queries.registry import shared_path, with_windows


def job1_selection_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every membership beside its run and its window's row of the explorer's view."""
    out = shared_path(spark, "selection-release")
    for _ in range(2):
        selection_release.release(spark, sf_dir, out)
    members = spark.read.schema(selection_release.MEMBERS).parquet(f"{out}/members")
    runs = spark.read.schema(selection_release.RUNS).parquet(f"{out}/runs").withColumnsRenamed({"mean_utility": "run_utility"})
    view = spark.read.parquet(f"{out}/view").drop("recon_loss", "group_id")
    rounded = {c: F.round(c, 6) for c in ("utility", "mean_recon_loss", "median_recon_loss", "recon_loss_q5", "recon_loss_q95", "run_utility", "baseline_jaccard")}
    # windows without a membership are part of the output too
    return view.join(members.join(runs, ["direction", "share", "group_id"]), "window_id", "left").withColumns(rounded)


def job2_text_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card beside the counts of its group."""
    out = shared_path(spark, "text-catalogue")
    for _ in range(2):
        text_catalogue.catalogue(spark, sf_dir, out)
    return text_catalogue.cards_with_counts(spark, out)


def job1_sql() -> str:
    c = selection_release.DEFAULTS
    shares = ", ".join(f"({s}::DOUBLE, {i})" for i, s in enumerate(c["shares"]))
    masks = ", ".join(f"CAST(coalesce(bit_or(CASE WHEN direction = '{d}' THEN CAST(1 AS BIGINT) << bit END), 0) AS BIGINT) AS mask_{d}" for d in (*c["directions"], selection_release.RANDOM))
    order = lambda by: f"row_number() OVER (PARTITION BY big_recording_index ORDER BY {by}, window_id) - 1"
    return with_windows(f"""
WITH e(share, bit) AS (VALUES {shares}), d(direction) AS (VALUES ('top'), ('bottom'), ('random')),
n AS (SELECT *, count(*) OVER (PARTITION BY big_recording_index) AS n, {order("recon_loss DESC")} AS t, {order("recon_loss")} AS b, {order(f"md5('{c['baseline_seed']}|' || window_id)")} AS r FROM windows),
m AS (SELECT *, CASE WHEN direction = 'random' OR max(recon_loss) OVER g = min(recon_loss) OVER g THEN 1.0::DOUBLE WHEN direction = 'top' THEN (recon_loss - min(recon_loss) OVER g) / (max(recon_loss) OVER g - min(recon_loss) OVER g)
    ELSE (max(recon_loss) OVER g - recon_loss) / (max(recon_loss) OVER g - min(recon_loss) OVER g) END AS utility
  FROM (SELECT *, CASE direction WHEN 'top' THEN t WHEN 'bottom' THEN b ELSE r END AS rank FROM n, e, d) WHERE rank < greatest(1, least(n, CAST(ceil(share * n) AS BIGINT))) WINDOW g AS (PARTITION BY direction, share, big_recording_index)),
runs AS (SELECT direction, share, big_recording_index, CAST(count(*) AS INTEGER) AS actual_size, avg(recon_loss) AS mean_recon_loss, median(recon_loss) AS median_recon_loss, quantile_cont(recon_loss, 0.05) AS recon_loss_q5, quantile_cont(recon_loss, 0.95) AS recon_loss_q95, avg(utility) AS run_utility FROM m GROUP BY 1, 2, 3),
j AS (SELECT a.direction, a.share, a.big_recording_index, count(z.window_id) AS met FROM m a LEFT JOIN m z ON z.direction = 'random' AND z.share = a.share AND z.window_id = a.window_id WHERE a.direction <> 'random' GROUP BY 1, 2, 3),
masks AS (SELECT window_id, {masks} FROM m GROUP BY 1)
SELECT w.window_id, w.modality, w.n_channels, CASE WHEN w.n_channels IN (19, 21, 22, 125, 128, 129) THEN w.n_channels || ' ch' WHEN w.n_channels <= 64 THEN 'Others LO (≤ 64 ch)' ELSE 'Others HI (> 64 ch)' END AS channels,
  w.dataset || ' · ' || w.modality || ' · ' || w.n_channels || ' ch · rec ' || w.big_recording_index AS label, CAST('0x' || substr(md5(w.window_id), 1, 8) AS BIGINT) % 100 < {c["sample_percent"]} AS in_sample, w.dataset,
  coalesce(mask_top, 0) AS mask_top, coalesce(mask_bottom, 0) AS mask_bottom, coalesce(mask_random, 0) AS mask_random, m.direction, m.share, m.big_recording_index AS group_id, CAST(m.rank AS INTEGER) AS rank, round(m.utility, 6) AS utility, m.recon_loss,
  actual_size, round(mean_recon_loss, 6) AS mean_recon_loss, round(median_recon_loss, 6) AS median_recon_loss, round(recon_loss_q5, 6) AS recon_loss_q5, round(recon_loss_q95, 6) AS recon_loss_q95, round(run_utility, 6) AS run_utility, round(met / (2 * actual_size - met), 6) AS baseline_jaccard
FROM windows w LEFT JOIN masks USING (window_id) LEFT JOIN m ON m.window_id = w.window_id LEFT JOIN runs ON runs.direction = m.direction AND runs.share = m.share AND runs.big_recording_index = m.big_recording_index
LEFT JOIN j ON j.direction = m.direction AND j.share = m.share AND j.big_recording_index = m.big_recording_index""")


def job2_sql() -> str:
    c = text_catalogue.DEFAULTS
    bounds = c["word_bins"]
    names = [f"{a}-{b - 1}" for a, b in zip([0, *bounds], bounds, strict=False)]
    bins = " ".join(f"WHEN n_words < {b} THEN '{n}'" for b, n in zip(bounds, names, strict=True))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
n AS (SELECT doc_id, lang, source, CAST(len(regexp_extract_all(t, '{text_catalogue.WORD}')) AS BIGINT) AS n_words, CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS BIGINT) AS n_lines, CAST(length(t) AS BIGINT) AS n_code_points,
  coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < {c["sample_percent"]}, false) AS in_sample, sha256(t) AS text_sha256 FROM d),
cards AS (SELECT n.*, quality, toxic, CASE {bins} ELSE '{bounds[-1]}+' END AS word_bin FROM n LEFT JOIN l ON l.doc_id = n.doc_id)
SELECT *, count(*) OVER g AS documents, CAST(sum(n_words) OVER g AS BIGINT) AS words, CAST(sum(n_code_points) OVER g AS BIGINT) AS code_points, count(*) FILTER (in_sample) OVER g AS sampled, count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) OVER g AS labelled,
  count(*) FILTER (toxic = 1) OVER g AS toxic_documents, max(n_words) OVER g AS longest
FROM cards WINDOW g AS (PARTITION BY lang, source, word_bin)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_selection_release": job1_selection_release, "job2_text_catalogue": job2_text_catalogue}
ORACLES: dict[str, str] = {"job1_selection_release": job1_sql(), "job2_text_catalogue": job2_sql()}
