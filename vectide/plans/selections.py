"""The selection build: a configuration of rankings, baselines and diverse sweeps to memberships, run rows, curves and a manifest.

Runs of a definition differ by group only, so a definition is one plan over all groups: run ids are hashes made in the plan from
a text that holds the group's number, and every metric is an aggregate by run id. A sweep's memberships and metrics come
from one grouped map, written once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import allocate, dpp, metrics, ranking, validate
from vectide.plans.jobs import fingerprint
from vectide.schema import CURVES, RUNS, SELECTIONS, conform
from vectide.sources import sinks
from vectide.sources.scratch import scope, written

#: Name of the grouping by recordings, and a group's number that stands for all of them in a text.
RECORDINGS, ANY_GROUP = "recording", -987654321
CURVE_KEYS = ["config_id", "method", "direction", "scope", "selection_eta", "kernel_method", "w_interaction"]
CURVE_METRICS = ["vendi_score", "vendi_score_normalized", "mean_pairwise_cosine", "mean_recon_loss"]
_HEAD = ("run_id", "config_id", "method", "direction", "scope", "candidate_run_id", "group_id", "allocation", "candidate_k", "selection_eta", "kernel_method", "w_interaction", "seed")
_MEMBER = ("run_id", "row_id", "rank", "marginal_logdet_gain", "utility", "recon_loss")


@dataclass(frozen=True)
class Settings:
    """What holds for all runs of a build."""

    source: str
    configuration: str
    grouping: str
    epsilon: float
    tie: float
    max_workspace_gib: float | None
    refuse: bool
    seed: int

    @staticmethod
    def of(config: dict, source: str) -> Settings:
        numbers = config.get("numerics", {})
        tie, limit = numbers.get("tie_tolerance", dpp.TIE), numbers.get("max_workspace_gib")
        return Settings(
            source, fingerprint(config), str(config.get("grouping", {}).get("name", RECORDINGS)), float(numbers.get("epsilon", dpp.EPSILON)), 0.0 if tie is None else float(tie),
            None if limit is None else float(limit), Settings.refuses(numbers), int(config.get("projection", {}).get("seed", 0)),
        )

    @staticmethod
    def refuses(numbers: dict) -> bool:
        """Whether groups beyond the stated workspace end the build; with "beyond_workspace": "partition" they stay partitioned."""
        how = numbers.get("beyond_workspace", "refuse")
        if how not in ("refuse", "partition"):
            raise ContractError(f"beyond_workspace {how}")
        return how == "refuse"

    def run_id(self, group: Column | None, **configuration: object) -> Column:
        """The run id of each row's group (None: of the whole table), as :func:`vectide.plans.jobs.run_id` makes it."""
        number = None if group is None else ANY_GROUP
        key = {"recording": number} if self.grouping == RECORDINGS else {"grouping": self.grouping, "group": number}
        text = sinks.canonical_json({"source_fingerprint": self.source, "configuration": {**configuration, **key}})
        if group is None:
            return F.substring(F.sha2(F.lit(text).cast("binary"), 256), 1, 20)
        before, after = text.split(str(ANY_GROUP))
        return F.substring(F.sha2(F.concat(F.lit(before), group.cast("string"), F.lit(after)).cast("binary"), 256), 1, 20)


def share(definition: dict, needed: bool = True) -> float | None:
    """The definition's share of rows, within 0 and 1."""
    eta = definition.get("selection_eta")
    if eta is None and not needed:
        return None
    if eta is None or not 0.0 < float(eta) <= 1.0:
        raise ContractError(f"selection_eta {eta} of {definition.get('id', definition.get('candidates'))} is not within 0 and 1")
    return float(eta)


def allocated(sizes: DataFrame, definition: dict, eta: float) -> DataFrame:
    how = str(definition.get("allocation", "proportional"))
    if how not in ("proportional", "flat"):
        raise ContractError(f"unknown allocation {how}")
    return allocate.proportional(sizes, eta) if how == "proportional" else allocate.flat(sizes, eta)


def grouped_windows(windows: DataFrame, config: dict, groups: DataFrame | None) -> DataFrame:
    """``windows`` with group_id: the recording, or the column of a group table that has to cover the windows exactly."""
    grouping = config.get("grouping", {})
    if str(grouping.get("name", RECORDINGS)) == RECORDINGS and groups is None:
        return windows.withColumn("group_id", F.col("big_recording_index").cast("long"))
    if groups is None:
        raise ContractError("the grouping needs a table of groups")
    named = groups.select(F.col("row_id").alias("window_id"), F.col(str(grouping.get("column", "group_id"))).cast("long").alias("group_id"))
    return validate.require_aligned(windows.drop("group_id"), named, "window_id")


def _ranking(rows: DataFrame, sizes: DataFrame, definition: dict, s: Settings) -> tuple[DataFrame, DataFrame]:
    name, direction, scope = str(definition["id"]), str(definition["direction"]), str(definition["scope"])
    eta, most = share(definition, False), int(definition.get("candidate_k", 0))
    if direction not in ("top", "bottom") or scope not in ("global", "per_recording", "per_group"):
        raise ContractError(f"ranking {name}: direction {direction}, scope {scope}")
    if eta is None and most <= 0:
        raise ContractError(f"ranking {name} needs selection_eta or candidate_k")
    if scope == "global":
        picked = ranking.rank(rows.drop("group_id"), None, direction, eta, None if eta is not None else most).withColumnRenamed("group_rows", "n").withColumn("group_id", F.lit(None).cast("long"))
    else:
        given = allocated(sizes, definition, eta) if eta is not None else sizes.withColumn("k", F.least("n", F.lit(most)))
        picked = ranking.rank_given(rows, "group_id", direction, given).join(sizes, "group_id")
    run = s.run_id(None if scope == "global" else F.col("group_id"), stage="ranking", definition=definition)
    picked = picked.withColumn("run_id", run).withColumn("config_id", F.lit(name))
    size = F.count(F.lit(1)).over(Window.partitionBy("run_id")).cast("double") / F.col("n") if eta is None else F.lit(eta)
    picked = ranking.with_utility(picked, ["run_id"], direction)
    return _finished(picked, definition, "ranking", direction, scope, size, s.seed)


def _finished(picked: DataFrame, definition: dict, method: str, direction: str, scope: str, eta: Column, seed: int) -> tuple[DataFrame, DataFrame]:
    """(heads, members) of rows with run_id, config_id, n, window_id, rank, utility."""
    out = picked.select(
        "run_id", "config_id", F.lit(method).alias("method"), F.lit(direction).alias("direction"), F.lit(scope).alias("scope"), F.lit(None).cast("string").alias("candidate_run_id"), "group_id",
        F.lit(str(definition.get("allocation", "proportional"))).alias("allocation"), F.col("n").alias("candidate_k"), eta.cast("double").alias("selection_eta"), F.lit(None).cast("string").alias("kernel_method"),
        F.lit(None).cast("double").alias("w_interaction"), F.lit(seed).cast("long").alias("seed"), F.col("window_id").alias("row_id"), F.col("rank").cast("int").alias("rank"),
        F.lit(None).cast("double").alias("marginal_logdet_gain"), F.col("utility").cast("double").alias("utility"), F.col("recon_loss").cast("double").alias("recon_loss"),
    )
    out = written(out, "selected")
    return out.where(F.col("rank") == 0).select(*_HEAD), out.select(*_MEMBER)


def _baseline(rows: DataFrame, sizes: DataFrame, definition: dict, s: Settings) -> tuple[DataFrame, DataFrame]:
    name, scope, seed = str(definition["id"]), str(definition.get("scope", "per_recording")), int(definition.get("seed", s.seed))
    if scope not in ("per_recording", "per_group"):
        raise ContractError(f"baseline {name}: scope {scope}")
    eta = share(definition)
    drawn = ranking.numpy_stratified(rows, "group_id", eta, seed, given=allocated(sizes, definition, eta))
    picked = drawn.join(rows.select("window_id", "recon_loss"), "window_id").join(sizes, "group_id").withColumn("utility", F.lit(1.0))
    picked = picked.withColumn("run_id", s.run_id(F.col("group_id"), stage="random_stratified", definition=definition)).withColumn("config_id", F.lit(name))
    return _finished(picked, definition, "random_stratified", "random", scope, F.lit(eta), seed)


def _sweep(rows: DataFrame, sizes: DataFrame, definition: dict, rankings: dict[str, tuple[dict, DataFrame, DataFrame]], s: Settings) -> tuple[DataFrame, DataFrame]:
    """(heads with the sweep's metrics, members) of one diverse sweep."""
    name, eta = str(definition["candidates"]), share(definition)
    if name not in rankings:
        raise ContractError(f"a sweep refers to the unknown ranking {name}")
    ranked, heads, members = rankings[name]
    wanted = definition.get("group_ids", definition.get("recording_indices"))
    if wanted is not None:
        known = {r[0] for r in sizes.where(F.col("group_id").isin([int(g) for g in wanted])).select("group_id").collect()}
        if len(known) < len({int(g) for g in wanted}):
            raise ContractError(f"no ranking {name} of groups {sorted({int(g) for g in wanted} - known)}")
    only = (lambda df: df) if wanted is None else (lambda df: df.where(F.col("group_id").isin([int(g) for g in wanted])))
    points = dpp.sweep({str(k): v["w_interaction"] for k, v in definition["kernels"].items()})
    pool, given = None, allocated(sizes, definition, eta)
    if not definition.get("full_population", True):
        pool = members.select(F.col("row_id").alias("window_id"))
        given = allocate.proportional(rows.join(pool, "window_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), eta)
    swept = dpp.sweep_runs(only(rows), "group_id", points, str(ranked["direction"]), eta, s.epsilon, only(given), pool, s.tie, s.max_workspace_gib, s.refuse)
    run = reduce(lambda c, p: F.when((F.col("kernel") == p.kernel) & (F.col("w") == p.w), s.run_id(F.col("group_id"), stage="dpp", definition=definition, candidates=name, kernel_method=p.kernel, w_interaction=p.w)).otherwise(c), points, F.lit(None).cast("string"))
    swept = written(swept.withColumn("run_id", run), "sweep")
    candidate = heads.select(F.col("group_id").alias("__g"), F.col("run_id").alias("candidate_run_id"))
    joined = swept.crossJoin(F.broadcast(candidate.limit(1).drop("__g"))) if str(ranked["scope"]) == "global" else swept.join(candidate, F.col("group_id") == F.col("__g")).drop("__g")
    out = joined.select(
        "run_id", F.concat(F.lit(f"{name}:"), "kernel").alias("config_id"), F.lit("dpp").alias("method"), F.lit(str(ranked["direction"])).alias("direction"), F.lit(str(ranked["scope"])).alias("scope"), "candidate_run_id", "group_id",
        F.lit(str(definition.get("allocation", "proportional"))).alias("allocation"), F.col("candidates").alias("candidate_k"), F.lit(eta).alias("selection_eta"), F.col("kernel").alias("kernel_method"), F.col("w").alias("w_interaction"),
        F.lit(s.seed).cast("long").alias("seed"), "log_det", F.col("vendi").alias("vendi_score"), F.col("mean_cosine").alias("mean_pairwise_cosine"), "operational_rank", F.col("n_degenerate").alias("n_degenerate_steps"), "rank_limited",
        F.col("positions").alias("greedy_order"), F.col("gains").alias("marginal_logdet_gains"),
    )
    of_run = dpp.members_of(swept).join(swept.select("group_id", "kernel", "w", "run_id"), ["group_id", "kernel", "w"])
    return out, of_run.select("run_id", "row_id", "rank", F.col("gain").alias("marginal_logdet_gain"), "utility", "recon_loss")


def selections(windows: DataFrame, config: dict, source: str, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(memberships, run rows) of all definitions of ``config``, in the columns of SELECTIONS and RUNS.

    ``config``: rankings (id, direction, scope, selection_eta or candidate_k, allocation), baselines (id, selection_eta, seed, scope,
    allocation), dpp (candidates, selection_eta, kernels, group_ids, full_population, allocation), numerics, grouping.
    """
    s = Settings.of(config, source)
    rows = grouped_windows(windows, config, groups).select("window_id", "group_id", "recon_loss", "embedding")
    sizes = written(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    narrow = rows.drop("embedding")
    rankings = {str(d["id"]): (d, *_ranking(narrow, sizes, d, s)) for d in config.get("rankings", [])}
    plain = [r[1:] for r in rankings.values()] + [_baseline(narrow, sizes, d, s) for d in config.get("baselines", [])]
    swept = [_sweep(rows, sizes, d, rankings, s) for d in config.get("dpp", [])]
    if not plain:
        raise ContractError("a configuration has rankings or baselines")
    members = written(reduce(DataFrame.unionByName, [m for _, m in plain + swept]), "members")
    heads = reduce(DataFrame.unionByName, [h for h, _ in plain])
    # diversity of plain runs; a sweep brings its own
    vectors = members.join(heads.select("run_id"), "run_id", "left_semi").join(rows.select(F.col("window_id").alias("row_id"), "embedding"), "row_id")
    vendi = metrics.group_vendi(vectors, "run_id", epsilon=s.epsilon).select("run_id", F.col("vendi").alias("vendi_score"))
    cosine = metrics.mean_cosine(vectors, ["run_id"]).select("run_id", F.col("mean_cosine").alias("mean_pairwise_cosine"))
    runs = heads.join(vendi, "run_id").join(cosine, "run_id")
    if swept:
        all_swept = reduce(DataFrame.unionByName, [h for h, _ in swept])
        of_run = members.join(all_swept.select("run_id", "candidate_run_id", "config_id", "group_id", F.col("w_interaction").alias("w")), "run_id")
        base = members.select(F.col("run_id").alias("candidate_run_id"), "row_id").join(all_swept.select("run_id", "candidate_run_id"), "candidate_run_id")
        overlap = metrics.jaccard(of_run, base, ["run_id"]).withColumnRenamed("jaccard", "baseline_jaccard")
        beside = metrics.adjacent_jaccard(of_run, ["config_id", "group_id"]).select("config_id", "group_id", F.col("w").alias("w_interaction"), "adjacent_jaccard")
        all_swept = all_swept.join(overlap, "run_id", "left").join(beside, ["config_id", "group_id", "w_interaction"], "left")
        runs = runs.unionByName(all_swept, allowMissingColumns=True)
    summary = ranking.loss_summary(members, ["run_id"]).join(members.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("actual_size")), "run_id")
    diverse = F.col("method") == "dpp"
    out = runs.join(summary, "run_id").withColumns({
        "vendi_score_normalized": F.col("vendi_score") / F.col("actual_size"), "grouping": F.lit(s.grouping), "big_recording_index": F.col("group_id") if s.grouping == RECORDINGS else F.lit(None), "epsilon": F.lit(s.epsilon),
        "solver_backend": F.when(diverse, "numpy-greedy-cholesky").otherwise("none"), "device": F.lit("cpu"), "source_fingerprint": F.lit(s.source), "configuration_fingerprint": F.lit(s.configuration),
    })
    return conform(members, SELECTIONS), conform(out, RUNS)


def _counts(members: DataFrame, runs: DataFrame) -> dict:
    by = {r[0]: r[1] for r in runs.groupBy("method").agg(F.count(F.lit(1))).collect()}
    return {"rows": members.count(), "runs": sum(by.values())} | {f"{m}_runs": by.get(m, 0) for m in ("ranking", "dpp", "random_stratified")}


def build(windows: DataFrame, config: dict, source: str, directory: str, groups: DataFrame | None = None) -> dict:
    """Write memberships and runs of a configuration to ``directory``, all or nothing, and its part of the manifest."""
    spark, directory = windows.sparkSession, directory.rstrip("/")
    places = {n: f"{directory}/{n}.parquet" for n in ("selections", "selection_runs")}
    with scope(spark):
        sinks.write_tables(dict(zip(places.values(), selections(windows, config, source, groups), strict=True)))
    members, runs = (spark.read.parquet(p) for p in places.values())
    about = _counts(members, runs) | {
        "artifacts": {"memberships": "selections.parquet", "runs": "selection_runs.parquet"}, "configuration_fingerprint": fingerprint(config), "source_fingerprint": source, "population": str(config.get("input", {}).get("population", "source")),
        "grouping": Settings.of(config, source).grouping, "groups": runs.where(F.col("group_id").isNotNull()).select("group_id").distinct().count(),
    }
    return sinks.merge_manifest(spark, f"{directory}/manifest.json", {"selection": about})


def is_built(spark: SparkSession, config: dict, source: str, directory: str) -> bool:
    """Whether ``directory`` holds the whole result of this configuration and source."""
    try:
        about = sinks.merge_manifest(spark, f"{directory}/manifest.json", {}).get("selection", {})
        whole = all(spark.read.parquet(f"{directory}/{n}.parquet").limit(1).count() for n in ("selections", "selection_runs"))
    except Exception:  # noqa: BLE001  a table that isn't there or can't be read is to be built
        return False
    return bool(whole) and about.get("configuration_fingerprint") == fingerprint(config) and about.get("source_fingerprint") == source


def curves(runs: DataFrame) -> DataFrame:
    """Operating curves: metrics of each point over its groups, in the columns of CURVES."""
    return conform(metrics.curve_summary(runs, CURVE_KEYS, CURVE_METRICS), CURVES)


def aggregate(spark: SparkSession, tasks: dict[str, str], directory: str, config: dict, source: str) -> dict:
    """One result from the tasks of a sweep (task -> directory): memberships, runs, curves, manifest."""
    directory = directory.rstrip("/")
    read = lambda n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{p}/{n}.parquet") for p in tasks.values()])
    members, runs = read("selections"), read("selection_runs")
    with scope(spark):
        sinks.write_tables({f"{directory}/selections.parquet": members, f"{directory}/selection_runs.parquet": runs, f"{directory}/curve_summary.parquet": curves(runs)})
    about = _counts(members, runs) | {"population": str(config.get("input", {}).get("population", "display")), "source_fingerprint": source, "configuration_fingerprint": fingerprint(config)}
    names = {"memberships": "selections.parquet", "runs": "selection_runs.parquet", "curves": "curve_summary.parquet"}
    return sinks.merge_manifest(spark, f"{directory}/manifest.json", {"schema_version": 1, "artifacts": names, "selection": about, "selection_sweep_tasks": list(tasks)})
