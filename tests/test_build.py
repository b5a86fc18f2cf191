"""The selection build against brute force: members, run ids, metrics, overlaps, errors, aggregation."""

from __future__ import annotations

import copy

import numpy as np
import pytest

from vectide.errors import ContractError
from vectide.operators import dpp, metrics
from vectide.plans import jobs, selections
from vectide.schema import CURVES, RUNS, SELECTIONS

CONFIG = {
    "rankings": [
        {"id": "top20", "direction": "top", "scope": "per_recording", "selection_eta": 0.2}, {"id": "low_all", "direction": "bottom", "scope": "global", "candidate_k": 9},
        {"id": "flat", "direction": "top", "scope": "per_group", "selection_eta": 0.25, "allocation": "flat"},
    ],
    "baselines": [{"id": "random", "selection_eta": 0.2, "seed": 29}],
    "dpp": [
        {"candidates": "top20", "selection_eta": 0.2, "kernels": {"multiplicative": {"w_interaction": [0, 4, 16]}, "additive": {"w_interaction": [1]}}},
        {"candidates": "flat", "selection_eta": 0.5, "full_population": False, "group_ids": [1, 2], "kernels": {"additive": {"w_interaction": [0.5, 2.5]}}},
    ],
}


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    return [(f"{g}_-_0_-_{i}", g, float(np.round(r.random() * 9, 2)), r.normal(size=6).tolist()) for g in range(3) for i in range(10 + 7 * g)]


@pytest.fixture(scope="module")
def windows(spark, data):
    return spark.createDataFrame(data, "window_id string, big_recording_index long, recon_loss double, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def built(windows):
    members, runs = selections.selections(windows, CONFIG, "source")
    assert members.schema == SELECTIONS and [(f.name, f.dataType) for f in runs.schema] == [(f.name, f.dataType) for f in RUNS]
    of: dict[str, list] = {}
    for m in members.orderBy("run_id", "rank").collect():
        of.setdefault(m["run_id"], []).append(m)
    return of, runs.collect()


def test_runs(built, data) -> None:
    of, runs = built
    assert {r["run_id"] for r in runs} == set(of) and len(runs) == 3 + 1 + 3 + 3 + 3 * 4 + 2 * 2
    loss, vector = {d[0]: d[2] for d in data}, {d[0]: d[3] for d in data}
    sets = {r["run_id"]: {m["row_id"] for m in of[r["run_id"]]} for r in runs}
    for r in runs:
        ids = [m["row_id"] for m in of[r["run_id"]]]
        values = np.array([loss[i] for i in ids])
        assert r["actual_size"] == len(ids) == len(set(ids)) and [m["rank"] for m in of[r["run_id"]]] == list(range(len(ids)))
        assert np.isclose(r["mean_recon_loss"], values.mean()) and np.isclose(r["recon_loss_q95"], np.percentile(values, 95)) and r["min_recon_loss"] == values.min()
        cosines = dpp.gram(np.array([vector[i] for i in ids]))
        assert np.isclose(r["vendi_score"], metrics.vendi(cosines), atol=1e-5) and np.isclose(r["mean_pairwise_cosine"], metrics.mean_offdiagonal(cosines), atol=1e-9)
        assert np.isclose(r["mean_utility"], np.mean([m["utility"] for m in of[r["run_id"]]])) and r["big_recording_index"] == r["group_id"] and r["source_fingerprint"] == "source"
        if r["method"] == "ranking":
            definition = next(d for d in CONFIG["rankings"] if d["id"] == r["config_id"])
            assert r["run_id"] == jobs.run_id("source", {"stage": "ranking", "definition": definition, "recording": r["group_id"]})
            mine = [d for d in data if r["group_id"] is None or d[1] == r["group_id"]]
            sign = -1 if r["direction"] == "top" else 1
            assert ids == [d[0] for d in sorted(mine, key=lambda d: (sign * d[2], d[0]))][: len(ids)] and r["candidate_k"] == len(mine)
        if r["method"] == "dpp":
            definition = next(d for d in CONFIG["dpp"] if r["config_id"].startswith(d["candidates"] + ":"))
            key = {"stage": "dpp", "definition": definition, "candidates": definition["candidates"], "recording": r["group_id"], "kernel_method": r["kernel_method"], "w_interaction": r["w_interaction"]}
            assert r["run_id"] == jobs.run_id("source", key)
            pool = sorted(d[0] for d in data if d[1] == r["group_id"] and (definition.get("full_population", True) or d[0] in sets[r["candidate_run_id"]]))
            v = np.array([loss[i] for i in pool])
            got = dpp.choose(dpp.gram(np.array([vector[i] for i in pool])), (v - v.min()) / (v.max() - v.min()), [dpp.Point(r["kernel_method"], r["w_interaction"])], max(1, int(np.ceil(definition["selection_eta"] * len(pool)))))
            assert ids == [pool[i] for i in got.rows[0]] and r["greedy_order"] == got.rows[0].tolist() and r["candidate_k"] == len(pool)
            assert np.allclose(r["marginal_logdet_gains"], got.gains[0]) and np.isclose(r["log_det"], got.log_det[0])
            base = sets[r["candidate_run_id"]]
            assert np.isclose(r["baseline_jaccard"], len(base & sets[r["run_id"]]) / len(base | sets[r["run_id"]]))
            sweep = sorted((x["w_interaction"], x["run_id"]) for x in runs if (x["config_id"], x["group_id"]) == (r["config_id"], r["group_id"]))
            at = [x for _, x in sweep].index(r["run_id"])
            near = [sets[sweep[j][1]] for j in (at - 1, at + 1) if 0 <= j < len(sweep)]
            mean = np.mean([len(x & sets[r["run_id"]]) / len(x | sets[r["run_id"]]) for x in near]) if near else None
            assert (r["adjacent_jaccard"] is None) == (mean is None) and (mean is None or np.isclose(r["adjacent_jaccard"], mean))
        if r["method"] == "random_stratified":
            mine = sorted(d[0] for d in data if d[1] == r["group_id"])
            assert ids == [mine[i] for i in np.random.default_rng(29 + r["group_id"]).choice(len(mine), len(ids), replace=False)]


@pytest.mark.parametrize("change,message", [
    (lambda c: c["dpp"][0].update(candidates="none"), "unknown ranking"), (lambda c: c["dpp"][1].update(group_ids=[1, 7]), "groups"), (lambda c: c["rankings"][0].update(selection_eta=1.5), "within"), (lambda c: c["rankings"][1].pop("candidate_k"), "needs"),
    (lambda c: c["rankings"][0].update(direction="up"), "direction"), (lambda c: c["baselines"][0].update(scope="global"), "scope"), (lambda c: c["rankings"][0].update(allocation="odd"), "allocation"), (lambda c: c.update(grouping={"name": "set"}), "table of groups"),
    (lambda c: c.update(numerics={"max_workspace_gib": 1e-9}), "workspace"),
])
def test_errors(windows, change, message: str) -> None:
    config = copy.deepcopy(CONFIG)
    change(config)
    with pytest.raises(ContractError, match=message):
        selections.selections(windows, config, "source")


def test_build_and_aggregate(spark, windows, tmp_path) -> None:
    tasks = {}
    for name, ws in (("a", [0, 8]), ("b", [32])):
        config = {"rankings": CONFIG["rankings"][:1], "dpp": [{"candidates": "top20", "selection_eta": 0.2, "kernels": {"multiplicative": {"w_interaction": ws}}}], "grouping": {"name": "set"}}
        groups = windows.selectExpr("window_id AS row_id", "big_recording_index + 10 AS group_id")
        tasks[name] = f"file://{tmp_path}/{name}"
        about = selections.build(windows, config, "source", tasks[name], groups)["selection"]
        assert about["ranking_runs"] == 3 and about["dpp_runs"] == 3 * len(ws) and about["groups"] == 3 and about["grouping"] == "set"
        assert selections.is_built(spark, config, "source", tasks[name]) and not selections.is_built(spark, config, "other", tasks[name]) and not selections.is_built(spark, config, "source", f"file://{tmp_path}/none")
    whole = selections.aggregate(spark, tasks, f"file://{tmp_path}/all", {"x": 1}, "source")
    assert whole["selection"]["runs"] == 3 + 3 + 6 + 3 and whole["selection_sweep_tasks"] == ["a", "b"]
    runs = spark.read.parquet(f"file://{tmp_path}/all/selection_runs.parquet")
    assert {r["group_id"] for r in runs.collect()} == {10, 11, 12} and runs.where("big_recording_index IS NOT NULL").count() == 0
    curves = spark.read.parquet(f"file://{tmp_path}/all/curve_summary.parquet")
    assert curves.columns == CURVES.fieldNames()
    got = {(r["method"], r["w_interaction"]): r for r in curves.collect()}
    assert set(got) == {("ranking", None), ("dpp", 0.0), ("dpp", 8.0), ("dpp", 32.0)} and got["ranking", None]["recording_count"] == 6
    values = sorted(r["vendi_score"] for r in runs.where("w_interaction = 8").collect())
    assert np.isclose(got["dpp", 8.0]["vendi_score_mean"], np.mean(values)) and np.isclose(got["dpp", 8.0]["vendi_score_median"], values[1]) and got["dpp", 8.0]["vendi_score_q25"] == values[0]
