"""Layouts keep planted clouds apart, their graphs follow their definitions, and sums over a grid are near the exact ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import layout, project
from vectide.operators.metrics import unit_rows


def clouds(many: int, each: int, dim: int = 24, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    centre = r.normal(size=(many, dim))
    return np.concatenate([c / np.linalg.norm(c) + 0.06 * r.normal(size=(each, dim)) for c in centre])


def table(spark, v: np.ndarray):
    return spark.createDataFrame([(f"w{i:04d}", i, x) for i, x in enumerate(v.tolist())], "window_id string, at long, embedding array<double>").repartition(3)


def kept(y: np.ndarray, of: np.ndarray, k: int = 10) -> float:
    """The share of points' k nearest in the plane that are of their own cloud."""
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return float((of[np.argsort(d, 1)[:, :k]] == of[:, None]).mean())


def places(df) -> np.ndarray:
    return np.array([(r["projection_x"], r["projection_y"]) for r in df.orderBy("window_id").collect()])


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_layouts_keep_clouds_better_than_principal_components(spark, method: str) -> None:
    v, of = clouds(16, 30), np.repeat(np.arange(16), 30)
    df = table(spark, v)
    flat, y = places(project.project(df, "pca")), places(project.project(df, method))
    assert np.isfinite(y).all() and np.abs(np.abs(flat).max() - 10) < 1e-9
    assert kept(y, of) > 0.97 > kept(flat, of) + 0.1
    assert np.allclose(y, places(project.project(df.repartition(5), method)), atol=1e-6)  # a seed's layout


def test_umap_extends_to_rows_outside_its_sample(spark) -> None:
    v, of = clouds(6, 50), np.repeat(np.arange(6), 50)
    y = places(project.project(table(spark, v), "umap", sample=150))
    assert len(y) == 300 and kept(y, of) > 0.95


def test_tsne_needs_all_rows(spark) -> None:
    with pytest.raises(ContractError, match="needs all rows"):
        project.project(table(spark, clouds(2, 10)), "tsne", sample=10)
    with pytest.raises(ContractError, match="no fit"):
        project.project(table(spark, clouds(2, 10)), "magic")


def test_fuzzy_graph_by_its_definition(spark) -> None:
    v = clouds(3, 25, 8)
    v[7] = v[6]
    k = 8
    u = v / np.linalg.norm(v, axis=1)[:, None]
    far = np.maximum(1 - u @ u.T, 0)
    share = np.zeros(far.shape)
    for i in range(len(v)):
        near = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(u[i] @ u[j], 9), j))[: k - 1]
        d = far[i, near]
        beyond = np.maximum(d - d[d > 0].min(), 0)
        low, high = 1e-9, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(-beyond / mid).sum() < np.log2(k - 1) else (low, mid)
        share[i, near] = np.exp(-beyond / max(low, layout.LEAST_SHARE * d.mean()))
    want = share + share.T - share * share.T
    got = {(r["a"], r["b"]): r["weight"] for r in layout.fuzzy_graph(unit_rows(table(spark, v)), k).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(want)), strict=True)}
    assert all(abs(w - want[i, j]) < 1e-6 for (i, j), w in got.items())


def test_chances_have_the_perplexity(spark) -> None:
    rows = layout._neighbours(unit_rows(table(spark, clouds(3, 60))), 60).mapInArrow(layout._chances(20.0), "a long, b long, p double")
    entropy = rows.groupBy("a").agg(F.sum(-F.col("p") * F.log("p")).alias("e"), F.sum("p").alias("p")).collect()
    assert len(entropy) == 180 and all(abs(r["e"] - np.log(20)) < 1e-6 and abs(r["p"] - 1) < 1e-9 for r in entropy)


@pytest.mark.parametrize(("scale", "off"), [(0.001, 0.02), (1.0, 0.02), (20.0, 0.2)])
def test_repulsion_from_a_grid(scale: float, off: float) -> None:
    """Nearly exact while cells are small beside the kernel; in a layout of some hundred units the nearest pairs are smoothed."""
    y = scale * np.random.default_rng(3).normal(size=(400, 2))
    d = y[:, None] - y[None]
    near = 1 / (1 + (d**2).sum(2))
    force, total = layout.repulsion(y)
    want = (d * (near**2)[:, :, None]).sum(1)
    assert abs(total - (near.sum() - 400)) < 0.02 * near.sum()
    assert np.linalg.norm(force - want) < off * np.linalg.norm(want)


def test_curve_follows_its_goal() -> None:
    a, b = layout.curve(0.1, 1.0)
    d = np.linspace(0.01, 3, 50)
    assert np.abs(1 / (1 + a * d ** (2 * b)) - np.where(d < 0.1, 1, np.exp(-(d - 0.1)))).max() < 0.08 and 1 < a < 2 and 0.7 < b < 1.1


def test_partitioned_descent_is_that_of_one_task(spark) -> None:
    rows = unit_rows(table(spark, clouds(6, 30))).select("at", "unit")
    graph = layout.chance_graph(rows, 10.0)
    start = project.pca(rows, 3).orderBy("at").toPandas()
    y = np.round(start[["x", "y"]].to_numpy(), 9) + np.concatenate([np.random.default_rng([3, b]).normal(scale=1e-4, size=(min(50, 180 - 50 * b), 2)) for b in range(4)])
    e = graph.orderBy("a", "b").toPandas()
    want = layout.match(y, e["a"].to_numpy(), e["b"].to_numpy(), e["weight"].to_numpy(), steps=12, early=6)
    found = layout.matched(project.pca(rows, 3), graph, 3, steps=12, early=6, rows=50).orderBy("at").toPandas()
    got = found[["x", "y"]].to_numpy()
    assert found["at"].tolist() == list(range(180)) and np.ptp(want) > 1e-3
    assert np.abs(got - want).max() < 1e-3 * np.ptp(want)


def test_tsne_of_more_rows_than_a_task_takes(spark, monkeypatch) -> None:
    """No sample stated: all rows are fitted, whatever their number."""
    monkeypatch.setattr(project, "SAMPLE", 60)
    monkeypatch.setattr(layout, "BLOCK_ROWS", 50)
    monkeypatch.setattr(layout.matched, "__defaults__", (4, 2, 12.0, None))
    monkeypatch.setattr(layout, "placed", None)
    y = places(project.project(table(spark, clouds(5, 24)), "tsne"))
    assert y.shape == (120, 2) and np.isfinite(y).all() and len(np.unique(y, axis=0)) == 120 and np.abs(y.mean(0)).max() < 1e-9


def test_a_step_is_one_job(spark) -> None:
    """Nothing of a step comes to the driver before the next one."""
    start = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "at long, x double, y double")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(59)], "a long, b long, weight double")
    context, jobs = spark.sparkContext, []
    for steps in (1, 5):
        context.setJobGroup(f"steps-{steps}", "")
        layout.matched(start, graph, 3, steps=steps, early=1, rows=20)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"steps-{steps}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 4


def test_few_rows(spark) -> None:
    for n in (1, 2, 3):
        for method in ("pca", "umap", "tsne"):
            assert np.isfinite(places(project.project(table(spark, clouds(1, n)), method))).all()
