"""Selection from partitioned groups equals the selection inside one task, ties and copies included."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import dpp, greedy
from vectide.plans import selections

POINTS = dpp.sweep({"additive": [0.0, 0.5, 3.0], "multiplicative": [0.0, 2.0, 40.0]})


def problem(n: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    v, loss = r.normal(size=(n, dim)), np.round(r.random(n), 2)
    v[n // 2 : n // 2 + n // 5] = v[3]  # copies
    loss[::7] = loss[0]
    return v, loss


@pytest.mark.parametrize("most", [4096, 12, 1])
def test_equals_one_task(spark, most: int) -> None:
    v, loss = problem(240, 24, 1)
    utility = (loss - loss.min()) / (loss.max() - loss.min())
    df = spark.createDataFrame([(i, x, u) for i, (x, u) in enumerate(zip((v / np.linalg.norm(v, axis=1)[:, None]).tolist(), utility.tolist(), strict=True))], "at long, unit array<double>, utility double").repartition(8)
    k = 16 if most > 1 else 5
    want = dpp.choose(dpp.gram(v), utility, POINTS, k)
    rows, gains, shares = greedy.choose(df.cache(), POINTS, k, most=most)
    for i in range(len(POINTS)):
        assert rows[i].tolist() == want.rows[i].tolist(), POINTS[i]
        assert np.allclose(gains[i], want.gains[i], atol=1e-8) and np.allclose(shares[i], want.shares[i], atol=1e-9)


def windows(spark, n: int = 150):
    v, loss = problem(n, 20, 4)
    return spark.createDataFrame([(f"w{(37 * i) % n:04d}", i % 3, x, float(y)) for i, (x, y) in enumerate(zip(v.tolist(), loss.tolist(), strict=True))], "window_id string, g long, embedding array<double>, recon_loss double").repartition(5)


@pytest.mark.parametrize("direction", ["top", "bottom"])
def test_groups_beyond_the_workspace(spark, direction: str) -> None:
    w = windows(spark)
    points = [dpp.Point("additive", 1.0), dpp.Point("multiplicative", 4.0)]
    want = {(r["group_id"], r["kernel"]): r for r in dpp.sweep_runs(w, "g", points, direction, 0.2).collect()}
    some = w.where((F.col("g") < 2) | (F.col("window_id") < "w0040"))  # group 2 is small and stays in one task
    limit = (dpp.workspace_bytes(45, 9) + 1) / 2**30
    for rows, expected in ((w, 3), (some, 2)):
        got = dpp.sweep_runs(rows, "g", points, direction, 0.2, max_workspace_gib=limit).collect()
        large = [r for r in got if r["candidates"] > 45]
        assert len(large) == 2 * expected and len(got) == 6
        for r in large:
            x = want[r["group_id"], r["kernel"]]
            assert r["row_ids"] == x["row_ids"] and r["positions"] == x["positions"] and r["operational_rank"] == x["operational_rank"]
            assert all(np.allclose(r[c], x[c], atol=1e-7) for c in ("gains", "utilities", "losses", "log_det", "vendi", "mean_cosine"))


def test_refusals(spark) -> None:
    w, points = windows(spark, 60), [dpp.Point("additive", 1.0)]
    with pytest.raises(ContractError, match="workspace"):
        dpp.sweep_runs(w, "g", points, "top", 0.2, max_workspace_gib=1e-9, refuse=True)
    with pytest.raises(ContractError, match="beyond_workspace"):
        selections.Settings.of({"numerics": {"beyond_workspace": "hope"}}, "s")
    assert selections.Settings.of({}, "s").refuse and not selections.Settings.of({"numerics": {"beyond_workspace": "partition"}}, "s").refuse
    one = w.limit(1).select(F.lit(0).cast("long").alias("at"), F.array(F.lit(1.0)).alias("unit"), F.lit(1.0).alias("utility"))
    for k in (0, 2):
        with pytest.raises(ContractError, match="can't be selected"):
            greedy.choose(one, points, k)


def test_more_choices_than_dimensions(spark) -> None:
    """Past the rank of the vectors pivots are what the diagonal adds."""
    v, loss = problem(80, 6, 9)
    utility = (loss - loss.min()) / (loss.max() - loss.min())
    df = spark.createDataFrame([(i, x, u) for i, (x, u) in enumerate(zip((v / np.linalg.norm(v, axis=1)[:, None]).tolist(), utility.tolist(), strict=True))], "at long, unit array<double>, utility double").repartition(3)
    points = [dpp.Point("additive", 2.0), dpp.Point("multiplicative", 1.0)]
    want = dpp.choose(dpp.gram(v), utility, points, 15)
    rows, gains, _ = greedy.choose(df, points, 15)
    assert rows[0].tolist() == want.rows[0].tolist() and np.allclose(gains[0], want.gains[0], atol=1e-8)
    assert rows[1][:6].tolist() == want.rows[1][:6].tolist() and (gains[1][6:] < -13).all() and (want.gains[1][6:] < -13).all()


def test_a_task_makes_no_matrix_of_pairs() -> None:
    """A group of 3,000 rows is chosen from in less memory than its cosines take, with the same result."""
    import tracemalloc

    import pyarrow as pa

    v, loss = problem(3000, 16, 3)
    points, k = dpp.sweep({"additive": [0.5], "multiplicative": [2.0]}), 300
    part = pa.table({"group_id": pa.array([5] * 3000), "row_id": [f"w{i:05d}" for i in range(3000)], "embedding": pa.array(v.tolist()), "recon_loss": loss, "k": pa.array([k] * 3000)})
    tracemalloc.start()
    got = dpp._sweep(points, "top", dpp.EPSILON, dpp.TIE, dpp.BATCH_BYTES)(part).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3000 * 3000 * 8 / 4
    cosines, utility = dpp.gram(v), (loss - loss.min()) / (loss.max() - loss.min())
    want = dpp.choose(cosines, utility, points, k)
    assert got[0]["positions"] == want.rows[0].tolist() and np.allclose(got[0]["gains"], want.gains[0], atol=1e-7)
    for j, r in enumerate(got):
        block = cosines[np.ix_(r["positions"], r["positions"])]
        assert np.isclose(r["vendi"], dpp.vendi(block), atol=1e-6) and np.isclose(r["mean_cosine"], dpp.mean_offdiagonal(block), atol=1e-9)
        a, d = dpp.weighted(points[j : j + 1], utility)
        mine, own = a[0, r["positions"]], np.broadcast_to(d, a.shape)[0, r["positions"]]
        assert np.isclose(r["log_det"], np.linalg.slogdet(mine[:, None] * mine * block + np.diag(own + dpp.EPSILON))[1], atol=1e-4)


def test_without_a_stated_limit_what_a_task_holds_counts(spark) -> None:
    """The estimate of three square matrices is for configurations that state a limit; a build without one refuses no group."""
    assert dpp.workspace_bytes(61_500, 6150) > 8 << 30 and dpp.held_bytes(61_500, 6150, 64, 6) < dpp.TASK_BYTES
    assert selections.Settings.of({}, "s").max_workspace_gib is None and selections.Settings.of({"numerics": {"max_workspace_gib": 8}}, "s").max_workspace_gib == 8.0
    w, points = windows(spark), [dpp.Point("additive", 1.0)]
    want = sorted((r["group_id"], tuple(r["row_ids"])) for r in dpp.sweep_runs(w, "g", points, "top", 0.2).collect())
    assert want == sorted((r["group_id"], tuple(r["row_ids"])) for r in dpp.sweep_runs(w, "g", points, "top", 0.2, refuse=True).collect())
