"""Allocation, greedy selection, groups, metrics: known results and differential checks."""

from __future__ import annotations

import numpy as np
import pytest

from vectide.errors import ContractError
from vectide.operators import allocate, cluster, dpp, metrics, ranking


def dense_greedy(kernel: np.ndarray, k: int) -> list[int]:
    """Greedy by determinants of whole submatrices."""
    picked: list[int] = []
    for _ in range(k):
        rest = [i for i in range(len(kernel)) if i not in picked]
        picked.append(max(rest, key=lambda i: np.linalg.slogdet(kernel[np.ix_([*picked, i], [*picked, i])])[1]))
    return picked


POINTS = [dpp.Point("multiplicative", 4.0), dpp.Point("multiplicative", 0.5), dpp.Point("additive", 1.0), dpp.Point("additive", 30.0), dpp.Point("additive", 0.0)]


def whole_kernel(cosines: np.ndarray, utility: np.ndarray, p: dpp.Point) -> np.ndarray:
    if p.kernel == "multiplicative":
        q = np.exp(p.w * (utility - utility.max()))
        return q[:, None] * cosines * q[None, :]
    return np.diag(utility + 1e-6) + p.w * cosines


@pytest.mark.parametrize("seed", range(3))
def test_points_side_by_side_choose_by_determinants(seed: int) -> None:
    r = np.random.default_rng(seed)
    cosines, utility = dpp.gram(r.normal(size=(40, 8))), r.random(40)
    got = dpp.choose(cosines, utility, POINTS, 6)
    for i, p in enumerate(POINTS):
        full = whole_kernel(cosines, utility, p)
        rows = got.rows[i]
        assert rows.tolist() == dense_greedy(full, 6)
        block = full[np.ix_(rows, rows)]
        assert np.isclose(got.gains[i].sum(), np.linalg.slogdet(block)[1], atol=1e-6)
        assert np.isclose(got.log_det[i], np.linalg.slogdet(block + 1e-6 * np.eye(6))[1], atol=1e-9)
        assert np.allclose(got.shares[i], np.exp(got.gains[i]) / np.diagonal(full)[rows])
        alone = dpp.choose(cosines, utility, [p], 6)
        assert (alone.rows[0] == rows).all() and np.allclose(alone.gains[0], got.gains[i])


def test_ties_go_to_the_first_row() -> None:
    got = dpp.choose(dpp.gram(np.ones((4, 3))), np.ones(4), [dpp.Point("multiplicative", 0.0)], 1)
    assert got.rows.tolist() == [[0]]
    with pytest.raises(ContractError):
        dpp.choose(dpp.gram(np.eye(3)), np.ones(3), POINTS, 4)


def test_zero_vectors_are_refused() -> None:
    with pytest.raises(ContractError):
        dpp.gram(np.array([[0.0, 0.0], [1.0, 0.0]]))


def fill(sizes: list[int], target: int) -> list[int]:
    k = [0] * len(sizes)
    while sum(k) < target:
        i = min((i for i in range(len(sizes)) if k[i] < sizes[i]), key=lambda i: (k[i], i))
        k[i] += 1
    return k


@pytest.mark.parametrize("sizes,eta", [([5, 50, 500, 5000], 0.10), ([3, 3, 3], 1.0), ([10, 10, 10], 0.1), ([1, 100], 0.5)])
def test_flat_allocation(spark, sizes: list[int], eta: float) -> None:
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "group_id long, n long")
    got = [r["k"] for r in allocate.flat(df, eta).orderBy("group_id").collect()]
    assert got == fill(sizes, round(eta * sum(sizes)))


def test_flat_allocation_needs_a_row_for_each_group(spark) -> None:
    with pytest.raises(ContractError):
        allocate.flat(spark.createDataFrame([(i, 10) for i in range(5)], "group_id long, n long"), 0.01)


def test_proportional_allocation(spark) -> None:
    df = spark.createDataFrame([(0, 389), (1, 1636), (2, 12940)], "group_id long, n long")
    assert [r["k"] for r in allocate.proportional(df, 0.01).orderBy("group_id").collect()] == [4, 17, 130]


def test_vendi_from_matrix_and_from_dual(spark) -> None:
    r = np.random.default_rng(1)
    rows = [(g, r.normal(size=6).tolist()) for g in range(2) for _ in range(3 + 9 * g)]
    df = spark.createDataFrame(rows, "g long, embedding array<double>")
    got = {x["g"]: x["vendi"] for x in metrics.group_vendi(df, "g").collect()}
    for g in (0, 1):
        assert np.isclose(got[g], metrics.vendi(dpp.gram(np.array([v for k, v in rows if k == g]))), atol=1e-6)


def test_mean_cosine_of_one_row_is_one(spark) -> None:
    df = spark.createDataFrame([(0, [1.0, 2.0])], "g long, embedding array<double>")
    assert metrics.mean_cosine(df, ["g"]).first()["mean_cosine"] == 1.0


def test_equal_losses_have_utility_one(spark) -> None:
    df = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 2.0)], "window_id string, g long, recon_loss double")
    assert {r["utility"] for r in ranking.with_utility(df, ["g"], "top").collect()} == {1.0}


def test_colours_differ_between_neighbours() -> None:
    edges = [(i, j, 1.0) for i in range(6) for j in range(i)]
    assert len(set(cluster.colours(edges, 6))) == 6
    assert len(set(cluster.colours(edges, 6, palette=3))) == 3


def slow_colours(edges, nodes, palette):
    """The rule as it is told: always the group with most colours beside it, then of most neighbours, then of the smallest number."""
    weight = {}
    for a, b, w in edges:
        weight[a, b] = weight.get((a, b), 0) + w
        weight[b, a] = weight.get((b, a), 0) + w
    out = {}
    while len(out) < nodes:
        near = {i: [x for y, x in weight if y == i] for i in range(nodes) if i not in out}
        i = min(near, key=lambda j: (-len({out[x] for x in near[j] if x in out}), -len(near[j]), j))
        cost = [sum(weight[i, x] for x in near[i] if out.get(x) == c) for c in range(palette)]
        out[i] = cost.index(min(cost))
    return [out[i] for i in range(nodes)]


def test_colours_of_parts_equal_the_rule_over_all_groups(spark) -> None:
    rng = np.random.default_rng(11)
    for palette in (3, 10):
        # three islands of 12, 9 and 7 groups, two groups on their own, links that repeat
        links = [(base + int(a), base + int(b), float(rng.integers(20, 90))) for base, n, m in ((0, 12, 40), (12, 9, 20), (21, 7, 9)) for a, b in rng.integers(0, n, (m, 2)) if a != b]
        links += links[:5]
        want = slow_colours(links, 30, palette)
        assert cluster.colours(links, 30, palette) == want
        contacts = spark.createDataFrame(links + [(4, 4, 50.0)], "a long, b long, contacts double")
        groups = spark.createDataFrame([(i,) for i in range(30)] + [(3,), (None,)], "group_id long")
        got = {r["group_id"]: r["group_colour"] for r in cluster.coloured(contacts, groups, palette).collect()}
        assert [got[i] for i in range(30)] == want and len(got) == 30


def test_colours_without_contacts(spark) -> None:
    contacts = spark.createDataFrame([], "a long, b long, contacts double")
    groups = spark.createDataFrame([(5,), (8,)], "group_id long")
    assert sorted(map(tuple, cluster.coloured(contacts, groups).collect())) == [(5, 0), (8, 0)]
    assert cluster.coloured(contacts, groups.limit(0)).count() == 0


def test_preflight_refuses_large_groups(spark) -> None:
    df = spark.createDataFrame([("a", 0, 1.0, [1.0])], "window_id string, g long, recon_loss double, embedding array<double>")
    with pytest.raises(ContractError):
        dpp.prepare(df, "g", 0.1, max_workspace_gib=1e-9)
