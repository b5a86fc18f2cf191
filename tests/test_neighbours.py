"""Neighbours, links, density groups and bounded groups against brute force, with several waves, hot places and repeated vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import cells, cluster, graph, knn, order
from vectide.operators.order import numbered


def vectors(n: int, dim: int = 5, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[n // 3 : n // 2] = v[0]  # many equal ones
    return v


def table(spark, v: np.ndarray, kind: str = "string"):
    name = (lambda i: f"r{i:04d}") if kind == "string" else int
    return spark.createDataFrame([(name(i), x) for i, x in enumerate(v.tolist())], f"id {kind}, embedding array<double>").repartition(3)


@pytest.mark.parametrize("few", [20_000, 0])
def test_numbers_follow_the_order(spark, monkeypatch, few: int) -> None:
    monkeypatch.setattr(order, "TASK_ROWS", few)
    df = spark.createDataFrame([(f"k{(37 * i) % 101:03d}", i % 3) for i in range(101)], "k string, g int")
    assert [r["number"] for r in numbered(df, "k").orderBy("k").collect()] == list(range(101))
    seen: dict[int, list] = {}
    for r in numbered(df, "k", within="g").orderBy("k").collect():
        seen.setdefault(r["g"], []).append(r["number"])
    assert all(x == list(range(len(x))) for x in seen.values())
    assert numbered(df.limit(0), "k").count() == 0


def take(monkeypatch, way: str, few: int = 10_000) -> None:
    """The way that two sides take to each other: "targets" or "queries" are sent to all tasks, or "tiles"."""
    monkeypatch.setattr(knn, "FEW", {"targets": 10_000, "queries": few, "tiles": 0}[way])
    if way == "tiles":
        monkeypatch.setattr(cells, "TILE_ROWS", 16)


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("rows,way", [(4096, "targets"), (1, "targets"), (4096, "queries"), (7, "tiles"), (4096, "tiles")])
def test_nearest_does_not_depend_on_blocks(spark, monkeypatch, kind: str, rows: int, way: str) -> None:
    take(monkeypatch, way, few=60)
    v = vectors(90)
    # scores that differ by less than the digits are ties
    v = np.concatenate([v, np.array([[1, 0, 0, 0, 0], [1, 2e-5, 0, 0, 0], [1, 1e-6, 0, 0, 0]])])
    df = table(spark, v, kind)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.round(u @ u.T, 9)
    got: dict = {}
    for r in knn.nearest(df.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), df, 6, "id", skip_self=True, rows=rows).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r["target"])
    name = (lambda i: f"r{i:04d}") if kind == "string" else int
    for q, targets in got.items():
        i = int(q[1:]) if kind == "string" else q
        assert targets == [name(j) for j in sorted(range(len(v)), key=lambda j: (-score[i, j], j)) if j != i][:6]
    assert len(got) > 20


def test_cells_far_apart_do_not_meet(spark, monkeypatch) -> None:
    """Far fewer products than all pairs on separated clouds, and the same neighbours; on one cloud nothing is lost either."""
    v = clouds([150, 90, 120, 140, 100])
    df = table(spark, v, "long")
    mine = knn._side_of(df, "id", "embedding", None)
    tiled, pivots, known = cells.index(mine, tile_rows=32)
    for k, eps in ((6, 0.0), (None, 0.2)):
        routed = cells.routes(mine, pivots, known, k, eps)
        assert cells.products(routed, tiled) < 0.35 * len(v) ** 2
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = np.round(u @ u.T, 9)
    take(monkeypatch, "tiles")
    got: dict[int, list[int]] = {}
    for r in knn.nearest(df, df, 6, "id").orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r["target"])
    assert got == {i: sorted(range(len(v)), key=lambda j: (-near[i, j], j))[:6] for i in range(len(v))}


@pytest.mark.parametrize("metric", ["cosine", "euclid", "reach"])
def test_metrics_and_hot_copies(spark, monkeypatch, metric: str) -> None:
    """A third of all rows are one vector, with ties, in tiles and past few targets."""
    r = np.random.default_rng(8)
    v = np.round(r.normal(size=(180, 4)), 2)
    v[::3] = v[0]
    floor = np.round(r.random(180), 1)
    floor[::3] = floor[0]
    df = spark.createDataFrame([(i, x, f) for i, (x, f) in enumerate(zip(v.tolist(), floor.tolist(), strict=True))], "id long, embedding array<double>, floor double").repartition(3)
    u = v if metric == "euclid" else v / np.linalg.norm(v, axis=1)[:, None]
    d = np.sqrt(np.maximum((u**2).sum(1)[:, None] + (u**2).sum(1)[None] - 2 * u @ u.T, 0))
    score = np.round({"cosine": u @ u.T, "euclid": -d, "reach": -np.maximum(d, floor[None])}[metric], 5)
    want = {i: sorted((j for j in range(180) if j != i), key=lambda j: (-score[i, j], j))[:5] for i in range(180)}
    for way in ("targets", "tiles"):
        take(monkeypatch, way)
        got: dict[int, list[int]] = {}
        for x in knn.nearest(df, df, 5, "id", metric=metric, skip_self=True, digits=5, floor="floor" if metric == "reach" else None).orderBy("query", "place").collect():
            got.setdefault(x["query"], []).append(x["target"])
        assert got == want


def test_the_driver_takes_no_rows_of_large_sides(spark, monkeypatch) -> None:
    df = table(spark, vectors(400), "long")
    taken: list[int] = []
    collect = type(df).collect

    def counted(self):
        found = collect(self)
        taken.append(sum("v" in r.__fields__ or "embedding" in r.__fields__ for r in found))
        return found

    def none(self):
        raise AssertionError("rows went to the driver")

    take(monkeypatch, "tiles")
    monkeypatch.setattr(type(df), "toArrow", none)
    monkeypatch.setattr(type(df), "collect", counted)
    out = knn.nearest(df, df, 3, "id", skip_self=True)
    assert sum(taken) <= 50  # pivots
    monkeypatch.setattr(type(df), "collect", collect)
    assert out.count() == 1200


def test_nothing_to_meet(spark, monkeypatch) -> None:
    df = table(spark, vectors(9), "long")
    for way in ("targets", "queries", "tiles"):
        take(monkeypatch, way)
        assert knn.nearest(df.limit(0), df, 2, "id").count() == knn.nearest(df, df.limit(0), 2, "id").count() == 0
        assert knn.nearest(df.limit(2), df, 99, "id").count() == 18


@pytest.mark.parametrize("way", ["targets", "queries", "tiles"])
def test_parts_do_not_meet(spark, monkeypatch, way: str) -> None:
    take(monkeypatch, way, few=100)
    v = vectors(60)
    df = table(spark, v, "long").withColumn("p", F.col("id") % 4)
    for r in knn.nearest(df, df, 3, "id", skip_self=True, part="p").collect():
        assert r["query"] % 4 == r["target"] % 4


@pytest.mark.parametrize("rows", [8, 1024])
def test_plane_neighbours(spark, rows: int) -> None:
    r = np.random.default_rng(3)
    p = np.round(r.normal(size=(150, 2)), 3)
    p[40:90] = p[3]
    p[100:110] = p[100]
    df = spark.createDataFrame([(f"r{i:03d}", x, y) for i, (x, y) in enumerate(p.tolist())], "id string, x double, y double").repartition(4)
    d = np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), 9)
    got: dict[str, list[str]] = {}
    for x in knn.plane_nearest(df, 8, "id", "x", "y", rows=rows).orderBy("query", "place").collect():
        got.setdefault(x["query"], []).append(x["target"])
    assert got == {f"r{i:03d}": [f"r{j:03d}" for j in sorted(range(150), key=lambda j: (d[i, j], j)) if j != i][:8] for i in range(150)}
    assert knn.plane_nearest(df.limit(3), 8, "id", "x", "y").count() == 6 and knn.plane_nearest(df.limit(0), 8, "id", "x", "y").count() == 0


def brute_labels(v: np.ndarray, eps: float, m: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.sqrt(np.maximum(2 - 2 * u @ u.T, 0))
    np.fill_diagonal(d, 0)
    core_d = np.sort(d, 1)[:, m - 1]
    wide = np.maximum(d, core_d[None])
    np.fill_diagonal(wide, np.inf)
    far = np.minimum(core_d, wide.min(1))
    core, label = core_d <= eps, list(range(len(v)))
    moved = True
    while moved:
        moved = False
        for i in np.flatnonzero(core):
            for j in np.flatnonzero(core & (d[i] <= eps)):
                if label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    out = [label[i] if core[i] else min((label[j] for j in np.flatnonzero(core & (d[i] <= eps))), default=-1) for i in range(len(v))]
    names: dict[int, int] = {}
    return [names.setdefault(x, len(names)) if x >= 0 else -1 for x in out], core_d, far


@pytest.mark.parametrize("way", ["targets", "tiles"])
@pytest.mark.parametrize("eps", [0.35, 0.7])
def test_density(spark, monkeypatch, eps: float, way: str) -> None:
    take(monkeypatch, way)
    monkeypatch.setattr(graph, "TASK_LINKS", 1_000_000 if way == "targets" else 0)
    v = vectors(120, 4, 5)
    df = table(spark, v).withColumnRenamed("id", "row_id")
    want, core, far = brute_labels(v, eps, 4)
    assert [r["label"] for r in cluster.dbscan(df, eps, 4).orderBy("row_id").collect()] == want
    got = cluster.density(df, 4).orderBy("row_id").collect()
    assert np.allclose([r["core"] for r in got], core, atol=1e-7) and np.allclose([r["reach"] for r in got], far, atol=1e-7)


@pytest.mark.parametrize("way", ["targets", "tiles"])
def test_links_keep_the_components_of_every_level(spark, monkeypatch, way: str) -> None:
    take(monkeypatch, way)
    v = vectors(80, 3, 9)
    levels = [0.1, 0.25, 0.5]
    rows = table(spark, v, "long").withColumn("floor", F.when(F.col("id") % 9 == 0, 0.3).otherwise(0.0))
    links = knn.links(rows, levels, "id", "embedding", "floor").cache()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    floor = np.where(np.arange(80) % 9 == 0, 0.3, 0.0)
    d = np.maximum(np.maximum(np.sqrt(np.maximum(2 - 2 * u @ u.T, 0)), floor[:, None]), floor[None])
    for n, eps in enumerate(levels):
        label = np.arange(80)
        for _ in range(80):
            label = np.minimum(label, np.where(d <= eps, label[None], 80).min(1))
        got = {r["node"]: r["label"] for r in graph.components(links.where(F.col("level") <= n)).collect()}
        assert [got.get(i, i) for i in range(80)] == label.tolist()


def clouds(sizes: list[int], seed: int = 2) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(len(sizes), 16))
    return np.concatenate([c / np.linalg.norm(c) + 0.02 * r.normal(size=(n, 16)) for c, n in zip(centres, sizes, strict=True)])


def check_groups(rows: list, n: int, limits: cluster.Limits) -> None:
    assert sorted(r["row_id"] for r in rows) == [f"r{i:04d}" for i in range(n)]
    members: dict[int, list[str]] = {}
    for r in rows:
        members.setdefault(r["group_id"], []).append(r["row_id"])
    assert sorted(members) == list(range(len(members)))
    assert all(limits.n_min <= len(x) <= limits.n_max for x in members.values())
    assert all(r["group_size"] == len(members[r["group_id"]]) for r in rows)
    firsts = [min(members[g]) for g in sorted(members)]
    assert firsts == sorted(firsts)


def test_clouds_are_density_groups(spark) -> None:
    sizes = [60, 45, 70, 3, 40]
    v = clouds(sizes)
    limits = cluster.Limits(n_max=80, n_min=20, eps0=0.4)
    rows = cluster.grouped(table(spark, v).withColumnRenamed("id", "row_id"), limits).orderBy("row_id").collect()
    check_groups(rows, len(v), limits)
    at = np.cumsum([0, *sizes])
    for a, b in ((0, 1), (1, 2), (2, 3), (4, 5)):  # a large cloud stays together; the small one is attached to one of them
        assert len({r["group_id"] for r in rows[at[a] : at[b]]}) == 1
    assert all(r["attached"] and r["group_split"] == "dbscan" for r in rows[at[3] : at[4]])
    assert not any(r["attached"] for r in rows[: at[3]]) and {r["group_depth"] for r in rows} == {1}


def leaf_plan(leaves: list[tuple[float, int]], limits: cluster.Limits) -> tuple[dict, set]:
    """Merges of leaves at angles, with sizes."""
    sums = {str(i): n * np.array([np.cos(a), np.sin(a)]) for i, (a, n) in enumerate(leaves)}
    return cluster._merge_plan({str(i): cluster._Node(n, 1) for i, (_, n) in enumerate(leaves)}, sums, {str(i): i for i in range(len(leaves))}, limits)


def test_a_leaf_that_takes_another_moves_its_centre() -> None:
    limits = cluster.Limits(n_max=100, n_min=20)
    # leaf 1 lies nearer to leaf 3; once leaf 0 has gone to leaf 2, that is the nearer one
    assert leaf_plan([(1.0, 18), (1.0, 19), (0.4, 20), (1.5, 60)], limits) == ({"0": "1"}, set())
    assert leaf_plan([(0.8, 10), (1.0, 19), (0.5, 22), (1.45, 60)], limits)[0] == {"0": "1"}
    far = [(0.9, 15), (1.1, 19), (0.6, 40), (1.58, 60)]
    assert leaf_plan(far[1:], limits)[0] == {"0": "2"}  # without leaf 0
    plan = leaf_plan([(0.95, 18), (1.1, 19), (0.94, 25), (1.235, 60)], limits)[0]
    assert plan == {"0": "2", "1": "3"}
    moved = leaf_plan([(1.25, 18), (1.1, 19), (0.94, 20), (1.62, 60)], limits)[0]
    assert moved["0"] == "1"


def test_merging_stops_at_the_limits() -> None:
    limits = cluster.Limits(n_max=40, n_min=20)
    goes, large = leaf_plan([(0.0, 5), (0.01, 38), (2.0, 30)], limits)
    assert goes == {"0": "2"} and not large  # the nearest has no room
    goes, large = leaf_plan([(0.0, 5), (0.01, 38), (2.0, 39)], limits)
    assert goes == {"0": "1"} and large == {"1"}  # none has room
    assert leaf_plan([(0.0, 5)], limits) == ({}, set())
    goes, large = leaf_plan([(0.0, 3), (0.1, 4), (0.2, 5)], limits)
    assert len(set(goes)) == 2 and not large  # small ones together


def test_starts_find_planted_clouds(spark) -> None:
    sizes = [300, 20, 150, 40, 90, 10, 60, 200]
    v = clouds(sizes, 4)
    rows = table(spark, v, "long").withColumn("node", F.when(F.col("id") < 490, "left").otherwise("right")).withColumnRenamed("id", "row_id")
    rows = cluster.unit_rows(rows)
    many = {"left": 3, "right": 5}
    got = cluster.starts(rows, many, 7)
    assert all(np.array_equal(got[n], x) for n, x in cluster.starts(rows.repartition(7), many, 7).items())  # whatever the partitions are
    centre = np.cumsum([0, *sizes])
    of = lambda c: int(np.searchsorted(centre, np.argmax(v / np.linalg.norm(v, axis=1)[:, None] @ c), side="right")) - 1
    for node, clouds_ in (("left", [0, 1, 2, 3]), ("right", [3, 4, 5, 6, 7])):
        assert len(got[node]) == many[node] and len({of(c) for c in got[node]}) == many[node] and {of(c) for c in got[node]} <= set(clouds_)
    centres = cluster.kmeans(rows, many, 7, 20)
    assert {of(c) for c in centres["right"]} == {3, 4, 5, 6, 7}
    # more centres than different rows
    same = rows.limit(0).unionAll(spark.createDataFrame([(i, [1.0, 0.0], [1.0, 0.0], "one") for i in range(30)], "row_id long, embedding array<double>, unit array<double>, node string").select(rows.columns))
    assert cluster.kmeans(same, {"one": 4}, 7, 5)["one"].shape[1] == 2


@pytest.mark.parametrize("control", [False, True])
def test_groups_keep_their_limits(spark, control: bool) -> None:
    v = np.concatenate([vectors(150, 6, 1), clouds([9, 200])[:, :6]])
    limits = cluster.Limits(n_max=50, n_min=20, eps0=0.5)
    rows = cluster.grouped(table(spark, v).withColumnRenamed("id", "row_id"), limits, control).collect()
    check_groups(rows, len(v), limits)
    few = cluster.grouped(table(spark, v[:5]).withColumnRenamed("id", "row_id"), limits).collect()
    assert {(r["group_id"], r["group_split"], r["group_size"]) for r in few} == {(0, "root", 5)}
    with pytest.raises(ContractError):
        cluster.grouped(table(spark, v).withColumnRenamed("id", "row_id"), cluster.Limits(n_max=50, n_min=30))


def test_kmeans_holds_few_products_at_once() -> None:
    """A batch beside many centres is measured in pieces, with the results of all at once."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from vectide.operators import cluster

    r = np.random.default_rng(2)
    rows, centres = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(10_000, 8)), r.normal(size=(4000, 8))))
    batch = pa.RecordBatch.from_arrays([pa.array(["0"] * len(rows)), pa.FixedSizeListArray.from_arrays(rows.ravel(), 8).cast(pa.list_(pa.float64()))], ["node", "unit"])
    sent = SimpleNamespace(value={"0": centres})
    for made in (cluster._gaps, cluster._shares, cluster._sums, cluster._assign):
        tracemalloc.start()
        out = list(made(sent)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 10_000 * 4000 * 8 / 3
        if made is cluster._assign:
            assert out[0]["part"].to_pylist() == (rows @ centres.T).argmax(1).tolist()
        if made is cluster._gaps:
            assert np.isclose(out[0]["gap"][0].as_py(), (1 - (rows @ centres.T).max(1)).sum())


def test_crowded_sides_meet_without_a_shuffle_by_tile(spark, monkeypatch) -> None:
    """Where no tile can be left out, blocks pass one another as written: what is shuffled doesn't grow with the number of tiles."""
    v = np.random.default_rng(8).normal(size=(300, 12))
    v[250:] = v[:50]  # copies
    df = spark.createDataFrame([(i, x, i % 2, float(i % 5) / 10) for i, x in enumerate(v.tolist())], "at long, embedding array<double>, part long, core double").repartition(3).cache()

    def results() -> list:
        near = sorted(map(tuple, knn.nearest(df, df, 6, "at", skip_self=True).select("query", "target", "place").collect()))
        parts = sorted(map(tuple, knn.nearest(df, df, 4, "at", metric="reach", skip_self=True, part="part", floor="core").select("query", "target", "place").collect()))
        least = sorted(map(tuple, knn.least_within(df, df.withColumn("value", F.col("at") + 7), 0.6, "at", "embedding", "value").collect()))
        links = knn.links(df, [0.5, 0.8], "at", "embedding", "core", "part").cache()
        joined = [sorted(map(tuple, graph.components(links.where(F.col("level") <= n)).collect())) for n in (0, 1)]
        return [near, parts, least, joined]

    want = results()

    def never(*args, **kwargs):
        raise AssertionError("a shuffle by tile")

    take(monkeypatch, "tiles")
    monkeypatch.setattr(cells, "meet", never)
    monkeypatch.setattr(cells, "QUERY_ROWS", 70)
    monkeypatch.setattr(cells, "TARGET_ROWS", 40)
    monkeypatch.setattr(cells, "TARGET_BYTES", 150 * 12 * 8)  # two parts of the targets
    assert results() == want


def test_a_forest_joins_what_all_links_join(monkeypatch) -> None:
    import pyarrow as pa

    r = np.random.default_rng(4)
    links = np.stack([r.integers(0, 60, 500), r.integers(0, 60, 500), r.integers(0, 2, 500)]).astype(np.int64)
    links[:2, links[2] == 0] //= 8
    batches = [pa.RecordBatch.from_arrays([pa.array(links[0, i : i + 50]), pa.array(links[1, i : i + 50]), pa.array(links[2, i : i + 50].astype(np.int32))], ["a", "b", "level"]) for i in range(0, 500, 50)]
    for most in (4_000_000, 120, 20):
        monkeypatch.setattr(graph, "HELD_LINKS", most)
        out = np.concatenate([np.stack([c.to_numpy().astype(np.int64) for c in b.columns]) for b in graph.forest(iter(batches))], axis=1)
        for n in (0, 1):
            want, got = (dict(zip(*map(np.ndarray.tolist, graph._labels(x[:2, x[2] <= n].T)), strict=True)) for x in (links, out))
            assert {k: x for k, x in want.items() if k != x} == {k: x for k, x in got.items() if k != x}
        if most > 500:
            assert out.shape[1] < 120


def test_links_do_not_grow_with_the_tasks(spark, monkeypatch) -> None:
    """Each task of crowded sides sends a forest over all rows; put together they are one link for each row and level, not one for each task."""
    v = np.random.default_rng(3).normal(size=(400, 12))
    df = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(v.tolist())], "at long, embedding array<double>, core double").repartition(3).cache()
    take(monkeypatch, "tiles")
    monkeypatch.setattr(cells, "QUERY_ROWS", 40)
    monkeypatch.setattr(cells, "TARGET_ROWS", 40)
    monkeypatch.setattr(cells, "TARGET_BYTES", 100 * 12 * 8)
    links = knn.links(df, [1.1], "at", "embedding", "core")
    assert links.count() <= 2 * len(v)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near, label = np.sqrt(np.maximum(2 - 2 * u @ u.T, 0)) <= 1.1, np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(near, label[None], len(v)).min(1))
    got = {r["node"]: r["label"] for r in graph.components(links.select("a", "b")).collect()}
    assert [got.get(i, i) for i in range(len(v))] == label.tolist()


def test_products_of_32_bits_lose_no_pair() -> None:
    """Pairs at the bound itself are found, scaled components or copies, and few or many pairs are scored alike."""
    r = np.random.default_rng(5)
    for dim in (1, 3, 64, 500):
        a, b = (cells.unit(r.normal(size=(n, dim)) * 10.0 ** r.integers(-3, 4, dim)) for n in (70, 90))
        b[:20] = a[:20]
        full = a @ b.T
        for least in (np.sort(full, axis=1)[:, -5], np.full(70, 1.0 - 1e-12)):
            i, j = knn.close(a, b, least)
            assert set(zip(*map(np.ndarray.tolist, np.nonzero(full >= least[:, None])), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
            assert np.allclose(knn.cosines(a, b, i, j), full[i, j], atol=1e-14)


def test_dense_clouds_are_linked_by_few_pairs(monkeypatch) -> None:
    """What one near pair tells is not asked of all pairs: blocks of several clouds, some rows of which take part at wider levels only."""
    r = np.random.default_rng(4)
    centre = cells.unit(r.normal(size=(3, 16)))
    centre = np.concatenate([centre, cells.unit(centre[:1] + 0.05 * r.normal(size=(1, 16)))])
    of = r.integers(0, 4, 1200)
    v = cells.unit(centre[of] + 0.004 * r.normal(size=(1200, 16)))
    levels = [0.06, 0.12, 0.4]
    floor = np.where(np.arange(1200) % 11 == 0, 0.1, 0.02)
    side = lambda at: cells.Side(at, v[at], np.zeros(len(at), np.int64), floor[at], np.zeros(len(at), np.int64))
    looked, close, kernel = [], knn.close, knn._Links(levels)
    monkeypatch.setattr(knn, "close", lambda a, b, least: looked.append(len(a) * len(b)) or close(a, b, least))
    found = [x for q in (np.arange(600), np.arange(600, 1200)) for x in [side(q)]]
    links = []
    for q in found:
        known = kernel.begin(q)
        for t in found:
            kernel.add(q, known, t)
        links.append(kernel.done(q, known))
    a, b, level = (np.concatenate([t[c].to_numpy() for t in links]) for c in ("a", "b", "level"))
    d = np.maximum(np.maximum(np.sqrt(np.maximum(2 - 2 * v @ v.T, 0)), floor[:, None]), floor[None])
    for n, eps in enumerate(levels):
        want, got = np.arange(1200), np.arange(1200)
        for _ in range(20):
            want = np.minimum(want, np.where(d <= eps, want[None], 1200).min(1))
        nodes, label = graph._labels(np.stack([a, b], 1)[level <= n])
        got[nodes] = label
        assert (got == want).all()
    assert sum(looked) < 0.2 * 1200**2


@pytest.mark.parametrize("way", ["targets", "tiles"])
def test_levels_tell_rows_apart_as_exact_distances_do(spark, monkeypatch, way: str) -> None:
    take(monkeypatch, way)
    u, (low, high), m = cells.unit(np.random.default_rng(6).normal(size=(160, 3))), (0.3, 0.7), 4
    rows = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(u.tolist())], "at long, unit array<double>, part long").cache()
    exact = cluster.reach(cluster.core_distances(rows, m, "at", part="part").cache(), "at", part="part").orderBy("at").collect()
    got = cluster._told_apart(rows, m, low, high).orderBy("at").collect()
    assert len(got) == len(exact) and any(r["core"] > low >= r["reach"] for r in exact)
    for a, b in zip(got, exact, strict=True):
        for e in (low, 0.4, high):
            assert ((a["core"] <= e), (a["reach"] <= e)) == ((b["core"] <= e), (b["reach"] <= e))
        if b["core"] > low and b["reach"] <= high:
            assert a["via"] == b["via"] or b["reach"] == b["core"]
