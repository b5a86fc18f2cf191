"""Publication as one version, leases of tasks, .npy matrices, and cubes of counts."""

from __future__ import annotations

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import explore
from vectide.plans import jobs
from vectide.sources import npy, publish


def ids(df) -> list[int]:
    return sorted(r[0] for r in df.collect())


def test_readers_keep_their_version(spark, tmp_path) -> None:
    base = f"file://{tmp_path}/set"
    with pytest.raises(ContractError, match="nothing is published"):
        publish.read(spark, base, "a")
    first = publish.publish({"a": spark.range(3), "b": spark.range(4)}, base)
    a, b = publish.read(spark, base, "a", "b")
    rows = a.toLocalIterator()
    next(rows)  # a reader in the middle of the table
    second = publish.publish({"a": spark.range(10), "b": spark.range(20)}, base, expected=first)
    assert 1 + sum(1 for _ in rows) == 3 and ids(b) == list(range(4))
    assert [x.count() for x in publish.read(spark, base, "a", "b")] == [10, 20] and publish.version(spark, base) == second
    publish.publish({"b": spark.range(1)}, base)
    assert [x.count() for x in publish.read(spark, base, "a", "b")] == [10, 1]  # a table that isn't given stays
    with pytest.raises(ContractError, match="no table c"):
        publish.read(spark, base, "c")


def test_a_driver_lost_between_tables_changes_nothing(spark, tmp_path, monkeypatch) -> None:
    base = f"file://{tmp_path}/set"
    publish.publish({"a": spark.range(3), "b": spark.range(4)}, base)
    with pytest.raises(Exception, match="lost"):
        publish.publish({"a": spark.range(9), "b": spark.range(9).select(F.raise_error(F.lit("lost")))}, base)
    with monkeypatch.context() as m:
        m.setattr(publish, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            publish.publish({"a": spark.range(9), "b": spark.range(9)}, base)
    assert [x.count() for x in publish.read(spark, base, "a", "b")] == [3, 4]
    assert publish.clean(spark, base) == []  # not while a reader may hold them
    assert len(publish.clean(spark, base, older_than_hours=-1)) == 2
    assert [x.count() for x in publish.read(spark, base, "a", "b")] == [3, 4]


def test_inputs_that_changed(spark, tmp_path) -> None:
    base = f"file://{tmp_path}/set"
    first = publish.publish({"a": spark.range(3)}, base)
    publish.publish({"a": spark.range(4)}, base)
    with pytest.raises(ContractError, match="has changed"):
        publish.publish({"a": spark.range(5)}, base, expected=first)
    assert publish.read(spark, base, "a")[0].count() == 4 and len(os.listdir(tmp_path / "set" / "versions")) == 2


def test_leases(spark, tmp_path) -> None:
    path = str(tmp_path / "task.lease")
    a, b = jobs.Lease(spark, path, "a", stale=60, beat=0.1), jobs.Lease(spark, path, "b", stale=60)
    assert a.take() and not b.take() and b.holder()["owner"] == "a"
    assert a.take()  # again by its holder
    os.utime(path, (time.time() - 900, time.time() - 900))
    time.sleep(0.4)
    assert a.holder()["silent"] < 60 and not b.take()  # the heartbeat went on
    a._stop.set()
    a._thread.join()
    os.utime(path, (time.time() - 900, time.time() - 900))
    assert b.take() and b.holder()["owner"] == "b"  # a dead runner's task
    b.release()
    assert b.holder() is None and a.take()
    a.release()


def test_a_task_that_another_runner_holds(spark, tmp_path) -> None:
    folder = str(tmp_path / "status")
    other = jobs.Lease(spark, f"{folder}/t.lease", "other", stale=60)
    assert other.take()
    j = jobs.Jobs(spark, folder, "s", stale=60)

    def work() -> str:
        spark.range(2).write.mode("overwrite").parquet(str(tmp_path / "out"))
        assert jobs.Lease(spark, f"{folder}/t.lease", "third").take() is False
        return str(tmp_path / "out")

    with pytest.raises(ContractError, match="run by other"):
        j.run("t", {"a": 1}, work)
    other._stop.set()
    other._thread.join()
    os.utime(tmp_path / "status" / "t.lease", (time.time() - 900, time.time() - 900))
    assert j.run("t", {"a": 1}, work) == str(tmp_path / "out") and j.status("t")["state"] == "done"
    assert not (tmp_path / "status" / "t.lease").exists()

    def fails() -> str:
        raise OSError("no")

    with pytest.raises(OSError):
        j.run("u", {}, fails)
    assert j.status("u")["state"] == "failed" and not (tmp_path / "status" / "u.lease").exists()


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
def test_npy_in_ranges(spark, tmp_path, kind: str) -> None:
    m = np.random.default_rng(1).normal(size=(1003, 7)).astype(kind)
    np.save(tmp_path / "m.npy", m)
    df = npy.read_npy(spark, f"file://{tmp_path}/m.npy", range_bytes=100 * 7 * m.itemsize)
    assert df.rdd.getNumPartitions() == 11 and dict(df.dtypes)["vector"] == {"<f4": "array<float>", "<f8": "array<double>"}[kind]
    rows = df.orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(1003)) and np.array_equal(np.array([r["vector"] for r in rows], kind), m)
    meta = spark.createDataFrame([(f"k{i:04d}", i) for i in range(1003)], "name string, n long").repartition(5)
    joined = {r["n"]: r["embedding"] for r in npy.with_metadata(df, meta, "name").collect()}
    assert len(joined) == 1003 and all(np.array_equal(np.array(joined[i], kind), m[i]) for i in (0, 1, 500, 1002))
    with pytest.raises(ContractError, match="1003 rows"):
        npy.with_metadata(df, meta.limit(9), "name")


def test_npy_that_does_not_fit(spark, tmp_path) -> None:
    np.save(tmp_path / "empty.npy", np.zeros((0, 3)))
    assert npy.read_npy(spark, str(tmp_path / "empty.npy")).count() == 0
    for name, m in (("cube", np.zeros((2, 2, 2))), ("whole", np.zeros((3, 3), np.int32)), ("columns", np.asfortranarray(np.ones((4, 3))))):
        np.save(tmp_path / f"{name}.npy", m)
        with pytest.raises(ContractError, match="row order"):
            npy.header(str(tmp_path / f"{name}.npy"))
    (tmp_path / "text.npy").write_text("nothing like it")
    with pytest.raises(ContractError, match="no .npy file"):
        npy.header(str(tmp_path / "text.npy"))
    np.save(tmp_path / "short.npy", np.zeros((50, 3)))
    raw = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(raw[:-8])
    with pytest.raises(Exception, match="ends before"):
        npy.read_npy(spark, str(tmp_path / "short.npy")).count()


def test_cubes_answer_as_scans_do(spark, tmp_path) -> None:
    r = random.Random(2)
    rows = [(r.randrange(-5, 60), r.choice(["a", "b", None]), r.random()) for _ in range(800)]
    df = spark.createDataFrame(rows, "x int, name string, y double")
    bins = {"x": explore.bin_of("x", 0, 50, 10), "name": F.col("name"), "y": explore.bin_of("y", 0, 1, 4)}
    cube = explore.Cube(df, bins, f"file://{tmp_path}/cube")
    binned = df.select(*[b.alias(n) for n, b in bins.items()])
    for _ in range(6):
        low, high = sorted((r.randrange(10), r.randrange(10)))
        names = r.sample(["a", "b", None], r.randrange(0, 4))
        y = r.choice([None, 2])
        cube.brush("x", low, high).brush("name", values=names).brush("y", high=y)
        sees = {"x": F.col("x").between(low, high), "name": F.lit(False), "y": F.lit(True) if y is None else F.col("y") <= y}
        for n in names:
            sees["name"] = sees["name"] | F.col("name").eqNullSafe(F.lit(n))
        for chart in bins:
            kept = binned
            for other, p in sees.items():
                kept = kept if other == chart else kept.where(p)
            assert {(x["bin"], x["count"]) for x in cube.chart(chart).collect()} == {(x[chart], x["count"]) for x in kept.groupBy(chart).count().collect()}
        assert cube.total().first()[0] == binned.where(sees["x"] & sees["name"] & sees["y"]).count()
    with pytest.raises(KeyError):
        cube.brush("z")
    assert cube.brush("x").brush("y").brush("name").total().first()[0] == 800
    assert "cube" in str(cube.chart("x").inputFiles())
