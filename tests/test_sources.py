"""Readers, sinks, jobs, contracts, streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.functions import text
from vectide.operators import explore, overlay, validate
from vectide.plans import artifacts, jobs, views
from vectide.schema import RUNS, SELECTIONS, conform
from vectide.sources import readers, scratch, sinks
from vectide.streaming import batches


def test_read_table_names_what_is_wrong(spark, tmp_path) -> None:
    with pytest.raises(ContractError):
        readers.read_table(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ContractError):
        readers.read_table(spark, str(tmp_path / "empty"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ContractError):
        readers.read_table(spark, str(tmp_path / "a.txt"))
    sinks.write_table(spark.range(3), str(tmp_path / "t.parquet"))
    assert readers.read_table(spark, str(tmp_path / "t.parquet"), ["id"]).count() == 3
    with pytest.raises(ContractError):
        readers.read_table(spark, str(tmp_path / "t.parquet"), ["other"])


@pytest.mark.parametrize("rows", [137, 64, 33, 2000])
def test_synthetic_windows(spark, rows: int) -> None:
    df = readers.synthetic_windows(spark, rows)
    assert df.count() == rows and df.select("window_id").distinct().count() == rows
    assert df.where("recon_loss < 0.001").count() == 0
    assert df.exceptAll(readers.synthetic_windows(spark, rows)).count() == 0
    with pytest.raises(ContractError):
        readers.synthetic_windows(spark, 0)


@pytest.mark.parametrize("lines,bad", [(["a", "b", "c"], None), (["a", "a"], "unsorted"), (["b", "a"], "unsorted"), (["a", " b"], "spaced")])
def test_manifest(spark, tmp_path, lines: list[str], bad: str | None) -> None:
    p = tmp_path / "m.txt"
    p.write_text("\n".join(lines) + "\n")
    if bad:
        with pytest.raises(ContractError, match=bad):
            readers.read_manifest(spark, str(p))
    else:
        assert readers.read_manifest(spark, str(p), len(lines)).count() == len(lines)
        with pytest.raises(ContractError):
            readers.read_manifest(spark, str(p), 99)


def test_report_checks_quota_and_checksum() -> None:
    manifest = b"a\nb\n"
    report = {"source_rows": 5, "manifest_rows": 2, "manifest_sha256": hashlib.sha256(manifest).hexdigest(), "config": {"group_size": 2, "keep_per_group": 1}}
    assert readers.read_report(json.dumps(report), manifest)["manifest_rows"] == 2
    for change in ({"manifest_rows": 3}, {"manifest_sha256": "0" * 64}):
        with pytest.raises(ContractError):
            readers.read_report(json.dumps(report | change), manifest)


def ids(spark, *names: str):
    return spark.createDataFrame([(n,) for n in names], "row_id string")


def test_clustered_import(spark) -> None:
    atlas, display = ids(spark, *"abcde"), ids(spark, *"abc")
    assert [r[0] for r in artifacts.import_clustered(ids(spark, "a", "d"), atlas, display).collect()] == ["a"]
    assert artifacts.import_clustered(ids(spark, "d", "e"), atlas, display).count() == 0
    for manifest, a, d in ((ids(spark, "x"), atlas, display), (ids(spark, "a"), ids(spark, "a", "a", "b", "c"), display), (ids(spark, "a"), atlas, ids(spark, "a", "a")), (ids(spark, "a"), atlas, ids(spark, "z"))):
        with pytest.raises(ContractError):
            artifacts.import_clustered(manifest, a, d)


def test_writers(spark, tmp_path) -> None:
    sinks.write_tables({str(tmp_path / "a"): spark.range(2), str(tmp_path / "b"): spark.range(3)})
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2 and spark.read.parquet(str(tmp_path / "b")).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_table(spark.range(1), str(tmp_path / "a"), overwrite=False)
    for kind in ("csv", "json", "jsonl", "parquet"):
        sinks.export(spark.range(5), str(tmp_path / kind), kind, F.col("id") > 2)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ContractError):
        sinks.export(spark.range(1), str(tmp_path / "x"), "xml")
    assert sinks.merge_manifest(spark, str(tmp_path / "m.json"), {"a": 1}) == {"a": 1}
    assert sinks.merge_manifest(spark, str(tmp_path / "m.json"), {"b": 2}) == {"a": 1, "b": 2}


def test_jobs_resume(spark, tmp_path) -> None:
    runs = []

    def work() -> str:
        runs.append(1)
        return sinks.write_table(spark.range(3), str(tmp_path / "out"))

    j = jobs.Jobs(spark, str(tmp_path / "status"), "source-a")
    for _ in range(2):
        j.run("t", {"eta": 0.1}, work)
    assert len(runs) == 1
    j.run("t", {"eta": 0.2}, work)
    assert len(runs) == 2
    with pytest.raises(ZeroDivisionError):
        j.run("u", {}, lambda: str(1 / 0))
    assert j.status("u")["state"] == "failed"


def test_configurations() -> None:
    assert len(jobs.sweep_config()["tasks"]) == 6
    assert jobs.load_config('{"a": 1}') == {"a": 1}
    with pytest.raises(ContractError):
        jobs.load_config("[1]")
    assert jobs.run_id("a", {"x": 1}) == jobs.run_id("a", {"x": 1}) != jobs.run_id("b", {"x": 1})


def test_source_contract(spark) -> None:
    schema = "window_id string, big_recording_index long, session_index long, offset long, recon_loss double, embedding array<double>"
    good = [("1_-_0_-_5", 1, 0, 5, 0.5, [1.0, 0.0])]
    assert validate.require_source(spark.createDataFrame(good, schema), 2).count() == 1
    for bad in ([("1_-_0_-_6", 1, 0, 5, 0.5, [1.0, 0.0])], good * 2, [("1_-_0_-_5", 1, 0, 5, float("nan"), [1.0, 0.0])], [("1_-_0_-_5", 1, 0, 5, 0.5, [1.0])], []):
        with pytest.raises(ContractError):
            validate.require_source(spark.createDataFrame(bad, schema), 2)
    odd = spark.createDataFrame([("name", 1, 0, 5, 0.5, [1.0, 0.0]), ("1_-_0_-_6", 1, 0, 5, 0.5, [1.0, 0.0])], schema)
    assert validate.require_source(odd, 2).count() == 2  # one id that doesn't parse ends the comparison


def test_conform(spark) -> None:
    out = conform(spark.createDataFrame([("a", 1)], "run_id string, extra int"), SELECTIONS)
    assert out.schema.fieldNames() == SELECTIONS.fieldNames() and out.first()["rank"] is None
    assert conform(out, RUNS).columns == RUNS.fieldNames()


def test_metadata_contract(spark) -> None:
    rows = spark.createDataFrame([(1, "a")], "big_recording_index long, dataset string")
    assert readers.require_metadata(rows).count() == 1
    for bad in (rows.union(rows), spark.createDataFrame([(1, None)], "big_recording_index long, dataset string")):
        with pytest.raises(ContractError):
            readers.require_metadata(bad)
    with pytest.raises(ContractError):
        validate.require_joined(spark.createDataFrame([(2,)], "big_recording_index long"), rows, "big_recording_index")


def test_masks_have_a_limit(spark) -> None:
    with pytest.raises(ContractError):
        overlay.masks(spark.range(1), {"k": list(range(33))}, ["top"], [0.1])


def test_views() -> None:
    assert views.clamp_group(-3, 5) == 0 and views.clamp_group(9, 5) == 4
    assert views.step_group(None, 1, 5) == 0 and views.step_group(4, 1, 5) == 0 and views.step_group(0, -1, 5) == 4


def test_cross_filter(spark) -> None:
    f = explore.CrossFilter(spark.range(10)).set("a", F.col("id") > 3).set("b", F.col("id") < 6).set("c", None)
    assert f.rows().count() == 2 and f.rows(but="a").count() == 6


def test_streams(spark, tmp_path) -> None:
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).withColumn("v", F.lit(1.0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batches.append_batches(batches.stream_table(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    batches.append_batches(batches.stream_table(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_names_and_literals_survive_any_text(spark) -> None:
    for value in ("plain", "", "it's", "a\\", "\\'", "line\nend\ttab", "`; DROP TABLE x; --", "%_\\%", "é 漢 \U0001f600", "${spark}", "{x}"):
        assert spark.sql(f"SELECT {text.literal(value)} AS v").first()["v"] == value
        if value and "${" not in value:
            out = spark.range(1).withColumnRenamed("id", value)
            assert out.selectExpr(text.quoted(value)).columns == [value]
    for value in (0, -1, 2**63 - 1, -(2**63), 0.1, -0.0, 1e308, 5e-324, float("inf"), True, False, None):
        got = spark.sql(f"SELECT {text.literal(value)} AS v").first()["v"]
        assert got == value and isinstance(got, type(value))
    assert spark.sql(f"SELECT {text.literal(float('nan'))} AS v").first()["v"] != 0
    with pytest.raises(ValueError):
        text.literal(2**63)
    for name in ("", "${spark}"):
        with pytest.raises(ValueError):
            text.quoted(name)


def test_view_names_differ_where_names_do(spark) -> None:
    names = ["My Table", "my table", "my-table", "1", "", "é", "x" * 300, "x" * 301]
    made = [text.view_name(n) for n in names]
    assert len(set(made)) == len(names)
    for view in made:
        spark.range(1).createOrReplaceTempView(view)
        assert spark.sql(f"SELECT * FROM {view}").count() == 1
        spark.catalog.dropTempView(view)


def test_scratch_tables_go_with_their_scope(spark) -> None:
    import threading
    from pathlib import Path
    from urllib.parse import urlparse

    there = lambda df: Path(urlparse(df.inputFiles()[0]).path).parent.is_dir()
    kept = scratch.written(spark.range(3), "kept")
    beside: list = []
    with scratch.scope(spark) as outer:
        first = scratch.written(spark.range(4), "first")
        with pytest.raises(RuntimeError), scratch.scope(spark):
            second = scratch.written(spark.range(5), "second")
            folder = Path(urlparse(second.inputFiles()[0]).path).parent
            raise RuntimeError
        assert not folder.exists() and there(first) and len(outer) == 1
        other = threading.Thread(target=lambda: beside.append(scratch.written(spark.range(6), "beside")))
        other.start()
        other.join()
        files = Path(urlparse(first.inputFiles()[0]).path).parent
    assert not files.exists() and there(kept) and there(beside[0])
    assert kept.count() == 3 and beside[0].count() == 6
