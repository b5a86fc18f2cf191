"""Order statistics by digits against sorting."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.operators import metrics, quantiles, ranking

WANTED = {"p0": ("v", 0.0, "linear"), "p5": ("v", 0.05, "linear"), "mid": ("v", 0.5, "linear"), "q25": ("v", 0.25, "lower"), "q75": ("v", 0.75, "lower"), "p100": ("v", 1.0, "linear")}


def brute(values: list[float]) -> dict[str, float | None]:
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    out = {}
    for name, (_, q, how) in WANTED.items():
        if not v:
            out[name] = None
            continue
        p = q * (len(v) - 1)
        a, b = v[math.floor(p)], v[math.ceil(p)]
        same = math.floor(p) == math.ceil(p) or a == b or how == "lower"
        out[name] = a if same else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
    return out


def check(spark, rows: list[tuple], held: int) -> None:
    df = spark.createDataFrame(rows, "g int, h string, v double").repartition(3)
    got = {(r["g"], r["h"]): r for r in quantiles.summarise(df, ["g", "h"], [F.count(F.lit(1)).alias("n")], WANTED, held).collect()}
    groups: dict = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, want in brute(values).items():
            have = got[k][name]
            if want is None:
                assert have is None
            elif math.isnan(want):
                assert math.isnan(have)
            else:
                assert have == pytest.approx(want, rel=1e-12, abs=0.0), (k, name)


@pytest.mark.parametrize("held", [3, 40, 10_000])
def test_large_groups_equal_sorted_ones(spark, held):
    rng = np.random.default_rng(3)
    rows = [(1, "a", float(x)) for x in rng.normal(size=700)]
    rows += [(1, None, float(x)) for x in rng.integers(0, 4, 300)]
    rows += [(None, None, float(x)) for x in np.exp(rng.normal(0, 200, 300))]
    rows += [(2, "b", 1.0 + i * 2.0**-52) for i in range(200)] + [(2, "b", None)] * 50
    rows += [(3, "c", x) for x in (math.inf, -math.inf, math.nan, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308) * 9]
    rows += [(4, "d", None)] * 60 + [(5, "e", 7.5)] * 100 + [(6, "f", 2.0), (6, "f", 4.0)]
    check(spark, rows, held)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.floats(allow_nan=False, allow_infinity=False, width=64)), min_size=1, max_size=40))
def test_any_doubles(spark, rows):
    check(spark, [(g, "x", v / 4) for g, v in rows], 2)


def test_first_digit_never_falls(spark):
    rng = np.random.default_rng(5)
    near = np.concatenate([np.nextafter(2.0 ** rng.integers(-1022, 1022, 400), d) for d in (0, np.inf)] + [2.0 ** (rng.integers(-60000, 60000, 2000) / 64)])
    v = sorted({float(x) for x in np.concatenate([near, -near, rng.normal(size=2000), [0.0, 5e-324, -5e-324, math.inf, -math.inf]])})
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", quantiles.first_digit(F.col("v")).alias("d")).orderBy("v")
    digits = [r["d"] for r in df.collect()]
    assert digits == sorted(digits) and max(digits) == quantiles.INFINITE


def test_empty_table_and_missing_keys(spark):
    df = spark.createDataFrame([], "g int, h string, v double")
    out = quantiles.summarise(df, ["g", "h"], [], WANTED)
    assert out.count() == 0 and out.columns == ["g", "h", *WANTED]
    with pytest.raises(ValueError):
        quantiles.summarise(df, [], [], WANTED)


def test_no_plan_gathers_a_large_group(spark):
    """Beyond ``held`` rows no aggregate of the hot group's branch keeps its values."""
    df = spark.range(3000).select((F.col("id") * 0 + 1).alias("g"), F.sin("id").alias("v"))
    found = quantiles._searched(df.select(F.col("g").alias("__group"), "v"), {"m": (0.5, "linear")}, 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    assert found.first()["m"] == pytest.approx(float(np.median(np.sin(np.arange(3000)))))


def test_summaries_are_the_same_by_either_way(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(v), float(u)) for g, v, u in zip(rng.integers(0, 3, 500), rng.normal(size=500), rng.random(500), strict=True)]
    df = spark.createDataFrame(rows, "g int, recon_loss double, utility double")
    named = df.withColumnsRenamed({"recon_loss": "loss", "utility": "actual_size"})
    plain = [sorted(map(tuple, x.collect())) for x in (ranking.loss_summary(df, ["g"]), metrics.curve_summary(named, ["g"], ["loss"]))]
    monkeypatch.setattr(quantiles, "HELD", 20)
    searched = [sorted(map(tuple, x.collect())) for x in (ranking.loss_summary(df, ["g"]), metrics.curve_summary(named, ["g"], ["loss"]))]
    for a, b in zip(plain, searched, strict=True):
        assert np.allclose(np.array(a, float), np.array(b, float), rtol=1e-12)
