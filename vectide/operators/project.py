"""Two-dimensional projections: a fit on a seeded sample of bounded size, and its extension to all rows by their nearest fitted rows.

A fit takes (at, unit) of the sample and a seed, and gives (at, x, y). ``pca`` needs sums over the rows, d x d numbers, and no row leaves
its task. ``umap`` moves points from there along the sample's fuzzy neighbour graph, ``tsne`` until neighbour chances match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import layout
from vectide.operators.cells import matrix
from vectide.operators.knn import interpolate
from vectide.operators.metrics import unit_rows
from vectide.operators.order import numbered
from vectide.sources.scratch import written

Fit = Callable[[DataFrame, int], DataFrame]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: number, sum and sum of outer products of its rows."""
    n, total, square = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("unit"))
            n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], ["n", "total", "square"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, 0.0, 0.0
    for batch in batches:
        for m, t, s in zip(batch.column("n").to_pylist(), batch.column("total"), batch.column("square"), strict=True):
            n, total, square = n + m, total + np.frombuffer(t.as_buffer(), np.float64), square + np.frombuffer(s.as_buffer(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], ["n", "total", "square"])


def principal_axes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, first two principal axes, signs fixed by the largest loading) from sums of tasks."""
    kinds = "n long, total binary, square binary"
    found = rows.select("unit").mapInArrow(_moments, kinds).groupBy().applyInArrow(_summed, kinds).first()
    mean = np.frombuffer(found["total"], np.float64) / found["n"]
    spread = np.frombuffer(found["square"], np.float64).reshape(len(mean), -1) / found["n"] - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :2].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes


def pca(rows: DataFrame, seed: int) -> DataFrame:
    """The first two principal components, scaled to 10."""
    mean, axes = principal_axes(rows)
    sent = rows.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = sent.value
        for batch in batches:
            if batch.num_rows:
                at = (matrix(batch.column("unit")) - mean) @ axes.T
                at = np.pad(at, ((0, 0), (0, 2 - at.shape[1])))
                yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(at[:, 0]), pa.array(at[:, 1])], ["at", "x", "y"])

    flat = written(rows.select("at", "unit").mapInArrow(run, "at long, x double, y double"), "components")
    most = flat.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 0.0
    return flat.select("at", *[(F.col(c) / F.lit(max(most, 1e-12)) * 10).alias(c) for c in ("x", "y")])


def umap(rows: DataFrame, seed: int) -> DataFrame:
    return layout.placed(pca(rows, seed), layout.fuzzy_graph(rows), "umap", seed)


def tsne(rows: DataFrame, seed: int) -> DataFrame:
    """In one task up to SAMPLE rows, else in steps over all blocks of rows."""
    start, graph = pca(rows, seed), layout.chance_graph(rows)
    return layout.placed(start, graph, "tsne", seed) if rows.count() <= SAMPLE else layout.matched(start, graph, seed)


#: Rows of a sample where none is stated, and of a layout in one task.
SAMPLE = 20_000
FITS: dict[str, Fit] = {"pca": pca, "umap": umap, "tsne": tsne}
#: Fits that know no rows outside their sample: where none is stated, it is the table.
NEEDS_ALL = {"tsne"}


def register_fit(name: str, fit: Fit) -> None:
    FITS[name] = fit


def fit_sample(df: DataFrame, sample: int, seed: int, key: str = "window_id") -> DataFrame:
    """A bounded sample: the ``sample`` rows of smallest seeded hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary")), key).limit(sample)


def project(df: DataFrame, method: str = "pca", sample: int | None = None, seed: int = 7, key: str = "window_id", k: int = 8, temperature: float = 12.0) -> DataFrame:
    """(key, projection_x, projection_y) of all rows: the fit's own coordinates for its sample, neighbours' for the rest.

    ``sample``: SAMPLE rows if none are stated, all rows for a fit that needs them.
    """
    if method not in FITS:
        raise ContractError(f"no fit named {method}")
    if method in NEEDS_ALL and sample is not None and df.count() > sample:
        raise ContractError(f"{method} needs all rows in its fit")
    chosen = df if method in NEEDS_ALL else fit_sample(df, SAMPLE if sample is None else sample, seed, key)
    drawn = written(numbered(unit_rows(chosen).select(key, "unit"), key, name="at"), "fit")
    at = FITS[method](drawn.select("at", "unit"), seed)
    fitted = written(drawn.join(at, "at").select(key, F.col("unit").alias("embedding"), F.col("x").alias("projection_x"), F.col("y").alias("projection_y")), "fitted")
    rest = df.select(key, "embedding").join(fitted.select(key), key, "left_anti")
    return interpolate(rest, fitted, key, "embedding", "projection_x", "projection_y", k, temperature)
