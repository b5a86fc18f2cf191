"""Diverse subsets: greedy maximum-determinant selection over sweeps of kernels and weights.

A group's rows go to one task, which steps through all points of a sweep side by side; one row for each point holds its metrics and
its members. A kernel has the rank of the vectors, so a d x d matrix a point stands for all factor columns, and no matrix of pairs of rows
is made: what a task holds grows with the rows. Groups whose workspace exceeds a budget are left partitioned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators.cells import matrix
from vectide.operators.metrics import entropy_rank, mean_offdiagonal, vendi

#: Defaults: diagonal jitter, relative width of near ties, pivot shares below which a step adds nothing.
EPSILON, TIE, OPERATIONAL, DEGENERATE = 1e-6, 1e-9, 1e-4, 10.0
MULTIPLICATIVE, ADDITIVE = "multiplicative", "additive"


@dataclass(frozen=True)
class Point:
    """One point of a sweep."""

    kernel: str
    w: float


def sweep(kernels: dict[str, Iterable[float]]) -> list[Point]:
    out = [Point(k, float(w)) for k, ws in kernels.items() for w in ws]
    for p in out:
        if p.kernel not in (MULTIPLICATIVE, ADDITIVE):
            raise ContractError(f"unknown kernel {p.kernel}")
    return out


def workspace_bytes(rows: Column | int, k: Column | int, dim: int = 512):
    """Vectors twice in 32 bits, three square matrices of the rows, two of the selection."""
    return rows * (dim * 8) + rows * rows * 24 + k * k * 16


def held_bytes(rows: Column | int, k: Column | int, dim: int, points: int):
    """What a task of a sweep holds of a group: vectors as they come, in order and as units, ids and losses, and the members of each point."""
    return rows * (dim * 40 + 300) + k * (points * 200)


def units(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)
    if not np.isfinite(size).all() or (size <= 0).any():
        raise ContractError("a vector has length zero or is not finite")
    return vectors / size[:, None]


def gram(vectors: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Cosines, with epsilon added to the diagonal."""
    u = units(vectors)
    s = u @ u.T
    return (s + s.T) / 2 + epsilon * np.eye(len(u))


def weighted(points: list[Point], utility: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(a, d) of each point: its kernel is a_i a_j cos_ij, and d_i more on the diagonal."""
    w = np.array([p.w for p in points])[:, None]
    multiplicative = np.array([p.kernel == MULTIPLICATIVE for p in points])[:, None]
    a = np.where(multiplicative, np.exp(np.where(multiplicative, w * (utility - utility.max())[None], 0.0)), np.sqrt(w))
    return a, np.where(multiplicative, 0.0, utility[None] + epsilon)


@dataclass(frozen=True)
class Chosen:
    """What each point of a sweep chose: (points, k) arrays, and a number for each point."""

    rows: np.ndarray  #: rows in the order of choice
    gains: np.ndarray  #: log gains
    shares: np.ndarray  #: gains as shares of the chosen rows' own diagonals
    log_det: np.ndarray


def choose(cosines: np.ndarray, utility: np.ndarray, points: list[Point], k: int, epsilon: float = EPSILON, tie: float = TIE) -> Chosen:
    """Greedy choice for all points at once: each step takes every point's largest residual, ties to the earlier row."""
    n, many = len(cosines), len(points)
    if not 0 < k <= n:
        raise ContractError(f"{k} of {n} rows can't be selected")
    a, d = weighted(points, utility, epsilon)
    own = a * a * np.diagonal(cosines)[None] + d
    left, each = own.copy(), np.arange(many)
    factors = np.zeros((many, k, n))
    rows, gains = np.empty((many, k), np.int64), np.empty((many, k))
    for step in range(k):
        best = left.max(1, keepdims=True)
        i = np.argmax(left >= best - np.abs(best) * tie, axis=1)
        pivot = np.maximum(left[each, i], epsilon)
        row = a[each, i][:, None] * a * cosines[i]
        row[each, i] += d[each, i]
        row -= np.matmul(factors[each, :step, i][:, None, :], factors[:, :step])[:, 0]
        row /= np.sqrt(pivot)[:, None]
        factors[:, step] = row
        left -= row * row
        left[each, i] = -np.inf  # taken
        rows[:, step], gains[:, step] = i, np.log(pivot)
    at = each[:, None]
    part = a[at, rows][:, :, None] * a[at, rows][:, None, :] * cosines[rows[:, :, None], rows[:, None, :]]
    part[:, np.arange(k), np.arange(k)] += d[at, rows] + epsilon
    sign, log_det = np.linalg.slogdet(part)
    if (sign <= 0).any() or not np.isfinite(log_det).all():
        raise ContractError("the determinant of a selection isn't positive")
    return Chosen(rows, gains, np.exp(gains) / own[at, rows], log_det)


def choose_units(u: np.ndarray, utility: np.ndarray, points: list[Point], k: int, epsilon: float = EPSILON, tie: float = TIE) -> Chosen:
    """What :func:`choose` makes of the cosines of unit vectors ``u``, without them.

    After some choices the residual kernel of two rows i, j is a_i a_j u_i' R u_j with R = I - sum g g' over the choices, so a step
    needs R, a d x d matrix of each point, and one product with the vectors.
    """
    n, dim, many = *u.shape, len(points)
    if not 0 < k <= n:
        raise ContractError(f"{k} of {n} rows can't be selected")
    a, d = weighted(points, utility, epsilon)
    left, each = a * a * (1 + epsilon) + d, np.arange(many)
    rest = np.repeat(np.eye(dim)[None], many, 0)
    rows, gains = np.empty((many, k), np.int64), np.empty((many, k))
    for step in range(k):
        best = left.max(1, keepdims=True)
        i = np.argmax(left >= best - np.abs(best) * tie, axis=1)
        pivot = np.maximum(left[each, i], epsilon)
        g = np.matmul(rest, u[i][:, :, None])[:, :, 0] * (a[each, i] / np.sqrt(pivot))[:, None]
        rest -= g[:, :, None] * g[:, None, :]
        row = g @ u.T
        row *= a
        row *= row
        left -= row
        left[each, i] = -np.inf  # taken
        rows[:, step], gains[:, step] = i, np.log(pivot)
    at = each[:, None]
    a, d = a[at, rows], d[at, rows]
    log_det = np.array([_log_det(u[r], x, x * x * epsilon + y + epsilon) for r, x, y in zip(rows, a, d, strict=True)])
    return Chosen(rows, gains, np.exp(gains) / (a * a * (1 + epsilon) + d), log_det)


def _log_det(u: np.ndarray, a: np.ndarray, own: np.ndarray) -> float:
    """Of a_i a_j cos_ij with ``own`` more on the diagonal, by a matrix of the rows or of the dimensions, whichever is smaller."""
    v = a[:, None] * u
    few = len(v) <= v.shape[1]
    sign, value = np.linalg.slogdet(v @ v.T + np.diag(own) if few else np.eye(v.shape[1]) + v.T @ (v / own[:, None]))
    if sign <= 0 or not np.isfinite(value):
        raise ContractError("the determinant of a selection isn't positive")
    return float(value if few else value + np.log(own).sum())


def diversity(u: np.ndarray, epsilon: float = EPSILON) -> tuple[float, float]:
    """(Vendi score, mean cosine) of unit vectors whose cosines have epsilon added to the diagonal; more rows than dimensions by their dual."""
    n, dim = u.shape
    if n <= dim:
        cosines = u @ u.T
        cosines = (cosines + cosines.T) / 2 + epsilon * np.eye(n)
        return vendi(cosines), mean_offdiagonal(cosines)
    values = np.concatenate([np.clip(np.linalg.eigvalsh(u.T @ u), 0, None) + epsilon, np.full(n - dim, epsilon)])
    total = u.sum(0)
    return min(float(n), max(1.0, entropy_rank(values))), float((total @ total - (u * u).sum()) / (n * (n - 1)))


def operational(shares: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Of each point: (steps whose share is above OPERATIONAL, steps within DEGENERATE * epsilon)."""
    return (shares > OPERATIONAL).sum(-1), (shares <= DEGENERATE * epsilon).sum(-1)


_METRICS = "group_id long, kernel string, w double, candidates long, k long, log_det double, vendi double, mean_cosine double, operational_rank int, n_degenerate int, rank_limited boolean"
SWEEP = f"{_METRICS}, positions array<int>, row_ids array<string>, gains array<double>, utilities array<double>, losses array<double>"


def _utility(loss: np.ndarray, direction: str) -> np.ndarray:
    v = loss if direction == "top" else -loss
    low, high = v.min(), v.max()
    return np.ones(len(v)) if low == high else (v - low) / (high - low)


def _sweep(points: list[Point], direction: str, epsilon: float, tie: float, batch_bytes: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_id")
        ids, loss = part["row_id"], part["recon_loss"].to_numpy().astype(np.float64)
        utility, u = _utility(loss, direction), units(matrix(part["embedding"]))
        k, (n, dim), group = int(part["k"][0].as_py()), u.shape, part["group_id"][0].as_py()
        del part
        out = []
        step = max(1, batch_bytes // (8 * (6 * n + 3 * dim * dim)))  # points whose residuals and matrices fit
        for begin in range(0, len(points), step):
            some = points[begin : begin + step]
            got = choose_units(u, utility, some, k, epsilon, tie)
            ranks, poor = operational(got.shares, epsilon)
            for j, p in enumerate(some):
                r = got.rows[j]
                score, mean = diversity(u[r], epsilon)
                out.append({
                    "group_id": group, "kernel": p.kernel, "w": p.w, "candidates": n, "k": k, "log_det": float(got.log_det[j]), "vendi": score, "mean_cosine": mean,
                    "operational_rank": int(ranks[j]), "n_degenerate": int(poor[j]), "rank_limited": bool(k > ranks[j]), "positions": r.tolist(), "row_ids": ids.take(pa.array(r)).to_pylist(),
                    "gains": got.gains[j].tolist(), "utilities": utility[r].tolist(), "losses": loss[r].tolist(),
                })
        return pa.Table.from_pylist(out, schema=_SWEEP_ARROW)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
_SWEEP_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split(" ") for f in SWEEP.split(", "))])
#: Bytes of residuals that a task holds at once, and of a group in one task where no other limit is given.
BATCH_BYTES, TASK_BYTES = 64 << 20, 512 << 20


def split(windows: DataFrame, group: str, eta: float, allocation: DataFrame | None = None, max_workspace_gib: float | None = 8.0, dim: int = 512, points: int = 1) -> tuple[DataFrame, list]:
    """(group_id, row_id, embedding, recon_loss, k; the groups beyond the workspace of a task, as rows of group_id and k).

    The workspace is :func:`workspace_bytes`, the estimate that configurations state a limit for; without one (None) it is what a task holds.
    """
    from vectide.operators.allocate import proportional

    sizes = windows.groupBy(F.col(group).cast("long").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    given = (proportional(sizes, eta) if allocation is None else allocation).select("group_id", "n", "k")
    if max_workspace_gib is None:
        dim = windows.agg(F.max(F.size("embedding"))).first()[0] or 1
        beyond = held_bytes(F.col("n"), F.col("k"), dim, points) > F.lit(TASK_BYTES)
    else:
        beyond = workspace_bytes(F.col("n"), F.col("k"), dim) > F.lit(max_workspace_gib * 2**30)
    large = given.where(beyond).select("group_id", "k").orderBy("group_id").collect()
    rows = windows.select(F.col(group).cast("long").alias("group_id"), F.col("window_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("recon_loss").cast("double").alias("recon_loss"))
    return rows.join(given.select("group_id", "k"), "group_id"), large


def prepare(windows: DataFrame, group: str, eta: float, allocation: DataFrame | None = None, max_workspace_gib: float = 8.0, dim: int = 512) -> DataFrame:
    """group_id, row_id, embedding, recon_loss, k; refuses groups beyond the workspace."""
    rows, large = split(windows, group, eta, allocation, max_workspace_gib, dim)
    if large:
        raise ContractError(f"workspace of group {large[0]['group_id']} exceeds {max_workspace_gib} GiB")
    return rows


def sweep_runs(windows: DataFrame, group: str, points: list[Point], direction: str, eta: float, epsilon: float = EPSILON, allocation: DataFrame | None = None, pool: DataFrame | None = None, tie: float = TIE, max_workspace_gib: float | None = None, refuse: bool = False) -> DataFrame:
    """One row for each group and point: metrics, and its members as arrays in the order of choice. One grouped map makes both.

    Groups beyond the workspace of a task stay partitioned and are chosen from by :mod:`vectide.operators.greedy`, one after another;
    with ``refuse`` they end the run instead, if a limit is given.
    ``pool`` (window_id) limits the candidates; ``allocation`` (group_id, n, k) says how many rows each group keeps, and which groups take part.
    """
    if pool is not None:
        windows = windows.join(pool.select("window_id"), "window_id", "left_semi")
    rows, large = (prepare(windows, group, eta, allocation, max_workspace_gib), []) if refuse and max_workspace_gib is not None else split(windows, group, eta, allocation, max_workspace_gib, points=len(points))
    if not large:
        return rows.groupBy("group_id").applyInArrow(_sweep(points, direction, epsilon, tie, BATCH_BYTES), SWEEP)
    from vectide.operators import greedy

    out = rows.where(~F.col("group_id").isin([r["group_id"] for r in large])).groupBy("group_id").applyInArrow(_sweep(points, direction, epsilon, tie, BATCH_BYTES), SWEEP)
    for r in large:
        out = out.unionAll(greedy.sweep_group(rows.where(F.col("group_id") == r["group_id"]).drop("k", "group_id"), r["group_id"], points, direction, r["k"], epsilon, tie))
    return out


def members_of(runs: DataFrame) -> DataFrame:
    """Memberships of such rows: one for each selected window, with its rank from 0."""
    x = F.posexplode(F.arrays_zip("row_ids", "gains", "utilities", "losses")).alias("rank", "x")
    return runs.select("group_id", "kernel", "w", x).select("group_id", "kernel", "w", F.col("x.row_ids").alias("row_id"), "rank", F.col("x.gains").alias("gain"), F.col("x.utilities").alias("utility"), F.col("x.losses").alias("recon_loss"))


def metrics_of(runs: DataFrame) -> DataFrame:
    return runs.select(*[f.split(" ")[0] for f in _METRICS.split(", ")])


def select(*args, **kwargs) -> DataFrame:
    """Memberships of a sweep: :func:`sweep_runs`, then :func:`members_of`."""
    return members_of(sweep_runs(*args, **kwargs))


def run_metrics(*args, **kwargs) -> DataFrame:
    """Metrics of a sweep: :func:`sweep_runs`, then :func:`metrics_of`."""
    return metrics_of(sweep_runs(*args, **kwargs))
