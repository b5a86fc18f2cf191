"""Greedy maximum-determinant selection of groups of any size: rows stay partitioned, and each step needs one small matrix.

A kernel here is a_i a_j cos_ij with a diagonal of its own, so it has the rank of the vectors. After some choices the residual of a
row is ``own - a^2 u'Qu``, where Q is the sum of g g' over the choices and g = a_i (u_i - Q u_i) / sqrt(pivot) of each. No row
of the kernel and no factor column is kept, only Q, d x d numbers for each point of a sweep, however many rows there are or are chosen.

A pass over the group gives each point's rows of largest residuals, wherever they lie, and the largest residual of all others. Residuals
only fall, so the driver goes on choosing among these rows while the best of them stays above that bound; then another pass
follows. Every pass chooses one row at least. What the driver holds are the vectors of these rows and Q, of bounded size; a
pass that an executor loses is computed again from the written rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import dpp
from vectide.operators.cells import matrix
from vectide.operators.metrics import mean_offdiagonal, unit_rows, vendi
from vectide.operators.order import numbered
from vectide.sources.scratch import written

#: Bytes of vectors and matrices of all points of a pass that the driver holds, and most rows of largest residuals a point.
HELD_BYTES, MOST_ROWS = 128 << 20, 4096


class _State:
    """One point's choices so far."""

    def __init__(self, point: dpp.Point, dim: int) -> None:
        self.point, self.q = point, np.zeros((dim, dim))
        self.rows: list[int] = []
        self.gains: list[float] = []
        self.owns: list[float] = []

    def left(self, u: np.ndarray, a: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own - a * a * np.einsum("ij,ij->i", u @ self.q, u)


def _weights(point: dpp.Point, utility: np.ndarray, high: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, own diagonal) of rows; ``high`` is the largest utility of the group."""
    if point.kernel == dpp.MULTIPLICATIVE:
        a = np.exp(point.w * (utility - high))
        return a, a * a * (1 + epsilon)
    return np.full(len(utility), np.sqrt(point.w)), point.w * (1 + epsilon) + utility + epsilon


def _largest(sent, most: int, high: float, epsilon: float):
    """Of each task and point, the rows of largest residuals, and at -1 the largest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = sent.value
        held = {p: (np.zeros(0, np.int64), np.zeros(0)) for p in states}
        rest = dict.fromkeys(states, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, u, utility = batch.column("at").to_numpy(), matrix(batch.column("unit")), batch.column("utility").to_numpy()
            for p, s in states.items():
                left = s.left(u, *_weights(s.point, utility, high, epsilon))
                open_ = ~np.isin(at, s.rows)
                ats, lefts = np.concatenate([held[p][0], at[open_]]), np.concatenate([held[p][1], left[open_]])
                order = np.lexsort((ats, -lefts))
                if len(order) > most:
                    rest[p] = max(rest[p], float(lefts[order[most]]))
                held[p] = ats[order[:most]], lefts[order[:most]]
        for p, (ats, lefts) in held.items():
            ats, lefts = np.append(ats, -1), np.append(lefts, rest[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ats), p, np.int32)), pa.array(ats), pa.array(lefts)], ["point", "at", "left"])

    return run


def _earliest(sent, high: float, epsilon: float):
    """Of each task and point, the first row whose residual reaches the point's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, floors = sent.value
        best: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, u, utility = batch.column("at").to_numpy(), matrix(batch.column("unit")), batch.column("utility").to_numpy()
            for p, floor in floors.items():
                s = states[p]
                some = at[(s.left(u, *_weights(s.point, utility, high, epsilon)) >= floor) & ~np.isin(at, s.rows)]
                if len(some):
                    best[p] = min(best.get(p, int(some.min())), int(some.min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["point", "at"])

    return run


def choose(rows: DataFrame, points: list[dpp.Point], k: int, epsilon: float = dpp.EPSILON, tie: float = dpp.TIE, most: int = MOST_ROWS) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(rows in the order of choice, log gains, shares) of each point, as :func:`vectide.operators.dpp.choose` has them.

    ``rows``: at (numbers from 0), unit, utility; written, as every pass reads it.
    """
    spark = rows.sparkSession
    n, dim, high = rows.agg(F.count(F.lit(1)), F.max(F.size("unit")), F.max("utility")).first()
    if not 0 < k <= n:
        raise ContractError(f"{k} of {n} rows can't be selected")
    states = {i: _State(p, dim) for i, p in enumerate(points)}
    out: dict[int, _State] = {}
    while states:
        most_ = max(1, min(most, HELD_BYTES // (8 * dim * len(states)) - dim))
        sent = spark.sparkContext.broadcast(states)
        found = written(rows.mapInArrow(_largest(sent, most_, high, epsilon), "point int, at long, left double"), "residuals")
        rest = {r[0]: r[1] for r in found.where("at < 0").groupBy("point").agg(F.max("left")).collect()}
        w = Window.partitionBy("point").orderBy(F.desc("left"), "at")
        top = found.where("at >= 0").withColumn("p", F.row_number().over(w)).where(F.col("p") <= most_ + 1)
        lefts: dict[int, list[tuple[int, float]]] = {}
        for r in top.orderBy("point", "p").collect():
            lefts.setdefault(r["point"], []).append((r["at"], r["left"]))
        bound = {p: max([rest.get(p, -np.inf), *[x for _, x in found_[most_:]]]) for p, found_ in lefts.items()}
        floors = {p: x[0][1] - abs(x[0][1]) * tie for p, x in lefts.items()}
        first = {p: min(at for at, left in x[:most_] if left >= floors[p]) for p, x in lefts.items()}
        unsure = {p: f for p, f in floors.items() if bound[p] >= f}  # a row that was not sent may be as good and come first
        if unsure:
            earliest = rows.mapInArrow(_earliest(spark.sparkContext.broadcast((states, unsure)), high, epsilon), "point int, at long").groupBy("point").agg(F.min("at").alias("at"))
            first |= {r["point"]: r["at"] for r in earliest.collect()}
        wanted = sorted({at for x in lefts.values() for at, _ in x[:most_]} | set(first.values()))
        names = F.broadcast(spark.createDataFrame([(at,) for at in wanted], "at long"))
        vectors = rows.join(names, "at").orderBy("at").toArrow()  # at most ``most`` rows a point
        at, u, utility = vectors["at"].to_numpy(), matrix(vectors["unit"]), vectors["utility"].to_numpy()
        for p, x in lefts.items():
            s = states[p]
            mine = np.searchsorted(at, sorted({i for i, _ in x[:most_]} | {first[p]}))
            _go_on(s, at[mine], u[mine], *_weights(s.point, utility[mine], high, epsilon), first[p], bound[p], k, epsilon, tie)
            if len(s.rows) == k:
                out[p] = states.pop(p)
    every = [out[i] for i in range(len(points))]
    return [np.array(s.rows) for s in every], [np.array(s.gains) for s in every], [np.exp(s.gains) / np.array(s.owns) for s in every]


def _go_on(s: _State, at: np.ndarray, u: np.ndarray, a: np.ndarray, own: np.ndarray, first: int, bound: float, k: int, epsilon: float, tie: float) -> None:
    """Choose among rows: ``first``, then the best ones while they are above what any other row can have."""
    left, i = s.left(u, a, own), int(np.searchsorted(at, first))
    while True:
        pivot = max(left[i], epsilon)
        g = a[i] * (u[i] - s.q @ u[i]) / np.sqrt(pivot)
        s.q += np.outer(g, g)
        left -= (a * (u @ g)) ** 2
        left[i] = -np.inf
        s.rows.append(int(at[i]))
        s.gains.append(float(np.log(pivot)))
        s.owns.append(float(own[i]))
        best = left.max()
        low = best - abs(best) * tie
        if len(s.rows) == k or not low > bound:
            return
        i = int(np.argmax(left >= low))


def sweep_group(windows: DataFrame, group: int, points: list[dpp.Point], direction: str, k: int, epsilon: float = dpp.EPSILON, tie: float = dpp.TIE, most: int = MOST_ROWS) -> DataFrame:
    """The rows of :data:`vectide.operators.dpp.SWEEP` for one group of any size: row_id, embedding, recon_loss. A selection's own k x k matrix is made on the driver."""
    spark = windows.sparkSession
    if 24 * k * k > HELD_BYTES * 8:
        raise ContractError(f"metrics of {k} selected rows of group {group} exceed {HELD_BYTES * 8} bytes")
    loss = F.col("recon_loss") if direction == "top" else -F.col("recon_loss")
    low, high, n = windows.agg(F.min(loss), F.max(loss), F.count(F.lit(1))).first()
    utility = F.lit(1.0) if low == high else (loss - F.lit(low)) / F.lit(high - low)
    rows = written(numbered(unit_rows(windows).select("row_id", "unit", "recon_loss", utility.alias("utility")), "row_id", name="at"), "greedy")
    chosen, gains, shares = choose(rows.select("at", "unit", "utility"), points, k, epsilon, tie, most)
    out = []
    for p, r, gain, share in zip(points, chosen, gains, shares, strict=True):
        names = F.broadcast(spark.createDataFrame([(int(i), j) for j, i in enumerate(r)], "at long, place int"))
        picked = rows.join(names, "at").orderBy("place").toArrow()  # the k rows of one selection
        u, each = matrix(picked["unit"]), picked["utility"].to_numpy()
        cosines = u @ u.T + epsilon * np.eye(k)
        a, own = _weights(p, each, 1.0, epsilon)
        sign, log_det = np.linalg.slogdet(a[:, None] * a[None] * cosines + np.diag(own - a * a * (1 + epsilon) + epsilon))
        if sign <= 0 or not np.isfinite(log_det):
            raise ContractError("the determinant of a selection isn't positive")
        ranks, poor = dpp.operational(share, epsilon)
        out.append((group, p.kernel, p.w, n, k, float(log_det), vendi(cosines), mean_offdiagonal(cosines), int(ranks), int(poor), bool(k > ranks), r.tolist(), picked["row_id"].to_pylist(), gain.tolist(), each.tolist(), picked["recon_loss"].to_pylist()))
    return spark.createDataFrame(out, dpp.SWEEP)
