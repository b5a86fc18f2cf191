"""Rows near other rows, by cosine or distance.

A side of at most FEW rows and FEW_BYTES is sent to all tasks, and the other one streams past it: with few targets every query has its
result at once and nothing shuffles; with few queries each task keeps its best and a grouped reduction merges them. Two
large sides meet through the index of :mod:`vectide.operators.cells`, chunk by tile, without a vector on the driver but its
pivots; where they can leave out few tiles, blocks of both are read side by side without a shuffle. The way taken changes no result. Rows of different parts (``part``) never meet. In the plane, blocks of
neighbouring points meet only blocks in reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.operators import cells
from vectide.operators.cells import Side, apart, distance, matrix, side, unit
from vectide.operators.graph import _labels, thinned
from vectide.sources.scratch import written

__all__ = ["Best", "best_score", "coverage", "interpolate", "least_within", "links", "matrix", "nearest", "plane_nearest", "unit"]

#: Rows and bytes of a side that goes to all tasks, entries of a score matrix, rows of targets at once, and rows of a block of the plane.
FEW, FEW_BYTES, SCORES, ROWS, BLOCK = 8192, 64 << 20, 1 << 22, 4096, 1024
#: Rows of targets that a task gathers for one pass of few queries.
GATHERED = 1 << 16
#: Pairs whose cosines are made one by one at once, and found pairs that wait for a place among the best.
PAIRS, WAITING = 1 << 15, 1 << 20
#: Pairs for each place among the best up to which screened pairs are scored one by one; rows that stand for a group of queries, and targets that are looked at first.
FULL, STAND, FIRST = 8, 16, 16

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _side_of(df: DataFrame, key: str, vector: str, part: str | None, floor: str | None = None, value: str | None = None) -> DataFrame:
    """id, v, part, floor, value: what either side of a join is made of."""
    return df.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(part) if part else F.lit(0)).cast("long").alias("part"),
        (F.col(floor) if floor else F.lit(0.0)).cast("double").alias("floor"), (F.col(value) if value else F.lit(0)).cast("long").alias("value"),
    )


def _few(rows: DataFrame) -> pa.Table | None:
    """All rows, if they are few."""
    if FEW <= 0:
        return None
    found = rows.limit(FEW + 1).toArrow()
    return found if found.num_rows <= FEW and found.nbytes <= FEW_BYTES else None


def _past_targets(sent, kernel, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = side(sent.value, plain)
        for batch in batches:
            if batch.num_rows and len(t):
                yield from kernel(side(batch, plain), t).to_batches()

    return run


def _past_queries(sent, kernel, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held = side(sent.value, plain), []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHERED:
                if len(q):
                    yield from kernel(q, side(pa.Table.from_batches(held), plain)).to_batches()
                held = []
        if len(q) and sum(b.num_rows for b in held):
            yield from kernel(q, side(pa.Table.from_batches(held), plain)).to_batches()

    return run


def _met(queries: DataFrame, targets: DataFrame, kernel: Callable[[Side, Side], pa.Table], schema: str, k: int | None = None, eps: float = 0.0, floors: bool = False, plain: bool = False, digits: int = 9, thin: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """(what ``kernel`` makes of queries and targets that meet, whether each query met all its targets at once).

    ``k`` or ``eps``: as far as a query looks. ``thin``: leaves out targets that can't matter, before two large sides meet.
    """
    context = queries.sparkSession.sparkContext
    few = _few(targets)
    if few is not None:
        return queries.mapInArrow(_past_targets(context.broadcast(few), kernel, plain), schema), True
    few = _few(queries)
    if few is not None:
        return targets.mapInArrow(_past_queries(context.broadcast(few), kernel, plain), schema), False
    made = cells.index(written(thin(targets), "thin") if thin else targets, plain)
    if made is None:
        return queries.sparkSession.createDataFrame([], schema), False
    tiled, pivots, known = made
    if cells.crowded(queries, pivots, known, k, eps, floors, plain, digits):
        return cells.past(queries, tiled, kernel, schema, plain, pivots), False
    return cells.meet(cells.routes(queries, pivots, known, k, eps, floors, plain, digits), tiled, kernel, schema), False


class Kernel:
    """What is made of a side of queries and the sides of targets that it meets, one or one after another."""

    def __call__(self, q: Side, t: Side) -> pa.Table:
        known = self.begin(q)
        self.add(q, known, t)
        return self.done(q, known)

    def begin(self, q: Side):
        raise NotImplementedError

    def add(self, q: Side, known, t: Side) -> None:
        raise NotImplementedError

    def done(self, q: Side, known) -> pa.Table:
        raise NotImplementedError


def _by_part(parts: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(parts, kind="stable")
    names, at = np.unique(parts[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, at[1:]), strict=True)) if len(parts) else {}


class Best:
    """The k best targets of each query so far, by rounded score, then id."""

    def __init__(self, k: int) -> None:
        self.k, self.q = k, np.zeros(0, np.int64)
        self.near, self.score, self.ids = np.zeros(0), np.zeros(0), None

    def add(self, q: np.ndarray, near: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            q, near, score, ids = np.concatenate([self.q, q]), np.concatenate([self.near, near]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -near, q))
        q = q[order]
        first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        order = order[keep]
        self.q, self.near, self.score, self.ids = q[keep], near[order], score[order], ids[order]

    def floors(self, n: int) -> np.ndarray:
        """The k-th best of each query, -inf where there are fewer."""
        out, count = np.full(n, -np.inf), np.bincount(self.q, minlength=n)
        full = count[self.q] == self.k
        np.minimum.at(low := np.full(n, np.inf), self.q[full], self.near[full])
        out[count == self.k] = low[count == self.k]
        return out


def cosine_at(far: np.ndarray) -> np.ndarray:
    """The cosine of unit vectors that are ``far`` apart."""
    return 1 - np.maximum(far, 0) ** 2 / 2


def close(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` (unit vectors) that contain all whose cosine is at least ``least`` of the row of ``a``.

    Products are made in 32 bits, and the bound is lowered by more than these can lose: a sum of n products of unit vectors is off by
    n + 2 roundings at most.
    """
    slack = (a.shape[1] + 16) * float(np.finfo(np.float32).eps)
    met = a.astype(np.float32) @ b.astype(np.float32).T >= (least - slack).astype(np.float32)[:, None]
    return np.divmod(np.flatnonzero(met), len(b))


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of ``a`` and j of ``b``: few pairs one by one, many by the product of all."""
    if len(i) * 8 > len(a) * len(b):
        return (a @ b.T)[i, j]
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]])
    return out


class _Nearest(Kernel):
    def __init__(self, k: int, metric: str, skip_self: bool, digits: int, rows: int, kind: pa.DataType, within: float | None = None, enough: float | None = None) -> None:
        self.k, self.metric, self.skip_self, self.digits, self.rows, self.kind = k, metric, skip_self, digits, rows, kind
        # rounded scores below which no target counts, and from which on k targets are enough
        score, spare = (lambda far: -far) if metric == "reach" else cosine_at, 2 * 10.0**-digits
        self.least = -np.inf if within is None else float(score(within)) - spare
        self.stop = np.inf if enough is None else float(score(enough)) + spare

    def looks(self, low: np.ndarray) -> np.ndarray:
        """The distance of targets whose rounded score is ``low``."""
        if self.metric == "euclid":
            return np.full(len(low), np.inf)
        return np.where(low == -np.inf, np.inf, -low if self.metric == "reach" else distance(np.maximum(low, -1)))

    def begin(self, q: Side) -> Best:
        return Best(self.k)

    def add(self, q: Side, best: Best, t: Side) -> None:
        k, metric, rows, mine = self.k, self.metric, self.rows, _by_part(q.part)
        for part, where in _by_part(t.part).items():
            if part not in mine:
                continue
            for b in range(0, len(where), rows):
                some = where[b : b + rows]
                floors, found, waiting = np.maximum(best.floors(len(q)), self.least), [], 0
                # queries that still look for something and have it in reach, and what they may reach
                all_at = mine[part][floors[mine[part]] < self.stop]
                inside, met = cells.reachable(q.v[all_at], t.v[some], self.looks(floors[all_at]), self.digits)
                all_at, some = all_at[inside], some[met]
                if not len(all_at) or not len(some):
                    continue
                v, step = t.v[some], max(1, SCORES // len(some))
                for a in range(0, len(all_at), step):
                    at = all_at[a : a + step]
                    low, few = floors[at], None
                    if metric != "euclid" and (low > -np.inf).all():
                        # only what may pass the k-th best so far is scored in full
                        few = close(q.v[at], v, low - 10.0**-self.digits if metric == "cosine" else cosine_at(10.0**-self.digits - low))
                    if few is not None and len(few[0]) <= max(FULL * k * len(at), len(at) * len(some) // 64):
                        i, j = few
                        score = cosines(q.v[at], v, i, j)
                        if metric == "reach":
                            score = np.minimum(-distance(score), -t.floor[some][j])
                        near = np.round(score, self.digits)
                        keep = near >= low[i]
                        if self.skip_self:
                            keep &= q.id[at][i] != t.id[some][j]
                        i, j, near, score = i[keep], j[keep], near[keep], score[keep]
                    else:
                        score = q.v[at] @ v.T if metric == "cosine" else -apart(q.v[at], v, metric == "euclid")
                        if metric == "reach":
                            score = np.minimum(score, -t.floor[some][None, :])
                        if self.skip_self:
                            score[q.id[at][:, None] == t.id[some][None, :]] = -np.inf
                        near = np.round(score, self.digits)
                        if len(some) > k:
                            low = np.maximum(low, np.partition(near, len(some) - k, axis=1)[:, len(some) - k])
                        i, j = np.divmod(np.flatnonzero((near >= low[:, None]) & (near > -np.inf)), len(some))
                        near, score = near[i, j], score[i, j]
                    found.append((at[i], near, score, t.id[some[j]]))
                    waiting += len(i)
                    if waiting > WAITING:
                        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
                        found, waiting = [], 0
                if waiting:
                    best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def done(self, q: Side, best: Best) -> pa.Table:
        kind = self.kind
        if best.ids is None:
            return pa.table({"query": pa.array([], kind), "target": pa.array([], kind), "score": pa.array([], pa.float64()), "near": pa.array([], pa.float64()), "place": pa.array([], pa.int32())})
        first = np.flatnonzero(np.concatenate([[True], best.q[1:] != best.q[:-1]])) if len(best.q) else np.zeros(0, np.int64)
        place = 1 + np.arange(len(best.q)) - np.repeat(first, np.diff(np.append(first, len(best.q))))
        return pa.table({"query": pa.array(q.id[best.q].tolist(), kind), "target": pa.array(best.ids.tolist(), kind), "score": best.score, "near": best.near, "place": pa.array(place, pa.int32())})


def nearest(queries: DataFrame, targets: DataFrame, k: int, key: str, vector: str = "embedding", metric: str = "cosine", skip_self: bool = False, digits: int = 9, rows: int = ROWS, part: str | None = None, floor: str | None = None, within: float | None = None, enough: float | None = None) -> DataFrame:
    """(query, target, score, place): the k best targets of each query; place from 1, scores equal to ``digits`` go to the smaller id.

    Score is the cosine, the negative distance for ``metric="euclid"``, or for "reach" the negative of the larger of a
    target's ``floor`` and the distance of unit vectors. Keys of queries are unique. The order of a task's rows or their blocks changes
    no result. ``within``: targets beyond that distance may be missing. ``enough``: k targets within that distance are any k of those.
    """
    kind = queries.schema[key].dataType.simpleString()
    kernel, schema = _Nearest(k, metric, skip_self, digits, rows, _ARROW[kind], within, enough), f"query {kind}, target {kind}, score double, near double, place int"

    def thin(side_: DataFrame) -> DataFrame:
        """Of equal vectors only the k + 1 of smallest floor and id can be among the k best: copies don't meet one another."""
        w = Window.partitionBy("part", F.xxhash64("v"), "v").orderBy(F.round("floor", digits), "id")
        return side_.withColumn("__copy", F.row_number().over(w)).where(F.col("__copy") <= k + 1).drop("__copy")

    hits, whole = _met(_side_of(queries, key, vector, part), _side_of(targets, key, vector, part, floor), kernel, schema, k + int(skip_self), within or 0.0, metric == "reach", metric == "euclid", digits, thin)
    if not whole:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "target"))
        hits = hits.withColumn("place", place).where(F.col("place") <= k)
    return hits.select("query", "target", "score", "place")


def best_score(queries: DataFrame, targets: DataFrame, key: str, vector: str = "embedding", part: str | None = None) -> DataFrame:
    """(query, score): highest cosine among all targets."""
    return nearest(queries, targets, 1, key, vector, part=part).select("query", "score")


def coverage(sample: DataFrame, selected: DataFrame, taus: tuple[float, ...], key: str = "window_id", vector: str = "embedding") -> DataFrame:
    """One row: shares of the sample whose nearest selected row has at least the cosine tau."""
    best = best_score(sample, selected, key, vector)
    return best.agg(*[F.avg((F.col("score") >= t).cast("double")).alias(f"coverage_{t}") for t in taus])


def interpolate(rest: DataFrame, fitted: DataFrame, key: str, vector: str, x: str, y: str, k: int = 8, temperature: float = 12.0) -> DataFrame:
    """Coordinates of rows outside a fit: softmax-weighted means of their k nearest fitted rows; fitted rows keep theirs."""
    near = nearest(rest, fitted, k, key, vector)
    known = fitted.select(F.col(key).alias("target"), F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty"))
    top = near.withColumn("top", F.max("score").over(Window.partitionBy("query")))
    weight = F.exp((F.col("score") - F.col("top")) * temperature)
    out = top.withColumn("wt", weight).join(known, "target").groupBy("query").agg((F.sum(F.col("wt") * F.col("tx")) / F.sum("wt")).alias(x), (F.sum(F.col("wt") * F.col("ty")) / F.sum("wt")).alias(y))
    return out.withColumnRenamed("query", key).union(fitted.select(key, F.col(x).cast("double"), F.col(y).cast("double")))


# within a distance


class _Least(Kernel):
    def __init__(self, eps: float) -> None:
        self.eps = eps

    def begin(self, q: Side) -> np.ndarray:
        return np.full(len(q), np.iinfo(np.int64).max)

    def add(self, q: Side, best: np.ndarray, t: Side) -> None:
        mine = _by_part(q.part)
        for part, where in _by_part(t.part).items():
            at = mine.get(part, np.zeros(0, np.int64))
            inside, met = cells.reachable(q.v[at], t.v[where], np.full(len(at), self.eps))
            at, where = at[inside], where[met]
            step = max(1, SCORES // max(1, len(where)))
            for a in range(0, len(at) if len(where) else 0, step):
                some = at[a : a + step]
                i, j = close(q.v[some], t.v[where], np.full(len(some), cosine_at(self.eps)))
                near = distance(cosines(q.v[some], t.v[where], i, j)) <= self.eps
                np.minimum.at(best, some[i[near]], t.value[where[j[near]]])

    def done(self, q: Side, best: np.ndarray) -> pa.Table:
        found = np.flatnonzero(best < np.iinfo(np.int64).max)
        return pa.table({"id": pa.array(q.id[found].tolist(), pa.int64()), "value": best[found]})


def least_within(queries: DataFrame, targets: DataFrame, eps: float, key: str, vector: str, value: str) -> DataFrame:
    """(key, value): the smallest value (long) among targets whose unit vector is within ``eps``; keys are long."""
    found, whole = _met(_side_of(queries, key, vector, None), _side_of(targets, key, vector, None, None, value), _Least(eps), "id long, value long", None, eps)
    found = found.withColumnsRenamed({"id": key, "value": value})
    return found if whole else found.groupBy(key).agg(F.min(value).alias(value))


class _Links(Kernel):
    """Links that join the same rows as all pairs within each level: every row, or group of rows, to what it is joined to."""

    def __init__(self, levels: list[float]) -> None:
        self.levels = levels

    def begin(self, q: Side) -> tuple[list, list, list, list]:
        # of each level, the group of each query: the smallest query that it is joined to here
        return [np.arange(len(q)) for _ in self.levels], [], [], []

    def settled(self, q: Side, at: np.ndarray, groups: list, t: Side, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """(targets that no pair can tell anything more of, the first level that joins them, -1 for none, the query they are joined to, whether
        the queries are of one group wherever they take part).

        Where all queries that take part in a level and in all wider ones are of one group, a target that takes part from there on is told by one near pair.
        """
        levels = np.array(self.levels)
        first, from_ = np.searchsorted(levels, q.floor[at]), np.searchsorted(levels, t.floor[some])
        begin = int(first.min())
        from_ = np.maximum(from_, begin)
        one, root = np.zeros(len(levels) + 1, bool), np.zeros(len(levels) + 1, np.int64)
        one[-1] = True
        for n in range(len(levels) - 1, begin - 1, -1):
            g = groups[n][at[first <= n]]
            one[n], root[n] = one[n + 1] and (g == g[0]).all(), g[0]
        stand = at[first == begin]
        stand = stand[:: -(-len(stand) // STAND)]
        near = np.maximum(distance(t.v[some] @ q.v[stand].T), np.maximum(q.floor[stand][None, :], t.floor[some][:, None])).min(1)
        out = from_ == len(levels)
        joined = ~out & one[from_] & (near <= np.append(levels, np.inf)[from_])
        return out | joined, np.where(joined, from_, -1), root[from_], bool(one[begin])

    def least(self, q: Side, at: np.ndarray, t: Side, some: np.ndarray) -> np.ndarray:
        """The first level at which each target is joined to one of the queries."""
        out, step = np.empty(len(some), np.int64), max(1, SCORES // len(at))
        for i in range(0, len(some), step):
            of = some[i : i + step]
            out[i : i + step] = np.searchsorted(self.levels, np.maximum(np.maximum(distance(t.v[of] @ q.v[at].T), q.floor[at][None, :]).min(1), t.floor[of]))
        return out

    def sets(self, q: Side, at: np.ndarray, groups: list) -> list[np.ndarray]:
        """The queries by large groups of the least level that has such groups of half of them, and the rest."""
        first = np.searchsorted(self.levels, q.floor[at])
        for n in range(int(first.min()), len(self.levels)):
            _, of, many = np.unique(np.where(first <= n, groups[n][at], -1 - np.arange(len(at))), return_inverse=True, return_counts=True)
            large = (many * STAND >= len(at)) & (many > 1)
            if 2 * many[large].sum() >= len(at):
                parts = [at[of == i] for i in np.flatnonzero(large).tolist()]
                return [*parts, at[~large[of]]] if not large[of].all() else parts
        return [at]

    def add(self, q: Side, known: tuple[list, list, list, list], t: Side) -> None:
        mine, (groups, a_out, b_out, level_out) = _by_part(q.part), known

        def told(some: np.ndarray, level: np.ndarray, to: np.ndarray) -> None:
            a_out.append(t.id[some])
            b_out.append(q.id[to])
            level_out.append(level.astype(np.int32))

        waiting = [(mine[part], where, FIRST) for part, where in _by_part(t.part).items() if part in mine]
        while waiting:
            at, left, size = waiting.pop()
            inside, met = cells.reachable(q.v[at], t.v[left], np.full(len(at), self.levels[-1]))
            at, left = at[inside], left[met]
            if len(at):
                at = at[q.floor[at] <= self.levels[-1]]
            if not len(at) or not len(left):
                continue
            done, level, root, one = self.settled(q, at, groups, t, left)
            told(left[level >= 0], level[level >= 0], root[level >= 0])
            left = left[~done]
            if not len(left):
                continue
            if one:
                level = self.least(q, at, t, left)
                near = level < len(self.levels)
                # of that level's group: any query that takes part in it
                first = np.searchsorted(self.levels, q.floor[at])
                told(left[near], level[near], np.array([groups[n][at[int((first <= n).argmax())]] for n in range(len(self.levels))])[level[near]])
                continue
            sets = self.sets(q, at, groups)
            if len(sets) > 1:
                waiting += [(s, left, size) for s in sets]
                continue
            picked = np.zeros(len(left), bool)
            picked[:: -(-len(left) // size)] = True
            some, left = left[picked], left[~picked]
            waiting.append((at, left, min(4 * size, max(FIRST, SCORES // len(at)))))
            i, j = close(q.v[at], t.v[some], np.full(len(at), cosine_at(self.levels[-1])))
            weight = np.maximum(np.maximum(distance(cosines(q.v[at], t.v[some], i, j)), q.floor[at][i]), t.floor[some][j])
            weight[q.id[at][i] == t.id[some][j]] = np.inf
            joined = np.zeros(len(some), bool)
            for n, eps in enumerate(self.levels):
                near = weight <= eps
                if not near.any():
                    continue
                x, y = i[near], j[near]
                touched = np.unique(y)
                group = groups[n][at]
                old = group.copy()
                while True:  # a target takes the smallest group near it, and gives it to all groups near it
                    low = np.full(len(some), len(q))
                    np.minimum.at(low, y, group[x])
                    new = group.copy()
                    np.minimum.at(new, x, low[y])
                    back = np.arange(len(q) + 1)
                    np.minimum.at(back, group, new)
                    new = back[group]
                    if (new == group).all():
                        break
                    group = new
                # targets that this level joins for the first time, and groups that it has brought together
                fresh = touched[~joined[touched]]
                low = low[fresh]
                joined[fresh] = True
                a_out.append(t.id[some[fresh]])
                b_out.append(q.id[low])
                level_out.append(np.full(len(fresh), n, np.int32))
                moved = np.flatnonzero(group != old)
                pairs = np.unique(np.stack([old[moved], group[moved]], 1), axis=0)
                a_out.append(q.id[pairs[:, 0]])
                b_out.append(q.id[pairs[:, 1]])
                level_out.append(np.full(len(pairs), n, np.int32))
                # what is joined here is joined at all wider levels
                for m in range(n, len(self.levels)):
                    wide = groups[m][pairs]
                    nodes, label = _labels(wide[wide[:, 0] != wide[:, 1]])
                    if len(nodes):
                        back = np.arange(len(q))
                        back[nodes] = label
                        groups[m] = back[groups[m]]

    def done(self, q: Side, known: tuple[list, list, list, list]) -> pa.Table:
        _, a_out, b_out, level_out = known
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"a": flat(a_out, pa.int64()), "b": flat(b_out, pa.int64()), "level": flat(level_out, pa.int32())})


def links(rows: DataFrame, levels: list[float], key: str, vector: str, floor: str, part: str | None = None) -> DataFrame:
    """(a, b, level): links whose components up to a level are those of all pairs whose distance and floors are within its eps.

    ``levels`` ascend. Where a chunk of rows meets others, each of these gets a link at the first level that joins it to the chunk, and
    each two groups of the chunk that it brings together get one: not one for each pair. A task sends a forest of its links, and forests are put together
    before they go on.
    """
    mine = _side_of(rows, key, vector, part, floor)
    out, _ = _met(mine, mine, _Links(levels), "a long, b long, level int", None, levels[-1])
    return thinned(out)


# the plane


def _pack_plane(k: int, rows: int):
    """Points in curve order -> blocks with their bounds and the distance within which each point has k others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                x, y, many = (b.column(c).to_numpy() for c in ("x", "y", "many"))
                d = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :])
                order = np.argsort(d, axis=1)
                enough = np.cumsum(many[order], axis=1) > k
                far = np.where(enough.any(1), np.take_along_axis(d, order, 1)[np.arange(len(x)), enough.argmax(1)], np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), *[pa.array([float(f(c))]) for c in (x, y) for f in (np.min, np.max)], pa.array([float(far.max())]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(b)], b.column("ids"))], ["block", "x0", "x1", "y0", "y1", "far", "xs", "ys", "ids"])
                made += 1

    return run


def _meet(k: int, digits: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qx, qy, tx, ty = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64) for c in ("qx", "qy", "xs", "ys"))
                lists = batch.column("ids")[i].values
                owner = np.repeat(np.arange(len(tx)), np.diff(lists.offsets.to_numpy()))
                ids = np.array(lists.flatten().to_pylist())
                best = Best(k + 1)
                for a in range(0, len(qx), 256):
                    d = np.sqrt((qx[a : a + 256, None] - tx[None, :]) ** 2 + (qy[a : a + 256, None] - ty[None, :]) ** 2)[:, owner]
                    near = np.round(-d, digits)
                    low = np.partition(near, -k - 1, axis=1)[:, -k - 1] if near.shape[1] > k + 1 else np.full(len(near), -np.inf)
                    r, c = np.nonzero(near >= low[:, None])
                    best.add(r + a, near[r, c], -d[r, c], ids[c])
                yield pa.RecordBatch.from_arrays([pa.array(qx[best.q]), pa.array(qy[best.q]), pa.array(best.ids.tolist(), kind), pa.array(best.score), pa.array(best.near)], ["x", "y", "target", "score", "near"])

    return run


def _in_reach(blocks: DataFrame, low: tuple[float, float], span: float, digits: int) -> DataFrame:
    """(q_block, t_block) of blocks whose bounds are within the query block's reach.

    Blocks are dealt to the cells of a grid, about as many as there are blocks, that their bounds (targets) or their reach (queries)
    cover, and meet by cell. A pair that shares several cells is kept in the first of them.
    """
    side_ = max(1, int(blocks.count() ** 0.5))
    cell = lambda c, i: F.least(F.greatest(F.floor((c - F.lit(low[i])) / F.lit(span / side_)), F.lit(0)), F.lit(side_ - 1)).cast("long")
    reach = F.col("far") * (1 + 1e-9) + 10.0 ** (1 - digits)

    def dealt(name: str, more) -> DataFrame:
        ends = {f"{name}_{c}{e}": cell(F.col(f"{c}{e}") + (more if e else -more), i) for i, c in enumerate("xy") for e in (0, 1)}
        out = blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in ("block", "far")], *[F.col(c).alias(f"{name}_at_{c}") for c in ("x0", "x1", "y0", "y1")], *[e.alias(n) for n, e in ends.items()])
        return out.withColumn("gx", F.explode(F.sequence(f"{name}_x0", f"{name}_x1"))).withColumn("gy", F.explode(F.sequence(f"{name}_y0", f"{name}_y1")))

    both = dealt("q", reach).join(dealt("t", F.lit(0.0)), ["gx", "gy"])
    first = (F.col("gx") == F.greatest("q_x0", "t_x0")) & (F.col("gy") == F.greatest("q_y0", "t_y0"))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"t_at_{c}0") - F.col(f"q_at_{c}1"), F.col(f"q_at_{c}0") - F.col(f"t_at_{c}1"))
    near = F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= F.col("q_far") * (1 + 1e-9) + 10.0 ** (1 - digits)
    return both.where(first & near).select("q_block", "t_block")


def plane_nearest(points: DataFrame, k: int, key: str, x: str, y: str, digits: int = 9, rows: int = BLOCK) -> DataFrame:
    """(query, target, score, place): each point's k nearest others in the plane; ties go to the smaller id.

    Places that several points share are one place with its k + 1 smallest ids, so no place is met twice. Places are sorted
    along a space-filling curve into blocks; a block meets the blocks whose bounds are within the distance in which each of its places
    has k others in its own block.
    """
    kind = points.schema[key].dataType.simpleString()
    p = written(points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "plane")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("n") <= k + 1)
    places = first.groupBy("x", "y").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("many"))
    low_x, high_x, low_y, high_y, count = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    grid = lambda c, low, high: F.floor((F.col(c) - F.lit(low or 0.0)) / F.lit(max((high or 0.0) - (low or 0.0), 1e-300)) * 65535).cast("long")
    spread = lambda c: reduce(lambda v, s: (v.bitwiseOR(F.shiftleft(v, s[0]))).bitwiseAND(F.lit(s[1])), ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)), c)
    curve = spread(grid("x", low_x, high_x)).bitwiseOR(F.shiftleft(spread(grid("y", low_y, high_y)), 1))
    sorted_ = places.withColumn("curve", curve).repartitionByRange(max(1, -(-count // (64 * rows))), "curve", "x", "y").sortWithinPartitions("curve", "x", "y")
    blocks = written(sorted_.mapInArrow(_pack_plane(k, rows), f"block long, x0 double, x1 double, y0 double, y1 double, far double, xs binary, ys binary, ids array<array<{kind}>>"), "plane-blocks")
    meet = _in_reach(blocks, (low_x or 0.0, low_y or 0.0), max((high_x or 0.0) - (low_x or 0.0), (high_y or 0.0) - (low_y or 0.0), 1e-300), digits)
    units = meet.join(blocks.select(F.col("block").alias("q_block"), F.col("xs").alias("qx"), F.col("ys").alias("qy")), "q_block").join(blocks.select(F.col("block").alias("t_block"), "xs", "ys", "ids"), "t_block")
    hits = units.select("qx", "qy", "xs", "ys", "ids").mapInArrow(_meet(k, digits, _ARROW[kind]), f"x double, y double, target {kind}, score double, near double")
    lists = hits.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("near"), "target"))).where(F.col("n") <= k + 1)
    each = p.join(lists, ["x", "y"]).where(F.col("id") != F.col("target"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("near"), "target"))
    return each.withColumn("place", place).where(F.col("place") <= k).select(F.col("id").alias("query"), "target", "score", "place")
