"""Two-dimensional layouts of a bounded sample from its neighbour graph: by fuzzy sets with negative sampling, and by matched neighbour distributions.

The graph is made by DataFrame passes: neighbours by :mod:`vectide.operators.knn`, each row's bandwidth by bisection in Arrow batches,
both directions of an edge put together in one shuffle. The layout itself moves all points of the sample in one task: points and
edges of a sample, whose size the caller bounds, are what that task holds.

Matching of neighbour chances takes tables of any size (:func:`matched`): edges are written once in blocks of rows, and each step moves the
rows of all blocks side by side. A task holds the edges of a block and the places of all rows, 16 bytes each, that it reads from
the table of the step before, and makes the grid of repulsion, of at most 256 x 256 sums, from them; nothing of a step passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators import knn
from vectide.sources.scratch import dropped, handed, scope, written

#: Steps of a bisection for a bandwidth, and the least bandwidth as a share of a row's mean distance.
BISECTIONS, LEAST_SHARE = 64, 1e-3
#: Largest move of a point by one edge.
CLIP = 4.0
#: Rows of a block of a partitioned layout, and its edges that are looked at at once.
BLOCK_ROWS, EDGES = 1 << 14, 1 << 18


def _neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(a, ids, far): each row's k nearest others by cosine, with their distances, nearest first."""
    near = knn.nearest(rows, rows, k, "at", "unit", skip_self=True)
    lists = near.groupBy(F.col("query").alias("a")).agg(F.sort_array(F.collect_list(F.struct("place", "target", "score"))).alias("n"))
    return lists.select("a", F.col("n.target").alias("ids"), F.transform("n.score", lambda x: F.greatest(F.lit(0.0), 1 - x)).alias("far"))


def bandwidths(far: np.ndarray, held: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each row the width at which the memberships exp(-far / width) of its neighbours (``held``) add up to ``target``, by bisection."""
    low, high, width = np.zeros(len(far)), np.full(len(far), np.inf), np.ones(len(far))
    for _ in range(BISECTIONS):
        total = np.where(held, np.exp(-far / width[:, None]), 0).sum(1)
        low, high = np.where(total < target, width, low), np.where(total < target, high, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    return width


def _padded(lists: pa.ListArray, fill: float) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(lists.offsets.to_numpy())
    held = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
    out = np.full(held.shape, fill)
    out[held] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, held


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far, held = _padded(batch.column("far"), np.inf)
        ids, _ = _padded(batch.column("ids"), -1)
        positive = np.where(far > 0, far, np.inf).min(1, initial=np.inf)
        beyond = np.maximum(far - np.where(np.isfinite(positive), positive, 0)[:, None], 0)
        many = held.sum(1)
        width = bandwidths(beyond, held, np.log2(np.maximum(many, 1)))
        width = np.maximum(width, LEAST_SHARE * np.where(held, far, 0).sum(1) / np.maximum(many, 1))
        share = np.where(beyond > 0, np.exp(-beyond / np.maximum(width, 1e-300)[:, None]), 1.0)
        a = np.repeat(batch.column("a").to_numpy(), many)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[held].astype(np.int64)), pa.array(share[held])], ["a", "b", "p"])


def _chances(perplexity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, held = _padded(batch.column("far"), np.inf)
            ids, _ = _padded(batch.column("ids"), -1)
            square = 2 * np.where(held, far, 0)  # of unit vectors
            goal = np.log(np.minimum(perplexity, np.maximum(held.sum(1) - 1e-3, 1.0)))
            low, high, beta = np.zeros(len(far)), np.full(len(far), np.inf), np.ones(len(far))
            for _ in range(BISECTIONS):
                e = np.where(held, np.exp(-(square - square.min(1, initial=0, where=held, keepdims=True) if square.size else square) * beta[:, None]), 0)
                p = e / np.maximum(e.sum(1, keepdims=True), 1e-300)
                entropy = -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum(1)
                low, high = np.where(entropy > goal, beta, low), np.where(entropy > goal, high, beta)
                beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
            a = np.repeat(batch.column("a").to_numpy(), held.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[held].astype(np.int64)), pa.array(p[held])], ["a", "b", "p"])

    return run


def _both(directed: DataFrame) -> DataFrame:
    """(a, b, p, q) with a < b: the weight of an edge in either direction, 0 where there is none."""
    up = F.col("a") < F.col("b")
    return directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.coalesce(F.max(F.when(up, F.col("p"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(~up, F.col("p"))), F.lit(0.0)).alias("q"))


def fuzzy_graph(rows: DataFrame, k: int = 15) -> DataFrame:
    """(a, b, weight) with a < b: rows' fuzzy neighbourhoods, put together by p + q - p q. ``rows``: at (long), unit."""
    directed = _neighbours(rows, k - 1).mapInArrow(_memberships, "a long, b long, p double")
    return _both(directed).select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("weight"))


def chance_graph(rows: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """(a, b, weight) with a < b: mean of both directions' chances to pick a neighbour, at a given perplexity."""
    directed = _neighbours(rows, max(1, int(3 * perplexity))).mapInArrow(_chances(perplexity), "a long, b long, p double")
    return _both(directed).select("a", "b", ((F.col("p") + F.col("q")) / 2).alias("weight"))


# moving points


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^2b) is nearest to 1 up to ``min_dist`` and an exponential fall beyond: Gauss-Newton on logarithms."""
    d = np.linspace(1e-3, 3 * spread, 300)
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    x = np.zeros(2)
    f = lambda x: 1 / (1 + np.exp(x[0]) * d ** (2 * np.exp(x[1]))) - goal
    for _ in range(100):
        r = f(x)
        j = np.stack([(f(x + h) - r) / 1e-6 for h in (np.array([1e-6, 0]), np.array([0, 1e-6]))], 1)
        x = x - np.linalg.lstsq(j, r, rcond=None)[0]
    return float(np.exp(x[0])), float(np.exp(x[1]))


def _add_up(at: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, move[:, i], n) for i in range(2)], 1)


def spread_out(start: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, epochs: int, seed: int, negatives: int = 5) -> np.ndarray:
    """Positions after pulling the ends of edges together, as often as their weights say, and pushing both away from drawn points.

    All edges of an epoch move points together; a point's pulls and pushes are divided by the same number, so the balance stays.
    """
    p, q = curve()
    draw, y, n = np.random.default_rng(seed), start.copy(), len(start)
    rate = weight / weight.max() if len(weight) else weight
    for e in range(epochs):
        live = np.flatnonzero(np.floor((e + 1) * rate) > np.floor(e * rate))
        if not len(live):
            continue
        i, j = a[live], b[live]
        d = y[i] - y[j]
        square = np.maximum((d**2).sum(1), 1e-12)
        pull = np.clip((-2 * p * q * square ** (q - 1) / (1 + p * square**q))[:, None] * d, -CLIP, CLIP)
        heads = np.repeat(np.concatenate([i, j]), negatives)
        others = draw.integers(0, n, len(heads))
        d = y[heads] - y[others]
        square = (d**2).sum(1)
        push = np.where((heads != others)[:, None], np.clip((2 * q / ((1e-3 + square) * (1 + p * square**q)))[:, None] * d, -CLIP, CLIP), 0)
        move = _add_up(i, pull, n) - _add_up(j, pull, n) + _add_up(heads, push, n)
        y += (1 - e / epochs) * move / np.maximum(np.bincount(np.concatenate([i, j]), minlength=n) / 2, 1)[:, None]
    return y


def _grid(low: np.ndarray, span: float, cell: float = 0.3, most: int = 256) -> tuple[np.ndarray, float, int]:
    """(lowest corner, width of a cell, nodes of a side) of the grid over a layout."""
    span = max(span, 1e-9)
    m = int(min(most, max(32, 2 ** np.ceil(np.log2(span / cell + 2)))))
    return low, span / (m - 2), m


def _corners(y: np.ndarray, low: np.ndarray, h: float, m: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The four nodes around each point, and the point's shares in them."""
    place = (y - low) / h
    at = np.minimum(place.astype(np.int64), m - 2)
    f = place - at
    nodes = [(at[:, 0] + dx) * m + at[:, 1] + dy for dx in (0, 1) for dy in (0, 1)]
    shares = [(f[:, 0] if dx else 1 - f[:, 0]) * (f[:, 1] if dy else 1 - f[:, 1]) for dx in (0, 1) for dy in (0, 1)]
    return nodes, shares


def _itself(shares: list[np.ndarray], h: float) -> np.ndarray:
    """What a point adds to itself through the nodes around it."""
    return sum(shares[i] * shares[j] / (1 + h * h * ((i // 2 != j // 2) + (i % 2 != j % 2))) for i in range(4) for j in range(4))


def _convolved(charge: np.ndarray, h: float) -> list[np.ndarray]:
    """At each node the sums over all others of 1 / (1 + d^2), and of both parts of a push, times their charge."""
    m = len(charge)
    step = np.concatenate([np.arange(m), np.arange(-m, 0)]) * h
    near = 1 / (1 + step[:, None] ** 2 + step[None, :] ** 2)
    spectrum = np.fft.rfft2(charge, (2 * m, 2 * m))
    return [np.fft.irfft2(spectrum * np.fft.rfft2(kernel), (2 * m, 2 * m))[:m, :m].ravel() for kernel in (near, step[:, None] * near**2, step[None, :] * near**2)]


def repulsion(y: np.ndarray, cell: float = 0.3, most: int = 256) -> tuple[np.ndarray, float]:
    """(sum over others of (y_i - y_j) / (1 + d^2)^2, sum over all pairs of 1 / (1 + d^2)), from a grid: points are spread to its nodes,
    sums over nodes are convolutions, and points take them from the nodes around them."""
    low, h, m = _grid(y.min(0), float(np.ptp(y, axis=0).max()), cell, most)
    nodes, shares = _corners(y, low, h, m)
    sums = _convolved(sum(np.bincount(n, s, m * m) for n, s in zip(nodes, shares, strict=True)).reshape(m, m), h)
    back = [sum(s[n] * w for n, w in zip(nodes, shares, strict=True)) for s in sums]
    return np.stack(back[1:], 1), float((back[0] - _itself(shares, h)).sum())


def _stepped(y: np.ndarray, speed: np.ndarray, gains: np.ndarray, slope: np.ndarray, rate: float, early: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, speeds, gains) after a step down the slope."""
    gains = np.maximum(np.where(slope * speed < 0, gains + 0.2, gains * 0.8), 0.01)
    speed = (0.5 if early else 0.8) * speed - rate * gains * slope
    return y + speed, speed, gains


def match(start: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, steps: int = 750, early: int = 250, exaggeration: float = 12.0) -> np.ndarray:
    """Positions whose heavy-tailed neighbour chances match ``weight``: gradient descent with momentum and gains, edges drawn out at first."""
    n = len(start)
    y, speed, gains = start / max(start.std(), 1e-12) * 1e-4, np.zeros_like(start), np.ones_like(start)
    p = weight / max(2 * weight.sum(), 1e-300)
    rate = max(n / exaggeration / 4, 50.0)
    for e in range(steps):
        d = y[a] - y[b]
        pull = ((exaggeration if e < early else 1.0) * p / (1 + (d**2).sum(1)))[:, None] * d
        push, total = repulsion(y)
        slope = 4 * (_add_up(a, pull, n) - _add_up(b, pull, n) - push / max(total, 1e-12))
        y, speed, gains = _stepped(y, speed, gains, slope, rate, e < early)
        y -= y.mean(0)
    return y


def placed(start: DataFrame, graph: DataFrame, kind: str, seed: int, epochs: int = 300) -> DataFrame:
    """(at, x, y): ``start`` (at, x, y) moved along ``graph`` (a, b, weight) in one task; ``kind`` is umap or tsne."""
    points = start.select(F.lit(0).alias("one"), "at", "x", "y")
    edges = graph.select(F.lit(0).alias("one"), "a", "b", "weight")

    def run(p: pa.Table, e: pa.Table) -> pa.Table:
        p, e = p.sort_by("at"), e.sort_by([("a", "ascending"), ("b", "ascending")])
        at = p["at"].to_numpy()
        y = np.stack([p["x"].to_numpy(), p["y"].to_numpy()], 1)
        a, b = (np.searchsorted(at, e[c].to_numpy()) for c in ("a", "b"))
        y = y + np.random.default_rng(seed).normal(scale=1e-4, size=y.shape)
        y = spread_out(y, a, b, e["weight"].to_numpy(), epochs, seed) if kind == "umap" else match(y, a, b, e["weight"].to_numpy())
        return pa.table({"at": at, "x": y[:, 0], "y": y[:, 1]})

    return points.groupBy("one").cogroup(edges.groupBy("one")).applyInArrow(run, "at long, x double, y double")


# layouts of tables of any size


_STATE = "block long, y binary, speed binary, gains binary"


def _state(block: int, y: np.ndarray, speed: np.ndarray, gains: np.ndarray) -> list[pa.Array]:
    return [pa.array([block], pa.int64()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (y, speed, gains)]]


_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _doubles(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, 2)


def _edge_block(group: pa.Table) -> pa.Table:
    """Edges of a block's rows, by row -> one row: how many each row has, their other ends and weights (in 32 bits, as each step reads them)."""
    group = group.sort_by([("a", "ascending"), ("b", "ascending")])
    a = group["a"].to_numpy()
    counts = np.bincount(a - a[0])
    raw = [counts.astype(np.int32), group["b"].to_numpy().astype(np.int32), group["weight"].to_numpy().astype(np.float32)]
    return pa.table({"block": group["block"][:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("counts", "ids", "weights"), raw, strict=True)}})


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks' weights."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(raw.as_buffer(), np.float32).sum(dtype=np.float64)) for raw in batch.column("weights")])], ["weight"])


def _started(scale: float, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group, block = group.sort_by("at"), group["block"][0].as_py()
        y = np.stack([group["x"].to_numpy(), group["y"].to_numpy()], 1)
        y = (y + np.random.default_rng([seed, block]).normal(scale=1e-4, size=y.shape)) * scale
        return pa.Table.from_arrays(_state(block, y, np.zeros_like(y), np.ones_like(y)), _STATE_NAMES)

    return run


def _field(every: list[np.ndarray]) -> tuple[np.ndarray, float, int, list[np.ndarray], float]:
    """(corner, width and side of a grid over the places of all blocks, both parts of a push at its nodes, the sum over all pairs): as in :func:`repulsion`."""
    ends = [np.array([f(y[:, i]) for i in range(2) for y in every]).reshape(2, -1) for f in (np.min, np.max)]
    low, high = ends[0].min(1), ends[1].max(1)
    low, h, m = _grid(low, float((high - low).max()))
    charge, own = np.zeros(m * m), 0.0
    for y in every:
        nodes, shares = _corners(y, low, h, m)
        charge += np.bincount(np.concatenate(nodes), np.concatenate(shares), m * m)
        own += float(_itself(shares, h).sum())
    sums = _convolved(charge.reshape(m, m), h)
    return low, h, m, sums[1:], float(charge @ sums[0]) - own


def _pulled(mine: np.ndarray, x: np.ndarray, y: np.ndarray, counts: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pulls of the edges of rows at ``mine`` to rows at ``x`` and ``y``; edges come by row, some rows at a time."""
    end, out, a = np.cumsum(counts, dtype=np.int64), np.zeros_like(mine), 0
    while a < len(mine):
        begin = int(end[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(end, begin + EDGES, "right")))
        of, to = np.repeat(np.arange(b - a), counts[a:b]), ids[begin : end[b - 1]]
        dx, dy = mine[a:b, 0][of] - x[to], mine[a:b, 1][of] - y[to]
        w = weight[begin : end[b - 1]] / (1 + dx * dx + dy * dy)
        out[a:b, 0], out[a:b, 1] = np.bincount(of, w * dx, b - a), np.bincount(of, w * dy, b - a)
        a = b
    return out


def _moved(weights: float, rate: float, exaggeration: float, early: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if field is None:  # the same for all blocks of a task
                    every = [_doubles(raw) for raw in batch.column("places")[i].values]
                    x, y = (np.concatenate([e[:, c] for e in every]) for c in range(2))
                    low, h, m, sums, total = field = _field(every)
                speed, gains = (_doubles(batch.column(c)[i]) for c in ("speed", "gains"))
                mine = every[block]
                counts, ids, weight = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("counts", np.int32), ("ids", np.int32), ("weights", np.float32)))
                pull = _pulled(mine, x, y, counts, ids, weight)
                nodes, shares = _corners(mine, low, h, m)
                push = np.stack([sum(s[n] * w for n, w in zip(nodes, shares, strict=True)) for s in sums], 1)
                slope = 4 * (exaggeration / weights * pull - push / max(total, 1e-12))
                yield pa.RecordBatch.from_arrays(_state(block, *_stepped(mine, speed, gains, slope, rate, early)), _STATE_NAMES)

    return run


def _opened(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("y"), strict=True):
            y = _doubles(raw)
            yield pa.RecordBatch.from_arrays([pa.array(block * rows + np.arange(len(y))), pa.array(y[:, 0]), pa.array(y[:, 1])], ["at", "x", "y"])


def matched(start: DataFrame, graph: DataFrame, seed: int, steps: int = 750, early: int = 250, exaggeration: float = 12.0, rows: int | None = None) -> DataFrame:
    """(at, x, y): the descent of :func:`match` over partitioned rows and edges. ``start``: at from 0 without gaps, x, y.

    A step is one job: it moves each block of rows by its edges and the grid, and writes where they are. Blocks meet the places of all rows as a
    cartesian product with one row, so these are read by the tasks and pass neither the driver nor a shuffle; each task makes the grid from them, at a
    cost of a few numbers a row. Blocks are of fixed size and the grid is added up in their order: no step depends on the tasks that make
    it. The table of a step is deleted after the next one; executors keep the edges, on disk where memory lacks.
    """
    spark, rows = start.sparkSession, rows or BLOCK_ROWS
    points = written(start.select("at", F.round("x", 9).alias("x"), F.round("y", 9).alias("y")), "layout-start")
    n, mean, square = points.agg(F.count(F.lit(1)), F.avg(F.col("x") + F.col("y")) / 2, F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2).first()
    if not n:
        return points
    scale = 1e-4 / max(round(max(square - mean * mean, 0.0) ** 0.5, 9), 1e-12)
    of = lambda c: F.floor(F.col(c) / rows).cast("long").alias("block")
    # the graph is made once for both ways of its edges; every row once more with itself, at no weight, so that none is without an edge
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "weight")
    ways = graph.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way")).select("way.*").unionAll(points.select(F.col("at").alias("a"), F.col("at").alias("b"), F.lit(0.0)))
    blocks = -(-n // rows)
    edges = ways.select(of("a"), "a", "b", "weight").repartitionByRange(blocks, "block")
    edges = written(edges.groupBy("block").applyInArrow(_edge_block, "block long, counts binary, ids binary, weights binary"), "layout-edges")
    weights = max(sum(r[0] for r in edges.select("block", "weights").mapInArrow(_weighed, "weight double").sort("weight").collect()), 1e-300)
    rate = max(n / exaggeration / 4, 50.0)
    edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with scope(spark) as made:

            def kept(df: DataFrame) -> DataFrame:
                """The state of a step, written."""
                out = written(df, "layout")
                for path in made[:-1]:
                    dropped(spark, path)
                del made[:-1]
                return out

            state = kept(points.select(of("at"), "at", "x", "y").groupBy("block").applyInArrow(_started(scale, seed), _STATE))
            for e in range(steps):
                whole = state.coalesce(1).agg(F.sort_array(F.collect_list(F.struct("block", "y", "speed", "gains"))).alias("all"))
                own = F.element_at("all", F.col("block").cast("int") + 1)
                met = edges.join(whole.hint("shuffle_replicate_nl")).select("block", "counts", "ids", "weights", F.col("all.y").alias("places"), own["speed"].alias("speed"), own["gains"].alias("gains"))
                state = kept(met.mapInArrow(_moved(weights, rate, exaggeration if e < early else 1.0, e < early), _STATE))
            last = made.pop()
    finally:
        edges.unpersist()
    handed(last)
    out = state.select("block", "y").mapInArrow(lambda batches: _opened(batches, rows), "at long, x double, y double")
    middle = out.agg(F.avg("x"), F.avg("y")).first()
    return out.select("at", *[(F.col(c) - F.lit(v)).alias(c) for c, v in zip(("x", "y"), middle, strict=True)])
