"""Density groups and bounded groups of vectors, as passes over a distributed table.

Distances are Euclidean between unit vectors. A table of nodes (paths) is refined breadth-first: all open nodes share each pass, rows
carry their node, and the driver keeps one row for each node or group, and the centres of k-means. Neighbours come from
:mod:`vectide.operators.knn`, components from links of spanning size. The same steps are taken at any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.errors import ContractError
from vectide.operators import knn
from vectide.operators.graph import components
from vectide.operators.metrics import unit_rows
from vectide.operators.order import numbered
from vectide.sources.scratch import written

#: Bytes of centres and their candidates that the driver holds and broadcasts at once, and centres whose sums travel as one row.
CENTRE_BYTES, CENTRE_ROWS = 256 << 20, 1024
#: Rounds in which candidates for starts are drawn, about as many a round as there are centres, LEAST_DRAWN at least.
ROUNDS, LEAST_DRAWN = 4, 16


@dataclass(frozen=True)
class Limits:
    """Parameters of grouping."""

    n_max: int = 2000
    n_min: int = 500
    eps0: float = 0.4
    min_samples: int = 5
    gamma: float = 0.85
    viable_frac: float = 0.6
    largest_frac: float = 0.9
    floor_divisor: float = 8.0
    fill: float = 0.75
    iterations: int = 50
    seed: int = 0

    def levels(self) -> list[float]:
        """Distances that are tried, from eps0 down to its floor."""
        out = [self.eps0]
        while out[-1] * self.gamma >= self.eps0 / self.floor_divisor:
            out.append(out[-1] * self.gamma)
        return out


def require_limits(limits: Limits) -> None:
    if limits.n_max < 2 * limits.n_min:
        raise ContractError("n_max has to be at least twice n_min")


# density


def core_distances(rows: DataFrame, m: int, key: str, vector: str = "unit", part: str | None = None, within: float | None = None, enough: float = 0.0) -> DataFrame:
    """``rows`` with ``core``: the distance to the m-th row of the part, itself counted; infinite where there are fewer.

    Beyond ``within`` it may be infinite; up to ``enough`` it is ``enough``.
    """
    far = knn.nearest(rows, rows, max(1, m - 1), key, vector, skip_self=True, part=part, within=within, enough=enough or None).where(F.col("place") == m - 1)
    far = far.select(F.col("query").alias(key), F.greatest(F.lit(enough), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))).alias("core"))
    none = F.lit(enough if m <= 1 else float("inf"))
    return rows.join(far, key, "left").withColumn("core", F.coalesce("core", none))


def reach(rows: DataFrame, key: str, vector: str = "unit", part: str | None = None) -> DataFrame:
    """``rows`` (with core) and ``reach``: the smallest eps at which a row is in a cluster, and ``via``, the row it is reached from."""
    one = knn.nearest(rows, rows, 1, key, vector, "reach", skip_self=True, part=part, floor="core").select(F.col("query").alias(key), (-F.col("score")).alias("__far"), F.col("target").alias("via"))
    return rows.join(one, key, "left").withColumn("reach", F.least("core", F.coalesce("__far", F.lit(float("inf"))))).drop("__far")


def _told_apart(rows: DataFrame, m: int, low: float, high: float) -> DataFrame:
    """``rows`` (at, part, unit) with core, reach and via, as far as levels from ``low`` to ``high`` tell them apart.

    Cores of at most ``low`` are ``low``, and distances above ``high`` may be infinite, so a row is done as soon as it has seen m rows within the least
    level, and meets none beyond the widest. Only the others can be in a cluster by way of another row. Where that is within ``low``, exact cores
    of the rows that are so near say which one it is.
    """
    mine = written(core_distances(rows, m, "at", part="part", within=high, enough=low), "open-core")
    apart = mine.where(F.col("core") > low)
    one = knn.nearest(apart, mine.where(F.col("core") <= high), 1, "at", "unit", "reach", skip_self=True, part="part", floor="core", within=high, enough=low)
    one = written(one.select(F.col("query").alias("at"), (-F.col("score")).alias("__far"), F.col("target").alias("via")), "open-via")
    beside = apart.join(one.where(F.col("__far") <= low).select("at"), "at", "left_semi")
    if not beside.isEmpty():
        beside = written(beside, "open-beside")
        near = mine.where(F.col("core") <= low).drop("core")
        near = near.join(knn.least_within(near.withColumn("value", F.col("at")), beside.withColumn("value", F.col("at")), low, "at", "unit", "value").select("at"), "at", "left_semi")
        near = written(near, "open-near")
        exact = knn.nearest(near, rows, max(1, m - 1), "at", "unit", skip_self=True, part="part").where(F.col("place") == m - 1)
        exact = near.join(exact.select(F.col("query").alias("at"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("core")), "at", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
        told = knn.nearest(beside, written(exact, "open-exact"), 1, "at", "unit", "reach", skip_self=True, part="part", floor="core")
        told = told.select(F.col("query").alias("at"), (-F.col("score")).alias("__far"), F.col("target").alias("via"))
        one = written(one.join(told.select("at"), "at", "left_anti").unionAll(told), "open-via")
    return mine.join(one, "at", "left").withColumn("reach", F.least("core", F.coalesce("__far", F.lit(float("inf"))))).drop("__far")


def density(df: DataFrame, m: int, key: str = "row_id") -> DataFrame:
    """(key, core, reach) of all rows."""
    rows = written(unit_rows(df).select(key, "unit"), "unit")
    return reach(written(core_distances(rows, m, key), "core"), key).select(key, "core", "reach")


def dbscan(df: DataFrame, eps: float, m: int, key: str = "row_id") -> DataFrame:
    """(key, label): clusters from 0 by their smallest key, -1 for noise. A row within eps of cores of several clusters joins the one of the smallest core."""
    rows = written(core_distances(numbered(unit_rows(df).select(key, "unit"), key, name="at"), m, "at"), "core")
    cores = rows.where(F.col("core") <= eps)
    joined = components(knn.links(cores, [eps], "at", "unit", "core"))
    named = written(cores.select(key, "at", "unit").join(joined.withColumnRenamed("node", "at"), "at", "left").withColumn("label", F.coalesce("label", "at")), "cores")
    beside = knn.least_within(rows.where(F.col("core") > eps).select("at", "unit"), named, eps, "at", "unit", "label")
    of = named.select("at", "label").unionAll(beside.select("at", "label"))
    return noise_labels(rows.select(key, "at").join(of, "at", "left"), "label", "at").select(key, F.col("canonical").cast("long").alias("label"))


def number_groups(df: DataFrame, label: list[str], key: str = "row_id") -> DataFrame:
    """Adds group_id, dense by the smallest key of each label, and group_size."""
    leaves = df.groupBy(*label).agg(F.min(key).alias("__first"), F.count(F.lit(1)).cast("int").alias("group_size"))
    named = numbered(leaves, "__first", name="group_id").withColumn("group_id", F.col("group_id").cast("int")).drop("__first")
    return df.join(named, label)


def noise_labels(df: DataFrame, label: str, key: str) -> DataFrame:
    """Adds ``canonical``: labels from 0 by their smallest key, -1 for null or negative ones."""
    firsts = df.where(F.col(label) >= 0).groupBy(label).agg(F.min(key).alias("__first"))
    named = numbered(firsts, "__first", name="canonical").withColumn("canonical", F.col("canonical").cast("int")).drop("__first")
    return df.join(named, label, "left").withColumn("canonical", F.coalesce("canonical", F.lit(-1)))


# k-means of many parts at once


def _by_node(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(node, places, unit vectors) of a batch."""
    nodes, at = np.unique(np.array(batch.column("node").to_pylist(), object), return_inverse=True)
    rows = knn.matrix(batch.column("unit"))
    for i, node in enumerate(nodes.tolist()):
        where = np.flatnonzero(at == i)
        yield node, where, rows[where]


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, cosine to it) of each row; at most knn.SCORES products are held at once, however many centres there are."""
    part, best = np.empty(len(rows), np.int64), np.empty(len(rows))
    step = max(1, knn.SCORES // max(1, len(centres)))
    for i in range(0, len(rows), step):
        fit = rows[i : i + step] @ centres.T
        part[i : i + step] = fit.argmax(1)
        best[i : i + step] = fit[np.arange(len(fit)), part[i : i + step]]
    return part, best


def _gaps(centres):
    """Of each task and node, the sum of 1 - cosine to the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for batch in batches:
            for node, _, rows in _by_node(batch):
                held[node] = held.get(node, 0.0) + float(np.maximum(1 - _nearest_centre(rows, centres.value[node])[1], 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["node", "gap"])

    return run


def _drawn(sent):
    """Rows whose draw is below their gap's share of the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, share = sent.value
        for batch in batches:
            draw, keep = batch.column("draw").to_numpy(), np.zeros(batch.num_rows, bool)
            for node, where, rows in _by_node(batch):
                keep[where] = draw[where] < share[node] * np.maximum(1 - _nearest_centre(rows, centres[node])[1], 0)
            yield batch.filter(pa.array(keep))

    return run


def _shares(centres):
    """Of each task and node, the number of rows nearest to each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for node, _, rows in _by_node(batch):
                c = centres.value[node]
                held[node] = held.get(node, 0) + np.bincount(_nearest_centre(rows, c)[0], minlength=len(c)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["node", "total"])

    return run


def _reclustered(rows: np.ndarray, weight: np.ndarray, k: int, race: np.random.Generator) -> np.ndarray:
    """``k`` of weighted rows, one after another with a chance in proportion to weight times the gap to those before (a race of exponentials)."""
    taken = [int(np.argmax(weight))]
    gap = 1 - rows @ rows[taken[0]]
    while len(taken) < min(k, len(rows)):
        time = race.exponential(size=len(rows)) / np.maximum(gap * weight, 1e-12)
        time[taken] = np.inf
        taken.append(int(np.argmin(time)))
        gap = np.minimum(gap, 1 - rows @ rows[taken[-1]])
    return rows[taken]


def starts(rows: DataFrame, many: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """First centres of each node's k-means, by rounds of oversampling: k-means||.

    A node begins with the row of smallest draw. Each round measures the gap of all rows to the candidates so far and takes every row
    with a chance in proportion to its gap, about as many as there are centres, in two passes over all nodes together. The candidates,
    weighted by the rows nearest to them, are then thinned to the centres. No task holds more than its batch and the candidates,
    and what comes to the driver is these, ROUNDS for each centre.
    """
    spark = rows.sparkSession
    draw = lambda i: ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "row_id"), 11) + 0.5) * F.lit(2.0**-53)).alias("draw")
    first = rows.select("node", "unit", "row_id", draw(0)).groupBy("node").agg(F.min_by("unit", F.struct("draw", "row_id")).alias("unit")).collect()
    found = {r["node"]: np.array([r["unit"]], np.float64) for r in first}
    for i in range(1, ROUNDS + 1):
        gaps = rows.select("node", "unit").mapInArrow(_gaps(spark.sparkContext.broadcast(found)), "node string, gap double").groupBy("node").agg(F.sum("gap").alias("gap")).collect()
        share = {r["node"]: max(LEAST_DRAWN, many[r["node"]]) / max(r["gap"], 1e-300) for r in gaps}
        sent = spark.sparkContext.broadcast((found, share))
        new = rows.select("node", "unit", draw(i), "row_id").mapInArrow(_drawn(sent), f"node string, unit array<double>, draw double, row_id {rows.schema['row_id'].dataType.simpleString()}").collect()
        more: dict[str, list] = {}
        for r in sorted(new, key=lambda r: (r["draw"], r["row_id"])):
            more.setdefault(r["node"], []).append(r["unit"])
        found |= {node: np.concatenate([found[node], units]) for node, units in more.items()}
    weights = rows.select("node", "unit").mapInArrow(_shares(spark.sparkContext.broadcast(found)), "node string, total binary").groupBy("node").applyInArrow(_total, "node string, total binary").collect()
    held = {r["node"]: np.frombuffer(r["total"], np.float64) for r in weights}
    return {node: _reclustered(c, held[node], many[node], np.random.default_rng([seed, len(c), *node.encode()[-8:]])) for node, c in found.items()}


def _assign(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.full(batch.num_rows, -1, np.int64)
            for node, where, rows in _by_node(batch):
                if node in centres.value:
                    part[where] = _nearest_centre(rows, centres.value[node])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return run


def _sums(centres):
    """Of each task, the sum and number of rows nearest to each centre, a row for CENTRE_ROWS centres, and the row that fits its own least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        worst: dict[str, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for node, _, rows in _by_node(batch):
                c = centres.value[node]
                part, best = _nearest_centre(rows, c)
                held = total.setdefault(node, np.zeros((len(c), rows.shape[1] + 1)))
                np.add.at(held, part, np.concatenate([rows, np.ones((len(rows), 1))], 1))
                i = int(best.argmin())
                if node not in worst or best[i] < worst[node][0]:
                    worst[node] = (float(best[i]), rows[i])
        for node, held in total.items():
            for i in range(0, len(held), CENTRE_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([i], pa.int64()), pa.array([held[i : i + CENTRE_ROWS].tobytes()], pa.binary()), pa.array([worst[node][0]]), pa.array([worst[node][1].tobytes()], pa.binary())], ["node", "first", "sums", "fit", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of some centres as they come, one held at a time; and the rows that fit least, as many as there are centres."""
    node, first, total, worst = None, None, 0.0, []
    for batch in batches:
        node, first = batch.column("node").slice(0, 1), batch.column("first").slice(0, 1)
        for raw, fit, row in zip(batch.column("sums"), batch.column("fit").to_pylist(), batch.column("row").to_pylist(), strict=True):
            total = total + np.frombuffer(raw.as_buffer(), np.float64)
            worst.append((fit, row))
        worst = sorted(worst)[:CENTRE_ROWS]
    yield pa.RecordBatch.from_arrays([node, first, pa.array([total.tobytes()], pa.binary()), pa.array([b"".join(r for _, r in worst)], pa.binary())], ["node", "first", "sums", "rows"])


def kmeans(rows: DataFrame, many: dict[str, int], seed: int, iterations: int) -> dict[str, np.ndarray]:
    """Centres of spherical k-means of each node of ``rows`` (row_id, node, unit): assign and add up until no centre moves."""
    if not many:
        return {}
    spark = rows.sparkSession
    dim = rows.agg(F.max(F.size("unit"))).first()[0] or 1
    if ROUNDS * sum(max(LEAST_DRAWN, k) for k in many.values()) * dim * 8 > CENTRE_BYTES:
        raise ContractError(f"candidates of {sum(many.values())} centres of {dim} numbers exceed {CENTRE_BYTES} bytes")
    centres = starts(rows, many, seed)
    for _ in range(iterations):
        sums = rows.select("node", "unit").mapInArrow(_sums(spark.sparkContext.broadcast(centres)), "node string, first long, sums binary, fit double, row binary")
        parts: dict[str, list] = {}
        for r in sums.groupBy("node", "first").applyInArrow(_added, "node string, first long, sums binary, rows binary").collect():
            parts.setdefault(r["node"], []).append(r)
        moved = 0.0
        for node, found in parts.items():
            found.sort(key=lambda r: r["first"])
            held = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in found]).reshape(-1, dim + 1).copy()
            empty = np.flatnonzero(held[:, -1] == 0)
            loose = np.frombuffer(found[0]["rows"], np.float64).reshape(-1, dim)[: len(empty)]
            held[empty[: len(loose)], :-1] = loose  # an empty part starts again at a row that fits badly
            new = _normal(held[:, :-1])
            moved = max(moved, float(np.abs(new - centres[node]).max()))
            centres[node] = new
        if moved < 1e-9:
            break
    return centres


def assigned(rows: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with ``part``, the nearest centre of its node; -1 where the node has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part long"
    return rows.mapInArrow(_assign(rows.sparkSession.sparkContext.broadcast(centres)), schema)


def _margin(axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = np.zeros(batch.num_rows)
            for node, where, rows in _by_node(batch):
                along[where] = -(rows @ axes.value[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(along, 12))], [*batch.schema.names, "along"])

    return run


def sliced(rows: DataFrame, sizes: dict[str, int], limits: Limits) -> DataFrame:
    """``rows`` of nodes of more than n_max rows, with ``slice``: rows in the order of their margin between two centres.

    Two slices meet where the nearer centre changes, moved until both are within the limits; more are of equal size.
    """
    centres = kmeans(rows, dict.fromkeys(sizes, 2), limits.seed, limits.iterations)
    axes = {node: c[0] - c[-1] for node, c in centres.items()}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", along double"
    placed = numbered(rows.mapInArrow(_margin(rows.sparkSession.sparkContext.broadcast(axes)), schema), "along", "row_id", within="node", name="place")
    nearer = {r[0]: r[1] for r in placed.groupBy("node").agg(F.count_if(F.col("along") < 0)).collect()}
    cuts = []
    for node, n in sizes.items():
        parts = -(-n // limits.n_max)
        first = min(max(nearer.get(node, 0), limits.n_min, n - limits.n_max), n - limits.n_min, limits.n_max) if parts == 2 else 0
        cuts.append((node, n, parts, first))
    table = rows.sparkSession.createDataFrame(cuts, "node string, n long, parts long, first long")
    number = F.when(F.col("parts") == 2, (F.col("place") >= F.col("first")).cast("long")).otherwise(F.floor(F.col("place") * F.col("parts") / F.col("n")))
    return placed.join(F.broadcast(table), "node").withColumn("slice", number.cast("long")).drop("place", "along", "n", "parts", "first")


# grouping


@dataclass
class _Node:
    """What the driver keeps of a group of rows."""

    size: int
    depth: int
    level: int = 0
    split: str = "root"
    path: str = ""
    members: list[str] = field(default_factory=list)


_ROWS = ("at", "row_id", "unit", "node", "attached")


def _sizes(rows: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in rows.groupBy("node").agg(F.count(F.lit(1))).collect()}


def _codes(rows: DataFrame, nodes: list[str], name: str) -> DataFrame:
    """``rows`` of these nodes, with the node's number."""
    table = rows.sparkSession.createDataFrame(list(zip(nodes, range(len(nodes)), strict=True)), f"node string, {name} long")
    return rows.join(F.broadcast(table), "node")


def _chosen_levels(found: list, counts: dict[int, int], limits: Limits) -> dict[int, int]:
    """The widest level of each node at which it falls apart: two viable clusters, enough rows in them, none too large."""
    out: dict[int, int] = {}
    for r in sorted(found, key=lambda r: r["level"]):
        n = counts[r["part"]]
        if r["part"] not in out and r["viable"] >= 2 and r["held"] >= limits.viable_frac * n and r["largest"] < limits.largest_frac * n:
            out[r["part"]] = r["level"]
    return out


def _split_by_density(rows: DataFrame, open_: dict[str, _Node], limits: Limits) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(rows with ``child`` and ``loose``, accepted nodes: (level, children)) of one step of all open nodes."""
    levels = limits.levels()
    names = sorted(open_)
    mine = written(_told_apart(written(_codes(rows, names, "part"), "open"), limits.min_samples, levels[-1], levels[0]), "open-reach")
    # levels with too few rows in clusters need no components
    share = mine.groupBy("part").agg(*[F.avg((F.col("reach") <= e).cast("double")).alias(f"s{i}") for i, e in enumerate(levels)]).collect()
    tried = [(r["part"], i) for r in share for i in range(open_[names[r["part"]]].level, len(levels)) if r[f"s{i}"] >= limits.viable_frac]
    if not tried:
        return rows, {}
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(p, i, levels[i]) for p, i in tried], "part long, level int, eps double"))
    used = sorted({i for _, i in tried}, reverse=True)  # ascending distances
    links = knn.links(mine.where(F.col("core") <= levels[used[-1]]).join(F.broadcast(spark.createDataFrame([(p,) for p in {p for p, _ in tried}], "part long")), "part"), [levels[i] for i in used], "at", "unit", "core", "part")
    wide = links.join(mine.select(F.col("at").alias("a"), "part"), "a").join(table.withColumnRenamed("level", "tried"), "part")
    step = F.element_at(F.array(*[F.lit(levels[i]) for i in used]), F.col("level") + 1)
    # a component of each level: levels are told apart in the number of a node
    total = mine.count() + sum(n.size for n in open_.values()) + 1
    base = (mine.agg(F.max("at")).first()[0] or 0) + total
    at_level = lambda c: (F.col("tried").cast("long") * F.lit(base) + F.col(c)).alias(c)
    joined = components(wide.where(step <= F.col("eps")).select(at_level("a"), at_level("b")))
    joined = written(joined.select(F.floor(F.col("node") / base).cast("int").alias("level"), (F.col("node") % base).alias("at"), (F.col("label") % base).alias("label")), "open-labels")
    each = mine.select("at", "part", "core", "reach", "via").join(table, "part")
    label = joined.select(F.col("level").alias("__l"), F.col("at").alias("__at"), F.col("label").alias("__label"))
    from_ = F.when(F.col("core") <= F.col("eps"), F.col("at")).when(F.col("reach") <= F.col("eps"), F.col("via"))
    each = each.withColumn("from", from_).join(label, (F.col("__l") == F.col("level")) & (F.col("__at") == F.col("from")), "left").withColumn("cluster", F.coalesce("__label", "from"))
    clusters = written(each.where(F.col("cluster").isNotNull()).groupBy("part", "level", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "open-clusters")
    viable = F.col("n") >= limits.n_min
    found = clusters.groupBy("part", "level").agg(F.count_if(viable).alias("viable"), F.sum(F.when(viable, F.col("n")).otherwise(0)).alias("held"), F.max("n").alias("largest")).collect()
    chosen = _chosen_levels(found, {i: open_[n].size for i, n in enumerate(names)}, limits)
    if not chosen:
        return rows, {}
    picked = F.broadcast(spark.createDataFrame(sorted(chosen.items()), "part long, level int"))
    children = clusters.join(picked, ["part", "level"]).where(viable).withColumn("child", F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
    counts = {r[0]: r[1] for r in children.groupBy("part").agg(F.count(F.lit(1))).collect()}
    named = each.select("at", "part", "level", "cluster").join(picked, ["part", "level"]).join(children.select("part", "level", "cluster", "child"), ["part", "level", "cluster"], "left").select("at", "child")
    split = written(mine.join(picked, "part").drop("level").join(named, "at", "left"), "open-children")
    kept, loose = split.where(F.col("child").isNotNull()), split.where(F.col("child").isNull())
    near = knn.nearest(loose, kept, 1, "at", "unit", part="part").select(F.col("query").alias("at"), F.col("target").alias("__to"))
    beside = loose.drop("child").join(near, "at").join(kept.select(F.col("at").alias("__to"), "child"), "__to").drop("__to").withColumn("attached", F.lit(True))
    out = kept.select(*_ROWS, "child").unionAll(beside.select(*_ROWS, "child"))
    return written(out, "open-split"), {names[p]: (level, counts[p]) for p, level in chosen.items()}


def _merge_plan(leaves: dict[str, _Node], sums: dict[str, np.ndarray], firsts: dict[str, int], limits: Limits) -> tuple[dict[str, str], set[str]]:
    """(leaf -> leaf that takes it, leaves that are then too large): the smallest leaf goes to the most similar one with room, again and again.

    Small leaves wait in a queue by size, then first row. A leaf that takes another moves its centre and, while it is small, waits again
    with its new size. Where none has room, the most similar leaf becomes too large and takes no more; if all are, these take the rest.
    """
    names = sorted(leaves, key=lambda n: firsts[n])
    total = np.stack([sums[n] for n in names]).astype(np.float64)
    centre, size = _normal(total), [leaves[n].size for n in names]
    host, open_ = np.arange(len(names)), np.ones(len(names), bool)
    large: set[int] = set()
    queue = [(size[i], i) for i in range(len(names)) if size[i] < limits.n_min]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        if host[i] != i or size[i] != n:
            continue  # it has gone, or waits with another size
        others = open_.copy()
        others[i] = False
        if not others.any():
            others[list(large)] = True
        if not others.any():
            break
        like = np.where(others, centre @ centre[i], -np.inf)
        room = np.where(np.array(size) + n <= limits.n_max, like, -np.inf)
        j = int((room if np.isfinite(room).any() else like).argmax())
        host[host == i] = j
        open_[i] = False
        total[j] += total[i]
        centre[j] = _normal(total[j : j + 1])[0]
        size[j] += n
        if size[j] > limits.n_max:
            large.add(j)
            open_[j] = False
        elif size[j] < limits.n_min:
            heapq.heappush(queue, (size[j], j))
    return {names[i]: names[j] for i, j in enumerate(host.tolist()) if i != j}, {names[j] for j in large}


def _vector_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for node, _, rows in _by_node(batch):
            held[node] = held.get(node, 0) + rows.sum(0)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["node", "total"])


def _total(group: pa.Table) -> pa.Table:
    return pa.table({"node": group["node"][:1], "total": pa.array([sum(np.frombuffer(x, np.float64) for x in group["total"].to_pylist()).tobytes()], pa.binary())})


def _renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` whose node is renamed; a name for each group."""
    if not names:
        return rows
    table = rows.sparkSession.createDataFrame(sorted(names.items()), "node string, __to string")
    return rows.join(F.broadcast(table), "node", "left").withColumn("node", F.coalesce("__to", "node")).drop("__to")


def _by_centres(rows: DataFrame, many: dict[str, int], name: Column, limits: Limits) -> DataFrame:
    """k-means parts of each node as nodes of their own, none with more than n_max rows."""
    out = assigned(rows, kmeans(rows, many, limits.seed, limits.iterations)).withColumn("node", name).drop("part")
    out = written(out, "parts")
    large = {n: c for n, c in _sizes(out).items() if c > limits.n_max}
    if not large:
        return out
    some = F.col("node").isin(list(large))
    cut = sliced(out.where(some), large, limits).withColumn("node", F.concat("node", F.lit("/"), F.col("slice"))).drop("slice")
    return written(out.where(~some).select(*_ROWS).unionAll(cut.select(*_ROWS)), "parts-cut")


def grouped(df: DataFrame, limits: Limits, control: bool = False) -> DataFrame:
    """row_id, group_id, group_path, group_depth, group_split, group_size, attached for a table of row_id and embedding.

    Nodes larger than n_max are split by density where a distance tells them apart, else by k-means; groups smaller than
    n_min join others. ``control``: k-means of the whole table. Groups keep the limits if there are at least n_min rows and
    n_max is twice n_min.
    """
    require_limits(limits)
    rows = numbered(unit_rows(df).select("row_id", "unit"), "row_id", name="at").withColumns({"node": F.lit("0"), "attached": F.lit(False)}).select(*_ROWS)
    rows = written(rows, "rows")
    total = rows.count()
    empty = rows.limit(0)
    leaves: dict[str, _Node] = {}
    done = [empty]
    if control:
        k = max(1, round(total / (limits.fill * limits.n_max)))
        out = _by_centres(rows, {"0": k}, F.col("part").cast("string"), limits)
        done.append(out)
        leaves = {n: _Node(c, 1, split="kmeans", path=n.split("/")[0]) for n, c in _sizes(out).items()}
        open_: dict[str, _Node] = {}
    else:
        open_ = {"0": _Node(total, 0, path="0")}
    while open_:
        for node in [n for n, x in open_.items() if x.size <= limits.n_max]:
            leaves[node] = open_.pop(node)
            done.append(rows.where(F.col("node") == node))
        if not open_:
            break
        rows = rows.where(F.col("node").isin(list(open_)))
        split, accepted = _split_by_density(rows, open_, limits)
        left = {n: x for n, x in open_.items() if n not in accepted}
        if left:
            parts = _by_centres(rows.where(F.col("node").isin(list(left))), {n: math.ceil(x.size / (limits.fill * limits.n_max)) for n, x in left.items()}, F.concat("node", F.lit(".k"), F.col("part")), limits)
            done.append(parts)
            for n, c in _sizes(parts).items():
                leaves[n] = _Node(c, left[n.rsplit(".k", 1)[0]].depth + 1, split="kmeans", path=n.split("/")[0])
        if not accepted:
            break
        rows = split.withColumn("node", F.concat_ws(".", "node", "child")).select(*_ROWS)
        of = {f"{n}.{c}": n for n, (_, many) in accepted.items() for c in range(many)}
        open_ = {n: _Node(c, open_[of[n]].depth + 1, accepted[of[n]][0] + 1, "dbscan", n) for n, c in _sizes(rows).items()}
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more.select(*_ROWS))
    out = written(out, "leaves")
    while any(x.size < limits.n_min for x in leaves.values()) and len(leaves) > 1:
        sums = {r[0]: np.frombuffer(r[1], np.float64) for r in out.select("node", "unit").mapInArrow(_vector_sums, "node string, total binary").groupBy("node").applyInArrow(_total, "node string, total binary").collect()}
        firsts = {r[0]: r[1] for r in out.groupBy("node").agg(F.min("at")).collect()}
        goes, large = _merge_plan(leaves, sums, firsts, limits)
        if not goes:
            break
        out = written(_renamed(out, goes), "merged")
        sizes = _sizes(out)
        leaves = {n: _Node(sizes[n], x.depth, split=x.split if n not in goes.values() or x.split.endswith("+merged") else f"{x.split}+merged", path=x.path) for n, x in leaves.items() if n in sizes}
        if large:
            some = F.col("node").isin(list(large))
            cut = sliced(out.where(some), {n: sizes[n] for n in large}, limits).withColumn("node", F.concat("node", F.lit("+"), F.col("slice"))).drop("slice")
            out = written(out.where(~some).select(*_ROWS).unionAll(cut.select(*_ROWS)), "merged-cut")
            for n, c in _sizes(out).items():
                if n not in leaves:
                    x = leaves[n.rsplit("+", 1)[0]]
                    leaves[n] = _Node(c, x.depth, split=x.split, path=x.path)
            leaves = {n: x for n, x in leaves.items() if n not in large}
    about = F.broadcast(df.sparkSession.createDataFrame([(n, x.path, x.depth, x.split) for n, x in leaves.items()], "node string, group_path string, group_depth int, group_split string"))
    named = number_groups(out.select("row_id", "node", "attached", "at"), ["node"], "at").join(about, "node")
    return named.select("row_id", "group_id", "group_path", "group_depth", "group_split", "group_size", "attached")


# groups beside each other


def adjacency(neighbours: DataFrame, groups: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, contacts): unordered pairs of different groups whose rows are neighbours at least ``least`` times. neighbours: (query, target)."""
    g = groups.select("row_id", "group_id")
    both = neighbours.join(g.select(F.col("row_id").alias("query"), F.col("group_id").alias("ga")), "query").join(g.select(F.col("row_id").alias("target"), F.col("group_id").alias("gb")), "target")
    pairs = both.where(F.col("ga") != F.col("gb")).groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count(F.lit(1)).alias("contacts"))
    return pairs.where(F.col("contacts") >= least)


def colours(edges: list[tuple[int, int, float]], nodes: int, palette: int = 10) -> list[int]:
    """A colour for each group: most constrained group first; where all colours are taken, the one of least contact.

    A heap holds an entry for each change of a group's constraint and older entries are skipped, so time grows with the links.
    """
    beside: list[dict[int, float]] = [{} for _ in range(nodes)]
    for a, b, w in edges:
        beside[a][b] = beside[a].get(b, 0) + w
        beside[b][a] = beside[b].get(a, 0) + w
    out = [-1] * nodes
    seen: list[set[int]] = [set() for _ in range(nodes)]
    waiting = [(0, -len(beside[i]), i) for i in range(nodes)]
    heapq.heapify(waiting)
    while waiting:
        constrained, _, i = heapq.heappop(waiting)
        if out[i] >= 0 or -constrained != len(seen[i]):
            continue
        cost = [0.0] * palette
        for x, w in beside[i].items():
            if out[x] >= 0:
                cost[out[x]] += w
        out[i] = cost.index(min(cost))
        for x in beside[i]:
            if out[x] < 0 and out[i] not in seen[x]:
                seen[x].add(out[i])
                heapq.heappush(waiting, (-len(seen[x]), -len(beside[x]), x))
    return out


def coloured(contacts: DataFrame, groups: DataFrame, palette: int = 10) -> DataFrame:
    """(group_id, group_colour) of all ``groups`` (group_id) by contacts (a, b, contacts): each connected part of the map in a task of its own.

    A colour depends on groups that can be reached alone, so parts are independent and the result is that of one pass over all groups. A task
    holds the links of one part: links of groups, of which each has many rows. Groups without contacts have colour 0. Null ids have no colour.
    """
    links = contacts.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("contacts").cast("double").alias("contacts")).where("a <> b AND contacts IS NOT NULL")
    links = written(links, "contacts")
    parts = components(links.select("a", "b"))

    def paint(part: pa.Table) -> pa.Table:
        a, b = part["a"].to_numpy(), part["b"].to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        # links in order, so that sums of contacts don't depend on how rows came
        edges = sorted(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), part["contacts"].to_pylist(), strict=True))
        return pa.table({"group_id": pa.array(ids, pa.int64()), "group_colour": pa.array(colours(edges, len(ids), palette), pa.int32())})

    painted = links.join(parts, F.col("a") == F.col("node")).select("label", "a", "b", "contacts").groupBy("label").applyInArrow(paint, "group_id long, group_colour int")
    every = groups.select(F.col("group_id").cast("long").alias("group_id")).where("group_id IS NOT NULL").distinct()
    return every.join(painted, "group_id", "left").select("group_id", F.coalesce("group_colour", F.lit(0)).alias("group_colour"))
