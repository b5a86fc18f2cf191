"""A metric index: rows of a table lie in cells around pivots, and a query meets the cells that it can reach.

Pivots are a seeded sample of bounded size. Every target goes to its nearest pivot, and a cell keeps the least and the largest
distance of its rows to the pivot. By the triangle inequality a query at distance D of a pivot is at least D - high and low - D away from
each row of that cell, and at least (D - nearest) / 2, where nearest is its distance to its own pivot. A cell that is further
than a query looks is not met. For the k nearest, a query looks as far as the cells that surely hold k rows reach.

Cells are cut into tiles and the queries of a tile into chunks, both of bounded size; a chunk and its tile meet in one task, as a
cogrouped pair. So no vector passes the driver but the pivots, no group grows with the table or with a hot cell, and a lost executor
costs the pairs it had. What the driver holds beside the pivots is a row of numbers for each cell, of at most CELLS cells.

Where queries can leave out few tiles, a shuffle by tile would carry every query once for each tile. A drawn sample of the queries tells; such
sides are packed into blocks and written, and meet as a cartesian product of the two tables, whose tasks read them and shuffle nothing
(:func:`past`). A task has all blocks of a part of the targets, of bounded size, for each of its blocks of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.sources.scratch import written

#: Rows of a tile and of a chunk of queries, bytes of pivots, and cells of all parts together.
TILE_ROWS, PIVOT_BYTES, CELLS = 4096, 16 << 20, 100_000
#: Queries that are drawn to tell how many tiles one meets, and tiles a query up to which sides meet by a shuffle.
DRAWN, MET = 2048, 8
#: Rows and bytes of a block of queries and of targets, and bytes of targets that a task has at once.
QUERY_ROWS, TARGET_ROWS, BLOCK_BYTES, TARGET_BYTES = 8192, 4096, 8 << 20, 128 << 20
#: Pivots that are put in an order, and least rows of a block of queries.
CHAINED, LEAST_ROWS = 20_000, 1024
#: Added to what a query looks for, beside the rounding of scores: distances of equal unit vectors are up to 1e-7.
SLACK = 1e-6


@dataclass
class Side:
    """Rows of one side of a pair as arrays. ``v``: unit vectors, or plain ones where distances are Euclidean."""

    id: np.ndarray
    v: np.ndarray
    part: np.ndarray
    floor: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.id)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def distance(cosine: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def apart(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)) if plain else distance(a @ b.T)


def _gaps(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to a point."""
    return np.sqrt(np.maximum(1 + point @ point - 2 * (rows @ point), 0))


def reachable(q: np.ndarray, t: np.ndarray, far: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of both sides (unit vectors) may be within ``far`` of one of the other: by the distance to the ball around the other side."""
    if not len(q) or not len(t) or np.isinf(far).any():
        return np.ones(len(q), bool), np.ones(len(t), bool)
    far = wider(far, digits)
    centre = t.mean(0)
    some = _gaps(q, centre) - _gaps(t, centre).max() <= far
    if not some.any():
        return some, np.zeros(len(t), bool)
    centre = q[some].mean(0)
    return some, _gaps(t, centre) - _gaps(q[some], centre).max() <= far[some].max()


def wider(far: np.ndarray, digits: int) -> np.ndarray:
    """A distance within which are all rows whose rounded score is that of a row within ``far``."""
    return np.sqrt(far**2 + 4.0 * 10.0**-digits) + 2 * 10.0**-digits + SLACK


def chain(points: np.ndarray) -> np.ndarray:
    """An order in which each point is followed by the nearest one that is left."""
    left, at = np.arange(len(points)), 0
    rows, out = points.astype(np.float32), []
    while len(left):
        out.append(int(left[at]))
        here, left, rows = rows[at], np.delete(left, at), np.delete(rows, at, 0)
        at = int(((rows - here) ** 2).sum(1).argmin()) if len(left) else 0
    return np.array(out, np.int64)


def side(batch: pa.RecordBatch | pa.Table, plain: bool = False) -> Side:
    """A batch of the columns id, v, part, floor and value. Vectors come as lists, or as bytes of doubles that are ready."""
    column = batch.column("v")
    if pa.types.is_binary(column.type):
        rows = column.to_pylist()
        v = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
    else:
        v = matrix(column)
        v = v if plain or not len(v) else unit(v)
    return Side(np.array(batch.column("id").to_pylist()), v, *(batch.column(c).to_numpy() for c in ("part", "floor", "value")))


COLUMNS = "v binary, part long, floor double, value long"


def _packed(s: Side, rows: np.ndarray, ids: pa.Array) -> list[pa.Array]:
    """Arrays of id and COLUMNS for some rows of a side."""
    v = np.ascontiguousarray(s.v[rows])
    width = v.shape[1] * 8 if v.ndim == 2 else 0
    raw = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int64)), pa.py_buffer(v.tobytes())]).cast(pa.binary())
    return [ids.take(pa.array(rows)), raw, pa.array(s.part[rows]), pa.array(s.floor[rows]), pa.array(s.value[rows])]


@dataclass
class Cells:
    """The cells of a table: part, pivot, rows, least and largest distance, largest and least floor, first tile and number of tiles."""

    part: np.ndarray
    pivot: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray
    first: np.ndarray
    tiles: np.ndarray


def _placed(pivots, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            if batch.num_rows:
                s = side(batch, plain)
                d = apart(s.v, p, plain)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*_packed(s, np.arange(len(s)), batch.column("id")), pa.array(at), pa.array(d[np.arange(len(at)), at])], ["id", "v", "part", "floor", "value", "pivot", "gap"])

    return run


def looks(d: np.ndarray, own: np.ndarray, cells: Cells, some: np.ndarray, k: int | None, eps: float, floors: bool, digits: int) -> np.ndarray:
    """Which of ``some`` cells each query meets. ``d``: distances to their pivots; ``own``: to the nearest pivot of all; ``eps``: no query looks further, if it is not 0."""
    if k is None:
        limit = np.full(len(d), eps)
    else:
        far = d + cells.high[some]
        if floors:
            far = np.maximum(far, cells.most[some])
        order = np.argsort(far, axis=1)
        held = np.cumsum(cells.rows[some][order], axis=1)
        enough = held >= k
        limit = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(d)), enough.argmax(1)], np.inf)
    if k is not None and eps:
        limit = np.minimum(limit, eps)
    limit = wider(limit, digits)[:, None]
    out = (d - cells.high[some] <= limit) & (cells.low[some] - d <= limit) & (d - own[:, None] <= 2 * limit)
    return out & (cells.least[some] <= limit) if floors else out


def _routed(sent, k: int | None, eps: float, floors: bool, plain: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = sent.value
        begin = dict(zip(*np.unique(cells.part, return_index=True), strict=True))
        end = dict(zip(*np.unique(cells.part[::-1], return_index=True), strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            s = side(batch, plain)
            d = apart(s.v, pivots, plain)
            own, lists = d.min(1), [np.zeros(0, np.int64)] * len(s)
            for part in np.unique(s.part).tolist():
                if part not in begin:
                    continue
                mine, some = np.flatnonzero(s.part == part), np.arange(begin[part], len(cells.part) - end[part])
                meets = looks(d[np.ix_(mine, cells.pivot[some])], own[mine], cells, some, k, eps, floors, digits)
                for i, row in zip(mine.tolist(), meets, strict=True):
                    of = some[row]
                    lists[i] = np.repeat(cells.first[of] - np.cumsum(cells.tiles[of]) + cells.tiles[of], cells.tiles[of]) + np.arange(int(cells.tiles[of].sum()))
            sizes = np.array([len(x) for x in lists])
            tiles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([*_packed(s, np.arange(len(s)), batch.column("id")), tiles], ["id", "v", "part", "floor", "value", "tiles"])

    return run


def index(targets: DataFrame, plain: bool = False, tile_rows: int | None = None) -> tuple[DataFrame, np.ndarray, Cells] | None:
    """(targets with their tile, written; pivots; cells); None for no targets. ``targets``: id, v (list), part, floor, value."""
    spark, tile_rows = targets.sparkSession, tile_rows or TILE_ROWS
    kind = targets.schema["id"].dataType.simpleString()
    n, dim, parts = targets.agg(F.count(F.lit(1)), F.max(F.size("v")), F.countDistinct("part")).first()
    if not n:
        return None
    many = max(1, min(-(-2 * n // tile_rows), PIVOT_BYTES // (8 * dim), CELLS // parts))
    # the rows of smallest hash, the same whatever the partitions are: at most PIVOT_BYTES
    drawn = targets.orderBy(F.xxhash64("id"), "id").limit(many).select("v").collect()
    pivots = np.array([r["v"] for r in drawn], np.float64)
    pivots = pivots if plain else unit(pivots)
    # cells, and so tiles, that are numbered one after another lie beside each other
    pivots = pivots[chain(pivots)] if len(pivots) <= CHAINED else pivots
    placed = written(targets.mapInArrow(_placed(spark.sparkContext.broadcast(pivots), plain), f"id {kind}, {COLUMNS}, pivot long, gap double"), "cells")
    about = placed.groupBy("part", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.min("floor").alias("least"), F.max("floor").alias("most"))
    found = sorted(tuple(r) for r in about.collect())  # a row for each cell, at most CELLS
    cells = Cells(*(np.array(c) for c in zip(*found, strict=True)), None, None)
    cells.tiles = -(-cells.rows // tile_rows)
    cells.first = np.cumsum(cells.tiles) - cells.tiles
    table = spark.createDataFrame([(p, c, f, t) for (p, c, *_), f, t in zip(found, cells.first.tolist(), cells.tiles.tolist(), strict=True)], "part long, pivot long, first long, many long")
    tile = F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))
    return placed.join(F.broadcast(table), ["part", "pivot"]).select("id", "v", "part", "floor", "value", tile.alias("tile")), pivots, cells


def routes(queries: DataFrame, pivots: np.ndarray, cells: Cells, k: int | None, eps: float = 0.0, floors: bool = False, plain: bool = False, digits: int = 9) -> DataFrame:
    """``queries`` with ``tiles``, the tiles that each one meets, written."""
    spark, kind = queries.sparkSession, queries.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((pivots, cells))
    return written(queries.mapInArrow(_routed(sent, k, eps, floors, plain, digits), f"id {kind}, {COLUMNS}, tiles array<long>"), "routes")


def meet(routed: DataFrame, tiled: DataFrame, kernel: Callable[[Side, Side], pa.Table], schema: str, chunk_rows: int | None = None) -> DataFrame:
    """What ``kernel`` makes of each chunk of queries and the tile that it meets."""
    chunk_rows = chunk_rows or TILE_ROWS
    each = routed.withColumn("tile", F.explode("tiles")).drop("tiles")
    chunks = each.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
    left = each.join(chunks, "tile").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")
    right = tiled.join(chunks, "tile").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        return kernel(side(q), side(t))

    return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(run, schema)


def crowded(queries: DataFrame, pivots: np.ndarray, cells: Cells, k: int | None, eps: float = 0.0, floors: bool = False, plain: bool = False, digits: int = 9) -> bool:
    """Whether a query meets more than MET tiles, and the mean of a sample says so. No result depends on it."""
    if cells.tiles.sum() <= MET:
        return False
    drawn = queries.orderBy(F.xxhash64("id"), "id").limit(DRAWN)
    kind = queries.schema["id"].dataType.simpleString()
    sent = queries.sparkSession.sparkContext.broadcast((pivots, cells))
    met = drawn.mapInArrow(_routed(sent, k, eps, floors, plain, digits), f"id {kind}, {COLUMNS}, tiles array<long>").agg(F.avg(F.size("tiles"))).first()[0]
    return (met or 0.0) > MET


def _blocks(rows: int, plain: bool):
    """Rows -> blocks: a row each, with its vectors as bytes and its least and largest part."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        s = side(t, plain)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x.combine_chunks()) for x in (t["id"], s.part, s.floor, s.value)]
        return pa.RecordBatch.from_arrays([lists[0], pa.array([s.v.tobytes()], pa.binary()), *lists[1:], pa.array([int(s.part.min())]), pa.array([int(s.part.max())])], ["ids", "v", "parts", "floors", "values", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, rows - many)
                held.append(some)
                at, many = at + some.num_rows, many + some.num_rows
                if many == rows:
                    yield packed(held)
                    held, many = [], 0
        if held:
            yield packed(held)

    return run


def _side_at(batch: pa.RecordBatch, i: int, name: str) -> Side:
    ids, parts, floors, values = (batch.column(f"{name}_{c}")[i].values for c in ("ids", "parts", "floors", "values"))
    v = np.frombuffer(batch.column(f"{name}_v")[i].as_buffer(), np.float64).reshape(len(ids), -1)
    return Side(np.array(ids.to_pylist()), v, *(x.to_numpy() for x in (parts, floors, values)))


def past(queries: DataFrame, targets: DataFrame, kernel: Callable, schema: str, plain: bool = False, pivots: np.ndarray | None = None) -> DataFrame:
    """What ``kernel`` makes of each block of queries and the blocks of targets that pass it, one after another.

    With the ``pivots`` of targets (with their tile), rows of both sides that lie together come in the same blocks, so that a kernel can pass over
    blocks that are out of its reach; blocks of queries are dealt to the tasks, as such blocks are not alike in what they cost.

    ``kernel``: begin(queries) gives what is known of them, add(queries, known, targets) adds to it, done(queries, known) gives rows. Rows of
    both sides: id, v (list), part, floor, value. Blocks without a part in common don't meet.
    """
    kind = queries.schema["id"].dataType.simpleString()
    block = f"ids array<{kind}>, v binary, parts array<long>, floors array<double>, values array<long>, low long, high long"

    cores = queries.sparkSession.sparkContext.defaultParallelism

    def packed(rows: DataFrame, most: int, name: str, order: str | None, dealt: bool = False) -> tuple[DataFrame, int]:
        raw = F.octet_length("v") / 8 if dict(rows.dtypes)["v"] == "binary" else F.size("v")
        n, dim, many = rows.agg(F.count(F.lit(1)), F.max(raw), F.countDistinct("part")).first()
        tasks = 2 * cores
        if dealt:  # several blocks for each core, as far as they are not small
            most = min(most, max(LEAST_ROWS, -(-n // (4 * cores))))
        if order:
            rows = rows.repartitionByRange(tasks, "part", order, F.xxhash64("id")).sortWithinPartitions("part", order)
        else:  # rows of a part in few blocks
            rows = rows.repartitionByRange(tasks, "part", F.xxhash64("id")).sortWithinPartitions("part") if many > 1 else rows.repartition(tasks, "id")
        made = rows.select("id", "v", "part", "floor", "value").mapInArrow(_blocks(max(1, min(most, int(BLOCK_BYTES // (8 * (dim or 1))))), plain), block)
        made = written(made.repartition(4 * cores) if dealt else made, name)
        return made, made.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0]

    if pivots is not None:
        sent = queries.sparkSession.sparkContext.broadcast(pivots)
        queries = written(queries.mapInArrow(_placed(sent, plain), f"id {kind}, {COLUMNS}, pivot long, gap double"), "query-cells")
    q, _ = packed(queries, QUERY_ROWS, "query-blocks", None if pivots is None else "pivot", pivots is not None)
    t, size = packed(targets, TARGET_ROWS, "target-blocks", None if pivots is None else "tile")
    q, t = (x.select(*[F.col(c).alias(f"{n}_{c}") for c in x.columns]) for n, x in (("q", q), ("t", t)))
    pairs = q.join(t.coalesce(max(1, -(-size // TARGET_BYTES))).hint("shuffle_replicate_nl"), (F.col("q_low") <= F.col("t_high")) & (F.col("t_low") <= F.col("q_high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("q_ids")[i].values
                if last is None or not name.equals(last):
                    if state is not None:
                        yield from kernel.done(*state).to_batches()
                    last, q = name, _side_at(batch, i, "q")
                    state = (q, kernel.begin(q))
                kernel.add(*state, _side_at(batch, i, "t"))
        if state is not None:
            yield from kernel.done(*state).to_batches()

    return pairs.drop("q_low", "q_high", "t_low", "t_high").mapInArrow(run, schema)


def products(routed: DataFrame, tiled: DataFrame) -> int:
    """Pairs of a query and a target that :func:`meet` compares."""
    size = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return routed.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("q")).join(size, "tile").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0))).first()[0]
