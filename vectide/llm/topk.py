"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers, sorted by length and cut into buckets of bounded size. Queries travel in
blocks, in waves of bounded size, past buckets that stay. The longest bucket first gives every query a threshold: its k-th score so far. For any other bucket the
threshold becomes a local cosine threshold, theta / (|q| * longest length in the bucket). Above 1, the bucket
is skipped; if it is high, intervals of the query's largest coordinates select candidates from sorted lists; if
it is low, only lengths prune. What is left is verified by exact integer products, so no result is lost.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a null
vec_id; an inner product beyond 64 bits stops the query with OverflowError, as it would be ranked wrongly; of rows that repeat a vec_id the smallest quantised vector counts; shorter vectors are padded with zeros;
equal scores go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import bounded_batches, discard, save, table, trimmed

#: Vectors in a bucket and queries in a block: what a task holds of either.
BUCKET_ROWS, QUERY_ROWS = 4096, 512
#: Bytes of query blocks that are gathered and broadcast at once.
WAVE_BYTES = 32 << 20
#: Coordinates looked at, and the share of length candidates below which coordinate pruning is chosen.
FOCUS, COORDINATE_SHARE = 3, 0.25

PACK = "block long, ids binary, flat binary, kind string, dim int, longest double"
HITS = "query_id long, vec_id long, score long"


def quantise(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each usable vector, one row for each id."""
    usable = F.forall(F.col("e"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & usable)
        .select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(scale))).cast("array<long>").alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _packer(rows: int):
    """Sorted rows of a partition -> packed blocks of at most ``rows`` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held, count = TaskContext.get().partitionId() << 32, 0, [], 0
        source = iter(batches)
        while True:
            batch = next(source, None)
            if batch is not None and batch.num_rows:
                held.append(batch.select(["vec_id", "v", "norm"]))
                count += batch.num_rows
            while count >= rows or batch is None and count:
                all_ = pa.Table.from_batches(held).combine_chunks()
                part, rest = all_.slice(0, rows), all_.slice(rows)
                m = _matrix(part["v"].combine_chunks())
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([base + made], pa.int64()), "ids": [part["vec_id"].to_numpy().astype("<i8").tobytes()],
                    "flat": [m.astype(kind := _narrow(m)).tobytes()], "kind": [kind], "dim": pa.array([m.shape[1]], pa.int32()), "longest": [float(part["norm"].to_numpy().max())],
                })
                made += 1
                held, count = rest.to_batches(), rest.num_rows
            if batch is None:
                return

    return pack


def _narrow(m: np.ndarray) -> str:
    """The smallest of three integer types that holds all components."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _unpack(ids: bytes, flat: bytes, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(flat, kind).reshape(len(i), dim).astype(np.int64)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 where it is exact."""
    d = min(q.shape[1], p.shape[1])
    q, p = q[:, :d], p[:, :d]
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(d, 1) < 2.0**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ p.astype(object).T
    if any(not -(2**63) <= x < 2**63 for x in wide.ravel().tolist()):
        raise OverflowError("an inner product does not fit 64 bits: use a smaller scale")
    return wide.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def search_bucket(qi: np.ndarray, qm: np.ndarray, theta: np.ndarray, pi: np.ndarray, pm: np.ndarray, k: int) -> tuple[list, list, list]:
    """Best k of a bucket for each query, of those whose score reaches the query's threshold (-inf: none yet)."""
    pn, qn = np.sqrt((pm.astype(float) ** 2).sum(1)), np.sqrt((qm.astype(float) ** 2).sum(1))
    order = np.argsort(-pn, kind="stable")
    pi, pm, pn = pi[order], pm[order], pn[order]
    longest, slack = float(pn.max(initial=0.0)), 1 + 1e-9
    out: tuple[list, list, list] = ([], [], [])

    def give(j: int, ids: np.ndarray, score: np.ndarray) -> None:
        ok = (ids != qi[j]) & (score >= theta[j])
        ids, score = ids[ok], score[ok]
        best = _best(score, ids, k)
        out[0].append(np.full(len(best), qi[j]))
        out[1].append(ids[best])
        out[2].append(score[best])

    alive = np.flatnonzero((theta <= 0) | (qn * longest * slack + 1e-6 >= theta))
    by_length, reach = [], {}
    lists = None
    for j in alive:
        # length pruning: only vectors with |p| >= theta / |q| can reach theta
        n = len(pn) if theta[j] <= 0 else int(np.searchsorted(-pn, -(theta[j] / (qn[j] * slack) - 1e-6), side="right"))
        cosine = theta[j] / (qn[j] * longest) if theta[j] > 0 and longest > 0 else 0.0
        if cosine > 0.3 and n > 64:
            if lists is None:
                unit = pm / np.maximum(pn, 1e-300)[:, None]
                lists = (unit, np.argsort(unit, axis=0), np.sort(unit, axis=0))
            unit, by, sorted_ = lists
            c = min(cosine, 1.0)
            u = qm[j, : unit.shape[1]] / qn[j]
            f = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
            half = np.sqrt(np.maximum(0, 1 - u[f] ** 2) * max(0.0, 1 - c * c)) + 1e-9
            # a unit p with u.p >= c' >= c has p_f inside these bounds; widened where u_f itself exceeds c
            low = np.where(-u[f] >= c, -1.0, c * u[f] - half)
            high = np.where(u[f] >= c, 1.0, c * u[f] + half)
            ends = [(np.searchsorted(sorted_[:, x], a, "left"), np.searchsorted(sorted_[:, x], b, "right")) for x, a, b in zip(f, low, high, strict=True)]
            pick = min(range(len(f)), key=lambda i: ends[i][1] - ends[i][0])
            if ends[pick][1] - ends[pick][0] < COORDINATE_SHARE * n:
                rows = by[ends[pick][0] : ends[pick][1], f[pick]]
                for i in range(len(f)):
                    rows = rows[(unit[rows, f[i]] >= low[i]) & (unit[rows, f[i]] <= high[i])]
                rows = rows[rows < n]
                give(j, pi[rows], _products(qm[j : j + 1], pm[rows])[0])
                continue
        by_length.append(j)
        reach[j] = n
    for at in range(0, len(by_length), 128):
        part = by_length[at : at + 128]
        n = max(reach[j] for j in part)
        scores = _products(qm[part], pm[:n])
        for j, row in zip(part, scores, strict=True):
            give(j, pi[: reach[j]], row[: reach[j]])
    return out


class _Held:
    """A block of queries with its best hits so far and the threshold that they give each query."""

    def __init__(self, row, k: int) -> None:
        self.ids, self.matrix = _unpack(row["q_ids"], row["q_flat"], row["q_kind"], row["q_dim"])
        self.theta = np.frombuffer(row["theta"], "<f8").copy() if row["theta"] else np.full(len(self.ids), -np.inf)
        self.length, self.k = np.sqrt((self.matrix.astype(float) ** 2).sum(1)), k
        self.order = np.argsort(self.ids)
        self.hits = [np.zeros(0, np.int64)] * 3

    def least(self) -> float:
        """The length that a vector needs for some query."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.theta > 0, self.theta / (self.length * (1 + 1e-9)) - 1e-6, 0.0)
        return float(need.min(initial=np.inf))

    def search(self, pi: np.ndarray, pm: np.ndarray) -> None:
        found = search_bucket(self.ids, self.matrix, self.theta, pi, pm, self.k)
        if not found[0]:
            return
        query, ids, score = (np.concatenate([old, *new]) for old, new in zip(self.hits, found, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.hits = [query[keep], ids[order][keep], score[order][keep]]
        last = place == self.k - 1
        at = self.order[np.searchsorted(self.ids[self.order], query[last])]
        self.theta[at] = np.maximum(self.theta[at], score[order][last])


def _searcher(wave, k: int):
    """All buckets of a task past a wave of query blocks; hits of one bucket tighten the thresholds for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_Held(row, k) for row in wave.value]
        for batch in batches:
            for r in batch.to_pylist():
                pi, pm = _unpack(r["ids"], r["flat"], r["kind"], r["dim"])
                for block in blocks:
                    if r["longest"] >= block.least():
                        block.search(pi, pm)
        for block in blocks:
            if len(block.hits[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in block.hits], ["query_id", "vec_id", "score"])

    return trimmed(run)


def _thresholds(bucket, k: int):
    """Query blocks -> the same blocks with each query's threshold from one bucket, and the length that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, pm = _unpack(*bucket.value) if bucket.value else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
        for batch in batches:
            for r in batch.to_pylist():
                block = _Held(r | {"theta": None}, k)
                block.search(pi, pm)
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]], pa.int64()), "q_ids": [r["q_ids"]], "q_flat": [r["q_flat"]], "q_kind": [r["q_kind"]], "q_dim": pa.array([r["q_dim"]], pa.int32()), "theta": [block.theta.astype("<f8").tobytes()], "least": [block.least()]})

    return trimmed(run)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each query the k largest integer products among ``vectors``: query_id, rank, vec_id, score.

    Both inputs come from :func:`quantise`. A query never finds its own vec_id.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=1024, size=8 << 20)
    stored = save(vectors, "topk-vectors")
    total = stored.count()
    width = max(1, -(-total // bucket_rows))
    by_norm = (F.col("norm").desc(), F.col("vec_id"))
    buckets = save(stored.repartitionByRange(width, *by_norm).sortWithinPartitions(*by_norm).mapInArrow(_packer(bucket_rows), PACK), "topk-buckets")
    blocks = queries.repartitionByRange(max(1, -(-total // (20 * query_rows))), *by_norm).sortWithinPartitions(*by_norm).mapInArrow(_packer(query_rows), PACK)
    blocks = blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("kind").alias("q_kind"), F.col("dim").alias("q_dim"))
    # the longest bucket is one row of at most bucket_rows vectors: its size is bounded, so it is broadcast
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    first = buckets.orderBy(F.desc("longest"), "block").select("ids", "flat", "kind", "dim").first()
    one = spark.sparkContext.broadcast(None if first is None else (bytes(first["ids"]), bytes(first["flat"]), first["kind"], first["dim"]))
    known = save(blocks.mapInArrow(_thresholds(one, k), "q_block long, q_ids binary, q_flat binary, q_kind string, q_dim int, theta binary, least double"), "topk-queries")
    # blocks travel in waves of bounded bytes; buckets stay where they are, and those too short for a whole wave are not read. The
    # list of blocks has 24 bytes for query_rows queries
    waves: list[list] = []
    held = WAVE_BYTES
    for r in known.select("q_block", "least", (F.length("q_flat") + F.length("q_ids") + F.length("theta")).alias("size")).orderBy("least", "q_block").collect():
        if held + r["size"] > WAVE_BYTES:
            waves.append([])
            held = 0
        waves[-1].append(r)
        held += r["size"]
    hits = spark.createDataFrame([], HITS)
    for wave in waves:
        rows = [r.asDict() for r in known.where(F.col("q_block").isin([r["q_block"] for r in wave])).collect()]
        near = buckets.where(F.col("longest") >= min(r["least"] for r in wave))
        sent = spark.sparkContext.broadcast(rows)
        del rows
        hits = hits.unionAll(save(near.mapInArrow(_searcher(sent, k), HITS), "topk-hits"))
        sent.destroy()  # one wave at a time is held, on the driver and by workers
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    discard(stored, buckets, known)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20; k = 20; components floor(64 * x)."""
    vectors = quantise(table(spark, sf_dir, "embeddings"), 64.0)
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


OP9_SQL = """
WITH usable AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), one AS (SELECT vec_id, min(v) AS v FROM usable GROUP BY vec_id),
flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM one),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
