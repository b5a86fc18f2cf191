"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.sources.scratch import written

#: Counted links up to which one task finds the components: 16 bytes each.
TASK_LINKS = 1_000_000
#: Links that a task holds while it thins them: 24 bytes each.
HELD_LINKS = 4_000_000
#: Tasks whose forests one task puts together.
MERGED = 8


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    nodes, label = _labels(np.concatenate(parts) if parts else np.zeros((0, 2), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])


def _labels(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each one reaches)."""
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while len(at):
        # both ends take the smaller label, then labels follow labels to their root
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[at[:, 0]], low)
        np.minimum.at(new, label[at[:, 1]], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label] if len(nodes) else nodes


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, level) of a task that join the same nodes at each level as all of its links, one for each node and level: sent where they stay many."""
    held, many = [], 0

    def thinned() -> list[np.ndarray]:
        a, b, level = np.concatenate(held, axis=1)
        out = []
        for n in np.unique(level).tolist():
            nodes, label = _labels(np.stack([a[level == n], b[level == n]], 1))
            some = nodes != label
            out.append(np.stack([nodes[some], label[some], np.full(int(some.sum()), n)]))
        return out

    def sent(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b, level in parts:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(level.astype(np.int32))], ["a", "b", "level"])

    for batch in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        many += batch.num_rows
        if many > HELD_LINKS:
            held = thinned()
            many = sum(x.shape[1] for x in held)
            if many > HELD_LINKS // 2:
                yield from sent(held)
                held, many = [], 0
    if held:
        yield from sent(thinned())


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b, level) that join the same nodes at each level, written: forests of MERGED tasks are put together until few are left, or they stay as many.

    Each task sends a forest over the nodes that it has met, so links would else grow with the tasks times the nodes.
    """
    made = written(links.mapInArrow(forest, links.schema), "forests")
    many = made.count()
    while many and (parts := made.rdd.getNumPartitions()) > 1:
        fewer = written(made.coalesce(-(-parts // MERGED)).mapInArrow(forest, links.schema), "forests")
        left = fewer.count()
        made, stays, many = fewer, 2 * left > many, left
        if stays:
            break
    return made


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b): the smallest node that each one reaches."""
    links = written(links.where(F.col("a") != F.col("b")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    if links.count() <= TASK_LINKS:
        return links.coalesce(1).mapInArrow(_union, "node long, label long")
    both = written(links.unionAll(links.select("b", "a")).distinct(), "links-both")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = written(hooked.join(jump, "next").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels
