"""Line dedup with two Bloom filters.

Map side, every task splits its texts and hashes the keys of long lines (once for each document). The hash space is
cut into segments; a reducer folds what tasks send for a segment into two bit arrays, "seen once" and "seen twice".
Only lines whose hash the second filter knows - suspected repeats - shuffle with their whole key, where exact counts
and the document that keeps the line are found. False positives of a filter cost a row of shuffle, never a line.

A filter has BITS_PER_KEY bits for each key up to ``max_filter_bits``. Beyond that the hash space is split into shards;
each shard has a pass of its own with a filter of bounded size, so broadcast stays bounded at any input size.

Defined results: a null or empty text is one empty line; each row is a document, also if its doc_id repeats or is
null (null ids count as smaller than any other); rows that share the largest doc_id of a line all keep it; lines and texts
of any length are read whole; an empty table gives no rows; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import BROADCAST_ROWS, as_row, bounded_batches, file_row, save, save_narrow, table, trimmed

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_KEY, PROBES = 16, 4
MAX_FILTER_BITS = 1 << 28
#: Bits of a filter that one reducer folds: 2 x 32 KB.
SEGMENT_BITS = 1 << 18
#: Repeated keys are broadcast only up to so many bytes.
BROADCAST_BYTES = 16 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether a UTF-8 key has at least ``least`` code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or sum((b & 0xC0) != 0x80 for b in key) >= least)


def document_keys(text: str | None, least: int) -> dict[bytes, list[int]]:
    """Keys of long lines with the numbers of the lines that have them."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line)
        if long_enough(key, least):
            out.setdefault(key, []).append(i)
    return out


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash, and PROBES bit places in that segment (a filter blocked by segment)."""
    segments = max(1, bits // SEGMENT_BITS)
    size = min(bits, SEGMENT_BITS)
    segment = (hashes >> np.uint64(40)) % np.uint64(segments)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    a, b = mixed >> np.uint64(32), (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return segment.astype(np.int64), np.stack([((a + np.uint64(i) * b) >> np.uint64(5)) % np.uint64(size) for i in range(PROBES)], 1).astype(np.int64)


def _hashes(least: int, shards: int, shard: int):
    """Sorted distinct hashes of each document in a batch, packed by segment range; a hash comes once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(k) for t in batch.column(0).to_pylist() for k in document_keys(t, least)]
            h = np.array(found, np.uint64)
            h = np.sort(h[h % np.uint64(shards) == np.uint64(shard)])
            yield pa.RecordBatch.from_arrays([pa.array([h.astype("<u8").tobytes()], pa.binary()), pa.array([len(h)], pa.int64())], ["hashes", "n"])

    return trimmed(run)


def _deal(bits: int, groups: int):
    """Packed hashes -> one packed row for each group of segments; from each task, hashes at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            h, n = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            if not len(h):
                continue
            group = positions(h, bits)[0] % groups
            order = np.argsort(group, kind="stable")
            h, group = h[order], group[order]
            names, at = np.unique(group, return_index=True)
            parts = np.split(h, at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())], ["g", "hashes"])

    return run


def _fold(bits: int, groups: int):
    """The rows of a task's segments -> (segment, twice): places whose bits were set by two different insertions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        size = min(bits, SEGMENT_BITS)
        for batch in batches:
            for raw in batch.column("hashes").to_pylist():
                h = np.frombuffer(raw, "<u8")
                segment, place = positions(h, bits)
                for s in np.unique(segment):
                    mine = place[segment == s]
                    one, two = once.setdefault(int(s), np.zeros(size, bool)), twice.setdefault(int(s), np.zeros(size, bool))
                    # a hash that its task has twice is in mine twice; places of one insertion count once
                    ordered = np.sort(mine, 1)
                    fresh = np.ones(ordered.shape, bool)
                    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
                    count = np.bincount(ordered[fresh], minlength=size)
                    two |= (count > 1) | ((count > 0) & one)
                    one |= count > 0
        for s, two in twice.items():
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["segment", "twice"])

    return trimmed(run)


def _suspects(least: int, shards: int, shard: int, bits: int, filters):
    """(row, doc_id, key, lines) of the keys that the second filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        size = min(bits, SEGMENT_BITS)
        segments = max(1, bits // SEGMENT_BITS)
        table_ = np.zeros((segments, size // 8), np.uint8)
        for s, raw in known.items():
            table_[s] = np.frombuffer(raw, np.uint8)
        for batch in batches:
            row, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            keys, where = [], []
            for j, t in enumerate(texts):
                for key, lines in document_keys(t, least).items():
                    keys.append(key)
                    where.append((j, lines))
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            if not len(h):
                continue
            segment, place = positions(h, bits)
            hit = h % np.uint64(shards) == np.uint64(shard)
            for i in range(PROBES):
                hit &= (table_[segment, place[:, i] >> 3] >> (7 - (place[:, i] & 7)).astype(np.uint8)) & 1 == 1
            pick = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([
                pa.array([row[where[i][0]] for i in pick], pa.string()), pa.array([ids[where[i][0]] for i in pick], pa.int64()),
                pa.array([keys[i] for i in pick], pa.binary()), pa.array([where[i][1] for i in pick], pa.list_(pa.int32())),
            ], ["row", "doc_id", "key", "lines"])

    return trimmed(run)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(row, drop): the numbers of the lines that a row of ``docs`` (row, doc_id, text) loses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("text")
    packed = save(texts.mapInArrow(_hashes(min_chars, 1, 0), "hashes binary, n long"), "line-hashes")
    total = packed.agg(F.sum("n")).first()[0] or 0
    wanted = max(SEGMENT_BITS, 1 << max(0, int(total * bits_per_key - 1).bit_length()))
    bits = min(wanted, max_filter_bits)
    shards = -(-wanted // bits)
    out = None
    for shard in range(shards):
        groups = max(1, bits // SEGMENT_BITS)
        mine = packed if shards == 1 else packed.mapInArrow(_only(shards, shard), packed.schema)
        dealt = mine.mapInArrow(_deal(bits, groups), "g long, hashes binary").repartition("g")
        # at most max_filter_bits / 8 bytes: the bound of what is gathered and broadcast
        known = {r[0]: bytes(r[1]) for r in dealt.mapInArrow(_fold(bits, groups), "segment long, twice binary").collect()}
        suspects = docs.mapInArrow(_suspects(min_chars, shards, shard, bits, spark.sparkContext.broadcast(known)), "row string, doc_id long, key binary, lines array<int>")
        out = suspects if out is None else out.union(suspects)
    suspects = save(out, "line-suspects")
    exact = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= min_docs).select(F.col("key").alias("k"), "last")
    # written first: each side of the join then has a plain shuffle of its own, which AQE splits where one line is hot;
    # a table of counted size is broadcast instead
    exact = save_narrow(exact, "line-repeats")
    size = exact.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("k")), F.lit(0))).first()
    exact = F.broadcast(exact) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES else exact
    lost = suspects.join(exact, F.col("key") == F.col("k")).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("drop"))


def _only(shards: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lambda h: h[h % np.uint64(shards) == np.uint64(shard)])(np.frombuffer(x, "<u8")) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in kept], pa.binary()), pa.array([len(h) for h in kept], pa.int64())], ["hashes", "n"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS, bits_per_key: int = BITS_PER_KEY, names: tuple[str, str, str] = ("__lines", "__dropped", "__kept")) -> DataFrame:
    """Every row of ``docs`` with its text after line dedup: all columns, then ``names``: lines, dropped lines (long), text that is kept.

    They take the place of columns of the same names.

    A line's key is the line stripped and lower-cased; keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose all their lines but those of the largest id.
    """
    if min_docs < 2:
        raise ValueError("min_docs has to be 2 or more: a line that one document has is no repeat")
    # a row name that a task can repeat: the file and the place in it
    place = file_row(docs)
    numbered = docs.select(as_row(docs).alias("doc"), place.alias("row")) if place is not None else save(docs.select(as_row(docs).alias("doc"), F.monotonically_increasing_id().cast("string").alias("row")), "line-rows")
    read = F.col("doc").getField(text_col)
    lost = dropped_lines(numbered.select("row", F.col("doc").getField(id_col).cast("long").alias("doc_id"), read.alias("text")), min_chars, min_docs, max_filter_bits, bits_per_key)
    text = F.coalesce(read, F.lit(""))
    joined = numbered.join(lost, "row", "left").withColumn("all", F.split(text, "\n", -1))
    drop = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.filter("all", lambda x, i: ~F.array_contains(drop, i)), "\n"))
    old = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    made = F.struct(F.size("all").cast("long").alias("lines"), F.size(drop).cast("long").alias("dropped"), kept.alias("kept"))
    return joined.select("doc", made.alias("made")).select(*old, *[F.col("made").getField(x).alias(name) for x, name in zip(("lines", "dropped", "kept"), names, strict=True)])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines, before and dropped, and a digest of what is left of each document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (SELECT k.doc_id, k.line, k.i, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
