"""Token ids to compact files and back: canonical length-limited Huffman codes from counts over all documents.

Documents are dealt by ranges of doc_id and sorted, encoded once and written; counts of all ids (a vocabulary's worth of
numbers, whatever the corpus is) give the code; each task then turns its run of documents into containers. The files
are a Parquet table of containers, (part, start) ascending with doc_id: Spark's commit protocol covers lost
executors, and any store that Spark reads will do.

Defined results: a null or empty text has the end id only; null doc_ids come first; rows that share a doc_id keep
their own ids, ordered by their text's hash; texts of any length are encoded whole; an empty table gives no containers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm import huffman
from vectide.llm.common import bounded_batches, discard, save, small, table, trimmed
from vectide.llm.encode import encoder

TOKENIZER, END = "word_bpe_49k.json", 1
#: Bytes of ids that become one container.
CONTAINER_BYTES = 2 << 20


def id_type(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def split_rows(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array: the ids of each row in its own width."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())


def joined_rows(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, number of ids of each)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size and len(offsets) else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(offsets) // width


def _ranged_ids(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        e = encoder(path)
        for batch in batches:
            ids, lengths = e.encode(batch.column("text"), end)
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), part), pa.int64()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(lengths, pa.int64()), split_rows(ids.astype(id_type(e.vocab)), lengths)], ["part", "local", "doc_id", "n", "ids"])

    return trimmed(run)


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(joined_rows(batch.column("ids"), kind)[0])
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def id_counts(encoded: DataFrame, kind: str, vocab: int) -> np.ndarray:
    """Counts of all ids; what comes to the driver is bounded by the vocabulary."""
    rows = encoded.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    out = np.zeros(vocab, np.int64)
    for i, n in rows:
        out[i] = n
    return out


def _contain(kind: str, lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(lengths, np.uint8)
        codes = huffman.canonical(bits)
        for batch in batches:
            parts, bases, local = (batch.column(c).to_numpy() for c in ("part", "base", "local"))
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]  # a split of a file holds one part, a merged one more
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                ids, sizes = joined_rows(batch.column("ids").slice(a, b - a), kind)
                start = int(bases[a] + local[a])
                raw = huffman.write_container(batch.column("doc_id").slice(a, b - a).to_pylist(), sizes, ids, start, bits, codes)
                yield pa.RecordBatch.from_arrays([pa.array([int(parts[a])], pa.int64()), pa.array([start], pa.int64()), pa.array([b - a], pa.int64()), pa.array([raw], pa.binary())], ["part", "start", "docs", "container"])

    return trimmed(run)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("container").to_pylist():
            box = huffman.Container(raw)
            box.check()
            starts = box.start + np.cumsum(box.sizes) - box.sizes
            yield pa.RecordBatch.from_arrays([pa.array(box.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(box.sizes, pa.int64()), split_rows(box.ids().astype("<u4"), box.sizes)], ["doc_id", "start", "n_tokens", "ids"])


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode every text and write containers, in ascending doc_id order, to the Parquet table ``path``."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    vocab = encoder(tokenizer).vocab
    kind = id_type(max(vocab, (end or 0) + 1))
    bounded_batches(spark)
    tie = F.xxhash64("text")  # rows that share an id are dealt apart
    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    encoded = save(ranged.mapInArrow(_ranged_ids(tokenizer, end), "part long, local long, doc_id long, n long, ids binary"), "token-ids")
    lengths = huffman.code_lengths(id_counts(encoded, kind, vocab)).tobytes()
    parts = encoded.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as there are shuffle partitions
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    bounded_batches(spark, size=CONTAINER_BYTES)
    encoded.join(small(bases), "part").mapInArrow(_contain(kind, lengths), "part long, start long, docs long, container binary").write.option("compression", "uncompressed").parquet(path)
    discard(encoded)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian)."""
    bounded_batches(spark, rows=2)
    return spark.read.schema("part long, start long, docs long, container binary").parquet(path).select("container").mapInArrow(_open, "doc_id long, start long, n_tokens long, ids binary")


def crc_of(ids: Column | str) -> Column:
    return F.crc32(ids).cast("long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to containers in order of doc_id and read back; a digest of each document."""
    from vectide.llm.common import new_path

    path = write_ids(table(spark, sf_dir, "documents"), new_path(spark, "token-files"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", crc_of("ids").alias("ids_crc32"))
