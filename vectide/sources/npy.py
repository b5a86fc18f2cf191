"""Dense matrices in .npy files, read in parallel by ranges of rows.

The header says where rows begin and how long they are, so a task seeks to its range and reads no more. Rows come as (at, vector) in
Arrow batches; their number joins them to metadata in the file's order. Paths are any that pyarrow's file systems open.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectide.errors import ContractError
from vectide.operators.order import numbered

#: Bytes of a task's range and of a batch.
RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
_KINDS = {"<f4": "float", "<f8": "double"}


def _open(path: str):
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(at.path))
    files, place = fs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def header(path: str) -> tuple[str, int, int, int]:
    """(type, rows, columns, first byte of the rows) of a two-dimensional matrix in row order."""
    with _open(path) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ContractError(f"{path} is no .npy file")
        size = "<H" if magic[6] == 1 else "<I"
        width = struct.calcsize(size)
        length = struct.unpack(size, f.read(width))[0]
        about = ast.literal_eval(f.read(length).decode("utf-8"))
    if about["descr"] not in _KINDS or about["fortran_order"] or len(about["shape"]) != 2:
        raise ContractError(f"{path}: a matrix of 32- or 64-bit floats in row order is expected, not {about}")
    return about["descr"], *about["shape"], 8 + width + length


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes
        self.kind, self.rows, self.columns, self.begin = header(path)

    def _step(self, size: int) -> int:
        return max(1, size // max(1, self.columns * np.dtype(self.kind).itemsize))

    def partitions(self) -> list[_Range]:
        step = self._step(self.range_bytes)
        return [_Range(i, min(i + step, self.rows)) for i in range(0, self.rows, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        width, step = self.columns * np.dtype(self.kind).itemsize, self._step(BATCH_BYTES)
        with _open(self.path) as f:
            f.seek(self.begin + partition.first * width)
            for i in range(partition.first, partition.last, step):
                n = min(step, partition.last - i)
                raw = f.read(n * width)
                if len(raw) != n * width:
                    raise ContractError(f"{self.path} ends before its {self.rows} rows")
                flat = np.frombuffer(raw, self.kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.columns), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), lists], ["at", "vector"])


class NpySource(DataSource):
    """spark.read.format("npy").load(path) after :func:`register`; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"at long, vector array<{_KINDS[header(self.options['path'])[0]]}>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(at, vector): rows of the matrix and their numbers from 0."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rangeBytes", range_bytes).load(path)


def with_metadata(matrix: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """``metadata`` in the order of a column, with the matrix's row of that place as ``embedding``; both have to be of one length."""
    rows = numbered(metadata, order, name="at")
    n, m = rows.count(), matrix.count()
    if n != m:
        raise ContractError(f"{m} rows of a matrix for {n} rows of metadata")
    return rows.join(matrix.withColumnRenamed("vector", "embedding"), "at").drop("at")
