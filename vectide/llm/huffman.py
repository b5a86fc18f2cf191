"""Length-limited canonical Huffman coding of token ids in numpy: code lengths by package-merge, table-driven decoding.

A container holds documents and their ids: header, code lengths, document ids and counts, the bit offset of every
block of BLOCK ids, bits. Blocks decode independently of each other, all blocks of a range side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"VTHF", 1
BLOCK = 256
#: Longest code: the decoding table has 2 ** LIMIT entries.
LIMIT = 18
HEAD = struct.Struct("<4sIQQqIBII")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ids with counts over 0, by package-merge; others get 0."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = []
    packed = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packed])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # whether the i-th smallest is an id or a package
        merged = merged[rank]
        packed = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_id in reversed(levels):
        chosen = is_id[:take]
        k = int(chosen.sum())  # ids come in ascending order of weight: the k smallest
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of ascending (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    used = np.flatnonzero(lengths)
    for length in np.unique(lengths[used]):
        code <<= int(length) - last
        last = int(length)
        ids = used[lengths[used] == length]
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every run of ``width`` bits: id << 8 | code length."""
    width = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    codes = canonical(lengths)
    out = np.zeros(1 << width, np.int64)
    order = used[np.argsort(codes[used].astype(np.int64) << (width - lengths[used].astype(np.int64)), kind="stable")]
    runs = np.int64(1) << (width - lengths[order].astype(np.int64))
    out[: int(runs.sum())] = np.repeat(order.astype(np.int64) << 8 | lengths[order], runs)
    return out, width


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, bits)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros((total + 7) // 8 + 8)
    # a code of at most 25 bits, shifted by up to 7, touches 4 bytes; no two codes share a bit, so sums are ors
    word = codes[ids].astype(np.uint64) << (32 - size - (starts & 7)).astype(np.uint64)
    first = starts >> 3
    for i in range(4):
        out += np.bincount(first + i, weights=((word >> np.uint64(24 - 8 * i)) & np.uint64(255)).astype(np.float64), minlength=len(out))[: len(out)]
    return starts[::BLOCK], out[: (total + 7) // 8].astype(np.uint8).tobytes()


def unpack(bits: bytes, offsets: np.ndarray, count: int, table: np.ndarray, width: int) -> np.ndarray:
    """``count`` ids of the blocks that begin at ``offsets``; all but the last block are full."""
    blocks = len(offsets)
    if not count:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[:4].view(">u4"), shape=(len(raw) - 3,), strides=(1,))
    out = np.zeros((BLOCK, blocks), np.uint32)
    at = offsets.astype(np.int64).copy()
    last = count - (blocks - 1) * BLOCK
    mask = (1 << width) - 1
    for i in range(BLOCK if blocks > 1 else last):
        if i == last:
            at = at[:-1]
        got = table[(words[at >> 3].astype(np.int64) >> (32 - width - (at & 7))) & mask]
        out[i, : len(at)] = got >> 8
        at = at + (got & 255)
    return out.T.reshape(-1)[: (blocks - 1) * BLOCK + last]


def write_container(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, start: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    offsets, bits = pack(ids, lengths, codes)
    table = zlib.compress(lengths.tobytes(), 6)
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), start, len(lengths), LIMIT, len(table), zlib.crc32(bits))
    return b"".join([
        head, table, np.packbits(null).tobytes(), np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.asarray(sizes, "<u8").tobytes(), offsets.astype("<u8").tobytes(), bits,
    ])


class Container:
    """Random access to a container: documents, and ids of any range of blocks."""

    def __init__(self, raw: bytes) -> None:
        magic, version, docs, self.count, self.start, vocab, limit, size, self.crc = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a container of this format")
        at = HEAD.size
        self.lengths = np.frombuffer(zlib.decompress(raw[at : at + size]), np.uint8)
        at += size
        null = np.unpackbits(np.frombuffer(raw, np.uint8, (docs + 7) // 8, at))[:docs]
        at += (docs + 7) // 8
        self.doc_ids = [None if x else int(d) for x, d in zip(null, np.frombuffer(raw, "<i8", docs, at), strict=True)]
        at += 8 * docs
        self.sizes = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        blocks = -(-self.count // BLOCK)
        self.offsets = np.frombuffer(raw, "<u8", blocks, at).astype(np.int64)
        self.bits = raw[at + 8 * blocks :]
        self._table = None

    def check(self) -> None:
        if zlib.crc32(self.bits) != self.crc:
            raise ValueError("the bits of a container are damaged")

    def table(self) -> tuple[np.ndarray, int]:
        if self._table is None:
            self._table = _table(self.lengths.tobytes())
        return self._table

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks first to last - 1."""
        blocks = len(self.offsets)
        last = blocks if last is None else min(last, blocks)
        if first >= last:
            return np.zeros(0, np.uint32)
        count = min(self.count, last * BLOCK) - first * BLOCK
        return unpack(self.bits, self.offsets[first:last], count, *self.table())


_TABLES: dict[bytes, tuple[np.ndarray, int]] = {}


def _table(lengths: bytes) -> tuple[np.ndarray, int]:
    """The decoding table of these code lengths; a worker keeps the last."""
    if lengths not in _TABLES:
        _TABLES.clear()
        _TABLES[lengths] = decode_table(np.frombuffer(lengths, np.uint8))
    return _TABLES[lengths]
