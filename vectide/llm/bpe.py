"""Byte-level BPE by the ranks of a vocabulary file: texts to ids, and ids back to bytes.

Texts are cut into pre-tokens by array operations on the code points of a whole batch. A pre-token that is no token of its own is
merged over a linked list of its bytes. The pairs to merge wait in a queue of ranks: a bucket for each merge rank holds places in
the list, and a bitmap of buckets in use, with a bitmap of its words above it and so on, gives the lowest rank by finding first
set bits. Entries whose pair has changed since are skipped. A merge costs the same however long the pre-token is, so runs
of a million letters take time in proportion to their length. Pre-tokens that were met before come from a bounded memo.

Both directions are maps over rows, without a shuffle: a lost executor costs the batches it had.

Defined results: a null or empty text has no ids, and null or empty ids no bytes; rows that share a doc_id stay rows of their
own, as do repeated rows; texts of any length are encoded whole; an empty table gives no rows; other columns are not read,
so names can't clash. Ids that the vocabulary does not have stop the job with ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, table, text_of, trimmed
from vectide.llm.encode import MEMO_BYTES, SLOTS, Encoder

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The pattern that :func:`pre_tokens` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_CODERS: dict[str, Coder] = {}
_KINDS: list[np.ndarray] = []


class RankQueue:
    """Places by rank, the lowest rank first: buckets, and bitmaps over them, level upon level, each word over 256 bits below."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = -(-ranks // 256) or 1
            self.levels.append([0] * ranks)
        self.descent = self.levels[::-1]
        self.bit = [1 << i for i in range(256)]

    def push(self, rank: int, place: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(place)
            return
        self.buckets[rank] = [place]
        for level in self.levels:
            word = rank >> 8
            old = level[word]
            level[word] = old | self.bit[rank & 255]
            if old:
                return
            rank = word

    def take(self) -> tuple[int, list[int]]:
        """Empty the bucket of the lowest rank: that rank, and its places, ascending."""
        rank = 0
        for level in self.descent:
            word = level[rank]
            rank = rank << 8 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            word = at >> 8
            level[word] ^= self.bit[at & 255]
            if level[word]:
                break
            at = word
        places = self.buckets.pop(rank)
        if len(places) > 1:
            places.sort()
        return rank, places


class Memo(Encoder):
    """The table of known words of :class:`Encoder`, for pieces that are encoded elsewhere."""

    def __init__(self, slots: int) -> None:  # no tokenizer is loaded
        self.mask = np.uint64(slots - 1)
        self.key, self.number = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.words, self.used, self.most = 0, 0, slots // 2


class Coder:
    """One vocabulary: bytes to ids, ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], slots: int = SLOTS) -> None:
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        if min(ranks.values()) < 0 or len(set(ranks.values())) != len(ranks):
            raise ValueError("ranks have to be distinct and not negative")
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.memo = Memo(slots)
        by_id: list[bytes | None] = [None] * self.size
        for token, i in ranks.items():
            by_id[i] = token
        self.lengths = np.array([-1 if t is None else len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.flat = np.frombuffer(b"".join(t or b"" for t in by_id), np.uint8)

    @classmethod
    def read(cls, path: str) -> Coder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: itself if it is a token, else the lowest-ranked pair is merged, the leftmost first, until none is left."""
        get, longest, queue = self.ranks.get, self.longest, self.queue
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, push = len(piece), queue.push
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of the pair that begins at each place
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        while queue.buckets:
            rank, places = queue.take()
            for at, i in enumerate(places):
                if pair[i] != rank:
                    continue  # stale: merged, or its right side has grown
                gone = after[i]
                end = after[gone]
                after[i], before[end], pair[gone], pair[i] = end, i, -1, -1
                low = rank
                left = before[i]
                if left >= 0:
                    pair[left] = made = get(piece[left:end], -1) if end - left <= longest else -1
                    if made >= 0:
                        push(made, left)
                        low = min(low, made)
                if end < n and after[end] - i <= longest:
                    pair[i] = made = get(piece[i : after[end]], -1)
                    if made >= 0:
                        push(made, i)
                        low = min(low, made)
                if low < rank:  # what was made comes before the rest of this bucket
                    for j in places[at + 1 :]:
                        push(rank, j)
                    break
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        w, memo = pre_tokens(texts), self.memo
        h = bytewords.hash_words(w)
        codes = memo._find(h)
        missing, known = np.flatnonzero(codes < 0), memo.words
        hashed, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
        at = missing[at]
        order = np.argsort(w.size[at], kind="stable")  # short ones first: they may stay
        at, hashed = at[order], hashed[order]
        new = [self.merge(w.buf[s : s + n].tobytes()) for s, n in zip(w.start[at].tolist(), w.size[at].tolist(), strict=True)]
        memo._add(new)
        codes[missing] = known + np.argsort(order)[back]
        sizes, first = memo.size[codes].astype(np.int64), memo.start[codes]
        ends = np.cumsum(sizes)
        ids = memo.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)]
        stay = min(int(np.searchsorted(w.size[at], MEMO_BYTES, side="right")), max(0, memo.most - known))
        memo._keep(hashed[:stay], np.arange(known, known + stay, dtype=np.int32))
        if stay < len(new):
            memo.words, memo.used = known + stay, int(memo.start[known + stay])
        return ids, np.diff(np.concatenate([[0], ends])[w.first])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, number of bytes of each)."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)], sizes


def kinds() -> np.ndarray:
    """White space, letter, number or other for each code point, as the rank files' own library tells them apart.

    Releases of Unicode differ from library to library, so its pattern engine is asked, once a process.
    """
    if not _KINDS:
        import tiktoken

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            asked = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            out[np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
        _KINDS.append(out)
    return _KINDS[0]


def _code_points(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of the first byte of each) of the first ``n`` bytes."""
    place = np.flatnonzero((buf[:n] & 0xC0) != 0x80)
    out = buf[place].astype(np.uint32)
    for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero((out >= low) & (out < (0xE0, 0xF0, 0x100)[more - 1]) & (buf[place] >= low))
        if len(some):
            value, at = out[some] & bits, place[some]
            for k in range(1, more + 1):
                value = value << 6 | (buf[at + k] & 0x3F)
            out[some] = value | 0x80000000  # not taken for a first byte again
    return out & 0x7FFFFFFF, place


def pre_tokens(texts: pa.Array) -> bytewords.Words:
    """The matches of PATTERN in each text, as places in its bytes."""
    buf, offsets = bytewords.text_bytes(texts)
    n = int(offsets[-1]) if len(offsets) else 0
    code, place = _code_points(buf, n)
    m = len(code)
    if not m:
        return bytewords.Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    kind = kinds()[code]
    opens = np.zeros(m + 1, bool)  # first code points of texts
    opens[np.searchsorted(place, offsets)] = True
    opens[m] = True
    edge = opens.copy()
    edge[1:m] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # of white space before something else, the last one stands alone, or opens the match that follows if it is a blank
    last = np.flatnonzero(space[:-1] & edge[1:m] & ~opens[1:m])
    edge[last] = True
    edge[last[code[last] == 0x20] + 1] = False
    # an apostrophe that opens a match takes s, t, m, d, re, ve or ll with it
    mark = np.flatnonzero((code == 0x27) & edge[:m])
    mark = mark[mark + 1 < m]
    mark = mark[~opens[mark + 1]]
    wide = np.concatenate([code, np.zeros(2, np.uint32)])
    one, two = wide[mark + 1], wide[mark + 2]
    long = (two == 0x65) & ((one == 0x72) | (one == 0x76)) | (two == 0x6C) & (one == 0x6C)
    long[long] &= ~opens[mark[long] + 2]
    short = np.isin(one, np.array([0x73, 0x74, 0x6D, 0x64], np.uint32))
    for some, more in ((mark[short], 2), (mark[long & ~short], 3)):
        edge[some + 1] = False
        edge[some + more] = True
    first = np.flatnonzero(edge[:m])
    start = place[first]
    return bytewords.Words(buf, start, np.diff(np.append(start, n)), np.searchsorted(start, offsets))


def coder(path: str) -> Coder:
    """One coder for each worker process and file."""
    if path not in _CODERS:
        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the rank files ask for another pattern")
        _CODERS[path] = Coder.read(path)
    return _CODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            ids, many = c.encode(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return trimmed(run)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            raw, sizes = c.decode(flat)
            at = np.concatenate([[0], np.cumsum(sizes)])[ends - ends[0]].astype(np.int64)
            whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, whole.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return trimmed(run)


def encode(docs: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text, without special tokens."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(_encode(ranks or public_tokenizers.path(RANKS)), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (the bytes that the ids stand for)."""
    bounded_batches(encoded.sparkSession)
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return encoded.select("doc_id", ids.alias("ids")).mapInArrow(_decode(ranks or public_tokenizers.path(RANKS)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
