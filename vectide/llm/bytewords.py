"""Words of a batch of texts as places in its UTF-8 bytes, and 64-bit hashes of them, without a Python string a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and \\t to \\r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([0, *((1 << 8 * i) - 1 for i in range(1, 9))], np.uint64)


@dataclass
class Words:
    buf: np.ndarray  #: bytes of all texts, eight zeros after them
    start: np.ndarray  #: place of each word
    size: np.ndarray  #: bytes of each word
    first: np.ndarray  #: number of the first word of each text, and of all words at the end

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.size[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = int(offsets[0]) if len(offsets) else 0
    high = int(offsets[-1]) if len(offsets) else 0
    out = np.zeros(high - low + 8, np.uint8)
    out[: high - low] = raw[low:high]
    return out, offsets - low


#: Bytes of ASCII letters, and of ASCII digits and punctuation.
LETTERS, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARKS[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def after_letters(buf: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the first ``n`` bytes is an ASCII digit or punctuation right after a letter of ASCII or Latin-1."""
    letter = LETTERS[buf[: max(0, n - 1)]]
    high = np.flatnonzero(buf[: max(0, n - 2)] == 0xC3) + 1
    letter[high] |= (buf[high] >= 0x80) & (buf[high] != 0x97) & (buf[high] != 0xB7)
    out = np.zeros(n, bool)
    out[1:] = letter & MARKS[buf[1:n]]
    return out


def split(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False, marks_apart: bool = False) -> Words:
    """Words between separators; with ``marks_apart`` what follows a letter from a digit or punctuation mark on is a word of its own."""
    buf, offsets = text_bytes(texts)
    if lower:
        buf = LOWER[buf]
    n = int(offsets[-1]) if len(offsets) else 0
    word = ~separators[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[offsets] = True
    if marks_apart:
        edge[:n] |= after_letters(buf, n)
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return Words(buf, start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; ``buf`` has eight more bytes than any run needs."""
    with np.errstate(over="ignore"):
        wide = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(len(buf) - 7,), strides=(1,)) if len(buf) >= 8 else np.zeros(1, np.uint64)
        h = mix(size.astype(np.uint64) * _M1 ^ (wide[start] & _MASK[np.minimum(size, 8)])) * _M1
        live = np.flatnonzero(size > 8)
        at = 8
        while len(live):
            part = wide[start[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
            h[live] = mix(h[live] ^ part) * _M1
            at += 8
            live = live[size[live] > at]
        return h ^ (h >> np.uint64(32))


def hash_words(words: Words) -> np.ndarray:
    return hashes(words.buf, words.start, words.size)


def hash_bytes(word: bytes) -> int:
    buf = np.frombuffer(word + b"\0" * 8, np.uint8)
    return int(hashes(buf, np.zeros(1, np.int64), np.array([len(word)]))[0])
