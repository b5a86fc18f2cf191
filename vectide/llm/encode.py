"""Token ids of whole texts, in batches, with a bounded memo of words.

A tokenizer whose pre-tokenizer drops white space splits a text at white space before anything else, so a text's ids are
its words' ids one after another. Words are looked up by a 64-bit hash in a table of fixed size; those it does not
know are encoded once a batch by the tokenizers library and remembered while there is room. Whether a tokenizer does so,
also splits before marks that follow letters, and ignores case, is tried on PROBES when it is loaded; one that does
not drop white space encodes whole texts.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from vectide.llm import bytewords

#: Remembered words (at most half of the slots), and the longest word in bytes that is remembered.
SLOTS, MEMO_BYTES = 1 << 21, 64
#: Pieces that are put together to try a tokenizer: letters, marks, white space.
PROBES = (("ab", "Zoe", "\u00e9t\u00e9", "\u00fc", "x"), (".", "'s", "'t", "12", "...", "#", "-ab", "_", "'", ")."), (" ", "\t", "\n", "\r\n", "  ", "\x0b", "\x0c"))
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str, slots: int = SLOTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        letters, marks, spaces = PROBES
        self.by_words = all(one(a + s + b) == one(a) + one(b) for a in (*letters, *marks) for b in (*letters, *marks) for s in spaces) and not any(one(s) for s in spaces)
        self.marks_apart = self.by_words and all(one(a + b) == one(a) + one(b) for a in letters for b in marks)
        self.lower = self.by_words and all(one(a) == one(a.upper()) for a in (*letters, *marks))
        # strings that stand for one id wherever they are in a text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = self.by_words and not any(c.isspace() for t in self.added for c in t)
        self.mask = np.uint64(slots - 1)
        self.key, self.number = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.words, self.used, self.most = 0, 0, slots // 2

    def _add(self, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(ids) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[self.words : self.words + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.words : self.words + len(ids)] = sizes
        self.words += len(ids)
        self.used += total

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known word, else -1: two slots are looked at."""
        a, b = h & self.mask, (h >> np.uint64(40)) & self.mask
        out = np.where(self.key[a] == h, self.number[a], -1)
        lost = np.flatnonzero(out < 0)
        b = b[lost]
        out[lost] = np.where(self.key[b] == h[lost], self.number[b], -1)
        return out

    def _keep(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Put words into free slots; one whose two slots are taken is encoded again when it comes again."""
        for shift in (0, 40):
            place = (h >> np.uint64(shift)) & self.mask
            free = np.flatnonzero(self.number[place] < 0)
            put = free[np.unique(place[free], return_index=True)[1]]
            self.key[place[put]], self.number[place[put]] = h[put], numbers[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            h, numbers = h[rest], numbers[rest]

    def _has_added(self, texts: pa.Array) -> bool:
        buf = bytewords.LOWER[bytewords.text_bytes(texts)[0]].tobytes()
        return any(t.lower().encode() in buf for t in self.added)

    def _whole(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        closing = [] if end is None else [end]
        ids = [[*e.ids, *closing] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); ``end`` is appended to each text."""
        if not self.by_words:
            return self._whole(texts, end)
        plain = not self._has_added(texts)  # words that may hold such strings stay as they are
        w = bytewords.split(texts, lower=self.lower and plain, marks_apart=self.marks_apart and plain)
        h = bytewords.hash_words(w)
        codes = self._find(h)
        kept = self.words, self.used
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unique, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[at]
            short = w.size[where] <= MEMO_BYTES
            order = np.argsort(~short, kind="stable")  # those that may stay come first
            stay = min(int(short.sum()), max(0, self.most - self.words))
            number = np.empty(len(unique), np.int64)
            number[order] = self.words + np.arange(len(unique))
            raw = w.buf
            for part, stays in ((order[:stay], True), (order[stay:], False)):
                for i in range(0, len(part), 1 << 16):
                    at_ = where[part[i : i + (1 << 16)]]
                    some = [raw[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(w.start[at_].tolist(), w.size[at_].tolist(), strict=True)]
                    self._add([e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
                if stays:
                    self._keep(unique[part], number[part].astype(np.int32))
                    kept = self.words, self.used
            codes[missing] = number[back]
        sizes, starts = self.size[codes].astype(np.int64), self.start[codes]
        ends = np.cumsum(sizes)
        made = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(made) + np.repeat(starts - (ends - sizes), sizes)]
        at = np.concatenate([[0], ends])[w.first]
        lengths = np.diff(at)
        self.words, self.used = kept
        if end is not None:
            out = np.empty(made + len(lengths), np.uint32)
            closing = at[1:] + np.arange(len(lengths))
            inner = np.ones(len(out), bool)
            inner[closing] = False
            out[inner], out[closing] = ids, end
            ids, lengths = out, lengths + 1
        return ids, lengths


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
