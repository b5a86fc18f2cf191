"""Bit-sliced search against a plain loop over all documents, and its edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import bitsliced

TERM = re.compile(bitsliced.TERM)
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(str.maketrans(bitsliced._UPPER, bitsliced._LOWER)))


def plain(docs: list, items: list, k: int) -> list:
    """Every document for every query, one after another."""
    rows = [(d, Counter(w), len(w)) for d, text in docs if (w := terms(text))]
    n, length = len(rows), sum(x[2] for x in rows)
    holding = Counter(t for _, c, _ in rows for t in c)
    asked: dict = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c, size in rows:
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs: list, items: list, k: int, parts: int = 3, **more) -> list:
    found = bitsliced.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), k, **more)
    return sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


def made(seed: int, n: int) -> list:
    random.seed(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "日本", "ÉTÉ", "a b", "İ"]
    texts = [" ".join(random.choices(words, weights=range(len(words), 0, -1), k=random.randrange(0, 30))) for _ in range(n)]
    return [(7 * i % (n + 1), t) for i, t in enumerate(texts)]


def test_equals_a_plain_loop(spark) -> None:
    docs = made(1, 400) + [(10_000 + i, "the same copy of w1 and W2") for i in range(90)] + [(5, "w1"), (5, "w1"), (None, "w2 w2"), (None, None), (9, ""), (8, "x" * 100_000), (6, "w3 " * 50_000)]
    items = [(i, t) for i, t in made(2, 12)] + [(3, "copy of w1"), (None, "W2 été"), (50, None), (51, "!?"), (52, "nothinglikeit")]
    want = plain(docs, items, 10)
    assert want and got(spark, docs, items, 10) == want
    # other blocks, groups of queries and sizes of the result change nothing
    assert got(spark, docs, items, 10, parts=7, query_terms=20) == want
    assert got(spark, docs, items, 2) == plain(docs, items, 2)


def test_small_blocks_and_steps(spark, monkeypatch) -> None:
    docs, items = made(3, 900), made(4, 9)
    for name, value in (("BLOCK_DOCS", 128), ("SUM_BYTES", 1), ("SLICE_BYTES", 1 << 16)):
        monkeypatch.setattr(bitsliced, name, value)
    assert got(spark, docs, items, 5, parts=2) == plain(docs, items, 5)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "")], [(1, "a")]), ([], [])])
def test_nothing_to_find(spark, docs: list, items: list) -> None:
    assert got(spark, docs, items, 3) == []


def test_clashing_columns(spark) -> None:
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, score long, query long")
    items = spark.createDataFrame([(1, "b", 5, 6)], "item_id long, text string, rank long, TERM long")
    assert [tuple(r) for r in bitsliced.search(docs, items).collect()] == [(1, 1, 1, 1000000000 // (1000 + 8 * 100) * math.floor(1000 * math.log(4 / 3)))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 12), st.integers(1, 9), st.sampled_from([1, 3, 1 << 20]))
def test_carries_and_descent(seed: int, docs: int, terms_: int, k: int, most: int) -> None:
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, most + 1, (terms_, docs)) * (rng.random((terms_, docs)) < 0.4)
    row, place = np.nonzero(dense)
    bits = bitsliced.slices(dense[row, place].astype(np.int64), row, place, terms_, -(-docs // 64))
    wanted = [rng.permutation(terms_)[: rng.integers(1, terms_ + 1)] for _ in range(4)]
    wanted.sort(key=len, reverse=True)
    matrix = np.zeros((4, len(wanted[0])), np.int64)
    for i, w in enumerate(wanted):
        matrix[i, : len(w)] = w
    total = bitsliced.add(bits, matrix, np.array([len(w) for w in wanted]))
    top = np.unpackbits(bitsliced.descend(total, k).view(np.uint8), axis=1, bitorder="little")[:, :docs]
    for i, w in enumerate(wanted):
        sums = dense[w].sum(0)
        best = [d for d in np.lexsort((np.arange(docs), -sums)).tolist() if sums[d]][:k]
        assert np.flatnonzero(top[i]).tolist() == sorted(best)
