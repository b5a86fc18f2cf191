"""Byte-level BPE against the library of the rank files, against a plain loop over odd ranks, and there and back."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.llm import bpe
from vectide.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
PIECES = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", " ", " ", "\n", "\t", "　", "1", "٣", "½", "!", "é", "日本", "́", "\x1c", "\U00010ee7", "\U0001f600", "R", "'s", "'ll", "  ", "the", " of"]


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(public_tokenizers.path(bpe.RANKS)).ranks, special_tokens={})


def split(ids: np.ndarray, many: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(many).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


def test_equals_the_library(library) -> None:
    random.seed(3)
    texts = ["".join(random.choices(PIECES, k=random.randrange(0, 25))) for _ in range(8000)] + ["", "'", "'r", " ", "\n ", " \n", "'re", "x'", "x'l", "don't you'll", "it's  'S"]
    coder = bpe.coder(public_tokenizers.path(bpe.RANKS))
    for _ in range(2):  # a second time from the memo
        assert split(*coder.encode(pa.array(texts))) == [library.encode_ordinary(t) for t in texts]
    forgetful = bpe.Coder(coder.ranks, slots=4)
    assert split(*forgetful.encode(pa.array(texts[:500]))) == [library.encode_ordinary(t) for t in texts[:500]]


def test_every_code_point(library) -> None:
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(f"a{c}1{c} {c}'" for c in every[i : i + 5000]) for i in range(0, len(every), 5000)]
    got = split(*bpe.coder(public_tokenizers.path(bpe.RANKS)).encode(pa.array(texts)))
    assert all(g == library.encode_ordinary(t) for g, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 100_000 + "c", "=-" * 100_000, "".join(random.Random(1).choices("abcdefgh", k=200_000)), "́" * 50_000])
def test_very_long_pre_tokens(library, text: str) -> None:
    begin = time.perf_counter()
    ids, many = bpe.coder(public_tokenizers.path(bpe.RANKS)).encode(pa.array([text]))
    assert time.perf_counter() - begin < 30  # a scan for each merge would take hours
    assert ids.tolist() == library.encode_ordinary(text) and many.tolist() == [len(ids)]


def plain(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=25), st.lists(st.text("abc", max_size=40), min_size=1, max_size=6), st.integers(0, 2**32))
def test_ranks_in_any_order(tokens: list[str], pieces: list[str], seed: int) -> None:
    """Ranks drawn at random: tokens whose parts come later, pairs that come before what made them, tokens that no merge reaches."""
    numbers = random.Random(seed).sample(range(70_000), 256 + len(tokens))
    ranks = dict(zip([*(bytes([i]) for i in range(256)), *(t.encode() for t in tokens)], numbers, strict=True))
    coder = bpe.Coder(ranks, slots=8)
    for p in pieces:
        if p:
            assert coder.merge(p.encode()) == plain(p.encode(), ranks)
            raw, _ = coder.decode(np.array(coder.merge(p.encode())))
            assert raw.tobytes() == p.encode()


def test_queue() -> None:
    queue, rng, held = bpe.RankQueue(70_000), random.Random(4), {}
    for _ in range(3000):
        if held and rng.random() < 0.4:
            rank, places = queue.take()
            assert rank == min(held) and places == sorted(held.pop(rank))
        else:
            rank, place = rng.choice([0, 255, 256, 65_535, 65_536, 69_999, rng.randrange(70_000)]), rng.randrange(1000)
            queue.push(rank, place)
            held.setdefault(rank, []).append(place)
    while held:
        rank, places = queue.take()
        assert rank == min(held) and places == sorted(held.pop(rank))
    assert not queue.buckets and not any(any(level) for level in queue.levels)


def test_bad_vocabularies_and_ids() -> None:
    every = {bytes([i]): i for i in range(256)}
    with pytest.raises(ValueError, match="byte 7"):
        bpe.Coder({k: v for k, v in every.items() if k != b"\x07"})
    with pytest.raises(ValueError, match="distinct"):
        bpe.Coder(every | {b"ab": 3})
    for bad in (300, 999, -1):
        with pytest.raises(ValueError, match="not in the vocabulary"):
            bpe.Coder(every | {b"ab": 500}).decode(np.array([1, bad]))


def test_query(spark, library, tmp_path) -> None:
    rows = [(1, None), (2, ""), (3, "It's  a tést,\n\n日本 123"), (3, "It's  a tést,\n\n日本 123"), (3, "other"), (None, "no id"), (4, "x" * 100_000), (5, " ".join(f"w{i}" for i in range(20_000)))]
    spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("own")).withColumn("DECODED", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_byte_bpe"](spark, f"file://{tmp_path}").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if d is None else d, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert got == sorted(want)


def test_empty_table_and_nulls(spark) -> None:
    empty = bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA)))
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0
    nulls = bpe.decode(spark.createDataFrame([(1, None), (None, None)], "doc_id long, ids array<int>")).collect()
    assert [(r["ids"], bytes(r["decoded"])) for r in nulls] == [([], b"")] * 2
