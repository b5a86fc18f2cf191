"""Ranked lexical search by a bit-sliced index of impacts: every document scored for every query with bitwise additions.

1. Texts are cut into terms by array operations on bytes. Each task writes blocks of documents (ids, lengths, and for each term that
   some query asks for the documents that hold it and how often) to the shared folder: the texts are read once.
2. Counts over all blocks give the number of documents, their terms, and the documents of each term: a row a term, added up by Spark.
3. Each block becomes bitmaps: for a term, slice s has bit s of the term's impact in each document. The bitmaps of a query's
   terms are added with carries, 64 documents a word and all queries at once, so that the sums lie in slices too. From the most
   significant slice down, documents are told apart until k are left; only their scores are put together. A task keeps k a query.

No pair of a query and a document is ever a row, and nothing is pruned by a guess: the result is exact. Queries go in
groups of at most QUERY_TERMS terms, each a pass over the texts, so what is broadcast is bounded whatever is asked. Blocks hold
fewer documents the more terms are asked for, so a block's bitmaps are bounded too.

Scores are integers: with N documents that have a term, L terms in all, n in the document, tf of them the term and df documents
that hold it, ``w * ((10**9 * tf) div (1000 * tf + 8 * (10 + (90 * n * N) div L)))`` summed over a query's terms, once each,
where ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``.

Defined results: a null or empty text has no terms, takes no part in N and is never found; texts of any length are read whole; rows
that share a doc_id or repeat are documents of their own, equal scores go to the smaller doc_id, null first; queries that share
an item_id (null is one too) are one query with the terms of all; a query without terms, or whose terms no document holds, has no
rows; empty tables give none; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, discard, save, table, trimmed

#: Most terms of a group of queries, bytes of a block's bitmaps, documents of a block, and bytes of sums that are held at once.
QUERY_TERMS, SLICE_BYTES, BLOCK_DOCS, SUM_BYTES = 1 << 16, 48 << 20, 4096, 32 << 20
#: Bits of one impact: less than 2 ** 20 times a weight, which is below 2 ** 16 up to 2 ** 90 documents.
IMPACT_BITS = 36
#: Bytes that no term has: ASCII but for digits and letters.
SEPARATORS = np.arange(256) < 128
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

BLOCK = "doc_ids array<long>, lengths binary, terms binary, starts binary, places binary, counts binary"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Terms:
    """The terms of a group of queries by number, found by hash and confirmed by all their bytes."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(terms) + b"\0" * 8, np.uint8)
        hashed = bytewords.hashes(self.buf, self.start, self.size) if terms else np.zeros(0, np.uint64)
        self.order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of one group of queries share a hash")

    def numbers(self, words: bytewords.Words) -> np.ndarray:
        """The number of each word; -1 for one that is not asked for."""
        out = np.full(len(words.start), -1, np.int64)
        if not len(self.order):
            return out
        hashed = bytewords.hash_words(words)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.order) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashed)
        number = self.order[at[hit]]
        same = words.size[hit] == self.size[number]
        live, ofs = np.flatnonzero(same), 0
        while len(live):
            same[live] = words.buf[words.start[hit[live]] + ofs] == self.buf[self.start[number[live]] + ofs]
            ofs += 1
            live = live[same[live] & (self.size[number[live]] > ofs)]
        out[hit[same]] = number[same]
        return out


def _packed(ids: list, lengths: list, pairs: list) -> pa.RecordBatch:
    """One block: documents by ascending doc_id, null first, and postings by term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term, doc, count = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(3))
    doc = place[doc]
    by = np.lexsort((doc, term))
    term, doc, count = term[by], doc[by], count[by]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    raw = (np.array(lengths, "<i8")[order].tobytes(), term[first].astype("<i4").tobytes(), np.append(first, len(term)).astype("<i4").tobytes(), doc.astype("<u2").tobytes(), count.astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *[pa.array([r], pa.binary()) for r in raw]], ["doc_ids", "lengths", "terms", "starts", "places", "counts"])


def _blocks(terms, docs: int):
    """Batches of texts -> blocks of at most ``docs`` documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms.value)
        ids: list = []
        lengths: list = []
        pairs: list = []
        for batch in batches:
            words = bytewords.split(batch.column("text"), SEPARATORS, lower=True)
            number, many = known.numbers(words), np.diff(words.first)
            of = np.repeat(np.arange(len(many)), many)
            asked = np.flatnonzero(number >= 0)
            key, count = np.unique(of[asked] << 32 | number[asked], return_counts=True)
            row, term = key >> 32, key & 0xFFFFFFFF
            full = np.flatnonzero(many)
            doc_id = batch.column("doc_id").to_pylist()
            for at in range(0, len(full), docs):  # rows of a batch, to fill what is left of a block and then more
                some = full[at : at + docs]
                while len(some):
                    take, some = some[: docs - len(ids)], some[docs - len(ids) :]
                    a, b = np.searchsorted(row, [take[0], take[-1] + 1])
                    pairs.append((term[a:b], len(ids) + np.searchsorted(take, row[a:b]), count[a:b]))
                    ids += [doc_id[i] for i in take.tolist()]
                    lengths += many[take].tolist()
                    if len(ids) == docs:
                        yield _packed(ids, lengths, pairs)
                        ids, lengths, pairs = [], [], []
        if ids:
            yield _packed(ids, lengths, pairs)

    return trimmed(run)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: documents and terms at -1, and the documents of each term at its number."""
    docs = length = 0
    found = np.zeros(0, np.int64)
    for batch in batches:
        for raw, term, start in zip(*(batch.column(c).to_pylist() for c in ("lengths", "terms", "starts")), strict=True):
            n, t = np.frombuffer(raw, "<i8"), np.frombuffer(term, "<i4")
            docs, length = docs + len(n), length + int(n.sum())
            if len(t) and t[-1] >= len(found):
                found = np.concatenate([found, np.zeros(int(t[-1]) + 1 - len(found), np.int64)])
            found[t] += np.diff(np.frombuffer(start, "<i4"))
    used = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used)), pa.array(np.append(docs, found[used])), pa.array(np.append(length, 0 * used))], ["term", "docs", "length"])


def weight(docs: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``docs`` documents hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Scores of single terms: their weights, how often documents hold them, and the documents' lengths."""
    m = 10 + 90 * lengths * docs // length
    return weights * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def slices(impact: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, words: int) -> np.ndarray:
    """(slice, row, word) bitmaps: bit s of the impact of each row at each place. Postings are sorted by row, then place."""
    many = int(impact.max(initial=0)).bit_length()
    out = np.zeros((many, rows * words), np.uint64)
    word, bit = row * words + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
    for s in range(many):
        has = np.flatnonzero(impact >> s & 1)
        if len(has):
            w = word[has]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[s, w[first]] = np.bitwise_or.reduceat(bit[has], first)
    return out.reshape(many, rows, words)


def add(bits: np.ndarray, wanted: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(slice, query, word) sums of the rows of ``bits`` that each query wants, by carries. Queries come by falling number of rows."""
    depth = bits.shape[0] + max(1, int(many.max(initial=1))).bit_length()
    total = np.zeros((depth, len(many), bits.shape[2]), np.uint64)
    for t in range(wanted.shape[1]):
        live = int(np.searchsorted(-many, -t, side="left"))  # queries of more than t terms
        rows = wanted[:live, t]
        carry = np.zeros((live, bits.shape[2]), np.uint64)
        for s in range(depth):
            sum_ = total[s, :live]
            if s < len(bits):
                b = bits[s, rows]
                half = sum_ ^ b
                b &= sum_
                total[s, :live] = half ^ carry
                half &= carry
                carry = b | half
            else:
                if not carry.any():
                    break
                total[s, :live], carry = sum_ ^ carry, sum_ & carry
    return total


def descend(total: np.ndarray, k: int) -> np.ndarray:
    """(query, word) bitmaps of the k documents of highest sums above 0, equal ones by place, from the top slice down."""
    sure = np.zeros(total.shape[1:], np.uint64)
    open_ = np.bitwise_or.reduce(total, axis=0)
    for s in range(len(total) - 1, -1, -1):
        high = open_ & total[s]
        both = sure | high
        found = np.bitwise_count(both).sum(1)
        sure = np.where((found <= k)[:, None], both, sure)
        open_ = np.where((found < k)[:, None], open_ & ~total[s], np.where((found > k)[:, None], high, np.uint64(0)))
    room = k - np.bitwise_count(sure).sum(1).astype(np.int64)
    ties = np.flatnonzero(open_.any(1))
    if len(ties):
        flat = np.unpackbits(open_[ties].view(np.uint8), axis=1, bitorder="little").astype(bool)
        flat &= np.cumsum(flat, axis=1) <= room[ties][:, None]
        sure[ties] |= np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    return sure


def _top(query: np.ndarray, score: np.ndarray, tie: list, k: int) -> np.ndarray:
    """Places of the k best of each query."""
    order = sorted(range(len(tie)), key=lambda i: (query[i], -score[i], tie[i] is not None, tie[i] or 0))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    return np.array(order, np.int64)[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def search_block(row: dict, weights: np.ndarray, docs: int, length: int, query: np.ndarray, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(query, score, doc_id) of the best of a block. ``query`` and ``term`` are the queries' terms, sorted by query."""
    ids, n = row["doc_ids"], np.frombuffer(row["lengths"], "<i8")
    terms, starts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["starts"], "<i4")
    place, count = np.frombuffer(row["places"], "<u2").astype(np.int64), np.frombuffer(row["counts"], "<i8")
    at = np.repeat(np.arange(len(terms)), np.diff(starts))
    words = -(-len(ids) // 64)
    bits = slices(impacts(weights[terms[at]], count, n[place], docs, length), at, place, len(terms), words)
    if not bits.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    here = np.full(len(weights), -1, np.int64)
    here[terms] = np.arange(len(terms))
    has = here[term] >= 0
    query, wanted = query[has], here[term[has]]
    asked, first, many = np.unique(query, return_index=True, return_counts=True)
    order = np.argsort(-many, kind="stable")
    asked, first, many = asked[order], first[order], many[order]
    step = max(1, SUM_BYTES // (8 * words * (len(bits) + 24)))
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(asked), step):
        some, most = many[a : a + step], int(many[a])
        matrix = np.zeros((len(some), most), np.int64)
        inside = np.arange(most) < some[:, None]
        matrix[inside] = wanted[(first[a : a + step, None] + np.arange(most))[inside]]
        total = add(bits, matrix, some)
        q, p = np.nonzero(np.unpackbits(descend(total, k).view(np.uint8), axis=1, bitorder="little"))
        score = np.zeros(len(q), np.int64)
        for s in range(len(total)):
            score |= (total[s, q, p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s
        out[0].append(asked[a : a + step][q])
        out[1].append(score)
        out[2].extend(ids[i] for i in p.tolist())
    return np.concatenate(out[0]), np.concatenate(out[1]), out[2]


def _searcher(sent, k: int):
    """All blocks of a task; it sends the k best of each query on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, docs, length, query, term = sent.value
        held: tuple[np.ndarray, np.ndarray, list] = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        for batch in batches:
            for row in batch.to_pylist():
                found = search_block(row, weights, docs, length, query, term, k)
                q, score, tie = np.concatenate([held[0], found[0]]), np.concatenate([held[1], found[1]]), held[2] + found[2]
                best = _top(q, score, tie, k)
                held = q[best], score[best], [tie[i] for i in best.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[2], pa.int64()), pa.array(held[1], pa.int64())], ["query", "doc_id", "score"])

    return trimmed(run)


def _group(docs: DataFrame, numbered: list[tuple[int, str]], k: int) -> tuple[DataFrame, DataFrame]:
    """(query, doc_id, score of each query's k best in each task; the table of blocks) for one group of queries."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in numbered})
    number = {t: i for i, t in enumerate(terms)}
    pairs = np.array(sorted({(q, number[t]) for q, t in numbered}), np.int64).reshape(-1, 2)
    block = max(64, min(BLOCK_DOCS, SLICE_BYTES * 8 // (IMPACT_BITS * max(1, len(terms))) // 64 * 64))
    bounded_batches(spark)
    blocks = save(docs.mapInArrow(_blocks(spark.sparkContext.broadcast([t.encode() for t in terms]), block), BLOCK), "search-blocks")
    bounded_batches(spark, rows=1)
    counted = blocks.select("lengths", "terms", "starts").mapInArrow(_statistics, "term long, docs long, length long")
    holding, n, length = np.zeros(len(terms), np.int64), 0, 0
    for r in counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).collect():  # a row for each term of the group
        if r["term"] < 0:
            n, length = r["docs"], r["length"]
        else:
            holding[r["term"]] = r["docs"]
    weights = np.array([weight(n, int(x)) for x in holding], np.int64)
    sent = spark.sparkContext.broadcast((weights, n, length, pairs[:, 0].copy(), pairs[:, 1].copy()))
    return blocks.mapInArrow(_searcher(sent, k), "query long, doc_id long, score long"), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    lower = F.translate(F.col(item_text), _UPPER, _LOWER)
    asked = save(items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))).alias("term")).distinct(), "search-queries")
    groups = max(1, -(-asked.count() // query_terms))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hits = []
    for g in range(groups):
        of = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = of.collect()  # about QUERY_TERMS rows, whatever is asked
        names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is not None, x))
        number = {x: i for i, x in enumerate(names)}
        found, _ = _group(texts, [(number[r["item_id"]], r["term"]) for r in rows], k)
        every = spark.createDataFrame(list(enumerate(names)), f"query long, item_id {items.schema[item_id].dataType.simpleString()}")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        hits.append(save(best.join(F.broadcast(every), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-hits"))
        discard(_)
    discard(asked)
    out = hits[0]
    for more in hits[1:]:
        out = out.unionAll(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents),
lens AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS big_n, CAST(coalesce(sum(n), 0) AS BIGINT) AS big_l FROM lens),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, big_n),
impact AS (SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS impact FROM tf JOIN lens USING (row) JOIN wt USING (term), total),
scored AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN impact USING (term) JOIN lens USING (row) GROUP BY item_id, row, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored) WHERE rank <= 10
"""
