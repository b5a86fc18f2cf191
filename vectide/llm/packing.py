"""Lexical retrieval packing: shards of a BM25 index give each seed document unused neighbours that fill its window.

Document frequencies and the mean length are those of the whole corpus. Each document is placed by two of its terms, drawn
by a hash of the term raced against its BM25 weight, the same for all documents: two documents draw the same term with about
the probability of their weighted overlap. Documents in that order are cut into shards of about SHARD_TOKENS ids, each an
inverted index that one task holds. A document's full windows are cut off first. Then, in a shard, the longest unused
rest is a seed; it is scored by all its terms against all unused documents, and these fill its window by falling score. The
one that does not fit is cut to close the window, and its rest is the next seed. Only where no unused document of the shard shares a
term the longest rests follow. The shard's last window is cut into sequences of powers of two, so nothing is padded.

A seed's neighbours come from its shard: of the corpus's ten best for a seed a part is in other shards (measured in the
README). ``whole_corpus`` asks every shard for every seed instead, in rounds: seeds of a round are windows that still have
room, then rests, then the longest unused documents, at most SEEDS; each shard returns its best unused documents, and a merge
keeps the part of the list that no unseen document of any shard can enter, so the result does not depend on
shards. Its time grows with the square of the corpus, and the driver holds 17 bytes a document (length, place, order, whether used).

Defined results: a null or empty text is its end id alone; each row is packed by itself, also rows that repeat a doc_id;
texts of any length are encoded whole; equal scores go to the earlier row; an empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, discard, new_path, release, save, table, trimmed, trimmed_group
from vectide.llm.encode import encoder
from vectide.llm.tokenids import END, TOKENIZER, crc_of, id_type, joined_rows, split_rows

WINDOW = 2048
#: Ids a shard of the index holds, give or take a document, and shards that one task makes one after another.
SHARD_TOKENS, TASK_SHARDS = 1 << 19, 4
#: Seeds of a round; hits that a shard returns in a round for all of them, and the least and most for one.
SEEDS, HITS, LEAST_HITS, MOST_HITS = 4096, 1 << 16, 16, 4096
#: Pieces that the driver holds before they are written.
PIECE_ROWS = 200_000
#: Seeds whose hits are merged in one group.
MERGED = 128
#: Bytes of texts that a worker encodes at once; what lies between is some fifty times as much.
BATCH_BYTES = 1 << 20
#: BM25 parameters.
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lengths = e.encode(batch.column("text"), end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(lengths, pa.int64()), split_rows(ids.astype(kind), lengths)], ["doc_id", "place", "n", "ids"])

    return trimmed(run)


def terms(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) of every distinct id of every row, by row and id."""
    key = np.sort(np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32) | ids.astype(np.uint64))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(at, len(key)))


def _document_counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(terms(*joined_rows(batch.column("ids"), kind))[1])
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return trimmed(run)


class Index:
    """An inverted index of documents with BM25 weights."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> None:
        row, term, times = terms(ids, lengths)
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        weight = idf[term] * times * (K1 + 1) / (times + norm[row])
        self.rows = len(lengths)
        self.first = np.searchsorted(row, np.arange(len(lengths) + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def terms_of(self, row: int) -> np.ndarray:
        return self.term[self.first[row] : self.first[row + 1]]

    def search(self, query: np.ndarray, used: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best ``most`` unused rows that share a term with the query, by falling score, then row."""
        first = self.begin[query]
        many = self.begin[query + 1] - first
        ends = np.cumsum(many)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
        # each row's weights are added in the order of terms, whatever else the index holds
        score = np.bincount(self.row[at], weights=self.weight[at], minlength=self.rows)
        if used is not None:
            score[used] = 0
        if most < len(score):
            low = np.partition(score, len(score) - most)[len(score) - most]
            hit = np.flatnonzero((score >= low) & (score > 0))
        else:
            hit = np.flatnonzero(score)
        hit = hit[np.argsort(-score[hit], kind="stable")[:most]]
        return hit, score[hit]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """All unused rows by falling score against the seed's terms."""
        return self.search(self.terms_of(seed), used, self.rows)[0]


Pieces = list[tuple[int, int, int]]
#: (seeds, used rows, hits wanted) -> for each seed (rows by falling score, whether no other unused row has a score).
Ask = Callable[[np.ndarray, np.ndarray, int], list[tuple[np.ndarray, bool]]]


def pack_rests(lengths: np.ndarray, ask: Ask, window: int = WINDOW, seeds: int = SEEDS) -> Iterator[list[Pieces]]:
    """Windows of (row, start, length) that hold what full windows leave of each row, by rounds; the last one may be short."""
    at = lengths // window * window
    rest = (lengths - at).astype(np.int32)
    used = rest == 0
    order = np.argsort(-rest, kind="stable").astype(np.int32)
    pool, cursor = int(rest.sum()), 0
    unfilled: list[tuple[int, Pieces, int]] = []
    carried: list[int] = []
    while True:
        todo: list[tuple[int, Pieces | None, int]] = [*unfilled, *((r, [(r, int(at[r]), int(rest[r]))], window - int(rest[r])) for r in carried)]
        unfilled, carried = [], []
        while cursor < len(order) and used[order[cursor]]:
            cursor += 1
        if not pool:
            break
        # no more seeds than half of what is left can fill
        want = min(seeds, max(1, pool // (2 * window))) - len(todo)
        if want > 0:
            some = order[cursor : cursor + 16 * seeds]
            todo += [(r, None, 0) for r in some[~used[some]][:want].tolist()]
        todo, later = todo[:seeds], todo[seeds:]
        unfilled = [x for x in later if x[1] is not None]
        done: list[Pieces] = []
        answers = ask(np.array([x[0] for x in todo], np.int64), used, int(np.clip(HITS // len(todo), LEAST_HITS, MOST_HITS)))
        still: list[tuple[int, Pieces, int]] = []

        def fill(inside: Pieces, space: int, rows) -> int:
            nonlocal pool
            for r in rows:
                if not space:
                    break
                if used[r]:
                    continue
                used[r] = True
                pool -= int(rest[r])
                take = min(space, int(rest[r]))
                inside.append((int(r), int(at[r]), take))
                space -= take
                at[r] += take
                rest[r] -= take
                if rest[r]:
                    carried.append(int(r))
            return space

        for (seed, inside, space), (hits, complete) in zip(todo, answers, strict=True):
            if inside is None:
                if used[seed]:  # an earlier window of this round has it
                    continue
                used[seed] = True
                pool -= int(rest[seed])
                inside, space = [(seed, int(at[seed]), int(rest[seed]))], window - int(rest[seed])
            space = fill(inside, space, hits.tolist())
            if space and complete:  # no unused document shares a term
                space = fill(inside, space, order[cursor:])
            if space:
                still.append((seed, inside, space))
            else:
                done.append(inside)
        unfilled = still + unfilled
        yield done
    # nothing is unused: what unfilled windows hold makes windows again, in order
    out: list[Pieces] = [[]]
    space = window
    for _, inside, _ in todo:
        for r, start, n in inside:
            while n:
                take = min(n, space)
                out[-1].append((r, start, take))
                start, n, space = start + take, n - take, space - take
                if not space:
                    out.append([])
                    space = window
    yield [w for w in out if w]


def pieces_of(windows: list[Pieces], sequence: int, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(row, start, length, sequence, offset) of windows numbered from ``sequence``, and the next number. A short window makes sequences of falling powers of two."""
    pieces = []
    for inside in windows:
        left = sum(n for _, _, n in inside)
        size, offset = window if left == window else 1 << (left.bit_length() - 1), 0
        for r, start, n in inside:
            while n:
                take = min(n, size - offset)
                pieces.append((r, start, take, sequence, offset))
                start, n, offset, left = start + take, n - take, offset + take, left - take
                if offset == size:
                    sequence, offset = sequence + 1, 0
                    size = 1 << (left.bit_length() - 1) if left else 0
    return pieces, sequence


def pack_shard(lengths: np.ndarray, index: Index, window: int = WINDOW, seeds: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of pieces that hold every id of every row once, of rows that one index holds."""
    full = [(r, start, window) for r, n in enumerate(lengths.tolist()) for start in range(0, n - window + 1, window)]
    pieces = [(r, start, n, i, 0) for i, (r, start, n) in enumerate(full)]
    sequence = len(pieces)

    def ask(rows: np.ndarray, used: np.ndarray, most: int) -> list[tuple[np.ndarray, bool]]:
        found = [index.search(index.terms_of(r), used, most)[0] for r in rows.tolist()]
        return [(f, len(f) < most) for f in found]

    for windows in pack_rests(lengths, ask, window, seeds):
        more, sequence = pieces_of(windows, sequence, window)
        pieces += more
    return pieces


def _shards(kind: str, most: int):
    """Sorted rows to shards: (part, number, doc_ids, sizes, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs, sizes, held, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())], ["part", "number", "doc_ids", "sizes", "ids"])

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if docs and total + n > most:
                    yield shard()
                    docs, sizes, held, total, number = [], [], [], 0, number + 1
                docs.append(doc)
                sizes.append(n)
                held.append(ids)
                total += n
        if docs:
            yield shard()

    return trimmed(run)


def _read(batch: pa.RecordBatch, kind: str, base: dict[tuple[int, int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, ids, sizes) of shards."""
    for i in range(batch.num_rows):
        key = (batch.column("part")[i].as_py(), batch.column("number")[i].as_py())
        yield base[key], np.frombuffer(batch.column("ids")[i].as_buffer(), kind), batch.column("sizes")[i].values.to_numpy()


def _seed_terms(kind: str, base, seeds: np.ndarray):
    """(seed, its terms) of the seeds that a shard holds; ``seeds`` ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, sizes in _read(batch, kind, base.value):
                mine = seeds[np.searchsorted(seeds, first) : np.searchsorted(seeds, first + len(sizes))]
                ends = np.cumsum(sizes)
                found = [np.unique(ids[ends[r] - sizes[r] : ends[r]]) for r in (mine - first).tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(mine), split_rows(np.concatenate(found), np.array([len(f) for f in found]))], ["seed", "terms"])

    return trimmed(run)


def _retrieve(kind: str, base, idf, mean: float, shard_tokens: int, asked, most: int):
    """(group of seeds, hits of its seeds in one index): rows and scores, and how many of them each seed has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ends, bits = asked.value
        numbers, ids, sizes, held = [], [], [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            row = np.concatenate(numbers)
            index = Index(np.concatenate(ids), np.concatenate(sizes), idf.value, mean)
            for g in range(0, len(ends), MERGED):
                found = [index.search(queries[ends[q - 1] if q else 0 : ends[q]], None, most) for q in range(g, min(g + MERGED, len(ends)))]
                yield pa.RecordBatch.from_arrays([pa.array([g // MERGED], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (np.array([len(f[0]) for f in found], np.int64), row[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found]))]], ["g", "sizes", "rows", "scores"])

        for batch in batches:
            for first, all_ids, n in _read(batch, kind, base.value):
                free = ~np.unpackbits(bits[first // 8 : (first + len(n)) // 8 + 1], count=first % 8 + len(n))[first % 8 :].astype(bool)
                if free.any():
                    numbers.append(first + np.flatnonzero(free))
                    ids.append(all_ids[np.repeat(free, n)])
                    sizes.append(n[free])
                    held += len(ids[-1])
                    if held >= shard_tokens:
                        yield from answers()
                        numbers, ids, sizes, held = [], [], [], 0
        if held:
            yield from answers()

    return trimmed(run)


def _merge(most: int):
    """The lists of a group's seeds over all shards, as far as no unseen document can enter them."""

    def run(group: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(x, t) for x, t in zip(r, ("<i8", "<i8", "<f8"), strict=True)] for r in zip(*[group[c].to_pylist() for c in ("sizes", "rows", "scores")], strict=True)]
        sizes, rows, complete = [], [], []
        ends = [np.cumsum(p[0]) for p in parts]
        for q in range(len(parts[0][0])):
            r = np.concatenate([p[1][e[q] - p[0][q] : e[q]] for p, e in zip(parts, ends, strict=True)])
            s = np.concatenate([p[2][e[q] - p[0][q] : e[q]] for p, e in zip(parts, ends, strict=True)])
            order = np.lexsort((r, -s))
            # a shard with ``most`` hits may hold more after its last one
            last = np.cumsum([p[0][q] for p in parts])[[p[0][q] == most for p in parts]] - 1
            keep = len(order)
            if len(last):
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                keep = int(place[last].min()) + 1
            sizes.append(min(keep, 4 * most))
            complete.append(sizes[-1] == len(order) and not len(last))
            rows.append(r[order[: sizes[-1]]])
        return pa.table({"g": group["g"][:1], "sizes": [np.array(sizes, np.int64).tobytes()], "rows": [np.concatenate(rows).tobytes()], "complete": [np.array(complete).tobytes()]}, schema=pa.schema([("g", pa.int64()), ("sizes", pa.binary()), ("rows", pa.binary()), ("complete", pa.binary())]))

    return trimmed_group(run)


def _cut(kind: str, base, full: dict[tuple[int, int], int], window: int):
    """Pieces of a shard's documents with their ids: full windows, and what the rounds made."""

    def run(shard: pa.Table, pieces: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return pa.table({c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}, schema=OUT)
        batch = shard.combine_chunks().to_batches()[0]
        (first, ids, sizes) = next(_read(batch, kind, base.value))
        many = sizes // window
        row = np.repeat(np.arange(len(sizes)), many)
        number = np.arange(len(row))
        start = (number - np.repeat(np.cumsum(many) - many, many)) * window
        key = (batch.column("part")[0].as_py(), batch.column("number")[0].as_py())
        made = [pieces[c].to_numpy().astype(np.int64) for c in ("row", "start", "length", "sequence", "offset")]
        row, start = np.concatenate([row, made[0] - first]), np.concatenate([start, made[1]])
        size, sequence, offset = (np.concatenate([a, b]) for a, b in ((np.full(len(number), window), made[2]), (full.value[key] + number, made[3]), (np.zeros(len(number), np.int64), made[4])))
        begin = (np.cumsum(sizes) - sizes)[row] + start
        ends = np.cumsum(size)
        flat = ids[np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)].astype("<u4")
        docs = batch.column("doc_ids")[0].values.take(pa.array(row))
        return pa.table([docs, *[pa.array(x, pa.int64()) for x in (start, size, sizes[row], sequence, offset)], split_rows(flat, size)], schema=OUT)

    def released(shard: pa.Table, pieces: pa.Table) -> pa.Table:
        try:
            return run(shard, pieces)
        finally:
            release()

    return released


OUT = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("number"), pa.array([x.values.to_numpy().astype("<i4").tobytes() for x in batch.column("sizes")], pa.binary())], ["part", "number", "sizes"])


def draw(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two terms of each row, by a race of the terms' hashes at the speed of their weights; -1 where there is no second."""
    row, term, times = terms(ids, lengths)
    chance = ((bytewords.mix((term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    race = -np.log(chance) / np.maximum(idf[term] * times * (K1 + 1) / (times + K1), 1e-9)
    first = np.searchsorted(row, np.arange(len(lengths) + 1))
    out = np.full((2, len(lengths)), -1, np.int64)
    for i in (0, 1):
        some = np.flatnonzero(np.diff(first) > 0)
        least = np.full(len(lengths), np.inf)
        least[some] = np.minimum.reduceat(race, first[some]) if len(some) else 0
        at = np.flatnonzero((race == least[row]) & (race < np.inf))[::-1]  # equal ones: the smaller term, written last
        out[i, row[at]] = term[at]
        race[np.flatnonzero(out[i, row] == term)] = np.inf
    return out[0], out[1]


def _routes(kind: str, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = draw(*joined_rows(batch.column("ids"), kind), idf.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(two)], [*batch.schema.names, "one", "two"])

    return trimmed(run)


def _pack_shards(kind: str, idf, mean: float, window: int, most: int):
    """Sorted rows of a partition, shard by shard, to pieces with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs, sizes, held, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            pieces = np.array(pack_shard(lengths, Index(ids, lengths, idf.value, mean), window), np.int64).reshape(-1, 5)
            pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
            row, start, size, sequence, offset = pieces.T
            ends = np.cumsum(size)
            begin = (np.cumsum(lengths) - lengths)[row] + start
            flat = ids[np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)].astype("<u4")
            owner = pa.concat_arrays(docs).take(pa.array(row))
            return pa.RecordBatch.from_arrays([owner, *[pa.array(np.ascontiguousarray(x), pa.int64()) for x in (start, size, lengths[row], (((part << 20) + number) << 24) + sequence, offset)], split_rows(flat, size)], OUT.names)

        for batch in batches:
            ids, lengths = joined_rows(batch.column("ids"), kind)
            ends = np.cumsum(lengths)
            begin = 0
            while begin < len(lengths):
                # the rows that this shard still takes, one at least
                base = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, base + most - total, "right")))
                if total and total + int(ends[begin]) - base > most:
                    yield shard()
                    docs, sizes, held, total, number = [], [], [], 0, number + 1
                    continue
                docs.append(batch.column("doc_id").slice(begin, stop - begin))
                sizes.append(lengths[begin:stop])
                held.append(ids[base : ends[stop - 1]])
                total += int(ends[stop - 1]) - base
                begin = stop
        if total:
            yield shard()

    return trimmed(run)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, whole_corpus: bool = False) -> DataFrame:
    """All documents in sequences of at most ``window`` ids: one row a piece, with its ids (unsigned 32-bit)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    vocab = max(encoder(tokenizer).vocab, end + 1)
    kind = id_type(vocab)
    bounded_batches(spark, size=BATCH_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), "text")
    encoded = save(rows.mapInArrow(_encode(tokenizer, end, kind), "doc_id long, place long, n long, ids binary"), "pack-ids")
    # numbers of the whole corpus: a vocabulary's worth
    found = np.zeros(vocab)
    for i, n in encoded.select("ids").mapInArrow(_document_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        found[i] = n
    total, tokens = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    mean = tokens / max(total, 1)
    idf = spark.sparkContext.broadcast(np.log(1 + (total - found + 0.5) / (found + 0.5)))
    if whole_corpus:
        return _pack_across(encoded, kind, idf, mean, tokens, window, shard_tokens)
    # rows that are alike in everything are told apart by their place
    by = ("one", "two", "doc_id", F.xxhash64("ids"), "place")
    routed = encoded.mapInArrow(_routes(kind, idf), "doc_id long, place long, n long, ids binary, one long, two long")
    ranged = routed.repartitionByRange(max(1, -(-tokens // (TASK_SHARDS * shard_tokens))), *by).sortWithinPartitions(*by)
    return ranged.select("doc_id", "ids").mapInArrow(_pack_shards(kind, idf, mean, window, shard_tokens), PIECES)


def _pack_across(encoded: DataFrame, kind: str, idf, mean: float, tokens: int, window: int, shard_tokens: int) -> DataFrame:
    """Packing whose seeds ask all shards, round by round."""
    spark = encoded.sparkSession
    ranged = encoded.repartitionByRange(max(1, -(-tokens // shard_tokens)), "doc_id", "ids", "place").sortWithinPartitions("doc_id", "ids", "place")
    shards = save(ranged.mapInArrow(_shards(kind, shard_tokens), "part long, number long, doc_ids array<long>, sizes array<long>, ids binary"), "pack-shards")
    discard(encoded)
    # lengths of all rows in order, the number of each shard's first row and of its first full window
    lengths, first_row, first_full = [np.zeros(0, np.int32)], {}, {}
    rows = sequence = 0
    for key, sizes in sorted(((r["part"], r["number"]), np.frombuffer(r["sizes"], "<i4")) for r in shards.mapInArrow(_sizes, "part long, number long, sizes binary").collect()):
        first_row[key], first_full[key] = rows, sequence
        rows, sequence = rows + len(sizes), sequence + int((sizes // window).sum())
        lengths.append(sizes)
    base, full = spark.sparkContext.broadcast(first_row), spark.sparkContext.broadcast(first_full)

    def ask(seeds: np.ndarray, used: np.ndarray, most: int) -> list[tuple[np.ndarray, bool]]:
        terms_of = {r["seed"]: np.frombuffer(r["terms"], kind).astype(np.int64) for r in shards.select("part", "number", "sizes", "ids").mapInArrow(_seed_terms(kind, base, np.sort(seeds)), "seed long, terms binary").collect()}
        queries = [terms_of[s] for s in seeds.tolist()]
        asked = spark.sparkContext.broadcast((np.concatenate(queries), np.cumsum([len(q) for q in queries]), np.packbits(used)))
        hits = shards.select("part", "number", "sizes", "ids").mapInArrow(_retrieve(kind, base, idf, mean, shard_tokens, asked, most), "g long, sizes binary, rows binary, scores binary")
        out: list[tuple[np.ndarray, bool]] = [(np.zeros(0, np.int64), True)] * len(seeds)
        for r in hits.groupBy("g").applyInArrow(_merge(most), "g long, sizes binary, rows binary, complete binary").collect():
            sizes, complete = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["complete"], bool)
            lists = np.split(np.frombuffer(r["rows"], "<i8"), np.cumsum(sizes)[:-1])
            out[r["g"] * MERGED : r["g"] * MERGED + len(sizes)] = zip(lists, complete.tolist(), strict=True)
        asked.destroy()
        return out

    # pieces of each round are written, so the driver never holds those of all
    path, keys, starts = new_path(spark, "pack-pieces"), sorted(first_row), np.array(sorted(first_row.values()), np.int64)
    names = ("part", "number", "row", "start", "length", "sequence", "offset")
    schema = ", ".join(f"{c} long" for c in names)
    held: list[tuple[int, int, int, int, int]] = []

    def flush() -> None:
        made = np.array(held, np.int64).reshape(-1, 5)
        shard = np.array(keys, np.int64).reshape(-1, 2)[np.searchsorted(starts, made[:, 0], "right") - 1] if len(made) else np.zeros((0, 2), np.int64)
        spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(x)) for x in (*shard.T, *made.T)], names=list(names))).coalesce(1).write.mode("append").parquet(path)
        held.clear()

    for windows in pack_rests(np.concatenate(lengths), ask, window):
        more, sequence = pieces_of(windows, sequence, window)
        held += more
        if len(held) > PIECE_ROWS:
            flush()
    flush()
    pieces = spark.read.schema(schema).parquet(path)
    return shards.groupBy("part", "number").cogroup(pieces.groupBy("part", "number")).applyInArrow(_cut(kind, base, full, window), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", crc_of("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence and a checksum of its ids."""
    return digest(pack_documents(table(spark, sf_dir, "documents")))
