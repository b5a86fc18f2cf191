"""Perplexity under an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Three passes over the training texts and one over all texts:

1. Words: tasks count 64-bit hashes of their words; reducers of hash ranges write sorted hash arrays with counts. A word's
   number is its place in all of them.
2. Word pairs: tasks count pairs of numbers; a pair's key is its two numbers times an odd constant modulo 2 ** 64, which can be
   undone, so the key is a hash and the pair at once. Reducers of key ranges write sorted key arrays with counts, and
   send what contexts and continuations need on to reducers of number ranges: no word, however common, is one task's.
3. Scoring: workers map the arrays and look up a batch's distinct words and pairs, in order.

Order 2 is what the disk allowed for shuffle, arrays and results keeps whole: nothing is pruned or sampled. Tables of the
model are as long as the vocabulary or the set of pairs; neither the driver nor a broadcast holds them, only their file names.

The folder of the model has to be reachable by pyarrow's file systems; where it is mounted (file:) arrays are mapped,
elsewhere a worker reads them into memory.

Defined results: a null or empty text is its end alone; a null doc_id counts as the text "null" when documents are
held out; rows that share a doc_id count each; without training texts every probability is that of an unknown word; an
empty table gives no rows; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, new_path, save, table, trimmed, trimmed_group

#: Number of the end of a text in word hashes; words never get it.
END_HASH = np.uint64(1)
ODD = 0xD6E8FEB86659FD93
UNDO = pow(ODD, -1, 1 << 64)
#: Entries a task holds before it sends them, and tokens of the corpus for each range of keys.
HELD, RANGE_TOKENS = 3_000_000, 2_000_000
#: Counts from this on lie in a side array.
BIG = 255

PARTS = "shard long, raw binary, n long"


def planes(values: np.ndarray) -> bytes:
    """Integers by byte planes: high planes of small values are runs of zeros for the shuffle's compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted u64 keys as differences, then u64 values; high planes of small numbers compress to nothing."""
    steps = keys.astype("<u8").copy()
    steps[1:] -= keys[:-1].astype("<u8")
    return planes(steps) + b"".join(planes(v.astype("<u8")) for v in values)


def unpack_sorted(raw: bytes, n: int, values: int) -> list[np.ndarray]:
    out = [np.cumsum(unplanes(raw[: 8 * n], "<u8"), dtype=np.uint64)]
    return out + [unplanes(raw[8 * n * (i + 1) : 8 * n * (i + 2)], "<i8") for i in range(values)]


def merge(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, with the sums of their values."""
    if not keys:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int64) for _ in values]
    all_ = np.concatenate(keys)
    order = np.argsort(all_, kind="stable")
    all_ = all_[order]
    at = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, np.int64)
    return all_[at], [np.add.reduceat(np.concatenate(v).astype(np.int64)[order], at) if len(at) else np.zeros(0, np.int64) for v in values]


def count_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every text's words and its end, texts' places): text i has places[i] to places[i + 1]."""
    w = bytewords.split(texts, bytewords.SPACES, lower=True)
    h = bytewords.hash_words(w)
    h[h <= END_HASH] = np.uint64(2)
    n = len(texts)
    at = w.first + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner], out[at[1:] - 1] = h, END_HASH
    return out, at


# files


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Written under another name and moved, so a task that runs twice does no harm."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    import uuid

    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(draft, f"{path}/{name}")


_MAPPED: dict[str, np.ndarray] = {}


def read_array(folder: str, name: str, kind: str) -> np.ndarray:
    key = f"{folder}/{name}"
    if key not in _MAPPED:
        if len(_MAPPED) > 10_000:
            _MAPPED.clear()
        url = urlparse(folder)
        if url.scheme in ("", "file"):
            path = f"{unquote(url.path)}/{name}"
            with open(path, "rb") as f:
                f.seek(0, 2)
                size = f.tell()
            _MAPPED[key] = np.memmap(path, kind, "r") if size else np.zeros(0, kind)
        else:
            store, path = fs.FileSystem.from_uri(folder)
            with store.open_input_file(f"{path}/{name}") as f:
                _MAPPED[key] = np.frombuffer(f.read(), kind)
    return _MAPPED[key]


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _send(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys with counts as one row for each range of keys."""
    shards = shard_of(keys, bits)
    names, at = np.unique(shards, return_index=True)
    ends = [*at[1:].tolist(), len(keys)]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([pack_sorted(keys[a:b], counts[a:b]) for a, b in zip(at.tolist(), ends, strict=True)], pa.binary()), pa.array([b - a for a, b in zip(at.tolist(), ends, strict=True)], pa.int64())], ["shard", "raw", "n"])


def _held(source: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of keys over as much of a task's input as HELD allows."""
    keys, counts, held = [], [], 0
    for some in source:
        k, n = count_of(some)
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > HELD:
            k, (n,) = merge(keys, [counts])
            if len(k) > HELD // 2:
                yield _send(k, n, bits)
                keys, counts, held = [], [], 0
            else:
                keys, counts, held = [k], [n], len(k)
    if keys:
        k, (n,) = merge(keys, [counts])
        if len(k):
            yield _send(k, n, bits)


def _words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _held((word_hashes(b.column("text"))[0] for b in batches if b.num_rows), bits)

    return trimmed(run)


def _word_range(folder: str):
    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        parts = [unpack_sorted(r, n, 1) for r, n in zip(group["raw"].to_pylist(), group["n"].to_pylist(), strict=True)]
        keys, (counts,) = merge([p[0] for p in parts], [[p[1] for p in parts]])
        write_array(folder, f"words-{shard}", keys.astype("<u8"))
        write_array(folder, f"counts-{shard}", counts.astype("<u8"))
        return pa.table({"shard": pa.array([shard], pa.int64()), "entries": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return trimmed_group(run)


@dataclass(frozen=True)
class Vocabulary:
    folder: str
    bits: int
    first: tuple[int, ...]  #: number of the first word of each range; the number of words at the end
    tokens: int

    def __len__(self) -> int:
        return self.first[-1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of sorted distinct hashes; -1 and 0 for unknown words."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, a, b in _runs(hashes, self.bits):
            if self.first[shard + 1] == self.first[shard]:
                continue
            known = read_array(self.folder, f"words-{shard}", "<u8")
            place = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            hit = known[place] == hashes[a:b]
            numbers[a:b][hit] = self.first[shard] + place[hit]
            counts[a:b][hit] = read_array(self.folder, f"counts-{shard}", "<u8")[place[hit]]
        return numbers, counts


def _runs(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys."""
    shards = shard_of(keys, bits)
    names, at = np.unique(shards, return_index=True)
    return list(zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def pair_keys(numbers: np.ndarray, at: np.ndarray, vocabulary: int) -> np.ndarray:
    """Key of every token with the one before it; a text's first follows the number ``vocabulary``. Both must be known."""
    before = np.empty(len(numbers), np.uint64)
    before[1:] = numbers[:-1].astype(np.uint64)
    before[at[:-1]] = np.uint64(vocabulary)
    with np.errstate(over="ignore"):
        return (before << np.uint64(32) | numbers.astype(np.uint64)) * np.uint64(ODD)


def _pairs(vocabulary: Vocabulary, bits: int):
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        h, at = word_hashes(batch.column("text"))
        unique, back = np.unique(h, return_inverse=True)
        return pair_keys(vocabulary.look_up(unique)[0][back], at, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _held((keys(b) for b in batches if b.num_rows), bits)

    return trimmed(run)


def _sums(ids: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return [ids[at], *(np.add.reduceat(v[order], at) if len(at) else np.zeros(0, np.int64) for v in values)]


def _pair_range(folder: str, step: int):
    """Writes a range of pairs; gives sums of its contexts (kind 0) and continuations (kind 1) by ranges of numbers."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        parts = [unpack_sorted(r, n, 1) for r, n in zip(group["raw"].to_pylist(), group["n"].to_pylist(), strict=True)]
        keys, (counts,) = merge([p[0] for p in parts], [[p[1] for p in parts]])
        del parts
        big = np.flatnonzero(counts >= BIG)
        write_array(folder, f"pairs-{shard}", keys.astype("<u8"))
        write_array(folder, f"times-{shard}", np.minimum(counts, BIG).astype(np.uint8))
        write_array(folder, f"places-{shard}", big.astype("<u4"))
        write_array(folder, f"many-{shard}", counts[big].astype("<u8"))
        with np.errstate(over="ignore"):
            plain = keys * np.uint64(UNDO)
        rows: dict[str, list] = {"shard": [], "kind": [], "raw": [], "n": [], "of_counts": []}
        of_counts = [int((counts == i).sum()) for i in (1, 2, 3, 4)]

        def give(kind: int, ids: np.ndarray, *values: np.ndarray) -> None:
            for part in np.unique(ids // step).tolist():
                a, b = np.searchsorted(ids, [part * step, (part + 1) * step])
                for name, x in (("shard", part), ("kind", kind), ("raw", pack_sorted(ids[a:b].astype(np.uint64), *(v[a:b] for v in values))), ("n", int(b - a)), ("of_counts", None)):
                    rows[name].append(x)

        left, right = (plain >> np.uint64(32)).astype(np.int64), (plain & np.uint64(0xFFFFFFFF)).astype(np.int64)
        give(0, *_sums(left, counts, *((counts == i).astype(np.int64) for i in (1, 2)), (counts >= 3).astype(np.int64)))
        give(1, *_sums(right, np.ones(len(right), np.int64)))
        if rows["of_counts"]:
            rows["of_counts"][0] = of_counts
        return pa.table(rows, schema=pa.schema([("shard", pa.int64()), ("kind", pa.int64()), ("raw", pa.binary()), ("n", pa.int64()), ("of_counts", pa.list_(pa.int64()))]))

    return trimmed_group(run)


def _number_range(folder: str, step: int, size: int):
    """Writes sums by number: of contexts (count, ones, twos, more), and continuations."""

    def run(group: pa.Table) -> pa.Table:
        part = group["shard"][0].as_py()
        low, n = part * step, min(step, size - part * step)
        contexts, continuations = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
        for kind, raw, many in zip(group["kind"].to_pylist(), group["raw"].to_pylist(), group["n"].to_pylist(), strict=True):
            ids, *values = unpack_sorted(raw, many, 4 if kind == 0 else 1)
            ids = ids.astype(np.int64) - low
            if kind == 0:
                for row, v in zip(contexts, values, strict=True):
                    row[ids] += v
            else:
                continuations[ids] += values[0]
        write_array(folder, f"contexts-{part}", contexts.astype("<u8"))
        write_array(folder, f"continuations-{part}", continuations.astype("<u8"))
        out = [int((continuations == i).sum()) for i in (1, 2, 3, 4)]
        return pa.table({"shard": pa.array([part], pa.int64()), "kinds": pa.array([int(continuations.sum())], pa.int64()), "of_counts": pa.array([out], pa.list_(pa.int64()))})

    return run


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of entries seen 1 to 4 times."""
    n1, n2, n3, n4 = of_counts
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(x, 0.0), i + 1.0) for i, x in enumerate(d))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    bits: int
    step: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    kinds: int  #: distinct pairs
    continued: tuple[int, int, int]  #: words with 1, 2, 3 or more continuations

    def by_number(self, name: str, numbers: np.ndarray, rows: int) -> np.ndarray:
        """(rows, numbers) of a file family that goes by number; ``numbers`` are sorted."""
        out = np.zeros((rows, len(numbers)), np.int64)
        for part in np.unique(numbers // self.step).tolist():
            a, b = np.searchsorted(numbers, [part * self.step, (part + 1) * self.step])
            values = read_array(self.vocabulary.folder, f"{name}-{part}", "<u8").reshape(rows, -1)
            out[:, a:b] = values[:, numbers[a:b] - part * self.step]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out = np.zeros(len(keys), np.int64)
        folder = self.vocabulary.folder
        for shard, a, b in _runs(keys, self.bits):
            known = read_array(folder, f"pairs-{shard}", "<u8")
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
            hit = np.flatnonzero(known[place] == keys[a:b])
            n = read_array(folder, f"times-{shard}", "u1")[place[hit]].astype(np.int64)
            big = np.flatnonzero(n == BIG)
            if len(big):
                n[big] = read_array(folder, f"many-{shard}", "<u8")[np.searchsorted(read_array(folder, f"places-{shard}", "<u4"), place[hit[big]])]
            out[a + hit] = n
        return out


def train(texts: DataFrame, folder: str) -> Model:
    """Count ``texts`` (text) and write the arrays of a model to ``folder``."""
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select("text")
    # a bound for tokens: half of the bytes; it only sets the number of ranges
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") / 7 + 1), F.lit(0.0))).first()[0]
    bits = max(0, int(size / RANGE_TOKENS).bit_length())
    width = (1 << bits)
    words = save(texts.mapInArrow(_words(bits), PARTS).groupBy("shard").applyInArrow(_word_range(folder), "shard long, entries long, tokens long"), "lm-words")
    entries = {r[0]: (r[1], r[2]) for r in words.collect()}  # a row for each range
    first = np.concatenate([[0], np.cumsum([entries.get(i, (0, 0))[0] for i in range(width)])])
    vocabulary = Vocabulary(folder, bits, tuple(int(x) for x in first), sum(x[1] for x in entries.values()))
    if len(vocabulary) >= 1 << 32:
        raise ValueError("numbers of words have 32 bits")
    step = max(1, -(-(len(vocabulary) + 1) // max(1, width)))
    sums = save(texts.mapInArrow(_pairs(vocabulary, bits), PARTS).groupBy("shard").applyInArrow(_pair_range(folder, step), "shard long, kind long, raw binary, n long, of_counts array<long>"), "lm-pairs")
    of_pairs = sums.where(F.col("of_counts").isNotNull()).select(*[F.col("of_counts")[i].alias(f"n{i}") for i in range(4)]).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(4)]).first()
    ranges = save(sums.drop("of_counts").groupBy("shard").applyInArrow(_number_range(folder, step, len(vocabulary) + 1), "shard long, kinds long, of_counts array<long>"), "lm-numbers")
    got = ranges.select("kinds", *[F.col("of_counts")[i].alias(f"n{i}") for i in range(4)]).agg(F.coalesce(F.sum("kinds"), F.lit(0)), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(4)]).first()
    return Model(vocabulary, bits, step, discounts(list(of_pairs)), discounts(list(got[1:])), got[0], (got[1], got[2], len(vocabulary) - got[1] - got[2]))


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens, known tokens, base score, log10 probability."""
    v = model.vocabulary
    size = len(v)
    h, at = word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    unique, back = np.unique(h, return_inverse=True)
    numbers, counts = v.look_up(unique)
    base = np.log10((counts + 1) / (v.tokens + size + 1))
    known = numbers >= 0
    seen = np.flatnonzero(known)
    # numbers grow with hashes, as both are sorted
    continued = np.zeros(len(unique), np.int64)
    continued[seen] = model.by_number("continuations", numbers[seen], 1)[0]
    if model.kinds:
        d = model.word_discounts
        low = (d[0] * model.continued[0] + d[1] * model.continued[1] + d[2] * model.continued[2]) / model.kinds
        p_word = np.maximum(continued - discount(continued, d), 0) / model.kinds + low / (size + 1)
    else:
        p_word = np.full(len(unique), 1 / (size + 1))
    context = np.zeros((4, len(unique) + 1))
    start = np.array([size], np.int64)
    if model.kinds:
        context[:, seen] = model.by_number("contexts", numbers[seen], 4)
        context[:, -1:] = model.by_number("contexts", start, 4)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = model.pair_discounts
        back_off = np.where(context[0] > 0, (d[0] * context[1] + d[1] * context[2] + d[2] * context[3]) / context[0], 1.0)
    # a pair of the batch is the place of its context among the batch's words, and the word's
    before = np.empty(len(back), np.int64)
    before[1:] = back[:-1]
    before[at[:-1]] = len(unique)
    pair, which = np.unique(before * (len(unique) + 1) + back, return_inverse=True)
    left, right = np.divmod(pair, len(unique) + 1)
    left_number = np.append(numbers, size)[left]
    both = np.flatnonzero((left_number >= 0) & (numbers[right] >= 0))
    times = np.zeros(len(pair), np.int64)
    if model.kinds:
        with np.errstate(over="ignore"):
            keys = (left_number[both].astype(np.uint64) << np.uint64(32) | numbers[right][both].astype(np.uint64)) * np.uint64(ODD)
        order = np.argsort(keys)
        times[both[order]] = model.pair_counts(keys[order])
    p = back_off[left] * p_word[right]
    some = times > 0
    p[some] += np.maximum(times[some] - discount(times[some], model.pair_discounts), 0) / context[0][left[some]]
    score = np.log10(p)
    n = len(texts)
    return np.diff(at), np.bincount(row, weights=known[back], minlength=n).astype(np.int64), np.bincount(row, weights=base[back], minlength=n), np.bincount(row, weights=score[which], minlength=n)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, known, base, score = score_texts(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return trimmed(run)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 7 == 2


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, base_score, score, perplexity."""
    out = docs.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and score of each document under a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")), new_path(spark, "lm-model"))
    return score_documents(docs, model).withColumn("train_tokens", F.lit(model.vocabulary.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
