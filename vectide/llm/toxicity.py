"""Toxicity scores of a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is a word vector (hashed words) and two character vectors: means of hashed byte trigrams, with marks at both
ends, and of hashed beginnings, so spellings, stems and endings share what they have in common. Two gated recurrent layers, one for each
direction, read windows of WINDOW words; attention pools their states to a logit. Windows overlap by half and cover
every whole text; a document's score comes from its highest window, as one toxic passage makes a document toxic, with the
mean of its three highest and of all windows.

Training picks each document's highest window (several instances, one label), by Adam with backpropagation through
time, on a bounded sample: SAMPLE labelled documents of the classes, by smallest hash of doc_id, none held out. Scores are
calibrated on a part of the sample that the network has not seen, for the share of label 1 among all allowed labels.

Defined results: null and empty texts are one window without words; a null doc_id counts as the text "null" when
documents are held out; labels null or of unknown documents do not count, of several labels the largest does; if
the labels lack a class, every score is the share of label 1; words and texts of any length are read whole when they are scored;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, table, trimmed, unused

#: The sample of the fit: at most so many labelled documents of classes 0 and 1, none of more bytes (one task holds them).
SAMPLE, SAMPLE_BYTES = (3000, 1500), 200_000
WINDOW, STRIDE = 32, 16
#: Hashed words, trigrams and beginnings, width of each vector, width of a direction's state.
WORDS, TRIGRAMS, STARTS, WIDE, STATE = 1 << 14, 1 << 13, 1 << 15, 16, 16
#: Bytes of the beginnings that are hashed.
BEGINNINGS = (3, 4, 5, 6, 7, 9)
EPOCHS, BATCH, RATE, SEED = 12, 128, 4e-3, 11
#: Small samples get more epochs, up to this many batches.
STEPS = 500
#: Windows of one or two repeated words of clean texts that each batch gets besides: repetition alone is not toxic.
REPEATS = 12
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Inputs:
    """The words of a batch of texts: distinct words with their features, and windows over the sequence."""

    def __init__(self, texts: pa.Array) -> None:
        w = bytewords.split(texts, SEPARATORS, lower=True)
        # capital letters of Latin-1 in UTF-8
        high = np.flatnonzero((w.buf[:-1] == 0xC3) & (w.buf[1:] >= 0x80) & (w.buf[1:] <= 0x9E) & (w.buf[1:] != 0x97)) + 1
        w.buf[high] += 0x20
        unique, at, back = np.unique(bytewords.hash_words(w), return_index=True, return_inverse=True)
        self.word = back.astype(np.int32)
        self.word_row = (unique % np.uint64(WORDS)).astype(np.int32)
        start, size = w.start[at], w.size[at]
        self.gram_count = size
        ends = np.cumsum(size)
        made = int(ends[-1]) if len(ends) else 0
        self.gram_row = np.empty(made, np.int16)
        for a in range(0, len(size), 1 << 15):  # in parts: what lies between is several times the result
            n, s = size[a : a + (1 << 15)], start[a : a + (1 << 15)]
            e = np.cumsum(n)
            k = np.arange(int(e[-1])) - np.repeat(e - n, n)
            place = np.repeat(s, n) + k
            left = np.where(k == 0, 1, w.buf[np.maximum(place - 1, 0)].astype(np.int64))
            right = np.where(k == np.repeat(n, n) - 1, 2, w.buf[np.minimum(place + 1, len(w.buf) - 1)].astype(np.int64))
            gram = (left << 16) | (w.buf[place].astype(np.int64) << 8) | right
            begin = int(ends[a] - size[a])
            self.gram_row[begin : begin + len(gram)] = (gram * 2654435761 >> 7) % TRIGRAMS
        self.gram_begin = ends - size
        self.start_rows = np.stack([(bytewords.hashes(w.buf, start, np.minimum(size, b)) + np.uint64(b)) % np.uint64(STARTS) for b in BEGINNINGS], 1).astype(np.int32)
        n = np.diff(w.first)
        self.windows = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(n)), self.windows)
        number = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.begin = w.first[:-1][self.doc] + number * STRIDE
        self.length = np.clip(w.first[1:][self.doc] - self.begin, 0, WINDOW)

    def rows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of distinct words, mask), by step and window."""
        step = np.arange(WINDOW)[:, None]
        mask = step < self.length[windows][None, :]
        at = np.where(mask, self.begin[windows][None, :] + step, 0)
        return (self.word[at] if len(self.word) else np.zeros_like(at)), mask


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s, k=0.1: (r.normal(size=s) * k).astype(np.float32)
    return {
        "words": n(WORDS, WIDE), "grams": n(TRIGRAMS, WIDE, k=0.3), "starts": n(STARTS, WIDE, k=0.1), "x": n(3 * WIDE, 6 * STATE, k=0.25), "xb": np.zeros(6 * STATE, np.float32),
        "h0": n(STATE, 3 * STATE, k=0.2), "h1": n(STATE, 3 * STATE, k=0.2), "nb0": np.zeros(STATE, np.float32), "nb1": np.zeros(STATE, np.float32),
        "a": n(2 * STATE, STATE, k=0.2), "ab": np.zeros(STATE, np.float32), "av": n(STATE, k=0.3), "o": n(2 * STATE, k=0.3), "ob": np.zeros(1, np.float32),
    }


def vectors(p: dict[str, np.ndarray], x: Inputs, which: np.ndarray | None = None) -> np.ndarray:
    """Word vector and character vectors of distinct words."""
    if not len(x.word_row):
        return np.zeros((1, 3 * WIDE), np.float32)
    grams = np.add.reduceat(p["grams"][x.gram_row], x.gram_begin, axis=0) / x.gram_count[:, None].astype(np.float32)
    starts = p["starts"][x.start_rows[:, 0]]
    for i in range(1, len(BEGINNINGS)):
        starts = starts + p["starts"][x.start_rows[:, i]]
    return np.concatenate([p["words"][x.word_row], grams, starts / np.float32(2)], 1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    np.negative(v, out=v)
    np.exp(v, out=v)
    v += 1
    return np.reciprocal(v, out=v)


def _gru(gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, u: np.ndarray, nb: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    """States (step, window, STATE) of one direction; ``gates``: input part of the gates of each distinct word."""
    steps, n = rows.shape
    out = np.empty((steps, n, STATE), np.float32)
    h = np.zeros((n, STATE), np.float32)
    full = mask.all(1)
    for t in reversed(range(steps)) if back else range(steps):
        g = gates.take(rows[t], axis=0)
        hu = h @ u
        hn = hu[:, 2 * STATE :] + nb
        zr = _sigmoid(np.add(g, hu, out=hu)[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        new = r * hn
        new += g[:, 2 * STATE :]
        np.tanh(new, out=new)
        nxt = h - new
        nxt *= z
        nxt += new
        if not full[t]:
            nxt = np.where(mask[t][:, None], nxt, h)
        if keep is not None:
            keep.append((t, h, z, r, hn, new))
        h = out[t] = nxt
    return out


def gates_of(p: dict[str, np.ndarray], e: np.ndarray) -> list[np.ndarray]:
    """The input part of both directions' gates, for each distinct word."""
    return [e @ np.ascontiguousarray(p["x"][:, i : i + 3 * STATE]) + p["xb"][i : i + 3 * STATE] for i in (0, 3 * STATE)]


def forward(p: dict[str, np.ndarray], parts: list[np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    tapes: list[list | None] = [None, None] if keep is None else [[], []]
    states = np.concatenate([_gru(parts[i], rows, mask, p[f"h{i}"], p[f"nb{i}"], bool(i), tapes[i]) for i in (0, 1)], 2)
    look = np.tanh(states @ p["a"] + p["ab"])
    weight = look @ p["av"]
    weight[~mask] = -1e9
    weight -= weight.max(0)
    np.exp(weight, out=weight)
    weight *= mask  # a window without words pools to zero
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tn,tnk->nk", weight, states)
    if keep is not None:
        keep.update(tapes=tapes, states=states, look=look, weight=weight, pooled=pooled)
    return pooled @ p["o"] + p["ob"][0]


def backward(p: dict[str, np.ndarray], x: Inputs, e: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    g = {k: np.zeros_like(v) for k, v in p.items()}
    states, look, weight, pooled = keep["states"], keep["look"], keep["weight"], keep["pooled"]
    g["o"], g["ob"][0] = pooled.T @ d_logit, d_logit.sum()
    d_pooled = d_logit[:, None] * p["o"]
    d_states = weight[:, :, None] * d_pooled[None]
    d_weight = (states * d_pooled[None]).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0)[None])
    g["av"] = np.einsum("tn,tnk->k", d_score, look)
    d_look = d_score[:, :, None] * p["av"] * (1 - look * look)
    flat = d_look.reshape(-1, STATE)
    g["a"], g["ab"] = states.reshape(-1, 2 * STATE).T @ flat, flat.sum(0)
    d_states += d_look @ p["a"].T
    d_gates = np.zeros((len(e), 6 * STATE), np.float32)
    for i in (0, 1):
        u = p[f"h{i}"]
        d_h = np.zeros((rows.shape[1], STATE), np.float32)
        seen, parts = [], []
        for t, h, z, r, hn, new in reversed(keep["tapes"][i]):
            d_h = d_h + d_states[t][:, i * STATE : (i + 1) * STATE] * mask[t][:, None]
            live = mask[t][:, None].astype(np.float32)
            d_out = d_h * live
            d_new = d_out * (1 - z) * (1 - new * new)
            d_z = d_out * (h - new) * z * (1 - z)
            d_hn = d_new * r
            d_r = d_new * hn * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_hn], 1)
            g[f"h{i}"] += h.T @ d_hu
            g[f"nb{i}"] += d_hn.sum(0)
            seen.append(rows[t])
            parts.append(np.concatenate([d_z, d_r, d_new], 1))
            d_h = d_h * (1 - live) + d_out * z + d_hu @ u.T
        np.add.at(d_gates[:, 3 * STATE * i : 3 * STATE * (i + 1)], np.concatenate(seen), np.concatenate(parts))
    used = np.flatnonzero(np.abs(d_gates).sum(1))
    g["x"], g["xb"] = e[used].T @ d_gates[used], d_gates.sum(0)
    if len(x.word_row) and len(used):
        d_e = d_gates[used] @ p["x"].T
        np.add.at(g["words"], x.word_row[used], d_e[:, :WIDE])
        n = x.gram_count[used]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(x.gram_begin[used] - (ends - n), n)
        np.add.at(g["grams"], x.gram_row[at], np.repeat(d_e[:, WIDE : 2 * WIDE] / n[:, None].astype(np.float32), n, axis=0))
        for i in range(len(BEGINNINGS)):
            np.add.at(g["starts"], x.start_rows[used, i], d_e[:, 2 * WIDE :] / np.float32(2))
    return g


def window_logits(p: dict[str, np.ndarray], x: Inputs, size: int = 1024, most_words: int = 1 << 17) -> np.ndarray:
    """Logits of all windows, ``size`` at a time; a table of more distinct words is taken in parts, each with its own words."""
    out = np.empty(len(x.doc), np.float32)
    some_words = len(x.word_row) <= most_words
    step = max(1, len(out)) if some_words else 1 << 14
    parts = gates_of(p, vectors(p, x)) if some_words else None
    for begin in range(0, len(out), step):
        mine = np.arange(begin, min(begin + step, len(out)))
        mine = mine[np.argsort(-x.length[mine], kind="stable")]  # full windows together need no masks
        if not some_words:
            rows, _ = x.rows(mine)
            words, back = np.unique(rows, return_inverse=True)
            parts, back = gates_of(p, vectors(p, _subset(x, words))), back.reshape(rows.shape)
        for i in range(0, len(mine), size):
            rows, mask = x.rows(mine[i : i + size])
            out[mine[i : i + size]] = forward(p, parts, rows if some_words else back[:, i : i + size], mask)
    return out


def document_logits(p: dict[str, np.ndarray], x: Inputs) -> tuple[np.ndarray, np.ndarray]:
    """(highest logit, mean of the three highest, mean of all) and the highest window of each document."""
    logit = window_logits(p, x)
    n, begin = x.windows, np.cumsum(x.windows) - x.windows
    if not len(n):
        return np.zeros((0, 3)), begin
    order = np.lexsort((-logit, x.doc))
    high = logit[order].astype(np.float64)
    some = np.minimum(n, 3)
    three = sum(np.where(some > i, high[np.minimum(begin + i, len(high) - 1)], 0.0) for i in range(3)) / some
    return np.stack([high[begin], three, np.add.reduceat(high, begin) / n], 1), order[begin]


def fit(texts: list[str], labels: np.ndarray, share: float, seed: int = SEED, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters, with "scale" and "shift" of the calibration; ``share``: of label 1 where scores are for."""
    r = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return initial(seed) | {"scale": np.zeros(3), "shift": np.float64(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}
    x = Inputs(pa.array(texts, pa.string()))
    n = len(texts)
    unseen = r.permutation(n) % 6 == 0
    p = initial(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    begin = np.cumsum(x.windows) - x.windows
    train = np.flatnonzero(~unseen)
    clean_windows = np.flatnonzero(np.isin(x.doc, train[labels[train] == 0]) & (x.length > 0))
    clean_words = x.word[x.begin[clean_windows]] if len(clean_windows) else np.zeros(0, np.int64)
    epochs = max(epochs, min(60, -(-STEPS * BATCH // (2 * len(train)))))
    for epoch in range(epochs):
        random_ = begin + (r.random(n) * x.windows).astype(np.int64)
        if epoch < 2:
            picked, y = np.concatenate([random_[train]] * 2), np.concatenate([labels[train]] * 2)
            other = begin + (r.random(n) * x.windows).astype(np.int64)
            picked[len(train) :] = other[train]
        else:
            top = document_logits(p, x)[1]
            clean = train[labels[train] == 0]
            picked, y = np.concatenate([top[train], random_[clean]]), np.concatenate([labels[train], labels[clean]])
        order = r.permutation(len(picked))
        for i in range(0, len(order), BATCH):
            some, target = picked[order[i : i + BATCH]], y[order[i : i + BATCH]]
            rows, mask = x.rows(some)
            if len(clean_words):
                pair = clean_words[r.integers(0, len(clean_words), (2, REPEATS))]
                made = np.where(np.arange(WINDOW)[:, None] < r.integers(1, WINDOW + 1, REPEATS)[None, :], pair[0], pair[1])
                rows, mask = np.concatenate([rows, made], 1), np.concatenate([mask, np.ones_like(made, bool)], 1)
                target = np.concatenate([target, np.zeros(REPEATS, np.float32)])
            # the words of this batch only
            words, back = np.unique(rows, return_inverse=True)
            part = _subset(x, words)
            rows = back.reshape(rows.shape)
            e = vectors(p, part)
            keep: dict = {}
            logit = forward(p, gates_of(p, e), rows, mask, keep)
            d = ((1 / (1 + np.exp(-logit)) - target) / len(target)).astype(np.float32)
            g = backward(p, part, e, rows, mask, keep, d)
            step += 1
            rate = RATE * min(1.0, step / 20) * (0.3 if epoch >= epochs - 4 else 1.0)
            norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
            for k in p:
                a = g[k] / max(1.0, norm / 5) + (1e-5 * p[k] if k in ("words", "grams", "starts") else 0)
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    found = document_logits(p, x)[0]
    mine = np.flatnonzero(unseen)
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))[mine]
    scale, shift = calibrate(found[mine], labels[mine], weight)
    return p | {"scale": scale, "shift": np.float64(shift)}


def _subset(x: Inputs, words: np.ndarray) -> Inputs:
    out = Inputs.__new__(Inputs)
    n = x.gram_count[words] if len(x.word_row) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((x.gram_begin[words] if len(n) else n) - (ends - n), n)
    out.start_rows = x.start_rows[words] if len(n) else x.start_rows
    out.word_row, out.gram_row, out.gram_count, out.gram_begin = (x.word_row[words] if len(n) else n), x.gram_row[at], n, ends - n
    return out


def calibrate(found: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Scales and shift of a document's logits by weighted logistic regression, pulled towards the highest logit alone."""
    x = np.concatenate([found, np.ones((len(found), 1))], 1)
    prior, pull = np.array([1.0, 0.0, 0.0, 0.0]), np.array([0.5, 0.5, 0.5, 0.05])
    c = prior.copy()
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (q - label)) + pull * (c - prior)
        move = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(pull), g)
        c -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-9:
            break
    return c[:3], float(c[3])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _fitted(share: float, seed: int):
    """The parameters of a fit on all rows of a task, as the bytes of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        out = io.BytesIO()
        np.savez(out, **fit([t or "" for t in rows["text"].to_pylist()], rows["label"].to_numpy(), share, seed))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["parameters"])

    return trimmed(run)


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fit on at most ``sample`` documents of the two classes that are not held out, in one task: only parameters come to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id")]
    # at most ``sample`` ids: the bound of what is broadcast
    clean, toxic = (known.where(F.col("toxic") == label).orderBy(*order).limit(sample[label]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("label")) for label in (0, 1))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(clean.unionAll(toxic)), F.col("doc_id") == F.col("__id")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # rows that repeat a doc_id do not add to the bound
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bounded_batches(docs.sparkSession)
    made = rows.coalesce(1).mapInArrow(_fitted(share, seed), "parameters binary").first()
    if made is None:  # no labelled documents
        return fit([], np.zeros(0), share, seed)
    with np.load(io.BytesIO(made[0])) as saved:
        return {k: saved[k][()] for k in saved.files}


def _score(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Inputs(batch.column("text"))
            logit = document_logits(p, x)[0] @ p["scale"] if p["scale"].any() else np.zeros(batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(logit + p["shift"], -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(score, pa.float64())], [*batch.schema.names, name])

    return trimmed(run)


def score_toxicity(docs: DataFrame, parameters: dict[str, np.ndarray], name: str = "__score") -> DataFrame:
    """All columns of ``docs`` and ``name``, a score from 0 to 1 that takes the place of a column of the same name."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    bounded_batches(docs.sparkSession, size=2 << 20)
    shared = docs.sparkSession.sparkContext.broadcast(parameters)
    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(_score(shared, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns."""
    (name,) = unused(docs.columns, "score")
    return score_toxicity(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole document, fitted on a sample of labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
