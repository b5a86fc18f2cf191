"""MinHash near-dedup with min-max hashing: each permutation gives its minimum and its maximum, so half the
evaluations give a signature of the same length, unbiased and of lower variance.

1. A pass over the texts: distinct word shingles, a fingerprint of the whole set, 288 signature values of 144
   permutations, 48 band hashes of 6 values (of six permutations each), a 256-bit sketch. No set is stored.
2. Equal sets become one class; its smallest doc_id stands for it.
3. Band buckets with more than one class: every member is paired with the bucket's smallest member - a star, so a bucket of
   any size gives as many pairs as members. Pairs are confirmed on full sets, made anew from the texts they need.
4. Components of confirmed links. Where a bucket still holds several components, its members are open. Open members
   list their shingles by rarity among them; sets of the similarity share one of their rarest shingles (a
   prefix filter), early enough in both lists (a positional filter). First each open document is paired with one
   central document of another component, for a few rounds; then all pairs of different components that pass are
   confirmed, so of a large group with links missing, edited shingles - rare ones - rule nearly all pairs out unseen.
   This step loses nothing: a pair that shares a band is confirmed, ruled out, or known to be connected.
   A pair of similarity 0.8 shares no band with probability 5e-7. The sketch only chooses which stars to confirm first.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than ``k`` give one shingle, the whole
sequence; texts of any length are read whole; rows that share a doc_id are one document; a null doc_id links with nothing, its component is null and
it is kept; an empty table gives no rows; other columns are not read (near_duplicates) or kept (drop_near_duplicates).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm import bytewords
from vectide.llm.common import bounded_batches, discard, save, save_narrow, small, table, trimmed, unused
from vectide.llm.tokenids import joined_rows, split_rows

K, SIMILAR = 5, 80
PERMUTATIONS, BANDS, ROWS = 144, 48, 6
SEED = 20240229
#: Bits of the sketch, and the most that differ in stars: at similarity 0.8 half of 0.2, and six standard deviations.
SKETCH, SKETCH_BITS = 256, 54
#: Rounds of stars among open documents before all pairs that are left.
ROUNDS = 3
#: Counted ids up to which a list of documents is broadcast: 8 bytes each.
ID_ROWS = 500_000


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


_A, _B = _multipliers()
#: Places of the values in bands: maxima are turned by 25, so no band holds both ends of a permutation.
_ORDER = np.concatenate([np.arange(PERMUTATIONS), PERMUTATIONS + np.roll(np.arange(PERMUTATIONS), 25)])


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    w = bytewords.split(texts, bytewords.SPACES, lower=True)
    h = bytewords.hash_words(w)
    n = len(h)
    with np.errstate(over="ignore"):
        steps = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(k)]
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            rolled += bytewords.mix(h[i : n - k + 1 + i] + np.uint64(i)) * steps[i]
        rolled = bytewords.mix(rolled)
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:  # the whole sequence, told from longer ones by its number of words
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = bytewords.mix(np.array([whole * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the permutations of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    for at in range(0, len(x), 2048):
        v = _A[:, None] * x[None, at : at + 2048] + _B[:, None]
        a, b = v.min(1), v.max(1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit hashes; a band's number is part of its hash."""
    v = signatures[:, _ORDER].reshape(-1, ROWS, BANDS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(v), BANDS)).copy()
        for i in range(ROWS):
            h = bytewords.mix(h * np.uint64(0xD1342543DE82EF95) + v[:, i])
    return h.astype(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """(sets, 4) of 64 bits: a bit of each of 256 values."""
    with np.errstate(over="ignore"):
        bits = (signatures[:, :SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view("<i8")


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingle_sets(batch.column("text"), k)
            full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            sig = np.array([signature(sets[i]) for i in full], np.uint32).reshape(-1, 2 * PERMUTATIONS)
            with np.errstate(over="ignore"):
                f0 = np.array([int(bytewords.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
                f1 = np.array([int(bytewords.mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(7)).sum(dtype=np.uint64)) for s in sets], np.uint64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[full + 1] = BANDS
            marks = np.zeros((len(sets), 4), np.int64)
            marks[full] = sketches(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f0.astype(np.int64)), pa.array(f1.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(band_hashes(sig).ravel())), *[pa.array(np.ascontiguousarray(marks[:, i])) for i in range(4)]],
                ["doc_id", "n", "f0", "f1", "bands", "s0", "s1", "s2", "s3"],
            )

    return trimmed(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), split_rows(flat, sizes)], ["node", "set"])

    return trimmed(run)


def _listed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            nodes = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            for at in range(0, len(flat), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part], pa.int64()), pa.array(np.repeat(sizes, sizes)[part], pa.int64()), pa.array(flat[part].astype(np.int64))], ["node", "n", "shingle"])

    return trimmed(run)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, nx), (ys, ny) = (joined_rows(batch.column(c), "<u8") for c in ("set_a", "set_b"))
            ax, ay = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.sort(np.concatenate([xs[ax[i] : ax[i] + nx[i]], ys[ay[i] : ay[i] + ny[i]]]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared) > 0
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return trimmed(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, by minimum labels and pointer jumping; lineage is cut each round."""
    both = save_narrow(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "near-edges")
    labels = save_narrow(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "near-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        better = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = save_narrow(better.join(far, "next").select("node", F.col("label").alias("old"), F.least("next", "jump").alias("label")), "near-labels")
        discard(labels)
        labels = moved
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels.select("node", "label")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _near(x: str, y: str) -> Column:
    bits = [F.bit_count(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3] <= SKETCH_BITS


def _prefixes(texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, node, n, at) of the shingles of ``nodes`` that a similar set has to share one of: the rarest ones that are not a node's alone."""
    found = texts.join(small(nodes, limit=ID_ROWS), F.col("doc_id") == F.col("node")).select("doc_id", "text").mapInArrow(_listed(k), "node long, n long, shingle long")
    listed = save(found.distinct(), "near-listed")
    often = save(listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "near-often")
    ranked = listed.join(often, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")).cast("long"))
    # a set that is similar shares at least percent of this one, so one of the first n - ceil(n * percent / 100) + 1
    out = save(ranked.where((F.col("df") > 1) & (100 * (F.col("n") - F.col("at") + 1) >= percent * F.col("n"))).select("shingle", "node", "n", "at"), "near-prefixes")
    discard(listed, often)
    return out


def _may_be_similar(percent: int) -> Column:
    """Sizes fit, and a pair that shares this shingle first could still share enough; false within a component."""
    most = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")) + 1
    return (F.col("xcomp") != F.col("ycomp")) & _sizes_fit(F.col("xn"), F.col("yn"), percent) & ((100 + percent) * most >= percent * (F.col("xn") + F.col("yn")))


def _shared(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """Prefix rows of shingles that several components share, with the shingle's largest component."""
    first = prefixes.join(comps, "node")
    counted = first.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = save(counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("main")).where(F.col("comps") > 1).select("shingle", "main"), "near-main")
    return save(first.join(main, "shingle"), "near-shared")


_COLUMNS = ("node", "comp", "n", "at")


def _star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document outside a shingle's largest component with one row of it, the most central; at most one pair for a document."""
    y = shared.where(F.col("comp") == F.col("main")).groupBy("shingle").agg(F.min(F.struct("at", "node", "n", "comp")).alias("y"))
    y = save(y.select("shingle", F.col("y.node").alias("ynode"), F.col("y.comp").alias("ycomp"), F.col("y.n").alias("yn"), F.col("y.at").alias("yat")), "near-central")
    x = shared.where(F.col("comp") != F.col("main")).select("shingle", *[F.col(c).alias(f"x{c}") for c in _COLUMNS])
    fits = x.join(y, "shingle").where(_may_be_similar(percent)).withColumn("most", F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")))
    best = fits.groupBy("xnode").agg(F.max_by("ynode", F.struct("most", -F.col("ynode"))).alias("ynode"))
    return best.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"))


def _rare_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) that may be similar and have different components: every similar pair is there."""
    x = shared.where(F.col("comp") != F.col("main")).select("shingle", *[F.col(c).alias(f"x{c}") for c in _COLUMNS])
    y = shared.select("shingle", *[F.col(c).alias(f"y{c}") for c in _COLUMNS])
    return x.join(y, [x["shingle"] == y["shingle"], _may_be_similar(percent)]).select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = K, percent: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Links: 100 * shared shingles >= percent * all shingles of both; percent is 80 or more, as the bands are made for that.
    """
    if percent < 80:
        raise ValueError("bands and sketch are made for a similarity of 0.8 or more")
    spark = docs.sparkSession
    bounded_batches(spark, size=2 << 20)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = save(texts.mapInArrow(_signed(k), "doc_id long, n long, f0 long, f1 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"), "near-signed")
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    marks = [f"s{i}" for i in range(4)]
    classes = save(usable.groupBy("f0", "f1").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", *marks)], F.any_value("bands").alias("bands")), "near-classes")
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = save(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).where(F.col("members") > 1).select("bucket", "least"), "near-buckets")
    live = save(placed.join(small(shared), "bucket"), "near-live")
    about = classes.select("node", "n", *marks)
    rename = lambda x: about.select(*[F.col(c).alias(f"{x}{c}") for c in about.columns])

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = save_narrow(pairs.select("a", "b").distinct(), "near-pairs")
        nodes = save_narrow(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-nodes")
        sets = save(texts.join(small(nodes, limit=ID_ROWS), "doc_id").select("doc_id", "text").mapInArrow(_sets(k), "node long, set binary"), "near-sets")
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        out = save(with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "near-links")
        discard(nodes, sets)
        return out, pairs

    # rows that share a doc_id are one document: the classes of its sets are linked
    several = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("f0", "f1")).alias("low"), F.max(F.struct("f0", "f1")).alias("high")).where(F.col("low") != F.col("high")).select("doc_id")
    several = save_narrow(several, "near-several")
    repeats = not several.isEmpty()
    same = None
    if repeats:
        of_doc = usable.select("doc_id", "f0", "f1").join(small(several, limit=ID_ROWS), "doc_id").distinct().join(classes.select("f0", "f1", "node"), ["f0", "f1"])
        first_of = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"))
        same = save_narrow(of_doc.join(first_of, "doc_id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "near-same")
    stars = live.where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(rename("a"), F.col("a") == F.col("anode")).join(rename("b"), F.col("b") == F.col("bnode")).where(_sizes_fit(F.col("an"), F.col("bn"), percent) & _near("a", "b"))
    links, tried = confirmed(stars)
    links = links if same is None else save_narrow(links.union(same), "near-links")
    first = components(links)
    told = save(live.join(first, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("comp")), "near-told")
    mixed = told.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where(F.col("low") < F.col("high")).select("bucket")
    open_ = save_narrow(told.join(small(save_narrow(mixed, "near-mixed")), "bucket").select("node").distinct(), "near-open")
    prefixes = _prefixes(texts, open_, k, percent)
    labels = first
    for _ in range(ROUNDS):  # stars around central documents leave few documents apart
        comps = open_.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"))
        pairs = save(_star_pairs(_shared(prefixes, comps), percent).join(tried, ["a", "b"], "left_anti"), "near-star")
        if pairs.isEmpty():
            break
        more, new = confirmed(pairs)
        tried = save_narrow(tried.union(new), "near-tried")
        if more.isEmpty():
            break
        links = save_narrow(links.union(more), "near-links")
        labels = components(links)
    comps = open_.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"))
    rest = save(_rare_pairs(_shared(prefixes, comps), percent).join(tried, ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        more, _ = confirmed(rest)
        labels = components(links.union(more)) if not more.isEmpty() else labels
    of_class = classes.select("f0", "f1", "node").join(labels, "node", "left").select("f0", "f1", F.coalesce("label", "node").alias("component"))
    known = save_narrow(of_class, "near-components")
    out = signed.select("doc_id", "n", "f0", "f1").join(known, ["f0", "f1"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    # one component for each document, also if some of its rows have no shingles
    if repeats:
        least = out.join(small(several, limit=ID_ROWS), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = K, percent: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose document is kept: of each group of near copies, the smallest doc_id. All rows of a kept doc_id stay."""
    (name,) = unused(docs.columns, "gone")
    gone = save_narrow(near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    return docs.join(small(gone, limit=ID_ROWS), F.col("doc_id") == F.col(name), "left_anti")


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set of four-word shingles and the smallest doc_id that its links reach."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
