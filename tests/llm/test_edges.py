"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectide.llm import licenses, linededup, lm, mixing, nearcopies, packing, telephony, tokenids, topk, toxicity
from vectide.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
LONG = " ".join(f"{w}{i}" for i in range(4000) for w in WORDS)
SHARED = "this passage of more than forty characters stands in many documents"
ROWS = [
    (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "one", None, None, 3), (4, " \n\t ", "de", "nonumber", 4), (5, LONG, "en", "src2", len(LONG)), (6, LONG, "en", "src2", None),
    *((10 + i, f"{SHARED}\nline {i} of its own, and some words more {i * 7}", "fr", "src0", 80) for i in range(6)),
    (20, "idiot " * 50, "en", "src0", 300), (21, "idiot " * 50, "en", "src0", 300), (21, "idiot " * 50, "en", "src0", 300), (None, "a row without an id", "en", "src3", 19), (None, None, None, None, None), (30, "x" * 100_000, "en", "src0", 100_000), (31, "\x00 ퟿ é 日本 cc by all rights reserved", "es", "src4", 30),
]
#: Names that operators use for helper columns or results, and plain ones.
EXTRA = (
    "node", "row", "key", "n", "score", "label", "at", "shard", "hashes", "k", "drop", "DROP_", "domain", "last", "bucket", "comp", "ids", "held_out", "all", "doc", "gone", "_gone", "_score", "place", "one", "two", "a", "b", "f0", "f1", "low", "high",
    "__row", "__all", "__drop", "__gone", "__score", "__n", "__domain", "__lang", "__source", "__doc", "__text", "__copies", "__copy", "__key", "__partial", "__full_epochs", "__rest", "__cut_key", "__p_domain", "media_",
)
#: Names of results, which replace such columns.
RESULTS = ("__lines", "__dropped", "__KEPT", "__n_words", "__n_base", "__first_word", "__last_word", "__labels", "__spans", "codec", "rate", "payload", "PCM")


@pytest.fixture(scope="module", params=["rows", "empty", "extra", "nulls"])
def docs(request, spark):
    """The tables of this module, with their number of rows."""
    if request.param == "nulls":
        return spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    df = spark.createDataFrame(ROWS if request.param != "empty" else [], SCHEMA)
    if request.param == "extra":
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in (*EXTRA, *RESULTS)])
    # as read from a file, which is how operators get their rows
    path = new_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.parquet(path)


def own_columns_stay(docs, out, replaced: tuple[str, ...] = ()) -> None:
    """Every value of the input's further columns is there as it was."""
    mine = [c for c in (*EXTRA, *RESULTS) if c in docs.columns and c.lower() not in {r.lower() for r in replaced}]
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower) and set(mine) <= set(out.columns)
    assert all(r[c] == f"own {c}" for r in out.select(*mine).collect() for c in mine)


def test_token_ids(spark, docs) -> None:
    path = tokenids.write_ids(docs, new_path(spark, "ids"))
    out = tokenids.read_ids(spark, path).orderBy("start").collect()
    assert len(out) == docs.count()
    start = 0
    for r in out:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"] and r["ids"][-4:] == b"\1\0\0\0"
        start += r["n_tokens"]
    known = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert known == sorted(known)


def test_packing(spark, docs) -> None:
    pieces = packing.pack_documents(docs, shard_tokens=1 << 14).collect()
    whole = tokenids.read_ids(spark, tokenids.write_ids(docs, new_path(spark, "ids"))).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in whole)
    lengths: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


def test_near_copies(spark, docs) -> None:
    out = nearcopies.near_duplicates(docs, k=4).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    if 5 in by:
        assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"]
        assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["component_id"] == 2
        assert by[3]["n_shingles"] == 1 and by[21]["component_id"] == 20
    assert all(r["kept"] for r in out if r["doc_id"] is None)


def test_lines(spark, docs) -> None:
    table = linededup.dedup_lines(docs)
    own_columns_stay(docs, table, ("__lines", "__dropped", "__kept"))
    out = table.collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    if 10 in by:
        assert [by[10 + i]["__dropped"] for i in range(6)] == [1] * 5 + [0]
        assert by[1]["__lines"] == by[2]["__lines"] == 1 and by[4]["__kept"] == " \n\t "


def test_lines_with_a_small_filter(spark) -> None:
    """Several shards, each with a filter of the smallest size, change nothing."""
    rows = [(i, "\n".join(f"line {j} that many documents have, or only few of them do" for j in range(i % 7, i % 7 + 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = linededup.dedup_lines(df).orderBy("doc_id").collect()
    counts: dict[str, list[int]] = {}
    for i, t in rows:
        for line in t.split("\n"):
            counts.setdefault(line, []).append(i)
    for (i, t), r in zip(rows, plain, strict=True):
        assert r["__kept"] == "\n".join(x for x in t.split("\n") if len(counts[x]) < 5 or i == max(counts[x]))
    # filters of one segment, so many bits a key that the hash space takes several passes
    assert linededup.dedup_lines(df, max_filter_bits=linededup.SEGMENT_BITS, bits_per_key=512).orderBy("doc_id").collect() == plain
    # one bit for sixteen keys: nearly every line is suspected
    crowded = linededup.dedup_lines(df.withColumn("text", F.concat("text", F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("a line of a single document, number "), i.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))), "\n"))), bits_per_key=1)
    assert [r["__dropped"] for r in crowded.orderBy("doc_id").collect()] == [r["__dropped"] for r in plain]


def test_licenses(spark, docs) -> None:
    table = licenses.scan_licenses(docs)
    own_columns_stay(docs, table, ("__n_words", "__n_base", "__first_word", "__last_word", "__labels", "__spans"))
    out = table.collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    if 31 in by:
        assert sorted(by[31]["__labels"]) == ["cc-by", "reserved"] and by[31]["__n_base"] == 2
        assert by[1]["__n_words"] == 0 and by[2]["__spans"] is None


def test_mixing(spark, docs) -> None:
    out = mixing.mix(docs, budget_share=1.0, max_epochs=1)
    assert out.columns == docs.columns
    own_columns_stay(docs, out)
    tokens = mixing.with_leaf(docs).agg(F.sum("__n")).first()[0] or 0
    taken = mixing.with_leaf(out).agg(F.sum("__n")).first()[0] or 0
    assert taken == tokens


def test_media(spark, docs) -> None:
    media = telephony.texts_as_media(docs)
    table = telephony.decode_media(media.select("*", *[F.lit(c).alias(c) for c in ("codec", "RATE", "Payload", "pcm", "own")]))
    assert table.columns == ["doc_id", "n_bytes", "media", "own", "codec", "rate", "payload", "pcm"]
    out = table.collect()
    assert len(out) == docs.count()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in out:
        assert any(telephony.payload_of(t) == r["payload"] for d, t in texts if d == r["doc_id"])


def test_language_model(spark, docs) -> None:
    rows = docs.select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    out = lm.score_documents(rows, lm.train(rows.where(~F.col("held_out")), new_path(spark, "lm"))).collect()
    assert len(out) == docs.count()
    assert all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in out)


def test_toxicity(spark, docs) -> None:
    labels = spark.createDataFrame([(20, 1, 1), (3, None, 0), (21, 1, 1), (10, 1, 0), (11, 0, None), (None, 1, 1), (20, 0, 0)], "doc_id long, quality int, toxic int")
    table = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    own_columns_stay(docs, table, ("__score",))
    out = table.collect()
    assert len(out) == docs.count()
    assert all(0 <= r["__score"] <= 1 for r in out)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch) -> None:
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} number {i} came home again" if i % 11 else None) for i in range(80)]
    taught = [(i, t or "", int(i % 3 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2 and i != 1]
    share = (sum(y for *_, y in taught) + 1) / (len(taught) + 3)  # the long text counts as a label, but teaches nothing
    wanted = toxicity.fit([t for _, t, _ in taught], np.array([y for *_, y in taught]), share)
    docs = spark.createDataFrame([(i, "friend " * 30_000 if i == 1 else t) for i, t in rows] + [rows[7]], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")

    def refused(*_):
        raise AssertionError("the driver takes texts apart")

    monkeypatch.setattr(toxicity.Inputs, "__init__", refused)
    got = toxicity.train(docs, labels)
    assert got.keys() == wanted.keys() and all(np.allclose(got[k], wanted[k], atol=1e-2) for k in wanted)
    nothing = toxicity.train(docs, labels.where("doc_id < 0"))
    assert not nothing["scale"].any() and nothing["shift"] == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, tmp_path_factory, name: str, stage) -> None:
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(20, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = stage(spark, docs, f"file://{folder}")
    if name != "packing":
        assert out.columns == docs.columns
        own_columns_stay(docs, out)
        assert out.count() <= docs.count()


def test_top_k_edges(spark) -> None:
    nan, inf = float("nan"), float("inf")
    rows = [(20 * i, [0.1 * i, -0.2, 0.3]) for i in range(1, 4)] + [(1, None), (2, [nan, 1.0, 1.0]), (3, [None, 1.0, 1.0]), (4, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, [0.5]), (7, []), (8, [1e6, 1e6, -1e6]), (9, [0.1, -0.2, 0.3]), (9, [0.1, -0.2, 0.3]), (60, [0.2, 0.2, 0.2])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, v string, norm double")
    q = topk.quantise(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(q, q.where(F.col("vec_id") % 20 == 0), 5).collect()}
    assert got == brute_top_k([(r["vec_id"], r["v"]) for r in q.collect()], 5)
    assert topk.exact_top_k(q.limit(0), q.limit(0), 5).count() == 0


def brute_top_k(rows: list, k: int) -> dict:
    out = {}
    for i, a in rows:
        if i % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in rows if j != i))[:k]
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_top_k_beyond_64_bits_is_refused(spark) -> None:
    q = topk.quantise(spark.createDataFrame([(20, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [2e9, 1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(q, q.where(F.col("vec_id") % 20 == 0), 1).collect()


@pytest.mark.parametrize("wave", [1 << 25, 500])
@pytest.mark.parametrize("spread", [0.0, 0.2, 1.0, 3.0])
def test_top_k_prunes_without_loss(spark, monkeypatch, spread: float, wave: int) -> None:
    """Long and short vectors, many equal ones, several buckets and blocks."""
    import numpy as np

    monkeypatch.setattr(topk, "WAVE_BYTES", wave)
    r = np.random.default_rng(5)
    size = np.exp(spread * r.normal(size=400))
    v = r.normal(size=(400, 6)) * size[:, None]
    v[100:200] = v[100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    q = topk.quantise(df, 8.0)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.exact_top_k(q, q.where(F.col("vec_id") % 20 == 0), 7, bucket_rows=90, query_rows=6).collect()}
    assert got == brute_top_k([(x["vec_id"], x["v"]) for x in q.collect()], 7)
