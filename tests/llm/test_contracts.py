"""The registered queries and the pipeline's stages against brute force, on a small table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectide.llm import linededup, mixing, nearcopies, packing, telephony, toxicity
from vectide.llm.queries import QUERIES

BAD = ["grumbling", "grumbles", "grumbled", "grumbler"]


def made_texts() -> list[str | None]:
    random.seed(11)
    words = [f"word{i}" for i in range(150)]
    body = lambda n: " ".join(random.choices(words, k=n))
    shared = [f"this line of more than forty characters stands in many texts, number {i}" for i in range(3)]
    texts: list[str | None] = [None, "", " \n", "One TWO three", "x" * 3000, "W" * 500 + " cc by"]
    for i in range(150):
        lines = [body(random.randrange(1, 60)) for _ in range(random.randrange(1, 5))]
        if i % 6 == 0:
            lines.insert(1, shared[i % 3])
        if i % 5 == 0:
            lines.append(" ".join([*random.choices(BAD, k=12), *random.choices(words, k=8)]))
        texts.append("\n".join(lines))
    base = random.choices([f"own{i}" for i in range(900)], k=120)
    for i in range(30):  # near copies, some linked only through others, and copies of the same text
        w = list(base)
        for j in range(random.choice([0, 0, 1, 2, 3, 5])):
            w[(37 * i + 11 * j) % 120] = f"e{i}x{j}"
        texts.append(" ".join(w))
    return texts + [body(5000), body(2500)]


TEXTS = made_texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("small")
    rows = [(3 * i + 1, t, ("en", "de", None)[i % 3], f"src{i % 9}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(any(b in (t or "") for b in BAD))) for d, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def texts(spark, folder) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library_ids(texts) -> dict[int, list[int]]:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts.items()}


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids(spark, folder, library_ids) -> None:
    start = 0
    want = {}
    for d in sorted(library_ids):
        want[d] = (start, len(library_ids[d]), crc(library_ids[d]))
        start += len(library_ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_ids"](spark, folder).collect()} == want


def holds_every_id(pieces: list, library_ids: dict[int, list[int]]) -> None:
    at = dict.fromkeys(library_ids, 0)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        ids = library_ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(x) for d, x in library_ids.items()}
    full: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in full.values())


def test_packing(spark, folder, library_ids) -> None:
    holds_every_id(QUERIES["op6_pack"](spark, folder).collect(), library_ids)


def components(sets: dict[int, set], percent: int = 80) -> dict[int, int]:
    label = {d: d for d in sets}
    ids = sorted(sets)
    moved = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


def shingles(text: str, k: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_copies(spark, folder, texts) -> None:
    sets = {d: shingles(t, 4) for d, t in texts.items()}
    label = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op7_near_copies"](spark, folder).collect()}
    assert got == {d: (len(sets[d]), label[d], label[d] == d) for d in texts}


def test_near_copies_of_repeated_ids(spark) -> None:
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, ""), (7, c), (7, None), (8, None), (None, a), (None, b), (20, c), (20, c)]
    out = nearcopies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    found = defaultdict(set)
    for r in out:
        found[r["doc_id"]].add(r["component_id"])
    assert dict(found) == {3: {3}, 5: {3}, 9: {3}, 7: {7}, 8: {8}, None: {None}, 20: {7}}
    kept = nearcopies.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(3, a), (7, c), (7, ""), (8, ""), (0, a), (0, b)])


def test_media(spark, folder, texts) -> None:
    for r in QUERIES["op8_media"](spark, folder).collect():
        payload = telephony.payload_of(texts[r["doc_id"]])
        kind = (telephony.MULAW, telephony.ALAW, telephony.ADPCM)[zlib.crc32(payload) % 3]
        media = telephony.wav(payload, kind)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == texts[r["doc_id"]].encode().rstrip(b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        pcm = telephony.resample(telephony.decode(kind, 64, payload), 8000, 16000).astype(np.int64)
        assert r["feature"] == f"{telephony.NAMES[kind]};samples={len(pcm)};rms={int(np.sqrt((pcm * pcm).sum() / len(pcm)))};turns={int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def test_stored_pcm_and_broken_files(spark, tmp_path) -> None:
    good = telephony.wav(bytes(range(256)) * 2, telephony.ADPCM)
    no_block = bytearray(good)
    no_block[32:34] = b"\0\0"
    rows = [(1, good), (2, bytes(no_block)), (3, None), (4, b""), (5, good[:30]), (6, b"RIFF0000WAVE")]
    out = telephony.store_pcm(spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in rows], "id int, media binary"), f"file://{tmp_path}/pcm")
    by = {r["id"]: r for r in out.collect()}
    want = telephony.resample(telephony.decode(telephony.ADPCM, 64, bytes(range(256)) * 2), 8000, 16000).astype("<i2").tobytes()
    assert bytes(by[1]["pcm"]) == want and by[1]["codec"] == "ima-adpcm" and by[1]["rate"] == 8000
    assert all(by[i]["pcm"] is None and by[i]["codec"] is None for i in (2, 3, 4, 5, 6))
    with pytest.raises(ValueError):
        telephony.parse_wav(bytes(no_block))


def test_language_model(spark, folder, texts) -> None:
    """Dictionary Kneser-Ney of order 2: base score, known tokens, probabilities that sum to one."""
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})), None] for d, t in texts.items()}
    out_of_training = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count, pairs = Counter(), Counter()
    for d, w in tokens.items():
        if not out_of_training[d]:
            count.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
    total, size = sum(count.values()), len(count)

    def discounts(values) -> tuple[float, float, float]:
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2])
        return 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]

    d2 = discounts(pairs.values())
    before = Counter(w for _, w in pairs)
    d1 = discounts(before.values())
    after: dict = defaultdict(Counter)
    for (v, w), c in pairs.items():
        after[v][w] = c
    less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    low = sum(d1[min(c, 3) - 1] for c in before.values()) / len(pairs)

    def probability(v, w) -> float:
        lower = less(before[w], d1) / len(pairs) + low / (size + 1)
        if v not in after:
            return lower
        n = sum(after[v].values())
        return less(after[v][w], d2) / n + sum(d2[min(c, 3) - 1] for c in after[v].values()) / n * lower

    for v in ["<s>", "word1", "one", "unheard of"]:
        assert math.isclose(sum(probability(v, w) for w in count) + probability(v, "never seen"), 1.0, rel_tol=1e-9)
    rows = QUERIES["op10_lm"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of_training[r["doc_id"]], len(w), sum(x in count for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (total + size + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(probability(v, x)) for v, x in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)


def test_toxicity_reads_no_held_out_label(spark, folder, tmp_path) -> None:
    out = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, folder).collect()}
    assert len(out) == len(TEXTS)
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit("zz")).withColumn("source", F.col("doc_id").cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    again = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, f"file://{tmp_path}").collect()}
    assert again == {d: r["score"] for d, r in out.items()}


def test_stages(spark, folder, library_ids) -> None:
    """Each stage on the whole table against what it has to do."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}
    # toxicity: what the query's scores reject goes, the rest is unchanged
    rejected = {r["doc_id"] for r in QUERIES["op3_toxicity"](spark, folder).collect() if r["predicted"]}
    assert {r["doc_id"]: r for r in stages["toxicity"](spark, docs, folder).collect()} == {d: r for d, r in rows.items() if d not in rejected} and rejected
    # lines
    where = defaultdict(set)
    for d, r in rows.items():
        for line in (r["text"] or "").split("\n"):
            key = linededup.line_key(line.encode())
            if len(key.decode()) >= 40:
                where[key].add(d)
    want = {}
    for d, r in rows.items():
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(where.get(linededup.line_key(x.encode()), ())) < 5 or d == max(where[linededup.line_key(x.encode())])]
        want[d] = r["text"] if len(kept) == len(lines) else "\n".join(kept)
    got = {r["doc_id"]: r for r in stages["line_dedup"](spark, docs, folder).collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    # near copies, five words
    label = components({d: shingles(r["text"] or "", 5) for d, r in rows.items()})
    assert {r["doc_id"]: r for r in stages["near_dedup"](spark, docs, folder).collect()} == {d: r for d, r in rows.items() if label[d] == d}
    # mixing: leaf sums are within a document of their quota, and nothing comes twice
    mixed = stages["mixing"](spark, docs, folder).collect()
    assert len({r["doc_id"] for r in mixed}) == len(mixed) and all(rows[r["doc_id"]] == r for r in mixed)
    n = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    counts = mixing.leaf_counts(docs)
    plan = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.plan(counts, corpus_pipeline.PIPELINE_SHARE, corpus_pipeline.PIPELINE_EPOCHS).collect()}
    taken, largest = Counter(), Counter()
    for r in counts.collect():
        leaf = r["domain"], r["lang"], r["source"]
        largest[leaf] = max(largest[leaf], r["n"])
        taken[leaf] += sum(n(x) for x in mixed if x["doc_id"] == r["doc_id"])
    assert sum(plan.values()) == int(sum(map(n, rows.values())) * corpus_pipeline.PIPELINE_SHARE)
    assert all(abs(taken[leaf] - q) <= largest[leaf] for leaf, q in plan.items())
    holds_every_id(stages["packing"](spark, docs, folder).collect(), library_ids)


def test_pipeline_runs_its_stages(spark, folder) -> None:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    # sequences are numbered by where they are made; pieces are the same
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    want, got = rows(docs), rows(corpus_pipeline.run(spark, folder))
    assert got == want and len({r[0] for r in got}) > 1


def test_the_pipeline_packs_among_all_documents(spark, folder, library_ids, monkeypatch) -> None:
    """The pieces are those of one index of the whole corpus, however small its shards are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = lambda: sorted(map(tuple, corpus_pipeline.pack(spark, docs, folder).collect()))
    one = packed()
    monkeypatch.setattr(packing, "pack_documents", partial(packing.pack_documents, shard_tokens=2000))
    assert sum(map(len, library_ids.values())) > 10 * 2000 and packed() == one
