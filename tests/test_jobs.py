"""The jobs: reruns, growing input, a run that ended half way, settings, and their queries against SQL."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, selection_release, text_catalogue
from jobs.common import settings
from tests.test_queries import DATA, rows
from vectide.errors import ContractError

DOCS = "doc_id long, text string, lang string, source string, extra int"


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name: str) -> None:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def snapshot(folder) -> dict[str, str]:
    """Names and contents of all files that a reader would see."""
    return {str(p.relative_to(folder)): hashlib.md5(p.read_bytes()).hexdigest() for p in folder.rglob("*.parquet") if not p.name.startswith(("_", "."))}


def whole(spark, out: str) -> list:
    return sorted(map(repr, text_catalogue.cards_with_counts(spark, out).select(sorted(text_catalogue.cards_with_counts(spark, out).columns)).collect()))


class Corpus:
    """A folder of documents that grows, and a folder of output."""

    def __init__(self, spark, path) -> None:
        self.spark, self.path, self.out = spark, path, f"file://{path}/out"
        spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1)], text_catalogue.LABELS).write.parquet(f"{path}/labels.parquet")

    def add(self, docs: list) -> None:
        self.spark.createDataFrame([(*d, 7) for d in docs], DOCS).coalesce(1).write.mode("append").parquet(f"file://{self.path}/documents.parquet")

    def run(self, **config) -> dict:
        return text_catalogue.catalogue(self.spark, f"file://{self.path}", self.out, config)


FIRST = [(1, "one two\nthree", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (4, "été " * 60, "de", "b")]
SECOND = [(5, "\n\n", "en", "a"), (1, "again under an id that has come before", "en", "a"), (None, "x" * 50_000, "fr", None), (6, "w\t" * 3000, None, None)]


@pytest.fixture
def corpus(spark, tmp_path) -> Corpus:
    return Corpus(spark, tmp_path)


def test_growing_input(spark, corpus) -> None:
    corpus.add(FIRST)
    assert corpus.run() == {"documents": 4, "cards": 4}
    before = snapshot(corpus.path / "out" / "cards")
    assert corpus.run() == {"documents": 0, "cards": 0}
    assert snapshot(corpus.path / "out" / "cards") == before
    corpus.add(SECOND)
    assert corpus.run() == {"documents": 4, "cards": 4}  # only what is new
    after = snapshot(corpus.path / "out" / "cards")
    assert before.items() <= after.items()  # cards that were there are not written again
    got = {(r["doc_id"], r["text_sha256"]): r for r in text_catalogue.read_cards(spark, corpus.out).collect()}
    assert len(got) == len(FIRST + SECOND)
    groups = defaultdict(lambda: [0, 0, 0])
    for d, t, lang, source in FIRST + SECOND:
        t = t or ""
        r = got[d, hashlib.sha256(t.encode()).hexdigest()]
        n = len(re.findall(text_catalogue.WORD, t))
        name = next((f"{a}-{b - 1}" for a, b in ((0, 50), (50, 200), (200, 500), (500, 2000)) if n < b), "2000+")
        assert (r["n_words"], r["n_lines"], r["n_code_points"], r["word_bin"], r["lang"], r["source"]) == (n, t.count("\n") + 1 if t else 0, len(t), name, lang, source)
        assert (r["quality"], r["toxic"]) == {1: (1, 1), 4: (None, 1)}.get(d, (None, None))
        g = groups[lang, source, name]
        g[0], g[1], g[2] = g[0] + 1, g[1] + n, max(g[2], n)
    counts = text_catalogue.read_counts(spark, corpus.out).collect()
    assert {(r["lang"], r["source"], r["word_bin"]): [r["documents"], r["words"], r["longest"]] for r in counts} == groups


def test_two_runs_equal_one(spark, corpus, tmp_path_factory) -> None:
    corpus.add(FIRST)
    corpus.run(files_per_batch=1)
    corpus.add(SECOND)
    corpus.run(files_per_batch=1)
    other = Corpus(spark, tmp_path_factory.mktemp("once"))
    other.add(FIRST)
    other.add(SECOND)
    other.run()
    assert whole(spark, corpus.out) == whole(spark, other.out)


def test_goes_on_after_a_run_that_ended_half_way(spark, corpus, monkeypatch) -> None:
    corpus.add(FIRST)

    def fails(df, *_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_catalogue, "overwrite", fails)
        with pytest.raises(Exception, match="lost"):
            corpus.run()
    corpus.add(SECOND)
    assert corpus.run()["documents"] == len(SECOND)  # cards of the first run are kept
    assert text_catalogue.read_counts(spark, corpus.out).agg(F.sum("documents")).first()[0] == len(FIRST + SECOND)
    once = whole(spark, corpus.out)
    # a counts' checkpoint that is lost is made again from the cards
    shutil.rmtree(corpus.path / "out" / "checkpoint" / "counts")
    corpus.run()
    assert whole(spark, corpus.out) == once


def test_empty_table(spark, corpus) -> None:
    corpus.add([])
    assert corpus.run() == {"documents": 0, "cards": 0}
    corpus.add(FIRST)
    assert corpus.run()["documents"] == 4


def test_settings(corpus) -> None:
    assert settings({"a": 2}, {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ContractError, match="unknown settings: c"):
        settings({"c": 1}, {"a": 1})
    for bad in ([], [0, 5], [5, 3], [5, 5]):
        with pytest.raises(ContractError, match="word_bins"):
            corpus.run(word_bins=bad)
    for job in (selection_release, text_catalogue):
        with open(job.__file__.replace(".py", ".json")) as f:
            assert json.load(f) == job.DEFAULTS


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_release_reruns_and_leaves_other_partitions(spark, tmp_path) -> None:
    out, read = f"file://{tmp_path}/out", lambda: spark.read.schema(selection_release.MEMBERS).parquet(f"{out}/members").orderBy("direction", "share", "group_id", "rank").collect()
    small = {"directions": ["top"], "shares": [0.05]}
    about = selection_release.release(spark, str(DATA), out, small)
    first = read()
    assert len(first) == about["memberships"] and {(r["direction"], r["share"]) for r in first} == {("top", 0.05), ("random", 0.05)}
    assert selection_release.release(spark, str(DATA), out, small) == about and read() == first
    more = selection_release.release(spark, str(DATA), out, {"shares": [0.2, 0.5]})
    then = read()
    assert [r for r in then if r["share"] == 0.05] == first and len(then) == len(first) + more["memberships"]
    view = spark.read.parquet(f"{out}/view")
    assert view.count() == more["windows"] and view.agg(F.max("mask_top")).first()[0] == 3
    manifest = spark.read.json(f"{out}/manifest").collect()
    assert len(manifest) == 1 and manifest[0]["runs"] == more["runs"] and json.loads(manifest[0]["settings"])["shares"] == [0.2, 0.5]


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_release_refuses(spark, tmp_path) -> None:
    for bad in ({"shares": []}, {"shares": [0.0]}, {"shares": [0.1, 0.1]}, {"directions": ["up"]}, {"directions": []}, {"vector_width": 3}, {"colour": 1}):
        with pytest.raises(ContractError):
            selection_release.release(spark, str(DATA), f"file://{tmp_path}/out", bad)
    assert not (tmp_path / "out").exists()
