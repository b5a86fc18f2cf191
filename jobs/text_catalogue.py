"""Text catalogue: a card for each new document, and counts of all cards for the explorer's charts. Incremental.

    python -m jobs.text_catalogue --tables DIR --out DIR [--config jobs/text_catalogue.json]

Two streams run until nothing new is left, each with its own checkpoint below ``out``:

1. documents -> cards: files that the checkpoint has not seen are read once. A card has the document's counts of words, lines and
   code points, a length bin, the display sample, a checksum, and the labels that were there when it was read. Cards are
   appended by language through the stream's file sink, which readers see batch by batch.
2. cards -> counts: new cards add to counts by language, source and length bin, which the stream keeps as state; each batch
   replaces the table of counts, by language. State is a row for each group, however many documents have come.

A rerun takes only what is new; with nothing new it changes nothing. A run that ended half way goes on where it was: both
sinks write a repeated batch once. Documents are taken as they come: one whose id has come before is a card of its own.

Defined results: a null text has no words or lines and the checksum of the empty text; null languages and sources are groups of
their own; columns that the input lacks are null, further ones are not read; a document with several labels has the largest.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import command_line, overwrite, settings
from vectide.errors import ContractError
from vectide.functions.sampling import hash_sample
from vectide.operators.metrics import null_safe_join

DEFAULTS = {"documents": "documents.parquet", "labels": "labels.parquet", "word_bins": [50, 200, 500, 2000], "sample_percent": 8, "files_per_batch": 256}
DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"
CARDS = "doc_id long, source string, n_words long, n_lines long, n_code_points long, word_bin string, in_sample boolean, text_sha256 string, quality int, toxic int, lang string"
COUNTS = "source string, word_bin string, documents long, words long, code_points long, sampled long, labelled long, toxic_documents long, longest long, lang string"
GROUP = ["lang", "source", "word_bin"]
WORD = r"[^\x20\x09-\x0D]+"
log = logging.getLogger("text_catalogue")


def word_bin(n: Column, bounds: list[int]) -> Column:
    """Names of length bins: "0-49", "50-199" and so on, the last one open."""
    lows = [0, *bounds]
    names = [f"{a}-{b - 1}" for a, b in zip(lows, bounds, strict=False)]
    return reduce(lambda c, i: F.when(n < bounds[i], names[i]).otherwise(c), range(len(bounds) - 1, -1, -1), F.lit(f"{lows[-1]}+"))


def cards_of(documents: DataFrame, labels: DataFrame, bounds: list[int], percent: int) -> DataFrame:
    """A card for each document, in the columns of CARDS. ``documents`` may be a stream."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counted = documents.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), lines.cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_code_points"),
        F.coalesce(hash_sample(F.col("doc_id"), percent), F.lit(False)).alias("in_sample"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), "lang",
    )
    joined = counted.withColumn("word_bin", word_bin(F.col("n_words"), bounds)).join(one, "doc_id", "left")
    return joined.select(*StructType.fromDDL(CARDS).fieldNames())


def counts_of(cards: DataFrame) -> DataFrame:
    """Counts of cards by language, source and length bin, in the columns of COUNTS. ``cards`` may be a stream."""
    labelled = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    out = cards.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), F.sum("n_code_points").alias("code_points"), F.count_if("in_sample").alias("sampled"), F.count_if(labelled).alias("labelled"),
        F.count_if(F.col("toxic") == 1).alias("toxic_documents"), F.max("n_words").alias("longest"),
    )
    return out.select(*StructType.fromDDL(COUNTS).fieldNames())


def _drained(query) -> int:
    """Wait for a stream to end; the rows that it read."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sum(p["numInputRows"] for p in query.recentProgress)


def catalogue(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Take the documents that have come to ``tables`` since the last run into ``out``; how many rows each stream read."""
    c = settings(config or {}, DEFAULTS)
    bounds = [int(b) for b in c["word_bins"]]
    if not bounds or bounds[0] <= 0 or bounds != sorted(set(bounds)):
        raise ContractError(f"word_bins {bounds}")
    labels = spark.read.schema(LABELS).parquet(f"{tables}/{c['labels']}")
    # as a pattern, which may name a single file too
    documents = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", int(c["files_per_batch"])).parquet(f"{tables}/{{{c['documents']}}}")
    cards = cards_of(documents, labels, bounds, int(c["sample_percent"])).writeStream.format("parquet").option("compression", "zstd").partitionBy("lang")
    read = _drained(cards.outputMode("append").option("checkpointLocation", f"{out}/checkpoint/cards").trigger(availableNow=True).start(f"{out}/cards"))
    log.info("read %s new documents of %s, wrote as many cards to %s/cards", read, tables, out)
    new = spark.readStream.schema(CARDS).option("maxFilesPerTrigger", int(c["files_per_batch"])).parquet(f"{out}/cards")
    counts = counts_of(new).writeStream.outputMode("complete").foreachBatch(lambda df, _: overwrite(df, f"{out}/counts", ["lang"]))
    added = _drained(counts.option("checkpointLocation", f"{out}/checkpoint/counts").trigger(availableNow=True).start())
    log.info("read %s new cards, wrote counts to %s/counts", added, out)
    return {"documents": read, "cards": added}


def read_cards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CARDS).parquet(f"{out}/cards")


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(f"{out}/counts")


def cards_with_counts(spark: SparkSession, out: str) -> DataFrame:
    """Every card beside the counts of its group: both tables of the output, whole."""
    return null_safe_join(read_cards(spark, out), read_counts(spark, out), GROUP)


if __name__ == "__main__":
    command_line("Text catalogue: cards of new documents and counts of all", catalogue)
