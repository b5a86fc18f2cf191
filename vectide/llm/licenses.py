"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 3-gram hashes of a text join a small table of template positions (whole templates, compared word by
word at the join, so a hash collision never votes). Hits are counted by (document, template, diagonal), where the
diagonal is the word's place in the text less its place in the template: an unedited copy has all its votes on one
diagonal, and an inserted or removed word moves the rest to a neighbouring one. Neighbouring diagonals merge; the merged
span is verified by the share of the template's 3-grams it holds and by its length in the text.

Template tables hold a few hundred rows whatever the corpus is, so they are broadcast. Nothing else is, and one
row per (document, template, diagonal) is all that shuffles.

Defined results: a null or empty text has no words, so all counts are 0, places null, labels empty; each row is a
document of its own, rows with equal doc_id included; texts of any length are read whole; an empty table gives no
rows; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_row, file_row, save, table

#: Words: runs of ASCII letters, digits and all characters past ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
K = 3
#: Diagonals this near each other are one span; a span counts from this share of a template's 3-grams on.
GAP, COVERAGE = 8, 0.6
#: Well-known openings of public licence texts.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def template_rows(templates: dict[str, str]) -> list[tuple]:
    """(label, place, number of 3-grams, three words) of every template place."""
    out = []
    for label, text in templates.items():
        w = words_of(text)
        if len(w) < K:
            raise ValueError(f"template {label} has fewer than {K} words")
        out += [(label, i, len(w) - K + 1, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), lambda w: w != "")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` with __row, a name of each row; rows that do not come straight from files get a written number."""
    place = file_row(docs)
    if place is not None:
        return docs.select(*columns, place.alias("__row"))
    return save(docs.select(*columns, F.monotonically_increasing_id().cast("string").alias("__row")), "license-rows")


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", key_col: str = "__row", gap: int = GAP, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(spans, base): spans (row, label, first_word, last_word, votes, share); base (row, n_base, first_word, last_word, base labels)."""
    spark = docs.sparkSession
    rows = template_rows(TEMPLATES if templates is None else templates)
    rows += [(f"\0{label}", 0, 1, *phrase.split()) for phrase, label in BASE.items() if len(phrase.split()) == K]
    names = ("label", "at", "grams", "t0", "t1", "t2")
    listed = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    known = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<label: string, at: int, grams: int, t0: string, t1: string, t2: string>>"))).withColumn("h", F.xxhash64("t0", "t1", "t2"))
    w = F.col("w")
    n = F.size("w")
    slid = docs.select(F.col(key_col).alias("row"), _words(F.col(text_col)).alias("w")).select(
        "row", F.posexplode(F.arrays_zip(w.alias("w0"), F.slice(w, F.lit(2), F.greatest(n, F.lit(1))).alias("w1"), F.slice(w, F.lit(3), F.greatest(n, F.lit(1))).alias("w2"))).alias("pos", "z")
    )
    grams = slid.select("row", "pos", F.col("z.w0").alias("w0"), F.col("z.w1").alias("w1"), F.coalesce(F.col("z.w2"), F.lit("")).alias("w2"))
    # one row for each hash, so that a place meets the table once; a two-word phrase is told by the place itself
    entries = F.broadcast(known.groupBy("h").agg(F.collect_list(F.struct("label", "at", "grams", "t0", "t1", "t2")).alias("xs")))
    pair = (F.col("w0") == "cc") & (F.col("w1") == "by")
    same = F.filter(F.coalesce(F.col("xs"), F.array()), lambda x: (x.t0 == F.col("w0")) & (x.t1 == F.col("w1")) & (x.t2 == F.col("w2")))
    found = F.transform(same, lambda x: F.struct(x.label.alias("label"), x["at"].alias("at"), x.grams.alias("grams")))
    phrase = F.when(pair, F.array(F.struct(F.lit("\0cc-by").alias("label"), F.lit(0).alias("at"), F.lit(1).alias("grams")))).otherwise(F.array())
    hits = (
        grams.withColumn("h", F.xxhash64("w0", "w1", "w2"))
        .join(entries, "h", "left")
        .where(F.col("xs").isNotNull() | pair)
        .select("row", "pos", F.explode(F.concat(found, phrase)).alias("x"))
        .select("row", "pos", "x.label", "x.at", "x.grams")
    )
    # rows of one diagonal, counted before they shuffle; a diagonal holds each template place once
    lines = hits.groupBy("row", "label", "grams", (F.when(F.col("label").startswith("\0"), F.lit(0)).otherwise(F.col("pos") - F.col("at"))).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats"), F.count_distinct("pos").alias("places")
    )
    lines = save(lines, "license-diagonals")
    base = lines.where(F.col("label").startswith("\0")).groupBy("row").agg(
        F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.collect_set(F.substring("label", 2, 100)).alias("labels")
    )
    by = Window.partitionBy("row", "label").orderBy("diagonal")
    merged = (
        lines.where(~F.col("label").startswith("\0"))
        .withColumn("starts", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("starts").over(by))
        .groupBy("row", "label", "grams", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first_word"), (F.max("last") + K - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"))
        .withColumn("share", F.col("held").cast("double") / F.col("grams").cast("double"))
        .where((F.col("share") >= coverage) & (F.col("last_word") - F.col("first_word") + 1 <= 2 * (F.col("grams") + K - 1)))
    )
    return merged.select("row", "label", F.col("first_word").cast("long"), F.col("last_word").cast("long"), F.col("votes").cast("long"), "share"), base


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with __n_words, __n_base, __first_word, __last_word, __labels (base labels), __spans (array of structs).

    They take the place of columns of the same names.
    """
    keyed = _keyed(docs, as_row(docs).alias("__doc"), F.col(text_col).alias("__text"))
    spans, base = license_spans(keyed, templates, "__text")
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "first_word", "last_word", "votes", "share"))).alias("spans"))
    found = base.join(per_row, "row", "full")
    found = found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])
    n_words = F.regexp_count(F.coalesce(F.col("__text"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    made = ["__n_words", "__n_base", "__first_word", "__last_word", "__labels", "__spans"]
    old = [F.col("__doc").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return keyed.select("__doc", "__row", n_words.cast("long").alias("__n_words")).join(found, "__row", "left").select(*old, *made)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of phrases, and labels by phrases and by spans of templates, for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = _keyed(docs, F.col("doc_id"), F.col("text"))
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    spans, base = license_spans(keyed)
    per_row = spans.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    found = base.join(per_row, "row", "full").withColumnRenamed("row", "__row")
    none = F.array().cast("array<string>")
    out = keyed.select("doc_id", "__row", n_words.cast("long").alias("n_words")).join(found, "__row", "left")
    labels, more = F.coalesce(F.col("labels"), none), F.coalesce(F.col("more"), none)
    return out.select(
        "doc_id", "n_words", F.coalesce(F.col("n_base"), F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, more)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.when(F.size(labels) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op5_sql() -> str:
    values = ", ".join("('{}', {}, {}, '{}')".format(label, at, n, " ".join(w)) for label, at, n, *w in template_rows(TEMPLATES))
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    return rf"""
WITH templates(label, ofs, grams, gram) AS (VALUES {values}), phrases(phrase, label, n) AS (VALUES {base}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 2], ' ') AS g2, array_to_string(w[pos + 1 : pos + 3], ' ') AS g3 FROM p),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS ls
  FROM g JOIN phrases ON phrase = CASE n WHEN 2 THEN g2 ELSE g3 END GROUP BY doc_id),
dia AS (SELECT doc_id, label, grams, pos - ofs AS dg, min(pos) AS a, max(pos) AS z, list(ofs) AS ats FROM g JOIN templates ON gram = g3 GROUP BY ALL),
st AS (SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY doc_id, label ORDER BY dg) <= {GAP} THEN 0 ELSE 1 END AS s FROM dia),
sp AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, label ORDER BY dg) AS span FROM st),
m AS (SELECT doc_id, label, CAST(len(list_distinct(flatten(list(ats)))) AS DOUBLE) / grams AS share, min(a) AS a, max(z) + 2 AS z, grams FROM sp GROUP BY doc_id, label, grams, span),
k AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS more FROM m WHERE share >= {COVERAGE} AND z - a + 1 <= 2 * (grams + 2) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(more, [])))), ',') AS labels,
  greatest(coalesce(best, 0.0::DOUBLE), CASE WHEN ls IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
