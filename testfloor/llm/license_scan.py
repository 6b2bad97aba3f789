"""License scans: votes of word k-grams on offset diagonals.

All rolling k-grams of a text are joined by hash (and text) to their places in the
templates. A hit at word i of the text and word j of a template votes for the
diagonal i - j. Neighbouring diagonals are merged, so that a span survives
inserted or dropped words, and a span is verified by the share of the template's
words that its hits cover. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from testfloor.llm.url_rules import lower_ascii

MAX_K = 3

# Notices as they are commonly written, lower-cased, without punctuation.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("proprietary", "all rights reserved no part of this work may be reproduced"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool  # all words must stand consecutively


def default_templates() -> list[Template]:
    return [Template(a, b, True) for a, b in PHRASES] + [Template(a, b, False) for a, b in NOTICES]


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    parts = F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """Every k-gram of every template with its place; k is 3, or the template's length if shorter.

    A template list is a constant of the caller: some lines of text, not data.
    """
    rows = []
    for t, template in enumerate(templates):
        ws = template.text.split()
        k = min(MAX_K, len(ws))
        rows += [
            (t, template.label, template.exact, len(ws), k, j, " ".join(ws[j : j + k])) for j in range(len(ws) - k + 1)
        ]
    schema = "template int, label string, exact boolean, length int, k int, at int, gram string"
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("gram"))


def _grams(w: Column, ks: list[int]) -> Column:
    """(place, gram) of all k-grams, preceded by one entry with the number of words as its place."""
    size = F.size(w)

    def of(k: int) -> Column:
        gram = lambda i: F.struct(
            i.alias("at"), F.concat_ws(" ", *[w[i + d] for d in range(k)]).alias("gram")
        )
        empty = F.array().cast("array<struct<at:int,gram:string>>")
        return F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), gram)).otherwise(empty)

    head = F.array(F.struct(size.alias("at"), F.lit(None).cast("string").alias("gram")))
    return F.concat(head, *[of(k) for k in ks])


def scan(docs: DataFrame, templates: list[Template] | None = None, max_gap: int = 3, accept: float = 0.6) -> DataFrame:
    """Per document: word count, places of exact templates, and labels of verified spans.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score. ``score`` is the largest share of a template's words covered by one span
    (1 for an exact place), 0 without a hit; a span counts from ``accept`` on. Rows
    of one doc_id are taken together; a NULL text has no words.
    """
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    listed = template_grams(spark, templates)
    ks = sorted({min(MAX_K, len(t.text.split())) for t in templates})
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", words(text).alias("w"))
    entries = split.select("doc_id", F.explode(_grams(F.col("w"), ks)).alias("e")).select(
        "doc_id", F.col("e.at").alias("i"), F.col("e.gram").alias("g"), F.xxhash64("e.gram").alias("h")
    )
    # Entries without a gram carry a document's word count through the join.
    hits = entries.join(F.broadcast(listed), (F.col("h") == F.col("hash")) & (F.col("g") == F.col("gram")), "left")
    hits = hits.filter(F.col("template").isNotNull() | F.col("g").isNull())
    votes = hits.groupBy(
        "doc_id",
        "template",
        "label",
        "exact",
        "length",
        "k",
        F.when(F.col("template").isNotNull(), F.col("i") - F.col("at")).alias("diagonal"),
    ).agg(F.collect_set("at").alias("places"), F.max(F.when(F.col("template").isNull(), F.col("i"))).alias("n_words"))
    # Exact templates have one span per diagonal; others merge diagonals that lie close together.
    order = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.when(F.col("exact") | gap.isNull() | (gap > max_gap), 1).otherwise(0)
    spans = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy("doc_id", "template", "label", "exact", "length", "k", "span").agg(
        F.min("diagonal").alias("start"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.max("n_words").alias("n_words"),
    )
    # A hit at j covers the template's words j to j + k - 1.
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("places", lambda j: F.sequence(j, j + F.col("k") - 1))))
    ) / F.col("length")
    spans = spans.withColumn("share", F.when(F.col("template").isNotNull(), covered))
    place = F.col("exact") & (F.col("share") == 1)
    verified = place | (~F.col("exact") & (F.col("share") >= accept))
    joined = lambda on: F.array_join(F.sort_array(F.collect_set(F.when(on, F.col("label")))), ",")
    return spans.groupBy("doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(verified).alias("labels"),
        F.coalesce(F.max(F.when(place | ~F.col("exact"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
