r"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word 2-gram of a text is hashed and joined to the (few, fixed) template positions with the same
hash and the same words. A match at text word i and template word j votes for diagonal i - j. All grams of a
template on one diagonal are an exact occurrence. For longer templates neighbouring diagonals, apart by few
inserted, doubled or missing words, are merged; a span without an exact occurrence counts if the template grams
found cover enough of the template and the span is not much longer than the template.

Words are maximal runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: letters, digits and everything
beyond ASCII.

Defined cases: a null or empty text has no words and no labels. Overlapping and repeated occurrences all
count. Rows that repeat an id and a text get the same result each; ids may be null. Very long texts are read
whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


#: Fixed phrases and labels (base), and the operator's own short statements of well-known licenses.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Templates of fewer words count only where they stand exactly.
FUZZY_WORDS = 5
#: Share of a template's grams that a merged span must hold, the last one (often a version) among them.
COVERAGE = 0.7
#: Diagonals at most this far apart are one span.
GAP = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per template position; as many as the templates have words (a fixed list)."""
    rows = []
    for t, template in enumerate(templates):
        w = template.text.split()
        n = len(w) - GRAM + 1
        if not 1 <= n <= 64:
            raise ValueError(f"a template has 2 to 65 words: {template.text}")
        rows += [(t, template.label, template.base, n, j, w[j], w[j + 1]) for j in range(n)]
    out = spark.createDataFrame(rows, "t int, label string, base boolean, n int, j int, t1 string, t2 string")
    return out.withColumn("hash", F.xxhash64("t1", "t2"))


def gram_hits(df: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    """The text grams that stand in a template: id, version (text hash), t, label, base, n, i, j."""
    w = words_of(F.col(text_col))
    # Only the id, the text's hash and the gram go through the explode; never the text itself.
    texts = df.select(id_col, F.xxhash64(text_col).alias("version"), w.alias("w"))
    grams = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2"), F.xxhash64(a, b).alias("hash")))
    rolled = texts.select(id_col, "version", F.posexplode(grams).alias("i", "g")).select(id_col, "version", "i", "g.w1", "g.w2", "g.hash")
    table = F.broadcast(template_grams(df.sparkSession, templates))
    return rolled.join(table, "hash").where("w1 = t1 and w2 = t2").select(id_col, "version", "t", "label", "base", "n", "i", "j")


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans: id, version, label, base, first and last word, score (share of template grams) and exact."""
    hits = gram_hits(df, id_col, text_col, templates)
    mask = F.bit_or(F.expr("shiftleft(1L, j)"))
    key = [id_col, "version", "t", "label", "base", "n"]
    diagonals = hits.groupBy(*key, (F.col("i") - F.col("j")).alias("diagonal")).agg(mask.alias("mask"), F.min("i").alias("low"), F.max("i").alias("high"))
    held = F.bit_count("mask")
    exact = diagonals.where(held == F.col("n")).select(
        id_col, "version", "label", "base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n")).alias("last_word"), F.lit(1.0).alias("score"), F.lit(True).alias("exact")
    )
    longer = diagonals.where(~F.col("base") & (F.col("n") + 1 >= FUZZY_WORDS))
    along = Window.partitionBy(id_col, "version", "t").orderBy("diagonal")
    new = F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.col("diagonal") - GAP - 1) > GAP
    merged = longer.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(along))
    islands = merged.groupBy(*key, "island").agg(F.bit_or("mask").alias("mask"), F.max(held).alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    covered = held / F.col("n")
    ends = F.expr("getbit(mask, n - 1)") == 1
    near = islands.where((covered >= COVERAGE) & ends & (F.col("most") < F.col("n")) & (F.col("high") - F.col("low") < 2 * F.col("n")))
    fuzzy = near.select(id_col, "version", "label", "base", F.col("low").alias("first_word"), (F.col("high") + 1).alias("last_word"), covered.alias("score"), F.lit(False).alias("exact"))
    return exact.unionByName(fuzzy)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word and last_word of base places, base_labels, labels, score."""
    spans = license_spans(df, id_col, text_col, templates)
    place = F.when(F.col("base"), F.col("first_word"))
    found = spans.groupBy(id_col, "version").agg(
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    texts = df.select(id_col, F.xxhash64(text_col).alias("version"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    left, right = texts.alias("l"), found.alias("r")
    same = F.col(f"l.{id_col}").eqNullSafe(F.col(f"r.{id_col}")) & (F.col("l.version") == F.col("r.version"))
    return left.join(right, same, "left").select(
        f"l.{id_col}",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
