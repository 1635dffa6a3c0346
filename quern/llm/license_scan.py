"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same grams in license templates (a
broadcast table: its size is that of TEMPLATES). A match votes for a diagonal, text position minus template position.
Votes are summed by (text, template, diagonal), diagonals that lie next to each other (inserted or lost words) merge,
and a merged band is verified: the template's words that its matches cover, by its number of words, is its score.

Defined results: null text is empty and has no words. Rows are told apart by id and text, so repeated rows each get the
same labels. Texts of fewer than k words have no grams. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals at most this far apart are one band.
NEAR = 2
#: Least share of a template's words that a verified band covers.
VERIFIED = 0.75
#: Words, of a text whose A-Z are lower-case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Texts that licenses ask to be placed with a work, and one-line notices; label, text.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced"),
)


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(words: Column, k: int = K) -> Column:
    """Hashes of the rolling k-grams of a words array."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def template_positions(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """template, label, t_words, t_pos, gram of every template k-gram."""
    rows = [(n, label, template_words(text)) for n, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, _w array<string>")
    return table.select("template", "label", F.size("_w").alias("t_words"), F.posexplode(grams(F.col("_w"), k)).alias("t_pos", "gram"))


def license_spans(words: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: doc_id, _key, label, template, start, end (in words), score. words: doc_id, _key, _words."""
    spark = words.sparkSession
    all_grams = words.select("doc_id", "_key", F.posexplode(grams(F.col("_words"), k)).alias("pos", "gram"))
    hits = all_grams.join(F.broadcast(template_positions(spark, templates, k)), "gram")
    votes = hits.groupBy("doc_id", "_key", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.collect_set("t_pos").alias("_hit")
    )
    along = Window.partitionBy("doc_id", "_key", "template").orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int")
    bands = votes.withColumn("band", F.sum(F.coalesce(opens, F.lit(0))).over(along))
    merged = bands.groupBy("doc_id", "_key", "template", "label", "t_words", "band").agg(
        F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("_hit"))).alias("_hit")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("_hit", lambda t: F.sequence(t, t + k - 1)))))
    scored = merged.withColumn("score", covered / F.col("t_words"))
    return scored.filter(F.col("score") >= VERIFIED).select("doc_id", "_key", "label", "template", "start", "end", "score")


def worded(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _key (hash of the text) and _words. Lower-casing also letters beyond A-Z changes no word boundary, and no
    other letter becomes one that phrases or templates hold but k, which no phrase holds."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.xxhash64(whole).alias("_key"), F.regexp_extract_all(F.lower(whole), F.lit(f"({WORD})"), 1).alias("_words"))


def phrase_places(words: Column) -> Column:
    """Places where a phrase's words stand one after another: array of (start, label)."""
    found = [_places_of(words, phrase.split(), label) for phrase, label in PHRASES]
    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(F.array_contains(words, "license"), F.array_sort(F.concat(*found))).otherwise(none)


def _places_of(words: Column, phrase: list[str], label: str) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(F.filter(starts, lambda i: _stands(words, phrase, i)), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _stands(words: Column, phrase: list[str], i: Column) -> Column:
    test = F.get(words, i) == phrase[0]
    for n, word in enumerate(phrase[1:], 1):
        test = test & (F.coalesce(F.get(words, i + n), F.lit("")) == word)
    return test


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = worded(docs, text)
    spans = license_spans(words).groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(
        F.collect_set("label").alias("_labels"), F.max("score").alias("_score")
    )
    base = words.select("doc_id", "_key", F.size("_words").cast("long").alias("n_words"), phrase_places(F.col("_words")).alias("_places"))
    rows = base.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    starts, none = F.transform("_places", lambda p: p["start"].cast("long")), F.array().cast("array<string>")
    own = F.array_distinct(F.transform("_places", lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.coalesce("_labels", none))).alias("labels"),
        F.greatest(F.coalesce("_score", F.lit(0.0)), F.when(F.size("_places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
