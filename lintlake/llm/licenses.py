"""License scans by diagonal voting, in DataFrame expressions only.

Every word k-gram of every text is hashed and joined to the positions that it has in the license templates. A
match votes for the diagonal (text position less template position) of its template. A short phrase is found
where one diagonal has all its votes. For long templates neighbouring diagonals are merged, since a word added
or left out moves the rest of a passage to the next one, and a merged span counts if it covers enough of
the template. Hashes only find candidates: each match compares the words themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.positional_index import words

# Phrases whose every occurrence counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The operative text of public licenses.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}


@dataclass(frozen=True)
class DiagonalRules:
    """k of the k-grams, how far apart diagonals may be to merge, and the share of a template to be covered."""

    k: int = 3
    merge: int = 4
    coverage: float = 0.6


def _templates(spark: SparkSession, rules: DiagonalRules) -> DataFrame:
    """One row for each k-gram of each template: bounded by the length of the template list."""
    rows = []
    for exact, texts in ((True, PHRASES), (False, {t: name for name, t in TEMPLATES.items()})):
        for text, label in texts.items():
            own = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
            grams = len(own) - rules.k + 1
            rows += [(own[i : i + rules.k], text if exact else label, label, exact, i, grams) for i in range(grams)]
    table = spark.createDataFrame(rows, "gram array<string>, template string, label string, exact boolean, at int, grams int")
    return table.withColumn("hash", F.xxhash64(*(F.col("gram")[i] for i in range(rules.k))))


def license_spans(docs: DataFrame, rules: DiagonalRules = DiagonalRules()) -> DataFrame:
    """Merged diagonals: row_key, template, label, first and past (word places), coverage, and of phrases n_base,
    first_base, last_base: how many full diagonals there are and where the first and the last start."""
    templates = _templates(docs.sparkSession, rules)
    listed = docs.select(_row_key().alias("row_key"), words(F.col("text")).alias("words"))
    starts = F.when(F.size("words") >= rules.k, F.sequence(F.lit(0), F.size("words") - rules.k))
    places = listed.select("row_key", "words", F.explode(starts).alias("pos"))
    own = [F.get("words", F.col("pos") + i) for i in range(rules.k)]
    hits = places.withColumn("hash", F.xxhash64(*own)).join(F.broadcast(templates), "hash")
    # Both bounds, not equality, so that the words are only compared where the hashes agree.
    hits = hits.filter((F.array(*own) >= F.col("gram")) & (F.array(*own) <= F.col("gram")))
    hits = hits.select("row_key", "template", "label", "exact", "grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    about = ["row_key", "template", "label", "exact", "grams"]
    votes = hits.groupBy(*about, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    along = Window.partitionBy("row_key", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > rules.merge, F.lit(True)).cast("int")
    banded = votes.withColumn("opens", opens).withColumn("band", F.sum("opens").over(along))
    full = F.col("exact") & (F.size("ats") == F.col("grams"))
    bands = banded.groupBy(*about, "band").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min("low").alias("first"),
        (F.max("high") + rules.k).alias("past"),
        F.count_if(full).alias("n_base"),
        F.min(F.when(full, F.col("low"))).alias("first_base"),
        F.max(F.when(full, F.col("low"))).alias("last_base"),
    )
    bands = bands.withColumn("coverage", F.when(F.col("exact"), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).otherwise(F.size("ats") / F.col("grams")))
    bands = bands.filter(F.col("coverage") >= rules.coverage)
    return bands.select("row_key", "template", "label", "first", "past", "coverage", "n_base", "first_base", "last_base")


def _row_key() -> Column:
    """The same for rows that repeat id and text, which have the same spans."""
    return F.xxhash64("doc_id", "text", F.isnull("doc_id"))


def license_labels(docs: DataFrame, rules: DiagonalRules = DiagonalRules()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of `docs`.

    A null or empty text has no words and no labels; `score` is the best coverage of a template, 1 where a base
    phrase stands and 0 where nothing is found. Repeated rows each get a row; a null doc_id stays null; an
    empty table gives an empty one; further columns are ignored.
    """
    base = F.col("n_base") > 0
    per_row = license_spans(docs, rules).groupBy("row_key").agg(
        F.sum("n_base").alias("n_base"),
        F.min("first_base").cast("bigint").alias("first_word"),
        F.max("last_base").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select("doc_id", _row_key().alias("row_key"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = rows.join(per_row, "row_key", "left").drop("row_key")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
