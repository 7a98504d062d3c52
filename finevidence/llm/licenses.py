"""License scan by diagonal voting, in DataFrame functions only.

The words of each text give rolling hashes of two words (for base phrases) and of three (for templates), each
of which is joined to the places where it stands in the phrases and templates. A hit votes for the diagonal
(place in the text minus place in the template) once its words are verified to be equal. Base phrases need
every vote on one diagonal. For templates, votes of neighbouring diagonals are merged, and each merged span is
verified by an ordered alignment: its hits make runs of words that are equal, and the chain of runs, rising in
text and template, that holds most words within a bounded stretch of the text. With m words aligned of n in the
template and k in the stretch, m / (n + k - m) must reach ``coverage``; that is also the span's score.

Phrases and templates are constants, so the broadcast side has a fixed size. Each text also sends one row that
stands for itself, so texts without a hit stay in the result. The shuffled rows are hits only.

A null text counts as empty; texts of fewer than two words have no hits. Repeated rows give one row
each. Empty tables give an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finevidence.llm.common import whole_text
from finevidence.llm.line_dedup import CAPITALS, SMALL

# The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Texts, notices and openings of common licenses.
TEMPLATES = [
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "bsd-3-clause",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "zlib",
    ),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl-notice",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
    ("this work is licensed under a creative commons attribution", "creative-commons"),
]
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram of base phrases, and of templates.
BASE_GRAM, GRAM = 2, 3
#: Diagonals at least this far apart, or a fifth of the template, belong to different spans.
NEAR = 2


def template_places(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """One row for each gram of each phrase and template, and one that meets each text's own row."""
    rows = [(None, -1, "", False, 0, 1, "", "", None)]
    for t, (phrase, label) in enumerate([*base, *templates]):
        words, is_base = re.findall(WORDS, phrase.translate(str.maketrans(CAPITALS, SMALL))), t < len(base)
        k = BASE_GRAM if is_base else GRAM
        rows += [(i, t, label, is_base, i, len(words) - (1 if is_base else 0), *words[i : i + k], *[None] * (GRAM - k)) for i in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "nth int, template int, label string, base boolean, place int, needed int, one string, two string, three string")
    return df.withColumn("hash", F.when(F.col("nth").isNull(), F.lit(0)).when(F.col("three").isNull(), F.xxhash64("one", "two")).otherwise(F.xxhash64("one", "two", "three"))).drop("nth")


def best_chain(runs: Column, needed: Column, coverage: float) -> Column:
    """The largest m / (needed + k - m) over chains of ``runs`` (structs ``at, place, n`` by at): m words in order in
    text and template, within a stretch of k words of the text, which is at most needed / coverage."""
    chain = "struct<end:int,place:int,m:int,start:int>"
    most = F.floor(needed / coverage).cast("int")

    def extend(state: Column, run: Column) -> Column:
        end = (run["at"] + run["n"]).cast("int")
        live = F.filter(state["chains"], lambda c: c["start"] + most >= end)  # what is further back can't be one stretch with the run
        before = F.filter(live, lambda c: (c["end"] <= run["at"]) & (c["place"] <= run["place"]))
        best = F.array_max(F.transform(before, lambda c: F.struct(c["m"].alias("m"), c["start"].alias("start"))))
        m, start = F.coalesce(best["m"], F.lit(0)) + run["n"], F.coalesce(best["start"], run["at"])
        new = F.struct(end.alias("end"), (run["place"] + run["n"]).cast("int").alias("place"), m.cast("int").alias("m"), start.cast("int").alias("start"))
        return F.struct(F.concat(live, F.array(new)).cast(f"array<{chain}>").alias("chains"), F.greatest(state["top"], m / (needed + end - start - m)).cast("double").alias("top"))

    first = F.struct(F.array().cast(f"array<{chain}>").alias("chains"), F.lit(0.0).alias("top"))
    return F.aggregate(runs, first, extend, lambda s: s["top"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.
    score: the best span's, 1 for a base phrase."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(whole_text(text_col), CAPITALS, SMALL), F.lit(WORDS), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    from_ = lambda i: F.slice("words", F.lit(i), F.greatest(F.size("words"), F.lit(1)))
    gram = lambda hash_, a, b, c: F.struct(hash_.alias("hash"), a.alias("a"), b.alias("b"), c.alias("c"))
    no_word = F.lit(None).cast("string")
    pairs = F.zip_with("words", from_(2), lambda a, b: gram(F.when(b.isNotNull(), F.xxhash64(a, b)), a, b, no_word))
    triples = F.zip_with(F.arrays_zip(F.col("words").alias("a"), from_(2).alias("b")), from_(3), lambda x, c: gram(F.when(c.isNotNull(), F.xxhash64(x["a"], x["b"], c)), x["a"], x["b"], c))
    # 0: the text's own row; 1 to n: pairs; n + 1 to 2 n: triples (those that would pass the end have a null hash). A gram
    # takes its own words along and not the text's, so the rows of a text grow with its length
    own = F.array(gram(F.lit(0).cast("long"), no_word, no_word, no_word))
    grams = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.concat(own, pairs, triples).alias("grams")).select("doc_id", "row", "n_words", F.posexplode("grams").alias("nth", "gram"))
    at = F.when(F.col("nth") > F.col("n_words"), F.col("nth") - F.col("n_words") - 1).otherwise(F.col("nth") - 1).cast("int")
    same = lambda own, word: F.col(own).eqNullSafe(F.col(word))
    hits = (
        grams.select("doc_id", "row", "n_words", "nth", at.alias("at"), "gram.*").where("hash IS NOT NULL").join(F.broadcast(template_places(spark, base, templates)), "hash")
        .where((F.col("template") < 0) & (F.col("nth") == 0) | (F.col("nth") > 0) & same("a", "one") & same("b", "two") & (F.col("three").isNull() | same("c", "three")))
        .select("doc_id", "row", "n_words", "template", "label", "base", "place", "needed", "at", (F.col("at") - F.col("place")).alias("diagonal"))
        .repartition("row")
    )
    key = ["row", "doc_id", "n_words", "template", "label", "base", "needed"]
    # runs of hits on one diagonal; a base phrase's are whole or nothing
    on_diagonal = Window.partitionBy("row", "template", "diagonal").orderBy("at")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(on_diagonal)).groupBy(*key, "diagonal", "run").agg(F.min("at").alias("at"), F.min("place").alias("place"), F.count("*").alias("n"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    opens = F.when(F.col("base"), 0).when(gap <= F.greatest(F.lit(NEAR), F.floor(F.col("needed") / 5)), 0).otherwise(1)
    spans = runs.withColumn("opens", opens).withColumn("span", F.sum("opens").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "span").agg(
        F.count(F.when(F.col("base") & (F.col("n") == F.col("needed")), 1)).alias("n_base"),
        F.min(F.when(F.col("n") == F.col("needed"), F.col("at"))).alias("first"),
        F.max(F.when(F.col("n") == F.col("needed"), F.col("at"))).alias("last"),
        F.when(~F.first("base") & (F.first("template") >= 0), F.sort_array(F.collect_list(F.struct("at", "place", (F.col("n") + GRAM - 1).alias("n"))))).alias("runs"),
    )
    score = F.when(F.col("template") < 0, 0.0).when(F.col("base"), (F.col("n_base") > 0).cast("double")).otherwise(best_chain(F.col("runs"), F.col("needed"), coverage))
    spans = spans.withColumn("score", score)
    is_base, is_own = F.col("base") & (F.col("n_base") > 0), ~F.col("base") & (F.col("score") >= coverage)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum("n_base").alias("n_base"),
            F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("last"))).cast("long").alias("last_word"),
            joined(is_base).alias("base_labels"),
            joined(is_base | is_own).alias("labels"),
            F.max("score").alias("score"),
        )
        .drop("row")
    )
