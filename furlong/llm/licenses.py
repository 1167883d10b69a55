"""License scans by diagonal voting between documents and license templates, with DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .work import materialize

NOT_WORD = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices by which works name their license, then whole texts and headers.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "all rights reserved"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]
#: Phrases that count wherever their words stand consecutively.
PHRASES = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, template, label, n_grams, place): one row for each k-gram place of the templates, a fixed small table."""
    told = [(i, label, re.findall("[a-z0-9]+", text.lower())) for i, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(told, "template int, label string, w array<string>").coalesce(1).filter(F.size("w") >= k)
    t = t.withColumn("n_grams", F.size("w") - (k - 1))
    t = t.select("template", "label", "n_grams", "w", F.explode(F.expr(f"sequence(0, size(w) - {k})")).alias("place"))
    return t.select(F.xxhash64(*[F.expr(f"w[place + {j}]") for j in range(k)]).alias("gram"), "template", "label", "n_grams", "place", *[F.expr(f"w[place + {j}]").alias(f"t{j}") for j in range(k)])


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least_share: float = 0.6, near: int = 2,
) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A document's rolling 3-gram hashes join the templates' (a fixed table, so it is broadcast); equal words are then
    required. Matches vote for their diagonal (place in the text minus place in the template). Each diagonal with a vote is
    merged with its neighbours, at most ``near`` away on either side, so a merged one spans 2 * near words at most. Its
    span is then verified word by word: in the order of the text, matches that go on in the template are taken, and the
    template's words that they cover are counted. A span is a find if these are at least ``least_share`` of the
    template's words. score is the largest such share over all spans, found or not. A long text is one array of words. A null or empty text has no words and finds nothing. Rows
    that repeat an id and text are one document, and each gets its result; rows that repeat an id with other texts are
    documents of their own. An empty table gives no rows; other columns are ignored."""
    spark, k = docs.sparkSession, 3
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("th"), F.expr(f"array_remove(split(translate(t, '{UPPER}', '{LOWER}'), '{NOT_WORD}'), '')").alias("w"))
    n_words = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))

    grams = rows.select("doc_id", "th", F.expr("slice(w, 2, size(w))").alias("b"), F.expr("slice(w, 3, size(w))").alias("c"), F.col("w").alias("a"))
    grams = grams.select("doc_id", "th", F.posexplode(F.arrays_zip("a", "b", "c")))
    grams = grams.select("doc_id", "th", "pos", F.col("col.a").alias("a"), F.col("col.b").alias("b"), F.col("col.c").alias("c"))
    base = F.lit(None).cast("string")
    for label, p in PHRASES:
        cond = (F.col("a") == p[0]) & (F.col("b") == p[1])
        base = F.when(cond & (F.col("c") == p[2]) if len(p) > 2 else cond, label).otherwise(base)
    grams = grams.withColumn("base", base).withColumn("gram", F.xxhash64("a", "b", "c"))
    table = template_grams(spark, templates or TEMPLATES, k)
    hits = grams.join(F.broadcast(table), (grams.gram == table.gram) & (grams.a == table.t0) & (grams.b == table.t1) & (grams.c == table.t2), "left")
    hits = hits.filter(F.col("base").isNotNull() | F.col("template").isNotNull())
    hits = hits.select("doc_id", "th", F.col("pos").cast("long").alias("pos"), "base", "template", "label", "n_grams", (F.col("pos") - F.col("place")).alias("diag"), "place")
    hits = materialize(hits.distinct())

    key = ["doc_id", "th"]
    found_base = hits.filter("base is not null").select(*key, "pos", "base").distinct().groupBy(*key).agg(
        F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("base").alias("base_set"))
    votes = hits.filter("template is not null").groupBy(*key, "template", "label", "n_grams", "diag").agg(F.collect_set("place").alias("places"))
    w = Window.partitionBy(*key, "template").orderBy("diag").rangeBetween(-near, near)
    merged = votes.withColumn("around", F.collect_list(F.struct("diag", "places")).over(w))
    # (place in the text, place in the template) of all votes of a merged diagonal, in the order of the text
    inner = "flatten(transform(around, d -> transform(d.places, p -> named_struct('pos', d.diag + p, 'place', cast(p as bigint)))))"
    going = (
        f"aggregate(array_sort({inner}), named_struct('last', -1L, 'covered', 0L), (a, x) -> CASE WHEN x.place <= a.last THEN a "
        f"ELSE named_struct('last', x.place, 'covered', a.covered + CASE WHEN a.last < 0 THEN {k}L ELSE least({k}L, x.place - a.last) END) END, a -> a.covered)"
    )
    spans = merged.select(*key, "label", (F.expr(going) / (F.col("n_grams") + (k - 1))).alias("share"))
    found = spans.groupBy(*key).agg(F.max("share").alias("score"), F.collect_set(F.when(F.col("share") >= least_share, F.col("label"))).alias("label_set"))
    both = found_base.unionByName(found, allowMissingColumns=True).groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n_base", "first_word", "last_word", "base_set", "score", "label_set")])
    none = F.array().cast("array<string>")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    base_set, label_set = F.coalesce("base_set", none), F.coalesce("label_set", none)
    out = n_words.join(both, (n_words.th == both.th) & n_words.doc_id.eqNullSafe(both.doc_id), "left")
    return out.select(
        n_words.doc_id, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", join(base_set).alias("base_labels"),
        join(F.array_union(base_set, label_set)).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
