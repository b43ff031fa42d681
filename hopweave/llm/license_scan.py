"""License scan by diagonal voting, with DataFrame operations only.

All rolling word pairs of the texts are joined on their hash with the positions of the same pairs in templates; words are compared as well, so a vote is exact. For whole licenses the next two words must be the
same too (by a hash of all four), as pairs such as "of the" would vote everywhere; such a vote stands for the four words it covers. Votes are counted for each offset between
the text and the template (a diagonal), neighbouring diagonals are merged so that a few added or dropped words don't matter, and a merged run counts if enough of the
template voted for it within a stretch of the text of about the template's length. Stretches begin at each vote of a run, so a run may be of any length.

Texts are read and split once: a row for each text itself goes through the join beside its pairs, and the votes are written to a shared table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, staged

#: Phrases that must stand word for word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Passages of public licenses and notices, and their labels. Those of a few words must be nearly whole.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}
#: Whole texts of short public licenses, without their copyright lines, and their labels.
LICENSES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
    IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
    THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
    copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
    anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
    source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
#: The share of a template's pairs (of a license's words) that must vote, and by how many places neighbouring diagonals may differ.
COVER = 0.75
DRIFT = 2
#: Words that a vote for a license covers besides its first.
REACH = 3

_SPLIT = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(_SPLIT), F.lit(1))


def _pairs(found: Column) -> Column:
    """(place, hash, four, word, next word) of every two words that follow one another; four is the hash of these and the two behind them."""
    first = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))

    def pair(w, i):
        then = F.get(found, i + 1)
        four = F.xxhash64(w, then, F.get(found, i + 2), F.get(found, i + 3))
        return F.struct(i.alias("place"), F.xxhash64(w, then).alias("hash"), four.alias("four"), w.alias("word"), then.alias("then"))

    return F.transform(first, pair)


def _templates(spark) -> DataFrame:
    """A row for each place of each template where a vote can be; their number is fixed. parts: pairs or, of a license, words; reach: words that a vote covers besides the first part."""
    texts = [(x, y, True, 0) for x, y in PHRASES.items()] + [(x, y, False, 0) for x, y in TEMPLATES.items()] + [(x, y, False, REACH) for y, x in LICENSES.items()]
    table = spark.createDataFrame([(t, *of) for t, of in enumerate(texts)], "template int, text string, label string, base boolean, reach int").withColumn("words", words(F.col("text")))
    parts = F.size("words") - F.when(F.col("reach") == 0, 1).otherwise(0)
    split = table.select("template", "label", "base", "reach", parts.alias("parts"), F.inline(_pairs(F.col("words"))))
    return split.where((F.col("reach") == 0) | (F.col("place") + F.col("reach") < F.col("parts"))).withColumnRenamed("place", "at").withColumnRenamed("four", "all_four")


def _width(parts: Column | int) -> Column | float:
    """How far the votes for a template of so many parts may lie apart."""
    return parts * 1.5 + 4


#: The width for the longest template.
WIDEST = int(_width(max(len(t.split()) for t in (*TEMPLATES, *LICENSES.values()))))


def _most(hits: Column) -> Column:
    """The largest number of different pairs that voted on diagonals at most DRIFT apart from one another in turn."""
    none = F.struct(F.lit(None).cast("int").alias("line"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("most"))

    def step(so_far, hit):
        at = F.when(hit["line"] - so_far["line"] > DRIFT, F.array(hit["at"])).otherwise(F.array_union(so_far["at"], F.array(hit["at"])))
        return F.struct(hit["line"].alias("line"), at.alias("at"), F.greatest(so_far["most"], F.size(at)).alias("most"))

    return F.aggregate(F.array_sort(hits), none, step)["most"]


def votes(docs: DataFrame) -> DataFrame:
    """For each text, template and diagonal (line) the distinct places `at` of the template that voted. A row of null template for each text: line is its number of words, copies its number of rows."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    split = docs.select("doc_id", key.alias("_text"), words(F.col("text")).alias("_words"))
    null = {"hash": "long", "four": "long", "word": "string", "then": "string"}
    whole = F.struct(F.size("_words").alias("place"), *(F.lit(None).cast(t).alias(n) for n, t in null.items()))
    pairs = split.select("doc_id", "_text", F.inline(F.concat(F.array(whole), _pairs(F.col("_words")))))
    t = F.broadcast(_templates(docs.sparkSession))
    same = (pairs["hash"] == t["hash"]) & (pairs["word"] == t["word"]) & (pairs["then"] == t["then"]) & ((t["reach"] == 0) | (pairs["four"] == t["all_four"]))
    met = pairs.join(t, same, "left").where(t["template"].isNotNull() | pairs["hash"].isNull())
    line = (F.col("place") - F.coalesce("at", F.lit(0))).alias("line")
    return met.groupBy("doc_id", "_text", "template", "label", "base", "reach", "parts", line).agg(F.collect_set("at").alias("at"), F.count("*").alias("copies"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs.

    n_base counts all places of the phrases, first_word and last_word are their least and greatest start; labels also has those of the templates and licenses found; score is the best
    share of a phrase's or template's pairs, or of a license's words (0 without any). Null counts as empty: no words, no labels (empty strings). Rows with the same id and text get the same result; a null
    doc_id is carried on; empty tables give no rows. Other columns are not read.
    """
    of = ("doc_id", "_text")
    lines = staged(votes(docs), "license-votes")
    texts, lines = lines.where(F.col("template").isNull()), lines.where(F.col("template").isNotNull())
    covered = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("reach")))))
    lines = lines.withColumn("at", F.when(F.col("reach") == 0, F.col("at")).otherwise(covered)).withColumn("score", F.size("at") / F.col("parts"))
    exact = lines.where(F.col("base") & (F.col("score") == 1)).select(*of, "label", "base", F.col("line").cast("long").alias("start"), "score")
    by = Window.partitionBy(*of, "template").orderBy("line")
    apart = F.coalesce(F.col("line") - F.lag("line").over(by) > DRIFT, F.lit(True)).cast("int")
    near = lines.where(~F.col("base")).withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(by))
    runs = near.groupBy(*of, "template", "label", "parts", "_run").agg(F.collect_list(F.struct("line", "at")).alias("lines"), F.max("score").alias("score"))
    at = F.lit(None).cast("long").alias("start")
    # a diagonal that is whole by itself can't be bettered; otherwise no stretch has more than its run
    whole = runs.where(F.col("score") == 1).select(*of, "label", F.lit(False).alias("base"), at, "score")
    runs = runs.where((F.col("score") < 1) & (F.size(F.array_distinct(F.flatten("lines.at"))) / F.col("parts") >= COVER))
    hits = runs.select(*of, "template", "label", "parts", "_run", F.inline("lines")).withColumn("at", F.explode("at")).withColumn("place", F.col("line") + F.col("at"))
    ahead = Window.partitionBy(*of, "template", "_run").orderBy("place").rangeBetween(0, WIDEST)
    hits = hits.withColumn("_ahead", F.collect_list(F.struct("line", "at", "place")).over(ahead))
    hits = hits.withColumn("_ahead", F.filter("_ahead", lambda h: h["place"] - F.col("place") <= _width(F.col("parts")))).where(F.size("_ahead") / F.col("parts") >= COVER)
    spans = hits.select(*of, "label", F.lit(False).alias("base"), at, (_most(F.col("_ahead")) / F.col("parts")).alias("score")).where(F.col("score") >= COVER)
    start = F.when(F.col("base"), F.col("start"))
    found = exact.unionByName(whole).unionByName(spans).groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_same")).agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    rows = texts.select(*of, F.col("line").cast("long").alias("n_words"), "copies")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same")), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
