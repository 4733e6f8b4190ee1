"""Licence scan by diagonal voting, in DataFrame functions only.

Every text becomes its words; the hashes of all its rolling K-word grams are joined with those of the licence templates (a
fixed, small table, broadcast), and the words of each hit are compared. A hit at word p of a text and gram t of a template
votes for the diagonal p - t. The votes of a diagonal are the set of the template's grams, so repeated rows can't vote
twice and templates may be whole licences. A diagonal with all votes is an exact copy. Neighbouring diagonals (at most
SLACK words apart) of a template are merged, which bridges inserted, dropped and changed words; a merged span is verified
by the share of the template's grams that it holds and by its length, at most STRETCH times the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.llm.common import LOWER, UPPER

K, SLACK, COVERED, STRETCH = 3, 4, 0.6, 2

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening or telling sentences of public licences, and their labels.
PASSAGES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("licensed under the GNU General Public License", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike", "cc-by-sa"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Whole public licences, without their copyright lines, and their labels.
WHOLE = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS, "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "bsd"),
)
TEMPLATES = PHRASES + PASSAGES + WHOLE

_SPACES = "".join(map(chr, [*range(0x00, 0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: maximal runs of digits, letters and characters beyond ASCII."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + _SPACES, LOWER + " " * len(_SPACES))
    return F.array_remove(F.split(flat, " "), "")


def grams(own: Column) -> Column:
    """Array of structs of K consecutive words."""
    n = F.size(own)
    return F.when(n >= K, F.arrays_zip(*[F.slice(own, d + 1, n - K + 1).alias(f"g{d}") for d in range(K)]))


def _hashed(rows: DataFrame, *keep: str, at: str) -> DataFrame:
    """One row a gram of `own` (words): keep, its place, its words g0.. and their hash."""
    out = rows.select(*keep, F.posexplode(grams(F.col("own"))).alias(at, "g")).select(*keep, at, *[F.col(f"g.g{d}").alias(f"{at}_{d}") for d in range(K)])
    return out.withColumn("hash", F.xxhash64(*[f"{at}_{d}" for d in range(K)]))


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(grams, facts): every K-gram of each template with its words and hash; and n_grams, exact, label of each template."""
    table = spark.createDataFrame([(i, text, label, i < len(PHRASES)) for i, (text, label) in enumerate(texts)], "template int, text string, label string, exact boolean").withColumn("own", words(F.col("text")))
    return _hashed(table, "template", at="gram"), table.select("template", (F.size("own") - K + 1).alias("n_grams"), "exact", "label")


def spans(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, mark, template, label, exact, first, last, coverage): verified licence spans, words counted from 0.

    mark is the text's hash. Exact phrases come place by place, all others as merged spans.
    """
    pieces, facts = templates(docs.sparkSession, texts)
    rolled = _hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), words(F.col("text")).alias("own")), "doc_id", "mark", at="place")
    hits = rolled.join(F.broadcast(pieces), "hash")
    for d in range(K):
        hits = hits.where(F.col(f"place_{d}") == F.col(f"gram_{d}"))
    hits = hits.withColumn("diagonal", F.col("place") - F.col("gram"))
    votes = hits.groupBy("doc_id", "mark", "template", "diagonal").agg(F.collect_set("gram").alias("votes"), F.min("place").alias("first"), (F.max("place") + K - 1).alias("last"))
    along = W.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    cut = F.when((F.col("template") < len(PHRASES)) | apart.isNull() | (apart > SLACK), 1).otherwise(0)
    merged = votes.withColumn("island", F.sum(cut).over(along.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "mark", "template", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    judged = merged.join(F.broadcast(facts), "template").withColumn("coverage", F.col("held") / F.col("n_grams"))
    fits = (F.col("coverage") >= COVERED) & (F.col("last") - F.col("first") < STRETCH * (F.col("n_grams") + K - 1))
    return judged.where(F.when(F.col("exact"), F.col("coverage") == 1).otherwise(fits)).select("doc_id", "mark", "template", "label", "exact", "first", "last", "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of exact phrases, first_word and last_word are their smallest and largest start; score is the
    largest coverage of a verified span, 0 without one. Null texts are empty. Each repeated row has its row; null ids
    are kept; extra columns are ignored; an empty table gives an empty result.
    """

    def joined(label: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(label)))

    per = spans(docs).groupBy("doc_id", "mark").agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"), F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = rows.join(per, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
