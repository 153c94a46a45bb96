"""Licence scans: Dice coefficient over word bigrams, in Spark expressions only.

Units of a text are the whole, each line, and passages.  A unit is normalised
(lower case, letters and digits of ASCII, single spaces) and becomes its set of
word bigrams.  A coefficient of at least t needs a template whose number of
bigrams is between t / (2 - t) and (2 - t) / t times the unit's, so units
outside the bounds of all templates are never expanded, and other templates are
left out by that bound alone; the rest are counted through shared bigrams.  No
pair without a shared bigram is formed.

A unit that matches holds so large a share of a template's bigrams that it must
hold one of the template's anchors, a few long words and bigrams; texts without
any anchor are left at once.  Passages find notices that are wrapped over lines or stand inside a
longer line: a text is cut into pieces at line feeds and after [.;:], pieces of
which at least half the bigrams belong to one template are hits, and a run of
hits of one template is a unit.

Texts with an anchor are written once.  Bigrams of units meet the template table
in an equi-join, whose form Spark picks by the table's size; shared counts are
combined before the shuffle.  Defined results: null, empty and one-word units
match nothing; repeated rows are matched one by one; of equal coefficients the
first licence id wins; empty tables give none; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strainlens import session
from strainlens.functions.arrays import let

THRESHOLD = 0.8

# fixed values: public notices and short licence texts, with their common identifiers
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, text string")


def normal(text) -> Column:
    """Lower case, ASCII letters and digits, single spaces; line feeds stay."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")


def bigrams(line) -> Column:
    """Distinct word bigrams of a normalised unit without line feeds."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    follow = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.array_distinct(F.slice(F.zip_with(words, follow, lambda a, b: F.concat(a, F.lit(" "), b)), 1, F.greatest(F.size(words) - 1, F.lit(0))))


def _ratio(threshold: float) -> float:
    """Least share of one set's size that the other has at the threshold."""
    return threshold / (2 - threshold)


def anchors(templates: list[str], threshold: float) -> tuple[list[str], list[tuple[str, str]]]:
    """Words and bigrams of which any unit that matches one of the (normalised) templates holds one.

    At the threshold t a unit holds at least t / 2 (1 + t / (2 - t)) of the
    template's bigrams, so it cannot miss a family of more than the rest.  A
    family is made of the bigrams of long words, those that meet most first,
    then of single bigrams.
    """
    least = threshold / 2 * (1 + _ratio(threshold))
    long: set[str] = set()
    pairs: set[tuple[str, str]] = set()
    for words in map(str.split, templates):
        left = set(zip(words, words[1:], strict=False))
        need = (1 - least) * len(left) + 1e-9
        covered = 0
        while left and covered <= need:
            met = {w: sum(w in g for g in left) for g in left for w in g if len(w) >= LONG}
            if met:
                word = max(met, key=lambda w: (w in long, met[w], w))
                long.add(word)
                covered += met[word]
                left = {g for g in left if word not in g}
            else:
                pair = max(left, key=lambda g: (g in pairs, len(g[0]) + len(g[1]), g))
                pairs.add(pair)
                covered += 1
                left.remove(pair)
    return sorted(long), sorted(pairs)


def _holds(text: Column, words: list[str], pairs: list[tuple[str, str]]) -> Column:
    """Whether the text has one of the words, anywhere, or of the bigrams."""
    def check(t: Column) -> Column:
        some = F.lit(False)
        for w in words:
            some = some | F.contains(t, F.lit(w))
        for x, y in pairs:
            some = some | (F.contains(t, F.lit(x)) & F.contains(t, F.lit(y)) & t.rlike(f"(?<![a-z0-9]){x}[^a-z0-9]+{y}(?![a-z0-9])"))
        return some

    # the text is lowered once for all of them
    return let(F.lower(text), check)


# letters of a long word
LONG = 7
# so many anchors are looked for in every text; with more templates all texts are expanded
MAX_ANCHORS = 100


def _best(units: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Best licence of each unit (row_no, unit, line, doc_id, grams and, for passages, template) that reaches the threshold."""
    ratio = _ratio(threshold)
    grams = units.select("doc_id", "row_no", "unit", "line", *[c for c in ("own",) if c in units.columns], F.size("grams").alias("u_size"), F.explode("grams").alias("gram"))
    met = grams.join(known, "gram").where((F.col("t_size") >= F.col("u_size") * ratio) & (F.col("t_size") * ratio <= F.col("u_size")))
    if "own" in units.columns:
        met = met.where("own = template")
    shared = met.groupBy("row_no", "unit", "line", "template", "u_size").agg(
        F.first("doc_id").alias("doc_id"), F.first("licence").alias("licence"), F.first("t_size").alias("t_size"), F.count("*").alias("n_shared"))
    return shared.withColumn("dice", 2.0 * F.col("n_shared") / (F.col("u_size") + F.col("t_size"))).where(F.col("dice") >= threshold)


def matches(docs: DataFrame, templates: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit ("whole", "line" or "passage"), line (0, the line, or the passage's first piece), licence, n_shared, dice of each unit that reaches the threshold."""
    given = default_templates(docs.sparkSession) if templates is None else templates
    flat = given.where("text IS NOT NULL").select("template", "licence", F.translate(normal(F.col("text")), "\n", " ").alias("flat"))
    known = flat.select("template", "licence", bigrams(F.col("flat")).alias("grams"))
    known = known.select("template", "licence", F.size("grams").alias("t_size"), F.explode("grams").alias("gram"))
    # a written table has a known size, by which Spark decides whether to broadcast it
    known = session.cut_lineage(known, "templates")
    least, most = known.agg(F.coalesce(F.min("t_size"), F.lit(0)), F.coalesce(F.max("t_size"), F.lit(0))).first()
    t = F.col(f"`{text}`")
    listed = [r["flat"] for r in flat.select("flat").limit(MAX_ANCHORS + 1).collect()]
    words, pairs = anchors(listed, threshold) if len(listed) <= MAX_ANCHORS else ([], [])
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text")).where(F.col("text").isNotNull())
    if 0 < len(words) + len(pairs) <= MAX_ANCHORS:
        rows = rows.where(_holds(F.col("text"), words, pairs))
    pieces = F.split(normal(F.regexp_replace("text", r"([.;:])[ \t]+", "$1\n")), "\n")
    rows = session.cut_lineage(rows.select("doc_id", F.monotonically_increasing_id().alias("row_no"), normal(F.col("text")).alias("norm"), pieces.alias("pieces")), "anchored")

    # the whole and the lines; a text of one line is its own whole, and a text of too many characters has too many bigrams
    ratio = _ratio(threshold)
    whole = F.translate("norm", "\n", " ")
    lines = F.when(F.instr("norm", "\n") > 0, F.concat(F.array(whole), F.split("norm", "\n"))).otherwise(F.array("norm"))
    units = rows.select("doc_id", "row_no", F.posexplode(lines).alias("line", "words"))
    units = units.select("doc_id", "row_no", F.when(F.col("line") == 0, "whole").otherwise("line").alias("unit"), "line", bigrams(F.col("words")).alias("grams"))
    plain = _best(units.where(F.size("grams").between(least * ratio, most / ratio)), known, threshold)

    # runs of pieces that mostly belong to one template
    piece = rows.select("doc_id", "row_no", F.posexplode("pieces").alias("piece", "words")).select("row_no", "piece", bigrams(F.col("words")).alias("grams"))
    hit = piece.select("row_no", "piece", F.size("grams").alias("u_size"), F.explode("grams").alias("gram")).join(known.select("template", "gram"), "gram")
    hit = hit.groupBy("row_no", "template", "piece", "u_size").agg(F.count("*").alias("n")).where(F.col("n") * 2 >= F.col("u_size"))
    run = F.col("piece") - F.row_number().over(Window.partitionBy("row_no", "template").orderBy("piece"))
    runs = hit.select("row_no", "template", "piece", run.alias("run")).groupBy("row_no", "template", "run").agg(F.min("piece").alias("first"), F.count("*").alias("n"))
    passages = rows.select("doc_id", "row_no", "pieces").join(runs, "row_no")
    passages = passages.select("doc_id", "row_no", F.lit("passage").alias("unit"), (F.col("first") + 1).alias("line"), F.col("template").alias("own"),
                               bigrams(F.array_join(F.slice("pieces", F.col("first") + 1, F.col("n").cast("int")), " ")).alias("grams"))
    scored = plain.unionByName(_best(passages.where(F.size("grams") > 0), known, threshold))
    best = F.min_by(F.struct("doc_id", "licence", "n_shared", "dice"), F.struct(-F.col("dice"), "licence", "template"))
    return scored.groupBy("row_no", "unit", "line").agg(best.alias("b")).select("b.doc_id", "unit", "line", "b.licence", "b.n_shared", "b.dice")
