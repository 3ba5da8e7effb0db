"""Licences named in documents, by the Dice coefficient over word bigrams.

Texts are normalised to words of letters and digits in lower case and compared with templates
of licence notices: with shared bigrams `s` and bigram counts `a` and `b` the coefficient is
2 s / (a + b). A passage whose number of bigrams lies outside [c b / (2 - c), b (2 - c) / c]
cannot reach the coefficient `c`, and neither can one that shares less than c b / (2 - c). So a
text is looked at more closely only for templates of which it shares that many bigrams as a
whole. Of such texts two things are compared: every line and every sentence of a line, and
every window of words of the whole text, over line feeds, that can be the best one of its
start. A window that lies in a matching line or sentence, or holds one of the same licence, is
that notice and not a further one. Of windows that overlap the one with the largest coefficient
is reported of each template, and of these the one that shares most bigrams. Only DataFrame expressions are used.

Time grows with the length of a text, also of one that repeats a notice without end: a start
looks at no more places than can matter to it, and windows are compared with those they hang
together with. What is quadratic is a chain of windows that all overlap their neighbours.

Bigrams are sets: a repeated bigram counts once. Null and empty texts and passages of one
word have no bigrams and match nothing. Repeated documents give repeated rows; of templates
that tie in a passage the first by name wins. Templates are a parameter of a few rows. Other
columns of the documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenantlake.llm.frame import settled

#: Wording of common licence notices (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
     "not use this file except in compliance with the License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 "
     "International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons "
     "Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it "
     "under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, "
     "version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0"),
)

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used "
    "to endorse or promote products derived from this software without specific prior written "
    "permission. ")


def _gnu(what: str, name: str, mark: str, version: str) -> str:
    return (f"This {what} is free software{mark[0]} you can redistribute it and/or modify it "
            f"under the terms of the GNU {name} General Public License as published by the Free "
            f"Software Foundation{mark[1]} either version {version} of the License, or (at your "
            f"option) any later version. This {what} is distributed in the hope that it will be "
            "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{name} General Public License for more details.")


def _gnu_grant(what: str, name: str, version: str) -> str:
    return _gnu(what, name, ":,", version).split(" This ")[0]


#: Whole licence texts and whole file headers (fixed values). The long texts (Apache-2.0, GPL,
#: LGPL-2.1, AGPL, MPL) are found by the header that their own appendix holds.
WHOLE = (
    ("agpl-3.0", _gnu("program", "Affero", ":,", "3")),
    ("agpl-3.0", _gnu_grant("program", "Affero", "3")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
     "not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
     "or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under "
     "the License."),
    ("bsd-2-clause", _BSD_2 + _AS_IS),
    ("bsd-3-clause", _BSD_2 + _BSD_3 + _AS_IS),
    ("gpl-2.0", _gnu("program", "", ";;", "2")),
    ("gpl-2.0", _gnu_grant("program", "", "2")),
    ("gpl-3.0", _gnu("program", "", ":,", "3")),
    ("gpl-3.0", _gnu_grant("program", "", "3")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
     "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-2.1", _gnu("library", "Lesser", ";;", "2.1")),
    ("lgpl-2.1", _gnu_grant("library", "Lesser", "2.1")),
    ("lgpl-3.0", _gnu("program", "Lesser", ":,", "3")),
    ("lgpl-3.0", _gnu_grant("program", "Lesser", "3")),
    ("lgpl-3.0", "This version of the GNU Lesser General Public License incorporates the terms "
     "and conditions of version 3 of the GNU General Public License, supplemented by the "
     "additional permissions listed below."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in "
     "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
     "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
     "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
     "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. "
     "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
     "author or authors of this software dedicate any and all copyright interest in the "
     "software to the public domain. We make this dedication for the benefit of the public at "
     "large and to the detriment of our heirs and successors. We intend this dedication to be "
     "an overt act of relinquishment in perpetuity of all present and future rights to this "
     "software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
     "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
     "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES + WHOLE, "license string, wording string")


def normal_words(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def bigrams(words: Column, places: bool = False) -> Column:
    """Distinct bigrams, or those of every place; the lambda binds `words`, so they are made
    once."""

    def pairs(w: Column) -> Column:
        ahead = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        both = F.zip_with(w, ahead, lambda a, b: F.concat(a, F.lit(" "), b))
        both = F.filter(both, lambda g: g.isNotNull())
        return both if places else F.array_distinct(both)

    return F.element_at(F.transform(F.array(words), pairs), 1)


def passages(text: Column) -> Column:
    """Lines, and the sentences of lines that have several."""
    lines = F.split(text, "\n")
    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+|\n"), lambda s: s != "")
    return F.array_distinct(F.concat(lines, sentences))


def known_templates(wanted: DataFrame) -> DataFrame:
    """license, template (a hash), its grams and their number."""
    return (wanted.select("license", bigrams(normal_words(F.col("wording"))).alias("grams"))
            .filter(F.size("grams") > 0)
            .select("license", F.xxhash64("license", "grams").alias("template"), "grams",
                    F.size("grams").alias("size")))


def candidates(docs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(text_key, template) where the whole text shares as many bigrams as a match needs."""
    # A text of n distinct bigrams has 2 n + 1 characters at least.
    low = known.agg(F.min("size")).first()[0]
    if low is None:
        docs, low = docs.filter("false"), 1
    grams = F.broadcast(known.select("template", "size", F.explode("grams").alias("gram")))
    return (docs.filter(F.length("text") >= 2 * least * low / (2 - least) + 1)
            .select(F.monotonically_increasing_id().alias("row"),
                    F.xxhash64("text").alias("text_key"),
                    bigrams(normal_words(F.col("text"))).alias("all"))
            # Apart from the select before, which numbers the rows before they are many.
            .select("row", "text_key", F.explode("all").alias("gram"))
            .join(grams, "gram")
            .groupBy("row", "text_key", "template", "size").agg(F.count("*").alias("shared"))
            .filter(F.col("shared") >= least * F.col("size") / (2 - least) - 1e-9)
            .select("text_key", "template").distinct())


def license_matches(docs: DataFrame, wanted: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, text_key, license, the line or sentence and its coefficient."""
    known = known_templates(wanted)
    bounds = known.agg(F.min("size").alias("low"), F.max("size").alias("high")).first()
    if bounds.low is None:
        bounds = (1, 0)
    low, high = least * bounds[0] / (2 - least), bounds[1] * (2 - least) / least
    long_enough = F.filter(passages(F.col("text")), lambda p: F.length(p) >= 2 * low + 1)
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.transform(
        long_enough, lambda p: F.struct(
            p.alias("passage"), bigrams(normal_words(p)).alias("grams")))).alias("p"))
    sized = (each.select("doc_id", "text_key", "p.passage", "p.grams",
                         F.size("p.grams").alias("n"))
             .filter(F.col("n").between(low, high)))
    template = F.broadcast(known.select(
        "license", "template", "size", F.explode("grams").alias("gram")))
    shared = (sized.select("doc_id", "text_key", "passage", "n",
                           F.explode("grams").alias("gram"))
              .join(template, "gram")
              .filter((F.col("n") >= least * F.col("size") / (2 - least))
                      & (F.col("n") <= F.col("size") * (2 - least) / least)))
    # A set, because rows of the same document meet here.
    dice = 2 * F.size(F.collect_set("gram")) / (F.first("n") + F.first("size"))
    return (shared.groupBy("doc_id", "text_key", "passage", "license", "template")
            .agg(dice.alias("dice")).filter(F.col("dice") >= least))


def _apart(windows: DataFrame, key: list[str]) -> DataFrame:
    """Those of the windows of a key that overlap none that ranks before them.

    Windows are columns of a struct `w` with `start` and `end`, ranked by the struct. Only
    windows that hang together by overlaps are compared with each other.
    """
    along = Window.partitionBy(*key).orderBy("w.start", "w.end")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("w.end").over(before) >= F.col("w.start"), F.lit(False))
    chained = (windows.withColumn("opens", (~reached).cast("int"))
               .withColumn("chain", F.sum("opens").over(along)))
    ranked = chained.groupBy(*key, "chain").agg(
        F.array_sort(F.collect_list("w")).alias("all"))
    none = F.array().cast(ranked.schema["all"].dataType)
    kept = F.aggregate("all", none, lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])), acc)
        .otherwise(F.concat(acc, F.array(x))))
    return ranked.select(*key, F.explode(kept).alias("w"))


def _stretches(places: Column, reach: Column, kind: str) -> Column:
    """`places` in steps of `reach`, each with what windows that start in it can gain later.

    After a step that is the first place of every bigram from there on, and of these the first
    `reach`: a window with more distinct bigrams than that matches nothing. So a start looks
    at no more than twice `reach` places, however often the text repeats itself.
    """

    def add(acc: Column, at: Column) -> Column:
        own, first = F.slice(places, at, reach), F.get(places, at - 1)["pos"]
        # Made twice, since a lambda that binds it would copy all that was gathered.
        near = F.concat(own, acc["later"])
        later = F.filter(near, lambda x: x["prev"].isNull() | (x["prev"] < first))
        return F.struct(
            F.slice(later, F.lit(1), reach).alias("later"),
            F.concat(acc["all"], F.array(F.struct(
                near.alias("near"), F.size(own).alias("own")))).alias("all"))

    zero = F.struct(F.array().cast(kind).alias("later"),
                    F.array().cast(f"array<struct<near: {kind}, own: int>>").alias("all"))
    return F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(places), reach)), zero, add,
                       lambda acc: acc["all"])


def _best_windows(places: Column, size: Column, least: float, kind: str) -> Column:
    """The best window of every start: shared, dice, start, end and its words.

    Another shared bigram on the left never lowers the coefficient, so windows start where a
    run of shared bigrams does. A bigram counts at its first place in the window, which is
    where the place before (`prev`) lies ahead of the start.
    """

    def from_start(near: Column, i: Column) -> Column:
        start = F.get(near, i - 1)["pos"]

        def step(acc: Column, x: Column) -> Column:
            new = F.when(x["prev"].isNull() | (x["prev"] < start), 1).otherwise(0)
            both = acc["both"] + F.when(x["hit"], new).otherwise(0)
            n = acc["n"] + new
            dice = 2 * both / (n + size)
            more = x["hit"] & (dice > acc["dice"])
            return F.struct(
                n.alias("n"), both.alias("both"),
                F.when(more, dice).otherwise(acc["dice"]).alias("dice"),
                F.when(more, both).otherwise(acc["shared"]).alias("shared"),
                F.when(more, x["pos"]).otherwise(acc["end"]).alias("end"))

        def done(acc: Column) -> Column:
            return F.struct((-acc["dice"]).alias("worse"), (-acc["shared"]).alias("rank"),
                            start.alias("start"), acc["end"].alias("end"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"),
                        F.lit(0).alias("shared"), start.alias("end"))
        return F.aggregate(F.slice(near, i, F.size(near)), zero, step, done)

    def of_stretch(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), s["own"]),
                          lambda i: F.get(s["near"], i - 1)["opens"])
        return F.filter(F.transform(starts, lambda i: from_start(s["near"], i)),
                        lambda w: -w["worse"] >= least)

    def with_words(w: Column) -> Column:
        inside = F.slice(places, w["start"] - F.get(places, F.lit(0))["pos"] + 1,
                         w["end"] - w["start"] + 1)
        words = F.concat(
            F.array_join(F.transform(
                inside, lambda x: F.substring_index(x["gram"], " ", 1)), " "),
            F.lit(" "), F.substring_index(F.get(places, w["end"] - F.get(
                places, F.lit(0))["pos"])["gram"], " ", -1))
        return F.struct(w["worse"].alias("worse"), w["rank"].alias("rank"),
                        w["start"].alias("start"), w["end"].alias("end"), words.alias("words"))

    reach = (F.floor((2 / least - 1) * size + 1e-9) + 1).cast("int")
    return F.transform(F.flatten(F.transform(_stretches(places, reach, kind), of_stretch)),
                       with_words)


def window_matches(docs: DataFrame, wanted: DataFrame, pairs: DataFrame,
                   least: float = 0.8) -> DataFrame:
    """doc_id, text_key and windows `w` of the text that match and don't overlap.

    `pairs` are the candidates. Two shared bigrams with more than (2 / c - 2) b other ones
    between them are in no common window, so texts are cut there.
    """
    known = known_templates(wanted)
    names = F.broadcast(known.select("license", "template", "size"))
    grams = F.broadcast(known.select("template", F.explode("grams").alias("gram"),
                                     F.lit(True).alias("shared")))
    key = ["doc_id", "text_key", "template"]
    placed = (docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
              .dropDuplicates(["doc_id", "text_key"])
              .join(pairs, "text_key").join(names, "template")
              .select(*key, "license", "size", F.posexplode(
                  bigrams(normal_words(F.col("text")), places=True)).alias("pos", "gram"))
              .join(grams, ["template", "gram"], "left")
              .withColumn("hit", F.coalesce("shared", F.lit(False))))
    along = Window.partitionBy(*key).orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    hit, prev, last = F.col("hit"), F.col("prev"), F.col("last")
    fresh = ~hit & (prev.isNull() | last.isNull() | (prev < last))
    opens = hit & ~F.coalesce(F.lag("hit").over(along), F.lit(False))
    far = F.col("others") - F.col("others_then") > (2 / least - 2) * F.col("size") + 1e-9
    cut = (placed
           .withColumn("prev", F.lag("pos").over(
               Window.partitionBy(*key, "gram").orderBy("pos")))
           .withColumn("last", F.last(F.when(hit, F.col("pos")), True).over(before))
           .withColumn("opens", opens)
           .withColumn("others", F.sum(fresh.cast("int")).over(along))
           .withColumn("others_then", F.last(F.when(hit, F.col("others")), True).over(before))
           .filter(hit | (last.isNotNull() & ~far))
           .withColumn("piece", F.sum((hit & (last.isNull() | far)).cast("int")).over(along)))
    pieces = (cut.groupBy(*key, "license", "size", "piece").agg(
        F.array_sort(F.collect_list(F.struct("pos", "prev", "hit", "opens", "gram")))
        .alias("places"), F.size(F.collect_set(F.when(hit, F.col("gram")))).alias("n"))
        .filter(F.col("n") >= least * F.col("size") / (2 - least) - 1e-9))
    kind = pieces.schema["places"].dataType.simpleString()
    each = pieces.select(*key, "license", "piece", F.explode(_best_windows(
        F.col("places"), F.col("size"), least, kind)).alias("w"))
    found = _apart(each, [*key, "license", "piece"]).select("doc_id", "text_key", F.struct(
        "w.rank", "w.worse", "license", "w.start", "w.end", "w.words").alias("w"))
    return _apart(found, ["doc_id", "text_key"])


def further_notices(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, text_key, license and dice of windows that no matching line or sentence is."""

    def spaced(words: Column) -> Column:
        return F.concat(F.lit(" "), words, F.lit(" "))

    held = lines.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(
        "license", spaced(F.array_join(normal_words(F.col("passage")), " ")).alias("words")
    )).alias("held")).withColumnsRenamed({"doc_id": "held_id", "text_key": "held_key"})
    known = F.coalesce(held["held"], F.array().cast(held.schema["held"].dataType))
    new = F.filter("windows", lambda w: ~F.exists(known, lambda p: (
        p["words"].contains(spaced(w["words"]))
        | ((p["license"] == w["license"]) & spaced(w["words"]).contains(p["words"])))))
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key"))
    # The same words many times are one notice, and are compared once.
    each = (windows.groupBy("doc_id", "text_key", "w.words", "w.license")
            .agg(F.max(-F.col("w.worse")).alias("dice"))
            .groupBy("doc_id", "text_key")
            .agg(F.collect_list(F.struct("words", "license", "dice")).alias("windows")))
    return (each.join(held, same, "left")
            .select("doc_id", "text_key", F.explode(new).alias("w"))
            .select("doc_id", "text_key", "w.license", "w.dice"))


def licenses(docs: DataFrame, wanted: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_notices and the licences of every document with their best coefficient."""
    pairs = settled(candidates(docs, known_templates(wanted), least), "licenses")
    keys = pairs.select("text_key").distinct()
    near = (docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
            .join(keys, "text_key", "left_semi").select("doc_id", "text"))
    lines = (license_matches(near, wanted, least).groupBy("doc_id", "text_key", "passage")
             .agg(F.min(F.struct((-F.col("dice")).alias("rank"), "license")).alias("b"))
             .select("doc_id", "text_key", "passage", "b.license",
                     (-F.col("b.rank")).alias("dice")))
    windows = window_matches(near, wanted, pairs, least)
    best = (lines.drop("passage").unionByName(further_notices(windows, lines))
            .groupBy("doc_id", "text_key", "license")
            .agg(F.max("dice").alias("dice"), F.count("*").alias("n"))
            .groupBy("doc_id", "text_key").agg(
                F.sum("n").alias("n_notices"),
                F.array_sort(F.collect_list(F.struct("license", "dice"))).alias("licenses")))
    none = F.array().cast(best.schema["licenses"].dataType)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = keyed.join(best, keyed["doc_id"].eqNullSafe(best["doc_id"])
                        & (keyed["text_key"] == best["text_key"]), "left")
    return joined.select(
        keyed["doc_id"], F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", none).alias("licenses"))
