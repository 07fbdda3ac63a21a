"""Licence scan: every line and every whole text against licence templates.

Texts are normalised to lower-case words without marks. A unit (a line, or the whole text of several lines)
matches a template if the Dice coefficient of their sets of word bigrams, twice the common bigrams over the
sum of the two numbers of bigrams, reaches a threshold ``t``. That is only possible if the unit has between
``t / (2 - t)`` and ``(2 - t) / t`` times as many bigrams as the template. So the templates are spread over
all sizes which they can match, units look up their own size there, and only those pairs are compared.

A match also shares at least ``m t / (2 - t)`` of the template's ``m`` bigrams. Of any bigrams of the template,
one more in number than it may miss, the unit thus has at least one. Such bigrams (the longest of each
template) form one pattern, and texts without any of them drop out before lines, words and bigrams are made.

Paragraphs wrapped over lines and notices inside longer lines are found by :func:`scan_windows`, which compares
every run of words of an admissible size with the templates, across line ends.

All of it is DataFrame code without a shuffle: the table of sizes depends on the templates alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

# Licence identifiers and the wording that licences are announced or granted with.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
)

THRESHOLD = 0.8
_IN_WORD = r"[\p{L}\p{N}]"
_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words, anything but letters and digits being a break."""
    plain = F.trim(F.regexp_replace(F.lower(text), _BREAK, " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def bigrams_of(words: Column) -> Column:
    """The set of neighbouring pairs, as an array."""
    count = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(count - 1, F.lit(0))), F.slice(words, 2, F.greatest(count - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(count > 1, pairs).otherwise(F.array().cast("array<string>")))


def sizes_of_templates(spark: SparkSession, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """A row for each template and each number of bigrams that can reach the threshold with it."""
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    made = spark.createDataFrame(rows, "template INT, license STRING, template_text STRING")
    made = made.select("template", "license", bigrams_of(words_of(F.col("template_text"))).alias("template_bigrams"))
    n = F.size("template_bigrams")
    low = F.greatest(F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)), F.lit(1)).cast("int")
    high = F.floor(n * F.lit((2 - threshold) / threshold) + F.lit(1e-9)).cast("int")
    return made.where(n > 0).select("*", F.explode(F.sequence(low, high)).alias("n_bigrams"))


def needed_pattern(bigrams: list[list[str]], threshold: float) -> str:
    """A regular expression that finds something in the lower-case form of every unit that matches a template.

    ``bigrams`` has those of each template. One that may miss ``k`` of them contributes its ``k + 1`` longest.
    """
    followers: dict[str, set[str]] = {}
    for pairs in bigrams:
        may_miss = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
        for pair in sorted(pairs, key=lambda pair: (-len(pair), pair))[: may_miss + 1]:
            first, second = pair.split(" ")
            followers.setdefault(first, set()).add(second)
    # Words are letters and digits alone, so nothing in them needs an escape.
    pairs = (rf"{first}{_BREAK}(?:{'|'.join(sorted(seconds))})" for first, seconds in sorted(followers.items()))
    return rf"(?<!{_IN_WORD})(?:{'|'.join(pairs)})"


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each unit and template that match: ``doc_id, line, template, license, dice``.

    ``line`` counts from 1; 0 is the whole text, which is compared too if it has several lines. A null or empty
    text matches nothing. A repeated row gives its matches again. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = sizes_of_templates(spark, templates, threshold)
    made = table.select("template", "template_bigrams").distinct().collect()  # the templates
    if not made:
        return docs.select(F.col(id_col).alias("doc_id")).where(F.lit(False)).selectExpr(
            "doc_id", "CAST(0 AS INT) AS line", "CAST(0 AS INT) AS template", "'' AS license", "0D AS dice"
        )
    needed = needed_pattern([row.template_bigrams for row in made], threshold)
    text = whole_text(text_col)
    possible = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.lower(text).rlike(needed))
    lines = F.transform(F.split("text", "\n", -1), lambda line, k: F.struct((k + 1).alias("line"), line.alias("unit")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))))
    units = possible.select("doc_id", F.explode(F.concat(lines, F.coalesce(whole, F.slice(lines, 1, 0)))).alias("at"))
    units = units.where(F.lower("at.unit").rlike(needed))
    units = units.select("doc_id", "at.line", bigrams_of(words_of(F.col("at.unit"))).alias("bigrams"))
    units = units.withColumn("n_bigrams", F.size("bigrams"))
    pairs = units.join(F.broadcast(table), "n_bigrams")  # as many rows as the templates have sizes
    common = F.size(F.array_intersect("bigrams", "template_bigrams"))
    dice = 2.0 * common / (F.col("n_bigrams") + F.size("template_bigrams"))
    return pairs.select("doc_id", "line", "template", "license", dice.alias("dice")).where(F.col("dice") >= threshold)


def scan_windows(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each place and template that match: ``doc_id, line, last_line, template, license, dice``.

    Units are all runs of words with as many bigrams as can match the template, wherever lines end. The best run
    from each beginning counts, and of those that overlap the better one, then the earlier, then the shorter.
    A run that does not begin and end with a bigram of the template is never better than without its ends, and
    one with fewer such bigrams than a match shares cannot match, so only the other runs are compared.
    """
    spark = docs.sparkSession
    table = sizes_of_templates(spark, templates, threshold).groupBy("template", "license", "template_bigrams")
    table = table.agg(F.max("n_bigrams").alias("longest"))
    made = table.collect()  # the templates
    if not made:
        return docs.select(F.col(id_col).alias("doc_id")).where(F.lit(False)).selectExpr(
            "doc_id", "CAST(0 AS INT) AS line", "CAST(0 AS INT) AS last_line", "CAST(0 AS INT) AS template", "'' AS license", "0D AS dice"
        )
    needed = needed_pattern([row.template_bigrams for row in made], threshold)
    least = [(row.template, row.license, row.template_bigrams, row.longest, math.ceil(len(row.template_bigrams) * threshold / (2 - threshold) - 1e-9)) for row in made]
    table = spark.createDataFrame(least, "template INT, license STRING, template_bigrams ARRAY<STRING>, longest INT, least INT")
    text = whole_text(text_col)
    possible = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.lower(text).rlike(needed))
    lines = F.transform(F.split("text", "\n", -1), lambda line, k: F.transform(words_of(line), lambda word: F.struct((k + 1).alias("line"), word.alias("word"))))
    # Exploded, an array of one is made once a text.
    words = possible.select("doc_id", F.explode(F.array(F.flatten(lines))).alias("words"))
    count = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, count), F.slice("words", 2, count), lambda a, b: F.concat_ws(" ", a["word"], b["word"]))
    words = words.select("doc_id", F.col("words.line").alias("lines"), F.explode(F.array(pairs)).alias("pairs"))
    both = words.join(F.broadcast(table), F.arrays_overlap("pairs", "template_bigrams"))
    hits = F.transform("pairs", lambda pair, k: F.when(F.array_contains("template_bigrams", pair), k))
    both = both.select("*", F.explode(F.array(F.filter(hits, lambda k: k.isNotNull()))).alias("hits")).where(F.size("hits") >= F.col("least"))

    def run(begin: Column, end: Column) -> Column:
        unit = F.array_distinct(F.slice("pairs", begin + 1, end - begin + 1))
        dice = 2.0 * F.size(F.array_intersect(unit, F.col("template_bigrams"))) / (F.size(unit) + F.size("template_bigrams"))
        return F.struct((-dice).alias("order"), begin.alias("begin"), end.alias("end"))

    near = lambda begin, end: end - begin < F.col("longest")
    begins = F.filter(
        F.transform("hits", lambda hit, k: F.struct(hit.alias("begin"), k.alias("k"))),
        lambda at: near(at["begin"], F.get("hits", at["k"] + F.col("least") - 1)),
    )
    both = both.select("*", F.explode(F.array(begins)).alias("begins")).where(F.size("begins") > 0)
    best = F.transform(
        "begins",
        lambda at: F.array_min(
            F.transform(
                F.filter(F.slice("hits", at["k"] + F.col("least"), F.col("longest")), lambda end: near(at["begin"], end)),
                lambda end: run(at["begin"], end),
            )
        ),
    )
    both = both.select("doc_id", "lines", "template", "license", F.explode(F.array(F.sort_array(F.filter(best, lambda r: -r["order"] >= threshold)))).alias("runs"))
    none = F.slice("runs", 1, 0)
    apart = lambda taken, r: ~F.exists(taken, lambda x: (x["begin"] <= r["end"]) & (r["begin"] <= x["end"]))
    taken = F.aggregate("runs", none, lambda taken, r: F.when(apart(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
    found = both.where(F.size("runs") > 0).select("doc_id", "lines", "template", "license", F.explode(taken).alias("run"))
    return found.select(
        "doc_id", F.get("lines", F.col("run.begin")).alias("line"), F.get("lines", F.col("run.end") + 1).alias("last_line"), "template", "license", (-F.col("run.order")).alias("dice")
    )


def scan_all(docs: DataFrame, **options) -> DataFrame:
    """Matches of :func:`scan` (``unit`` is ``line`` or ``text``) and of :func:`scan_windows` (``run``).

    ``unit, doc_id, line, last_line, template, license, dice``; a line that matches shows a run too.
    """
    kind = F.when(F.col("line") > 0, "line").otherwise("text").alias("unit")
    units = scan(docs, **options).select(kind, "doc_id", "line", F.col("line").alias("last_line"), "template", "license", "dice")
    runs = scan_windows(docs, **options).select(F.lit("run").alias("unit"), "doc_id", "line", "last_line", "template", "license", "dice")
    return units.unionByName(runs)
