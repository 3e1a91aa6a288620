"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of every document is joined to the places where it stands in license templates.  A match
votes for a diagonal, document place minus template place: copies of a template lie on one diagonal, and a word
put in or left out moves the rest of a copy to a neighbouring one.  Votes are summed by diagonal; diagonals are
clustered by nearness alone, and those of a cluster whose words touch are merged, whatever stands between them.
Verification compares words: a vote counts where the k-gram's words themselves are the template's, a merged span must
have COVERED of its template's words, and where spans of several templates lie over the same words, the one with
most of its template's words owns them and the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .native import ascii_words, let

K = 3
#: Diagonals at most so far apart are neighbours; words between spans at most, to merge them.
NEAR_DIAGONALS, GAP_WORDS = 8, 12
#: Longs of the bitmap of template hashes, a power of two: 64 kB.
MAP_WORDS = 1024
#: Least share of a template's words that a span has.
COVERED = 0.8

# The phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices and texts, one label to each.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2.0"),
    ("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0-notice", "licensed under cc by-nc 4.0"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(label, t_words, t_pos, h, t_gram): a few thousand rows at most, as the templates are fixed."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in templates]))
    cut = spark.range(1).select(rows.alias("t")).select("t.label", let(ascii_words(F.col("t.text")), lambda w: F.struct(F.size(w).alias("n"), _grams(w).alias("g"))).alias("x"))
    return cut.select("label", F.col("x.n").alias("t_words"), F.explode("x.g").alias("g")).select("label", "t_words", F.col("g.pos").alias("t_pos"), "g.h", F.col("g.gram").alias("t_gram"))


def _hashes(words: Column) -> Column:
    """(pos, h) of each place of a K-gram."""
    each = F.transform(words, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, *[F.get(words, i + j) for j in range(1, K)]).alias("h")))
    return F.slice(each, 1, F.greatest(F.size(words) - (K - 1), F.lit(0)))


def _grams(words: Column, known: Column | None = None) -> Column:
    """(pos, h, gram) of each place of a K-gram: its hash to join by, its words to compare.

    known: a bitmap of the templates' hashes, as an array of longs.  What it lacks can't join and becomes no row.
    """
    found = _hashes(words)
    if known is not None:
        found = F.filter(found, lambda g: F.call_function("getbit", known[F.shiftrightunsigned(g["h"], 6).bitwiseAND(MAP_WORDS - 1).cast("int")], g["h"].bitwiseAND(63).cast("int")) == 1)
    return F.transform(found, lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), F.array_join(F.slice(words, g["pos"] + 1, K), " ").alias("gram")))


def bitmap(grams: DataFrame) -> list[int]:
    """MAP_WORDS longs with a bit for each h of the templates."""
    out = [0] * MAP_WORDS
    for (h,) in grams.select("h").collect():
        out[(h >> 6) & (MAP_WORDS - 1)] |= 1 << (h & 63)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, mark, label, first_word, end_word, coverage, verified): merged diagonals; mark tells texts of one doc_id apart."""
    places = template_grams(docs.sparkSession, templates)
    known = F.lit(bitmap(places)).cast("array<bigint>")
    # The outer form, as the inner one gets a filter into which the optimizer copies all that is below.
    grams = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode_outer(let(ascii_words(F.col("text")), lambda w: _grams(w, known))).alias("g"))
    found = grams.select("doc_id", "mark", "g.pos", "g.h", "g.gram").join(F.broadcast(places), "h").where("gram = t_gram")
    text = ["doc_id", "mark"]
    votes = found.groupBy(*text, "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set(F.struct("t_pos", "pos")).alias("at")
    )
    # Bounded windows: a row is a diagonal of one label in one text.
    every = Window.unboundedPreceding
    by_diagonal = Window.partitionBy(*text, "label").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR_DIAGONALS
    near = votes.withColumn("far", far).withColumn("cluster", F.sum(F.coalesce("far", F.lit(True)).cast("int")).over(by_diagonal))
    by_place = Window.partitionBy(*text, "label", "cluster").orderBy("first", "diagonal")
    apart = F.col("first") > F.max("last").over(by_place.rowsBetween(every, -1)) + K + GAP_WORDS
    joined = near.withColumn("apart", apart).withColumn("part", F.sum(F.coalesce("apart", F.lit(True)).cast("int")).over(by_place))
    merged = joined.groupBy(*text, "label", "cluster", "part", "t_words").agg(F.min("first").alias("first_word"), (F.max("last") + K).alias("end_word"), F.flatten(F.collect_list("at")).alias("at"))
    words = lambda name: F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x[name], x[name] + K - 1))))
    sized = merged.withColumns({"t_found": F.size(words("t_pos")), "words": words("pos")}).withColumn("coverage", F.col("t_found") / F.col("t_words"))
    sized = materialise(sized.drop("at").withColumn("sid", F.monotonically_increasing_id()))
    # Of verified spans over a word, the one with most of its template's words owns it; a span stays if it owns most of its words.
    best = Window.partitionBy(*text, "word").orderBy(F.desc("t_found"), F.desc("coverage"), "label", "cluster", "part")
    owned = sized.where(F.col("coverage") >= COVERED).withColumn("word", F.explode("words")).withColumn("own", (F.row_number().over(best) == 1).cast("int"))
    kept = owned.groupBy("sid").agg((2 * F.sum("own") > F.count("*")).alias("owns"))
    return sized.join(kept, "sid", "left").select(*text, "label", "first_word", "end_word", "coverage", F.coalesce("owns", F.lit(False)).alias("verified"))


def _phrase_at(w: Column, phrase: str, label: str) -> Column:
    """(start, label) of each place where the phrase's words stand in w."""
    p = phrase.split()
    words = F.array(*map(F.lit, p))
    at = F.transform(w, lambda x, i: F.when((x == p[0]) & (F.slice(w, i + 1, len(p)) == words), i))
    some = F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("label"))), lambda x: F.lit(False))
    return F.when(F.array_contains(w, p[0]) & F.array_contains(w, p[-1]), some).otherwise(none)


def phrase_places(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_words, and places: (start, label) of every phrase of the base labels."""
    found = let(ascii_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*[_phrase_at(w, *x) for x in PHRASES.items()]).alias("places")))
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), found.alias("x")).select("doc_id", "mark", "x.n_words", "x.places")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text).

    Base labels come from exact phrases, further ones from verified template spans.  score: the best coverage of a
    template, 1 where a phrase stands, 0 without either.  Null or empty text: no words, no labels.  Texts shorter
    than a k-gram have no spans.  Rows with one doc_id and different texts have labels of their own, repeated rows the
    same ones; other columns are ignored; an empty table gives an empty result.
    """
    base = phrase_places(docs)
    added = spans(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"), F.max("coverage").alias("best"))
    added = added.withColumnsRenamed({"doc_id": "__span_doc", "mark": "__mark"})
    both = base.join(added, base["doc_id"].eqNullSafe(added["__span_doc"]) & (base["mark"] == added["__mark"]), "left")
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    n = F.size("places").cast("long")
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return both.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        line(own).alias("base_labels"),
        line(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """scan() in DuckDB's SQL."""
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all(" + lower + ", '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    rows = ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in templates)
    base = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) AS start, '{label}' AS label FROM d" for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
tw AS (SELECT label, {words.format("text")} AS w FROM (VALUES {rows}) v(label, text)),
t AS (SELECT label, len(w) AS n, i - 1 AS tp, w[i:i + {K - 1}] AS gram FROM (SELECT label, w, unnest(range(1, len(w) - {K - 2})) AS i FROM tw)),
g AS (SELECT doc_id, i - 1 AS pos, w[i:i + {K - 1}] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d)),
vote AS (SELECT doc_id, label, n, pos, tp, pos - tp AS dg FROM g JOIN t USING (gram)),
dgs AS (SELECT doc_id, label, dg, min(pos) AS lo, max(pos) AS hi FROM vote GROUP BY ALL),
c1 AS (SELECT *, dg - lag(dg) OVER (PARTITION BY doc_id, label ORDER BY dg) AS gap FROM dgs),
c2 AS (SELECT *, count(*) FILTER (coalesce(gap, 1000000) > {NEAR_DIAGONALS}) OVER (PARTITION BY doc_id, label ORDER BY dg) AS cl FROM c1),
c3 AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, label, cl ORDER BY lo, dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c2),
c4 AS (SELECT doc_id, label, dg, cl || '/' || sum(CASE WHEN reach IS NULL OR lo - reach > {K + GAP_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label, cl ORDER BY lo, dg ROWS UNBOUNDED PRECEDING) AS sp FROM c3),
hit AS (SELECT doc_id, label, sp, n, unnest([tp, tp + 1, tp + 2]) AS tp, unnest([pos, pos + 1, pos + 2]) AS pos FROM vote JOIN c4 USING (doc_id, label, dg)),
cov AS (SELECT doc_id, label, sp, count(DISTINCT tp) AS k, count(DISTINCT tp) / any_value(n) AS cover FROM hit GROUP BY ALL),
rival AS (SELECT DISTINCT h.doc_id, h.label, h.sp, h.pos, k, cover FROM hit h JOIN cov USING (doc_id, label, sp) WHERE cover >= {COVERED}),
won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k DESC, cover DESC, label, CAST(split_part(sp, '/', 1) AS INT), CAST(split_part(sp, '/', 2) AS INT)) = 1 AS mine FROM rival),
stay AS (SELECT doc_id, label FROM won GROUP BY doc_id, label, sp HAVING 2 * count(*) FILTER (mine) > count(*)),
more AS (SELECT doc_id, list(DISTINCT label) AS more FROM stay GROUP BY doc_id),
added AS (SELECT doc_id, best, more FROM (SELECT doc_id, max(cover) AS best FROM cov GROUP BY doc_id) LEFT JOIN more USING (doc_id)),
at_ AS ({base}),
b AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, list(DISTINCT label) AS own FROM at_ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE least(coalesce(best, 0.0), 1.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN added USING (doc_id)
"""


SQL = sql()
