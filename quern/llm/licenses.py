"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is read as its terms, so comment marks, line ends and wrapping do not matter. Wherever an
anchor of a template occurs, the window of the template's length that would put the anchor in its
place is a unit to compare with that template, and so is the whole text of a licence file (by its
name) with all templates. Units and templates are sparse TF-IDF vectors; a cosine of THRESHOLD or
more gives the unit the template's licence, and the best unit decides for the document. A text
without a unit like its template goes by its SPDX tag.

The anchors of a template are its terms but for COMMON words, weighty ones first, until the rest of
its vector is shorter than THRESHOLD: a window without one would consist of common words. Windows
that share too little of their template's weight to reach THRESHOLD are dropped before they are
counted out.

A document without a licence of its own inherits from the nearest directory above it that holds a
licence file: distinct directories are joined with their ancestors by path, and documents with
their directory. DataFrame operations only; the templates are a fixed small table.

Edge cases: null and empty texts have no licence of their own but may inherit; null paths inherit
nothing; ties between templates go to the first name, between licence files of a directory to
the greater cosine, then the first name; repeated rows are reported each; an empty table gives an
empty result; columns other than doc_id, path and text are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, with_rid

THRESHOLD = 0.6
COVER = 0.5  # a document of which a notice is this share of its terms is the licence file of its directory
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WRAPPED = r"(\w)-[ \t]*\r?\n[ \t]*(?:[#*/;%]+[ \t]*)?(\w)"  # a word that goes on in the next line, behind a comment mark
SPDX = r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.-]+?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"
#: Common words, which are no anchors (fixed values).
COMMON = frozenset("a all an and any are as at be by can do either file following for from has in into is it its kind list may must name names nor not of on or other person program so that the their these they this to under use used was were with work writing written you your".split())

#: Notices and opening paragraphs of public licences (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. The Software is provided as is, without warranty of any kind."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, WRAPPED, "$1-$2")), F.lit(f"({TERM})"))


class Vectors:
    """The templates as unit vectors; a bounded table, as they are fixed and few."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.bags = [re.findall(TERM, text.lower()) for _, text in templates]
        df = Counter(t for b in self.bags for t in set(b))
        self.idf = {t: math.log((1 + len(self.bags)) / (1 + n)) + 1 for t, n in df.items()}
        self.rare = math.log(1 + len(self.bags)) + 1  # of terms that no template has
        self.weights = []
        for bag in self.bags:
            w = {t: n * self.idf[t] for t, n in Counter(bag).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.weights.append({t: x / norm for t, x in w.items()})

    def anchors(self) -> list[tuple[str, int, int]]:
        """(term, template, offset in it)."""
        out = []
        for k, (bag, w) in enumerate(zip(self.bags, self.weights)):
            rest = 1.0
            for t in sorted(w.keys() - COMMON, key=lambda t: (-w[t], t)):
                if rest < THRESHOLD**2 - 1e-9:
                    break
                rest -= w[t] ** 2
                out += [(t, k, i) for i, x in enumerate(bag) if x == t]
        return out

    def table(self, spark) -> DataFrame:
        rows = [(k, self.names[k], t, x, self.idf[t]) for k, w in enumerate(self.weights) for t, x in sorted(w.items())]
        return spark.createDataFrame(rows, "template int, licence string, term string, weight double, idf double")


def windows(texts: DataFrame, v: Vectors) -> DataFrame:
    """texts: _rid, terms. _rid, unit (template, start, length), terms of every window that may be like its template."""
    found = v.anchors()
    known = sorted({t for t, _, _ in found})
    places = F.create_map(*[x for t in known for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(len(v.bags[k])).alias("n")) for own, k, i in found if own == t]))])
    hits = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(known))
    aligned = F.flatten(F.transform(hits, lambda h: F.transform(places[h["t"]], lambda a: F.struct(a["k"].alias("k"), (h["i"] - a["i"]).alias("start"), a["n"].alias("n")))))
    within = lambda a: F.struct(a["k"].alias("k"), F.greatest(a["start"], F.lit(0)).alias("start"), (F.least(a["start"] + a["n"], F.size("terms")) - F.greatest(a["start"], F.lit(0))).alias("n"))
    rows = texts.select("_rid", "terms", F.array_distinct(F.transform(aligned, within)).alias("w"))
    rows = rows.select("_rid", F.explode(F.transform("w", lambda a: F.struct(a["k"].alias("k"), a["start"].alias("start"), a["n"].alias("n"), F.slice("terms", a["start"] + 1, a["n"]).alias("terms")))).alias("w"))
    mass = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x * x).alias("x")) for t, x in w.items()]) for w in v.weights])
    shared = F.aggregate(F.element_at(mass, F.col("w.k") + 1), F.lit(0.0), lambda acc, x: acc + F.when(F.array_contains(F.col("w.terms"), x["t"]), x["x"]).otherwise(0.0))
    kept = rows.where(shared >= THRESHOLD**2 - 1e-9)
    return kept.select("_rid", F.struct("w.k", "w.start", "w.n").alias("unit"), F.col("w.terms").alias("terms")).dropDuplicates(["_rid", "unit"])


def best_licence(units: DataFrame, v: Vectors) -> DataFrame:
    """units: _rid, unit (k, the template to compare with, or -1 for all; start; n), terms. The best (licence, score, n of the unit) of every _rid, with a score of at least THRESHOLD."""
    vectors = v.table(units.sparkSession)
    found = units.select("_rid", "unit", F.explode("terms").alias("term")).groupBy("_rid", "unit", "term").agg(F.count("*").alias("tf"))
    idf = vectors.groupBy("term").agg(F.first("idf").alias("idf"))
    weighed = found.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(v.rare)))
    norms = weighed.groupBy("_rid", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors.select("template", "licence", "term", "weight")), "term").where(F.col("unit.k").isin(-1) | (F.col("unit.k") == F.col("template"))).groupBy("_rid", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["_rid", "unit"]).withColumn("score", F.round(F.least(F.col("dot") / F.col("norm"), F.lit(1.0)), 6)).where(F.col("score") >= THRESHOLD)
    # The least of (-score, licence, -n) is the greatest score, then the first name, then the longest unit.
    best = scored.groupBy("_rid").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", (-F.col("unit.n")).alias("n"))).alias("best"))
    return best.select("_rid", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"), (-F.col("best.n")).alias("unit_terms"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, down to the root (the empty path), each with its depth."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))


def tagged(text: Column, templates=TEMPLATES) -> Column:
    """The licence that an SPDX tag names, if it is one of the templates'."""
    names = F.create_map(*[F.lit(x) for n in sorted({n for n, _ in templates}) for x in (n.lower(), n)])
    return F.try_element_at(names, F.lower(F.regexp_extract(text, SPDX, 1)))


def one_of(words: list[str]) -> str:
    """A pattern for the words that shares their beginnings, so that few branches are tried at each place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    ends = by.pop("", None) is not None
    branches = [re.escape(c) + one_of(rest) for c, rest in sorted(by.items())]
    if not branches:
        return ""
    return branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)}){'?' if ends else ''}"


def scan(files: DataFrame, by_content: bool = False) -> DataFrame:
    """doc_id, path, licence, score, origin (header, file, inherited or none), origin_dir; one row for each row of files.

    by_content: files have no telling names, so one that is a notice in the main (COVER) is a licence file.
    """
    v = Vectors()
    path = F.regexp_replace(F.col("path").cast("string"), "/+", "/")
    rows = with_rid(files.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text")))
    name = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    anchor = f"(?i)(?<![a-z0-9]){one_of(sorted({t for t, _, _ in v.anchors()}))}(?![a-z0-9])"
    some = F.coalesce(F.col("text").rlike(anchor), F.lit(False))
    narrow = cut(rows.select("doc_id", "_rid", "path", name.alias("named"), F.when(some, terms(F.col("text"))).alias("terms"), tagged(F.col("text")).alias("tag")))
    narrow = narrow.withColumn("dir", F.array_join(F.filter(F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/"), lambda p: p != ""), "/"))
    units = windows(narrow.where("terms is not null").select("_rid", "terms"), v)
    whole = narrow.where("named and terms is not null").select("_rid", F.struct(F.lit(-1).alias("k"), F.lit(0).alias("start"), F.size("terms").alias("n")).alias("unit"), "terms")
    own = cut(best_licence(units.unionByName(whole), v))
    tags = narrow.where("tag is not null").join(own.select("_rid"), "_rid", "left_anti").select("_rid", F.col("tag").alias("licence"), F.lit(1.0).alias("score"), F.lit(0).alias("unit_terms"))
    named = narrow.select("doc_id", "_rid", "path", "dir", "named", F.size("terms").alias("n")).join(own.unionAll(tags), "_rid", "left")
    is_file = F.col("unit_terms") >= F.col("n") * COVER if by_content else F.col("named")
    named = named.withColumn("is_file", F.col("licence").isNotNull() & is_file)
    # One licence a directory, from its licence files.
    held = named.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    held = held.select("dir", F.col("best.licence").alias("l"), (-F.col("best.minus")).alias("s"))
    up = narrow.select("dir").where("dir is not null").distinct().select(F.col("dir").alias("below"), F.explode(ancestors(F.col("dir"))).alias("a")).select("below", "a.depth", "a.dir")
    nearest = up.join(held, "dir").groupBy("below").agg(F.max(F.struct("depth", "dir", "l", "s")).alias("near"))
    out = named.join(nearest, F.col("dir") == F.col("below"), "left")
    inherited = F.col("licence").isNull() & F.col("near").isNotNull()
    origin = F.when(F.col("licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(inherited, "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("licence", "near.l").alias("licence"), F.coalesce("score", "near.s").alias("score"), origin.alias("origin"), F.when(inherited, F.col("near.dir")).alias("origin_dir"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: their source and language are the directories, their doc_id the name."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    path = F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), by_content=True)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_V = Vectors()
#: Licence files lie in the directories that hold all files, so the nearest directory is a file's own.
OP7_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_sql_text(n)}, {_sql_text(b)})" for i, (n, b) in enumerate(TEMPLATES))}) t(template, licence, body)),
 tt AS (SELECT template, licence, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM t),
 df AS (SELECT term, ln((1 + {len(TEMPLATES)}) / (1 + count(DISTINCT template))::DOUBLE) + 1 AS idf FROM tt GROUP BY 1),
 tw AS (SELECT template, licence, term, count(*) * any_value(idf) AS w FROM tt JOIN df USING (term) GROUP BY 1, 2, 3),
 tv AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
 an AS (SELECT * FROM (VALUES {", ".join(f"({_sql_text(t)}, {k}, {i}, {len(_V.bags[k])})" for t, k, i in _V.anchors())}) a(term, template, off, len)),
 d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '{WRAPPED}', '\1-\2', 'g')), '{TERM}') AS terms FROM documents),
 p AS (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM d),
 w AS (SELECT DISTINCT doc_id, template, greatest(i - off, 0) AS lo, least(i - off + len, len(terms)) AS hi FROM p JOIN an USING (term) JOIN d USING (doc_id)),
 ut AS (SELECT doc_id, template, lo, hi, unnest(terms[lo + 1 : hi]) AS term FROM w JOIN d USING (doc_id)),
 uw AS (SELECT doc_id, template, lo, hi, term, count(*) * coalesce(any_value(idf), ln(1 + {len(TEMPLATES)}) + 1) AS w FROM ut LEFT JOIN df USING (term) GROUP BY ALL),
 un AS (SELECT doc_id, template, lo, hi, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
 sc AS (SELECT doc_id, licence, hi - lo AS n, round(least(sum(w * weight) / any_value(norm), 1.0), 6) AS score FROM uw JOIN tv USING (term, template) JOIN un USING (doc_id, template, lo, hi) GROUP BY doc_id, lo, hi, template, licence),
 best AS (SELECT doc_id, licence, score, n FROM sc WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence, n DESC) = 1),
 f AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir, licence, score, licence IS NOT NULL AND n >= {COVER} * len(terms) AS is_file FROM documents JOIN d USING (doc_id) LEFT JOIN best USING (doc_id)),
 h AS (SELECT dir, licence AS l, score AS s FROM f WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1)
SELECT doc_id, dir || '/' || doc_id || '.txt' AS path, coalesce(licence, l) AS licence, coalesce(score, s) AS score, CASE WHEN is_file THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN licence IS NULL AND l IS NOT NULL THEN dir END AS origin_dir
FROM f LEFT JOIN h USING (dir)
"""
