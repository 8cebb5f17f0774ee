"""Operator 2: licence scans (DataFrame functions only).

Units of a text are the whole text, its paragraphs (divided by lines without a letter or digit), its comment blocks (runs of lines that
begin with a comment mark) and its single lines; all but the whole text need a licence word. So a header that is wrapped over several lines above code, and the
title or notice of a licence file, are units of their own. A unit's sparse TF-IDF vector
(terms ``[a-z0-9]+`` of the folded text; idf over the templates, terms outside them at the highest) is compared by
cosine with each template; the best at or above ``LEAST_COSINE`` is the document's own licence. The statement that all rights are reserved
stands in most licences too and counts only where no licence is found. A licence file
(``LICENSE``, ``LICENCE`` or ``COPYING``) with a licence covers its directory and all below, and every document
inherits from its nearest covered ancestor directory. Inheritance is resolved once for each directory, by a join
of ancestor paths, and then joined to the documents, so a directory with very many documents costs no more rows.

Null and empty texts have no licence of their own; a null path has no directory and inherits nothing. Ties go to the
first template by name; of several licence files in a directory the best cosine, then the smallest path, counts. Repeated rows
get a row each, an empty table none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

LEAST_COSINE = 0.8
HINT = r"(?i)licen[cs]e|copyright|rights reserved|spdx"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
#: Between paragraphs: lines without a letter or digit.
PARAGRAPH = r"\n(?:[^A-Za-z0-9\n]*\n)+"
COMMENTS = r"(?:(?:^|\n)[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*)+"
RESERVED = "proprietary"
#: Public licence titles and notices, and the short statements in use for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (RESERVED, "All rights reserved."),
]


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0)), F.lower)


def _weights(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(term, idf) and (template, name, term, normalised weight), both as small as the templates."""
    n = len(templates)
    made = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, name string, text string")
    tf = made.select("template", "name", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "name", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    weighted = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, weighted.join(norm, "template").select("template", "name", "term", (F.col("w") / F.col("norm")).alias("tw"))


def units(text: Column) -> Column:
    """The whole text, and its paragraphs, comment blocks and lines that hold a licence word; each once."""
    parts = F.concat(F.split(text, PARAGRAPH), F.regexp_extract_all(text, F.lit(COMMENTS), F.lit(0)), F.split(text, "\n"))
    return F.array_distinct(F.concat(F.array(text), F.filter(parts, lambda x: x.rlike(HINT))))


def own_licences(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(row, own_license, cosine) for the rows of df (row, text) of which a unit matches a template."""
    spark = df.sparkSession
    idf, weighted = _weights(spark, templates)
    unseen = math.log(1.0 + len(templates)) + 1.0
    parts = df.filter(F.col("text").rlike(HINT)).select("row", F.posexplode(units(F.col("text"))).alias("unit", "part"))
    tf = stored(parts.select("row", "unit", F.explode(terms(F.col("part"))).alias("term")).groupBy("row", "unit", "term").agg(F.count("*").alias("tf")), "tf")
    vector = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = vector.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vector.filter(F.col("idf").isNotNull()).join(F.broadcast(weighted), "term").groupBy("row", "unit", "template", "name").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, ["row", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= least)
    best = scored.groupBy("row").agg(F.min(F.struct((F.col("name") == RESERVED).alias("weak"), (-F.col("cosine")).alias("minus"), "name")).alias("b"))
    return best.select("row", F.col("b.name").alias("own_license"), (-F.col("b.minus")).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, path, own_license, cosine, license, from_dir) per row; license is the own one, else the inherited."""
    hit = F.when(F.col(text_col).rlike(HINT), F.col(text_col))
    # written first: another run could number the rows in another order
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), path.alias("path"), hit.alias("text")), "rows")
    own = own_licences(rows, templates, least)
    labelled = rows.drop("text").join(own, "row", "left").withColumn("dir", parent(F.col("path")))
    holders = (
        labelled.filter(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "path", F.col("own_license").alias("name"))).alias("b"))
        .select(F.col("dir").alias("from_dir"), F.col("b.name").alias("inherited"))
    )
    depth = F.size(F.split("dir", "/"))
    ancestors = (
        labelled.filter(F.col("dir").isNotNull())
        .select("dir")
        .distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(0), depth)))
        .withColumn("from_dir", F.expr("substring_index(dir, '/', k)"))
    )
    nearest = ancestors.join(holders, "from_dir").groupBy("dir").agg(F.max(F.struct("k", "from_dir", "inherited")).alias("b"))
    return labelled.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        "own_license",
        "cosine",
        F.coalesce("own_license", F.col("b.inherited")).alias("license"),
        F.when(F.col("own_license").isNull(), F.col("b.from_dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """A directory tree over documents: source / thousand / hundred / ten; each directory's first id is its licence file."""
    d = F.col("doc_id")
    step = lambda k: F.floor(d / k).cast("string")
    return F.concat(
        F.col("source"),
        F.when(d % 1000 == 0, F.concat(F.lit("/"), step(1000)))
        .when(d % 100 == 0, F.concat(F.lit("/"), step(1000), F.lit("/"), step(100)))
        .otherwise(F.concat(F.lit("/"), step(1000), F.lit("/"), step(100), F.lit("/"), step(10))),
        F.when(d % 10 == 0, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/"), d.cast("string"), F.lit(".txt"))),
    )


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> str:
    quoted = ",\n".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(templates))
    hint = "licen[cs]e|copyright|rights reserved|spdx"
    return f"""
WITH tpl(template, name, text) AS (VALUES {quoted}),
ttf AS (SELECT template, name, lower(w) AS term, count(*) AS tf
        FROM (SELECT template, name, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tpl)) / (1.0 + count(*))) + 1.0 AS idf FROM ttf GROUP BY term),
tw AS (SELECT template, name, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS norm
       FROM ttf JOIN idf USING (term)),
docs AS (SELECT doc_id, text, source ||
           CASE WHEN doc_id % 1000 = 0 THEN '/' || (doc_id // 1000)
                WHEN doc_id % 100 = 0 THEN '/' || (doc_id // 1000) || '/' || (doc_id // 100)
                ELSE '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || (doc_id // 10) END AS dir,
           CASE WHEN doc_id % 10 = 0 THEN '/LICENSE' ELSE '/' || doc_id || '.txt' END AS leaf
         FROM documents),
hits AS (SELECT * FROM docs WHERE regexp_matches(text, '{hint}', 'i')),
parts AS (SELECT DISTINCT doc_id, part FROM (
            SELECT doc_id, unnest(list_concat(string_split_regex(text, '{PARAGRAPH}'),
                   regexp_extract_all(text, '{COMMENTS}'), string_split(text, chr(10)))) AS part FROM hits)
          WHERE regexp_matches(part, '{hint}', 'i') UNION SELECT doc_id, text FROM hits),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS unit, part FROM parts),
tf AS (SELECT doc_id, unit, lower(w) AS term, count(*) AS tf
       FROM (SELECT doc_id, unit, unnest(regexp_extract_all(part, '[A-Za-z0-9]+')) AS w FROM units) GROUP BY ALL),
v AS (SELECT tf.*, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM tpl)) + 1.0) AS w FROM tf LEFT JOIN idf USING (term)),
n AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
s AS (SELECT v.doc_id, v.unit, tw.template, tw.name, round(sum(v.w * tw.w / tw.norm) / any_value(n.norm), 6) AS cosine
      FROM v JOIN tw USING (term) JOIN n ON n.doc_id = v.doc_id AND n.unit = v.unit GROUP BY ALL),
own AS (SELECT doc_id, name AS own_license, cosine FROM s WHERE cosine >= {least}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name = '{RESERVED}', cosine DESC, name) = 1),
lab AS (SELECT docs.doc_id, dir, dir || leaf AS path, own_license, cosine FROM docs LEFT JOIN own USING (doc_id)),
holders AS (SELECT dir AS from_dir, own_license AS inherited FROM lab WHERE own_license IS NOT NULL AND doc_id % 10 = 0
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
near AS (SELECT d.dir, h.from_dir, h.inherited FROM (SELECT DISTINCT dir FROM lab) d
         JOIN holders h ON d.dir = h.from_dir OR starts_with(d.dir, h.from_dir || '/')
         QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.from_dir) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, inherited) AS license,
       CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM lab LEFT JOIN near USING (dir)
"""
