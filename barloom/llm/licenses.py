"""Licence scan in DataFrame functions only: sparse TF-IDF cosine to templates, then path inheritance.

A text is cut three ways: at line breaks and sentence ends, at blank lines, and not at all. Of the lines and
sentences those that name a licence are passages (headers), of the blocks and whole texts those that hold a
phrase of a licence's body. Equal passages are one class, and the classes are the corpus of the inverse
document frequencies. A class takes the template with the highest cosine, if that reaches what the template
asks for; a file takes its best passage's. A file is a licence file if its name says so or if licence passages
hold at least half of its words. Files without a licence of their own inherit that of the nearest ancestor
directory that has a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

THRESHOLD = 0.6
#: What an SPDX line needs: all of them share most of their words.
EXACT = 0.95
BROADCAST_MAX = 100_000
CUT = r"\n|[.!?;] "
BLOCK = r"\n[ \t\r#*/;-]*\n"
NAMES = r"(^|/)(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)[^/]*$"
MARKS = "licen[sc]e|copyright|spdx|permission is hereby|public domain|creative commons|cc by"
BODIES = r"redistribution\s+and\s+use\s+in\s+source|permission\s+is\s+hereby\s+granted|permission\s+to\s+use,\s+copy,\s+modify|free\s+and\s+unencumbered\s+software|apache\s+license|general\s+public\s+license|mozilla\s+public\s+license"
TERM = "[a-z0-9]+"
#: How licences are named in headers and at the top of licence files.
_HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: The bodies and notices of licences, as their files and headers hold them.
_TEXTS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Licences that SPDX lines name, beside those above.
_NAMED = "0BSD AGPL-3.0-only AGPL-3.0-or-later BSL-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Zlib"
_SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in _HEADERS} | set(_NAMED.split())))
#: (licence, text, least cosine) of all templates.
TEMPLATES = tuple((n, t, THRESHOLD) for n, t in _HEADERS + _TEXTS) + tuple((n, t, EXACT) for n, t in _SPDX)


def _template_rows() -> str:
    return ", ".join("({}, '{}', '{}', {}D)".format(k, name, text.replace("'", "''"), least) for k, (name, text, least) in enumerate(TEMPLATES))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _vectors(texts: DataFrame, key: str, idf: DataFrame, n: int) -> DataFrame:
    """(key, term, w) with unit length; idf: (term, df), a term that it lacks has none."""
    tf = texts.select(key, F.explode(_terms(F.col("passage"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(broadcast_if(idf, BROADCAST_MAX), "term", "left").select(key, "term", (F.col("tf") * (F.ln(F.lit(1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def match_templates(passages: DataFrame) -> DataFrame:
    """(passage, licence, score) of each distinct passage whose best template, of those it is close enough to, has the highest cosine."""
    spark = passages.sparkSession
    classes = materialize(passages.select("passage").distinct().withColumn("id", F.xxhash64("passage")), "passages")
    n = classes.count()
    idf = classes.select("id", F.explode(F.array_distinct(_terms(F.col("passage")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialize(idf, "idf")
    templates = spark.sql(f"SELECT * FROM VALUES {_template_rows()} AS t(template, licence, passage, least)")
    own = _vectors(classes, "id", idf, n)
    wanted = F.broadcast(_vectors(templates, "template", idf, n).withColumnRenamed("w", "wt"))  # one row for each term of TEMPLATES
    cosine = own.join(wanted, "term").groupBy("id", "template").agg(F.round(F.sum(F.col("w") * F.col("wt")), 6).alias("score"))
    names = F.broadcast(templates.select("template", "licence", "least"))
    best = cosine.join(names, "template").where("score >= least").groupBy("id").agg(F.max(F.struct("score", "licence")).alias("best"))
    return classes.join(best, "id").select("passage", F.col("best.licence").alias("licence"), F.col("best.score").alias("score"))


def _passages(text: Column) -> Column:
    """The distinct passages of a text that name a licence or hold a phrase of one's body."""
    lines = F.filter(F.split(text, CUT), lambda x: F.lower(x).rlike(MARKS))
    blocks = F.filter(F.concat(F.split(text, BLOCK), F.array(text)), lambda x: F.lower(x).rlike(BODIES))
    return F.array_distinct(F.concat(lines, blocks))


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, path, licence, origin, score, n_passages) of every file; origin is header, licence file, inherited or null.

    A null or empty text has no header and may inherit; a null path has its headers' licence only by
    inheritance rules of no directory, so none; repeated paths count as one file and keep their rows; of equal
    scores the licence last in the alphabet holds; an empty table gives no rows.
    """
    own = files.select(F.struct(*keep).alias("keep") if keep else F.lit(None).alias("keep"), F.col(path).alias("path"), F.col(text).alias("text"))
    marked = own.where(F.lower("text").rlike(f"{MARKS}|{BODIES}") & F.col("path").isNotNull())
    found = marked.select("path", F.size(_terms(F.col("text"))).alias("n_terms"), F.explode(_passages(F.col("text"))).alias("passage"))
    found = materialize(found, "headers")
    known = broadcast_if(materialize(match_templates(found), "licences"), BROADCAST_MAX)
    hits = found.join(known, "passage").groupBy("path").agg(
        F.max(F.struct("score", "licence")).alias("best"), F.count("*").alias("n_passages"), F.sum(F.size(_terms(F.col("passage")))).alias("covered"), F.max("n_terms").alias("n_terms")
    )
    hits = materialize(hits.select("path", "best.licence", "best.score", "n_passages", (F.col("path").rlike(NAMES) | (2 * F.col("covered") >= F.col("n_terms"))).alias("whole")), "hits")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    by_folder = hits.where("whole").groupBy(folder.alias("folder")).agg(F.max(F.struct("score", "licence")).alias("held"))
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    folders = own.where("path IS NOT NULL").select(folder.alias("folder")).distinct()
    above = folders.select("folder", F.inline(up))
    held = broadcast_if(materialize(by_folder, "folders"), BROADCAST_MAX).withColumnRenamed("folder", "above")
    nearest = above.join(held, "above").groupBy("folder").agg(F.max_by("held", "depth").alias("held"))
    nearest = broadcast_if(materialize(nearest, "nearest"), BROADCAST_MAX)
    rows = own.select("keep", "path", folder.alias("folder")).join(hits, "path", "left").join(nearest, "folder", "left")
    origin = F.when(F.col("whole"), "licence file").when(F.col("licence").isNotNull(), "header").when(F.col("held").isNotNull(), "inherited")
    return rows.select(
        *[F.col("keep")[c].alias(c) for c in keep], F.col("path").alias(path), F.coalesce("licence", "held.licence").alias("licence"), origin.alias("origin"),
        F.coalesce("score", "held.score").alias("score"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
    )


def oracle(files: str) -> str:
    """DuckDB SQL for scan() over a SELECT of (doc_id, path, text), doc_id kept."""
    values = _template_rows().replace("D)", ")")
    return rf"""
WITH f AS ({files}),
t(template, licence, passage, least) AS (VALUES {values}),
h AS (
  SELECT path, len(regexp_extract_all(lower(text), '{TERM}')) AS n_terms, unnest(list_distinct(list_concat(
    list_filter(string_split_regex(text, '{CUT}'), lambda x: regexp_matches(lower(x), '{MARKS}')),
    list_filter(list_append(string_split_regex(text, '{BLOCK}'), text), lambda x: regexp_matches(lower(x), '{BODIES}'))))) AS passage
  FROM f WHERE path IS NOT NULL AND regexp_matches(lower(text), '{MARKS}|{BODIES}')
), c AS (SELECT DISTINCT passage FROM h),
n AS (SELECT count(*) AS n FROM c),
ct AS (SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM c) GROUP BY ALL),
tt AS (SELECT template, licence, least, term, count(*) AS tf FROM (SELECT template, licence, least, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
cw AS (SELECT passage, term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM ct LEFT JOIN d USING (term), n),
tw AS (SELECT template, licence, least, term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM tt LEFT JOIN d USING (term), n),
cn AS (SELECT passage, sqrt(sum(w * w)) AS norm FROM cw GROUP BY passage),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
s AS (
  SELECT cw.passage, tw.licence, tw.least, round(sum(cw.w / cn.norm * (tw.w / tn.norm)), 6) AS score
  FROM cw JOIN cn USING (passage) JOIN tw USING (term) JOIN tn USING (template) GROUP BY cw.passage, tw.template, tw.licence, tw.least
), k AS (
  SELECT passage, licence, score FROM s WHERE score >= least QUALIFY row_number() OVER (PARTITION BY passage ORDER BY score DESC, licence DESC) = 1
), m AS (
  SELECT path, arg_max(licence, (score, licence)) AS licence, max(score) AS score, count(*) AS n_passages,
         regexp_matches(path, '{NAMES}') OR 2 * sum(len(regexp_extract_all(lower(passage), '{TERM}'))) >= max(n_terms) AS whole
  FROM h JOIN k USING (passage) GROUP BY path
), fo AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS above, arg_max(licence, (score, licence)) AS licence, max(score) AS score FROM m WHERE whole GROUP BY 1
), di AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM f WHERE path IS NOT NULL),
up AS (SELECT folder, depth, array_to_string(list_slice(string_split(folder, '/'), 1, depth), '/') AS above FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS depth FROM di)),
ne AS (SELECT folder, arg_max(licence, depth) AS licence, arg_max(score, depth) AS score FROM up JOIN fo USING (above) GROUP BY folder)
SELECT f.doc_id, f.path, coalesce(m.licence, ne.licence) AS licence,
       CASE WHEN m.whole THEN 'licence file' WHEN m.licence IS NOT NULL THEN 'header' WHEN ne.licence IS NOT NULL THEN 'inherited' END AS origin,
       coalesce(m.score, ne.score) AS score, coalesce(m.n_passages, 0)::BIGINT AS n_passages
FROM f LEFT JOIN m USING (path) LEFT JOIN ne ON regexp_replace(f.path, '/?[^/]*$', '') = ne.folder
"""
