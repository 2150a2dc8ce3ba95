"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Texts and templates are cut into words, and every ``SHINGLE`` consecutive words
are one shingle.  Windows of ``SPAN`` shingles overlap at every position of
either; a template of fewer shingles is one window of all it has, and documents
have windows of that size too.  Each window has ``BANDS`` bands, each the
MinHashes of its shingles under ``ROWS`` hash functions of its own (xxHash64
under different seeds).  A template is retrieved by every document one of whose
windows agrees with one of its own, of the same size, in a band.

Windows whose shingles have Jaccard similarity j agree with a chance of
1 - (1 - j ** ROWS) ** BANDS: with 2 and 5, for sure where they are equal, with
0.89 where all but one of 4 shingles are (j = 0.6), and neighbouring windows add
to that.  A text holding 0.8 of a template's shingles has lost at most a fifth
of them, and a change of a word loses five in a row, so that runs of ``SPAN``
remain; what can be missed is a text that holds the shingles scattered in runs
of one to three.  ``tests/llm`` measures the recall.

Retrieved pairs of document and template, one each, are then verified exactly:
the share of the template's distinct shingles that the whole document has,
compared word for word, must be ``CONTAINED`` or more.  Only retrieved documents
are read again for that.

Windows are made, hashed and probed in one scan stage; only agreeing bands are
shuffled.  The template side is broadcast while its keys, counted first, are at
most ``BROADCAST_KEYS``, the retrieved pairs while at most ``BROADCAST_PAIRS``;
beyond that the same joins shuffle.

Defined results: null, empty and shorter texts match nothing; templates with
equal texts all match; a template of fewer than ``SHINGLE`` words is refused;
rows that repeat a doc_id and its text give one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.decontaminate import words_of
from isobar.llm.text import table
from isobar.session import materialize

#: Words of a shingle, shingles of a window, bands, hash functions of a band, and the share that must be contained.
SHINGLE, SPAN, BANDS, ROWS, CONTAINED = 5, 4, 5, 2, 0.8
BROADCAST_KEYS, BROADCAST_PAIRS = 2_000_000, 2_000_000

#: Notices and opening clauses of public licences (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Whole texts of short public licences without their copyright lines (fixed values).
WHOLE = {
    "0bsd-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
TEMPLATES |= WHOLE

def _cut(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, words and the shingles' hashes of each text; null where there are none."""
    rows = texts.select(*keep, words_of(F.col("text").cast("string")).alias("words"))
    rows = rows.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    last = F.size("hashes") - SHINGLE
    return rows.select(*keep, "words", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(SHINGLE)]))).alias("shingles"))


def _windows(cut: DataFrame, keep: list[str], sizes: list[int], header: bool) -> DataFrame:
    """(``keep``, at, key) of each window's bands; header: one more row a text, with at = -1 and a null key."""
    n = F.coalesce(F.size("shingles"), F.lit(0))
    first = -1 if header else 0
    at = F.when(n >= min(sizes), F.sequence(F.lit(first), n - min(sizes))).otherwise(F.array(F.lit(-1)) if header else F.array().cast("array<int>"))
    rows = cut.select(*keep, "shingles", F.explode(at).alias("at"))
    rows = rows.select(*keep, "at", *[F.expr(f"get(shingles, at + {i})").alias(f"w{i}") for i in range(max(sizes))])
    # A window of one shingle has one band: more would say the same.
    forms = [(size, band) for size in sizes for band in range(BANDS if size > 1 else 1)]
    number = F.when(F.col("at") >= 0, F.sequence(F.lit(0), F.lit(len(forms) - 1))).otherwise(F.array(F.lit(-1)))
    rows = rows.select(*keep, "at", *[f"w{i}" for i in range(max(sizes))], F.explode(number).alias("form"))
    rows = rows.withColumn("size", F.expr(" ".join(["CASE form", *[f"WHEN {i} THEN {size}" for i, (size, _) in enumerate(forms)], "ELSE 0 END"])))
    rows = rows.withColumn("band", F.expr(" ".join(["CASE form", *[f"WHEN {i} THEN {band}" for i, (_, band) in enumerate(forms)], "ELSE 0 END"])))
    # The band's number takes part in the hash, so that one expression serves all bands.
    least = [F.least(*[F.when(F.col("size") > i, F.xxhash64(f"w{i}", F.col("band") * ROWS + row)) for i in range(max(sizes))], F.lit(None).cast("long")) for row in range(ROWS)]
    last = F.coalesce(*[F.when(F.col("size") == i + 1, F.col(f"w{i}")) for i in range(max(sizes))])
    key = F.when(last.isNotNull(), F.xxhash64(*least, "band", "size"))
    return rows.select(*keep, "at", key.alias("key")).where("at = -1 OR key IS NOT NULL")


def template_sizes(cut: DataFrame) -> DataFrame:
    """``cut`` templates with the size of their windows."""
    return cut.withColumn("span", F.least(F.size("shingles"), F.lit(SPAN)))


def retrieve(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows of each document: a header (template null), and retrieved templates, once each for a document's key.

    Columns doc_id, text_tag, template.
    """
    cut = template_sizes(_cut(templates, ["template"]).where(F.size("words") > 0))
    if not cut.where("span IS NULL").isEmpty():
        raise ValueError(f"a template needs {SHINGLE} words at least")
    sizes = sorted(r.span for r in cut.select("span").distinct().collect())
    parts = [_windows(cut.where(F.col("span") == n).drop("span"), ["template"], [n], header=False).select("template", "key") for n in sizes]
    tagged = _cut(docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_tag"), "text"), ["doc_id", "text_tag"])
    rows = _windows(tagged, ["doc_id", "text_tag"], sizes or [SPAN], header=True)
    if not parts:
        return rows.where("at = -1").select("doc_id", "text_tag", F.lit(None).cast("string").alias("template"))
    keys = parts[0]
    for part in parts[1:]:
        keys = keys.unionByName(part)
    keys = materialize(keys.distinct(), "template-keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # Headers get keys of their own, so that a shuffled join doesn't deal them all to one task.
    rows = rows.withColumn("key", F.coalesce("key", F.xxhash64("doc_id", "text_tag", F.lit("header"))))
    found = rows.join(side, "key", "left").where("at = -1 OR template IS NOT NULL")
    return found.select("doc_id", "text_tag", F.when(F.col("at") >= 0, F.col("template")).alias("template"))


def verify(docs: DataFrame, pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_tag, template, containment, first) of retrieved pairs (doc_id, text_tag, template).

    first: the word at which the first shingle that the template has begins.
    """
    asked = pairs.groupBy("doc_id", "text_tag").agg(F.collect_set("template").alias("asked")).select(F.col("doc_id").alias("_id"), F.col("text_tag").alias("_tag"), "asked")
    asked = materialize(asked, "retrieved")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_PAIRS else asked
    tagged = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_tag"), "text")
    chosen = tagged.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_tag") == F.col("_tag"))).select("doc_id", "text_tag", "text", "asked")
    own = _shingles(chosen, ["doc_id", "text_tag", "asked"])
    of = _shingles(templates, ["template"]).select("template", "shingle", "words").distinct()
    count = of.groupBy("template").agg(F.count(F.lit(1)).alias("of"))
    both = of.join(count, "template").select("template", "of", F.col("shingle").alias("t_shingle"), F.col("words").alias("t_words"))
    both = materialize(both, "template-shingles")
    small = F.broadcast(both) if both.count() <= BROADCAST_KEYS else both
    same = own.join(small, F.col("shingle") == F.col("t_shingle")).where("words = t_words AND array_contains(asked, template)")
    found = same.groupBy("doc_id", "text_tag", "template").agg(F.count_distinct("words").alias("n"), F.max("of").alias("of"), F.min("at").alias("first"))
    return found.select("doc_id", "text_tag", "template", (F.col("n") / F.col("of")).alias("containment"), "first")


def _shingles(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, at, shingle, words): each shingle's hash and its words as a string."""
    cut = _cut(texts, keep)
    n = F.coalesce(F.least(F.size("shingles"), F.size("words")), F.lit(0))
    # No filter on n: it would be pushed below the arrays and make them anew for each of their elements.
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(-1)))
    rows = cut.select(*keep, "words", "shingles", F.explode(at).alias("at")).where("at >= 0")
    return rows.select(*keep, "at", F.expr("get(shingles, at)").alias("shingle"), F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(SHINGLE))).alias("words"))


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_tag, licenses.

    licenses: sorted array of (template, containment, first), first being the
    word at which the first matching shingle begins.
    """
    by = ["doc_id", "text_tag"]
    found = retrieve(docs, templates).groupBy(*by, "template").agg(F.count(F.lit(1)).alias("n"))
    found = materialize(found, "retrieved-pairs")
    pairs = found.where("template IS NOT NULL")
    kept = verify(docs, pairs, templates).where(F.col("containment") >= contained)
    copies = found.where("template IS NULL").select(*by, F.col("n").cast("int").alias("copies"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("containment"), F.lit(None).cast("int").alias("first"))
    rows = copies.unionByName(kept.select(*by, F.lit(None).cast("int").alias("copies"), "template", "containment", "first"))
    own = F.when(F.col("template").isNotNull(), F.struct("template", "containment", "first"))
    rows = rows.groupBy(*by).agg(F.max("copies").alias("copies"), F.array_sort(F.collect_set(own)).alias("licenses"))
    return rows.select(*by, "licenses", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), default_templates(spark))
    names = F.array_join(F.transform("licenses", lambda x: x["template"]), ",")
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0))
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), F.round(best + 1e-9, 6).alias("best_containment"))


_CUT = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))

SQL = f"""
WITH t(template, text) AS (VALUES {_VALUES}),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT template, {_CUT.format("text")} AS w FROM t))),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM (SELECT doc_id, {_CUT.format("text")} AS w FROM documents))),
m AS (SELECT doc_id, template, count(*) AS n FROM ds JOIN ts USING (s) GROUP BY doc_id, template),
k AS (SELECT doc_id, template, m.n / tn.n AS c FROM m JOIN tn USING (template) WHERE m.n >= 0.8 * tn.n)
SELECT d.doc_id, count(k.template) AS n_licenses, coalesce(string_agg(k.template, ',' ORDER BY k.template), '') AS licenses,
  round(coalesce(max(k.c), 0) + 0.000000001, 6) AS best_containment
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""

QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE = {"op10_license_scan": SQL}
