"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame operations only.

Every line of a file, and every run of up to SPAN lines, is a header candidate, as notices are wrapped; lines without words (blank ones, bare comment marks) do not count. A licence
file is also compared as a whole, with templates of whole texts among others. Candidates that surely stay below `least` are dropped first: those without any of the words that a score of `least` needs, and those whose bound is too
low, the bound being a product over a length that are both sums over lines. Candidates and templates
are sparse vectors over words other than STOP: idf comes from the templates, words that no template has weigh most and only lengthen the vector.
Templates are a small fixed table. A candidate's products with the templates come from a join on the word, so nothing
dense is built. The best template at `least` or more names the file's license (ties: the first name). Versions and clauses are told apart by their own templates.

A file without a license of its own takes that of the nearest ancestor directory with a licensed licence file (of several in one directory the best
match, then the first path): directories are looked up by joins on their path prefixes, then files join their directory. The root, which is above all, is one row that goes to all.

Defined results: a null text is an empty text; a null path has no directory and inherits nothing; repeated rows and ties give
equal rows, one for each input row; rows of one id and path with different texts each have the license of their own text; whole texts of any length are read; an empty table gives an empty table; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Wording of public licenses and their notices.
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", f"{MIT_GRANT}, to deal in the Software without restriction."),
    ("MIT", f"MIT License Copyright (c) {MIT_GRANT} (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", f"{BSD_HEAD}."),
    ("BSD-2-Clause", f"{BSD_HEAD}: {BSD_TWO} {AS_IS}"),
    ("BSD-3-Clause", f"{BSD_HEAD}: {BSD_TWO} {BSD_THIRD} {AS_IS}"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; " + GNU_TERMS.format(kind="General Public License", v="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: " + GNU_TERMS.format(kind="General Public License", v="3")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3, as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; " + GNU_TERMS.format(kind="Lesser General Public License", v="2.1")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: " + GNU_TERMS.format(kind="Lesser General Public License", v="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = "[a-z0-9]+"
#: Lines of one candidate at most.
SPAN = 6
#: Words that do not count: they are in any text.
STOP = "the of and to in a is that for it with as you are this by not be or from at an any can may which all if without on into its other such".split()
#: Further words that are frequent in texts without notices, the most frequent first (mit: also German).
FREQUENT = "mit but so your do even however used out use way under work general public version free source code general person program software name event data 0 2 3 4 1 v no".split()
#: In the SQL a line without any of these is no candidate, and a candidate is one line.
TRIGGER = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|creative commons|warrant"


def words_of(text: str) -> list[str]:
    return [w for w in re.findall(WORD, text.lower()) if w not in STOP]


def template_vectors() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, license, word, weight over the template's length) rows, idf by word, and the idf of a word that no template has."""
    bags = [Counter(words_of(text)) for _, text in TEMPLATES]
    n, df = len(bags), Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in sorted(df.items())}
    rows = []
    for i, b in enumerate(bags):
        length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items()))
        rows += [(i, TEMPLATES[i][0], w, c * idf[w] / length) for w, c in sorted(b.items())]
    return rows, idf, math.log(1 + n) + 1


def needed(weights: list[tuple[int, str, str, float]], least: float) -> list[str]:
    """The templates' words without those that, by themselves, give less than `least` with every template: a candidate at `least` has one of these. Left out are FREQUENT words first, then those of little weight."""
    left, share, most = [], Counter(), Counter()
    for _, _, w, x in weights:
        most[w] = max(most[w], x)
    for word in sorted(most, key=lambda w: (FREQUENT.index(w) if w in FREQUENT else len(FREQUENT), most[w], w)):
        squares = Counter({i: x * x for i, _, w, x in weights if w == word})
        if all(share[i] + x < (least - 1e-3) ** 2 for i, x in squares.items()):
            share.update(squares)
        else:
            left.append(word)
    return left


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}" if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"
    return "SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f" AS t({names})"


def license_scan(files: DataFrame, path: Column, licence_file: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.65) -> DataFrame:
    """Rows (doc_id, path, own_license, own_score, license, inherited_from), one for each input row."""
    spark = files.sparkSession
    weights, idf, unknown = template_vectors()
    vectors = spark.sql(_values(weights, "template, license, word, weight"))
    idfs = spark.sql(_values(list(idf.items()), "word, idf"))
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    trigger = f"(?<![a-z0-9])(?:{'|'.join(needed(weights, least))})(?![a-z0-9])"
    # Each word's part in the bound: at most idf * weight in the product, idf ** 2 in the squared length (a word that comes n times adds n * n of these).
    most = Counter()
    for _, _, w, x in weights:
        most[w] = max(most[w], x * idf[w])
    table = lambda d: F.create_map(*[F.lit(x) for w, v in d.items() for x in (w, v)])
    product, square = table(most), table({w: x * x for w, x in idf.items()})
    summed = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda total, x: total + f(x))
    cut = lambda x: F.filter(F.regexp_extract_all(x, F.lit(f"({WORD})")), lambda w: ~w.isin(STOP))
    line = lambda x: F.struct(x.alias("words"), summed(x, lambda w: F.coalesce(F.element_at(product, w), F.lit(0.0))).alias("p"), summed(x, lambda w: F.coalesce(F.element_at(square, w), F.lit(unknown * unknown))).alias("s"))
    digest = F.xxhash64(text, F.lit("text"))  # tells rows of one id and path apart
    near = files.where(text.rlike(trigger)).select(F.coalesce(path, F.lit("")).alias("path"), F.col(id_col).alias("doc_id"), digest.alias("text_of"), F.when(licence_file, F.array_join(cut(text), " ")).alias("whole"), F.transform(F.filter(F.transform(F.split(text, "\n"), cut), lambda x: F.size(x) > 0), line).alias("lines"))
    n = F.size("lines")
    # A run begins and ends with a template's word: without such a line it would score more.
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.get("lines", i - 1)["p"] > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(SPAN), n - i + 1)), lambda k: F.slice("lines", i, k))).otherwise(F.array())))
    sound = F.filter(runs, lambda r: (F.element_at(r, -1)["p"] > 0) & (summed(r, lambda x: x["p"]) >= (least - 1e-5) * F.sqrt(summed(r, lambda x: x["s"]))))
    # The same bound with each template by itself.
    each = [table({w: x * idf[w] for i, _, w, x in weights if i == t}) for t in range(len(TEMPLATES))]
    weigh = lambda t: lambda w: F.coalesce(F.element_at(t, w), F.lit(0.0))
    joined = F.transform(sound, lambda r: F.struct(F.flatten(F.transform(r, lambda x: x["words"])).alias("words"), ((least - 1e-5) * F.sqrt(summed(r, lambda x: x["s"]))).alias("low")))
    joined = F.filter(joined, lambda r: reduce(or_, (summed(r["words"], weigh(t)) >= r["low"] for t in each)))
    parts = F.transform(joined, lambda r: F.array_join(r["words"], " "))
    parts = F.array_distinct(F.when(F.col("whole").isNotNull(), F.concat(parts, F.array("whole"))).otherwise(parts))
    found = near.where(n > 0).select("path", "doc_id", "text_of", F.explode(parts).alias("part"))
    # From here on a candidate goes by its digest, as its rows multiply.
    found = written(found.withColumn("words", F.split("part", " ")).withColumn("part", F.md5("part")), "candidates")
    # One vector for each distinct candidate, however many files hold it.
    bag = found.groupBy("part").agg(F.first("words").alias("words"))
    words = bag.select("part", F.explode("words").alias("word")).groupBy("part", "word").agg(F.count("*").alias("tf"))
    words = words.join(F.broadcast(idfs), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    length = words.groupBy("part").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    scores = words.join(F.broadcast(vectors), "word").groupBy("part", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = scores.join(length, "part").withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= least)
    best = scores.groupBy("part").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    own = found.drop("words").join(best, "part").groupBy("doc_id", "path", "text_of").agg(F.min("best").alias("best")).select(F.col("doc_id").alias("k"), F.col("path").alias("p"), F.col("text_of").alias("t"), F.col("best.license").alias("own_license"), (-F.col("best.s")).alias("own_score"))
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(licence_file, F.lit(False)).alias("is_file"), digest.alias("text_of"))
    rows = rows.join(own, rows.doc_id.eqNullSafe(own.k) & (F.coalesce(rows.path, F.lit("")) == own.p) & (rows.text_of == own.t), "left").drop("k", "p", "t", "text_of")
    rows = written(rows.withColumn("dir", F.regexp_extract("path", "^(.*)/", 1)), "licensed")
    granted = rows.where("is_file and own_license is not null and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("g")).select(F.col("dir").alias("above"), F.col("g.path").alias("from"), F.col("g.own_license").alias("given"))
    dirs = rows.where("own_license is null and path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.where("dir <> ''").select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("above")).where("above <> ''")
    near = above.join(granted, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "from", "given")).alias("near")).select("dir", "near.from", "near.given")
    # One row, with nulls where the root grants nothing.
    root = granted.where("above = ''").agg(F.first("from").alias("root_from"), F.first("given").alias("root_given"))
    out = rows.where("own_license is null").join(near, "dir", "left").join(F.broadcast(root), F.col("path").isNotNull(), "left")
    out = out.select("doc_id", "path", "own_license", "own_score", F.coalesce("given", "root_given").alias("license"), F.when(F.col("given").isNotNull(), F.col("from")).otherwise(F.col("root_from")).alias("inherited_from"))
    return out.union(rows.where("own_license is not null").select("doc_id", "path", "own_license", "own_score", F.col("own_license").alias("license"), F.lit(None).cast("string")))


def license_sql(path: str, licence_file: str, least: float = 0.65) -> str:
    """The same over documents for DuckDB."""
    weights, idf, unknown = template_vectors()
    sql = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" if isinstance(v, int) else f"{v!r}::DOUBLE" for v in r) + ")" for r in rows)
    return f"""WITH vectors(template, license, word, weight) AS (VALUES {sql(weights)}), idfs(word, idf) AS (VALUES {sql(list(idf.items()))}),
files AS (SELECT doc_id, coalesce(text, '') AS text, {path} AS path, {licence_file} AS is_file FROM documents),
found AS (SELECT doc_id, path, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{TRIGGER}')) || CASE WHEN is_file THEN [text] ELSE [] END)) AS part FROM files WHERE regexp_matches(text, '{TRIGGER}')),
parts AS (SELECT DISTINCT part FROM found),
words AS (SELECT part, word, count(*) AS tf FROM (SELECT part, unnest(regexp_extract_all(lower(part), '{WORD}')) AS word FROM parts) WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY ALL),
weighed AS (SELECT part, word, tf * coalesce(idf, {unknown!r}::DOUBLE) AS x FROM words LEFT JOIN idfs USING (word)),
lengths AS (SELECT part, sqrt(sum(x * x)) AS length FROM weighed GROUP BY part),
scores AS (SELECT part, license, round(sum(x * weight) / any_value(length), 6) AS score FROM weighed JOIN vectors USING (word) JOIN lengths USING (part) GROUP BY part, template, license),
best AS (SELECT part, min({{'s': -score, 'license': license}}) AS best FROM scores WHERE score >= {least} GROUP BY part),
own AS (SELECT doc_id, path, min(best) AS best FROM found JOIN best USING (part) GROUP BY ALL),
rows AS (SELECT f.doc_id, f.path, f.is_file, best.license AS own_license, -best.s AS own_score, regexp_extract(f.path, '^(.*)/', 1) AS dir FROM files f LEFT JOIN own USING (doc_id, path)),
granted AS (SELECT dir AS above, min({{'s': -own_score, 'path': path, 'license': own_license}}) AS g FROM rows WHERE is_file AND own_license IS NOT NULL GROUP BY dir),
near AS (SELECT dir, max({{'n': length(above), 'from': g.path, 'given': g.license}}) AS near FROM
  (SELECT dir, unnest([array_to_string(string_split(dir, '/')[1:k], '/') FOR k IN range(0, len(string_split(dir, '/')) + 1)]) AS above FROM (SELECT DISTINCT dir FROM rows)) JOIN granted USING (above) GROUP BY dir)
SELECT r.doc_id, r.path, own_license, own_score, coalesce(own_license, near.given) AS license, CASE WHEN own_license IS NULL THEN near."from" END AS inherited_from
FROM rows r LEFT JOIN near USING (dir)"""
