"""Licence scan by a positional index of rare licence words, in DataFrame functions only.

The templates are licence texts, headers and short notices; the licence words are those of their
mandatory key phrases. How many files hold each licence word is counted over all files first (a row a
word), which gives its IDF. A template is indexed under its words of highest IDF; a posting says at
which place of which template the word stands. A file takes its own licence words and looks up the
highest of each template that it can hold, that is, all whose index words it has. A hit gives a start of the template
in the file. Postings are intersected by relative position: a start that as many
postings give as the template has index words is a candidate, found as a run of equal starts in sorted
order. A candidate counts if every mandatory key phrase stands there word by word. As index words are
part of the key phrases, no place is missed, whichever words are chosen.

All work on a file is in arrays of its own row: one scan for the counts, one for the places, no shuffle
of files. What is fixed in size (templates, index) is part of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent

# Label, whether it is one of the base phrases, text of the licence or notice, mandatory key phrases (parts of the text, by words).
TEMPLATES = [
    ("mit", True, "mit license", ["mit license"]),
    ("apache", True, "apache license", ["apache license"]),
    ("gpl", True, "general public license", ["general public license"]),
    ("agpl", False, "GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("apache-2.0", False, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""", ["apache license version 2 0"]),
    ("boost-1.0", False, "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", ["boost software license"]),
    ("bsd", False, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ["redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"]),
    ("bsd-3", False, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["may be used to endorse or promote products derived from this software"]),
    ("cc-by-4.0", False, "this work is licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", False, "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", False, "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("creative-commons", False, "This work is licensed under a Creative Commons Attribution License", ["creative commons attribution"]),
    ("epl", False, "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("gpl-2.0", False, "licensed under the GNU General Public License version 2", ["general public license version 2"]),
    ("gpl-3.0", False, "this work is licensed under the GNU General Public License version 3", ["general public license version 3"]),
    ("gpl-header", False, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ["you can redistribute it and or modify it under the terms of the gnu general public license"]),
    ("isc", False, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"]),
    ("lgpl", False, "GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("mit-grant", False, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("mit-release", False, "released under the mit license", ["under the mit license"]),
    ("mpl-2.0", False, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http://mozilla.org/MPL/2.0/.""", ["mozilla public license"]),
    ("unlicense", False, """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["free and unencumbered software released into the public domain"]),
    ("zlib", False, """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions""", ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"]),
]

#: Index words of each template.
RAREST = 2
#: Fixed value: what separates words in lower-cased text, as a Java pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def parsed() -> list[dict]:
    """The templates with word lists, and places of the key phrases in them."""
    out = []
    for label, base, notice, keys in TEMPLATES:
        words = re.findall("[0-9a-z]+", notice.lower())
        out.append({"label": label, "base": base, "words": words, "keys": [(_at(words, k.split()), k.split()) for k in keys]})
    return out


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; null gives none. U+212A alone would become an ASCII letter: it is set aside first."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(plain, BETWEEN), "")


def vocabulary() -> list[str]:
    """The licence words: those of the key phrases."""
    return sorted({w for t in parsed() for _, key in t["keys"] for w in key})


def frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Licence word -> number of files that hold it, 0 for none; the tasks send a row a word."""
    known = vocabulary()
    held = F.explode(F.array_intersect(words_of(F.col(f"`{text}`")), F.array(*[F.lit(w) for w in known])))
    found = {r.word: r["count"] for r in docs.select(held.alias("word")).groupBy("word").count().collect()}
    return {w: found.get(w, 0) for w in known}


def index(held: dict[str, int], rarest: int = RAREST) -> list[list[tuple[int, str]]]:
    """For each template the places and words of its key phrases that the fewest files hold (highest IDF), rarest first."""
    out = []
    for t in parsed():
        keyed = [(off + i, w) for off, key in t["keys"] for i, w in enumerate(key)]
        out.append(sorted(keyed, key=lambda x: (held[x[1]], -len(x[1]), x[0]))[:rarest])
    return out


def scan(docs: DataFrame, text: str = "text", found: str = "licenses", held: dict[str, int] | None = None) -> DataFrame:
    """All columns of docs and a struct ``found``: n_words and places, an array of (label, base, start, share).

    start is where the template's first key phrase starts, in words from 0; share is the part of the
    template's words that stand in place. A null or empty text has no words and no places. Rows are
    scanned whole, each by itself; repeated rows get the same. ``found`` must not be a column of docs
    (ValueError). held are the ``frequencies`` of a corpus; by default those of docs, counted at once.
    """
    absent(docs, found)
    templates, keyed = parsed(), index(frequencies(docs, text) if held is None else held)
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, entries in enumerate(keyed):
        for place, word in entries:
            postings.setdefault(word, []).append((i, place))

    def strings(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def numbers(*values: int) -> Column:
        return F.array(*[F.lit(v) for v in values])

    lookup = F.create_map(*[c for w, of in postings.items() for c in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(p).alias("p")) for i, p in of]))])
    rare = sorted(postings)
    columns = list(docs.columns)

    # explode() of one element keeps the array from being computed again for each use
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.explode(F.array(words_of(F.col(f"`{text}`")))).alias("words"))
    rows = rows.select("row", "words", F.explode(F.array(F.array_intersect("words", strings(rare)))).alias("mine"))
    # the file's own licence words of highest IDF: those of the templates that have all of theirs in it
    heads = F.array(*[strings(sorted({w for _, w in entries})) for entries in keyed])
    whole = F.filter(heads, lambda ws: F.size(F.array_except(ws, "mine")) == 0)
    sought = F.when(F.size("mine") > 0, F.array_distinct(F.flatten(whole))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("row", "words", F.explode(F.array(sought)).alias("sought"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("sought", w), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "words", F.explode(F.array(F.when(F.size("sought") > 0, hits).otherwise(F.array().cast("array<int>")))).alias("hits"))
    word_at = lambda i: F.get(F.col("words"), i)
    starts = F.flatten(F.transform("hits", lambda i: F.transform(F.element_at(lookup, word_at(i)), lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("at")))))
    rows = rows.select("row", "words", F.explode(F.array(F.array_sort(starts))).alias("starts"))
    # a start that all index words of its template give stands so often in a row
    needed = numbers(*[len(entries) for entries in keyed])
    last = lambda s, i: F.get("starts", i + F.get(needed, s["t"]) - 1)
    agreed = F.array_distinct(F.filter("starts", lambda s, i: F.coalesce(last(s, i) == s, F.lit(False))))
    rows = rows.select("row", "words", F.explode(F.array(agreed)).alias("starts"))

    def stands(at: Column, off: int, phrase: list[str]) -> Column:
        return (at + off >= 0) & (F.slice("words", F.greatest(at + off, F.lit(0)) + 1, len(phrase)) == strings(phrase))

    def verified(s: Column) -> Column:
        out = F.lit(False)
        for i, t in enumerate(templates):
            test = F.lit(True)
            for off, k in t["keys"]:
                test = test & F.coalesce(stands(s["at"], off, k), F.lit(False))
            out = F.when(s["t"] == i, test).otherwise(out)
        return out

    labels, bases, firsts = strings([t["label"] for t in templates]), F.array(*[F.lit(t["base"]) for t in templates]), numbers(*[t["keys"][0][0] for t in templates])
    wholes = F.array(*[strings(t["words"]) for t in templates])

    def place(s: Column) -> Column:
        whole = F.get(wholes, s["t"])
        same = F.size(F.filter(F.transform(whole, lambda w, i: word_at(s["at"] + i) == w), lambda x: F.coalesce(x, F.lit(False))))
        return F.struct(F.get(labels, s["t"]).alias("label"), F.get(bases, s["t"]).alias("base"), (s["at"] + F.get(firsts, s["t"])).cast("long").alias("start"), (same / F.size(whole)).alias("share"))

    places = F.transform(F.filter("starts", verified), place)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.struct(F.size("words").cast("long").alias("n_words"), places.alias("places")).alias(found))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs).select("doc_id", "licenses.n_words", F.explode(F.array(F.col("licenses.places"))).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("places")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)), 6).alias("score"),
    )


def _values() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = []
    for t in parsed():
        keys = "[" + ", ".join(f"{{'o': {off - t['keys'][0][0]}, 'w': {quoted(k)}}}" for off, k in t["keys"]) + "]"
        rows.append(f"('{t['label']}', {str(t['base']).lower()}, {t['keys'][0][0]}, {quoted(t['words'])}, {keys})")
    return ",\n".join(rows)


#: The same in SQL: every key phrase is compared at every word.
OP1_SQL = rf"""
WITH t(label, base, off, words, keys) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d),
h AS (SELECT rid, i AS start, label, base, round(len(list_filter(range(len(words)), lambda k: i - off + k >= 0 AND w[i - off + k + 1] = words[k + 1])) / CAST(len(words) AS DOUBLE), 6) AS share
  FROM p JOIN t ON w[i + 1] = keys[1].w[1] AND len(list_filter(keys, lambda k: w[i + k.o + 1 : i + k.o + len(k.w)] = k.w)) = len(keys)),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (rid)
"""
