"""License scans by a positional index of rare words, with DataFrame functions only.

TEMPLATES hold, for each label, public licence texts and notices, each with a mandatory key phrase. The index maps
every word to its postings (template, offset) and its inverse document frequency over the templates; words below LEAST_IDF and
the usual English stopwords are left out. In a file, the words of the index are looked up with their positions (``hits``). The rarest word of a template's key phrase gives the
places where the template may begin; the key phrase must stand there word for word. The template's postings are then
intersected with the hits by relative position: a posting counts if its word stands within the template's slack of
where the beginning puts it (a sixteenth of the template's length, so that a long text may have some words put in or left out). The
share of idf that counts is the score, and from SHARE on the file gets the template's label.

Since key phrases are mandatory, texts that hold none of their rarest words beside the next one can't match; these are passed
over by one search for such pairs. Every other file is looked up at every such place; nothing is capped.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased in A-Z only.

Defined cases: a null text counts as empty; a text without matches has n_base 0, null first and last words, empty
labels and score 0; long texts are read whole; repeated rows each get their result; an empty table gives no rows; columns besides doc_id and text don't matter.
"""

import math
import re
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import STOPWORDS

#: The base phrases, by label.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Share of a template's idf that must stand at its relative positions; least idf of a word of the index.
SHARE, LEAST_IDF = 0.6, 0.5

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1}. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)

#: Fixed values: (label, public text, mandatory key phrase of it).
TEMPLATES = [
    ("agpl-3.0", _GNU.format("Affero General Public License", "either version 3 of the License, or (at your option) any later version"), "GNU Affero General Public License as published"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3", "Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "you may not use this file except in compliance with the License"),
    ("bsd-2-clause", _BSD + _BSD_END, "Redistribution and use in source and binary forms"),
    ("bsd-3-clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END, "may be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License", "BSD 2-Clause"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License", "BSD 3-Clause"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "any person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal", "has waived all copyright and related or neighboring rights"),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("gpl-2.0", _GNU.format("General Public License", "either version 2 of the License, or (at your option) any later version"), "Free Software Foundation, either version 2"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl-3.0", _GNU.format("General Public License", "either version 3 of the License, or (at your option) any later version"), "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU Lesser General Public License as published"),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "Lesser General Public License, version 2.1"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "anyone to use this software for any purpose including commercial applications"),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


class Template(NamedTuple):
    label: str
    postings: list[tuple[str, int, float]]  # word, offset, idf
    key: list[str]
    at: int  # offset of the key phrase
    rare: int  # the rarest word of the key phrase, by its place in it
    slack: int

    @property
    def total(self) -> float:
        return sum((v for _, _, v in self.postings), 0.0)


def build_index(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    texts = [words_of(t) for _, t, _ in templates]
    df = Counter(w for t in texts for w in set(t))
    idf = {w: math.log(len(texts) / n) for w, n in df.items()}
    out = []
    for (label, _, key), t in zip(templates, texts):
        k = words_of(key)
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        # Digits and short words are common outside licences, whatever the templates say.
        rare = max(range(len(k)), key=lambda i: (len(k[i]) > 2 and not k[i].isdigit(), idf[k[i]], len(k[i])))
        out.append(Template(label, [(w, i, idf[w]) for i, w in enumerate(t) if idf[w] >= LEAST_IDF and w not in STOPWORDS], k, at, rare, len(t) // 16))
    return out


def _may_match(keys: list[tuple[list[str], int]]) -> Column:
    """Whether a text holds the rarest word of some key phrase (of two words or more) together with a neighbour of it.

    Most texts hold none of these words even as a substring, which is told faster than by the pattern. low: the text in lower case; whatever it
    does to other letters, the words' own stay.
    """
    pairs = sorted({_SEPARATORS.join(k[max(r - 1, 0) : max(r - 1, 0) + 2]) for k, r in keys})
    some = reduce(Column.__or__, (F.contains("low", F.lit(w)) for w in sorted({k[r] for k, r in keys})))
    return some & F.col("text").rlike("(?i)" + "|".join(pairs))


def _starts(key: list[str], rare: int) -> Column:
    """Where the key words stand in w, found by the places of the rarest one in hits."""
    n = len(key)
    starts = F.transform(F.filter("hits", lambda x: x["w"] == key[rare]), lambda x: x["i"] - rare)
    return F.filter(starts, lambda s: (s >= 0) & (s + n <= F.size("w")) & (F.slice("w", F.greatest(s, F.lit(0)) + 1, F.lit(n)) == F.array(*map(F.lit, key))))


def _share(starts: str, t: Template) -> Column:
    """The largest share of a template's postings that the hits meet by relative position, over the starts of its key phrase; 0 without one."""
    quoted = ", ".join(f"struct('{w}' as w, {i} as i, {v!r}D as v)" for w, i, v in t.postings)
    postings = F.expr(f"array({quoted})")

    def here(start: Column) -> Column:
        begin = start - t.at
        near = lambda p: F.exists("hits", lambda x: (x["w"] == p["w"]) & (F.abs(x["i"] - p["i"] - begin) <= t.slack))
        return F.aggregate(postings, F.lit(0.0), lambda got, p: got + F.when(near(p), p["v"]).otherwise(F.lit(0.0))) / F.lit(t.total)

    return F.coalesce(F.array_max(F.transform(starts, here)), F.lit(0.0))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the columns of op10."""
    index, base = build_index(), [words_of(p) for p in BASE.values()]
    keys = [(t.key, t.rare) for t in index] + [(p, 0) for p in base]
    vocabulary = sorted({w for t in index for w, _, _ in t.postings} | {k[r] for k, r in keys})
    may = _may_match(keys)
    none = F.array().cast("array<string>")
    words = F.when(may, F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_WORD), F.lit(0))).otherwise(none)
    docs = docs.select("doc_id", "text", F.lower("text").alias("low"))
    docs = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("bigint").alias("n_words"), F.coalesce(words, none).alias("w"))
    docs = docs.withColumn("hits", F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*vocabulary)))
    found = {f"t{j}": _starts(t.key, t.rare) for j, t in enumerate(index)} | {f"b{j}": F.transform(_starts(p, 0), lambda i: i.cast("bigint")) for j, p in enumerate(base)}
    docs = docs.select("doc_id", "n_words", "hits", *(s.alias(c) for c, s in found.items()))
    docs = docs.select("*", *(_share(f"t{j}", t).alias(f"s{j}") for j, t in enumerate(index)))
    labels = [F.when(F.round(f"s{j}", 9) >= SHARE, F.lit(t.label)) for j, t in enumerate(index)]
    base_labels = [F.when(F.size(f"b{j}") > 0, F.lit(label)) for j, label in enumerate(BASE)]
    scores = [F.col(f"s{j}") for j in range(len(index))] + [F.when(F.size(f"b{j}") > 0, 1.0).otherwise(0.0) for j in range(len(BASE))]
    places = F.concat(*(F.col(f"b{j}") for j in range(len(BASE))))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",")
    return docs.select("doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base_labels).alias("base_labels"), joined([*base_labels, *labels]).alias("labels"), F.round(F.greatest(*scores), 9).alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    """The same by definition: every place of every key phrase, and every posting of its template looked up around its place."""
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    index = build_index()
    templates = ",\n".join(f"({j}, '{t.label}', {words(t.key)}, {t.at}, {t.slack}, {t.total!r}::double, [{', '.join(f'{{w: {w!r}, i: {i}, v: {v!r}::double}}' for w, i, v in t.postings)}])" for j, t in enumerate(index))
    base = ", ".join(f"('{k}', {words(words_of(p))})" for k, p in BASE.items())
    at = "list_filter(range(1, len(w) - len(key) + 2), lambda i: w[i:i + len(key) - 1] = key)"
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
b(label, key) as (values {base}),
t(j, label, key, key_at, slack, total, p) as (values {templates}),
found as (select doc_id, label, unnest({at}) - 1 as i from d, b where list_has_all(w, key)),
of_base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as ls from found group by doc_id),
begins as (select doc_id, w, label, p, slack, total, unnest({at}) - key_at as lo from d, t where list_has_all(w, key)),
shares as (select doc_id, label, list_sum(list_transform(p, lambda x: case when lo + x.i + slack >= 1 and list_contains(w[greatest(1, lo + x.i - slack):lo + x.i + slack], x.w) then x.v else 0.0 end)) / total as share from begins),
of_templates as (select doc_id, max(share) as best, list_distinct(list(label) filter (where round(share, 9) >= {SHARE})) as ls from shares group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(a.ls), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a.ls, []), coalesce(c.ls, [])))), ','), '') as labels,
  round(greatest(coalesce(best, 0.0), case when n_base > 0 then 1.0 else 0.0 end), 9) as score
from d left join of_base a using (doc_id) left join of_templates c using (doc_id)
"""


OP10_SQL = _sql()
