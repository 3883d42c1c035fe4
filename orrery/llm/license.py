"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance along directories.

1. Texts are weighed whole, by paragraphs (headers are such), by sentences (lines, or ends of sentences)
   and by the words that lead up to or follow a "licence" in a sentence; each distinct unit once. Units that
   hold none of the templates' anchors() are left out: none of them can reach the least cosine.
2. A unit is a sparse vector of its terms' counts times their inverse document frequency in the
   templates; common words have no weight. The template of the greatest cosine wins, if it reaches MIN_COSINE.
3. A file's own licence is that of its SPDX-License-Identifier, as it stands there, or else of its best
   unit; "All rights reserved" counts only without any other. A file is a licence file if its name says
   so, if it is weighed whole as a licence, or if its licence sentences make up FILE_SHARE of its words;
   the best licence file stands for its directory.
4. A file without a licence of its own inherits from the nearest directory above it that has one, by
   a join of the distinct directories' ancestors with the directories that have licences.

Defined results: null and empty texts have no licence of their own and may inherit. Null paths have
no directory and inherit nothing. Ties go to the greatest licence name. Repeated rows stay.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

MIN_COSINE, FILE_SHARE = 0.6, 0.5
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+:-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+:-]+)*|\([^\n]*\))"
_WORDS_AROUND = (r"(?i)(?:\S+\s+){0,4}licen[cs]e\S*", r"(?i)licen[cs]ed?\S*(?:\s+\S+){1,6}")
_PARAGRAPH = r"\n[ \t]*(?:[#/*;%!-]+[ \t]*)?(?=\n)"
# Words without weight, and those that anchors() avoids where it can.
_COMMON = set("a all an and any are as at be but can do for from have if in is it its may more must no not of on one or other out should so such that the their them these this to was will with you your".split())
_PLAIN = set("a all an and any are as at be but by can copy copies distribute file following for free from have hereby if in including is it its library made may met must no not notice of on or other permitted permission person program provided published redistribute released should software some source terms that the their them these this to under use used version without with within work works you your 0 1 2 3 4".split())
_TERM = "[a-z0-9]+"
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"

# Notices, headers, titles and texts of usual licences; further templates are a parameter.
_LATER = "either version {} of the License, or (at your option) any later version"
_GNU = [
    ("GPL-2.0", "General Public License", _LATER.format(2)), ("GPL-3.0", "General Public License", _LATER.format(3)),
    ("LGPL-3.0", "Lesser General Public License", _LATER.format(3)), ("AGPL-3.0", "Affero General Public License", _LATER.format(3)),
]
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, under the MIT License."),
    ("BSD-3-Clause", "Redistribution under the terms of the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution under the terms of the BSD 2-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *[(name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, {version}.") for name, kind, version in _GNU],
    *[(name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, {version}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program.") for name, kind, version in _GNU],
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    *[("MIT", x) for x in (*_MIT, " ".join(_MIT))],
    *[("BSD-2-Clause", x) for x in (_BSD[0], f"{_BSD[0]} {_BSD[2]}")],
    *[("BSD-3-Clause", x) for x in (f"{_BSD[0]} {_BSD[1]}", f"{_BSD[0]} {_BSD[1]} {_BSD[2]}")],
    ("ISC", _ISC),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
]


def vectors(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, float]], list[tuple[str, int, str, float]], float]:
    """idf of each term, unit vectors of the templates as (term, template, licence, weight), and the idf of other terms."""
    bags = [(name, Counter(re.findall(_TERM, text.lower()))) for name, text in templates]
    df = Counter(t for _, bag in bags for t in bag)
    other = math.log(1 + len(bags)) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()} | dict.fromkeys(_COMMON, 0.0)
    rows = []
    for k, (name, bag) in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(t, k, name, n * idf[t] / norm) for t, n in sorted(bag.items()) if idf[t]]
    return sorted(idf.items()), rows, other


def _values(spark, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def anchors(templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> list[str]:
    """Terms of which any unit that reaches min_cosine has one.

    A cosine to a template is at most the length of the template's vector over the terms that both have. So terms whose
    squares sum to less than min_cosine squared may be left out of each template: plain words first, then the lightest.
    """
    by: dict[int, list[tuple[bool, float, str]]] = {}
    for term, k, _, w in vectors(templates)[1]:
        by.setdefault(k, []).append((term not in _PLAIN, w, term))
    found = set()
    for terms in by.values():
        left = min_cosine**2 - 1e-6
        for _, w, term in sorted(terms):
            left -= w * w
            if left < 0:
                found.add(term)
    return sorted(found)


def any_of(terms: list[str]) -> str:
    """A pattern of the whole words that are among terms (of [a-z0-9]), as a tree of prefixes: a word that isn't costs a few comparisons, not one a term."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return rf"(?i)\b(?=[{''.join(sorted(tree))}]){pattern(tree)}\b" if tree else "(?!)"


def best_templates(sentences: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """key (the MD5), licence, cosine of the distinct units that reach min_cosine. sentences: a column sentence."""
    spark = sentences.sparkSession
    idf, unit, other = vectors(templates)
    words = sentences.select(F.md5("sentence").alias("key"), "sentence").dropDuplicates(["key"]).select("key", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(_TERM), F.lit(0))).alias("term"))
    counted = words.groupBy("key", "term").count()
    weighed = counted.join(F.broadcast(_values(spark, idf, "term string, idf double")), "term", "left").select("key", "term", (F.col("count") * F.coalesce("idf", F.lit(other))).alias("w"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(_values(spark, unit, "term string, template int, licence string, unit double")), "term").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"), F.count("*").alias("n")).filter("n > 1")  # one word, such as "mit", is no notice
    cosine = dots.join(norms, "key").select("key", F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"), "licence").alias("m"))
    return cosine.groupBy("key").agg(F.max("m").alias("m")).select("key", "m.licence", "m.cosine").filter(F.col("cosine") >= min_cosine)


def _extracted(pattern: str, sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))


def scan(files: DataFrame, path: Column, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, own_licence, cosine, n_sentences, licence, inherited_from (a directory; the root is the empty string) of every file."""
    rows = files.select(files[id_col].alias("doc_id"), path.alias("path"), files[text_col].alias("text"))
    dir_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    anchor = any_of(anchors(templates, min_cosine))
    held = lambda units: F.filter(units, lambda u: u.rlike(anchor))
    n_words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    likely = rows.filter(F.col("text").rlike(f"{anchor}|{_SPDX}")).withColumn("sentences", held(F.split("text", r"\n|(?<=[.!?;])\s+")))
    around = [F.flatten(F.transform("sentences", functools.partial(_extracted, r))) for r in _WORDS_AROUND]
    larger = F.array_except(held(F.concat(F.split("text", _PARAGRAPH), *around)), F.array_append("sentences", F.col("text")))
    whole = F.when(~F.array_contains("sentences", F.col("text")), F.array("text")).otherwise(F.array().cast("array<string>"))
    of_kind = lambda units, kind: F.transform(units, lambda u: F.struct(u.alias("sentence"), F.lit(kind).alias("kind")))
    declared = F.nullif(F.regexp_extract("text", _SPDX, 1), F.lit(""))
    units = F.concat(of_kind(F.col("sentences"), 0), of_kind(larger, 1), of_kind(held(whole), 2))
    told = written(likely.select("doc_id", "path", n_words("text").alias("n_words"), declared.alias("declared"), F.explode_outer(units).alias("u")).select("doc_id", "path", "n_words", "declared", "u.*"), "licence-units")
    # A declared identifier is exact, and rights that are reserved are no licence.
    best = best_templates(told.filter("sentence IS NOT NULL"), templates, min_cosine)
    matched = told.withColumn("key", F.md5("sentence")).join(best, "key", "left").filter("licence IS NOT NULL OR declared IS NOT NULL")
    rank = F.struct(F.col("declared").isNotNull().alias("exact"), (F.col("licence") != "Proprietary").alias("told"), F.when(F.col("declared").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("cosine"), F.coalesce("declared", "licence").alias("licence"))
    hit, is_sentence = F.col("cosine").isNotNull(), F.col("kind") == 0
    own = matched.groupBy("doc_id", "path").agg(F.max(rank).alias("m"), F.count(F.when(hit & is_sentence, 1)).alias("n_sentences"), F.sum(F.when(hit & is_sentence, n_words("sentence")).otherwise(0)).alias("n_own"), F.max("n_words").alias("n_words"), F.max(hit & (F.col("kind") == 2)).alias("whole"))
    own = own.select("doc_id", "path", "m.licence", "m.cosine", "n_sentences", (F.col("path").rlike(_FILE_NAME) | F.coalesce("whole", F.lit(False)) | (F.col("n_own") >= FILE_SHARE * F.col("n_words"))).alias("is_file"))
    of_dir = own.filter("is_file AND path IS NOT NULL").groupBy(dir_of.alias("above")).agg(F.max(F.struct("cosine", "licence")).alias("m")).select("above", F.col("m.licence").alias("dir_licence"))
    dirs = rows.select(dir_of.alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("a")).select("dir", "a.*")
    nearest = ancestors.join(of_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("m")).select("dir", "m.above", "m.dir_licence")
    found = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("licence").alias("own_licence"), "cosine", "n_sentences")
    joined = rows.select("doc_id", "path", dir_of.alias("dir")).join(found, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    inherits = F.col("own_licence").isNull()
    return joined.join(nearest, "dir", "left").select(
        "doc_id", "path", "own_licence", "cosine", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"),
        F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(inherits, F.col("above")).alias("inherited_from"),
    )
