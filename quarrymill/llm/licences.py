"""Operator 9: licence scans (``licence_scan``). DataFrame functions only.

Lines with a licence cue are compared with licence templates by the cosine of sparse TF-IDF vectors. Document
frequencies are counted over all such lines of the corpus for the templates' terms; a term that no template has gets
the weight of a term seen once. A file's licence is that of its best line above ``MIN_COSINE`` (ties: the first name).

In the same way the header that a file begins with (comment lines, or a first paragraph, of two lines at least) and a
licence file by name are compared with the customary headers, titles and texts in ``TEXTS``: as a whole and by paragraph,
with frequencies counted over these. A whole with ``SURE`` or more decides; else the best of whole, paragraph and line.
Long licences (GPL, Apache, MPL, EPL) stand in ``TEXTS`` with title and header, by which their full texts are known.

What a file states after ``SPDX-License-Identifier:`` is its licence as stated, with ``OR``, ``AND``, ``WITH`` and endings
like ``-or-later``, whether a template has it or not; of several statements the first by name.

A file is a licence file if its name says so, or if it has ``TEXT_WORDS`` words or more and its licence lines hold at least
half of them. A file without a licence of its own inherits that of the nearest directory above it that has a licence file
(named ones before others; their most frequent licence, ties: the first name), found by joining directories with their ancestors.

Defined results: a null or empty text has no licence of its own; rows with equal paths are one file whose lines are
pooled, each with a row in the result; a null path is the empty path in the root; repeated lines of a file count once;
an empty table gives an empty result; only path and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, written

MIN_COSINE = 0.6
CUE = r"(?i)licen[cs]|copyright|spdx|copyleft|all rights reserved|permission is hereby granted|redistribution and use|public domain"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: The same matches without backtracking into the group, which would recurse on long runs.
_TERM = r"[a-z0-9]++(?:\.[0-9]++)*+"
LICENCE_NAME = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[._-].*)?$"
# Customary licence sentences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Customary headers, titles and texts, for blocks and licence files. The SQL of the query knows the sentences above only.
TEXTS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GPL.format("Affero General Public License", 3)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_3 + _AS_IS),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GPL.format("General Public License", 2)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GPL.format("General Public License", 3)),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", "2.1").replace("program", "library")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3)),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3).replace("program", "library")),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
SURE = 0.9
#: A text that is less than this is a header, however much of it names a licence.
TEXT_WORDS = 20
_STATED_ID = r"\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?"
STATED = rf"(?i:SPDX-License-Identifier):[ \t]*({_STATED_ID}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_STATED_ID})*)"
_MARK = r"(?:/\*+|\*+/|\*|//+|#+|;+|--+|<!--|%+|dnl\b)"
_BLANK = r"\n[ \t]*\n"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_terms(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``(no, licence, term, tf)`` of the fixed templates."""
    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("licence"), F.lit(t).alias("text")) for i, (n, t) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows)).select("no", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("no", "licence", "term").agg(F.count("*").alias("tf"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def licence_blocks(files: DataFrame, path: Column, text: Column) -> DataFrame:
    """``(path, line, n_words, whole, held, terms)``: leading headers and licence files, whole and by paragraph.

    Comment marks are taken away. ``line`` is a digest, as a block may be long; ``held`` counts the block's words.
    """
    said = F.regexp_replace(text, r"\r\n?", "\n")
    begun = F.regexp_replace(said, r"\A\s+", "")
    lines = F.split(begun, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(r"^[ \t]*(?:$|" + _MARK + ")")), True)
    run = F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0)).cast("int"))), "\n")
    header = F.when(begun.startswith("/*"), F.substring_index(begun, "*/", 1)).when(begun.startswith("<!--"), F.substring_index(begun, "-->", 1)).when(begun.rlike(r"\A" + _MARK), run).otherwise(F.split(begun, _BLANK, 2)[0])
    is_named = F.regexp_extract(path, r"([^/]*)$", 1).rlike(LICENCE_NAME)
    block = F.regexp_replace(F.when(is_named, begun).otherwise(header), r"(?m)^[ \t]*" + _MARK, "")
    found = files.filter(text.rlike(CUE)).select(path.alias("path"), F.regexp_count(text, F.lit(SPACE_WORD)).alias("n_words"), is_named.alias("named"), block.alias("block"))
    found = found.filter(F.col("block").rlike(CUE) & (F.col("named") | F.trim("block").contains("\n")))
    parts = F.filter(F.split("block", _BLANK), lambda x: x.rlike(CUE))
    # Equal paragraphs fall together below.
    units = F.concat(F.array(F.struct(F.col("block").alias("line"), F.lit(True).alias("whole"))), F.transform(parts, lambda x: F.struct(x.alias("line"), F.lit(False).alias("whole"))))
    return _digested(found.select("path", "n_words", F.inline(units)), "whole")


def _digested(units: DataFrame, *also: str) -> DataFrame:
    """``units`` (path, n_words, line, ...) once each, with terms and word count; a digest stands for the line, which may be long."""
    measured = units.select("path", "n_words", *also, _terms(F.col("line")).alias("terms"), F.regexp_count("line", F.lit(SPACE_WORD)).alias("held"), F.sha2("line", 256).alias("line"))
    return measured.groupBy("path", "line").agg(*[F.max(c).alias(c) for c in ("n_words", "held", "terms", *also)])


def nearest_templates(lines: DataFrame, templates: DataFrame, min_cosine: float) -> DataFrame:
    """``(path, line, n_words, b)``: the lines (with terms) near a template; b holds minus the cosine (c) and the licence."""
    counted = lines.select("path", "line", "n_words", F.explode("terms").alias("term")).groupBy("path", "line", "n_words", "term").agg(F.count("*").alias("tf"))
    total = lines.count()
    seen = counted.join(F.broadcast(templates.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    vocabulary = templates.select("term").distinct().join(seen, "term", "left").select("term", (F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    vocabulary = F.broadcast(written(vocabulary, "licence_idf"))  # one row per term of the fixed templates
    known = templates.join(vocabulary, "term").withColumn("tw", F.col("tf") * F.col("idf"))
    known = known.withColumn("t_norm", F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(Window.partitionBy("no")))).select("no", "licence", "term", "tw", "t_norm")

    once = F.log(F.lit((1.0 + total) / 2.0)) + 1
    weighted = counted.join(vocabulary, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", once))
    weighted = weighted.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("path", "line"))))
    cosine = F.round(F.sum(F.col("w") * F.col("tw")) / (F.col("norm") * F.col("t_norm")), 6)
    near = weighted.join(F.broadcast(known), "term").groupBy("path", "line", "n_words", "norm", "no", "licence", "t_norm").agg(cosine.alias("cosine")).filter(F.col("cosine") >= min_cosine)
    return near.groupBy("path", "line", "n_words").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files`` with licence, origin (file, header, inherited, none) and cosine beside the path, a row per input row."""
    spark = files.sparkSession
    path = F.coalesce(files[path_col], F.lit(""))
    text = files[text_col]
    lines = files.filter(text.rlike(CUE)).select(path.alias("path"), F.regexp_count(text, F.lit(SPACE_WORD)).alias("n_words"), F.explode(F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)))).alias("line"))
    lines = lines.withColumn("stated", F.regexp_replace(F.regexp_extract("line", STATED, 1), "[.-]+$", ""))
    lines = written(_digested(lines, "stated"), "licence_lines")

    best = nearest_templates(lines, template_terms(spark), min_cosine).join(lines.select("path", "line", "held"), ["path", "line"])
    blocks = written(licence_blocks(files, path, text), "licence_blocks")
    sizes = blocks.select("path", "line", "whole", "held")
    block = nearest_templates(blocks, template_terms(spark, TEXTS), min_cosine).join(sizes, ["path", "line"])
    # A whole that is almost a template's text comes before all, with its own cosine.
    sure = F.col("whole") & (-F.col("b.c") >= SURE)
    block = block.groupBy("path").agg(
        F.min(F.struct((~sure).alias("r"), F.col("b.c").alias("c"), F.col("b.licence").alias("licence"))).alias("u"),
        F.max("held").alias("held_block"),
        F.max("n_words").alias("n_block"),
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    own = best.groupBy("path").agg(F.min("b").alias("b"), F.sum("held").alias("held"), F.max("n_words").alias("n_words"))
    own = own.join(block, "path", "full")
    of_line = F.when(F.col("b").isNotNull(), F.struct(F.lit(True).alias("r"), F.col("b.c").alias("c"), F.col("b.licence").alias("licence")))
    own = own.select("path", F.least(of_line, "u").alias("b"), F.greatest("held", "held_block").alias("held"), F.greatest("n_words", "n_block").alias("n_words"))
    stated = lines.filter("stated <> ''").groupBy("path").agg(F.min("stated").alias("stated"))
    own = own.join(stated, "path", "full")
    is_named = name.rlike(LICENCE_NAME)
    is_text = F.coalesce((F.col("n_words") >= TEXT_WORDS) & (2 * F.col("held") >= F.col("n_words")), F.lit(False))
    own = own.select("path", F.coalesce("stated", "b.licence").alias("own"), (-F.col("b.c")).alias("cosine"), is_named.alias("is_named"), (is_named | is_text).alias("is_file"))
    own = written(own, "licence_own")

    per = own.filter("is_file").groupBy(directory(F.col("path")).alias("above"), "is_named", "own").count()
    by_dir = per.groupBy("above").agg(F.min(F.struct((~F.col("is_named")).alias("other"), (-F.col("count")).alias("n"), "own"))["own"].alias("licence"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("above")))
    dirs = files.select(directory(path).alias("dir")).distinct().select("dir", F.inline(ancestors)).join(by_dir, "above")
    nearest = written(dirs.groupBy("dir").agg(F.max_by("licence", "depth").alias("inherited")), "licence_dirs")

    named = files.withColumns({"_path": path, "_dir": directory(path)}).drop("licence", "origin", "cosine")
    out = named.join(own.withColumnRenamed("path", "_path"), "_path", "left").join(nearest.withColumnRenamed("dir", "_dir"), "_dir", "left")
    origin = F.when(F.col("own").isNull(), F.when(F.col("inherited").isNull(), "none").otherwise("inherited")).when(F.col("is_file"), "file").otherwise("header")
    return out.select(*named.drop("_path", "_dir", text_col).columns, F.coalesce("own", "inherited", F.lit("")).alias("licence"), origin.alias("origin"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
