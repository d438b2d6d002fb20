"""License scan: Dice coefficient over word bigrams between units of a text and license templates.

Units are the lines of a text, its blocks (lines between blank lines, where a block has several lines) and the whole
text where it has several parts, for full licence texts. Both
sides are lower-cased runs of letters and digits, as sets of distinct word bigrams. A template is a candidate for
a unit only if their set sizes allow the wanted coefficient, and only if they share enough bigrams: those of the
few templates are looked up by hash while the texts are scanned, so hardly a unit is compared with a template in
vain. Only DataFrame functions are used.

Cases: null and empty texts, and units with fewer than two words, match nothing; texts are taken whole; repeated
rows, and rows that share an id, give one row per (id, unit, license); rows with a null id are ignored; of equal
coefficients the license that sorts first wins; an empty table gives an empty table. Only the two named columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.llm.staging import materialise, small_side

#: Least coefficient of a match.
LEAST = 0.8

# Licence texts and notices as they are commonly given.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Whole licence texts, without their titles and copyright lines.
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
FULL_TEXTS = {
    "MIT": "\n\n".join(TEMPLATES["MIT"][3:]),
    "BSD-2-Clause": BSD_CONDITIONS + "\n\n" + BSD_WARRANTY,
    "BSD-3-Clause": BSD_CONDITIONS + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + BSD_WARRANTY,
    "ISC": TEMPLATES["ISC"][0] + "\n\n" + ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC_WARRANTY,
    "Apache-2.0": "\n\n".join(TEMPLATES["Apache-2.0"][1:]),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
for _name, _text in FULL_TEXTS.items():
    TEMPLATES[_name] = [*TEMPLATES.get(_name, []), _text]


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """Distinct word bigrams."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))


def _once(value: Column, name: str) -> Column:
    """``value`` as a generated column, which the optimizer doesn't copy into the expressions that use it."""
    return F.explode(F.array(value)).alias(name)


def template_grams(spark: SparkSession, templates: dict[str, list[str]], least: float) -> DataFrame:
    """license, template (number), size, lo (the least size of a unit that it can match, and the fewest common bigrams), gram: as many rows as the templates have bigrams."""
    rows = [(name, i, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    held = spark.createDataFrame(rows, "license string, template int, text string").select("license", "template", _once(words_of(F.col("text")), "words"))
    sized = held.where(F.size("words") > 1).select("license", "template", _once(bigrams(F.col("words")), "grams")).withColumn("size", F.size("grams"))
    return sized.select("license", "template", "size", (F.col("size") * least / (2 - least) - 1e-6).alias("lo"), F.explode("grams").alias("gram"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, unit ('line', 'block' or 'text'), unit_no (from 0), license, template, dice: the best template of each license for each unit, at ``least`` or more."""
    templates = TEMPLATES if templates is None else templates
    grams = template_grams(docs.sparkSession, templates, least)

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("text")))
    blocks = F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("block").alias("unit"), i.alias("unit_no"), x.alias("text"))), lambda x: F.contains(x["text"], F.lit("\n")))

    entire = F.when(F.regexp_like(text, F.lit(r"\n[ \t\r]*\n")), F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), text.alias("text")))).otherwise(F.array())

    def units(rows: DataFrame) -> DataFrame:
        split = rows.select(F.col(id_col).alias("id"), F.explode(F.concat(lines, blocks, entire)).alias("u")).select("id", "u.unit", "u.unit_no", _once(words_of(F.col("u.text")), "words"))
        return split.where(F.size("words") > 1)

    # a pair with the wanted coefficient shares at least lo of the template's bigrams; counted with repeats, which only adds
    def near(rows: DataFrame, *key: str) -> DataFrame:
        most = F.size("words") - 1
        joined = F.zip_with(F.slice("words", 1, most), F.slice("words", 2, most), lambda a, b: F.concat_ws(" ", a, b))
        pairs = rows.select(*key, most.alias("most"), F.explode(joined).alias("gram"))
        # the templates are given in code, so their bigrams have a fixed size
        hits = pairs.join(F.broadcast(grams), "gram").where("most >= lo").groupBy(*key, "license", "template").agg(F.count("*").alias("hits"), F.first("lo").alias("lo"))
        return hits.where("hits >= lo").select(*key, "license", "template")

    # the words of a unit follow each other in the whole text, so a text has all bigrams of its units: texts first, then units of those left
    known = docs.where(F.col(id_col).isNotNull())
    entire_texts = known.select(F.col(id_col).alias("id"), _once(words_of(text), "words")).where(F.size("words") > 1)
    open_ = materialise(near(entire_texts, "id").select(F.col("id").alias(id_col)).distinct(), "license-texts")
    hits = materialise(near(units(known.join(small_side(open_), id_col, "left_semi")), "id", "unit", "unit_no"), "license-hits")

    held = docs.join(small_side(hits.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")
    whole = grams.groupBy("license", "template").agg(F.collect_set("gram").alias("template_grams"))
    both = units(held).join(small_side(hits), ["id", "unit", "unit_no"]).join(F.broadcast(whole), ["license", "template"])
    sets = both.select("id", "unit", "unit_no", "license", "template", "template_grams", _once(bigrams(F.col("words")), "grams"))
    common = F.size(F.array_intersect("grams", "template_grams"))
    rated = sets.select("id", "unit", "unit_no", "license", "template", (2.0 * common / (F.size("grams") + F.size("template_grams"))).alias("dice")).where(F.col("dice") >= least).distinct()
    best = rated.groupBy("id", "unit", "unit_no", "license").agg(F.max(F.struct("dice", -F.col("template"))).alias("x"))
    return best.select(F.col("id").alias(id_col), "unit", "unit_no", "license", (-F.col("x.col2")).alias("template"), F.col("x.dice").alias("dice"))


def license_of(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with a match: its best license."""
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("dice"), "license", "unit", "unit_no")))
    return ranked.where("rank = 1").drop("rank")
