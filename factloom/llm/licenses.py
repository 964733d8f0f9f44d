"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams, in DataFrame functions.

Text is normalised: lower case (A-Z), licence spelled license, words of ASCII letters and digits, so that line breaks, comment marks and quotes don't count. A text is
compared line by line, paragraph by paragraph (runs of lines that are not blank), as a whole, and by windows of a template's own
number of words: wherever one of the template's anchors (see anchor_words()) stands in the text, the window is compared that puts it
at its place in the template. So a notice is found inside a longer line, wrapped over lines, or in a comment. A template is a
candidate only if a unit's size allows the wanted coefficient: with a and b bigrams, 2 min(a, b) / (a + b) is the most there can be.
Only candidates are intersected. Before any of that, texts that lack all anchor words are passed over.

Defined results: a null, empty or one-word text has no bigrams and no licence; a null id is carried along; repeated rows give
repeated results; equal coefficients go to the first template by name; other columns of the input are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import let

from .common import text_of

LEAST_DICE = 0.8
LONG_WORD = 6
#: Words of any prose, which make anchors only where nothing else is left.
COMMON_WORDS = frozenset("a all also an and any are as at be but by can for from has have if in is it may no not of on or other such than that the their they this to use was we which will with you your".split())

#: Texts and notices as they are published with these licences; "-line" and "-spdx" are one-line references to a licence, "-opening" the head of a long text.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-line": "the GNU Affero General Public License version 3",
    "agpl-3.0-opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause-line": "the BSD 2-Clause License",
    "bsd-2-clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-line": "the BSD 3-Clause License",
    "bsd-3-clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2.0-line": "the Eclipse Public License 2.0",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-line": "the GNU General Public License version 2",
    "gpl-2.0-opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-2.0-or-later-line": "under the GPL v2 or later",
    "gpl-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-named-line": "the GNU General Public License version 3",
    "gpl-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-3.0-or-later-line": "under the GPL v3 or later",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2.1-line": "the GNU Lesser General Public License version 2.1",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-licensed-line": "Licensed under the MIT License.",
    "mit-line": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "mit-named-line": "Released under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-under-line": "under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-line": "the Mozilla Public License 2.0",
    "mpl-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)).replace("licence", "license"))


def pairs(words: Column) -> Column:
    """The bigrams of an array of words, in order."""
    return let(words, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), lambda a, b: F.concat(a, F.lit(" "), b)))


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole text."""
    return F.array_distinct(F.concat(F.split(text, "[\r\n]+"), F.split(text, "(?:\r?\n[ \t]*){2,}"), F.array(text)))


def anchor_words(own: list[str], least: float) -> list[str]:
    """Words such that every unit that reaches `least` with a template of these bigrams has a bigram with one of them.

    Such a unit shares at least b least / (2 - least) of the template's b bigrams, so it has one of any b - that + 1 of them: words
    are taken that so many bigrams hold, long and telling ones first and of these the ones that most bigrams hold.
    """
    left, out = set(own), []
    while len(left) >= max(1, math.ceil(len(own) * least / (2 - least) - 1e-9)):
        held = Counter(w for g in left for w in set(g.split()))
        out.append(min(held, key=lambda w: (w in COMMON_WORDS, -min(len(w), LONG_WORD), -held[w], w)))
        left = {g for g in left if out[-1] not in g.split()}
    return sorted(out)


class Template(NamedTuple):
    words: int
    bigrams: list[str]  # distinct, sorted
    anchors: dict[str, int]  # bigrams with an anchor word, with their first place in the template


def prepared(templates: dict[str, str], least: float) -> dict[str, Template]:
    out = {}
    for name, text in sorted(templates.items()):
        words = normal_words(text)
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        if grams:
            anchors = set(anchor_words(sorted(set(grams)), least))
            out[name] = Template(len(words), sorted(set(grams)), {g: grams.index(g) for g in sorted(set(grams)) if anchors & set(g.split())})
    return out


def license_matches(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """One row per input row: <id_col>, matches array<struct<name, dice>>: each template's best unit, if it reaches `least`."""
    tables = prepared(templates or TEMPLATES, least)
    text = text_of(text_col)
    every = sorted({w for t in tables.values() for w in anchor_words(t.bigrams, least)})
    may = text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(w.replace("license", "licen[cs]e") for w in every) + ")(?![a-z0-9])")
    words = lambda u: F.regexp_extract_all(F.replace(F.translate(u, UPPER, LOWER), F.lit("licence"), F.lit("license")), F.lit("[a-z0-9]+"), F.lit(0))
    none = F.array().cast("array<string>")
    texts = documents.select(F.col(id_col).alias("id"), F.when(may, text).alias("text"))
    rows = texts.select("id", F.when(F.col("text").isNotNull(), F.filter(F.transform(units(F.col("text")), lambda u: F.array_distinct(pairs(words(u)))), lambda g: F.size(g) > 0)).otherwise(F.array(none)).alias("units"), F.when(F.col("text").isNotNull(), pairs(words(F.col("text")))).otherwise(none).alias("grams"))
    listed = lambda values: ", ".join(f"'{g}'" for g in values)  # noqa: E731  (of a to z, digits and spaces)
    anchors = sorted({g for t in tables.values() for g in t.anchors})
    placed = rows.select("id", "units", "grams", F.expr(f"filter(transform(grams, (g, i) -> if(g IN ({listed(anchors)}), i, NULL)), i -> i IS NOT NULL)").alias("places"))

    def best(t: Template) -> Column:
        """The best coefficient of the units and windows whose size allows `least`. As text, since a thousand literals take long to build one by one."""
        size = len(t.bigrams)
        own = f"filter(places, p -> get(grams, p) IN ({listed(t.anchors)}))"
        offsets = "map(" + ", ".join(f"'{g}', {at}" for g, at in t.anchors.items()) + ")"
        starts = f"array_distinct(transform({own}, p -> p - try_element_at({offsets}, get(grams, p))))"
        windows = f"transform({starts}, s -> array_distinct(slice(grams, greatest(s, 0) + 1, {t.words - 1} + least(s, 0))))"
        fits = f"filter(concat(units, {windows}), g -> 2 * least(size(g), {size}) >= {float(least)}D * (size(g) + {size}))"
        return F.expr(f"array_max(transform({fits}, g -> 2.0D * size(array_intersect(g, array({listed(t.bigrams)}))) / (size(g) + {size})))")

    each = F.array(*[F.struct(F.lit(k).alias("name"), best(t).alias("dice")) for k, t in tables.items()])
    return placed.select(F.col("id").alias(id_col), F.filter(each, lambda m: m["dice"] >= least).alias("matches"))


def license_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = license_matches(documents, id_col, text_col)
    top = F.array_max(F.transform("matches", lambda m: m["dice"]))
    name = F.get(F.filter("matches", lambda m: m["dice"] == top), F.lit(0))["name"]
    return found.select(F.col(id_col), F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["name"]), ",").alias("licenses"), name.alias("best_license"), F.round(top, 9).alias("best_dice"))


def report_sql(least: float = LEAST_DICE) -> str:
    """license_report(documents) in DuckDB's SQL."""
    tables = prepared(TEMPLATES, least)
    listed = lambda values: "[" + ", ".join(f"'{g}'" for g in values) + "]"
    values = ", ".join(f"('{k}', {listed(t.bigrams)}, {t.words})" for k, t in tables.items())
    anchors = ", ".join(f"('{k}', '{g}', {at})" for k, t in tables.items() for g, at in t.anchors.items())
    return f"""
WITH templates(name, own, words) AS (VALUES {values}),
anchors(name, gram, spot) AS (VALUES {anchors}),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT rid, unnest(list_distinct(list_concat(string_split_regex(t, '[\r\n]+'), string_split_regex(t, '(?:\r?\n[ \t]*){{2,}}'), [t]))) AS u FROM numbered),
worded AS (SELECT rid, regexp_extract_all(replace(translate(u, '{UPPER}', '{LOWER}'), 'licence', 'license'), '[a-z0-9]+') AS w FROM parts),
grams AS (SELECT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
whole AS (SELECT rid, regexp_extract_all(replace(translate(t, '{UPPER}', '{LOWER}'), 'licence', 'license'), '[a-z0-9]+') AS w FROM numbered),
paired AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS all_grams FROM whole WHERE len(w) > 1),
placed AS (SELECT rid, unnest(all_grams) AS gram, generate_subscripts(all_grams, 1) - 1 AS place FROM paired),
starts AS (SELECT DISTINCT rid, name, place - spot AS s FROM placed JOIN anchors USING (gram)),
windows AS (SELECT rid, name, own, list_distinct(all_grams[greatest(s, 0) + 1 : s + words - 1]) AS g FROM starts JOIN paired USING (rid) JOIN templates USING (name)),
compared AS (SELECT rid, name, own, g FROM grams, templates UNION ALL SELECT rid, name, own, g FROM windows),
scored AS (SELECT rid, name, max(2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own))) AS dice FROM compared
  WHERE 2 * least(len(g), len(own)) >= {least} * (len(g) + len(own)) GROUP BY rid, name),
kept AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS licenses, arg_min(name, (-dice, name)) AS best_license, max(dice) AS best_dice FROM scored WHERE dice >= {least} GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, best_license, round(best_dice, 9) AS best_dice
FROM numbered LEFT JOIN kept USING (rid)"""
