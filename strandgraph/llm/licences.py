"""Licence scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

DataFrame expressions only, one pass over the rows, no shuffle. Text is lower-cased (A-Z), each run of other characters than
a-z, 0-9 and line feeds becomes one space. What is compared: each line, each paragraph (parted by a line without letters and
digits), the whole text, and windows of as many words as a template has, at each place that one of its bigrams starts, so a
notice inside a line and a licence inside a longer text are found too. Bigrams are a set of 64-bit hashes.

With m bigrams in a template and a in a unit, Dice >= t needs a between m * t / (2 - t) and m * (2 - t) / t, as the common
bigrams are at most min(a, m), and t * (a + m) / 2 of them in common. A template of which the whole text has fewer can match
nothing in it: a text first meets all templates' bigrams at once, then each template by that number, and units are only made for
what is left. The templates are a column of one array, so the plan doesn't grow with them.

The long texts of some licences (Apache, GPL, MPL) are found by their heads; others can be given as templates.

Defined results: a null or empty text, and one without a match, has no licence (null), dice 0 and no units. Of equal scores the
first name in alphabetical order wins. Every row is judged by itself, so repeated rows, null ids and empty tables need no
rule of their own. The columns of the input stay; clashing names get underscores before them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, text_or_empty

THRESHOLD = 0.8

# Notices, heads and texts of public licences.
TEMPLATES = {
    "0BSD": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.',
    ),
    "AGPL-3.0": (
        'Licensed under the GNU Affero General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
        'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    ),
    "BSD-2-Clause": (
        'Licensed under the BSD 2-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        'Licensed under the BSD 3-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
    ),
    "BSL-1.0": (
        'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    ),
    "CC-BY-4.0": (
        'Licensed under CC BY 4.0.',
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    ),
    "CC-BY-NC-4.0": (
        'Licensed under CC BY-NC 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    ),
    "CC-BY-ND-4.0": (
        'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    ),
    "CC-BY-SA-4.0": (
        'Licensed under CC BY-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    ),
    "CC0-1.0": (
        'This work is dedicated to the public domain under CC0 1.0 Universal.',
        'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.',
    ),
    "EPL-2.0": (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    ),
    "GPL-2.0": (
        'This work is licensed under the GNU General Public License, version 2.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
        'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    "GPL-3.0": (
        'This work is licensed under the GNU General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
        'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    "ISC": (
        'Licensed under the ISC License.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "LGPL-2.1": (
        'Licensed under the GNU Lesser General Public License, version 2.1.',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA',
    ),
    "LGPL-3.0": (
        'Licensed under the GNU Lesser General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    "MIT": (
        'Released under the MIT License.',
        'Licensed under the MIT License.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    ),
    "PostgreSQL": (
        'Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.',
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ),
    "WTFPL": (
        'DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


def template_words(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(licence, normalised words) for each template text of two words or more, by licence."""
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.translate(str.maketrans(UPPER, LOWER))).strip(" ").split(" ")
    found = [(name, plain(t)) for name in sorted(templates) for t in templates[name]]
    return [(name, words) for name, words in found if len(words) > 1]


def bounds(m: int, threshold: float) -> tuple[int, int, int]:
    """The least and greatest number of bigrams of a unit that can reach the threshold against m, and the least in common."""
    sizes = [a for a in range(1, int(m * 2 / threshold) + 2) if 2 * min(a, m) >= threshold * (a + m)]
    return sizes[0], sizes[-1], math.ceil(threshold * (sizes[0] + m) / 2 - 1e-9)


def _grams(words: Column) -> Column:
    """The hashes of neighbouring words, in order; words has one at least."""
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _hashes(pairs: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(f"xxhash64('{a}', '{b}')" for a, b in pairs) + ")"


def _template_column(fixed: list[tuple[str, list[str]]], threshold: float) -> Column:
    """An array of (licence, words, m, low, high, need, grams), folded into one literal."""
    out = []
    for name, words in fixed:
        pairs = list(dict.fromkeys(zip(words, words[1:])))
        low, high, need = bounds(len(pairs), threshold)
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        out.append(f"named_struct('licence', '{quoted}', 'words', {len(words)}, 'm', {len(pairs)}, 'low', {low}, 'high', {high}, 'need', {need}, 'grams', {_hashes(pairs)})")
    return F.expr(f"array({', '.join(out)})")


def _dice(unit: Column, t: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(unit, t["grams"])) / (F.size(unit) + t["m"])


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with licence (the best match or null), dice (its coefficient, else 0) and n_licence_units (lines, paragraphs and whole
    texts that match, equal ones counted once)."""
    fixed = template_words(TEMPLATES if templates is None else templates)
    licence, dice, n = (free_name(docs, x) for x in ("licence", "dice", "n_licence_units"))
    names = [free_name(docs, f"licence_{x}") for x in ("text", "words", "grams", "met", "alive", "units", "hits", "windows")]
    plain, words, grams, met, alive, units, hits, windows = names
    none = F.array().cast("array<struct<dice:double,licence:string>>")
    one_line = lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " "))
    if not fixed:
        return docs.select("*", F.lit(None).cast("string").alias(licence), F.lit(0.0).alias(dice), F.lit(0).cast("bigint").alias(n))
    least = min(bounds(len(set(zip(w, w[1:]))), threshold)[2] for _, w in fixed)
    every = list(dict.fromkeys(p for _, w in fixed for p in zip(w, w[1:])))
    df = docs.withColumn(plain, F.regexp_replace(F.translate(text_or_empty(docs, text), UPPER, LOWER), "[^a-z0-9\n]+", " "))
    df = df.withColumn(words, F.split(one_line(F.col(plain)), " ")).withColumn(grams, _grams(F.col(words))).drop(words)
    df = df.withColumn(met, F.array_intersect(F.col(grams), F.expr(_hashes(every))))
    lives = F.filter(_template_column(fixed, threshold), lambda t: F.size(F.array_intersect(F.col(met), t["grams"])) >= t["need"])
    df = df.withColumn(alive, F.when(F.size(met) >= least, lives)).drop(met)
    some = F.coalesce(F.size(alive) > 0, F.lit(False))
    whole = F.col(plain)
    parts = F.array_union(F.split(whole, "\n"), F.array_union(F.split(whole, "\n(?: ?\n)+"), F.array(whole)))
    lists = F.transform(F.array_distinct(F.transform(parts, one_line)), lambda u: F.split(u, " "))
    df = df.withColumn(units, F.when(some, F.transform(lists, lambda w: F.array_distinct(_grams(w)))))

    def best(unit: Column) -> Column:
        fits = F.filter(F.col(alive), lambda t: F.size(unit).between(t["low"], t["high"]))
        return _first(F.filter(F.transform(fits, lambda t: _match(unit, t)), lambda h: h["dice"] >= threshold))

    def slid(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(t["grams"], F.element_at(F.col(grams), p)))
        found = F.transform(starts, lambda p: _match(F.array_distinct(F.slice(F.col(grams), p, t["words"] - 1)), t))
        return _first(F.filter(found, lambda h: h["dice"] >= threshold))

    df = df.withColumn(hits, F.when(some, F.array_compact(F.transform(F.col(units), best))).otherwise(none))
    df = df.withColumn(windows, F.when(some, F.array_compact(F.transform(F.col(alive), slid))).otherwise(none)).drop(plain, grams, alive, units)
    df = df.withColumn(n, F.size(hits).cast("bigint")).withColumn(hits, _first(F.concat(F.col(hits), F.col(windows)))).drop(windows)
    df = df.withColumns({licence: F.col(hits)["licence"], dice: F.coalesce(F.col(hits)["dice"], F.lit(0.0))})
    return df.select(*(F.col(f"`{c}`") for c in (*docs.columns, licence, dice, n)))


def _match(unit: Column, t: Column) -> Column:
    return F.struct(_dice(unit, t).alias("dice"), t["licence"].alias("licence"))


def _first(found: Column) -> Column:
    """The best of an array of (dice, licence), null of an empty one; of equal ones the first name."""
    least = F.array_min(F.transform(found, lambda h: F.struct((-h["dice"]).alias("less"), h["licence"].alias("licence"))))
    return F.get(F.transform(F.array_compact(F.array(least)), lambda h: F.struct((-h["less"]).alias("dice"), h["licence"].alias("licence"))), F.lit(0))
