"""Licence scans: normalised parts of a text against licence templates, by Dice coefficient over the sets of their word
bigrams. DataFrame functions only, and no shuffle: the templates are fixed and travel in the plan.

Normalising lower-cases and leaves letters and digits, other runs becoming one blank. Two kinds of parts are compared:

Units are lines, sentences of lines, paragraphs, the whole text, and the paragraphs with a telling word, joined: so a
licence of many paragraphs is found within a longer text. Dice is 2 * common / (bigrams of unit + bigrams of template);
with a threshold t it needs a unit of at least t / (2 - t) and at most (2 - t) / t times the template's bigrams, which
prunes templates before any intersection. Of the templates that a unit matches the closest counts, and a notice's numbers
(versions) must be there.

Windows find notices within other prose: of each notice (all templates but the whole texts of licences) as many words as
it has, placed where one of its anchors stands in the text as in the notice. Anchors are so chosen that no window without
any of them reaches t. A window, too, must hold the notice's numbers. Of windows that overlap by more than half of the shorter
one, the one with the most common bigrams counts, then that of the greater coefficient.

A text without any telling word is not looked at. That loses nothing: each template has words that cover so many of its
bigrams that a part without any of them has too few left.

Defined cases: a null or empty text has no part and no licence; a part of fewer than two words has no bigram and matches
nothing; an empty table gives an empty one; a template found several times counts once, with its best coefficient; a
doc's licences are in order of their names; columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, text_of

DICE = 0.8
#: Paragraphs with one of these, joined, are one more unit.
LEGAL_WORDS = ("license", "copyright", "covered", "distribut", "warrant", "work")

# Names and usual wordings of licences and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_WARRANTY = "IN NO EVENT SHALL THE {0} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _WARRANTY.format("COPYRIGHT HOLDER OR CONTRIBUTORS")
# Whole short licences: their conditions above and what follows them.
TEMPLATES |= {
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-2-Clause']} {_DISCLAIMER}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-3-Clause']} {_DISCLAIMER}",
    "BSD-disclaimer": _DISCLAIMER,
    "ISC-text": f"{TEMPLATES['ISC']} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-whole": f"{TEMPLATES['MIT-text']} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
TEMPLATES |= {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
# Short forms by licence; a template's name is what stands before the sign #.
SHORT = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["MIT License", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
}
TEMPLATES |= {f"{name}#{i}": t for name, forms in SHORT.items() for i, t in enumerate(forms)}
#: Whole texts of licences: they stand as paragraphs of their own and get no windows.
WHOLE = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files("corpusloom.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
TEMPLATES |= WHOLE
# Words too common to tell a notice from other prose, English ones and the German "mit".
COMMON = frozenset(
    "a about after all also an and any are as at be because been before being between both but by can could do does each every file for form from had has have he her here his how i if in into is it its just like "
    "made make many may me mit more most much must my no not of on one only or other our out over own same shall she should since so software some such than that the their them then there these they this those to "
    "under until up use used very was we were what when where which while who will with without work would yes you your".split()
)

OTHER = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[\x20\t\r]*\n"


#: The end of a sentence within a line.
STOP = r"([.!?])[ \t]+"


@cache
def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def numbers_of(name: str, text: str) -> list[str]:
    """Words with a digit, which tell versions apart; not those that number clauses, and none for whole texts."""
    return [] if name in WHOLE else sorted({w for w in template_words(re.sub(r"\b[0-9]+\. (?=[A-Z])", "", text)) if re.search("[0-9]", w)})


@cache
def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, in order."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)))


def least_common(n: int, dice: float) -> int:
    """Bigrams that a unit must share with a template of n."""
    return math.ceil(dice * n / (2 - dice) - 1e-9)


def covering_words(bigrams: list[str], least: int) -> list[str]:
    """Words so chosen that fewer than `least` bigrams have none of them; rare ones first."""
    left, chosen = list(bigrams), []
    while len(left) >= least:
        count: dict[str, int] = {}
        for b in left:
            for w in set(b.split(" ")):
                count[w] = count.get(w, 0) + 1
        word = max(sorted(count), key=lambda w: (w not in COMMON and len(w) > 2, w not in COMMON, count[w] + len(w) / 100))
        chosen.append(word)
        left = [b for b in left if word not in b.split(" ")]
    return chosen


def telling_words(bigrams: list[str], dice: float) -> set[str]:
    return set(covering_words(bigrams, least_common(len(bigrams), dice)))


def anchors(text: str, dice: float) -> list[tuple[str, int]]:
    """Words of a notice with their places in it: a window of its length that reaches `dice` holds one of them.

    A window has at most as many bigrams b as the notice's n words less one; with 2 * common / (b + n') at `dice` and
    common at most b, common is dice * n' / (2 - dice) at least, and more where the window's bigrams are all different.
    """
    words, pairs = template_words(text), template_bigrams(text)
    chosen = covering_words(pairs, least_common(len(pairs), dice))
    return [(w, i) for i, w in enumerate(words) if w in chosen]


def _clues(templates: dict[str, str] = TEMPLATES, dice: float = DICE) -> list[str]:
    """The telling words of all templates."""
    return sorted(set().union(*(telling_words(template_bigrams(t), dice) for t in templates.values())))


def pairs_of(words: Column) -> Column:
    """Array of the distinct bigrams of an array of words."""
    return F.when(F.size(words) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(words, i), F.try_element_at(words, i + 1))))).otherwise(F.array().cast("array<string>"))


def words_of(part: Column) -> Column:
    """Array of the words of a text in lower case."""
    return F.split(F.trim(F.regexp_replace(part, OTHER, " ")), " ", -1)


def bigrams(unit: Column) -> Column:
    return let(words_of(unit), pairs_of)


FOUND = "array<struct<name:string,dice:double>>"


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, text: str = "text") -> DataFrame:
    """docs with n_licences, licences (name:coefficient in ten-thousandths, comma-joined), best_licence and best_dice."""
    docs = docs.drop("n_licences", "licences", "best_licence", "best_dice", "_hits")
    templates = dict(sorted((templates or TEMPLATES).items()))
    known = {name: template_bigrams(t) for name, t in templates.items()}
    low = min(math.ceil(len(b) * dice / (2 - dice) - 1e-9) for b in known.values())
    high = max(math.floor(len(b) * (2 - dice) / dice + 1e-9) for b in known.values())
    clues = _clues(templates, dice)

    def holds(words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(clues))

    def shared(xs: list[str]) -> Column:
        return F.split(F.lit("\n".join(xs)), "\n", -1)  # folded to one literal

    def numbered(name: str) -> Column:
        return F.array(*[F.lit(w) for w in numbers_of(name, templates[name])]).cast("array<string>").alias("numbers")

    table = F.array(*[F.struct(F.lit(name.split("#")[0]).alias("name"), F.lit(len(b)).alias("size"), shared(b).alias("bigrams"), numbered(name)) for name, b in known.items()])

    def units(t: Column) -> Column:
        """Texts of the units. A line of fewer letters than `low` bigrams need is none."""
        lines = F.concat(F.split(t, "\n", -1), F.split(F.regexp_replace(t, STOP, "$1\n"), "\n", -1))
        short = F.filter(F.array_distinct(lines), lambda u: F.length(u) > 2 * low)

        def of_paragraphs(ps: Column) -> Column:
            legal = F.lit(False)
            joined = lambda keep: F.array_join(F.filter(ps, keep), "\n\n")
            return F.concat(ps, F.array(joined(lambda p: holds(words_of(p))), joined(lambda p: reduce(lambda a, w: a | F.contains(p, F.lit(w)), LEGAL_WORDS, legal))))

        return F.array_distinct(F.concat(short, F.array(t), let(F.split(t, PARAGRAPH, -1), of_paragraphs)))

    def compare(b: Column) -> Column:
        """The closest templates of a unit's bigrams."""
        fits = F.filter(table, lambda k: (F.size(b) >= k["size"] * F.lit(dice / (2 - dice)) - 1e-9) & (F.size(b) <= k["size"] * F.lit((2 - dice) / dice) + 1e-9))
        fits = F.filter(fits, lambda k: F.forall(k["numbers"], lambda n: F.exists(b, lambda x: F.startswith(x, F.concat(n, F.lit(" "))) | F.endswith(x, F.concat(F.lit(" "), n)))))
        scored = F.transform(fits, lambda k: F.struct(k["name"].alias("name"), (F.lit(2.0) * F.size(F.array_intersect(b, k["bigrams"])) / (F.size(b) + k["size"])).alias("dice")))
        return let(F.filter(scored, lambda h: h["dice"] >= dice - 1e-9), lambda hs: F.filter(hs, lambda h: h["dice"] >= F.array_max(F.transform(hs, lambda x: x["dice"])) - 1e-9))

    notices = [(name, t) for name, t in templates.items() if name not in WHOLE]
    forms = F.array(*[F.struct(F.lit(name.split("#")[0]).alias("name"), F.lit(len(template_words(t))).alias("words"), F.lit(len(known[name])).alias("size"), shared(known[name]).alias("bigrams"), numbered(name)) for name, t in notices])
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (_, t) in enumerate(notices):
        for w, at in anchors(t, dice):
            places.setdefault(w, []).append((i + 1, at))
    stands = F.map_from_arrays(F.array(*[F.lit(w) for w in places]), F.array(*[F.array(*[F.struct(F.lit(i).alias("t"), F.lit(at).alias("at")) for i, at in xs]) for xs in places.values()]))

    def windows(w: Column) -> Column:
        """name and dice of the best windows."""
        anchored = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(list(places)))
        starts = F.array_distinct(F.flatten(F.transform(anchored, lambda s: F.transform(F.try_element_at(stands, s["x"]), lambda a: F.struct(a["t"].alias("t"), (s["i"] - a["at"]).alias("start"))))))

        def measured(s: Column) -> Column:
            def by_form(f: Column) -> Column:
                def by_words(own: Column) -> Column:
                    def by_pairs(b: Column) -> Column:
                        common = F.when(F.size(F.array_except(f["numbers"], own)) == 0, F.size(F.array_intersect(b, f["bigrams"]))).otherwise(0)
                        return F.struct(common.alias("common"), (F.lit(2.0) * common / (F.size(b) + f["size"])).alias("dice"), s["start"].alias("start"), (s["start"] + f["words"]).alias("end"), s["t"].alias("t"), f["name"].alias("name"))

                    return let(pairs_of(own), by_pairs)

                return let(F.slice(w, s["start"] + 1, f["words"]), by_words)

            return let(F.element_at(forms, s["t"]), by_form)

        inside = F.filter(starts, lambda s: (s["start"] >= 0) & (s["start"] + F.element_at(forms, s["t"])["words"] <= F.size(w)))
        hits = F.filter(F.transform(inside, measured), lambda h: h["dice"] >= dice - 1e-9)

        def closer(g: Column, h: Column) -> Column:
            over = (F.least(g["end"], h["end"]) - F.greatest(g["start"], h["start"])) * 2 > F.least(g["end"] - g["start"], h["end"] - h["start"])
            key = lambda x: F.struct(x["common"], x["dice"], -x["t"], -x["start"])
            return over & (key(g) > key(h))

        best = let(hits, lambda hs: F.filter(hs, lambda h: ~F.exists(hs, lambda g: closer(g, h))))
        return F.transform(best, lambda h: F.struct(h["name"].alias("name"), h["dice"].alias("dice")))

    low_text = F.lower(text_of(text))
    sets = F.filter(F.transform(units(low_text), bigrams), lambda b: F.size(b).between(low, high))
    none = F.array().cast(FOUND)
    hits = let(words_of(low_text), lambda w: F.when(holds(w), F.concat(F.flatten(F.transform(sets, compare)), windows(w))).otherwise(none))
    # sorted by name and coefficient: the last of a name is its best
    ordered = F.array_sort(F.array_distinct(hits))
    best = let(ordered, lambda o: F.filter(o, lambda h: ~F.exists(o, lambda x: (x["name"] == h["name"]) & (x["dice"] > h["dice"]))))
    top = F.element_at(F.array_sort(F.transform("_hits", lambda h: F.struct((-h["dice"]).alias("d"), h["name"].alias("name")))), 1)
    return (
        docs.withColumn("_hits", best)
        .withColumn("n_licences", F.size("_hits"))
        .withColumn("licences", F.array_join(F.transform("_hits", lambda h: F.concat_ws(":", h["name"], F.floor(h["dice"] * 10000 + 1e-6).cast("string"))), ","))
        .withColumn("best_licence", F.when(F.size("_hits") > 0, top["name"]))
        .withColumn("best_dice", F.when(F.size("_hits") > 0, -top["d"]))
        .drop("_hits")
    )


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_templates() -> str:
    rows = []
    for i, (name, t) in enumerate(sorted((n, t) for n, t in TEMPLATES.items() if n not in WHOLE)):
        rows.append(f"({i + 1}, '{name.split('#')[0]}', {len(template_words(t))}, {_sql_list(template_bigrams(t))}, {_sql_list(numbers_of(name, t))}::VARCHAR[])")
    return ", ".join(rows)


def _sql_anchors() -> str:
    return ", ".join(f"({i + 1}, '{w}', {at})" for i, (_, t) in enumerate(sorted((n, t) for n, t in TEMPLATES.items() if n not in WHOLE)) for w, at in anchors(t, DICE))


_SQL_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
#: The same rows without the text filter, which loses nothing.
OP5_SQL = (
    r"""
WITH templates AS (
  SELECT * FROM (VALUES """
    + ", ".join(f"('{name.split('#')[0]}', {_sql_list(template_bigrams(t))}, {_sql_list(numbers_of(name, t))}::VARCHAR[])" for name, t in sorted(TEMPLATES.items()))
    + r""") v(name, bigrams, numbers)
), forms AS (
  SELECT * FROM (VALUES """
    + _sql_templates()
    + r""") v(t, name, words, bigrams, numbers)
), anchors AS (
  SELECT * FROM (VALUES """
    + _sql_anchors()
    + r""") v(t, word, place)
), lowered AS (
  SELECT doc_id, lower(coalesce(text, '')) AS text, regexp_split_to_array(lower(coalesce(text, '')), '\n[\x20\t\r]*\n') AS p FROM documents
), cleared AS (
  SELECT doc_id, text, p, list_filter(p, lambda x: len(list_intersect(string_split(trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), """
    + _sql_list(_clues())
    + r""")) > 0) AS telling, list_filter(p, lambda x: regexp_matches(x, '"""
    + "|".join(LEGAL_WORDS)
    + r"""')) AS legal FROM lowered
), units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), p, [text, array_to_string(telling, chr(10) || chr(10)), array_to_string(legal, chr(10) || chr(10))])) AS unit FROM cleared
), worded AS (
  SELECT doc_id, string_split(trim(regexp_replace(unit, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM units
), paired AS (
  SELECT doc_id, row_number() OVER () AS u, """
    + _SQL_PAIRS.format("w")
    + r""" AS b FROM worded WHERE len(w) > 1
), scored AS (
  SELECT doc_id, u, name, 2.0::DOUBLE * len(list_intersect(b, t.bigrams)) / (len(b) + len(t.bigrams)) AS dice
  FROM paired JOIN templates t ON len(b) >= len(t.bigrams) * (0.8::DOUBLE / 1.2) - 1e-9 AND len(b) <= len(t.bigrams) * (1.2::DOUBLE / 0.8) + 1e-9
  WHERE len(list_filter(t.numbers, lambda n: len(list_filter(b, lambda x: starts_with(x, n || ' ') OR suffix(x, ' ' || n))) > 0)) = len(t.numbers)
), closest AS (
  SELECT doc_id, name, dice FROM (SELECT *, max(dice) OVER (PARTITION BY u) AS m FROM scored WHERE dice >= 0.8 - 1e-9) WHERE dice >= m - 1e-9
), texts AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM lowered
), placed AS (
  SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts
), starts AS (
  SELECT DISTINCT r, t, i - place AS start FROM placed JOIN anchors USING (word) WHERE i >= place
), windows AS (
  SELECT doc_id, r, t, name, start, start + words AS stop, bigrams, numbers, w[start + 1 : start + words] AS own FROM starts JOIN texts USING (r) JOIN forms USING (t) WHERE start + words <= len(w)
), measured AS (
  SELECT *, """
    + _SQL_PAIRS.format("own")
    + r""" AS b FROM windows WHERE len(list_intersect(numbers, own)) = len(numbers)
), near AS (
  SELECT doc_id, r, t, name, start, stop, len(list_intersect(b, bigrams)) AS common, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM measured
), hit AS (
  SELECT * FROM near WHERE dice >= 0.8 - 1e-9
), best AS (
  SELECT doc_id, name, dice FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit g WHERE g.r = h.r AND (least(g.stop, h.stop) - greatest(g.start, h.start)) * 2 > least(g.stop - g.start, h.stop - h.start)
      AND (g.common > h.common OR g.common = h.common AND (g.dice > h.dice OR g.dice = h.dice AND (g.t < h.t OR g.t = h.t AND g.start < h.start))))
), named AS (
  SELECT doc_id, name, max(dice) AS dice FROM (SELECT * FROM closest UNION ALL SELECT * FROM best) GROUP BY doc_id, name
), hits AS (
  SELECT doc_id, count(*)::INTEGER AS n_licences, string_agg(name || ':' || floor(dice * 10000 + 1e-6)::BIGINT, ',' ORDER BY name) AS licences,
         arg_min(name, (-dice, name)) AS best_licence, max(dice) AS best_dice
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_licences, 0)::INTEGER AS n_licences, coalesce(licences, '') AS licences, best_licence, best_dice
FROM documents d LEFT JOIN hits USING (doc_id)
"""
)
