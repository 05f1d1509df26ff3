"""License scans: Dice coefficient over word bigrams against licence templates.

Native: DataFrame functions only. A text is read as units (its lines and its blank-line
separated paragraphs) and as windows of words across all of them; units are normalised to lower-case words. The Dice coefficient
of two bigram sets of sizes a and b is at most 2*min(a,b)/(a+b), so a unit meets only templates
whose size lies within the bounds that the threshold allows; units outside every bound are
dropped, as are those without any of the words that every match needs to contain.

Windows find the notices that are only a part of their unit, or spread over comment lines. A
window of best coefficient begins and ends with a bigram of its template, so only such windows
of the allowed sizes are compared. They are taken best first, without overlap within a licence;
the matching units of a licence stand for as many of its windows, the others are matches of their own.

Defined edge cases
- null or empty text: no match, n_matches 0, null license_id and dice.
- units with fewer than two words have no bigrams and match nothing.
- ties in the coefficient: the alphabetically first licence.
- repeated rows are repeated in the result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices in common use, by SPDX identifier (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
THRESHOLD = 0.8
_BLANKS = "\t\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_words(text: Column) -> Column:
    """Lower-cased ASCII-punctuation-free words of a unit."""
    return F.filter(F.split(normal_text(text), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    return F.array_distinct(neighbours(words))


def neighbours(words: Column) -> Column:
    """All pairs of neighbouring words in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _sizes(threshold: float) -> tuple[float, float]:
    """Bounds of the ratio between two set sizes whose coefficient can reach the threshold."""
    return threshold / (2 - threshold), (2 - threshold) / threshold


def template_grams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Licence and sorted distinct bigrams of each template."""
    blank = str.maketrans(dict.fromkeys(_BLANKS + "\n", " "))
    out = []
    for name, text in templates:
        w = text.translate(blank).lower().split()
        out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


#: Function words, the last choice for a needed word (fixed values).
FUNCTION_WORDS = frozenset("a above all an and any are as at be been by can for from has have if in is it its may must no not of on or other out such that the their these this to under use was where which will with without you".split())


def needed_words(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold for some template contains one.

    A match of a template of t bigrams shares at least threshold * (t + t * low) / 2 of them. So
    if more than the others contain a chosen word, a matching unit must contain a chosen word.
    Long words come first and function words last, so that the chosen words are rare.
    """
    low, _ = _sizes(threshold)
    known = template_grams(templates)
    chosen: set[str] = set()
    for _, grams in known:
        t = len(grams)
        most_missing = t - math.ceil(threshold * (t + math.ceil(t * low - 1e-9)) / 2 - 1e-9)
        for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in FUNCTION_WORDS, w.isdigit(), -len(w), w)):
            if sum(not chosen.isdisjoint(g.split()) for g in grams) > most_missing:
                break
            chosen.add(w)
    return sorted(chosen)


def normal_text(text: Column) -> Column:
    """Lower-cased text with blanks for ASCII punctuation and line ends, and a blank at both ends."""
    return F.concat(F.lit(" "), F.lower(F.translate(text, _BLANKS + "\n", " " * (len(_BLANKS) + 1))), F.lit(" "))


def _contains(normal: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(normal, F.lit(f" {w} ")) for w in words))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def windows(text: Column, table: Column, threshold: float = THRESHOLD) -> Column:
    """Array of (license_id, dice): windows of the whole text that reach the threshold, best first, disjoint within a licence."""
    low, high = _sizes(threshold)

    def of_template(t: Column, grams: Column) -> Column:
        least = F.ceil(t["size"] * low - 1e-9).cast("int")  # of bigrams in a window, and of those that it shares
        most = F.floor(t["size"] * high + 1e-9).cast("int")

        def from_start(p: Column, at: Column) -> Column:
            ends = F.filter(at, lambda q: (q >= p) & (q < p + most))
            return F.when(F.size(ends) >= least, F.transform(ends, lambda q: scored(p, q))).otherwise(F.array().cast(kind))

        def scored(p: Column, q: Column) -> Column:
            part = F.slice(grams, p, q - p + 1)
            dice = F.lit(2.0) * F.size(F.array_intersect(t["grams"], part)) / (F.size(F.array_distinct(part)) + t["size"])
            return F.struct((-dice).alias("d"), (p - q).alias("l"), p.alias("p"), q.alias("q"), t["license_id"].alias("license_id"))

        at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull())
        enough = F.size(F.array_intersect(t["grams"], grams)) >= least
        good = _let(at, lambda a: F.filter(F.flatten(F.transform(a, lambda p: from_start(p, a))), lambda w: w["d"] <= -threshold))
        return F.when(enough, good).otherwise(F.array().cast(kind))

    kind = "array<struct<d:double,l:int,p:int,q:int,license_id:string>>"
    every = _let(neighbours(normal_words(text)), lambda grams: F.flatten(F.transform(table, lambda t: of_template(t, grams))))
    free = lambda kept, w: ~F.exists(kept, lambda k: (k["license_id"] == w["license_id"]) & (k["p"] <= w["q"] + 1) & (w["p"] <= k["q"] + 1))
    best = F.aggregate(F.array_sort(every), F.array().cast(kind), lambda kept, w: F.when(free(kept, w), F.concat(kept, F.array(w))).otherwise(kept))
    return F.transform(best, lambda w: F.struct(w["license_id"].alias("license_id"), (-w["d"]).alias("dice")))


def _with_others(units: Column, found: Column) -> Column:
    """Matches of units, and the windows of each licence beyond as many as its units."""
    same = lambda x, w: F.size(F.filter(x, lambda o: o["license_id"] == w["license_id"]))
    return F.concat(units, F.filter(found, lambda w, i: same(F.slice(found, 1, i), w) >= same(units, w)))


def matches(text: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> Column:
    """Array of (license_id, dice), one for each unit and licence that reaches the threshold."""
    low, high = _sizes(threshold)
    known = template_grams(templates)
    every = F.lit(sorted({g for _, grams in known for g in grams}))
    table = F.array(*(F.struct(F.lit(name).alias("license_id"), F.lit(len(grams)).alias("size"), F.lit(grams).alias("grams")) for name, grams in known))
    smallest, largest = min(len(g) for _, g in known) * low, max(len(g) for _, g in known) * high
    nothing = F.array().cast("array<string>")
    needed = needed_words(templates, threshold)
    # Paragraphs of one line are lines already.
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.concat(F.split(text, "\n"), F.when(F.contains(text, F.lit("\n")), paragraphs).otherwise(nothing))
    # n bigrams need at least n + 1 words of a character each and the blanks between them.
    units = F.filter(units, lambda u: (F.length(u) >= 2 * smallest + 1) & _contains(normal_text(u), needed))
    grams = F.filter(F.transform(F.transform(units, normal_words), bigrams), lambda g: (F.size(g) >= smallest) & (F.size(g) <= largest) & F.arrays_overlap(g, every))

    def score(g: Column) -> Column:
        fits = F.filter(table, lambda t: (t["size"] >= F.size(g) * low) & (t["size"] <= F.size(g) * high))
        scored = F.transform(fits, lambda t: F.struct(t["license_id"].alias("license_id"), (F.lit(2.0) * F.size(F.array_intersect(t["grams"], g)) / (F.size(g) + t["size"])).alias("dice")))
        kept = F.filter(scored, lambda m: m["dice"] >= threshold)
        # One entry for each licence: its best template.
        return F.filter(kept, lambda m: ~F.exists(kept, lambda o: (o["license_id"] == m["license_id"]) & (o["dice"] > m["dice"])))

    by_units = F.flatten(F.transform(grams, lambda g: F.array_distinct(score(g))))
    both = _let(by_units, lambda u: _let(windows(text, table, threshold), lambda w: _with_others(u, w)))
    # Texts without any needed word never reach the array functions, and most not even normalisation.
    plain = functools.reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in needed))
    return F.when(plain, F.when(_contains(normal_text(text), needed), both))


def summarise(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """One row per document: n_matches (pairs of unit and licence, and further windows), license_ids (sorted, comma-joined), license_id and dice of the best match.

    A narrow projection: no join, no shuffle.
    """
    found = docs.select(F.col(id_col), F.coalesce(matches(F.col("text"), threshold, templates), F.array().cast("array<struct<license_id:string,dice:double>>")).alias("m"))
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["dice"]).alias("d"), x["license_id"].alias("license_id"))))
    return found.select(id_col, "m", best.alias("best")).select(
        id_col,
        F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license_id"]))), ",").alias("license_ids"),
        F.col("best.license_id").alias("license_id"),
        (-F.col("best.d")).alias("dice"),
    )
