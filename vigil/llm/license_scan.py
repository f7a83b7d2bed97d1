"""Licence scan: Dice coefficient over word bigrams against licence templates.

Native: only DataFrame functions. Every line of a text, and the text as a whole,
is normalised (lower case, runs of anything but letters and digits to one space).
Its set of word bigrams is compared with the sets of the templates. A Dice
coefficient of at least t needs sizes within t/(2-t) and (2-t)/t of each other,
so a unit is compared only with templates inside those bounds; units outside all
bounds never have their bigrams built. A one-word unit has no bigrams and matches
nothing.

A notice may be wrapped over several lines of a longer text, or stand in a line with
other prose. So the words of a text are also searched for windows of up to (2-t)/t times
a template's bigrams, whatever the lines. The best window for a template starts and ends
with one of its bigrams, and holds at least t/(2-t) of them: only texts with that many
are searched, and only windows between two such places are scored. Of overlapping windows
of one template the one with the highest coefficient stays, of several templates the one
that shares the most bigrams. A window is left out where the whole text, or a line that
it touches, matches the same template.

Defined cases: null and empty texts have no match (no row); repeated rows give
repeated results; ties go to the first template by name; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short public licence notices and headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def word_pairs(words: Column) -> Column:
    """Word bigrams, in order, of an array of at least two words."""
    n = F.size(words) - F.lit(1)
    return F.zip_with(
        F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def bigrams(words: Column) -> Column:
    """Distinct word bigrams of an array of at least two words."""
    return F.array_distinct(word_pairs(words))


def _once(value: Column) -> Column:
    """The value as a column of a generator: filters on it stay above it, so it is computed once
    per row and not again in every filter and comparison that Spark would move it into."""
    return F.explode(F.array(value))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _record(**values: Column) -> Column:
    """A struct whose names hold in nested lambdas, too."""
    return F.named_struct(*[x for name, v in values.items() for x in (F.lit(name), v)])


def _best(grams: Column, sets: dict[str, list[str]], threshold: float) -> Column:
    """dice, rank and license of the best template for a set of bigrams; null if none is near in size."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    n = F.size(grams)
    scored = [
        F.when(
            (n >= F.lit(low * len(g))) & (n <= F.lit(high * len(g))),
            _record(
                dice=F.lit(2.0) * F.size(F.array_intersect(grams, _strings(g))) / (n + F.lit(len(g))),
                rank=F.lit(-rank),
                license=F.lit(name),
            ),
        )
        for rank, (name, g) in enumerate(sets.items())
    ]
    return F.array_max(F.array(*scored))


def _units(text: Column) -> Column:
    """Every line, and the text as a whole (unit 0)."""
    lines = F.split(text, "\n")
    # a one-line text is its own line 1, so the whole is not looked at twice
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("unit"), text.alias("raw"))))
    by_line = F.transform(lines, lambda line, i: F.struct((i + F.lit(1)).alias("unit"), line.alias("raw")))
    return F.concat(by_line, F.coalesce(whole, F.array()))


def _apart(windows: Column) -> Column:
    """Windows that do not overlap, the greatest first."""
    return F.aggregate(
        F.reverse(F.array_sort(windows)),
        F.slice(windows, 1, 0),
        lambda kept, w: F.when(
            F.exists(kept, lambda k: (k["start"] <= w["end"]) & (w["start"] <= k["end"])), kept
        ).otherwise(F.concat(kept, F.array(w))),
    )


def _template_windows(template: Column) -> Column:
    """Windows of the columns grams and hits that match the template, none overlapping."""
    wanted, need, most = template["grams"], template["need"], template["most"]

    def score(first: Column, last: Column) -> Column:
        held = F.slice("grams", first["at"] + F.lit(1), last["at"] - first["at"] + F.lit(1))
        shared = F.size(F.array_intersect(held, wanted))
        return _record(
            dice=F.lit(2.0) * shared / (F.size(F.array_distinct(held)) + F.size(wanted)),
            shared=shared,
            shortness=first["at"] - last["at"],
            start=first["at"],
            end=last["at"],
        )

    def from_hits(hits: Column) -> Column:
        def widest(first: Column, k: Column) -> Column:
            ends = F.slice(hits, k + need, most)
            near = F.filter(ends, lambda last: last["at"] - first["at"] < most)
            return F.array_max(F.transform(near, lambda last: score(first, last)))

        return F.transform(hits, widest)

    own = F.filter("hits", lambda h: F.array_contains(wanted, h["gram"]))
    # through an array of one, so that the hits are found once and not again for each start
    scored = F.flatten(F.transform(F.array(own), from_hits))
    matching = F.filter(scored, lambda w: w["dice"] >= template["least"])
    return F.flatten(F.transform(F.array(matching), _apart))


def _window_matches(docs: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """doc_id, unit (line in which the window begins), license, dice of notices that are no unit."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    need = {name: max(1, ceil(low * len(g) - 1e-9)) for name, g in sets.items()}
    every = _strings(sorted(set().union(*sets.values())))
    templates = F.array(
        *[
            _record(
                rank=F.lit(-rank),
                license=F.lit(name),
                grams=_strings(g),
                need=F.lit(need[name]),
                most=F.lit(int(high * len(g) + 1e-9)),
                least=F.lit(threshold),
            )
            for rank, (name, g) in enumerate(sets.items())
        ]
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    enough = [F.size(F.array_intersect("seen", _strings(g))) >= F.lit(need[name]) for name, g in sets.items()]
    rows = (
        docs.select("doc_id", text.alias("raw"))
        .where(F.length("raw") >= F.lit(2 * min(need.values())))
        .select("doc_id", "raw", _once(F.split(normalise(F.col("raw")), " ")).alias("words"))
        .where(F.size("words") > 1)
        .select("doc_id", "raw", _once(F.array_intersect(word_pairs(F.col("words")), every)).alias("seen"))
        .where(reduce(or_, enough))
    )
    words = F.transform(F.split("raw", "\n"), lambda line: F.split(normalise(line), " "))
    placed = F.transform(
        words,
        lambda ws, i: F.transform(
            F.filter(ws, lambda w: w != F.lit("")), lambda w: _record(word=w, line=i + F.lit(1))
        ),
    )
    unit_grams = F.transform(
        F.transform(_units(F.col("raw")), lambda u: u.withField("words", F.split(normalise(u["raw"]), " "))),
        lambda u: u.withField("grams", F.when(F.size(u["words"]) > 1, bigrams(u["words"]))),
    )
    told = F.transform(
        F.filter(unit_grams, lambda u: u["grams"].isNotNull()),
        lambda u: _record(unit=u["unit"], best=_best(u["grams"], sets, threshold)),
    )
    rows = (
        rows.select("doc_id", "raw", _once(F.flatten(placed)).alias("placed"))
        .where(F.size("placed") > 1)
        .select("doc_id", "raw", F.col("placed.line").alias("line"), _once(word_pairs(F.col("placed.word"))).alias("grams"))
    )
    hits = F.filter(
        F.transform("grams", lambda g, i: _record(at=i, gram=g)),
        lambda h: F.array_contains(every, h["gram"]),
    )
    found = F.transform(
        templates,
        lambda t: F.transform(
            _template_windows(t),
            lambda w: _record(
                shared=w["shared"], dice=w["dice"], rank=t["rank"], earliness=-w["start"],
                start=w["start"], end=w["end"], license=t["license"],
            ),
        ),
    )
    return (
        rows.select("doc_id", "raw", "line", "grams", _once(hits).alias("hits"))
        .select("doc_id", "raw", "line", _once(F.flatten(found)).alias("windows"))
        .where(F.size("windows") > 0)
        .select(
            "doc_id", "line",
            _once(F.filter(told, lambda u: u["best"]["dice"] >= F.lit(threshold))).alias("told"),
            F.explode(_apart(F.col("windows"))).alias("w"),
        )
        .select(
            "doc_id", "told", "w.license", "w.dice",
            F.get("line", F.col("w.start")).alias("unit"),
            F.get("line", F.col("w.end") + F.lit(1)).alias("until"),
        )
        .where(
            ~F.exists(
                "told",
                lambda u: (u["best"]["license"] == F.col("license"))
                & ((u["unit"] == F.lit(0)) | u["unit"].between(F.col("unit"), F.col("until"))),
            )
        )
        .select("doc_id", "unit", "license", "dice")
    )


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8
) -> DataFrame:
    """doc_id, unit, license, dice of every unit that matches a template (unit 0: whole text,
    k: line k) and of every other notice (unit k: it begins in line k)."""
    sets = {name: template_bigrams(t) for name, t in sorted((templates or TEMPLATES).items())}
    sets = {name: grams for name, grams in sets.items() if grams}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = docs.select("doc_id", F.explode(_units(text)).alias("u")).select("doc_id", "u.unit", "u.raw")
    # n words have at most n - 1 distinct bigrams; a word and the break after it take two characters at least
    fewest = min(low * len(g) for g in sets.values())
    largest = max(high * len(g) for g in sets.values())
    # bigrams of some of the words bound those of all from below: a long unit that has
    # too many in its opening words is outside all bounds
    opening = F.slice("words", 1, 2 * int(largest) + 2)
    units = (
        units.where(F.length("raw") >= F.lit(2 * fewest))
        .select("doc_id", "unit", _once(F.split(normalise(F.col("raw")), " ")).alias("words"))
        .where((F.size("words") > 1) & (F.size("words") - 1 >= F.lit(fewest)))
        .where((F.size("words") <= F.size(opening)) | (F.size(bigrams(opening)) <= F.lit(largest)))
        .select("doc_id", "unit", _once(bigrams(F.col("words"))).alias("grams"))
    )
    matched = (
        units.where(F.size("grams") <= F.lit(largest))
        .select("doc_id", "unit", _once(_best(F.col("grams"), sets, threshold)).alias("best"))
        .where(F.col("best.dice") >= F.lit(threshold))
        .select("doc_id", "unit", "best.license", "best.dice")
    )
    return matched.unionByName(_window_matches(docs, sets, threshold))
