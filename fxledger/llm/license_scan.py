"""Licence notices by Dice coefficient over word bigrams, in DataFrame functions only.

A text is cut into units: its lines, its paragraphs and the whole text.  A
unit and a template are normalised (A-Z lower-cased, anything that is neither
a letter nor a digit becomes one space) and compared as sets of word bigrams;
they match when Dice = 2 |A and B| / (|A| + |B|) reaches the threshold.

Two exact prunings come first.  From the threshold follows the least share of
a template's bigrams that a match contains, so a few of its words can be
chosen such that no match lacks all of them: a unit without any is skipped
before it is normalised.  And |A| bounds the sizes of the templates it can
match, so the others are not intersected.  Everything is one projection over
the scan, without a shuffle.

Null and empty texts have no units.  Units of fewer than two words have no
bigrams and match nothing.  A repeated unit counts once.  Of equally good
templates the first by id is named.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Licence notices in common use, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU Affero General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
                         "not use this file except in compliance with the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 "
                      "International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related "
               "or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it "
                      "under the terms of the GNU General Public License as published by the Free "
                      "Software Foundation, either version 3 of the License, or (at your option) "
                      "any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
           "or without fee is hereby granted, provided that the above copyright notice and this "
           "permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                "this software and associated documentation files (the \"Software\"), to deal in "
                "the Software without restriction, including without limitation the rights to use, "
                "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                "Software, and to permit persons to whom the Software is furnished to do so, "
                "subject to the following conditions",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A match needs PERCENT / 100 or more.
PERCENT = 80

#: Everyday words are the last to be chosen as keywords.
EVERYDAY = {"and", "by", "for", "in", "is", "of", "or", "the", "this", "to", "under", "with", "you"}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: str) -> list[str]:
    """The words of a template (ASCII, as all templates are)."""
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = normalise(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def keywords(templates: dict[str, str], percent: int = PERCENT) -> list[str]:
    """Words such that any unit that matches a template contains at least one.

    A match with a template of b bigrams shares at least t b / (2 - t) of them.
    Words are taken, longest first, until fewer bigrams than that hold none.
    """
    chosen: set[str] = set()
    for text in templates.values():
        grams = bigrams(text)
        for word in sorted(set(normalise(text)), key=lambda w: (w in EVERYDAY, -len(w), w)):
            without = [g for g in grams if not chosen & set(g.split())]
            if len(without) * (200 - percent) < percent * len(grams):
                break
            chosen.add(word)
    return sorted(chosen)


def _bigrams(unit: Column) -> Column:
    lowered = F.translate(unit, _A, _Z)
    words = F.split(F.trim(F.regexp_replace(lowered, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")), " ")
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                                    F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                    lambda a, b: F.concat(a, F.lit(" "), b))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None,
         percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, ``matches`` (array of structs dice,
    license, unit; best first) and ``text`` statistics left to the caller.
    Columns of ``docs`` other than doc_id and text are not touched."""
    templates = TEMPLATES if templates is None else templates
    known = [(k, bigrams(v)) for k, v in sorted(templates.items()) if bigrams(v)]
    if not known:
        raise ValueError("no template of two words or more")
    any_word = "(?i)" + "|".join(keywords(templates, percent))
    tpl = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(len(g)).alias("n"),
                             F.array(*[F.lit(x) for x in g]).alias("g")) for k, g in known])
    text = F.coalesce(F.col("text"), F.lit(""))
    longest = max(len(g) for _, g in known)
    room = longest * (200 - percent) // percent

    units = F.when(text.rlike(any_word), F.array_distinct(F.concat(
        F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))).otherwise(
        F.array().cast("array<string>"))
    # a unit of b distinct bigrams has at least b + 1 words; long ones may repeat theirs
    units = F.filter(units, lambda u: u.rlike(any_word))
    sized = F.transform(units, lambda u: F.struct(u.alias("unit"), _bigrams(u).alias("g")))
    sized = F.filter(sized, lambda s: F.size(s["g"]).between(1, room))

    def compared(s: Column) -> Column:
        n = F.size(s["g"])
        fits = F.filter(tpl, lambda t: (2 * 100 * F.least(n, t["n"]) >= percent * (n + t["n"])))
        both = F.transform(fits, lambda t: F.struct(
            F.size(F.array_intersect(s["g"], t["g"])).alias("both"), (n + t["n"]).alias("sum"),
            t["id"].alias("id")))
        hit = F.filter(both, lambda x: 200 * x["both"] >= percent * x["sum"])
        return F.transform(hit, lambda x: F.struct(
            (F.lit(2.0) * x["both"] / x["sum"]).alias("dice"), x["id"].alias("license"),
            s["unit"].alias("unit")))

    hits = F.flatten(F.transform(sized, compared))
    best = F.array_sort(hits, lambda x, y: F.when(x["dice"] > y["dice"], -1)
                        .when(x["dice"] < y["dice"], 1)
                        .when(x["license"] < y["license"], -1)
                        .when(x["license"] > y["license"], 1)
                        .when(x["unit"] < y["unit"], -1)
                        .when(x["unit"] > y["unit"], 1).otherwise(0))
    return docs.select("doc_id", best.alias("matches"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the best template and its Dice, the number of matching (unit,
    template) pairs, and all matched templates, sorted and comma-joined."""
    first = F.try_element_at(F.col("matches"), F.lit(1))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", first["license"].alias("license"), first["dice"].alias("dice"),
                        F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(ids, ",").alias("licenses"))
