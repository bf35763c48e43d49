"""License scans, in DataFrame functions only.

A unit is a line of a document, or its whole text. Units and templates are normalised
(lower case, letters and digits only) and compared by the Dice coefficient of their word
bigrams: 2 * shared / (unit's + template's), a unit's bigrams counted with repeats and a
template's once. For a threshold d a template of b bigrams can only match units of
d / (2 - d) * b to (2 - d) / d * b bigrams, so most units and templates part on size alone.

``notices`` finds templates anywhere in a text instead, wrapped over lines or within one: of all windows of
consecutive words, the one of the highest Dice for each template.

Null and empty texts have no hits. Rows are independent; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and wordings of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(b: int, d: float) -> tuple[int, int]:
    """Least and greatest number of bigrams of a unit that can reach d with a template of b."""
    return math.ceil(d / (2 - d) * b - 1e-9), math.floor((2 - d) / d * b + 1e-9)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: n_hits (units that match some template), and the best match's license and dice;
    ties go to the template listed first."""
    table = [(name, _bigrams(t)) for name, t in templates.items()]
    table = [(k, name, b, *bounds(len(b), threshold)) for k, (name, b) in enumerate(table) if b]
    low, high = min(t[3] for t in table), max(t[4] for t in table)

    def dice(words, n):
        """The best (dice, -order of the template) of a unit of n bigrams; templates out of its bounds cost one comparison."""
        grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
        return F.aggregate(
            F.array(*[F.struct(F.lit(-k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, b)).alias("b")) for k, _, b, lo, hi in table]),
            F.struct(F.lit(0.0).alias("d"), F.lit(-9999).alias("k")),
            lambda best, t: F.when(n.between(t["lo"], t["hi"]), F.greatest(best, F.struct((2.0 * F.size(F.array_intersect(grams, t["b"])) / (n + F.size(t["b"]))).alias("d"), t["k"].alias("k")))).otherwise(best),
        )

    normal = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    units = F.concat(F.split(F.col("_t"), "\n"), F.when(F.instr(F.col("_t"), "\n") > 0, F.array(F.translate(F.col("_t"), "\n", " "))).otherwise(F.array().cast("array<string>")))
    words = F.transform(units, lambda u: F.filter(F.split(u, " +"), lambda w: w != ""))
    words = F.filter(words, lambda w: (F.size(w) - 1).between(low, high))
    best = F.filter(F.transform(words, lambda w: dice(w, F.size(w) - 1)), lambda s: s["d"] >= threshold)
    top = F.array_max(F.col("_hits"))
    names = F.array(*[F.lit(name) for name in templates])
    return (
        docs.select("doc_id", normal.alias("_t"))
        .select("doc_id", best.alias("_hits"))
        .select("doc_id", F.size("_hits").cast("long").alias("n_hits"), F.when(F.size("_hits") > 0, F.element_at(names, 1 - top["k"])).alias("license"), F.round(top["d"], 6).alias("dice"))
    )


def notices(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document and template that some window of consecutive words matches: doc_id, license, the best window's
    first_word and last_word (from 1) and dice; ties go to the window that begins, then ends, first.

    A bigram at either end that is none of the template's only lowers a window's Dice, so windows from one
    of the template's bigrams to another are all that is needed, and size bounds cut these short. Documents
    without a match have no row, repeated rows have theirs each, long texts are read whole."""
    table = [(name, b, *bounds(len(b), threshold)) for name, b in ((name, _bigrams(t)) for name, t in templates.items()) if b]
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    every = sorted({g for _, b, _, _ in table for g in b})

    def let(value, f):
        """f(value), computed once: bound by a lambda, as a column's expression may be put in for its name."""
        return F.transform(F.array(value), f)[0]

    def pairs(w):
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)).alias("g")))
        return F.filter(whole, lambda x: x["g"].isin(every))

    def window(near, x, b, low):
        """The best window from the bigram x over those of the template that are near behind it, x the first of them."""

        def longer(best, y):
            seen = F.array_union(best["seen"], F.array(y["g"]))
            d = 2.0 * F.size(seen) / (y["at"] - x["at"] + 1 + len(b))
            return F.struct(F.greatest(best["d"], d).alias("d"), F.when(d > best["d"], y["at"] + 1).otherwise(best["last"]).alias("last"), seen.alias("seen"))

        none = F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("seen"))
        tried = F.when(2 * F.size(near) >= threshold * (low + len(b)) - 1e-9, F.aggregate(near, none, longer)).otherwise(none)
        return let(tried, lambda t: F.struct(t["d"].alias("d"), (-x["at"]).alias("first"), t["last"].alias("last")))

    def best_of(some, name, b, low, high):
        def best(own):
            return F.array_max(F.transform(own, lambda x, i: let(F.filter(F.slice(own, i + 1, high), lambda y: y["at"] < x["at"] + high), lambda near: window(near, x, b, low))))

        return F.struct(F.lit(name).alias("license"), let(F.filter(some, lambda x: x["g"].isin(b)), best).alias("w"))

    best = let(let(words, pairs), lambda some: F.filter(F.array(*[best_of(some, *t) for t in table]), lambda f: f["w"]["d"] >= threshold))
    found = docs.select("doc_id", F.explode_outer(best).alias("f")).filter("f is not null")
    return found.select("doc_id", "f.license", (-F.col("f.w.first")).alias("first_word"), F.col("f.w.last").alias("last_word"), F.round("f.w.d", 6).alias("dice"))


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by brute force: every unit against every template, without bounds."""
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(g) for g in _bigrams(t))}])" for k, (name, t) in enumerate(templates.items()))
    return rf"""
WITH t(k, name, b) AS (VALUES {rows}),
n AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS x FROM documents),
u AS (SELECT r, unnest(string_split(x, chr(10)) || CASE WHEN contains(x, chr(10)) THEN [replace(x, chr(10), ' ')] ELSE [] END) AS u FROM n),
w AS (SELECT row_number() OVER () AS q, r, list_filter(string_split(u, ' '), lambda z: z <> '') AS w FROM u),
g AS (SELECT q, r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w WHERE len(w) BETWEEN 2 AND 400),
d AS (SELECT q, r, k, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS d FROM g, t),
h AS (SELECT q, r, k, name, d, row_number() OVER (PARTITION BY q ORDER BY d DESC, k) AS best FROM d WHERE d >= {threshold}),
p AS (SELECT r, count(*) AS n_hits, arg_max(name, d - k * 1e-9) AS license, max(d) AS dice FROM h WHERE best = 1 GROUP BY r)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, license, round(dice, 6) AS dice FROM n LEFT JOIN p USING (r)
"""
