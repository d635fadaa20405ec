"""Licence scans: windows of text against licence notices by Dice coefficient.

A text is normalised as a whole (lower case, runs of anything but letters and
digits, line breaks too, to one blank); windows of its words are turned into
sets of word bigrams and compared with the templates' sets: 2 |A and B| /
(|A| + |B|).  A window can only reach the threshold if it holds a least number
of a template's bigrams, so a text is compared only with the templates of
which it has that many; most texts have none, and most of those lack even the
few words of which every match needs one.

Everything here is Spark column functions; the templates are literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.minhash import let

# Licence notices as they stand in files and on pages.
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved."],
}
# File headers and licence bodies, by their paragraphs.
BODIES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
                     "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
                     "the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
                 "or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions:"],
}
DICE = (8, 10)              # least coefficient, as a fraction


def template_sets(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(licence, sorted bigrams) of each template, by the rule used for lines."""
    out = []
    for name, texts in (templates or TEMPLATES).items():
        for t in texts:
            w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w))))
    return out


def bounds(size: int, num: int, den: int) -> tuple[int, int]:
    """Sizes of a set whose coefficient with one of ``size`` can reach num/den:
    the overlap is at most the smaller size."""
    low = -(-num * size // (2 * den - num))
    high = size * (2 * den - num) // num
    return low, high


def normal_words(line: Column) -> Column:
    """Words of a normalised line (non-ASCII letters count as separators)."""
    return F.split(F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), " ")


def joined_bigrams(words: Column) -> Column:
    """Word bigrams by position, repeated ones too; none of fewer than two words."""
    return let(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(
        " ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>")))


def places_before(items: Column) -> Column:
    """For each item the place (from 1) of the last equal one before it, 0 if there is none."""
    def of(by_item: Column) -> Column:
        pairs = F.transform(by_item, lambda x, j: F.struct(x["i"].alias("i"), F.when(
            (j > 0) & (F.get(by_item, F.greatest(j - 1, F.lit(0)))["x"] == x["x"]), F.get(by_item, F.greatest(j - 1, F.lit(0)))["i"])
            .otherwise(F.lit(0)).alias("last")))
        return F.transform(F.array_sort(pairs), lambda p: p["last"])

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))), of)


def key_words(bigram_set: list[str], need: int) -> set[str]:
    """Words, long ones first, of which every text with ``need`` of the bigrams has one."""
    left, out = set(bigram_set), set()
    for w in sorted({w for b in left for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        out.add(w)
        left = {b for b in left if w not in b.split()}
    return out


def literal(values) -> Column:
    """A constant array of strings, folded when planned."""
    return F.split(F.lit("|".join(values)), "\\|")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, dice: tuple[int, int] = DICE,
         text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Licence notices in the whole text of every document.

    A window starts and ends with a bigram of the template and is at most as
    many times longer than the template as its set may be larger; of those
    with one start the one with the highest coefficient counts (the shortest
    of equal ones).  Time is in proportion to the text.  Windows that share words are one notice: taken from the left, the one with the
    higher coefficient stays (of two templates, the one that shares more
    bigrams with its window).

    Returns the columns of ``keep``, ``n_notices``, ``license`` (of the best
    notice: highest coefficient, then earliest, then licence name; null if
    there is none), ``dice`` (its coefficient, 0 if none) and ``line`` (number
    from 1 of the line where it starts, null if none).  Null and empty texts
    have no notice; equal rows give equal rows; an empty table gives an empty
    result.
    """
    num, den = dice
    if templates is None:
        templates = {n: TEMPLATES.get(n, []) + BODIES.get(n, []) for n in [*TEMPLATES, *BODIES]}
    sets = template_sets(templates)
    lengths = [len(normal.split()) - 1 for ts in templates.values() for t in ts
               for normal in [re.sub("[^a-z0-9]+", " ", t.lower())]]
    keys = sorted(set().union(*(key_words(s, bounds(len(s), num, den)[0]) for _, s in sets)))
    every = literal(sorted({b for _, s in sets for b in s}))
    kind = "array<struct<start:int,end:int,minus:double,less:int,license:string,template:int>>"

    def windows(b: Column, before: Column, k: int, name: str, s: list[str], length: int) -> Column:
        """For each start, the best window of bigrams ``b`` that reaches the threshold with template ``k``.

        The window grows bigram by bigram: one counts if it does not stand in
        the window already, which its place ``before`` tells.
        """
        size = len(s)
        need, _ = bounds(size, num, den)
        most = bounds(max(size, length), num, den)[1]
        own = literal(s)

        def grow(p: Column, start: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                new = F.get(before, i - 1) < start
                ours = F.get(p, i - 1)
                n = acc["n"] + F.when(new, 1).otherwise(0)
                k_ = acc["k"] + F.when(new & ours, 1).otherwise(0)
                hit = F.struct(start.alias("start"), i.alias("end"), (-(2 * k_ / (n + size))).alias("minus"), (-k_).alias("less"),
                               F.lit(name).alias("license"), F.lit(k).alias("template"))
                reach = ours & (2 * den * k_ >= num * (n + size))
                best = acc["best"]
                better = reach & (best.isNull() | (-(2 * k_ / (n + size)) < best["minus"]))
                return F.struct(n.alias("n"), k_.alias("k"), F.when(better, hit).otherwise(best).alias("best"))

            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(None).cast(kind[6:-1]).alias("best"))
            ends = F.sequence(start, F.least(start + (most - 1), F.size(p)))
            return F.aggregate(ends, zero, step, lambda acc: acc["best"])

        def of(p: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: F.get(p, i - 1))
            # a window holds ``need`` different bigrams of the template, so as many places
            last = F.greatest(F.lit(0), F.size(starts) - (need - 1))
            return let(starts, lambda at: F.filter(F.transform(F.slice(at, F.lit(1), last), lambda i: grow(p, i)), lambda w: w.isNotNull()))

        return let(F.transform(b, lambda x: F.array_contains(own, x)), of).cast(kind)

    def better(w: Column, now: Column) -> Column:
        return F.when(w["template"] == now["template"], w["minus"] < now["minus"]).otherwise(
            F.struct(w["less"], w["minus"], w["license"]) < F.struct(now["less"], now["minus"], now["license"]))

    def rank(w: Column) -> Column:
        return F.struct(w["minus"].alias("minus"), w["start"].alias("start"), w["license"].alias("license"))

    def step(acc: Column, w: Column) -> Column:
        now = acc["now"]
        apart = now.isNull() | (w["start"] > now["end"] + 1)      # the last word of ``now`` is end + 1
        return F.struct(
            F.when(apart, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(apart & now.isNotNull(), F.least(acc["best"], rank(now))).otherwise(acc["best"]).alias("best"),
            F.when(apart | better(w, now), w).otherwise(now).alias("now"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("struct<minus:double,start:int,license:string>").alias("best"),
                    F.lit(None).cast(kind[6:-1]).alias("now"))
    done = "struct<n:int,best:struct<minus:double,start:int,license:string>>"
    whole = F.coalesce(F.col(text), F.lit(""))
    maybe = docs.select(*keep, F.when(F.arrays_overlap(normal_words(whole), literal(keys)), F.transform(
        F.split(whole, "\n"), lambda x: F.array_remove(normal_words(x), ""))).alias("_lines"))
    b = maybe.select(*keep, "_lines", F.when(F.col("_lines").isNotNull(), joined_bigrams(F.flatten("_lines"))).alias("_b"))
    hits = b.select(*keep, "_lines", "_b", F.array_intersect("_b", every).alias("_hits"))
    none = F.array().cast(kind)
    # a row of its own, so that the places before are found once for all templates
    hits = hits.select(*keep, "_lines", "_b", "_hits", F.inline(F.array(F.struct(
        F.when(F.size("_hits") > 0, places_before(F.col("_b"))).alias("_before")))))
    tests = [F.when(F.size(F.array_intersect("_hits", literal(s))) >= bounds(len(s), num, den)[0],
                    F.coalesce(windows(F.col("_b"), F.col("_before"), k, name, s, length), none)).otherwise(none)
             for k, ((name, s), length) in enumerate(zip(sets, lengths))]
    found = hits.select(*keep, "_lines", F.when(F.size("_hits") > 0, F.array_sort(F.flatten(F.array(*tests)))).alias("_found"))
    folded = found.select(*keep, "_lines", F.aggregate("_found", zero, step, lambda acc: F.struct(
        acc["n"].alias("n"), F.when(acc["now"].isNotNull(), F.least(acc["best"], rank(acc["now"]))).alias("best"))).cast(done).alias("_r"))
    # the line of word ``start``: the first one up to whose end there are that many words
    ends = F.aggregate("_lines", F.struct(F.lit(0).alias("words"), F.lit(0).alias("line")), lambda acc, x: F.when(
        acc["words"] >= F.col("_r.best.start"), acc).otherwise(F.struct(
            (acc["words"] + F.size(x)).alias("words"), (acc["line"] + 1).alias("line"))), lambda acc: acc["line"])
    return folded.select(*keep, F.coalesce(F.col("_r.n"), F.lit(0)).cast("bigint").alias("n_notices"),
                         F.col("_r.best.license").alias("license"),
                         F.coalesce(-F.col("_r.best.minus"), F.lit(0.0)).alias("dice"),
                         F.when(F.col("_r.best").isNotNull(), ends).cast("bigint").alias("line"))
