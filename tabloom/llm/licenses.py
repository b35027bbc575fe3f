"""Licence recognition by sentence rules.

A text is cut into sentences twice, at sentence marks followed by white space (so that wrapped lines
stay together) and at line ends (so that a notice below an unfinished line is seen). A sentence is
normalised to lower-case letters, digits and single spaces and looked up among the known licence
sentences; the identifiers found, in order, are the text's sequence. Rules are ordered: each asks for
some identifiers one after another, wherever it matches it takes them out of the sequence, and what
is left is offered to the next rule. Only DataFrame functions run here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-name": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License (MIT)", "This project is licensed under the MIT License."),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is-software": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "no-liability-software": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsd-2-name": ("Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "bsd-3-name": ("Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "apache-2-name": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "Apache License, Version 2.0",
        "Apache License, Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/",
    ),
    "apache-2-terms": ("you may not use this file except in compliance with the License.",),
    "apache-2-copy": ("You may obtain a copy of the License at",),
    "gpl-3-name": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "gpl-2-name": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "gpl-grant": ("This program is free software:", "This program is free software;"),
    "gpl-3-or-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2-or-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl-name": ("Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "agpl-name": ("Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "mpl-2-name": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
    ),
    "cc0-name": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."),
    "cc-by-name": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-name": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-name": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd-name": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "reserved": ("All rights reserved.",),
}

# Public licence tags as they stand behind "SPDX-License-Identifier:".
TAGS = (
    "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "Unlicense",
)

#: A sentence that is not known as a whole but holds these words: the clause on endorsement, whoever it names.
PHRASES = {"endorse or promote products": "bsd-names"}


@dataclass(frozen=True)
class Rule:
    """``license`` where these identifiers follow one another."""

    license: str
    sequence: tuple[str, ...]


#: From the most particular to the least; a short notice comes after the texts that contain it.
RULES = (
    Rule("MIT", ("mit-name", "mit-grant", "mit-notice", "as-is-software", "no-liability-software")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is-software", "no-liability-software")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("GPL-3.0-or-later", ("gpl-grant", "gpl-3-or-later")),
    Rule("GPL-2.0-or-later", ("gpl-grant", "gpl-2-or-later")),
    Rule("Apache-2.0", ("apache-2-name", "apache-2-terms", "apache-2-copy")),
    Rule("Apache-2.0", ("apache-2-name", "apache-2-terms")),
    Rule("Apache-2.0", ("apache-2-name",)),
    Rule("ISC", ("isc-grant",)),
    Rule("MIT", ("mit-name",)),
    Rule("BSD-3-Clause", ("bsd-3-name",)),
    Rule("BSD-2-Clause", ("bsd-2-name",)),
    Rule("GPL-3.0", ("gpl-3-name",)),
    Rule("GPL-2.0", ("gpl-2-name",)),
    Rule("LGPL-3.0", ("lgpl-name",)),
    Rule("AGPL-3.0", ("agpl-name",)),
    Rule("MPL-2.0", ("mpl-2-name",)),
    Rule("CC0-1.0", ("cc0-name",)),
    Rule("CC-BY-4.0", ("cc-by-name",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("All-Rights-Reserved", ("reserved",)),
    *[Rule(tag, (f"tag-{tag}",)) for tag in TAGS],
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "([.;:!?])[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n"
#: Every known sentence holds one of these words, so a text without them has no sequence.
WORDS = ("licens", "software", "redistribution", "reserved", "contributors", "cc0", "bsd", "mozilla")
HINT_WORDS = ("license", "licence", "copyright", "all rights reserved", "redistribut")
HINT = "|".join(HINT_WORDS)


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; the same words in one place only."""
    table: dict[str, str] = {}
    for name, sentences in SENTENCES.items():
        for s in sentences:
            if table.setdefault(normal(s), name) != name:
                raise ValueError(f"{s!r} has two identifiers")
            if not any(w in normal(s) for w in WORDS):
                raise ValueError(f"{s!r} has none of WORDS")
    return table | {normal(f"SPDX-License-Identifier: {tag}"): f"tag-{tag}" for tag in TAGS}


def pattern(rule: Rule) -> str:
    """In a sequence written as "<a><b>", so that no identifier is part of another."""
    return "".join(f"<{name}>" for name in rule.sequence)


def identifier(sentence: Column, table: Column) -> Column:
    known = F.try_element_at(table, F.trim(sentence))
    return F.coalesce(known, *[F.when(F.contains(sentence, F.lit(words)), F.lit(name)) for words, name in PHRASES.items()])


def identifiers(sentences: Column, table: Column) -> Column:
    found = F.filter(F.transform(sentences, lambda s: identifier(s, table)), lambda x: x.isNotNull())
    return F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def recognised(sequence: Column) -> Column:
    """(left, licenses): the rules applied in order, each taking what it matches."""
    rules = F.array(*[F.struct(F.lit(r.license).alias("license"), F.lit(pattern(r)).alias("pattern")) for r in RULES])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("licenses"))
    return F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.contains(state["left"], rule["pattern"]),
            F.struct(
                F.replace(state["left"], rule["pattern"], F.lit("|")).alias("left"),
                F.array_append(state["licenses"], rule["license"]).alias("licenses"),
            ),
        ).otherwise(state),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sequence, licenses, n_known, n_unknown) for every row of ``docs``.

    ``sequence`` holds the identifiers of the finer cut (the one that finds more; sentences win a tie),
    ``licenses`` the sorted distinct licences of both cuts, joined by commas, ``n_known`` the number of
    identifiers and ``n_unknown`` the lines that speak of licences and are not known. Null and empty
    texts have none. Rows are independent: repeated rows, ties and null ids change nothing, and other
    columns are not read. Very long texts are normalised whole. The list knows the licences of RULES by their notices, first
    sentences and tags, and the texts of the MIT, BSD and ISC licences; others are unknown.
    """
    table = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    low = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    one = docs.select(F.col(f"`{id_col}`").alias("id"), low.alias("t"))
    speaks = F.lit(False)
    for word in (*WORDS, *HINT_WORDS):
        speaks = speaks | F.contains(F.col("t"), F.lit(word))
    one = one.withColumn("speaks", speaks)
    marked = F.regexp_replace(F.regexp_replace("t", MARK, "$1\u0001"), "[^a-z0-9\u0001]+", " ")
    cut = one.select(
        "id",
        F.when(F.col("speaks"), F.split(marked, "\u0001")).alias("sentences"),
        F.when(F.col("speaks"), F.split(F.regexp_replace("t", "[^a-z0-9\n]+", " "), "\n")).alias("lines"),
    )
    unknown = F.filter("lines", lambda s: F.regexp_like(s, F.lit(HINT)) & identifier(s, table).isNull())
    two = cut.select(
        "id",
        F.coalesce(identifiers(F.col("sentences"), table), F.lit("")).alias("a"),
        F.coalesce(identifiers(F.col("lines"), table), F.lit("")).alias("b"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size(unknown)).cast("long").alias("n_unknown"),
    )
    some = F.when((F.col("a") == "") & (F.col("b") == ""), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.concat(recognised(F.col("a"))["licenses"], recognised(F.col("b"))["licenses"])))
    )
    count = lambda c: F.length(c) - F.length(F.translate(c, "<", ""))
    three = two.select("id", "a", "b", some.alias("licenses"), count(F.col("a")).alias("na"), count(F.col("b")).alias("nb"), "n_unknown")
    return three.select(
        F.col("id").alias(id_col),
        F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("sequence"),
        F.array_join("licenses", ",").alias("licenses"),
        F.greatest("na", "nb").cast("long").alias("n_known"),
        "n_unknown",
    )
