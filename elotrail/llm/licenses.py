"""Operator 2: licence scans by sentence-rule recognition.

A text is cut into sentences, each is normalised (A-Z lower-cased, everything but a-z
and 0-9 to single spaces) and looked up among known licence sentences.  In a sentence that
is not known whole, the longest run of lines from each line on that is a known sentence is
one, so a notice is seen without a full stop before it (below a heading or a copyright
line), hard-wrapped or not; every other line is a sentence of its own.  The ordered
rules - sequences of sentence ids - are then matched against the document's sequence: an
earlier rule takes its sentences before a later one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Sentences of public licences and notices, by id.
SENTENCES = {
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "apache-2-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2-use": "you may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at",
    "bsd-use": "Redistribution and use in source and binary forms, with or without "
               "modification, are permitted provided that the following conditions are met",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and "
           "related or neighboring rights to this work",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU General "
                   "Public License as published by the Free Software Foundation, either version "
                   "3 of the License, or (at your option) any later version",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy "
                 'of this software and associated documentation files (the "Software"), to deal '
                 "in the Software without restriction, including without limitation the rights "
                 "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all "
                "copies or substantial portions of the Software",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "reserved": "All rights reserved",
    "spdx-apache-2": "Apache-2.0",
    "spdx-mit": "MIT",
    "spdx": "SPDX-License-Identifier",
}
# Rules in order of precedence.
RULES = [
    ("Apache-2.0", ["apache-2-the", "apache-2-use", "apache-2-copy"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-later"]),
    ("Apache-2.0", ["spdx", "spdx-apache-2"]),
    ("MIT", ["spdx", "spdx-mit"]),
    ("Apache-2.0", ["apache-2"]),
    ("BSD", ["bsd-use"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-3.0-only", ["gpl-3"]),
    ("MIT", ["mit"]),
    ("MPL-2.0", ["mpl-2"]),
    ("all-rights-reserved", ["reserved"]),
]
# Identifiers that an SPDX line may name, and pairs of them that it offers.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib"]
SPDX_OR = ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later"]
# GNU licences whose notice names a version, by identifier.
GNU = {"GPL": ("General", ["2", "3"]), "LGPL": ("Lesser General", ["2.1", "3"]), "AGPL": ("Affero General", ["3"])}
# How a line says that a work has a licence, and what it calls it.
LEADS = ["Licensed under the", "Released under the", "Distributed under the",
         "This project is licensed under the", "This software is released under the"]
NAMES = {"MIT": "MIT License", "ISC": "ISC License", "Apache-2.0": "Apache License 2.0",
         "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
         "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0"}


def _more() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules that follow from the lists above, besides the ones written out."""
    sentences, rules = {}, []

    def known(name: str, sentence: str) -> str:
        """Id of a sentence, the one that it has already if it is known."""
        form = normalise(sentence)
        for i, old in (SENTENCES | sentences).items():
            if normalise(old) == form:
                return i
        sentences[name] = sentence
        return name

    for short, (family, versions) in GNU.items():
        terms = (f"you can redistribute it and/or modify it under the terms of the GNU {family} "
                 "Public License as published by the Free Software Foundation")
        for v in versions:
            later = f"either version {v} of the License, or (at your option) any later version"
            licence = f"{short}-{v if '.' in v else v + '.0'}-or-later"
            rules.append((licence, [known(f"{short.lower()}-terms", terms), known(f"gnu-{v}-later", later)]))
            rules.append((licence, [known(f"{short.lower()}-{v}-later", f"{terms}, {later}")]))
    offers = [f"{a} OR {b}" for a in SPDX_OR for b in SPDX_OR if a != b]
    for x in [*SPDX, *offers]:
        name = "spdx-" + normalise(x).replace(" ", "-")
        rules.append((x, ["spdx", known(name, x)]))
    rules.append(("ISC", [known("isc-grant", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies"))]))
    for licence, called in NAMES.items():
        for k, lead in enumerate(LEADS):
            rules.append((licence, [known(f"{normalise(licence).replace(' ', '-')}-lead-{k}", f"{lead} {called}")]))
    return sentences, [r for r in rules if r not in RULES]


END = re.compile(r"[.!?;:]+[ \t\n\r\f\v]+")
_OTHER = re.compile(r"[^a-z0-9]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.translate(_FOLD)).strip(" ")


_sentences, _rules = _more()
SENTENCES |= _sentences
RULES += _rules


def _pieces(text: str, end: re.Pattern, at: int = 0) -> Iterator[tuple[int, str]]:
    """(place, piece) of a text between matches of ``end``."""
    start = 0
    for m in end.finditer(text):
        yield at + start, text[start:m.start()]
        start = m.end()
    yield at + start, text[start:]


_LINE = re.compile("\n")


def heads_of(known: dict[str, str]) -> dict[str, list[str]]:
    """The known sentences by their first word."""
    heads: dict[str, list[str]] = {}
    for form in known:
        heads.setdefault(form.split(" ", 1)[0], []).append(form)
    return heads


def _runs(lines: list[tuple[str, int, int]], known: dict[str, str],
          heads: dict[str, list[str]]) -> Iterator[tuple[str, int, int]]:
    """(sentence id or "", start, end) of lines (form, start, end), none of an empty form:
    from each line on, the longest run that is known, or else the line."""
    k = 0
    while k < len(lines):
        run, start, end = lines[k]
        name, after = known.get(run, ""), k + 1
        open_ = [f for f in heads.get(run.split(" ", 1)[0], ()) if f.startswith(run)]
        for n in range(k + 1, len(lines) if open_ else 0):
            run = f"{run} {lines[n][0]}"
            open_ = [f for f in open_ if f.startswith(run)]
            if not open_:
                break
            if run in known:
                name, end, after = known[run], lines[n][2], n + 1
        yield name, start, end
        k = after


def recognise(text: str, known: dict[str, str],
              heads: dict[str, list[str]] | None = None) -> list[tuple[str, int, int]]:
    """(sentence id or "", start, end) of each sentence that has a letter or digit of ASCII."""
    heads, out = heads_of(known) if heads is None else heads, []
    for at, sentence in _pieces(text, END):
        form = normalise(sentence)
        if form in known or "\n" not in sentence:
            if form:
                out.append((known.get(form, ""), at, at + len(sentence)))
            continue
        lines = [(f, start, start + len(s)) for start, s in _pieces(sentence, _LINE, at)
                 if (f := normalise(s))]
        out.extend(_runs(lines, known, heads))
    return out


def match_rules(ids: list[str], rules: list[tuple[str, list[str]]]) -> list[tuple[str, int, int]]:
    """(licence, first, last sentence) of each match, in the text's order.  Rules come in
    their order, each from left to right, over sentences that none before has taken."""
    ids, found = list(ids), []
    present = set(ids)
    for licence, seq in rules:
        if not present.issuperset(seq):
            continue
        k = 0
        while k + len(seq) <= len(ids):
            if ids[k:k + len(seq)] == seq:
                found.append((licence, k, k + len(seq) - 1))
                ids[k:k + len(seq)] = [None] * len(seq)
                k += len(seq)
            else:
                k += 1
    return sorted(found, key=lambda x: x[1])


def scan(text: Column, sentences: dict[str, str] | None = None,
         rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """struct(n_sentences, ids, matches) of a text (not null); a match has its licence and
    the characters from its first to its last sentence.  The tables are code-sized."""
    known = {normalise(s): i for i, s in (sentences or SENTENCES).items()}
    heads, order = heads_of(known), rules or RULES
    match = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_sentences", pa.int64()), ("ids", pa.list_(pa.string())),
                      ("matches", pa.list_(match))])

    @F.arrow_udf("struct<n_sentences:bigint,ids:array<string>,"
                 "matches:array<struct<license:string,start:int,end:int>>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out = []
            for t in a.to_pylist():
                found = recognise(t, known, heads)
                out.append({"n_sentences": len(found), "ids": [f[0] for f in found if f[0]],
                            "matches": [{"license": x, "start": found[i][1], "end": found[j][2]}
                                        for x, i, j in match_rules([f[0] for f in found], order)]})
            yield pa.array(out, kind)

    return scanned(text)


def scan_licenses(docs: DataFrame, text: str = "text", **tables) -> DataFrame:
    """Add n_sentences, sentence_ids, licenses (different ones, sorted) and matches (with
    characters of the original) to each row.

    One narrow pass over whole texts.  A null or empty text has no sentences; repeated rows
    stay; an empty table gives no rows; columns of the four names are replaced."""
    new = ("n_sentences", "sentence_ids", "licenses", "matches")
    d = docs.withColumn("__s", scan(text_of(text), **tables))
    return d.select(*[c for c in docs.columns if c not in new],
                    F.col("__s.n_sentences").alias("n_sentences"),
                    F.col("__s.ids").alias("sentence_ids"),
                    F.array_sort(F.array_distinct("__s.matches.license")).alias("licenses"),
                    F.col("__s.matches").alias("matches"))
