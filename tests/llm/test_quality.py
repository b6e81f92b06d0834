"""Operators 3 and 2: held-out accuracy, and a plain rule scan."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from elotrail.llm import quality
from elotrail.llm.licenses import RULES, SENTENCES, match_rules, recognise, normalise, scan_licenses
from elotrail.llm.quality import classify, features, ftrl, held_out, train, _weights, Model

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = classify(docs, labels).join(labels, "doc_id").withColumn("out", held_out(F.col("doc_id")))
    rows = [r for r in out.collect() if r["out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    for y in (0, 1):
        own = [r["predicted"] for r in rows if r["quality"] == y]
        assert own and np.mean([p == y for p in own]) >= 0.9


def test_labels_are_all_that_counts(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["sun", "moon", "star", "sky"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["buy", "now", "$$$", "sky"]) for _ in range(30)) for _ in range(20)]
    rows = [(i, t, 0.0, "z") for i, t in enumerate(good + bad)] + [(None, None, 0.0, ""), (999, "", 1.0, "")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, score double, x string")
    labels = [(i, int(i < 60), None) for i in range(80)] + [(1, 1, 0), (None, 1, 0), (2, None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = classify(docs, labels)
    assert out.columns == ["doc_id", "text", "score", "x", "predicted"] or set(out.columns) == {
        "doc_id", "text", "score", "x", "predicted"}
    got = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert min(score[i] for i in range(60)) > max(score[i] for i in range(60, 80))
    again = dict((r["doc_id"], r["score"]) for r in classify(docs.repartition(3), labels).collect())
    assert again == pytest.approx(score, abs=1e-12)
    assert {r["score"] for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_ftrl_separates_and_stays_sparse():
    z, n = np.zeros(9), np.zeros(9)
    rows = [(np.array([y, 2 + k % 6]), np.array([1.0, 1e-6]), y) for k in range(400) for y in (0, 1)]
    ftrl(rows, z, n)
    w = _weights(z, n)
    assert w[1] > 1 and w[0] < -1 and not w[2:8].any()


def plain_features(text):
    """Every n-gram of a text by itself, and its share among those of its kind."""
    tokens = quality.TOKENS.findall(text)
    codes = [quality._token(t) for t in tokens]
    shapes = [6 if k and codes[k] >> 8 == codes[k - 1] >> 8 else c & 255 for k, c in enumerate(codes)]
    kinds = [[(1, c >> 8) for c in codes],
             [(2, a >> 8, b >> 8) for a, b in zip(codes, codes[1:])],
             [(3, *g) for g in zip(shapes, shapes[1:])] if len(codes) != 1 else [(3, shapes[0])],
             [(4, *g) for g in zip(shapes, shapes[1:], shapes[2:])]]
    out = Counter()
    for grams in kinds:
        for g in grams:
            h = 0
            for p in g:
                h = (h ^ p) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out[h >> (64 - quality.BITS)] += 1 / len(grams)
    return dict(out)


TEXTS = ["", " ", "one", "  one ", "a a", "a a a b", "Some words, REPEATED repeated words!! 123 über $$$ " * 40,
         "x" * 300 + " y y", "no$spaces$at$all" * 20, "\u2003wide\u2003spaces\x1cand separators " * 5,
         "last " + " " * 500, " " * 500 + "late", "p" + " " * 300 + "q" + " " * 300 + "q"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50, 200, 1 << 20])
def test_features_at_any_chunk(chunk, monkeypatch):
    monkeypatch.setattr(quality, "_CHUNK", chunk)
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=1 << quality.BITS), 0.1)
    for text in TEXTS:
        want = plain_features(text)
        index, value = features(text)
        assert list(index) == sorted(want)
        assert value == pytest.approx([want[i] for i in index])
        total = 0.1 + sum(model.weights[i] * v for i, v in want.items())
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-total)))


def test_long_text_without_spaces_takes_no_walk():
    rng = random.Random(3)
    text = "".join(rng.choice("ab$%") for _ in range(3 << 20))
    start = time.monotonic()
    features(text)
    assert time.monotonic() - start < 30


def plain_ftrl(rows, rounds):
    """FTRL-proximal updates one coordinate at a time, over (features, label)."""
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else (
        math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(rounds):
        for x, y in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_equals_a_plain_learner(spark):
    """The whole operator on the smallest table: learners, their average and all scores."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), i, int(y)) for i, y in
            labels.select("doc_id", "quality").collect() if y is not None and i in text
            and zlib.crc32(str(i).encode()) % 5]
    of = spark.createDataFrame([(p,) for p, _, _ in rows], "place string").select(
        "place", F.pmod(F.xxhash64("place"), F.lit(quality.SHARDS)).alias("shard"))
    shard = {r["place"]: r["shard"] for r in of.collect()}
    learned = [plain_ftrl([(plain_features(text[i]), y) for p, i, y in sorted(rows) if shard[p] == s],
                          quality.ROUNDS) for s in sorted(set(shard.values()))]
    mean = Counter()
    for w in learned:
        for i, v in w.items():
            mean[i] += v / len(learned)
    assert rows and mean
    for r in classify(docs, labels).collect():
        total = mean["bias"] + sum(mean[i] * v for i, v in plain_features(text[r["doc_id"]]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_bound_on_training_rows(spark):
    docs = spark.createDataFrame([(i, f"good t{i}" if i % 2 else "bad $$$") for i in range(200)],
                                 "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert train(docs, labels, bound=50).weights.any()
    # in bytes: texts of 6 to 7 bytes, of which a text may have a sixteenth
    assert train(docs, labels, bound_bytes=300).weights.any()
    assert not train(docs, labels, bound_bytes=90).weights.any()


# -- licence scans ------------------------------------------------------------------


def test_sentences_and_rules():
    known = {normalise(s): i for i, s in SENTENCES.items()}
    text = ("Intro line | without stop\nAll rights reserved.\nLicensed under the Apache\nLicense, Version "
            "2.0 (the \"License\"); you may not use this file except in compliance with the License.\n"
            "You may obtain a copy of the License at\nhttp://x\nMore.")
    found = recognise(text, known)
    assert [f[0] for f in found if f[0]] == ["reserved", "apache-2-the", "apache-2-use", "apache-2-copy"]
    for name, a, b in found:
        if name:
            assert known[normalise(text[a:b])] == name
    assert match_rules(["x", "a", "b", "a", "a", "b"], [("AB", ["a", "b"]), ("A", ["a"])]) == [
        ("AB", 1, 2), ("A", 3, 3), ("AB", 4, 5)]


def test_license_documents(spark):
    docs = spark.createDataFrame([
        (1, "Foo.\nReleased under the MIT License.\nAll rights reserved.", 1), (2, None, 1), (3, "", 1),
        (4, "SPDX-License-Identifier: MIT\nx", 1), (4, "SPDX-License-Identifier: MIT\nx", 1),
        (5, "Not released under the MIT License", 1)], "doc_id long, text string, licenses int")
    out = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    assert out[1]["licenses"] == ["MIT", "all-rights-reserved"] and out[1]["n_sentences"] == 3
    assert out[4]["licenses"] == ["MIT"] and out[5]["licenses"] == [] and out[2]["n_sentences"] == 0
    assert scan_licenses(docs).count() == 6 and scan_licenses(docs.limit(0)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
BSD_TEXT = """BSD 3-Clause License

Copyright (c) 2020, Jane Roe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
APACHE_TEXT = """   Copyright 2020 Jane Roe

   Licensed under the Apache License,
   Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License
   at

       http://www.apache.org/licenses/LICENSE-2.0
"""


def test_standard_texts_below_heading_and_copyright_line(spark):
    texts = {1: (MIT_TEXT, "MIT", ["mit-grant", "mit-keep"]), 2: (BSD_TEXT, "BSD", ["bsd-use"]),
             3: (APACHE_TEXT, "Apache-2.0", ["apache-2-the", "apache-2-use", "apache-2-copy"])}
    for k, (t, name, ids) in list(texts.items()):
        texts[k + 10] = (t.replace("\n", "\r\n"), name, ids)
        texts[k + 20] = ("\n".join(f" * {line}" for line in t.split("\n")), name, ids)
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string")
    out = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    for k, (t, name, ids) in texts.items():
        assert (out[k]["licenses"], out[k]["sentence_ids"]) == ([name], ids)
        m, = out[k]["matches"]
        first, last = normalise(SENTENCES[ids[0]]), normalise(SENTENCES[ids[-1]])
        assert normalise(t[m["start"]:m["end"]]).startswith(first)
        assert normalise(t[m["start"]:m["end"]]).endswith(last)
    known = {normalise("a b c"): "abc", normalise("a b"): "ab", normalise("c d"): "cd"}
    ids = lambda t: [f[0] for f in recognise(t, known)]
    assert ids("x\na\nb\nc\nd") == ["", "abc", ""] and ids("x\na\nb\ny\nc\n\nd") == ["", "ab", "", "cd"]


def test_notices_of_the_gnu_licences_spdx_lines_and_leads(spark):
    notice = ("{0} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {1}\n"
              "Public License as published by the Free Software Foundation{2} either\nversion {3} of the "
              "License, or (at your option) any later version.\n\nMore.")
    texts = {
        1: (notice.format("This program", "General", ";", "2"), "GPL-2.0-or-later"),
        2: (notice.format("This library", "Lesser General", ";", "2.1"), "LGPL-2.1-or-later"),
        3: (notice.format("This program", "Affero General", ",", "3"), "AGPL-3.0-or-later"),
        4: (notice.format("This program", "General", ",", "3"), "GPL-3.0-or-later"),
        5: ("# SPDX-License-Identifier: BSD-3-Clause\nimport x", "BSD-3-Clause"),
        6: ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        7: ("SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0"),
        8: ("X.\nLicensed under the MIT License.", "MIT"),
        9: ("This project is licensed under the Apache License 2.0.", "Apache-2.0"),
        10: ("ISC License\n\nCopyright (c) 2020 J\n\nPermission to use, copy, modify, and/or distribute this "
             "software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright "
             "notice and this permission notice appear in all copies.", "ISC")}
    plain = {20: ("GPL-2.0-only", None), 21: ("either version 2 of the License", None), 22: ("ISC\nMIT", None)}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in (texts | plain).items()], "doc_id long, text string")
    out = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs).collect()}
    assert out == {k: [x] if x else [] for k, (_, x) in (texts | plain).items()}


def test_sentences_are_known_by_one_id():
    forms = [normalise(s) for s in SENTENCES.values()]
    assert len(set(forms)) == len(forms) and all(set(seq) <= set(SENTENCES) for _, seq in RULES)


def test_very_long_text_of_unknown_lines():
    known = {normalise(s): i for i, s in SENTENCES.items()}
    text = "you can\n" * 300_000 + "All rights reserved."
    start = time.monotonic()
    assert [f[0] for f in recognise(text, known) if f[0]] == ["reserved"]
    assert time.monotonic() - start < 30
