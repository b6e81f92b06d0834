"""Operators 6 and 7 against plain Python versions."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from elotrail.llm import simhash, sketch

# -- operator 6 ---------------------------------------------------------------------


def plain_sketch(text, scale, least):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\f\r", " " * 5)).split(" ") if w]
    h8 = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(hs):
        seed = 42
        for h in hs:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed & sketch.FULL

    if len(words) < 5:  # one shingle of all words
        return None
    every = sorted({chain(h8[i:i + 5]) for i in range(len(h8) - 4)})
    top = sketch.FULL // scale - 1
    below = [h for h in every if h <= top]
    if len(below) >= least:
        return top, below
    return (every[least - 1] if len(every) > least else sketch.FULL), every[:least]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_sketches(spark):
    rng = random.Random(1)
    texts = [words(rng, n) for n in (5, 6, 30, 60, 400, 3000)] + ["a \n b\tc  d e f"]
    df = sketch.add_sketch(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s",
                           scale=8, least=16)
    for r in df.collect():
        assert (r["s"]["limit"], r["s"]["hashes"]) == plain_sketch(r["text"], 8, 16)


def test_containment_of_very_unequal_texts(spark):
    rng = random.Random(2)
    small = words(rng, 3000, 10**6)
    big = words(rng, 30_000, 10**6) + " " + small
    df = spark.createDataFrame([(small, big)], "a string, b string")
    df = sketch.add_sketch(sketch.add_sketch(df, "a", "x"), "b", "y")
    both = sketch.merge(F.col("x"), F.col("y"))
    r = df.select(sketch.containment(F.col("x"), F.col("y")).alias("in_big"),
                  sketch.containment(F.col("y"), F.col("x")).alias("in_small"),
                  sketch.as_string(both).alias("m"), sketch.as_string(F.col("y")).alias("y")).first()
    assert r["in_big"] == 1.0 and abs(r["in_small"] - 0.09) < 0.05 and r["m"] == r["y"]


def test_documents_and_their_neighbours(spark):
    rng = random.Random(3)
    texts = {3: words(rng, 80), 1: words(rng, 900), 9: "", 5: None, 7: "äöü€x", 11: words(rng, 300)}
    texts[12] = texts[11]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()],
                                 "doc_id long, text string, own string").repartition(3)
    out = {r["doc_id"]: r for r in sketch.fingerprint_documents(docs).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert out[11]["fingerprint"] == out[12]["fingerprint"] != out[1]["fingerprint"]
    assert out[11]["near_next"] == 1.0 and out[1]["near_next"] == 0.0
    assert abs(out[1]["near_edited"] - 0.75) < 0.2
    assert out[5]["near_next"] == 0.0 and out[9]["near_edited"] == 1.0


def parsed(fingerprint):
    limit, _, hashes = fingerprint.partition(":")
    return int(limit, 16), {int(h, 16) for h in hashes.split(",") if h}


def likeness(a, b):
    """Share of the first fingerprint's hashes below both limits that the second one has."""
    (la, a), (lb, b) = parsed(a), parsed(b)
    x = {h for h in a if h <= min(la, lb)}
    return 1.0 if not a and not b else len(x & b) / len(x) if x else 0.0


def test_likeness_follows_from_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sorted(sketch.fingerprint_documents(docs).collect())
    for r, after in zip(out, out[1:] + out[:1]):
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness(r["fingerprint"], after["fingerprint"])


def test_short_document_inside_the_next(spark):
    rng = random.Random(5)
    texts = {}
    for k, n in enumerate([24, 24, 24, 34, 60, 200, 400]):
        short = words(rng, n, 10**6)
        half = " ".join(short.split()[:n // 2 + 2])
        texts[4 * k] = short
        texts[4 * k + 1] = f"{words(rng, 1500, 10**6)} {short} {words(rng, 1500, 10**6)}"
        texts[4 * k + 2] = short  # of which about half is in the next one
        texts[4 * k + 3] = f"{words(rng, 3000, 10**6)} {half}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["near_next"] for r in sketch.fingerprint_documents(docs).collect()}
    grams = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    for k in range(0, len(texts), 2):
        own, after = grams(texts[k]), grams(texts[k + 1])
        share = len(own & after) / len(own)
        # a quarter of the shorter text's shingles is compared
        assert out[k] == 1 if share == 1 else abs(out[k] - share) < 2 / (len(own) / 4) ** 0.5
        if k + 2 in texts:
            assert out[k + 1] == 0.0 or grams(texts[k + 1]) & grams(texts[k + 2])


def test_very_long_document(spark):
    rng = random.Random(8)
    texts = [(1, words(rng, 300_000)), (2, "a b c d e f"), (3, "x" * 10**6)]
    out = sorted(sketch.fingerprint_documents(spark.createDataFrame(
        texts, "doc_id long, text string")).collect())
    for (_, t), r in zip(texts, out):
        plain = plain_sketch(t, sketch.SCALE, sketch.LEAST)
        assert plain is None or parsed(r["fingerprint"]) == (plain[0], set(plain[1]))
    assert [r["n_chars"] for r in out] == [len(t) for _, t in texts]


def test_repeated_null_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 2 + [(None, "x y z"), (None, None)],
                                 "doc_id long, text string")
    out = sketch.fingerprint_documents(docs).collect()
    assert len(out) == 4 and len({str(r) for r in out if r["doc_id"] == 1}) == 1
    one = sketch.fingerprint_documents(docs.filter("doc_id = 1").limit(1)).collect()
    assert one[0]["near_next"] == 1.0
    assert sketch.fingerprint_documents(docs.limit(0)).count() == 0


def test_fingerprints_run_without_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = sketch.add_sketch(docs, "text", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- operator 7 ---------------------------------------------------------------------


def plain_fingerprint(text, shingle=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    ws = [w for w in low.translate(str.maketrans("\t\n\x0b\f\r", " " * 5)).split(" ") if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + shingle]).encode(), 42)
          for i in range(max(1, len(ws) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs):  # (id, fingerprint)
    left, out = dict(pairs), {}
    for start in sorted(left):
        if start in out:
            continue
        todo, seen = [start], {start}
        while todo:
            a = todo.pop()
            for b in left:
                if b not in seen and (left[a] ^ left[b]).bit_count() <= 4:
                    seen.add(b)
                    todo.append(b)
        out.update(dict.fromkeys(seen, start))
    return out


def test_fingerprint_of_a_text(monkeypatch):
    rng = random.Random(4)
    texts = ["", " \n", "A b", "a B c d", "ÄB c d e f", words(rng, 500)]
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(simhash, "_CHUNK", chunk)
        assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def prints(rng, n, crowd):
    """Random fingerprints, pairs at 0 to 6 bits, a chain, and a crowd around one value."""
    out = [rng.getrandbits(64) for _ in range(n)]
    flip = lambda v, k: v ^ sum(1 << b for b in rng.sample(range(64), k))
    out += [flip(v, rng.randint(0, 6)) for v in out[:n // 2]]
    chain = [rng.getrandbits(64)]
    for _ in range(20):
        chain.append(flip(chain[-1], 4))
    loose = rng.sample(range(64), 14)
    centre = rng.getrandbits(64)
    out += chain + [centre ^ sum(1 << b for b in loose if rng.random() < 0.3) for _ in range(crowd)]
    return out


@pytest.mark.parametrize("seed,crowd,crowded", [(1, 0, 128), (2, 250, 128), (3, 250, 8), (4, 100, 2)])
def test_components_equal_all_pairs(spark, seed, crowd, crowded, monkeypatch):
    rng = random.Random(seed)
    fps = prints(rng, 150, crowd)
    pairs = {i: v for i, v in enumerate(fps)}
    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (4, 64, crowded))
    df = spark.createDataFrame([(i, v - (v >> 63 << 64)) for i, v in pairs.items()], "id long, fp long")
    comp = {r["fp"] % 2**64: r["component"] for r in simhash.components(df).collect()}
    want = plain_components(pairs.items())
    assert {i: comp[v] for i, v in pairs.items()} == want


def test_pairs_come_once(spark):
    rng = random.Random(9)
    fps = sorted(set(prints(rng, 100, 150)))
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in fps], "fp long")
    got = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.near_pairs(df, crowded=10).collect()]
    want = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1:] if (a ^ b).bit_count() <= 4]
    assert sorted(got) == sorted(want)


def test_dense_group_gives_links_in_proportion(spark):
    rng = random.Random(13)
    bits = rng.sample(range(64), 16)
    centre = rng.getrandbits(64)
    fps = [centre ^ sum(1 << b for k, b in enumerate(bits) if v >> k & 1) for v in rng.sample(range(2**16), 20_000)]
    df = spark.createDataFrame([(i, v - (v >> 63 << 64)) for i, v in enumerate(fps)], "id long, fp long")
    links = simhash.near_pairs(df.select("fp"), thin=True).collect()
    assert len(links) < 2 * len(fps)
    assert all(r["a"] < r["b"] for r in links)
    assert {r["component"] for r in simhash.components(df).collect()} == {0}


def test_two_near_crowds_link_and_far_ones_do_not(spark):
    rng = random.Random(17)
    bits = rng.sample(range(64), 40)
    cube = lambda c: [c ^ sum(1 << b for k, b in enumerate(bits[:9]) if v >> k & 1) for v in range(2**9)]
    away = lambda c, n: c ^ sum(1 << b for b in bits[20:20 + n])
    centre = rng.getrandbits(64)
    crowds = [cube(centre), cube(away(centre, 4)), cube(away(centre, 9))]
    rows = [(k * 1000 + i, v - (v >> 63 << 64)) for k, c in enumerate(crowds) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "id long, fp long")
    comp = {r["fp"]: r["component"] for r in simhash.components(df).collect()}
    assert {i // 1000: comp[v] for i, v in rows} == {0: 0, 1: 0, 2: 2000} and set(comp.values()) == {0, 2000}


@pytest.mark.parametrize("n", [2, 10**4, 10**7, 10**10])
def test_plan_keeps_the_pigeonhole(n):
    rng = np.random.default_rng(1)
    parts = simhash.plan_parts(rng.integers(0, 2**64, 500, dtype=np.uint64), n, 4)
    masks = [m for m, _ in parts]
    assert all(a & b == 0 for k, a in enumerate(masks) for b in masks[k + 1:])
    # thresholds plus one per part in use make radius + 1: no pair can pass all parts by
    assert sum(t + 1 for _, t in parts) == 5


def test_documents_link(spark):
    rng = random.Random(11)
    base = words(rng, 400)
    texts = {5: base, 2: base + " tail", 9: base, 4: "", 1: None, 8: words(rng, 300), 3: "Lone"}
    docs = spark.createDataFrame([(i, t, "f") for i, t in texts.items()] + [(8, texts[8], "g")],
                                 "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == plain_components(fps.items())
    assert len(out) == 8 and simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_components(fps.items()).values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0
