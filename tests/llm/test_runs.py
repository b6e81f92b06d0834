"""Periodic runs against a plain search, whole and appended piece by piece."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from elotrail.llm.queries import op13_periodic_runs, planted
from elotrail.llm.runs import SquareCatcher, block_of, find_runs, levels, periodic_runs, text_runs

SF = "/root/testdata/sf0.001"


def plain_runs(s, least=12):
    """Every period in turn: stretches of words that equal the one a period later."""
    out = set()
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i < len(s) - p:
            j = i
            while j < len(s) - p and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and j > i:
                if not any(s[i:j + p - q] == s[i + q:j + p] for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, most=130):
    n, k = rng.randrange(most), rng.choice([1, 2, 2, 3, 5, 30])
    s = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, 1 + max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + p + rng.randrange(n - a))):
                s[i] = s[i - p]
    return s


@pytest.mark.parametrize("least", [12, 3, 8])
def test_equals_plain_search(least):
    rng = random.Random(least)
    for _ in range(500):
        s = random_words(rng)
        assert [tuple(r) for r in find_runs(np.array(s, np.int64), least).tolist()] == plain_runs(s, least)


def test_appended_in_pieces():
    """After every append the runs are those of the words so far, and each is reported once,
    when its first square is complete."""
    rng = random.Random(5)
    for _ in range(60):
        s, catcher, told, k = random_words(rng, 90), SquareCatcher(), [], 0
        while k < len(s):
            m = rng.choice([1, 2, 5, 17, 60])
            told += catcher.append(np.array(s[k:k + m]))
            k = min(len(s), k + m)
            want = plain_runs(s[:k])
            assert [tuple(r) for r in catcher.runs().tolist()] == want
            assert sorted(told) == sorted((a, p) for a, _, p in want)


def test_pieces_of_any_size_agree(monkeypatch):
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 90, 700), 3), rng.integers(0, 9, 500),
                        np.zeros(300, np.int64), np.tile([1, 2, 3, 4, 5], 100)])
    whole = find_runs(s).tolist()
    assert any(p == 700 for _, _, p in whole) and any(p == 5 for _, _, p in whole)
    for size in (97, 1000):
        monkeypatch.setattr("elotrail.llm.runs._CHUNK", size)
        assert find_runs(s).tolist() == whole
    monkeypatch.setattr("elotrail.llm.runs._CELLS", 50)
    monkeypatch.setattr("elotrail.llm.runs._ROWS", 3)
    assert find_runs(s).tolist() == whole


def test_levels_hold_every_period():
    for top in (1, 5, 6, 14, 15, 100, 5000):
        ranges = list(levels(top))
        assert [p for _, low, high in ranges for p in range(low, high + 1)] == list(range(1, top + 1))
        for b, low, high in ranges:
            assert all(block_of(p) == b and 2 * b - 1 <= max(12 - p, p) for p in range(low, high + 1))
    with pytest.raises(ValueError):
        SquareCatcher(2)


def test_long_texts_take_seconds():
    """A million words: one word over and over, two words at random, one period of 1,000."""
    rng = np.random.default_rng(1)
    assert find_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    assert find_runs(np.tile(rng.permutation(1000), 1000)).tolist() == [[0, 1_000_000, 1000]]
    assert len(find_runs(rng.integers(0, 2, 200_000))) > 1000


def test_words_and_collapsed_text():
    n, runs, kept = text_runs("a\x0bb c\t" * 5 + "\n \x1c  A")
    assert (n, runs.tolist(), kept) == (17, [[0, 15, 3]], "a b c \x1c  A")
    assert text_runs("")[0] == 0 and text_runs(" \n")[2] == ""
    assert text_runs("Ä 漢 " * 6)[1].tolist() == [[0, 12, 2]]


def test_operator(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "na " * 30 + "hey", "x"), (3, "na " * 30 + "hey", "x"), (None, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs(docs, prefix="p_")
    assert got.columns == ["doc_id", "text", "runs", "p_n_words", "p_runs", "p_collapsed"]
    out = [tuple(r) for r in got.drop("text").collect()]
    assert out[2] == out[3] and out[2][3][0].asDict() == {"start": 0, "length": 30, "period": 1}
    assert out[2][4] == "na hey" and out[0][2:] == (0, [], "") and out[4][4] == "a b"
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_plain_version(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        s = {x: k for k, x in enumerate(dict.fromkeys(w))}
        ids = [s[x] for x in w]
        runs = plain_runs(ids) if n <= 1500 else [tuple(x) for x in find_runs(np.array(ids)).tolist()]
        gone = {i for a, length, p in runs for i in range(a + p, a + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        text = "".join(f"{a},{length},{p}\n" for a, length, p in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[r["doc_id"]] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                             hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    got = op13_periodic_runs(spark, SF)
    assert {t for c, t in got.dtypes if c in ("n_runs", "start", "length", "period", "exponent_milli")} == {"bigint"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_planting_leaves_odd_rows(spark):
    chosen = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    other = next(i for i in range(2000) if i not in chosen)
    rows = [(None, "a  b"), (other, " x\ty "), (chosen[0], None), (chosen[1], " "), (chosen[2], "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own"))
    assert dict(map(tuple, planted(docs).collect())) == dict(rows)
