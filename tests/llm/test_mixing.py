"""Operator 9 against a plain queue."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from elotrail.llm.mixing import mix, source_targets, word_count

WEIGHTS = (5, 2, 1)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3 * sizes[s] for s in over})


def plain_mix(rows):
    sizes, docs = {}, {}
    for i, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        key = int(hashlib.md5(f"0:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
        docs.setdefault(s, []).append((key, i, n))
    target, queue = plain_targets(sizes), []
    for s, own in docs.items():
        for turn in range(3):
            at = turn * sizes[s]
            for key, i, n in sorted(own):
                at += n
                if n:
                    queue.append((at / target[s], s is None, s or "", turn, at - turn * sizes[s], key, i, n))
    taken, at, total = {}, 0, sum(sizes.values())
    for *_, i, n in sorted(queue):
        at += n
        if 2 * at - n <= 2 * total:
            taken[i] = taken.get(i, 0) + n
    return target, taken


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "c", "d", None, "a", "a", "a"]), rng.choice([0, 1, 5, 20, 100]))
            for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_a_plain_queue(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, s, "w " * n if n else None, 9) for i, s, n in rows],
                                 "doc_id long, source string, text string, size int").repartition(5)
    target, taken = plain_mix(rows)
    out = {r["doc_id"]: r for r in mix(docs).collect()}
    for i, s, n in rows:
        assert out[i]["size"] == n and out[i]["taken"] == taken.get(i, 0) <= 3 * n
        assert out[i]["target"] == pytest.approx(target[s])
    for s, t in target.items():
        assert abs(sum(taken.get(i, 0) for i, x, _ in rows if x == s) - t) <= 100


def test_targets_with_a_hot_and_an_empty_source(spark):
    sizes = {"hot": 9000, "small": 10, "none": 0, None: 40, "b": 500}
    out = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    want = plain_targets(sizes)
    assert {r["source"]: r["target"] for r in out.collect()} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_words(spark):
    texts = {"": 0, "a": 1, " a ": 1, "a b": 2, "\ta\x0bb\x0cc\r\nd ": 4, "é\u00a0x y": 2, "\x1ca": 1}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", word_count(F.col("t")).alias("n")).collect()} == {
        **texts, None: 0}


def test_repeated_rows_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x y")] * 3 + [(None, "a", "z"), (2, None, None)],
                                 "doc_id long, source string, text string")
    out = mix(docs).collect()
    assert len(out) == 5 and sum(r["taken"] for r in out) == 7
    assert mix(docs).collect() == mix(docs.repartition(3)).select("*").collect() or sorted(
        map(str, out)) == sorted(map(str, mix(docs.repartition(3)).collect()))
    assert mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mix(docs.filter("doc_id = 2")).collect()] == [0]


def test_a_hot_or_null_doc_id_does_not_meet_in_one_task(spark, monkeypatch):
    from elotrail.llm import mixing
    met, running = [], mixing._running

    def watched(df, keys, bucket, *args, **kw):
        met.append(df.groupBy(*keys, bucket).count().agg(F.max("count")).first()[0])
        return running(df, keys, bucket, *args, **kw)

    monkeypatch.setattr(mixing, "_running", watched)
    rng = random.Random(7)
    rows = [(rng.choice([None, 7]), "a", rng.choice([1, 5])) for _ in range(3000)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows],
                                 "doc_id long, source string, text string").repartition(4)
    got = {}
    for r in mix(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["taken"]
    assert met[0] <= 2 * mixing.SALTS  # two sizes of an id
    assert got == plain_mix(rows)[1]
