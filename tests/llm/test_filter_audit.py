"""Filter interaction audit against chains that are run one after another."""

import random
from itertools import permutations

import pytest

from elotrail.llm.filter_audit import OUTCOMES, audit, audit_documents, packed_outcomes, unpack

LABELS = "doc_id long, quality int, toxic int"


def chains(docs, labels):
    """Plain version: every order is run over the documents of a part."""
    marks = {}
    for d, q, t in (x for x in labels if x[0] is not None):
        g, x = marks.get(d, (False, False))
        marks[d] = (g or q == 1, x or t == 1)
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = {}
    for d, text, source in docs:
        t = text or ""
        words = t.replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                  "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                  "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        parts.setdefault(source or "", []).append((failed, *marks.get(d, (False, False))))
    out, gone_by = {}, {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                fails = sum(r[0][f] for r in rows)
                gone_by[part, f] = gone_by.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone),
                    sum(r[0][f] and sum(r[0].values()) == 1 for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, gone_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(report):
    rows = [r.asDict() for r in report.collect()]
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in OUTCOMES) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_chains_run_in_turn(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÄÖ", "漢字", "Ünit"]
    texts = [None, "", " \n\t", "A" * 50, "x " * 300, "a|b", "hot text of many rows " * 60]
    for _ in range(40):
        n = rng.choice([3, 150, 199, 200, 260, 700])
        words = rng.choices(vocabulary[:rng.choice([20, 400])], k=n)
        if rng.random() < .4:
            words = [w.upper() if rng.random() < .1 else w for w in words]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", " 5%", "#"]))
    docs = [(i, rng.choice(texts) if rng.random() < .7 else texts[6], rng.choice(["s0", "s0", "s1", "", None]))
            for i in range(200)]
    docs += [(None, texts[6], "s0"), (None, "only here", "s1"), docs[7], docs[7], (docs[9][0], docs[9][1], "other")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(220), 150)]
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for c in ("mask", "part", "id", "n", "good", "first", "salt"):  # clashing names
        from pyspark.sql import functions as F
        frame = frame.withColumn(c, F.lit("own"))
    got = as_dict(audit_documents(frame, spark.createDataFrame(labels, LABELS)))
    assert got == chains(docs, labels)


def test_empty_and_single(spark):
    schema = "doc_id long, text string, source string"
    none = spark.createDataFrame([], LABELS)
    assert audit_documents(spark.createDataFrame([], schema), none).count() == 0
    one = as_dict(audit_documents(spark.createDataFrame([(1, None, None)], schema), none))
    assert len(one) == 600 and one["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120)


def test_very_long_text(spark):
    docs = [(1, " ".join(f"w{i}" for i in range(1_000_000)), "s"), (2, "Zz " * 1_000_000, "s")]
    got = as_dict(audit_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"),
                                  spark.createDataFrame([], LABELS)))
    assert got == chains(docs, [])


@pytest.mark.parametrize("k", [1, 3])
def test_other_numbers_of_filters(spark, k):
    rows = [("p", m, False, False) for m in range(1 << k) for _ in range(m + 1)]
    got = as_dict(audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), "XYZ"[:k]))
    for order in permutations("XYZ"[:k]):
        left = rows
        for step, f in enumerate(order, 1):
            left = [r for r in left if not r[1] >> "XYZ".index(f) & 1]
            assert got["p", "".join(order), step][0] == len(left)


def test_fields_do_not_overflow():
    """Sums as large as rows can be counted stay inside their fields."""
    packed = packed_outcomes(5)
    n = (1 << 62) - 1
    total = unpack(sum(n * p for p in packed[1:2]), 600)
    assert set(total.tolist()) == {0, n} and (total == n).sum() == 120
