"""Operator 12: how filters interact, by wide packed counters.

A document that a chain of filters removes goes at the first filter of the chain that it
fails.  So the mask of the filters it fails fixes its outcome in every step of every order:
each mask is mapped to one integer whose fields, one for each (order, step), hold 1 where the
document is removed and 0 elsewhere (600 fields for five filters).  Integers add up field by
field; the fields of a part's sum are its counts.  A field has 64 bits, more than any count
of rows needs, so no field overflows into the next.  What else is asked follows from the
fields: kept is the total less what went so far, a filter's failures are what it removes as
the first, its unique failures what it removes as the last.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import cut
from .common import UPPER, text_of

FIELD = 8  # bytes of a field
FILTERS = "ABCDE"
SPACE = r"[ \t-\r]+"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def packed_outcomes(k: int) -> list[int]:
    """The integer of each mask of ``k`` filters (bit i: it fails filter i); field
    ``order * k + step`` is 1 where the document is removed."""
    out = []
    for mask in range(1 << k):
        fields = np.zeros(0, "<u8")
        if mask:
            fields = np.array([[j == next(i for i in order if mask >> i & 1) for j in order]
                               for order in permutations(range(k))], "<u8").ravel()
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpack(total: int, fields: int) -> np.ndarray:
    """The fields of a sum of such integers."""
    return np.frombuffer(total.to_bytes(fields * FIELD, "little"), "<u8").astype(np.int64)


def audit_rows(counts: list[dict], names: str) -> dict[str, list]:
    """The report of one part from its counts of rows by (mask, good, toxic)."""
    k = len(names)
    packed = packed_outcomes(k)
    orders = list(permutations(range(k)))
    total, sums = 0, {"all": 0, "good": 0, "toxic": 0}
    for c in counts:
        total += c["n"]
        whole = c["n"] * packed[c["mask"]]  # n equal integers added up
        sums["all"] += whole
        sums["good"] += whole * c["good"]
        sums["toxic"] += whole * c["toxic"]
    removed, good, toxic = (unpack(sums[x], len(orders) * k).reshape(-1, k) for x in ("all", "good", "toxic"))
    at = np.array(orders)
    fails, unique, shapley = (np.zeros(k, np.int64) for _ in range(3))
    for i in range(k):
        fails[i] = removed[at[:, 0] == i, 0][0]
        unique[i] = removed[at[:, -1] == i, -1][0]
        shapley[i] = removed[at == i].sum()
    values = {"kept": total - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails[at] - removed,
              "unique_fails": unique[at], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[at]}
    return {"filter_order": ["".join(names[i] for i in o) for o in orders for _ in range(k)],
            "step": [*range(1, k + 1)] * len(orders),
            **{n: values[n].ravel().tolist() for n in OUTCOMES}}


def audit(masks: DataFrame, names: str) -> DataFrame:
    """Report of rows (part, mask, good, toxic): one row for each part, order and step.

    Rows are counted by mask first, at most 4 * 2^k of them for a part, so that neither a hot
    part nor the number of rows is felt where the integers are added up.  No rows, no report."""
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return report(counts, names)


def report(counts: DataFrame, names: str) -> DataFrame:
    """As ``audit``, of counted rows (part, mask, good, toxic, n)."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES)

    def of_part(t: pa.Table) -> pa.Table:
        rows = audit_rows(t.to_pylist(), names)
        part = pa.array([t["part"][0].as_py()] * len(rows["step"]), pa.string())
        types = {"filter_order": pa.string(), "step": pa.int32()}
        return pa.table({"part": part, **{c: pa.array(v, types.get(c, pa.int64())) for c, v in rows.items()}})

    return counts.groupBy("part").applyInArrow(of_part, schema)


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text alone fails.  A: under 200 words; B: under half of the
    words are different; C: over 2 % capital letters A-Z; D: one of # $ % & * |."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text),
              text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for i, f in enumerate(failed):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of the five filters over whole texts; E: equal to the text of a smaller doc_id.

    Null text: empty; null source: part ''.  A null doc_id is smaller than none and larger than
    none, has no label and never fails E; rows that repeat a doc_id and its text fail E alike.  A
    document is good or toxic if any of its labels says so.  Other columns are not read, whatever
    their names.  An empty table gives no rows.

    Texts are read once; texts are equal if their SHA-256 is.  Only narrow rows move: the first id
    of each text is a partial minimum (copies of one text meet as one row a task), and it meets the
    rows again under (text, id), counted before, so a text that a third of the rows hold does not
    gather anywhere."""
    text = text_of()
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = cut(rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = (rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
             .withColumn("first", F.lit(True)))
    marks = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
             .withColumn("salt", F.lit(0).cast("long")))
    # rows without an id find no label: they are spread over the tasks by their text
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    known = rows.join(first, ["digest", "id"], "left").withColumn("salt", salt)
    later = F.col("id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    counts = (known.join(marks, ["id", "salt"], "left")
              .groupBy("part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"),
                       F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
              .agg(F.sum("n").alias("n")))
    return report(counts, FILTERS)
