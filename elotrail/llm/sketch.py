"""Operator 6: threshold-scaled document fingerprints, natively.

A text's words (runs other than white space) give shingles of ``SHINGLE`` words
(fewer words: all of them); a shingle's hash is kept when it is below a fixed
fraction of the hash range, so the sketch of a union is the union of sketches,
and the share of one text's kept hashes found in another's estimates containment
whatever the two sizes.  So that short texts have hashes to compare, a sketch
keeps at least the ``LEAST`` smallest; two sketches are compared below the smaller of
the limits up to which each is whole.  Likenesses follow from the two fingerprints alone.  Of
a text of n shingles that lies whole in a long one, nothing is left below the fixed limit
(containment 0) with probability (1 - 1 / SCALE) ** n: 6 % at 10 shingles, 0.3 % at 20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slots, text_of

SHINGLE = 5
SCALE = 4    # one shingle of so many is kept
LEAST = 32   # hashes that a sketch keeps at least, where the text has them
FULL = (1 << 63) - 1


def add_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, scale: int = SCALE,
               least: int = LEAST) -> DataFrame:
    """Add ``out``: struct(limit, hashes), the sorted different hashes not above ``limit``.

    Hashes are xxHash64 over the hashes of a shingle's words, without the sign bit.
    ``limit`` is the fixed threshold; for a text with too few hashes below it, its
    ``least``-th smallest hash, or the full range if it has no more.  A null text or
    one without words has no hashes."""
    top = F.lit(FULL // scale - 1)
    least_ones = F.slice("__s", 1, least)
    return (_add_hashes(df, text, "__h", shingle)
          .withColumn("__k", F.array_distinct(F.filter("__h", lambda h: h <= top)))
          # all hashes in order, only where the ones below the threshold are too few
          .withColumn("__s", F.when(F.size("__k") < least, F.sort_array(F.array_distinct("__h"))))
          .withColumn(out, F.when(F.col("__s").isNull(), F.struct(
              top.alias("limit"), F.sort_array("__k").alias("hashes")))
              .otherwise(F.struct(
                  F.when(F.size("__s") > least, F.element_at(least_ones, -1))
                  .otherwise(F.lit(FULL)).alias("limit"), least_ones.alias("hashes"))))
          .drop("__h", "__k", "__s"))


def _add_hashes(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Add ``out``: the hashes of all shingles of a text, as they come."""
    words = F.filter(F.split(F.translate(text_of(text), "\t\n\x0b\f\r", "     "), " "),
                     lambda w: w != "")
    at = lambda i: F.get("__w", i)
    long_ = F.transform(F.sequence(F.lit(0), F.size("__w") - shingle), lambda i: F.xxhash64(
        *[at(i + k) for k in range(shingle)]).bitwiseAND(F.lit(FULL)))
    short = F.transform(F.array(F.col("__w")), lambda w: F.xxhash64(w).bitwiseAND(F.lit(FULL)))
    none = F.array().cast("array<bigint>")
    return (df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
            .withColumn(out, F.when(F.size("__w") >= shingle, long_)
                        .when(F.size("__w") > 0, short).otherwise(none)).drop("__w"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1.

    Both sketches are cut to the smaller limit.  1 if both texts have no words; 0 if
    one has none, or nothing of ``a`` is left below the limit."""
    limit = F.least(a["limit"], b["limit"])
    x = F.filter(a["hashes"], lambda h: h <= limit)
    both = F.size(F.array_intersect(x, b["hashes"]))
    return (F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), F.lit(1.0))
            .when(F.size(x) == 0, F.lit(0.0)).otherwise(both / F.size(x)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), F.sort_array(F.filter(
        F.array_union(a["hashes"], b["hashes"]), lambda h: h <= limit)).alias("hashes"))


def as_string(s: Column) -> Column:
    """limit:hash,hash,... in hexadecimal; equal for equal texts."""
    digits = lambda h: F.lower(F.hex(h))
    return F.concat(digits(s["limit"]), F.lit(":"), F.array_join(F.transform(s["hashes"], digits), ","))


def next_documents(docs: DataFrame) -> DataFrame:
    """For rows (doc_id, h, n_chars), one per different (doc_id, h), the document before each
    in order of (doc_id, h), null ids first; before the first comes the last.  Both are
    given as structs (doc_id, h), which are equal where both ids are null.

    Only these narrow rows are put in order (see ``slots``: no single task has them all)."""
    d = slots(docs.distinct().withColumn("__all", F.lit(0)), "__all", ["doc_id", "h"], "pos")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    key = F.struct("doc_id", "h")
    after = d.select((F.col("pos") + 1).alias("p"), key.alias("prev"), F.col("n_chars").alias("prev_chars"))
    last = n.first()["n"]
    after = after.withColumn("p", F.when(F.col("p") == last, F.lit(0)).otherwise(F.col("p")).cast("long"))
    return (d.join(after, F.col("pos") == F.col("p"))
            .select(key.alias("of"), "prev", "prev_chars"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of each row.

    The edited text is the text with its last quarter of characters replaced by the
    first as many of the next document in ascending (doc_id, hash of the text); rows
    that repeat a document share one place there, and one document follows itself; no
    documents give no rows.  Null texts are empty; other columns are not looked at.
    ``near_*`` is the estimated containment of the document's fingerprint in the other one.
    The texts are shuffled once and sketched behind that; a document's head, at most a quarter of
    its predecessor's length, and its sketch are sent to the row it follows."""
    text_ = text_of(text)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_.alias("text"),
                    F.xxhash64(text_).alias("h"))
    order = next_documents(d.select("doc_id", "h", F.length("text").cast("long").alias("n_chars")))
    # one key without nulls: joins and the group share a partitioning, so the texts and
    # what follows them are shuffled once each
    d = d.select("text", F.struct("doc_id", "h").alias("key"))
    heads = d.join(order, F.col("key") == F.col("of"))
    heads = (add_sketch(heads, "text", "own").select("prev", F.struct(
        F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"),
        F.col("own").alias("next")).alias("follows"))
        .groupBy("prev").agg(F.first("follows").alias("follows")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    e = (d.join(heads, F.col("key") == F.col("prev"))
         .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), "follows.head"))
         .select("key.doc_id", n.cast("long").alias("n_chars"), "text", "edited", "follows.next"))
    e = add_sketch(add_sketch(e, "text", "own"), "edited", "other")
    own, other = F.col("own"), F.col("other")
    return e.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    as_string(own).alias("fingerprint"), as_string(other).alias("edited_fingerprint"),
                    containment(own, other).alias("near_edited"),
                    containment(own, F.col("next")).alias("near_next"))
