"""Operator 9: mix sources to target weights by weighted fair queueing, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MAX_REPEATS = 3      # a source gives at most so many times its size
SALTS = 16
BUCKETS = 1024       # slices of a source's order, and of the queue up to virtual time 1
LAST_STEP = 16 * BUCKETS  # later times share a slice; the cut hardly ever gets there


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t\\n\\x0b\\f\\r; a null text has none.

    Each such run is one place where a non-white character follows a white one, once
    the text has a space in front: the text's marks for it are counted by length."""
    flat = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.regexp_count(flat, F.lit(" [^ ]")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources from rows (source, size): source, source_size, target.

    Sources in code point order, null last, weigh ``weights`` in turn.  Targets are
    in proportion to the weights and add up to all sizes, but none is above
    ``repeats`` times its source's size; what that cuts off goes to the others by
    weight, until none is above.  In the order of size over weight the capped
    sources come first, so running sums find them in one go: a source is capped
    when its cap over its weight is at most what the sources from it on would get
    a unit of weight.  Works on one row per source, after the aggregation."""
    s = sizes.groupBy("source").agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source")))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((rank - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w.cast("long"))
    cap = F.col("source_size") * F.lit(repeats)
    by = W.orderBy(F.col("source_size") / F.col("w"), F.col("w"),
                   F.col("source").isNull(), F.col("source"))
    run, everyone = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everyone))
         .withColumn("free", F.col("total") - F.coalesce(F.sum(cap).over(run), F.lit(0)))
         .withColumn("share", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(run), F.lit(0)))
         .withColumn("capped", (cap * F.col("share") <= F.col("free") * F.col("w")).cast("int"))
         # once a source is not capped, none after it is
         .withColumn("capped", F.min("capped").over(by.rowsBetween(W.unboundedPreceding, 0))))
    first = F.max(F.when(F.col("capped") == 0, F.struct("share", "free"))).over(everyone)
    return s.withColumn("first", first).select(
        "source", "source_size", "total",
        F.when(F.col("capped") == 1, cap.cast("double")).otherwise(
            F.col("first.free").cast("double") * F.col("w") / F.col("first.share")
        ).alias("target"))


def shuffle_key(doc_id: Column, seed: int = 0) -> Column:
    """A document's place in its source's shuffled order: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
        doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str,
             out: str, below: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with each row in (bucket, order) within
    ``keys`` (not null).  Buckets are summed first; only a bucket's rows meet in a task.
    With ``below``, buckets before which the sum has reached that column are left out."""
    extra = [F.first(below).alias(below)] if below else []
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__s"), *extra)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    if below:
        sums = sums.filter(F.col("__off") < F.col(below))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (df.join(sums.select(*keys, bucket, "__off"), [*keys, bucket])
            .withColumn(out, F.col("__off") + F.sum(value).over(inside)).drop("__off"))


def _cumulated(d: DataFrame) -> DataFrame:
    """Add ``cum``: the sum of ``size`` up to and with each row within ``name``, in the order
    of (key, doc_id, size).

    Rows equal in all of these are interchangeable, so they are counted by salt first and
    only the counts are put in order; then each row finds its place in its salt's run.  A
    slice's task has one row per different (doc_id, size) and salt, however often it comes."""
    group = ["name", "slice", "key", "id", "size", "salt"]
    d = d.withColumn("id", F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("")))
    runs = (d.groupBy(*group).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
            .withColumn("words", F.col("n") * F.col("size")))
    runs = _running(runs, ["name"], "slice", ["key", "doc_id", "size", "salt"], "words", "end")
    nth = F.row_number().over(W.partitionBy(*group).orderBy("key"))
    return (d.withColumn("nth", nth).join(runs.select(*group, "n", "end"), group)
            .withColumn("cum", F.col("end") - (F.col("n") - F.col("nth")) * F.col("size"))
            .drop("id", "salt", "nth", "n", "end"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS,
        seed: int = 0, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Each source's documents, in a shuffled order fixed by ``seed`` and repeated up to
    ``repeats`` times, get a virtual finish time: the source's words up to and with
    the document over the source's target.  All are queued by that time, and the
    queue is cut where its words reach the total of all sizes, to the nearest
    document; ``copies`` says how often the document is taken before the cut.

    Running sums go by slices (of the shuffled order within a source, of virtual time
    in the queue), so neither a source that owns most rows nor the queue meets in one
    task, and rows that share one doc_id (or have none) are dealt over salts.  Documents without words take part with no copies; ties in time go by
    source, round and order; repeated rows count each; an empty table gives no rows.
    ``keep`` names further columns that come along as kept_0, kept_1, ..."""
    from ..operators.stage import cut
    # the words are counted once; all that follows reads these narrow rows
    d = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                        word_count(F.col(text)).alias("size"),
                        # written with the row, so that every reading deals alike
                        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
                        .cast("int").alias("salt"),
                        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]), "sizes")
    name = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("name")
    t = source_targets(d, weights, repeats).select(name, "source_size", "total", "target")
    # a source that owns most rows is dealt over SALTS keys of the join
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = (d.select("*", name).join(t, ["name", "salt"])
         .withColumn("key", shuffle_key(F.col("doc_id"), seed))
         .withColumn("slice", F.shiftrightunsigned("key", 60 - (BUCKETS - 1).bit_length())))
    d = cut(_cumulated(d), "queue")

    def place(round_: Column) -> list[Column]:
        """Place in the queue of a document's copy in a round."""
        finish = (round_ * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")
        return [finish.alias("finish"), F.col("source").isNull().alias("last"), F.col("name"),
                round_.alias("round"), F.col("cum"), F.col("key"), F.col("doc_id")]

    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    q = (d.filter(F.col("size") > 0).select("*", rounds.alias("r"))
         .select("size", "total", *place(F.col("r"))))
    order = q.columns[2:]
    step = F.least(F.floor(F.col("finish") * BUCKETS), F.lit(LAST_STEP))
    q = _running(q.withColumn("step", step), [], "step", order, "size", "queued", below="total")
    end = (q.filter(2 * F.col("queued") - F.col("size") <= 2 * F.col("total"))
           .agg(F.max(F.struct(*order)).alias("end")).first()["end"])  # one row
    kinds = {f.name: f.dataType for f in q.schema}
    until = None if end is None else F.struct(*[F.lit(end[c]).cast(kinds[c]).alias(c) for c in order])
    copies = F.lit(0)
    for r in range(repeats if end else 0):
        copies = copies + F.when((F.col("size") > 0) & (F.struct(*place(F.lit(r))) <= until), 1).otherwise(0)
    return d.withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"kept_{i}").alias(f"kept_{i}") for i, _ in enumerate(keep)])
