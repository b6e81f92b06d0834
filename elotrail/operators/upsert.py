"""K3/K4: idempotent inserts -- first writer wins, also inside one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import cut


def first_per_key(df: DataFrame, key: str, order_cols) -> DataFrame:
    """Keep the earliest row (by ``order_cols``) of every key.

    ``min_by`` over a struct in one groupBy: partial aggregation map-side,
    so even a key repeated millions of times is one row per task."""
    order_cols = list(order_cols)
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
    return agg.select(key, "_r.*").select(*df.columns)


def upsert_ignore(new: DataFrame, existing: DataFrame | None, key: str,
                  order_cols) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows of ``new`` whose key is not yet in
    ``existing``, first occurrence per key.

    The key is global: a row may come back under another month, so the
    anti-join looks at the key column (and nothing else) of all of
    ``existing``, not only at the partitions the batch touches."""
    batch = first_per_key(new, key, order_cols)
    if existing is None:
        return batch
    return batch.join(existing.select(key), key, "left_anti")


def upsert_ignore_near(new: DataFrame, existing: DataFrame, key: str, order_cols,
                       partition: str) -> DataFrame:
    """As ``upsert_ignore``, against a table stored by ``partition``; ``new`` is a written table
    too, and ``order_cols`` tell the rows of a key apart.

    A row that comes back mostly comes back under its partition value, so the keys of the
    partitions that the batch touches are looked at first; they are pruned at the scan.
    Only where keys are left do they meet the keys of the other partitions.  A load that
    brings nothing new reads no more as the table grows.

    All of this is worked out on keys and order alone and written (``cut``), down to the rows
    that are left out.  Whole rows meet only those: few in a load of new rows, so that the
    session's broadcast limit mostly spares their shuffle."""
    order_cols = list(order_cols)
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # months: a few hundred
    here = F.col(partition).isin(touched)
    # one column is a minimum by hash, a struct would be one by sorting
    least = F.min(F.struct(*order_cols) if len(order_cols) > 1 else order_cols[0])
    first = new.groupBy(key).agg(least.alias("_first"))
    unknown = cut(first.join(existing.filter(here).select(key), key, "left_anti"), "unknown")
    if unknown.isEmpty():
        return new.limit(0)
    fresh = cut(unknown.join(existing.filter(~here).select(key), key, "left_anti"), "new-keys")
    fresh = fresh.select(F.col(key).alias("_key"), *[
        (F.col(f"_first.{c}") if len(order_cols) > 1 else F.col("_first")).alias(f"_{c}") for c in order_cols])

    def without(rows: DataFrame, other: DataFrame) -> DataFrame:
        same = F.col(key).eqNullSafe(F.col("_key"))
        for c in order_cols:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return rows.join(other, same, "left_anti")

    left_out = cut(without(new.select(key, *order_cols), fresh), "left-out").toDF(*fresh.columns)
    return without(new, left_out)
