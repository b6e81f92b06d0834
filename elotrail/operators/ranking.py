"""Order statistics that stay distributed.

A window ``partitionBy(group).orderBy(x)`` puts a whole group into one task.
With few groups (8 rating bands, or one global order) that is one task for
the whole data set.  Instead, rows are range-partitioned on (group, order):
every task ranks its own slice, and a small table of per-slice totals
(at most #partitions + #groups rows) supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import cut

_PID = "_rk_pid"


def cumulative_before(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      weight_col: str | None = None, num_partitions: int | None = None,
                      small_groups: bool = True) -> DataFrame:
    """Add ``_before`` (sum of weights of rows strictly earlier in the group's
    order) and ``_total`` (group total).  Weight defaults to 1 (row positions).

    ``order_cols`` must order the rows of a group totally (unique), e.g.
    distinct (band, value) pairs, or a unique record ordinal.
    ``small_groups`` states that the number of groups is bounded (bands,
    one global group); the offset table is then broadcast.
    """
    w = F.col(weight_col) if weight_col else F.lit(1)
    keys = [*group_cols, *order_cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = (df.withColumn("_rk_w", w.cast("long"))
         .repartitionByRange(n, *keys)
         .withColumn(_PID, F.spark_partition_id()))
    # The range bounds come from a sample; evaluated twice (running sums and
    # slice totals) they could differ.  Writing the sliced rows once, slice id
    # included, makes both sides read the same assignment (and cuts lineage).
    r = cut(r, "rank-slices")
    # Running sum inside a slice: the window partition is (slice, group), so
    # no task ever holds more than one range slice.
    local_w = (Window.partitionBy(_PID, *group_cols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = r.withColumn("_rk_local", F.coalesce(F.sum("_rk_w").over(local_w), F.lit(0)))
    slices = r.groupBy(_PID, *group_cols).agg(F.sum("_rk_w").alias("_rk_pw"))
    by_group = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    offs = slices.select(
        _PID, *group_cols,
        F.coalesce(F.sum("_rk_pw").over(by_group.orderBy(_PID).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_pw").over(by_group).alias("_total"))
    if small_groups:
        offs = F.broadcast(offs)  # bounded: #partitions x #groups rows
    out = local.join(offs, [_PID, *group_cols], "inner")
    return (out.withColumn("_before", F.col("_rk_off") + F.col("_rk_local"))
            .drop(_PID, "_rk_w", "_rk_local", "_rk_off"))


def average_rank_pct(df: DataFrame, group_cols: list[str], value_col: str,
                     out_col: str = "percentile") -> DataFrame:
    """Pandas ``groupby(g)[v].rank(pct=True)`` (average method, NULLs kept NULL).

    Ties are first collapsed to (group, value, count) -- map-side, so a hot
    value (many players with net change 0) is one row -- then ranked with
    :func:`cumulative_before`, then joined back on (group, value).  AQE's
    skew join splits the hot value's partition on the probe side.
    """
    valued = df.filter(F.col(value_col).isNotNull())
    ties = valued.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = cumulative_before(ties, group_cols, [value_col], "_ties")
    pct = ranked.select(*group_cols, value_col,
                        ((F.col("_before") + (F.col("_ties") + 1) / 2.0) / F.col("_total"))
                        .alias(out_col))
    return df.join(pct, [*group_cols, value_col], "left")


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group (numpy / pandas default,
    ``percentile_cont``), one output column per entry of ``probs``.

    Values are collapsed to (group, value, count) first, ranked by range
    slices, and only the rows holding the needed order statistics survive
    the filter -- no group is ever gathered in one task.
    """
    counts = (df.filter(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c")))
    ranked = cumulative_before(counts, group_cols, [value_col], "_c")
    lo_hi = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        start, end = F.col("_before"), F.col("_before") + F.col("_c")
        lo_hi += [
            F.when((start <= lo) & (lo < end), F.col(value_col)).alias(f"_{name}_lo"),
            F.when((start <= hi) & (hi < end), F.col(value_col)).alias(f"_{name}_hi"),
            (h - lo).alias(f"_{name}_frac")]
    picked = ranked.select(*group_cols, *lo_hi)
    conds = [F.col(f"_{n}_lo").isNotNull() | F.col(f"_{n}_hi").isNotNull() for n in probs]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    aggs = []
    for name in probs:
        lo_v, hi_v = F.max(f"_{name}_lo"), F.max(f"_{name}_hi")
        frac = F.max(f"_{name}_frac")
        aggs.append((lo_v + frac * (hi_v - lo_v)).cast("double").alias(name))
    g = picked.filter(cond)
    return g.groupBy(*group_cols).agg(*aggs) if group_cols else g.agg(*aggs)
