"""Statistics over aggregated frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile for confidence intervals.
Z95 = 1.96


def share(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """100 * value / total.  Only for already-aggregated frames with a
    handful of rows (brackets, events, bands): the total is a window over all
    of them, so the input is computed once."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, F.lit(100.0) * F.col(value) / total)


def mean_ci(df: DataFrame, by: list[str], value: str, z: float = Z95) -> DataFrame:
    """Mean with a normal-approximation confidence interval per group.

    (A plotting library would bootstrap; the normal interval needs only
    count / mean / stddev, all partial aggregates.)"""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"),
                            F.stddev_samp(value).alias("_sd"),
                            F.count(value).alias("n"))
    half = F.lit(z) * F.col("_sd") / F.sqrt(F.col("n"))
    return g.select(*by, "mean", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"), "n")


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin).

    Integer arithmetic, so bin edges are exact; min / max are scalar
    sub-queries (one extra pass over the input, no join)."""
    ext = df.select(F.struct(F.min(col).alias("mn"), F.max(col).alias("mx"))).scalar()
    mn, mx = ext["mn"], ext["mx"]
    width = mx - mn
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(col) - mn) * bins / width) + 1, F.lit(bins)))
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return _all_bins(counts, bins).select("bin", (mn + (F.col("bin") - 1) * width / F.lit(float(bins)))
                         .cast("double").alias("lower"),
                         (mn + F.col("bin") * width / F.lit(float(bins))).cast("double")
                         .alias("upper"), "n")


def _all_bins(counts: DataFrame, bins: int) -> DataFrame:
    """Counts (bin, n) with the empty bins of 1 to ``bins``; none if there are no counts."""
    every = F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    some = counts.agg(F.count(F.lit(1)).alias("c")).filter("c > 0").select(every)
    return some.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def log_ecdf(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Log-spaced bins between min and max, cumulative share of rows.

    The running sum is over at most ``bins`` aggregated rows."""
    lx = F.log10(F.col(col))
    pos = df.filter(F.col(col) > 0)
    ext = pos.select(F.struct(F.min(lx).alias("lo"), F.max(lx).alias("hi"),
                              F.count(F.lit(1)).alias("n"))).scalar()
    lmn, lmx, total = ext["lo"], ext["hi"], ext["n"]
    b = F.when(lmx == lmn, F.lit(1)).otherwise(
        F.least(F.floor(F.lit(float(bins)) * (lx - lmn) / (lmx - lmn)) + 1, F.lit(bins)))
    counts = pos.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return _all_bins(counts, bins).select("bin", "n", (F.sum("n").over(w) / total).alias("cum_share"))


def hex_bins(df: DataFrame, x: str, y: str, gridsize: int = 50, log_x: bool = True) -> DataFrame:
    """Hexagonal-grid counts (two offset lattices, nearest centre);
    extent = data min / max of each axis."""
    xv = F.log10(F.col(x)) if log_x else F.col(x).cast("double")
    yv = F.col(y).cast("double")
    pts = df.select(xv.alias("_x"), yv.alias("_y")).dropna()
    # The grid extent is four numbers: fetched once (a bounded action) and
    # used as literals, so the per-row arithmetic stays a flat expression.
    ext = pts.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    x0, x1, y0, y1 = [float(v) if v is not None else 0.0 for v in ext]
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    sx = (x1 - x0) / nx if x1 > x0 else 1.0
    sy = (y1 - y0) / ny if y1 > y0 else 1.0
    gx, gy = (F.col("_x") - F.lit(x0)) / F.lit(sx), (F.col("_y") - F.lit(y0)) / F.lit(sy)
    ix1, iy1 = F.bround(gx, 0), F.bround(gy, 0)
    ix2, iy2 = F.floor(gx), F.floor(gy)
    d1 = (gx - ix1) * (gx - ix1) + 3.0 * (gy - iy1) * (gy - iy1)
    d2 = (gx - ix2 - 0.5) * (gx - ix2 - 0.5) + 3.0 * (gy - iy2 - 0.5) * (gy - iy2 - 0.5)
    first = d1 < d2
    cell = pts.select(
        F.when(first, 1).otherwise(2).alias("lattice"),
        F.when(first, ix1).otherwise(ix2).cast("int").alias("ix"),
        F.when(first, iy1).otherwise(iy2).cast("int").alias("iy"))
    off = F.when(F.col("lattice") == 1, 0.0).otherwise(0.5)
    return (cell.groupBy("lattice", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
            .select("lattice", "ix", "iy",
                    (F.lit(x0) + (F.col("ix") + off) * sx).alias("x_centre"),
                    (F.lit(y0) + (F.col("iy") + off) * sy).alias("y_centre"), "n"))


def marginals(df: DataFrame, x: str, y: str, gridsize: int = 50, log_x: bool = True) -> DataFrame:
    """The counts along each axis of the hexagonal grid: (axis, bin, lower, n), in
    cells of its width (x) and height (y) from the smallest value on."""
    xv = F.log10(F.col(x)) if log_x else F.col(x).cast("double")
    pts = df.select(xv.alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    ext = pts.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()  # four numbers
    out = None
    for axis, n, lo, hi in (("x", gridsize, ext[0], ext[1]),
                            ("y", int(gridsize / math.sqrt(3)), ext[2], ext[3])):
        lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
        step = (hi - lo) / n if hi > lo else 1.0
        cell = F.least(F.floor((F.col(f"_{axis}") - F.lit(lo)) / F.lit(step)), F.lit(n - 1))
        part = (pts.groupBy(cell.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(axis).alias("axis"), "bin",
                        (F.lit(lo) + F.col("bin") * F.lit(step)).alias("lower"), "n"))
        out = part if out is None else out.unionByName(part)
    return out


def snap_nearest(x: Column, targets: list[float]) -> Column:
    """The element of ``targets`` nearest to x; a tie goes to the earlier one."""
    arr = F.array(*[F.lit(float(t)) for t in targets])
    best = F.array_min(F.transform(arr, lambda v, i: F.struct(F.abs(v - x).alias("d"),
                                                              i.alias("i"), v.alias("v"))))
    return F.when(x.isNotNull(), best["v"])


def quantile_bin(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """Pandas ``qcut(x, n, labels=False)`` -- right-closed bins between
    exact quantile edges; bin = number of inner edges strictly below x.

    The edges are one exact ``percentile`` aggregate over ``df``; use on
    aggregated frames (here: at most 7 x 1440 weekday-minute rows)."""
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = df.select(F.percentile(F.col(col), probs)).scalar()
    e = df.withColumn("_qb_edges", edges)
    below = [(F.element_at(F.col("_qb_edges"), i) < F.col(col)).cast("int") for i in range(1, n)]
    total = below[0]
    for b in below[1:]:
        total = total + b
    return e.withColumn(out, total.cast("int")).drop("_qb_edges")


def rank0(df: DataFrame, value: str, tie: str, out: str = "rank") -> DataFrame:
    """0-based ascending rank (argsort of argsort); ties by ``tie``.
    Only over small aggregated frames."""
    return df.withColumn(out, (F.row_number().over(Window.orderBy(value, tie)) - 1).cast("int"))
