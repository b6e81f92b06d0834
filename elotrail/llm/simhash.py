"""Operator 7: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``radius`` bits differ.  The bits are dealt
to parts; with thresholds t_i that add up to radius - parts + 1, any two linked
fingerprints differ in at most t_i bits of some part i (a threshold of -1 leaves a
part out).  Correlated bits go to the same part, the number of parts and the thresholds
are those of least estimated cost, found by dynamic programming on the counts of
candidates that a bounded sample of fingerprints shows.  Each fingerprint is then filed under
its value in each part, probes all values within the threshold, and pairs that meet are
verified in the join.  The parameters steer cost only: every choice finds all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import cut
from .common import LOWER, UPPER, text_of

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
SAMPLE = 2048          # fingerprints that the plan of parts is estimated on
PROBE_COST = 12.0      # cost of one probe, in verified pairs
CROWDED = 128          # fingerprints in a bucket from which on it is divided further
_CHUNK = 1 << 16       # shingles worked on at once
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 values."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        s, e = starts[k:min(n, k + _CHUNK)].tolist(), last[k:min(n, k + _CHUNK)].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s, e)], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer; zero for a text without words."""

    @F.arrow_udf("bigint")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            h = np.array([fingerprint(t, shingle) for t in a.to_pylist()], np.uint64)
            yield pa.array(h.view(np.int64))

    return hashes(text)


# -- plan of parts ----------------------------------------------------------------
def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the columns of a 0/1 matrix to parts of near equal width: each part grows
    around its first bit by the bits most correlated with those it has."""
    if len(bits) > 1:
        x = bits - bits.mean(axis=0)
        norm = np.sqrt((x * x).sum(axis=0))
        norm[norm == 0] = 1
        corr = np.abs((x / norm).T @ (x / norm))
    else:
        corr = np.zeros((BITS, BITS))
    left, out = list(range(BITS)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up, one per part) that add up to ``total`` at least cost, where
    ``cost[i][t + 1]`` is that of threshold t in part i: dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in now or c + x < now[s + t][0]:
                    now[s + t] = (c + x, [*ts, t])
        best = now
    return best[total]


def plan_parts(sample: np.ndarray, n: int, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each part in use, for ``n`` fingerprints like the sample's."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]
    choices = []
    for parts in range(2, radius + 2):
        groups = group_bits(bits.astype(float), parts)
        masks = [sum(1 << b for b in g) for g in groups]
        cost = []
        for g, mask in zip(groups, masks):
            v = sample & np.uint64(mask)
            near = np.zeros(radius + 1)
            for k in range(0, len(v), 256):
                d = np.bitwise_count(v[k:k + 256, None] ^ v[None, :]).ravel()
                near += np.bincount(np.minimum(d, radius + 1), minlength=radius + 2)[:radius + 1]
            near[0] -= len(v)  # a fingerprint with itself
            # half a pair stands for those that a sample of this size cannot show
            share = (np.cumsum(near) + 0.5) / max(1, len(v) * (len(v) - 1))
            row, probes = [0.0], 0
            for t in range(radius + 1):
                probes += comb(len(g), t)
                share_t = max(share[t], probes / 2.0 ** len(g))
                row.append(PROBE_COST * n * probes + n * n / 2 * share_t)
            cost.append(row)
        c, ts = allocate(cost, radius - parts + 1)
        choices.append((c, [(m, t) for m, t in zip(masks, ts) if t >= 0]))
    return min(choices)[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flipped(part: int, value: Column, flips: list[int]) -> Column:
    """All (part, value) that a fingerprint of this value probes."""
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.struct(
        F.lit(part).alias("part"), value.bitwiseXOR(f).alias("value")))


def one_bit_pairs(prints: DataFrame) -> DataFrame:
    """Pairs a < b of fingerprints (column ``fp``, distinct) that differ in one bit, by equality."""
    flips = F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)])
    more = F.filter(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f)), lambda v: v > F.col("fp"))
    return (prints.select(F.col("fp").alias("a"), F.explode(more).alias("b"))
            .join(prints.select(F.col("fp").alias("b")), "b").select("a", "b"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE,
               crowded: int = CROWDED, *, thin: bool = False) -> DataFrame:
    """Pairs a < b of different fingerprints (column ``fp``, distinct) at most ``radius`` bits apart,
    each once.

    Pairs are verified inside the join, which gives out links only.  A bucket with more than
    ``crowded`` fingerprints (near copies in thousands, or a common value) is divided: its members
    also have to agree on one of radius + 1 slices of the bits, which all linked ones
    do, so no task has to compare all of them with each other.

    With ``thin`` only pairs that give the same components come out.  The members of crowded buckets are
    linked in two rounds: neighbours at one bit first, each of which gets one pair with the
    smallest fingerprint it reaches; then pairs of such fingerprints (or of those in no crowd)
    between which any two are near, once, put together before they are shuffled.  So a dense group of m
    gives some m pairs, not m * m / 2."""
    picked = prints.orderBy(F.xxhash64("fp")).limit(sample).collect()  # bounded by the parameter
    n = prints.count()
    parts = plan_parts(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), max(n, 2), radius)
    slices = [_signed(sum(1 << b for b in range(k, BITS, radius + 1))) for k in range(radius + 1)]
    x = F.col("a").bitwiseXOR(F.col("b"))
    filed, probes = [], []
    for i, (mask, t) in enumerate(parts):
        own = [b for b in range(BITS) if mask >> b & 1]
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(own, k)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        filed.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        probes.append(_flipped(i, value, flips))

    def rows(keys: Column, name: str) -> DataFrame:
        return prints.select(F.col("fp").alias(name), F.explode(keys).alias("k")).select(
            name, "k.part", "k.value")

    base, probe = rows(F.array(*filed), "a"), rows(F.concat(*probes), "b")
    full = (base.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > crowded).select("part", "value", F.lit(True).alias("crowd")))

    group = {"a": F.col("a"), "b": F.col("b")}  # what stands for a fingerprint
    if thin:
        dense = base.join(full, ["part", "value"], "left_semi").select(F.col("a").alias("fp")).distinct()
        near = cut(link_components(one_bit_pairs(cut(dense, "dense"))).filter("fp <> root"), "dense-roots")
        group = {c: F.col(f"{c}_root") for c in group}

    def grouped(df: DataFrame, name: str) -> DataFrame:
        if not thin:
            return df
        r = near.select(F.col("fp").alias(name), F.col("root").alias("root"))
        return df.join(r, name, "left").select(
            name, "part", "value", F.coalesce("root", name).alias(f"{name}_root"))

    def divide(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(j).alias("slice"), F.col(name).bitwiseAND(F.lit(m)).alias("own"))
                         for j, m in enumerate(slices)])
        whole = F.array(F.struct(F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("own")))
        names = [name, *([f"{name}_root"] if thin else []), "part", "value"]
        return grouped(df, name).join(full, ["part", "value"], "left").select(
            *names, F.explode(F.when(F.col("crowd"), each).otherwise(whole)).alias("d")
        ).select(*names, "d.slice", "d.own")

    # a pair is given out for the first part, and there the first slice, in which it meets
    on = (F.col("a") < F.col("b")) & (group["a"] != group["b"]) & (F.bit_count(x) <= radius)
    for c in ("part", "value", "slice", "own"):
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    for i, (mask, t) in enumerate(parts[:-1]):
        apart = F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) > t
        on = on & ((F.col("l.part") <= i) | apart)
    for j, m in enumerate(slices[:-1]):
        on = on & ((F.col("l.slice") <= j) | (x.bitwiseAND(F.lit(m)) != 0))
    met = divide(base, "a").alias("l").join(divide(probe, "b").alias("r"), on)
    if not thin:
        return met.select("a", "b")
    between = met.select(F.least(*group.values()).alias("a"), F.greatest(*group.values()).alias("b")).distinct()
    return near.select(F.col("root").alias("a"), F.col("fp").alias("b")).union(between)


def link_components(pairs: DataFrame) -> DataFrame:
    """fp and root (the smallest reachable fp) of each end of a pair.

    Alternating large and small stars: each round every node's larger (then smaller)
    neighbours are hung on its smallest one, until nothing changes; the rounds grow with
    the logarithm of the component's size.  Rounds are written to the checkpoint folder."""
    e = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    e = cut(e, "links")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(
            F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = cut(small, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == mark:
            return e.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("fp"), F.col("v").alias("root"))).distinct()
        mark = now


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and component of each row (fp, id) of ``prints``, where the component is the
    smallest id that is reachable over links (nulls do not count).  One row per fp."""
    u = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = link_components(near_pairs(u.select("fp"), radius, thin=True))
    linked = u.join(roots, "fp").select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root")
    return u.join(named.select("fp", "component"), "fp", "left").select(
        "fp", F.coalesce("component", "least").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    Texts are read once, in a pass that gives out fingerprints; all that follows works
    on different fingerprints, so exact copies and repeated rows cost one row.  Null and
    empty texts have fingerprint zero and link like others; null ids never name a component
    unless it has no other; an empty table gives no rows."""
    d = cut(docs.select(F.col(doc_id).alias("id"), simhash(text_of(text), shingle).alias("fp")), "simhash")
    return d.join(components(d, radius), "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one of the smallest
    doc_id (null last), then of the smallest hash of the text; of repeated rows one stays.
    Columns and their names stay as they are."""
    h = F.xxhash64(text_of(text))
    d = cut(docs.select(F.col(doc_id).alias("id"), h.alias("h"),
                        simhash(text_of(text), shingle).alias("fp")), "simhash")
    u = cut(d.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))
                                .alias("id")), "prints")
    roots = link_components(near_pairs(u.select("fp"), radius, thin=True))
    kept = (u.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("id").alias("id")).select(F.col("id.id").alias("__id"), F.col("id.h").alias("__h")))
    out = docs.withColumn("__of", h)
    return (out.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__h")),
                     "left_semi").dropDuplicates([doc_id, "__of"]).select(*docs.columns))
