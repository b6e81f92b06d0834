"""Operator 11: near-duplicate embeddings by search in a robust-pruned flat graph.

Different vectors are dealt to overlapping shards around centroids; each shard builds its part
of the graph (nearest candidates and a few random ones, pruned so that a candidate goes where
an edge kept before leads nearer to it), and the adjacency lists of a vector from all its shards
are united.  Then each shard searches its vectors over the united lists: a beam search from the
medoids and the vector's own node comes near, a range-expanding search follows the edges of all
vectors in range.  Cosines are worked out in double precision, so every link is verified.  A
bounded set of vectors is compared with all others to audit the recall; below the target, shards
overlap more and beams widen, in the end until every vector is in every shard.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import cut
from .simhash import link_components

THRESHOLD = 0.95
SHARD = 2048        # vectors aimed at in a shard; one of over twice as many is divided into parts
CELLS = 1024        # centroids at most
SAMPLE = 8192       # vectors that centroids are fitted on, at most
AUDIT = 256         # vectors compared with all others, at most
TARGET = 0.99       # recall that the audit asks for
DEGREE = 24         # edges that pruning keeps; twice as many with those that lead back
POOL, FAR = 64, 8   # nearest and random candidates of a node
ALPHA = 1.2
BEAM = 32
SLACK = 1.25        # vectors up to this times the linking distance are expanded
_ROWS = 256         # queries worked on at once


# -- vectors ----------------------------------------------------------------------
def unit(v: list | None) -> bytes | None:
    """The vector in length 1 as bytes of doubles; None if it cannot link."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64) + 0.0  # no negative zeros
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return (x / np.sqrt(x @ x) + 0.0).tobytes()


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


# -- cells ------------------------------------------------------------------------
def fit_cells(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Up to ``k`` centroids of length 1, by Lloyd's rounds from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """Which cells hold each vector: the nearest, and those whose border with it is not further
    than ``margin``."""
    s = x @ c.T
    best = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[best]
    return s.max(axis=1, keepdims=True) - s <= margin * apart


# -- graph of a shard ---------------------------------------------------------------
def build_graph(x: np.ndarray, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) in both directions, of each node the nearest 2 * degree at most."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rng = np.random.default_rng(n)
    pool, src, dst = min(POOL, n - 1), [], []
    for lo in range(0, n, _ROWS):
        own = np.arange(lo, min(n, lo + _ROWS))
        row = np.arange(len(own))[:, None]
        s = x[own] @ x.T
        s[row[:, 0], own] = -np.inf
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        cand = np.concatenate([near, rng.integers(0, n, (len(own), FAR))], axis=1)
        cand = np.take_along_axis(cand, np.argsort(-s[row, cand], axis=1, kind="stable"), axis=1)
        to_own = 2 - 2 * s[row, cand]
        alive = np.isfinite(to_own)  # not the node itself
        between = 2 - 2 * (x[cand] @ x[cand].transpose(0, 2, 1))
        for _ in range(degree):
            pick = alive.argmax(axis=1)
            left = alive[row[:, 0], pick]
            if not left.any():
                break
            src.append(own[left])
            dst.append(cand[row[:, 0], pick][left])
            alive &= ALPHA * ALPHA * between[row[:, 0], pick] > to_own
            alive[row[:, 0], pick] = False
    a, b = np.concatenate(src), np.concatenate(dst)
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = key // n, key % n
    order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), a))
    a, b = a[order], b[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < 2 * degree
    return a[keep], b[keep]


def search(queries: np.ndarray, x: np.ndarray, edges: np.ndarray, threshold: float, beam: int = BEAM,
           nodes: np.ndarray | None = None) -> np.ndarray:
    """Which rows of ``x`` (columns) each query (rows) found with a cosine of at least ``threshold``.

    ``edges``: the neighbours of each row, filled up by -1; ``nodes``: the rows that the queries are,
    if they are some, where their search begins beside the medoid."""
    n = len(x)
    medoid = (x @ x.mean(axis=0)).argmax()
    wide = 1 - SLACK * SLACK * (1 - threshold)
    found = np.zeros((len(queries), n), bool)
    for lo in range(0, len(queries), _ROWS):
        own = np.arange(lo, min(len(queries), lo + _ROWS))
        q, m = queries[own], len(own)
        row = np.arange(m)
        seen = np.zeros((m, n), bool)
        range_rows, range_cols = [], []

        def look(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            """Cosines of queries r with rows c, noted if in range."""
            s = np.einsum("ij,ij->i", q[r], x[c])
            seen[r, c] = True
            found[own[r[s >= threshold]], c[s >= threshold]] = True
            range_rows.append(r[s >= wide])
            range_cols.append(c[s >= wide])
            return s

        # beam search: the best node that is not expanded yet, until the beam has none
        ids = np.full((m, 2), medoid)
        ids[:, 1] = -1 if nodes is None else np.where(nodes[own] == medoid, -1, nodes[own])
        sims = np.full(ids.shape, -np.inf)
        r, k = np.nonzero(ids >= 0)
        sims[r, k] = look(r, ids[r, k])
        done = ids < 0
        while True:
            best = np.where(done, -np.inf, sims).argmax(axis=1)
            go = row[~done[row, best]]
            if not len(go):
                break
            done[go, best[go]] = True
            fresh = np.full((m, edges.shape[1]), -1)
            fresh[go] = edges[ids[go, best[go]]]
            r, k = np.nonzero(fresh >= 0)
            new = ~seen[r, fresh[r, k]]
            near = np.full(fresh.shape, -np.inf)
            r, k = r[new], k[new]
            near[r, k] = look(r, fresh[r, k])
            ids, sims = np.concatenate([ids, fresh], axis=1), np.concatenate([sims, near], axis=1)
            done = np.concatenate([done, np.isneginf(near)], axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, done = (np.take_along_axis(a, top, axis=1) for a in (ids, sims, done))
        # range-expanding search: all neighbours of all that is in range
        while range_rows:
            r, c = np.concatenate(range_rows), np.concatenate(range_cols)
            range_rows.clear()
            range_cols.clear()
            step = max(1, (1 << 20) // max(1, edges.shape[1]))
            for k in range(0, len(r), step):
                to = edges[c[k:k + step]]
                rr, col = np.broadcast_to(r[k:k + step, None], to.shape)[to >= 0], to[to >= 0]
                new = ~seen[rr, col]
                pair = np.unique(rr[new] * n + col[new])
                for j in range(0, len(pair), 1 << 16):
                    look(pair[j:j + (1 << 16)] // n, pair[j:j + (1 << 16)] % n)
            if not sum(map(len, range_rows)):
                break
    return found


def edge_table(cid: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Neighbours of each row as rows of this shard, filled up by -1; ``cid`` ascends, and
    neighbours that are not in it are left out."""
    owner = np.repeat(np.arange(len(cid)), np.diff(lists.offsets.to_numpy()))
    to = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(cid, to), len(cid) - 1)
    owner, at = owner[cid[at] == to], at[cid[at] == to]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    edges = np.full((len(cid), int(place.max(initial=0)) + 1), -1)
    edges[owner, place] = at
    return edges


def local_roots(found: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    root = np.full(len(found), -1)
    for i in range(len(found)):
        if root[i] < 0:
            front = np.array([i])
            while len(front):
                root[front] = i
                front = np.flatnonzero(found[front].any(axis=0) & (root < 0))
    return root


# -- shards ---------------------------------------------------------------------------
MEMBER = "cid long, weight long, vec binary, dims int, cells array<int>"


def assign_cells(classes: DataFrame, centroids: dict[int, np.ndarray], margin: dict[int, float]) -> DataFrame:
    """``classes`` with the cells that hold each vector, ascending.  A length that no centroid
    has is one cell."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims = b.column("dims").to_numpy()
            cells: list = [[0]] * len(dims)
            for d in np.unique(dims).tolist():
                if d in centroids:
                    at = np.flatnonzero(dims == d)
                    hold = cells_of(_matrix(b.column("vec").take(pa.array(at)), d), centroids[d], margin[d])
                    for i, own in zip(at.tolist(), hold):
                        cells[i] = np.flatnonzero(own).tolist()
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("weight"), b.column("vec"),
                                              b.column("dims"), pa.array(cells, pa.list_(pa.int32()))],
                                             ["cid", "weight", "vec", "dims", "cells"])

    return classes.select("cid", "weight", "vec", "dims").mapInArrow(batches, MEMBER)


def deal_parts(members: DataFrame, shard: int) -> DataFrame:
    """Rows of each cell with their part of it; a cell of more than 2 * ``shard`` vectors has
    several, dealt by a hash."""
    each = members.withColumn("cell", F.explode("cells"))
    parts = each.groupBy("dims", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(2.0 * shard))).cast("int").alias("parts"))
    return each.join(parts, ["dims", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))


def graph_lists(dealt: DataFrame) -> DataFrame:
    """cid and its neighbours, united over all the shards that hold it."""

    def build(t: pa.Table) -> pa.Table:
        cid, x = t["cid"].to_numpy(), _matrix(t["vec"], t["dims"][0].as_py())
        order = np.argsort(cid)
        cid, x = cid[order], x[order]
        a, b = build_graph(x)
        bounds = np.searchsorted(a, np.arange(len(cid) + 1))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cid[b], pa.int64()))
        return pa.table({"cid": pa.array(cid, pa.int64()), "near": lists})

    lists = dealt.select("dims", "cell", "part", "cid", "vec").groupBy("dims", "cell", "part").applyInArrow(
        build, "cid long, near array<long>")
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search_shards(dealt: DataFrame, lists: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(cid, n, root) of the vectors with links in a block: the weight of those counted there, and
    the smallest vector it hangs together with.

    A block is a part of a cell, whose vectors are searched over the united lists, or two parts
    of a divided one, where the vectors of each are searched in the other.  A pair that several cells hold is counted in the first of them."""
    blocks = (dealt.join(lists, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("b1", F.least("part", "other")).withColumn("b2", F.greatest("part", "other")))

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        cell, cid = t["cell"][0].as_py(), t["cid"].to_numpy()
        x, part = _matrix(t["vec"], t["dims"][0].as_py()), t["part"].to_numpy()
        near = t["near"].combine_chunks()
        found = np.zeros((len(cid), len(cid)), bool)
        sides = [np.flatnonzero(part == p) for p in np.unique(part)]
        for one, two in ((0, 0),) if len(sides) == 1 else ((0, 1), (1, 0)):
            asked, rows = sides[one], sides[two]
            edges = edge_table(cid[rows], near.take(pa.array(rows)))
            found[np.ix_(asked, rows)] = search(x[asked], x[rows], edges, threshold, beam,
                                                np.arange(len(rows)) if one == two else None)
        np.fill_diagonal(found, False)
        found |= found.T
        root = local_roots(found)
        earlier = [[c for c in cells if c < cell] for cells in t["cells"].to_pylist()]
        names = {c: k for k, c in enumerate(sorted({c for cells in earlier for c in cells}))}
        if names:
            held = np.zeros((len(cid), len(names)), np.float32)
            for i, cells in enumerate(earlier):
                held[i, [names[c] for c in cells]] = 1
            counted = found & ~(held @ held.T > 0)
        else:
            counted = found
        n = counted.astype(np.float64) @ t["weight"].to_numpy().astype(np.float64)
        some = found.any(axis=1)
        return pa.table({"cid": pa.array(cid[some], pa.int64()), "n": pa.array(n[some].astype(np.int64)),
                         "root": pa.array(cid[root[some]], pa.int64())})

    return (blocks.select("dims", "cell", "b1", "b2", "part", "cid", "weight", "vec", "cells", "near")
            .groupBy("dims", "cell", "b1", "b2").applyInArrow(block, "cid long, n long, root long"))


def audit_recall(classes: DataFrame, found: DataFrame, threshold: float, audited: int) -> float:
    """Share of the links that ``found`` (cid, links) counts for at most ``audited`` vectors, of those
    that comparing each with all others gives."""
    picked = classes.orderBy(F.xxhash64("cid")).limit(audited).select("cid", "vec", "dims").collect()  # bounded
    by_dims: dict[int, list] = {}
    for r in picked:
        by_dims.setdefault(r["dims"], []).append((r["cid"], bytes(r["vec"])))
    asked = {d: (np.array([c for c, _ in rows]), np.frombuffer(b"".join(v for _, v in rows)).reshape(-1, d))
             for d, rows in by_dims.items()}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims, cid, weight = (b.column(c).to_numpy() for c in ("dims", "cid", "weight"))
            for d in set(np.unique(dims).tolist()) & set(asked):
                at = np.flatnonzero(dims == d)
                ids, q = asked[d]
                hit = (q @ _matrix(b.column("vec").take(pa.array(at)), d).T >= threshold) & (ids[:, None] != cid[at])
                n = hit.astype(np.float64) @ weight[at].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["cid", "n"])

    true = classes.select("cid", "weight", "vec", "dims").mapInArrow(count, "cid long, n long").groupBy(
        "cid").agg(F.sum("n").alias("n"))
    r = (true.join(found, "cid", "left").agg(F.sum("n"), F.sum(F.coalesce("links", F.lit(0))))).first()
    return 1.0 if not r[0] else r[1] / r[0]


def _margin(threshold: float, dims: int, overlap: float) -> float:
    """``overlap`` times the size of the step between linked vectors along one direction."""
    return overlap * math.sqrt(2 - 2 * threshold) / math.sqrt(dims)


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 threshold: float = THRESHOLD, shard: int = SHARD, cells: int = CELLS, sample: int = SAMPLE,
                 audited: int = AUDIT, target: float = TARGET, overlap: float = 1.0) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of each row, and the audited recall.

    Links join rows whose vectors have a cosine of at least ``threshold``; n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable, kept whether it is the row's
    own.  Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing; so do vectors of different lengths with each other.  Rows that repeat a vector (or a
    multiple that comes out equal in length 1) are one node with their number as weight, and link with
    each other; rows that repeat a vec_id are rows of their own.  Null ids name no component unless it
    has no other, and are not kept.  Other columns are not read.  An empty table gives no rows.

    Centroids are fitted on at most ``sample`` vectors, all vectors are indexed.  A cell that holds
    more than 2 * ``shard`` of them is divided, its parts are searched two by two: no task
    holds more than about 4 * ``shard`` vectors, and no pairs are given out, only counts and one
    edge for each vector and block."""
    @F.arrow_udf("binary")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([unit(v) for v in a.to_pylist()], pa.binary())

    rows = cut(vectors.select(F.col(vec_id).alias("id"), units(F.col(embedding).cast("array<double>")).alias("vec"))
               .withColumn("key", F.unhex(F.sha2("vec", 256))), "vectors")
    classes = cut(rows.filter("vec IS NOT NULL").groupBy("key", "vec")
                  .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
                  .withColumn("cid", F.monotonically_increasing_id())
                  .withColumn("dims", (F.octet_length("vec") / 8).cast("int")), "classes")
    n = classes.count()
    fitted: dict[int, list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64("vec")).limit(sample).select("vec", "dims").collect():  # bounded
        fitted.setdefault(r["dims"], []).append(bytes(r["vec"]))
    total = sum(map(len, fitted.values()))
    centroids = {d: fit_cells(np.frombuffer(b"".join(v)).reshape(-1, d),
                              min(cells, math.ceil(2 * n * len(v) / total / shard), max(1, len(v) // 4)))
                 for d, v in fitted.items()}
    beam = BEAM
    while True:
        margin = {d: _margin(threshold, d, overlap) for d in centroids}
        members = cut(assign_cells(classes, centroids, margin), "members")
        dealt = cut(deal_parts(members, shard), "shards")
        blocks = cut(search_shards(dealt, graph_lists(dealt), threshold, beam), "blocks")
        found = cut(blocks.groupBy("cid").agg(F.sum("n").alias("links")), "links")
        recall = audit_recall(classes, found, threshold, audited)
        if recall >= target or min(margin.values(), default=2) >= 2:
            break
        overlap, beam = 2 * overlap, 2 * beam
    if recall < target:
        warnings.warn(f"recall {recall:.4f} of links is below {target}", stacklevel=2)
    edges = blocks.filter("root <> cid").select(F.col("root").alias("a"), F.col("cid").alias("b")).distinct()
    roots = link_components(edges).withColumnRenamed("fp", "cid")
    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    result = (named.select("key", "cid", "weight", "root").join(least, "root").join(found, "cid", "left")
              .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "component"))
    alone = rows.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = rows.filter("key IS NOT NULL").select("id", "key").join(result, "key").select("id", "n", "component")
    return out.unionByName(alone).select(
        F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")), recall


def near_vectors(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``link_vectors`` alone."""
    return link_vectors(vectors, **options)[0]
