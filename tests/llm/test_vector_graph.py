"""Embedding near-duplicates against comparing all pairs."""

import numpy as np
import pytest

from elotrail.llm.vector_graph import (build_graph, cells_of, edge_table, fit_cells, link_vectors, local_roots,
                                       near_vectors, search, unit)

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, threshold=0.95):
    """Plain version: (n_links, component, kept) of each row."""
    good = [i for i, (_, v) in enumerate(rows) if unit(v) is not None]
    vec = {i: np.frombuffer(unit([float(np.float32(x)) for x in rows[i][1]])) for i in good}
    links = {i: [j for j in good if j != i and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= threshold] for i in good}
    out = []
    for i, (vid, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vid, len(links.get(i, [])), least, vid is not None and vid == least))
    return sorted(out, key=str)


def planted(rng, n, dims=16, groups=8):
    x = rng.normal(size=(n, dims))
    for _ in range(groups):
        at = rng.choice(n, rng.integers(2, 30), replace=False)
        x[at] = x[at[0]] + rng.normal(size=(len(at), dims)) * rng.choice([.05, .15, .3])
    at = rng.choice(n, n // 4, replace=False)
    x[at] = x[at[0]]  # a hot vector
    return [(int(i), x[i].tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0)
                                  for i, v in rows], SCHEMA)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_all_pairs(spark):
    rows = planted(np.random.default_rng(1), 600)
    got, recall = link_vectors(frame(spark, rows), shard=64)
    assert recall == 1.0 and result(got) == all_pairs(rows)


def test_divided_cells(spark):
    """One cell, parts of about 50 vectors that are searched two by two."""
    rows = planted(np.random.default_rng(2), 400, groups=5)
    got, recall = link_vectors(frame(spark, rows), shard=40, cells=1)
    want = all_pairs(rows)
    same = sum(a == b for a, b in zip(result(got), want))
    assert recall >= 0.95 and same >= 0.95 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 2.0, 3.0]
    rows = [(1, a), (2, [2.0, 4.0, 6.0]), (3, a), (3, a), (3, [0.0, 0.0, 1.0]), (4, None), (5, []), (6, [0.0] * 3),
            (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 2.0]), (10, [1.0, 2.0]), (11, [1.0, 2.1]),
            (None, [0.0, 0.0, 1.0]), (None, [-1.0, 0.0, 0.0]), (None, None), (12, [-0.0, 0.0, 1.0]), (-5, [1.0, 2.0, 3.01])]
    from pyspark.sql import functions as F
    df = frame(spark, rows)
    for c in ("vec", "key", "cid", "id", "kept"):
        df = df.withColumn(c, F.lit("own"))
    assert result(near_vectors(df)) == all_pairs(rows)
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.filter("vec_id = 4")).first() == (4, 0, 4, True)


def test_long_chain(spark):
    """Neighbours link, the ends do not: one component."""
    t = np.linspace(0, 2.5, 60)
    rows = [(100 - i, [float(np.cos(x)), float(np.sin(x)), 0.0]) for i, x in enumerate(t)]
    assert {r[2] for r in result(near_vectors(frame(spark, rows)))} == {41}


def test_low_recall_is_reported(spark, monkeypatch):
    monkeypatch.setattr("elotrail.llm.vector_graph.search", lambda q, x, *a: np.zeros((len(q), len(x)), bool))
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01])]
    with pytest.warns(UserWarning, match="recall"):
        _, recall = link_vectors(frame(spark, rows))
    assert recall == 0


def test_graph_and_search():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.1  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = build_graph(x)
    assert (a != b).all() and np.bincount(a, minlength=len(x)).min() >= 1
    import pyarrow as pa
    bounds = np.searchsorted(a, np.arange(len(x) + 1))
    edges = edge_table(np.arange(len(x)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(b)))
    found = search(x, x, edges, 0.95, nodes=np.arange(len(x)))
    true = x @ x.T >= 0.95
    assert not (found & ~true).any() and (found & true).sum() >= 0.999 * true.sum()
    root = local_roots(true)
    assert (root[:300] == 0).all() and root[-1] == len(x) - 1
    assert len(build_graph(x[:1])[0]) == 0


def test_cells_overlap():
    x = np.random.default_rng(4).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = fit_cells(x, 10)
    some, most, every = (cells_of(x, c, m).sum(axis=1) for m in (0, .2, 2))
    assert (some == 1).all() and most.mean() > 1.1 and (every == 10).all()
