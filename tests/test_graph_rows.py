"""Paths and potentials of small keys, told in one row a key, against rounds of joins and a plain search."""

import numpy as np
import pytest
from framewise.operators import graph


def nets(seed: int = 3):
    rng = np.random.default_rng(seed)
    return [(k, int(a), int(b), round(float(g), 2)) for k in range(12) for (a, b), g in zip(rng.integers(0, 9, (3 + k, 2)), rng.normal(size=3 + k)) if a != b]


def test_small_keys_meet_edges_once(spark, monkeypatch):
    """A chain of 30 edges writes its edges and the list of large keys, nothing a round."""
    made = []
    write = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: made.append(df) or write(df))
    net = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(30)], "k int, a bigint, b bigint, gap double")
    v = graph.network_potentials(net, spark.createDataFrame([(0, 0, 2.0)], "k int, node bigint, potential double"), None, ["k"])
    assert {r["node"]: (r["potential"], r["spread"]) for r in v.collect()} == {i: (2.0 + i, 0.0) for i in range(31)}
    p = graph.shortest_path(net, spark.createDataFrame([(0, 0, 30)], "k int, source bigint, target bigint"), 30, ["k"])
    assert p.first()["path"] == list(range(31))
    assert len(made) == 4


@pytest.mark.parametrize("most", [1, 3, None])
def test_potentials_by_row_and_by_rounds(spark, most):
    e = spark.createDataFrame(nets(), "k int, a bigint, b bigint, gap double")
    start = spark.createDataFrame([(k, v, 0.5 + v) for k in range(14) for v in (0, 4)], "k int, node bigint, potential double")
    got = [sorted((r["k"], r["node"], round(r["potential"], 9), round(r["spread"], 9)) for r in graph.network_potentials(e, start, most, ["k"], small).collect()) for small in (64, 8, 0)]
    assert got[0] == got[1] == got[2]
    assert {g[0] for g in got[0]} == set(range(14))


@pytest.mark.parametrize("most", [1, 4])
def test_paths_by_row_and_by_rounds(spark, most):
    e = [(k, a, b) for k, a, b, _ in nets(5)]
    want = {}
    for k in range(13):
        near = {v: {x for _, p, q in (y for y in e if y[0] == k) for x in (p, q) if v in (p, q) and x != v} for v in range(9)}
        for t in (0, 3, 8):
            ways = [[0]]
            while ways and ways[0][-1:] != [t] and not any(w[-1] == t for w in ways):
                ways = [[*w, x] for w in ways for x in near[w[-1]] if x not in w] if len(ways[0]) <= most else []
            want[k, t] = min((w for w in ways if w[-1] == t), default=None)
    df = spark.createDataFrame(e, "k int, a bigint, b bigint")
    ends = spark.createDataFrame([(k, 0, t) for k, t in want], "k int, source bigint, target bigint")
    for small in (64, 8, 0):
        assert {(r["k"], r["target"]): r["path"] for r in graph.shortest_path(df, ends, most, ["k"], small).collect()} == want
