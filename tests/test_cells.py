"""Pair operators over runs with cells of their own, rectangular, triclinic and none, against plain loops."""

import random

import numpy as np
import pytest
from framewise.operators import cells, pairs
from pyspark.sql import functions as F

CELLS = {0: [[20, 0, 0], [0, 24, 0], [0, 0, 30]], 1: [[20, 0, 0], [6, 22, 0], [-4, 5, 25]], 2: [[9, 0, 0], [2, 9, 0], [1, 1, 9]], 3: [[20, 1, 2], [-3, 22, 1], [4, 5, 25]]}


@pytest.fixture(scope="module")
def atoms(spark):
    rng = random.Random(1)
    rows = [(r, r * 10 + f, i, "O" if i % 3 else "H", *(rng.uniform(-30, 60) for _ in range(3))) for r in range(5) for f in range(2) for i in range(70)]
    df = spark.createDataFrame(rows, "run int, frame int, atom_id int, element string, x double, y double, z double")
    boxes = spark.createDataFrame([(r, [[float(v) for v in x] for x in m]) for r, m in CELLS.items()], "run int, cell array<array<double>>")
    return rows, cells.with_cells(df, boxes)


def brute(rows, cutoff):
    """{(frame, i, j): d}; run 4 has no cell and is open."""
    out = {}
    for r, f, i, _, *p in rows:
        for _, g, j, _, *q in rows:
            if f == g and i != j:
                d = np.array(q) - np.array(p)
                if r in CELLS:
                    m = np.array(CELLS[r], float)
                    d = d - np.rint(d @ np.linalg.inv(m)) @ m
                if np.linalg.norm(d) <= cutoff:
                    out[f, i, j] = float(np.linalg.norm(d))
    return out


@pytest.mark.parametrize("dense", [True, False, None])
def test_neighbours(atoms, dense):
    rows, df = atoms
    want = brute(rows, 4.3)
    assert len(want) > 3000
    got = {(r["frame"], r["i"], r["j"]): r["d"] for r in pairs.neighbour_pairs(df, df, 4.3, "cell", dense=dense).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    half = {(r["frame"], r["i"], r["j"]): (r["d"], r["p"]["x"]) for r in pairs.neighbour_pairs(df, df, 4.3, "cell", dense=dense, half=True, carry=("x",)).collect()}
    at = {(f, i): x for _, f, i, _, x, _, _ in rows}
    assert half.keys() == {k for k in want if k[1] < k[2]} and all(v[1] == at[k[0], k[1]] for k, v in half.items())


def test_three_lengths_are_a_rectangular_cell(spark, atoms):
    rows, df = atoms
    df = df.where("run = 0")
    pair = lambda box, dense: sorted((r["i"], r["j"], round(r["d"], 9)) for r in pairs.neighbour_pairs(df, df, 5.0, box, dense=dense).collect())
    assert pair((20.0, 24.0, 30.0), True) == pair("cell", False) == pair("cell", True)


def test_operators(atoms):
    rows, df = atoms
    o, h = df.where("element = 'O'"), df.where("element = 'H'")
    kind = {(f, i): e for _, f, i, e, *_ in rows}
    near = {k: d for k, d in brute(rows, 6.0).items() if kind[k[0], k[1]] == "H" and kind[k[0], k[2]] == "O"}
    want = {}
    for (f, i, j), d in near.items():
        if d <= 5.5 and d <= want.get((f, i), (9.0, 0))[0]:
            want[f, i] = (d, j)
    got = {(r["frame"], r["h"]): r["nearest"] for r in pairs.nearest_owner(h, o, 5.5, 0.5, "cell").collect()}
    assert got == {k: j for k, (_, j) in want.items()}
    closed = df.where("run < 4")
    g = pairs.rdf(closed, closed, 1.0, 4.0, "cell").orderBy("bin").collect()
    close = [d for (f, _, _), d in brute(rows, 4.0).items() if f < 40]
    assert [r["n"] for r in g] == np.histogram(close, bins=range(5))[0].tolist()
    ideal = sum(2 * 70 * 70 / abs(np.linalg.det(np.array(m, float))) for m in CELLS.values())
    assert g[3]["g"] == pytest.approx(g[3]["n"] / (ideal * 4 / 3 * np.pi * (4**3 - 3**3)))
    stated = pairs.rdf(closed, closed, 1.0, 4.0, "cell", rho=0.01).orderBy("bin").collect()
    assert stated[3]["g"] == pytest.approx(g[3]["n"] / (560 * 0.01 * 4 / 3 * np.pi * (4**3 - 3**3)))
    assert {r["area"] >= 0 for r in pairs.sasa(h, df, 2.0, 40, "cell").collect()} == {True}
    shallow = pairs.hbonds(o, h, o, 3.0, 5.0, 20.0, "cell")
    assert shallow.count() == pairs.hbonds(o, h, o, 3.0, 5.0, 20.0, "cell", dense=True).count() > 0


def test_wide_cells_copy_atoms_near_faces_only(spark, atoms):
    rows, df = atoms
    want = brute(rows, 2.6)  # axes of six cutoffs and more take cells of two
    got = {(r["frame"], r["i"], r["j"]): r["d"] for r in pairs.neighbour_pairs(df, df, 2.6, "cell", dense=True).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    half = [(r["frame"], r["i"], r["j"]) for r in pairs.neighbour_pairs(df, df, 2.6, "cell", dense=True, half=True).collect()]
    assert sorted(half) == sorted(k for k in want if k[1] < k[2])
    x = pairs.neighbour_pairs(df, df, 2.6, "cell", dense=True)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000 and "inv[" not in plan  # short formulas: nested lookups were more than the JVM compiles
    grid = cells.Grid(60.0, 5.0)
    n = grid.counts(None)
    at = [spark.range(4000).select("id", *[((F.col("id") * k) % 6007 / 6007 * 60).alias(c) for c, k in zip("xyz", (1, 389, 2741))])][0]
    place = [F.col(c) for c in "xyz"]
    scale = dict(zip(["_ux", "_uy", "_uz", "_rx", "_ry", "_rz"], [*grid.scaled(place, None, n), *grid.reach(None, n)]))
    assert 4000 * 6 < grid.spread(at.withColumns(scale), n, False).count() < 4000 * 10  # 27 before
