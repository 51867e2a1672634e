"""Operators against closed forms and NumPy."""

import math

import numpy as np
import pytest
from framewise.functions import exprs as X
from framewise.operators import agg, align, density, events, freeenergy as FE, geometry, graph, pairs, regress, titration as T
from pyspark.sql import functions as F

XYZ = "run int, frame int, atom_id bigint, element string, x double, y double, z double"


def frames(spark, arrays, elements=None):
    rows = [(0, f, i + 1, (elements or ["O"] * len(a))[i], *map(float, p)) for f, a in enumerate(arrays) for i, p in enumerate(a)]
    return spark.createDataFrame(rows, XYZ)


def test_expressions(spark):
    a = [-540.0, -180.0, -0.5, 179.9, 180.0, 725.0]
    df = spark.createDataFrame([(v,) for v in a], "a double")
    got = df.select(X.wrap_deg(F.col("a")), X.branch_near(F.col("a"), F.lit(350.0)), X.planar_deviation(F.col("a")), X.min_image(F.col("a"), 100.0)).collect()
    for v, r in zip(a, got):
        assert r[0] == pytest.approx((v + 180) % 360 - 180) and abs(r[1] - 350) <= 180 and math.cos(math.radians(r[1] - v)) == pytest.approx(1)
        assert r[2] == pytest.approx(abs((v + 90) % 180 - 90)) and r[3] == pytest.approx(v - 100 * np.rint(v / 100))


def test_pairs_and_images(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 20, (2, 40, 3))
    df = frames(spark, p)
    got = {(r["frame"], r["i"], r["j"]): r["d"] for r in pairs.neighbour_pairs(df, df, 5.0, 20.0).collect()}
    want = {}
    for f in range(2):
        d = p[f][None] - p[f][:, None]
        d = np.linalg.norm(d - 20 * np.rint(d / 20), axis=2)
        want |= {(f, i + 1, j + 1): d[i, j] for i in range(40) for j in range(40) if i != j and d[i, j] <= 5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    moved = df.withColumns({c: F.col(c) + 20 * (F.col("atom_id") % 3) for c in "xyz"})  # images change nothing
    assert {k: round(v, 9) for k, v in got.items()} == {(r["frame"], r["i"], r["j"]): round(r["d"], 9) for r in pairs.neighbour_pairs(moved, df, 5.0, 20.0).collect()}
    g = pairs.rdf(df, df, 1.0, 5.0, 20.0).orderBy("bin").collect()
    assert sum(r["n"] for r in g) == sum(v < 5 for v in want.values()) and g[-1]["running"] == pytest.approx(len(want) / 80)


def test_dense_frames(spark):
    """Frames of many atoms, whose pairs come by cells: ordered, half and carried forms, nearest owners, hydrogen bonds and areas against NumPy."""
    rng = np.random.default_rng(11)
    p = rng.uniform(0, 30, (2, 500, 3))
    kind = ["O" if k % 3 == 0 else "H" for k in range(500)]
    df = frames(spark, p, kind)
    for cutoff in (5.0, 7.4, 11.0):  # six cells a side, four, and none
        want = {}
        for f in range(2):
            d = p[f][None] - p[f][:, None]
            d = np.linalg.norm(d - 30 * np.rint(d / 30), axis=2)
            i, j = np.nonzero((d <= cutoff) & ~np.eye(500, dtype=bool))
            want |= {(f, a + 1, b + 1): d[a, b] for a, b in zip(i.tolist(), j.tolist())}
        for dense in (True, False):
            got = {(r["frame"], r["i"], r["j"]): r["d"] for r in pairs.neighbour_pairs(df, df, cutoff, 30.0, dense=dense).collect()}
            half = {(r["frame"], r["i"], r["j"]): (r["d"], r["p"], r["q"]) for r in pairs.neighbour_pairs(df, df, cutoff, 30.0, dense=dense, carry=("x",), half=True).collect()}
            assert got.keys() == want.keys() and {k for k in want if k[1] < k[2]} == half.keys()
            assert all(abs(v[0] - want[k]) < 1e-9 and v[1]["x"] == p[k[0], k[1] - 1, 0] and v[2]["x"] == p[k[0], k[2] - 1, 0] for k, v in half.items())
    o, h = df.where("element = 'O'"), df.where("element = 'H'")
    owners = {(r["frame"], r["h"]): (r["nearest"], r["owner"], r["d2"]) for r in pairs.nearest_owner(h, o, 4.0, 0.5, 30.0).collect()}
    d = p[0][None] - p[0][:, None]
    d = np.linalg.norm(d - 30 * np.rint(d / 30), axis=2)
    os_ = [k for k in range(500) if kind[k] == "O"]
    for k in range(500):
        if kind[k] == "H":
            a, b = sorted(os_, key=lambda x: d[k, x])[:2]
            if d[k, a] <= 4:
                assert owners[0, k + 1][0] == a + 1 and owners[0, k + 1][1] == (a + 1 if d[k, b] - d[k, a] >= 0.5 or d[k, b] > 4.5 else None)
            else:
                assert (0, k + 1) not in owners
    for dense in (True, False):
        bonds = pairs.hbonds(o, h, o, 2.0, 6.0, 120.0, 30.0, dense=dense).count()
        assert bonds == pairs.hbonds(o, h, o, 2.0, 6.0, 120.0, 30.0).count() > 0
    few = df.where("atom_id <= 40")
    area = {(r["frame"], r["i"]): r["area"] for r in pairs.sasa(few, few, 4.0, 50, 30.0).collect()}
    k = np.arange(50)
    z = 1 - (2 * k + 1) / 50
    ball = np.stack([np.sqrt(1 - z * z) * np.cos(k * 2.399963229728653), np.sqrt(1 - z * z) * np.sin(k * 2.399963229728653), z], axis=1)
    for i in range(40):
        e = (p[0, i] + 4 * ball)[:, None] - np.delete(p[0, :40], i, axis=0)[None]
        free = (np.linalg.norm(e - 30 * np.rint(e / 30), axis=2) >= 4).all(axis=1).mean()
        assert area[0, i + 1] == pytest.approx(free * 4 * math.pi * 16)


def test_large_graphs(spark):
    """Keys of many edges go by rounds, others in arrays; both give the smallest node of each component, and long paths are found."""
    rng = np.random.default_rng(5)
    e = [(k, int(a), int(b)) for k in range(3) for a, b in rng.integers(0, 60 if k else 12, (40 + 60 * k, 2)) if a != b] + [(9, i, i + 1) for i in range(30)]
    df = spark.createDataFrame(e, "frame int, a bigint, b bigint")
    want = {}
    for k in {x[0] for x in e}:
        at = {v: v for x in e if x[0] == k for v in x[1:]}
        for _ in range(80):
            for _, a, b in (x for x in e if x[0] == k):
                at[a] = at[b] = min(at[a], at[b])
        want |= {(k, v): m for v, m in at.items()}
    for small in (64, 0, 1000):
        assert {(r["frame"], r["node"]): r["label"] for r in graph.component_labels(df, ["frame"], small).collect()} == want
    ends = spark.createDataFrame([(9, 0, 12), (9, 3, 29)], "frame int, source bigint, target bigint")
    got = {r["source"]: r["n_bridging"] for r in graph.shortest_path(df, ends, 12, ["frame"]).collect()}
    assert got == {0: 11, 3: -1}
    net = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(30)], "k int, a bigint, b bigint, gap double")
    v = {r["node"]: r["potential"] for r in graph.network_potentials(net, spark.createDataFrame([(0, 0, 2.0)], "k int, node bigint, potential double"), None, ["k"]).collect()}
    assert v == {i: 2.0 + i for i in range(31)}


def test_walkers_by_blocks(spark):
    rng = np.random.default_rng(8)
    x = [(r, int(s), int(rng.integers(0, 5)), bool(rng.random() < 0.6)) for r in range(3) for s in range(60)] + [(0, 60, 0, True), (0, 60, 2, True)]
    want = []
    for r in range(3):
        n = max(v[2] for v in x if v[0] == r) + 2
        at = list(range(n))
        for s in sorted({v[1] for v in x if v[0] == r}):
            for _, _, low, yes in sorted(v for v in x if v[0] == r and v[1] == s):
                if yes:
                    at[low], at[low + 1] = at[low + 1], at[low]
            want += [(r, s, w, p) for p, w in enumerate(at)]
    df = spark.createDataFrame(x, "run int, step int, low int, accepted boolean")
    for block in (1, 7, 1000):
        assert sorted((r["run"], r["step"], r["walker"], r["place"]) for r in events.walker_positions(df, block=block).collect()) == sorted(want)


def test_basins_of_three_angles(spark):
    """Catchments, merged modes and circular measures against a NumPy version."""
    rng = np.random.default_rng(4)
    n, near = 12, 180.0
    x = np.concatenate([rng.normal(m, 14, (500 - 120 * k, 3)) for k, m in enumerate([(170, 0, 60), (-60, 90, 60), (-60, 150, 60), (20, -120, -90)])])
    x = (x + 180) % 360 - 180
    c = np.floor((x % 360) / (360 / n)).astype(int)
    hist = np.zeros((n, n, n))
    np.add.at(hist, tuple(c.T), 1)
    d = np.zeros_like(hist)
    shifts = [(a, b, e) for a in (-1, 0, 1) for b in (-1, 0, 1) for e in (-1, 0, 1)]
    for s in shifts:
        d += np.roll(hist, s, (0, 1, 2)) * (2 - abs(s[0])) * (2 - abs(s[1])) * (2 - abs(s[2])) / 64
    ids = np.arange(n**3).reshape(n, n, n)
    best, up = d.copy(), ids.copy()
    for s in shifts:
        m, k = np.roll(d, s, (0, 1, 2)), np.roll(ids, s, (0, 1, 2))
        better = (m > best) | ((m == best) & (k < up))
        best, up = np.where(better, m, best), np.where(better, k, up)
    up = up.ravel()
    while (up[up] != up).any():
        up = up[up]
    top = up[c @ [n * n, n, 1]]
    modes = sorted(((-(top == t).sum(), t) for t in set(top.tolist())))
    lead, to = [], {}
    for _, t in modes:
        at = np.array([t // (n * n), t // n % n, t % n])
        gaps = [(np.linalg.norm((lambda g: np.minimum(g, n - g) * 360 / n)(np.abs(at - np.array([u // (n * n), u // n % n, u % n])))), u) for u in lead]
        close = [g for g in gaps if g[0] <= near]
        to[t] = min(close)[1] if close else t
        lead += [] if close else [t]
    groups = np.array([to[t] for t in top.tolist()])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r["basin"]: r for r in density.density_basins3d(df, ["a", "b", "c"], n, 0.02, near).collect()}
    want = {g: (groups == g).sum() for g in set(groups.tolist()) if (groups == g).mean() >= 0.02}
    assert {k: r["n"] for k, r in got.items()} == want and len(lead) < len(modes)
    for g, r in got.items():
        z = np.exp(1j * np.radians(x[groups == g])).mean(axis=0)
        assert np.allclose([r[f"mean_{k}"] for k in "abc"], np.degrees(np.angle(z))) and np.allclose([r[f"sd_{k}"] for k in "abc"], np.degrees(np.sqrt(-2 * np.log(np.abs(z)))))


def test_inference(spark):
    """Tails of t and F at tabled points, and intervals of a line and a plane against normal equations."""
    from framewise.functions import student

    assert student.t_quantile(0.95, 10) == pytest.approx(2.228138852, abs=1e-8) and student.t_quantile(0.95, 2) == pytest.approx(4.302652730, abs=1e-8)
    assert student.t_two_sided(2.0, 5) == pytest.approx(0.1019394789, abs=1e-9) and student.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 30))
    y = 1 + 2 * a - 0.5 * b + rng.normal(scale=0.4, size=30)
    df = spark.createDataFrame([(0, *map(float, r)) for r in zip(a, b, y)], "k int, a double, b double, y double")
    for x, r, names in ((np.column_stack([np.ones(30), a]), regress.fit_line(df, "a", "y", ["k"]).first(), ("intercept", "slope")), (np.column_stack([np.ones(30), a, b]), regress.fit_plane(df, "a", "b", "y", ["k"]).first(), ("c0", "c1", "c2"))):
        inv = np.linalg.inv(x.T @ x)
        c = inv @ x.T @ y
        n, m = x.shape
        se = np.sqrt(np.diag(inv) * ((y - x @ c) ** 2).sum() / (n - m))
        for i, name in enumerate(names):
            assert r[name] == pytest.approx(c[i]) and r[f"se_{name}"] == pytest.approx(se[i])
            assert r[f"{name}_high"] - r[f"{name}_low"] == pytest.approx(2 * student.t_quantile(0.95, n - m) * se[i])


def test_expire(spark):
    from framewise import runtime

    df = spark.range(3)
    kept = runtime.materialise(df)
    assert runtime.expire(spark, hours=1.0) == 0 and kept.count() == 3
    assert runtime.expire(spark, hours=-1.0) > 0 and runtime.materialise(df).count() == 3


def test_geometry(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(size=(6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    noisy = ref + rng.normal(scale=0.3, size=ref.shape)
    arrays = [ref, ref @ q.T + 5, noisy, -ref]

    def kabsch(a, b):
        a, b = a - a.mean(0), b - b.mean(0)
        u, s, v = np.linalg.svd(a.T @ b)
        s[-1] *= np.sign(np.linalg.det(u @ v))
        return math.sqrt(max(0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)))

    df = frames(spark, arrays)
    got = {r["frame"]: r["rmsd"] for r in geometry.rmsd(df, df.where("frame = 0")).collect()}
    assert all(got[k] == pytest.approx(kabsch(a, ref), abs=1e-5) for k, a in enumerate(arrays))
    square = frames(spark, [[(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1)], [(0, 0, 0)] * 4])
    t = {r["frame"]: r["t"] for r in geometry.dihedrals(square, {"t": (1, 2, 3, 4)}, None).collect()}
    assert abs(t[0]) == pytest.approx(90) and t[1] is None
    assert geometry.bond_angle(square.where("frame = 0"), 1, 2, 3, None).first()["angle"] == pytest.approx(90)
    hexagon = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3), 0) for k in range(6)]
    assert geometry.ring_planarity(frames(spark, [hexagon]), [1, 2, 3, 4, 5, 6], 50.0).first()["planarity"] == pytest.approx(0, abs=1e-6)
    s = frames(spark, [[(25, 25, 25), (25, 25, 40)]])
    assert pairs.sasa(s.where("atom_id = 1"), s, 2.0, 200, 50.0).first()["area"] == pytest.approx(16 * math.pi)
    chain = frames(spark, [[(9.5, 0, 0), (0.5, 0, 0), (1.5, 0, 0), (5, 5, 5)]]).withColumn("mol", F.lit(1))
    bonds = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "mol int, a bigint, b bigint")
    u = {r["atom_id"]: r["x"] for r in geometry.unwrap_molecule(chain, bonds, 10.0, 4).collect()}
    assert u[2] == pytest.approx(10.5) and u[3] == pytest.approx(11.5) and u[4] is None


def test_graphs(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 1, 4), (0, 4, 3), (0, 3, 5), (0, 7, 8), (1, 1, 2)], "frame int, a bigint, b bigint")
    ends = spark.createDataFrame([(0, 1, 5), (1, 1, 9), (2, 3, 3)], "frame int, source bigint, target bigint")
    got = {r["frame"]: (r["connected"], r["n_bridging"], r["path"]) for r in graph.shortest_path(e, ends, 3, ["frame"]).collect()}
    assert got == {0: (True, 2, [1, 2, 3, 5]), 1: (False, -1, None), 2: (True, -1, [3])}
    assert {r["frame"]: r["largest"] for r in graph.largest_component(e, ["frame"]).collect()} == {0: 5, 1: 2}
    ring = spark.createDataFrame([(0, k, (k + 1) % 5) for k in range(5)] + [(0, 0, 9)], "frame int, a bigint, b bigint")
    assert [r["ring"] for r in graph.five_rings(ring, spark.createDataFrame([(0, 0)], "frame int, node bigint"), ["frame"]).collect()] == [[0, 1, 2, 3, 4]]
    net = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "c", 2.0), (0, "a", "c", 3.5)], "k int, a string, b string, gap double")
    v = {r["node"]: (r["potential"], r["spread"]) for r in graph.network_potentials(net, spark.createDataFrame([(0, "a", 0.0)], "k int, node string, potential double"), 3, ["k"]).collect()}
    assert v["b"][0] == 1.0 and v["c"][0] == 3.5 and v["c"][1] == pytest.approx(0.5)


def test_events(spark):
    s = spark.createDataFrame([(0, float(k), float(v)) for k, v in enumerate([0, 1, 0, 1, 1, 1, 0, 1, 1])], "run int, t double, value double")
    got = events.islands(s, F.col("value") > 0, dt=1.0).orderBy("start").collect()
    assert [(r["start"], r["n"], r["duration"]) for r in got] == [(1.0, 1, 1.0), (3.0, 3, 3.0), (7.0, 2, 2.0)]
    assert events.first_sustained(s, F.col("value") > 0, 2.0).first()["start"] == 3.0  # a one-frame excursion doesn't trigger
    p = spark.createDataFrame([("w", k, v) for k, v in enumerate([0, 1, 2, 1, 0, 2, 0])], "walker string, step int, place int")
    r = events.round_trips(p, 0, 2).first()
    assert (r["n_trips"], r["mean_steps"]) == (2, 3.0)
    x = spark.createDataFrame([(0, 1, 0, True), (0, 2, 1, True), (0, 3, 0, False)], "run int, step int, low int, accepted boolean")
    last = {r["walker"]: r["place"] for r in events.walker_positions(x).where("step = 3").collect()}
    assert last == {0: 2, 1: 0, 2: 1}
    with pytest.raises(Exception, match="clock"):
        align.stitch_restart(s, s).collect()
    assert align.stitch_restart(s, s, shift=True).count() == 17


def test_blocks_of_one_run(spark):
    """One run that holds all rows, cut into blocks of any number of rows, gives what the whole run gives."""
    rng = np.random.default_rng(7)
    t = np.cumsum(rng.choice([1.0, 1.0, 1.0, 5.0], 300))
    v = np.repeat(rng.integers(0, 3, 100), 3)
    s = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(t, v)] + [(1, 3.5, 1)], "run int, t double, value int")
    grid = spark.createDataFrame([(r, float(x)) for r in (0, 1) for x in rng.uniform(-20, t[-1] + 20, 60)], "run int, t double")
    few = s.where("value = 2")
    plain = lambda df: sorted(map(str, df.collect()))
    for block in (2, 17, 10**6):
        for how in ({}, {"gap": 3.0}, {"value": F.col("value")}, {"value": F.col("value"), "gap": 3.0, "dt": 1.0}):
            assert plain(events.islands(s, F.col("value") > 0, size=block, **how)) == plain(events.islands(s, F.col("value") > 0, **how))
        assert plain(events.first_sustained(s, F.col("value") > 0, 8.0, size=block)) == plain(events.first_sustained(s, F.col("value") > 0, 8.0))
        for b in (s, few):
            assert plain(align.asof_backward(grid, b, ["value"], size=block)) == plain(align.asof_backward(grid, b, ["value"]))
            assert plain(align.nearest_time_join(grid, b, ["value"], 4.0, size=block)) == plain(align.nearest_time_join(grid, b, ["value"], 4.0))
            assert plain(align.interp_join(grid, b, size=block)) == plain(align.interp_join(grid, b))
        assert plain(align.station_times(s, 7.0, size=block)) == plain(align.station_times(s, 7.0))


def test_estimators(spark):
    rng = np.random.default_rng(3)
    k, n, kt = 4, 60, 0.6
    mu = np.arange(k) * 0.5
    x = rng.normal(mu[:, None], 1, (k, n))
    u = 0.3 * (x[:, :, None] - mu) ** 2 + np.arange(k) * 0.2
    df = spark.createDataFrame([(j, f + 1, u[j, f].tolist()) for j in range(k) for f in range(n)], "sample int, frame bigint, u array<double>")
    red = u.reshape(-1, k) / kt
    f = np.zeros(k)
    for _ in range(2000):
        new = -np.log((np.exp(-red) / (n * np.exp(f - red)).sum(1, keepdims=True)).sum(0))
        f = new - new[0]
    got, overlap, sd = FE.mbar(df, k, kt)
    assert np.allclose(got, kt * f, atol=1e-6)
    o = overlap.groupBy("i").agg(F.sum("overlap").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1, abs=1e-6) for r in o)
    w = (u[0, :, 1] - u[0, :, 0]) / kt
    e = {r["edge"]: r for r in FE.fep_edges(df, k, kt).collect()}
    assert e[0]["forward"] == pytest.approx(-kt * math.log(np.exp(-w).mean()))
    sym = spark.createDataFrame([(0, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0])], "sample int, frame bigint, u array<double>")
    assert FE.bar_edges(sym, 2, 1.0).first()["bar"] == pytest.approx(1.0)  # symmetric work
    lam = [0.0, 0.5, 1.0]
    quad = spark.createDataFrame([(j, f, [3 * a * a + 2 * a + 7 for a in lam]) for j in range(3) for f in range(1, 5)], "sample int, frame bigint, u array<double>")
    t = FE.ti(quad, lam, 2).withColumn("key", F.lit(0))
    assert FE.trapezoid(t, "lambda", "du_dl", ["key"]).first()["integral"] == pytest.approx(5.0)


def test_wham_and_weights(spark):
    rng = np.random.default_rng(4)
    kt, k = X.GAS_KCAL * 300, 2.0
    rows = []
    for w, c in enumerate(np.arange(-2, 2.1, 0.5)):
        # a harmonic well of stiffness 1 under umbrellas of stiffness k: exact normal samples
        rows += [(w, float(c), float(v)) for v in rng.normal(2 * k * c / (2 * k + 1), math.sqrt(kt / (2 * k + 1)), 3000)]
    df = spark.createDataFrame(rows, "window int, target double, value double")
    pmf = [r for r in FE.wham(df, k, 300.0, -1.5, 1.5, 30).collect() if r["pmf"] is not None]
    off = np.array([r["pmf"] - 0.5 * r["x"] ** 2 for r in pmf if abs(r["x"]) < 1.2])
    assert np.ptp(off) < 0.25
    s = spark.createDataFrame([(0, float(t), 0.1 * t) for t in range(8)], "run int, t double, value double")
    h = spark.createDataFrame([(0, 2.0, 0.2, 0.5, 0.3), (0, 5.0, 0.5, 0.5, 0.3)], "run int, t_hill double, center double, height double, width double")
    got = FE.tp_weights(s, h, 300.0, -1.0, 2.0, 301, ["run"]).orderBy("t").collect()
    assert got[0]["bias"] == got[1]["bias"] == 0 and sum(r["weight"] for r in got) == pytest.approx(1)
    assert got[6]["bias"] == pytest.approx(sum(0.5 * math.exp(-0.5 * ((0.6 - c) / 0.3) ** 2) for c in (0.2, 0.5)))
    b = FE.block_bootstrap(s.withColumn("idx", F.col("t").cast("bigint")), ["value"], 3, 3, 1, ["run"]).collect()
    assert sorted((r["replica"], r["n"]) for r in b) == [(k, 8) for k in range(4)]


def test_fits(spark):
    ph = np.arange(3, 11, 0.5)
    f = 1 / (1 + 10 ** (0.9 * (6.4 - ph)))
    one = spark.createDataFrame([("a", float(p), float(v)) for p, v in zip(ph, f)], "site string, ph double, fraction double")
    r = T.fit_titration_grid(one, ["site"], 2.0, 12.0, 21, 6).first()
    assert r["pka"] == pytest.approx(6.4, abs=0.01) and r["hill"] == pytest.approx(0.9, abs=0.01)
    a, b, w = 5.5, 7.0, 0.8
    s = np.stack([np.ones_like(ph), 10 ** (ph - a), 10 ** (ph - b), 10 ** (2 * ph - a - b - w)])
    s /= s.sum(0)
    two = spark.createDataFrame([("x", *map(float, (p, *v))) for p, v in zip(ph, s.T)], "site string, ph double, p11 double, p01 double, p10 double, p00 double")
    r = T.fit_two_site(two, ["site"], 25).first()
    assert (r["pk_a"], r["pk_b"], r["w"]) == pytest.approx((a, b, w), abs=1e-3)
    m = np.stack([np.ones_like(ph), 10 ** (ph - 6.0), 10 ** (ph - 6.5)])
    m /= m.sum(0)
    tau = spark.createDataFrame([("x", *map(float, (p, *v))) for p, v in zip(ph, m.T)], "site string, ph double, s0 double, s1 double, s2 double")
    r = T.fit_microstates(tau, ["site"], 2, 20).first()
    assert (r["pk1"], r["pk2"]) == pytest.approx((6.0, 6.5), abs=1e-3) and r["macro"] == pytest.approx(-math.log10(10**-6.0 + 10**-6.5), abs=1e-3)
    lag = range(30)
    acf = spark.createDataFrame([(0, k, 0.2 + 0.8 * math.exp(-k / 5)) for k in lag], "run int, lag int, c double")
    r = regress.fit_decay(acf, ["run"], 2.0, 20).first()
    assert (r["tau"], r["plateau"]) == pytest.approx((5.0, 0.2), abs=1e-3)
    osc = spark.createDataFrame([(0, k, math.exp(-0.1 * k) * math.cos(0.6 * k)) for k in lag], "run int, lag int, c double")
    r = regress.fit_model(osc, ["run"], "underdamped", {"rate": 0.15, "omega": 0.55}, 20).first()
    assert (r["rate"], r["omega"]) == pytest.approx((0.1, 0.6), abs=1e-3)


def test_density(spark):
    v = [0.0, 0.1, 0.5, 1.0, 1.0, 2.0, -1.0]
    df = spark.createDataFrame([(0, x) for x in v], "k int, value double")
    h = density.hist1d(df, "value", 0.0, 1.0, 4, ["k"]).orderBy("bin").collect()
    assert [r["n"] for r in h] == np.histogram([x for x in v if 0 <= x <= 1], 4, (0, 1))[0].tolist()
    n = np.random.default_rng(0).poisson(5, (6, 6))
    cells = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(6) for j in range(6)], "i int, j int, n bigint")
    p = np.pad(n, 1, mode="edge")
    want = sum((2 - abs(a)) * (2 - abs(b)) / 16 * p[1 + a : 7 + a, 1 + b : 7 + b] for a in (-1, 0, 1) for b in (-1, 0, 1))
    got = np.zeros((6, 6))
    for r in density.smooth2d(cells, 6, 6).collect():
        got[r["i"], r["j"]] = r["smooth"]
    assert np.allclose(got, want)
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(c, 8, (300, 3)) for c in (60, 200)]) % 360
    b = density.density_basins3d(spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double"), ["a", "b", "c"], 12, 0.1).collect()
    assert len(b) == 2 and all(abs(r["population"] - 0.5) < 0.02 for r in b)
    f = spark.createDataFrame([(0, x / 10, float((x / 10 - 1) ** 2)) for x in range(21)], "k int, x double, f double")
    c = density.level_crossings(f, "x", "f", 0.25, ["k"]).first()
    assert (c["left"], c["right"]) == pytest.approx((0.5, 1.5)) and density.local_parabola(f, "x", "f", 0.35, ["k"]).first()["curvature"] == pytest.approx(1.0)
    sm = FE.smooth_pmf(f, 0.0, ["k"]).collect()
    assert all(r["smooth"] == pytest.approx(r["f"]) for r in sm)


def test_flat_trans_torsion_keeps_its_sign(spark):
    v = spark.createDataFrame([(0.0,), (-0.0,)], "z double").selectExpr("z", "cast(1 as double) as a", "cast(-1 as double) as b")
    n = lambda *c: [F.col(k) if isinstance(k, str) else F.lit(k) for k in c]
    # normals (0, 1, 0) and (z, -1, 0): the cross product's last component is -z
    got = [r[0] for r in v.select(X.torsion_of(n(0.0, "a", 0.0), n("z", "b", 0.0), n(-0.0, -0.0, "a"))).collect()]
    assert sorted(got) == [-180.0, 180.0]


def test_basin_residence_multiplies_no_samples(spark):
    """Each sample is held against its surface's minima in its own row: none is copied for every minimum and gathered again."""
    s = spark.createDataFrame([(r, float(t), float(10 * t + r), r % 2) for r in range(6) for t in range(9)], "run int, t double, value double, surface int")
    m = spark.createDataFrame([(0, "a", 10.0), (0, "b", 60.0), (1, "c", 30.0), (1, "d", 30.0)], "surface int, basin string, x double")
    x = agg.basin_residence(s, m, "surface")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan.lower() and "SortMergeJoin" not in plan
    got = {(r["run"], r["basin"]): r["residence"] for r in x.collect()}
    assert got[0, "a"] == 4.0 and got[0, "b"] == 4.0 and got[1, "c"] == 8.0 and (1, "d") not in got


def test_sasa_points_are_made_once(spark):
    """The sphere's points are numbers in the plan, not trigonometry for every blocker of an atom; a lone atom keeps its sphere, one inside another's loses half."""
    a = spark.createDataFrame([(1, 1, "O", 10.0, 10.0, 10.0), (1, 2, "O", 10.0, 10.0, 10.0001), (2, 1, "O", 0.0, 0.0, 0.0)], "frame int, atom_id int, element string, x double, y double, z double")
    x = pairs.sasa(a, a, 3.0, 60, 50.0)
    assert "COS(" not in x._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["frame"], r["i"]): r["area"] / (4 * math.pi * 9) for r in x.collect()}
    assert got == pytest.approx({(1, 1): 0.5, (1, 2): 0.5, (2, 1): 1.0})
