"""Bootstrap, MBAR, autocorrelation, titration grids and wrapped smoothing against plain numpy."""

import math

import numpy as np
import pytest
from framewise.operators import density, freeenergy as FE, geometry, regress, titration as T
from pyspark.sql import functions as F


def test_bootstrap_sums(spark):
    """Every replica's sums are those of its circular blocks, also where one goes round the end or a series is shorter than a block."""
    rng = np.random.default_rng(2)
    rows = [(r, i, float(v), float(v * v)) for r, n in ((0, 50), (1, 23), (2, 4), (3, 1)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "run int, idx int, a double, b double").repartition(3)
    start = lambda n: F.expr(f"(replica * 31 + block * 17 + run * 5) % {n}")
    got = {(r["replica"], r["run"]): r for r in FE.block_bootstrap(df, ["a", "b"], 25, 6, 1, ["run"], start=start).collect()}
    assert len(got) == 26 * 4
    for (rep, run), r in got.items():
        x = np.array([v[2:] for v in rows if v[0] == run])
        n = len(x)
        at = np.concatenate([((rep * 31 + b * 17 + run * 5) % n + np.arange(6)) % n for b in range(math.ceil(n / 6))])[:n] if rep else np.arange(n)
        assert r["n"] == n and [r["sum_a"], r["sum_b"]] == pytest.approx(x[at].sum(axis=0).tolist())
    hashed = FE.block_bootstrap(df, ["a"], 200, 6, 1, ["run"])
    assert hashed.where("n <> case run when 0 then 50 when 1 then 23 when 2 then 4 else 1 end").count() == 0
    est = FE.bootstrap_intervals(hashed.withColumn("m", F.col("sum_a") / F.col("n")), "m", ["run"], 200)
    for r in est.where("run < 2").collect():
        x = np.array([v[2] for v in rows if v[0] == r["run"]])
        assert r["estimate"] == pytest.approx(x.mean()) and r["low"] < r["estimate"] < r["high"] and r["enough"]
        assert 0.4 < r["sd"] / (x.std() / math.sqrt(len(x))) < 1.6


def mbar_numpy(u, counts, rounds=20000):
    f = np.zeros(u.shape[1])
    for _ in range(rounds):
        den = np.log((counts * np.exp(f - u)).sum(axis=1))
        new = -np.log(np.exp(-u - den[:, None]).sum(axis=0))
        new -= new[0]
        if np.abs(new - f).max() < 1e-12:
            break
        f = new
    return f


@pytest.mark.parametrize("gap, counts", [(0.5, [60, 60, 60, 60]), (3.2, [150, 40, 90, 120, 60]), (1.0, [50, 0, 70])])
def test_mbar(spark, monkeypatch, gap, counts):
    """Unequal counts, a state without samples, and poor overlap that takes substitution hundreds of rounds: few passes, the same result."""
    rng = np.random.default_rng(3)
    k = len(counts)
    mu = np.arange(k) * gap
    x = np.concatenate([rng.normal(m, 1, n) for m, n in zip(mu, counts)])
    u = 0.5 * (x[:, None] - mu) ** 2 + np.arange(k) * 0.7
    state = np.repeat(np.arange(k), counts)
    df = spark.createDataFrame([(int(s), (0.6 * v).tolist()) for s, v in zip(state, u)], "sample int, u array<double>").repartition(3)
    passes, was = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: passes.append(1) or was(self, *a, **b))
    f, overlap, sd = FE.mbar(df, k, 0.6)
    want = mbar_numpy(u, np.array(counts, float))
    assert np.allclose(np.array(f) / 0.6, want, atol=1e-6) and len(passes) < 15
    rows = {}
    for r in overlap.collect():
        rows.setdefault(r["i"], []).append(r["overlap"])
    assert all(sum(v) == pytest.approx(1, abs=1e-6) for v in rows.values())
    assert sd[0] == 0 and all(0 < s < 2 for s in sd[1:]) and sd[-1] == max(sd)


def test_mbar_errors(spark):
    """Standard errors agree with the spread over repeated data."""
    rng = np.random.default_rng(5)
    found, told = [], []
    for _ in range(12):
        x = rng.normal(np.repeat([0.0, 1.0], 200), 1)
        u = np.stack([0.5 * x**2, 0.5 * (x - 1) ** 2], axis=1)
        f, _, sd = FE.mbar(spark.createDataFrame([(int(i >= 200), v.tolist()) for i, v in enumerate(u)], "sample int, u array<double>"), 2, 1.0)
        found.append(f[1])
        told.append(sd[1])
    assert 0.5 < np.std(found, ddof=1) / np.mean(told) < 1.8


@pytest.mark.parametrize("size", [None, 20])
def test_autocorrelation(spark, size):
    rng = np.random.default_rng(1)
    series = {r: sorted(rng.choice(200, n, replace=False).tolist()) for r, n in ((0, 150), (1, 40), (2, 1))}  # indices with gaps
    rows = [(r, int(i), float(rng.uniform(0, 360))) for r, idx in series.items() for i in idx]
    got = {(r["run"], r["lag"]): (r["c"], r["n"]) for r in regress.cosine_acf(spark.createDataFrame(rows, "run int, idx int, a double"), F.col("a"), 6, size=size).collect()}
    want = {}
    for r, i, a in rows:
        for q, j, b in rows:
            if r == q and 0 <= j - i <= 6:
                want.setdefault((r, j - i), []).append(math.cos(math.radians(a - b)))
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(np.mean(v)) and got[k][1] == len(v) for k, v in want.items())


def test_titration_grid_from_many_rows(spark):
    """Rows are summed by pH first: a thousand outcomes a pH give the fit of their means, with the rows' own sum of squares."""
    rng = np.random.default_rng(6)
    ph = np.repeat(np.arange(3.0, 10.0, 0.5), 300)
    hit = (rng.random(len(ph)) < 1 / (1 + 10 ** (0.8 * (6.3 - ph)))).astype(float)
    df = spark.createDataFrame([("a", float(p), float(v)) for p, v in zip(ph, hit)], "site string, ph double, fraction double")
    r = T.fit_titration_grid(df, ["site"], None, None, 61, 4, hills=(0.15, 2.0)).first()
    sse = lambda pka, hill: float(((hit - 1 / (1 + 10 ** (hill * (pka - ph)))) ** 2).sum())
    assert r["sse"] == pytest.approx(sse(r["pka"], r["hill"])) and abs(r["pka"] - 6.3) < 0.1
    assert all(r["sse"] <= sse(r["pka"] + a, r["hill"] + b) + 1e-9 for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))
    one = T.fit_titration_grid(df, ["site"], None, None, 241, 4, hills=1.0).first()
    assert one["hill"] == 1.0 and all(one["sse"] <= sse(one["pka"] + a, 1.0) + 1e-9 for a in (-0.01, 0.01))


@pytest.mark.parametrize("sigma", [0.4, 1.1, 3.0])
def test_wrapped_gaussian(spark, sigma):
    """Against a dense array, at three widths, the last wider than the circle."""
    n = 9
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((n, n, n)) < 0.05, rng.integers(1, 9, (n, n, n)), 0).astype(float)
    cells = [(int(c), float(v)) for c, v in enumerate(dense.ravel()) if v]
    got = np.zeros(n**3)
    for r in density.wrapped_gaussian(spark.createDataFrame(cells, "cell bigint, d double"), n, sigma).collect():
        got[r["cell"]] = r["d"]
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in range(3):
        dense = sum(v / w.sum() * np.roll(dense, k, axis) for k, v in zip(range(-reach, reach + 1), w))
    assert np.allclose(got, dense.ravel(), atol=1e-12)


@pytest.mark.parametrize("size", [None, 60])
def test_hill_bias_against_all_pairs(spark, size):
    """The expansion equals the sum over all hills: several widths, ties in time, hills out of reach, a run without hills; blocks of a run hand their sums on."""
    rng = np.random.default_rng(11)
    hills, samples, want = [], [], {}
    for run, width in enumerate((0.05, 0.3, 4.0, 25.0)):
        th, center, height = rng.integers(0, 300, 400) * 1.0, rng.normal(-2, 6, 400), rng.uniform(0.05, 0.5, 400)
        hills += [(run, float(a), float(b), float(c), width) for a, b, c in zip(th, center, height)]
        for t, s in zip(rng.integers(-5, 310, 250), np.concatenate([rng.normal(-2, 6, 200), rng.uniform(-300, 300, 50)])):
            samples.append((run, float(t), float(s)))
            want[run, float(t), float(s)] = (height * np.exp(-0.5 * ((s - center) / width) ** 2))[th <= t].sum()
    samples += [(9, 1.0, 2.0), (9, 1.0, 2.0)]
    want[9, 1.0, 2.0] = 0.0
    s = spark.createDataFrame(samples, "run int, t double, value double")
    h = spark.createDataFrame(hills, "run int, t_hill double, center double, height double, width double")
    got = {(r["run"], r["t"], r["value"]): r["bias"] for r in FE.hill_bias(s, h, ["run"], size=size).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_rmsd_of_flat_straight_and_mirrored_groups(spark):
    """Best-fit deviation equals the one by singular values where the smaller ones are zero, equal or of opposite sign."""
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    base = rng.normal(size=(6, 3)) * 10
    flat, straight = base * [1, 1, 0], base * [1, 0, 0]
    noise = lambda: rng.normal(size=(6, 3)) * 0.3
    cases = [(base, base @ q + noise() + 5), (base, base * [1, 1, -1]), (flat, flat @ q + 3), (flat, flat + noise()), (straight, 1.1 * straight @ q - 7), (straight, base), (base * [20, 1, 1], base * [-20, -1, 1] + noise()), (base[:1], base[:1] + 4), (base[:2], 2 * base[:2] @ q), (0 * base, 0 * base)]
    cases += [(rng.normal(size=(6, 3)) * 10, rng.normal(size=(6, 3)) * 10) for _ in range(40)]
    rows = lambda side: [(k, i, *map(float, x)) for k, c in enumerate(cases) for i, x in enumerate(c[side])]
    schema = "frame int, atom_id int, x double, y double, z double"
    got = {r["frame"]: r["rmsd"] for r in geometry.rmsd(spark.createDataFrame(rows(1), schema), spark.createDataFrame(rows(0), schema), ("frame",), ("frame",)).collect()}
    for k, (a, b) in enumerate(cases):
        a, b = a - a.mean(0), b - b.mean(0)
        u, s, v = np.linalg.svd(a.T @ b)
        s[2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
        assert got[k] == pytest.approx(math.sqrt(max(0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))), abs=2e-6)


def test_soft_minimum_of_touching_atoms(spark):
    from framewise.operators import pairs

    a = spark.createDataFrame([(1, 1, "O", 0.0, 0.0, 0.0), (1, 2, "C", 0.004, 0.0, 0.0)], "frame int, atom_id int, element string, x double, y double, z double")
    got = pairs.soft_min_distance(a.where("element = 'O'"), a.where("element = 'C'"), 20.0, 50.0).first()["soft_min"]
    assert abs(got - 0.004) < 1e-9  # exp(20 / 0.004) is beyond doubles
