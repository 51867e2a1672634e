"""Titration, binding and spectra models. Fits are sums of products per group in Spark; only parameters travel."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import GAS_KCAL, log1pexp


def fit_hh(df: DataFrame, keys: list[str], ph: str = "ph", fraction: str = "fraction") -> DataFrame:
    """M1: pKa and Hill coefficient from the straight line log10((1 - f) / f) against pH, points at 0 and 1 left out."""
    y = F.log10((1 - F.col(fraction)) / F.col(fraction))
    x = df.where((F.col(fraction) > 0) & (F.col(fraction) < 1)).withColumn("_y", y)
    g = x.groupBy(*keys).agg(F.regr_slope("_y", ph).alias("_s"), F.regr_intercept("_y", ph).alias("_i"), F.count("*").alias("n"))
    return g.select(*keys, F.try_divide(-F.col("_i"), F.col("_s")).alias("pka"), (-F.col("_s")).alias("hill"), "n")


def deprotonated(ph: Column, pka: Column | float, hill: Column | float = 1.0) -> Column:
    pka, hill = (F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (pka, hill))
    return 1 / (1 + F.pow(F.lit(10.0), hill * (pka - ph)))


def fit_titration_grid(df: DataFrame, keys: list[str], lo: float | None, hi: float | None, points: int = 41, rounds: int = 4, ph: str = "ph", fraction: str = "fraction", hills: tuple[float, float] | float = (0.2, 3.8)) -> DataFrame:
    """M2: least squares over a grid of (pKa, Hill) of `points` a side, refined around the best point in each round: keys, pka, hill, sse.

    Rows are reduced to counts, means and spreads by pH first, so a round's work is the grid times the pH values, whatever
    the number of rows. lo, hi: pKa range of the first round (None: the pH range and 2 on either side). hills: range of the
    Hill coefficient, or one value, which leaves the pKa as the only parameter. With a stated pKa range the next round spans
    two steps on either side, else three, and the pKa's centre is the start.
    """
    from ..runtime import materialise

    one = not isinstance(hills, (tuple, list))
    n, reach = points - 1, 2 if lo is not None else 3
    least = 0.05 if lo is not None else 0.01
    df = materialise(df.groupBy(*keys, F.col(ph).cast("double").alias("_ph")).agg(F.count(fraction).alias("_n"), F.avg(fraction).alias("_f"), F.coalesce(F.var_pop(fraction), F.lit(0.0)).alias("_v")))
    low, high = (F.lit(float(lo)), F.lit(float(hi))) if lo is not None else (F.min("_ph") - 2, F.max("_ph") + 2)
    h0, h1 = (hills, hills) if one else hills
    best = df.groupBy(*keys).agg(low.alias("plo"), high.alias("phi")).withColumns({"hlo": F.lit(float(h0)), "hhi": F.lit(float(h1))})
    for _ in range(rounds):
        step = {"ps": (F.col("phi") - F.col("plo")) / n, "hs": (F.col("hhi") - F.col("hlo")) / n}
        g = best.withColumns({**step, "i": F.explode(F.sequence(F.lit(0), F.lit(n)))}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(0 if one else n))))
        g = g.select(*keys, "ps", "hs", (F.col("plo") + F.col("i") * F.col("ps")).alias("pka"), F.greatest(F.lit(least), F.col("hlo") + F.col("j") * F.col("hs")).alias("hill"))
        e = F.col("_f") - deprotonated(F.col("_ph"), F.col("pka"), F.col("hill"))
        s = df.join(g, keys).groupBy(*keys, "pka", "hill", "ps", "hs").agg(F.sum(F.col("_n") * (e * e + F.col("_v"))).alias("sse"))
        m = materialise(s.groupBy(*keys, "ps", "hs").agg(F.min(F.struct("sse", "pka", "hill")).alias("m")).select(*keys, "m.*", "ps", "hs"))
        best = m.select(*keys, (F.col("pka") - reach * F.col("ps")).alias("plo"), (F.col("pka") + reach * F.col("ps")).alias("phi"), (F.col("hill") if one else F.greatest(F.lit(least), F.col("hill") - reach * F.col("hs")) if lo is None else F.col("hill") - reach * F.col("hs")).alias("hlo"), (F.col("hill") if one else F.col("hill") + reach * F.col("hs")).alias("hhi"))
    return m.select(*keys, "pka", "hill", "sse")


def microstate_weights(ph: Column, pkas: list[Column]) -> list[Column]:
    """M4: shares of one protonated state and n deprotonated tautomers with the given pKas."""
    w = [F.pow(F.lit(10.0), ph - p) for p in pkas]
    total = 1 + sum(w[1:], w[0])
    return [1 / total, *[x / total for x in w]]


def macro_pka(pkas: list[Column]) -> Column:
    return -F.log10(sum((F.pow(F.lit(10.0), -p) for p in pkas[1:]), F.pow(F.lit(10.0), -pkas[0])))


#: Sum of squared residuals, of that of the values, that is only rounding.
FLOOR = 1e-28


def gauss_newton(df: DataFrame, keys: list[str], model: dict[str, tuple], start: dict[str, float] | list[dict[str, float]], rounds: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """Damped Gauss-Newton least squares of every key at once.

    model: observed column -> (value, [derivative by each parameter]) as functions of the parameters' Columns. Each round
    is one aggregation of J^T J, J^T r and r^T r by key; the small systems are solved by elimination in expressions, and a
    step that does not lower the sum of squares is undone and damped more. A key has converged when a step lowers the sum
    by less than tolerance of it, when it is at the rounding of the values, or when no step of any length lowers it; it then leaves the rounds, which end when all
    keys have. Of several starts each key keeps the one with the least sum. Returns the parameters, sse and converged.
    """
    from ..runtime import materialise

    starts = [start] if isinstance(start, dict) else start
    if len(starts) > 1:
        numbered = df.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1))))
        at = {p: F.element_at(F.array(*[F.lit(float(s[p])) for s in starts]), F.col("_start") + 1) for p in starts[0]}
        every = _gauss_newton(numbered, [*keys, "_start"], model, at, rounds, tolerance, materialise)
        best = F.min_by(F.struct(*starts[0], "sse", "converged"), F.struct(F.coalesce(F.nanvl("sse", F.lit(float("inf"))), F.lit(float("inf"))), "_start"))
        return every.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")
    return _gauss_newton(df, keys, model, {p: F.lit(float(v)) for p, v in starts[0].items()}, rounds, tolerance, materialise)


def _solve():
    """Solutions of small dense systems, one a row (matrix by rows, right side); NaN where there is none. Rows are keys, so they are few."""

    def solve(matrix: pd.Series, right: pd.Series) -> pd.Series:
        import numpy as np

        def one(a, b):
            a, b = np.array(a, float), np.array(b, float)
            try:
                return np.linalg.solve(a.reshape(len(b), len(b)), b)
            except np.linalg.LinAlgError:
                return np.full(len(b), np.nan)

        return pd.Series([one(a, b) for a, b in zip(matrix, right)], dtype=object)

    return F.pandas_udf(solve, "array<double>")


def _gauss_newton(df: DataFrame, keys: list[str], model: dict[str, tuple], start: dict[str, Column], rounds: int, tolerance: float, materialise) -> DataFrame:
    names = list(start)
    n = len(names)
    df = materialise(df)
    state = df.select(*keys).distinct().select("*", F.lit(False).alias("_done"), *[v.alias(p) for p, v in start.items()], *[v.alias(f"_old_{p}") for p, v in start.items()], F.lit(None).cast("double").alias("_sse"), F.lit(1e-3).alias("_damp"), *[F.lit(0.0).alias(f"_a{i}{j}") for i in range(n) for j in range(n)], *[F.lit(0.0).alias(f"_b{i}") for i in range(n)])
    for _ in range(rounds):
        p = [F.col(c) for c in names]
        finished, going = state.where("_done"), state.where("not _done")
        x = df.join(going.select(*keys, *names), keys)
        # residuals and slopes as columns, then sums of their products: no formula stands in a sum
        cols = {}
        for k, (obs, (value, slopes)) in enumerate(model.items()):
            cols |= {f"_o{k}": F.col(obs), f"_r{k}": F.col(obs) - value(*p), **{f"_j{k}_{i}": s(*p) for i, s in enumerate(slopes)}}
        x = x.select(*keys, *[c.alias(name) for name, c in cols.items()])
        add = lambda parts: F.sum(sum(parts[1:], parts[0]))
        each = range(len(model))
        sums = {"_n": add([F.col(f"_r{k}") * F.col(f"_r{k}") for k in each]), "_y": add([F.col(f"_o{k}") * F.col(f"_o{k}") for k in each])}
        for i in range(n):
            sums[f"_g{i}"] = add([F.col(f"_j{k}_{i}") * F.col(f"_r{k}") for k in each])
            for j in range(n):
                sums[f"_h{i}{j}"] = add([F.col(f"_j{k}_{i}") * F.col(f"_j{k}_{j}") for k in each])
        y = x.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()]).join(going, keys)
        good = F.col("_sse").isNull() | (F.col("_n") <= F.col("_sse"))
        ends = F.coalesce(good & (F.col("_sse") - F.col("_n") <= tolerance * F.col("_n") + 1e-300), F.lit(False)) | F.coalesce(F.col("_n") <= FLOOR * F.col("_y"), F.lit(False)) | (~good & (F.col("_damp") > 1e9))
        base = [F.when(good, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in names]
        y = y.select(*keys, ends.alias("_done"), *[b.alias(f"_o{i}") for i, b in enumerate(base)], F.when(good, F.col("_n")).otherwise(F.col("_sse")).alias("_sse"), F.when(good, F.greatest(F.lit(1e-9), F.col("_damp") / 5)).otherwise(F.col("_damp") * 8).alias("_damp"), *[F.when(good, F.col(f"_h{i}{j}")).otherwise(F.col(f"_a{i}{j}")).alias(f"_a{i}{j}") for i in range(n) for j in range(n)], *[F.when(good, F.col(f"_g{i}")).otherwise(F.col(f"_b{i}")).alias(f"_b{i}") for i in range(n)])
        matrix = F.array(*[F.col(f"_a{i}{j}") * (1 + F.col("_damp")) + 1e-12 if i == j else F.col(f"_a{i}{j}") for i in range(n) for j in range(n)])
        y = y.withColumn("_step", _solve()(matrix, F.array(*[F.col(f"_b{i}") for i in range(n)])))
        y = y.select(*keys, "_done", *[(F.col(f"_o{i}") + F.col("_step")[i]).alias(c) for i, c in enumerate(names)], *[F.col(f"_o{i}").alias(f"_old_{c}") for i, c in enumerate(names)], "_sse", "_damp", *[f"_a{i}{j}" for i in range(n) for j in range(n)], *[f"_b{i}" for i in range(n)])
        state = materialise(y.unionByName(finished))
        if state.where("not _done").isEmpty():
            break
    return state.select(*keys, *[F.col(f"_old_{c}").alias(c) for c in names], F.col("_sse").alias("sse"), F.col("_done").alias("converged"))


def fit_two_site(df: DataFrame, keys: list[str], rounds: int = 25, ph: str = "ph") -> DataFrame:
    """M3: p00, p10, p01, p11 of two coupled sites fitted to pk10, pk01 and the coupling w (in pK units); macroscopic pKas."""
    ten, ln = F.lit(10.0), math.log(10)

    def shares(a, b, w):
        x = F.col(ph)
        s = {"p11": F.lit(1.0), "p01": F.pow(ten, x - a), "p10": F.pow(ten, x - b), "p00": F.pow(ten, 2 * x - a - b - w)}
        total = s["p11"] + s["p01"] + s["p10"] + s["p00"]
        return {k: v / total for k, v in s.items()}

    power = {"p11": (0, 0, 0), "p01": (1, 0, 0), "p10": (0, 1, 0), "p00": (1, 1, 1)}

    def slope(k, i):
        # d share / d parameter = -ln 10 * share * (own power - mean power)
        def f(*p):
            s = shares(*p)
            return -ln * s[k] * (power[k][i] - sum((s[q] * power[q][i] for q in power), F.lit(0.0)))

        return f

    model = {k: ((lambda k: lambda *p: shares(*p)[k])(k), [slope(k, i) for i in range(3)]) for k in power}
    x = gauss_newton(df, keys, model, {"pk_a": 7.0, "pk_b": 7.0, "w": 0.0}, rounds)
    first = -F.log10(F.pow(ten, -F.col("pk_a")) + F.pow(ten, -F.col("pk_b")))
    return x.select(*keys, "pk_a", "pk_b", "w", first.alias("macro_1"), (F.col("pk_a") + F.col("pk_b") + F.col("w") - first).alias("macro_2"), "sse", "converged")


def fit_microstates(df: DataFrame, keys: list[str], n: int, rounds: int = 25, ph: str = "ph") -> DataFrame:
    """M4: shares s0 (protonated), s1..sn (tautomers) fitted to one pKa a tautomer; macroscopic pKa."""
    ln = math.log(10)
    share = lambda k: lambda *p: microstate_weights(F.col(ph), list(p))[k]
    slope = lambda k, i: lambda *p: -ln * share(k)(*p) * ((1.0 if k == i + 1 else 0.0) - share(i + 1)(*p))
    x = gauss_newton(df, keys, {f"s{k}": (share(k), [slope(k, i) for i in range(n)]) for k in range(n + 1)}, {f"pk{i + 1}": 7.0 for i in range(n)}, rounds)
    return x.withColumn("macro", macro_pka([F.col(f"pk{i + 1}") for i in range(n)]))


def titration_curve(sites: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
    """M5: deprotonated fraction of each site (pka, hill) on a dense pH grid."""
    n = int(round((hi - lo) / step))
    x = sites.withColumn("ph", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: lo + i * step)))
    return x.withColumn("fraction", deprotonated(F.col("ph"), F.col("pka"), F.col("hill")))


def binding_linkage(df: DataFrame, temperature: float, ph0: float, ph: str = "ph", bound: str = "pka_bound", free: str = "pka_free", dg0: str = "dg0") -> DataFrame:
    """M6: protons taken up on binding, and the binding free energy and constant at each pH from its value dg0 at ph0."""
    ln, rt = math.log(10), GAS_KCAL * temperature
    proton = lambda pk: 1 / (1 + F.pow(F.lit(10.0), F.col(ph) - F.col(pk)))
    g = lambda x: log1pexp(ln * (F.col(free) - x)) - log1pexp(ln * (F.col(bound) - x))
    dg = F.col(dg0) + rt * (g(F.col(ph)) - g(F.lit(float(ph0))))
    return df.withColumns({"dn_h": proton(bound) - proton(free), "dg": dg}).withColumn("kd", F.exp(F.col("dg") / rt))


def spectral_mixture_peak(populations: DataFrame, spectra: DataFrame, keys: list[str]) -> DataFrame:
    """M7: population-weighted spectrum of each key and its peak, refined by the vertex through the highest point and its neighbours. populations: (keys, state, p); spectra: (state, wl, a)."""
    mix = populations.join(spectra, "state").groupBy(*keys, "wl").agg(F.sum(F.col("p") * F.col("a")).alias("a"))
    w = Window.partitionBy(*keys).orderBy("wl")
    y = mix.withColumns({"_l": F.lag("a").over(w), "_r": F.lead("a").over(w), "_d": F.lead("wl").over(w) - F.col("wl")})
    m = y.groupBy(*keys).agg(F.max(F.struct("a", (-F.col("wl")).alias("n"), "_l", "_r", "_d")).alias("m"))
    bend = F.col("m._l") - 2 * F.col("m.a") + F.col("m._r")
    return m.select(*keys, (-F.col("m.n") + F.coalesce(F.when(bend < 0, F.col("m._d") * (F.col("m._l") - F.col("m._r")) / (2 * bend)), F.lit(0.0))).alias("peak"), F.col("m.a").alias("height"))


def fit_sigmoid(df: DataFrame, keys: list[str], lo: float, hi: float, points: int, ph: str = "ph", y: str = "y") -> DataFrame:
    """M8: y = low + (high - low) * deprotonated(pH, pKa): linear in low and high, so a grid over pKa with a regression at each point."""
    g = df.withColumn("pka", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + i * ((hi - lo) / (points - 1)))))
    g = g.withColumn("_f", deprotonated(F.col(ph), F.col("pka")))
    s = g.groupBy(*keys, "pka").agg(F.regr_slope(y, "_f").alias("b"), F.regr_intercept(y, "_f").alias("a"), (F.regr_syy(y, "_f") - F.try_divide(F.pow(F.regr_sxy(y, "_f"), F.lit(2)), F.regr_sxx(y, "_f"))).alias("sse"))
    m = s.where("sse is not null").groupBy(*keys).agg(F.min(F.struct("sse", "pka", "a", "b")).alias("m"))
    return m.select(*keys, "m.pka", F.col("m.a").alias("low"), (F.col("m.a") + F.col("m.b")).alias("high"), "m.sse")
