"""Free-energy surfaces and estimators. Surfaces: (keys, x, f). Cross energies: (sample, frame, u array<double>), u[k] in state k.

Iterative estimators keep their state in a handful of numbers (one a state or edge) that travel with the plan; each step
is one aggregation over all samples.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import GAS_KCAL, PKA_FACTOR, fermi, kernel
from .runs import long_runs, spans


def min_near(fes: DataFrame, target: float, half: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """in [target - half, target + half] the local minimum nearest the target (edge minima allowed), else the nearest point; ties by energy."""
    w = Window.partitionBy(*keys).orderBy(x)
    y = fes.where(F.col(x).between(target - half, target + half)).withColumns({"_l": F.lag(f).over(w), "_r": F.lead(f).over(w)})
    inner = (F.col(f) < F.col("_l")) & (F.col(f) < F.col("_r"))
    edge = (F.col("_l").isNull() & (F.col(f) <= F.col("_r"))) | (F.col("_r").isNull() & (F.col(f) <= F.col("_l")))
    rank = F.struct((~F.coalesce(inner | edge, F.lit(False))).alias("no"), F.abs(F.col(x) - target).alias("d"), F.col(f).alias("f"), F.col(x).alias("x"))
    return y.groupBy(*keys).agg(F.min(rank).alias("m")).select(*keys, F.col("m.x").alias("x_min"), F.col("m.f").alias("f_min"))


def delta_f(fes: DataFrame, x1: float, x2: float, half: float, temperature: float, keys: list[str]) -> DataFrame:
    """F(min1) - F(min2) and the pKa it stands for."""
    a, b = min_near(fes, x1, half, keys), min_near(fes, x2, half, keys)
    y = a.select(*keys, F.col("f_min").alias("f1")).join(b.select(*keys, F.col("f_min").alias("f2")), keys)
    d = F.col("f1") - F.col("f2")
    return y.select(*keys, d.alias("delta_f"), (d / (PKA_FACTOR * temperature)).alias("pka"))


def side_minima(fes: DataFrame, split: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """least energy below the split and from it on, and their gap."""
    y = fes.groupBy(*keys).agg(F.min(F.when(F.col(x) < split, F.col(f))).alias("left"), F.min(F.when(F.col(x) >= split, F.col(f))).alias("right"))
    return y.withColumn("gap", F.col("right") - F.col("left"))


def local_minima(fes: DataFrame, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """points no higher than their neighbours (ends included)."""
    w = Window.partitionBy(*keys).orderBy(x)
    y = fes.withColumns({"_l": F.lag(f).over(w), "_r": F.lead(f).over(w)})
    return y.where((F.col("_l").isNull() | (F.col(f) <= F.col("_l"))) & (F.col("_r").isNull() | (F.col(f) <= F.col("_r")))).drop("_l", "_r")


def bin_minima(fes: DataFrame, lo: float, width: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """the lowest point of each bin of x."""
    b = F.floor((F.col(x) - lo) / width).cast("int")
    return fes.groupBy(*keys, b.alias("bin")).agg(F.min(F.struct(F.col(f).alias("f"), F.col(x).alias("x"))).alias("m")).select(*keys, "bin", F.col("m.x").alias("x"), F.col("m.f").alias("f"))


def basin_free_energy(fes: DataFrame, kt: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """points go to the minimum that steepest descent reaches (on equal slopes to the left); -kT ln sum exp(-F / kT) of each basin."""
    w = Window.partitionBy(*keys).orderBy(x)
    y = fes.withColumns({"_l": F.lag(f).over(w), "_r": F.lead(f).over(w)})
    down_l, down_r = F.coalesce(F.col(f) - F.col("_l"), F.lit(0.0)), F.coalesce(F.col(f) - F.col("_r"), F.lit(0.0))
    way = F.when((down_l > 0) & (down_l >= down_r), -1).when(down_r > 0, 1).otherwise(0)
    y = y.withColumn("_way", way)
    at = F.when(F.col("_way") == 0, F.col(x))
    left = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    y = y.withColumn("basin", F.when(F.col("_way") == -1, left).when(F.col("_way") == 1, right).otherwise(F.col(x)))
    m = F.min(f).over(Window.partitionBy(*keys, "basin"))
    return y.withColumn("_m", m).groupBy(*keys, "basin").agg((F.first("_m") - kt * F.log(F.sum(F.exp(-(F.col(f) - F.col("_m")) / kt)))).alias("free_energy"), F.count("*").alias("n_points"))


def fes2d_minimum(fes: DataFrame, x0: float, y0: float, half: float, keys: list[str], x: str = "x", y: str = "y", f: str = "f") -> DataFrame:
    """lowest point in the box around a target, else the grid point nearest to it."""
    inside = (F.abs(F.col(x) - x0) <= half) & (F.abs(F.col(y) - y0) <= half)
    far = (F.col(x) - x0) ** 2 + (F.col(y) - y0) ** 2
    rank = F.struct((~inside).alias("out"), F.when(inside, F.col(f)).otherwise(far).alias("r"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(f).alias("f"))
    return fes.groupBy(*keys).agg(F.min(rank).alias("m")).select(*keys, F.col("m.x").alias("x_min"), F.col("m.y").alias("y_min"), F.col("m.f").alias("f_min"))


def pka2d(fes: DataFrame, half: float, temperature: float, keys: list[str]) -> DataFrame:
    """pKa1 from the minima near (1, 1) and (0, 1), pKa2 from those near (1, 1) and (1, 0)."""
    m = {n: fes2d_minimum(fes, *at, half, keys).select(*keys, F.col("f_min").alias(n)) for n, at in (("f11", (1.0, 1.0)), ("f01", (0.0, 1.0)), ("f10", (1.0, 0.0)))}
    y = m["f11"].join(m["f01"], keys).join(m["f10"], keys)
    return y.select(*keys, *[((F.col("f11") - F.col(c)) / (PKA_FACTOR * temperature)).alias(n) for c, n in (("f01", "pka1"), ("f10", "pka2"))])


def savgol(f: str, keys: list[str], x: str, width: int = 9, degree: int = 3) -> Column:
    """Savitzky-Golay value of f: the polynomial of the `width` nearest rows, at the ends that of the first or last `width` rows. Keys of fewer rows get null."""
    import numpy as np

    at = np.arange(width) - width // 2
    v = np.vander(at, degree + 1, increasing=True)
    hat = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in v @ np.linalg.pinv(v)])
    w = Window.partitionBy(*keys).orderBy(x)
    n, i, half = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w) - 1, width // 2
    near = F.collect_list(F.col(f)).over(w.rowsBetween(1 - width, width - 1))  # at most 2 * width - 1 rows
    start = F.greatest(F.lit(0), F.least(i - half, n - width))
    rows = F.slice(near, start - F.greatest(F.lit(0), i - width + 1) + 1, F.lit(width))
    value = F.aggregate(F.zip_with(rows, F.element_at(hat, (i - start + 1).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(n >= width, value)


def stationary_points(fes: DataFrame, half: int, keys: list[str], x: str = "x", f: str = "f", smooth: str = "mean") -> DataFrame:
    """smoothed surface, its central gradient, and its interpolated zero crossings with their kind.

    smooth: "mean" over 2 * half + 1 points, or "savgol", that mean followed by a Savitzky-Golay cubic over nine points.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    y = fes.withColumn("_s", F.avg(f).over(w.rowsBetween(-half, half)))
    if smooth == "savgol":
        y = y.withColumn("_s", savgol("_s", keys, x))
    y = y.withColumn("_g", (F.lead("_s").over(w) - F.lag("_s").over(w)) / (F.lead(x).over(w) - F.lag(x).over(w)))
    y = y.withColumns({"_gn": F.lead("_g").over(w), "_xn": F.lead(x).over(w)}).where("_g * _gn < 0")
    return y.select(*keys, (F.col(x) + (F.col("_xn") - F.col(x)) * F.col("_g") / (F.col("_g") - F.col("_gn"))).alias("x0"), F.when(F.col("_g") < 0, "min").otherwise("max").alias("kind"))


def pmf_features(fes: DataFrame, low: tuple[float, float], high: tuple[float, float], temperature: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """minima of two basins, highest point between them, gap, both barriers, equivalent pKa shift and two-state fractions."""
    pick = lambda b: F.min(F.when(F.col(x).between(*b), F.struct(F.col(f).alias("f"), F.col(x).alias("x"))))
    m = fes.groupBy(*keys).agg(pick(low).alias("a"), pick(high).alias("b")).where("a is not null and b is not null")
    top = fes.join(m, keys).where(F.col(x).between(F.col("a.x"), F.col("b.x"))).groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max(F.struct(F.col(f).alias("f"), (-F.col(x)).alias("n"))).alias("t"))
    gap, rt = F.col("b.f") - F.col("a.f"), GAS_KCAL * temperature
    return top.select(*keys, F.col("a.x").alias("x_low"), F.col("b.x").alias("x_high"), (-F.col("t.n")).alias("x_top"), gap.alias("gap"), (F.col("t.f") - F.col("a.f")).alias("barrier_up"), (F.col("t.f") - F.col("b.f")).alias("barrier_down"), (-gap / (rt * math.log(10))).alias("delta_pka"), (1 / (1 + F.exp(-gap / rt))).alias("fraction_low"))


def pmf_thermodynamics(fes: DataFrame, low: tuple[float, float], high: tuple[float, float], between: tuple[float, float], temperature: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """basin minima, transition maximum, populations on its two sides and their free-energy difference."""
    rt = GAS_KCAL * temperature
    lo = lambda b: F.min(F.when(F.col(x).between(*b), F.struct(F.col(f).alias("f"), F.col(x).alias("x"))))
    m = fes.groupBy(*keys).agg(lo(low).alias("a"), lo(high).alias("b"), F.max(F.when(F.col(x).between(*between), F.struct(F.col(f).alias("f"), (-F.col(x)).alias("n")))).alias("t"), F.min(f).alias("_m"))
    w = F.exp(-(F.col(f) - F.col("_m")) / rt)
    first = F.col(x) <= -F.col("t.n")
    y = fes.join(m, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in "abt"], F.sum(F.when(first, w).otherwise(0.0)).alias("wa"), F.sum(F.when(first, 0.0).otherwise(w)).alias("wb"))
    return y.select(*keys, (F.col("b.f") - F.col("a.f")).alias("delta_pmf"), (F.col("t.f") - F.col("a.f")).alias("barrier_up"), (F.col("t.f") - F.col("b.f")).alias("barrier_down"), (F.col("wa") / (F.col("wa") + F.col("wb"))).alias("fraction_low"), (-rt * F.log(F.col("wb") / F.col("wa"))).alias("population_dg"))


def hermite_dense(fes: DataFrame, per_step: int, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """cubic Hermite points between neighbours, slopes by central differences (one-sided at the ends)."""
    w = Window.partitionBy(*keys).orderBy(x)
    dl, dr = (F.col(f) - F.lag(f).over(w)) / (F.col(x) - F.lag(x).over(w)), (F.lead(f).over(w) - F.col(f)) / (F.lead(x).over(w) - F.col(x))
    mid = (F.lead(f).over(w) - F.lag(f).over(w)) / (F.lead(x).over(w) - F.lag(x).over(w))
    y = fes.withColumn("_m", F.coalesce(mid, dl, dr))
    y = y.withColumns({"_x1": F.lead(x).over(w), "_f1": F.lead(f).over(w), "_m1": F.lead("_m").over(w)}).where("_x1 is not null")
    y = y.withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_step - 1)), lambda i: i / per_step)))
    u, h = F.col("u"), F.col("_x1") - F.col(x)
    v = (2 * u**3 - 3 * u**2 + 1) * F.col(f) + (u**3 - 2 * u**2 + u) * h * F.col("_m") + (3 * u**2 - 2 * u**3) * F.col("_f1") + (u**3 - u**2) * h * F.col("_m1")
    return y.select(*keys, (F.col(x) + u * h).alias("x"), v.alias("f"))


#: Widths beyond which a hill is left out (there it adds under 1e-17 of its height), and terms of the expansion, whose rest is under 1e-15 of a hill's height.
REACH, TERMS = 9, 20


def hill_bias(samples: DataFrame, hills: DataFrame, keys: list[str], t: str = "t", value: str = "value", size: int | None = None) -> DataFrame:
    """Bias of the hills (keys, t_hill, center, height, width) at or before each sample's time at its value: (keys, t, value, bias), one row for equal samples; 0 where no hill is.

    No sample meets a hill. The axis is cut into cells of one width. With u and v the places of sample and hill from the
    middle of a cell in widths, the kernel is exp(-u^2 / 2) times the sum over k of u^k / k! and v^k exp(-v^2 / 2), |u| at
    most a half: hills give each cell in reach TERMS moments, whose running sums in time order each sample looks up. Work
    grows with samples plus hills. Cells of runs with more than `size` rows are cut by time, and blocks hand their sums on.
    """
    h = hills.select(*keys, F.col("t_hill").alias("at"), "center", "height", "width")
    widths = h.groupBy(*keys).agg(F.max("width").alias("width"))
    middle = F.floor(F.col("center") / F.col("width"))
    h = h.select(*keys, "at", "center", "height", "width", F.explode(F.sequence(middle - REACH, middle + REACH)).alias("cell"))
    v = F.col("center") / F.col("width") - F.col("cell") - 0.5
    names = [f"m{k}" for k in range(TERMS)]
    h = h.select(*keys, "cell", "at", v.alias("v"), (F.col("height") * F.exp(-0.5 * v * v)).alias("m0"))
    power = lambda k: F.col("m0") * reduce(lambda x, y: x * y, [F.col("v")] * k) if k else F.col("m0")
    h = h.select(*keys, "cell", "at", *[power(k).alias(name) for k, name in enumerate(names)])
    s = samples.select(*keys, F.col(t).alias("at"), F.col(value).alias("s")).distinct().join(widths, keys, "left")
    place = F.col("s") / F.col("width")
    s = s.select(*keys, F.floor(place).alias("cell"), "at", "s", (place - F.floor(place) - 0.5).alias("u"))
    x = h.unionByName(s.withColumn("sample", F.lit(True)), allowMissingColumns=True)
    owner = samples.select(F.struct(*keys).alias("_run")).unionByName(hills.select(F.struct(*keys).alias("_run")))
    by = [*keys, "cell"]
    cut = long_runs(owner, "_run", size)
    if cut:
        x = spans(x.withColumn("_cell", F.struct(*by)), "_cell", "at", size).drop("_n")
        ends = x.groupBy("_cell", "_block").agg(*[F.sum(m).alias(m) for m in names])
        o = Window.partitionBy("_cell").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        carry = ends.select(F.col("_cell").alias("_k"), F.col("_block").alias("_b"), *[F.coalesce(F.sum(m).over(o), F.lit(0.0)).alias(f"_c{m}") for m in names])
        by = [*by, "_block"]
    w = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({m: F.coalesce(F.sum(m).over(w), F.lit(0.0)) for m in names}).where("sample")
    if cut:
        x = x.join(carry, F.col("_cell").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).withColumns({m: F.col(m) + F.col(f"_c{m}") for m in names})
    terms = reduce(lambda total, k: F.col(names[k]) + total * F.col("u") / (k + 1), range(TERMS - 2, -1, -1), F.col(names[-1]))
    return x.select(*keys, F.col("at").alias(t), F.col("s").alias(value), F.coalesce(F.exp(-0.5 * F.col("u") * F.col("u")) * terms, F.lit(0.0)).alias("bias"))


def tp_weights(samples: DataFrame, hills: DataFrame, temperature: float, lo: float, hi: float, points: int, keys: list[str], t: str = "t", value: str = "value", size: int | None = None) -> DataFrame:
    """reweighting of standard metadynamics: bias V(s, t), offset c(t), log weight, weight (sum 1 a key).

    Only hills at or before a sample act on it. hills: (keys, t_hill, center, height, width), one width a key. size: rows of
    a run that one task takes in hill_bias.
    """
    beta, ds = 1 / (GAS_KCAL * temperature), (hi - lo) / (points - 1)
    h = hills.select(*keys, F.col("t_hill").alias("th"), "center", "height", "width")
    # the bias on the grid after each hill: one running sum by grid point, gathered to one array a hill
    grid = h.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("th", "center"))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    run = F.sum(F.col("height") * kernel((lo + F.col("g") * ds - F.col("center")) / F.col("width"))).over(Window.partitionBy(*keys, "g").orderBy("no"))
    after = grid.withColumn("v", run).groupBy(*keys, "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "v"))), lambda x: x["v"]).alias("vs"))
    # how many hills each sample has behind it, by one pass over both in time order
    none = F.lit(None).cast("double")
    both = samples.select(*keys, F.col(t).alias("at"), F.col(value).alias("s"), F.lit(0).alias("hill")).unionByName(h.select(*keys, F.col("th").alias("at"), none.alias("s"), F.lit(1).alias("hill")))
    behind = both.withColumn("no", F.sum("hill").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)).cast("int")).where("hill = 0").drop("hill")
    widths = h.groupBy(*keys).agg(F.max("width").alias("width"))
    seen = behind.join(after, [*keys, "no"], "left").join(widths, [*keys], "left")
    level = lambda k: F.coalesce(F.get("vs", k), F.lit(0.0))
    term = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: beta * level(k) - 0.5 * F.pow((lo + k * ds - F.col("s")) / F.col("width"), F.lit(2)) + F.when(k.isin(0, points - 1), math.log(0.5 * ds)).otherwise(math.log(ds)))
    seen = seen.withColumn("e", term).withColumn("m", F.array_max("e"))
    total = F.aggregate(F.transform("e", lambda v: F.exp(v - F.col("m"))), F.lit(0.0), lambda s, v: s + v)
    c = seen.select(*keys, F.col("at").alias(t), F.col("s").alias(value), ((F.col("m") + F.log(total) - F.log(math.sqrt(2 * math.pi) * F.col("width"))) / beta).alias("offset")).distinct()
    bias = hill_bias(samples, hills, keys, t, value, size)
    y = bias.join(c, [*keys, t, value]).withColumn("log_weight", beta * (F.col("bias") - F.col("offset")))
    w = Window.partitionBy(*keys)
    y = y.withColumn("_e", F.exp(F.col("log_weight") - F.max("log_weight").over(w)))
    return y.select(*keys, t, value, "bias", "offset", "log_weight", (F.col("_e") / F.sum("_e").over(w)).alias("weight"))


def joint_fes(df: DataFrame, a: str, b: str, weight: str, ga: tuple[float, float, int], gb: tuple[float, float, int], ha: float, hb: float, temperature: float) -> DataFrame:
    """F8: weighted product-kernel density of two columns on a grid (lo, hi, points), normalised by the trapezoid rule, and -RT ln of it."""
    sp = df.sparkSession
    axis = lambda g, n: sp.range(g[2]).select(F.col("id").cast("int").alias(n), (g[0] + F.col("id") * (g[1] - g[0]) / (g[2] - 1)).alias(f"{n}x"), F.when(F.col("id").isin(0, g[2] - 1), 0.5).otherwise(1.0).alias(f"{n}w"))
    x = df.crossJoin(F.broadcast(axis(ga, "i").crossJoin(axis(gb, "j"))))  # a stated grid
    d = x.groupBy("i", "j", "ix", "jx", "iw", "jw").agg(F.sum(F.col(weight) * kernel((F.col("ix") - F.col(a)) / ha) * kernel((F.col("jx") - F.col(b)) / hb)).alias("p"))
    cell = (ga[1] - ga[0]) / (ga[2] - 1) * (gb[1] - gb[0]) / (gb[2] - 1)
    total = d.agg((F.sum(F.col("p") * F.col("iw") * F.col("jw")) * cell).alias("total"))
    y = d.crossJoin(F.broadcast(total)).withColumn("p", F.col("p") / F.col("total"))  # one row
    f = F.when(F.col("p") > 0, -GAS_KCAL * temperature * F.log("p"))
    least = y.agg(F.min(f).alias("least"))
    return y.crossJoin(F.broadcast(least)).select("i", "j", F.col("ix").alias("a"), F.col("jx").alias("b"), "p", (f - F.col("least")).alias("f"))


def joint_profile(df: DataFrame, a: str, b: str, weight: str, ga: tuple[float, float, int], gb: tuple[float, float, int], ha: float, hb: float, temperature: float, support: float = 1e-4, jacobian: bool = False) -> DataFrame:
    """F8: on every grid cell (i, j, a, b) the weighted density p, the density `sampled` of the samples as they are, `supported` (sampled at least `support` of its maximum), the free energy f of supported cells (p divided by b^2 with the Jacobian), the conditional density of b at a among the samples, and the trapezoid weights of the two axes."""
    sp = df.sparkSession
    da, db = (ga[1] - ga[0]) / (ga[2] - 1), (gb[1] - gb[0]) / (gb[2] - 1)
    axis = lambda g, d, n: sp.range(g[2]).select(F.col("id").cast("int").alias(n), (g[0] + F.col("id") * d).alias(f"{n}x"), (F.when(F.col("id").isin(0, g[2] - 1), 0.5).otherwise(1.0) * d).alias(f"w{n}"))
    x = df.crossJoin(F.broadcast(axis(ga, da, "i").crossJoin(axis(gb, db, "j"))))  # a stated grid
    k = kernel((F.col("ix") - F.col(a)) / ha) * kernel((F.col("jx") - F.col(b)) / hb)
    d = x.groupBy("i", "j", "ix", "jx", "wi", "wj").agg(F.sum(F.col(weight) * k).alias("p"), (F.avg(k) / (2 * math.pi * ha * hb)).alias("sampled"))
    whole = d.agg(F.sum(F.col("p") * F.col("wi") * F.col("wj")).alias("total"), F.max("sampled").alias("top"))
    d = d.crossJoin(F.broadcast(whole)).withColumns({"p": F.try_divide(F.col("p"), F.col("total")), "supported": F.col("sampled") >= support * F.col("top")})  # one row
    at_a = d.groupBy("i").agg(F.sum(F.col("sampled") * F.col("wj")).alias("at_a"))
    shown = F.col("p") / (F.col("jx") ** 2) if jacobian else F.col("p")
    f = F.when(F.col("supported") & (shown > 0), -GAS_KCAL * temperature * F.log(shown))
    d = d.join(at_a, "i").withColumns({"_f": f, "conditional": F.coalesce(F.try_divide(F.col("sampled"), F.col("at_a")), F.lit(0.0))})
    least = d.agg(F.min("_f").alias("least"))
    return d.crossJoin(F.broadcast(least)).select("i", "j", F.col("ix").alias("a"), F.col("jx").alias("b"), "p", "sampled", "supported", (F.col("_f") - F.col("least")).alias("f"), "conditional", "wi", "wj")  # one row


def joint_marginals(profile: DataFrame, temperature: float, jacobian: bool = False) -> DataFrame:
    """F8: both marginals of joint_profile: (axis "a" or "b", k, x, p, f), f with minimum 0 on each axis; the Jacobian divides the marginal of b by b^2."""
    pa = profile.groupBy(F.lit("a").alias("axis"), F.col("i").alias("k"), F.col("a").alias("x")).agg(F.sum(F.col("p") * F.col("wj")).alias("p"))
    pb = profile.groupBy(F.lit("b").alias("axis"), F.col("j").alias("k"), F.col("b").alias("x")).agg(F.sum(F.col("p") * F.col("wi")).alias("p"))
    if jacobian:
        pb = pb.withColumn("p", F.col("p") / F.col("x") ** 2)
    y = pa.unionByName(pb)
    f = F.when(F.col("p") > 0, -GAS_KCAL * temperature * F.log("p"))
    return y.withColumn("f", f - F.min(f).over(Window.partitionBy("axis")))  # the grid's points


def frame_free_energy(df: DataFrame, weight: str, temperature: float, keys: list[str], r: str | None = None) -> DataFrame:
    """per frame -RT ln of its weight (divided by r^2 if r is given), from the least of its key."""
    c = F.col(weight) / F.col(r) ** 2 if r else F.col(weight)
    f = F.when(c > 0, -GAS_KCAL * temperature * F.log(c))
    return df.withColumn("score", f).withColumn("score", F.col("score") - F.min("score").over(Window.partitionBy(*keys)))


def joint_minima(fes: DataFrame, ceiling: float) -> DataFrame:
    """cells (i, j) below the ceiling that are lower than all eight neighbours present."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    near = fes.withColumn("o", o).select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), "f")
    low = near.groupBy("i", "j").agg(F.min("f").alias("_low"))
    return fes.join(low, ["i", "j"], "left").where((F.col("f") <= ceiling) & (F.col("_low").isNull() | (F.col("f") < F.col("_low")))).drop("_low")


def weighted_radial_hist(df: DataFrame, r: str, weight: str, width: float, temperature: float, keys: list[str]) -> DataFrame:
    """weighted counts by shell, divided by the shell's volume, as a PMF with minimum 0."""
    x = df.groupBy(*keys, F.floor(F.col(r) / width).cast("int").alias("bin")).agg(F.sum(weight).alias("w"))
    lo = F.col("bin") * width
    d = F.col("w") / (F.pow(lo + width, F.lit(3)) - F.pow(lo, F.lit(3)))
    f = F.when(d > 0, -GAS_KCAL * temperature * F.log(d))
    return x.withColumn("pmf", f - F.min(f).over(Window.partitionBy(*keys)))


def wham(samples: DataFrame, k: float, temperature: float, lo: float, hi: float, bins: int, tolerance: float = 1e-7, most: int = 100_000, period: float | None = None, most_cells: int = 10_000_000) -> DataFrame:
    """PMF of umbrella windows (window, target, value) with bias k (x - target)^2 by the WHAM equations.

    Spark counts samples by bin and by window; the fixed point runs on that table of windows and bins, whose size is set
    by the grid, not by the data: windows times bins beyond most_cells are an error, and so is a fixed point that `most`
    rounds don't reach.
    """
    import numpy as np

    from ..functions.exprs import bin_of

    width = (hi - lo) / bins
    c = samples.select("window", bin_of(F.col("value"), lo, width, bins).alias("bin")).where("bin is not null")
    windows = samples.agg(F.count_distinct("window")).first()[0]
    if windows * bins > most_cells:
        raise ValueError(f"{windows} windows and {bins} bins are more than {most_cells} cells")
    n_window = {r["window"]: r["n"] for r in c.groupBy("window").agg(F.count("*").alias("n")).collect()}
    n_bin = {r["bin"]: r["n"] for r in c.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    target = {r["window"]: r["t"] for r in samples.groupBy("window").agg(F.first("target").alias("t")).collect()}
    names = sorted(n_window)
    beta, x = 1 / (GAS_KCAL * temperature), lo + (np.arange(bins) + 0.5) * width
    d = x[None, :] - np.array([target[w] for w in names])[:, None]
    if period:
        d -= period * np.rint(d / period)
    boltz, n, h = np.exp(-beta * k * d * d), np.array([n_window[w] for w in names], float), np.array([n_bin.get(b, 0) for b in range(bins)], float)
    f = np.zeros(len(names))
    for _ in range(most):
        p = h / np.maximum((n[:, None] * np.exp(beta * f)[:, None] * boltz).sum(axis=0), 1e-300)
        new = -np.log(np.maximum((boltz * p).sum(axis=1), 1e-300)) / beta
        new -= new[0]
        done, f = np.abs(new - f).max() < tolerance, new
        if done:
            break
    else:
        raise ArithmeticError(f"WHAM has not converged in {most} rounds")
    with np.errstate(divide="ignore"):
        pmf = np.where(p > 0, -np.log(p) / beta, np.nan)
    pmf -= np.nanmin(pmf)
    rows = [(int(b), float(x[b]), int(h[b]), None if np.isnan(pmf[b]) else float(pmf[b])) for b in range(bins)]
    return samples.sparkSession.createDataFrame(rows, "bin int, x double, n bigint, pmf double")


def block_bootstrap(df: DataFrame, values: list[str], replicas: int, block: int, seed: int, keys: list[str], idx: str = "idx", start=None) -> DataFrame:
    """circular moving blocks: (replica, keys, n, sum_<value>), sums over each resampled series, whose count is the key's own; replica 0 is the data itself.

    idx counts a key's rows from 0. Nothing is copied: a key is cut into pieces of `block` rows, the starts that fall into a
    piece stand beside it as one array, and each piece gives every replica its sums of the rows that the starts in it and
    in the piece before cover, by running sums. start(n): places of the starts by replica and block as an expression over
    the columns replica, block, keys; a hash of seed by default.
    """
    width = len(values)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(F.lit(seed), "replica", *keys, "block"), F.col("_n")) if start is None else start("_n")
    # a row of n becomes replicas times blocks: its rows are dealt first, and the join knows of hits only that they come from n, and so must not take them for small
    dealt = n.repartition(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = dealt.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("replica")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)).alias("block"))
    s = s.select(*keys, "_n", "replica", place.alias("_s"), F.least(F.lit(block), F.col("_n") - F.col("block") * block).alias("_len"))
    # a sample block covers [s, s + len) around the circle: at most three pieces, the first from s on, and what is left of it in the next ones
    piece = F.floor(F.col("_s") / block)
    parts = s.withColumn("_to", F.explode(F.array_distinct(F.transform(F.array(F.lit(0), F.col("_len") - 1, F.least(F.col("_len") - 1, F.col("_n") - 1 - F.col("_s"))), lambda o: F.floor(F.pmod(F.col("_s") + o, F.col("_n")) / block)))))
    hits = parts.groupBy(*keys, F.col("_to").alias("_piece")).agg(F.collect_list(F.struct(F.col("replica").cast("int").alias("r"), F.col("_s").cast("bigint").alias("s"), F.col("_len").cast("bigint").alias("len"))).alias("hits"))  # about one a replica
    rows = df.join(n, keys).select(*keys, "_n", F.floor(F.col(idx) / block).alias("_piece"), F.struct(F.col(idx).cast("bigint").alias("_i"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)]).alias("row"))
    pieces = rows.groupBy(*keys, "_n", "_piece").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # `block` rows
    both = pieces.join(hits.hint("merge"), [*keys, "_piece"])
    names = [f"sum_{v}" for v in values]

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        flat = lambda col, name: col.flatten().field(name).to_numpy(zero_copy_only=False)
        owner = lambda col: np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False))
        for batch in batches:
            rows, hits = batch.column("rows"), batch.column("hits")
            n, size = batch.column("_n").to_numpy(zero_copy_only=False), batch.num_rows
            held, found = owner(rows), owner(hits)
            i, r, s, length = flat(rows, "_i"), flat(hits, "r"), flat(hits, "s"), flat(hits, "len")
            # the rows of all pieces of the batch stand in one line, a piece after the other
            reach = int(max(n.max(initial=0), 1)) * 2 + 2
            line = held * 2 * reach + i + reach
            v = [np.append(np.ones(len(i)), 0.0), *[np.append(flat(rows, f"v{k}"), 0.0) for k in range(width)]]
            at, inverse = np.unique(found * (replicas + 1) + r, return_inverse=True)
            total = np.zeros((len(at), width + 1))
            for turn in (0, n[found]):  # the part before the end of the series, and the part that goes round
                a, b = np.searchsorted(line, found * 2 * reach + s - turn + reach), np.searchsorted(line, found * 2 * reach + s + length - turn + reach)
                some = b > a
                ends = np.column_stack([a[some], b[some]]).ravel()
                for k in range(width + 1):
                    if len(ends):
                        np.add.at(total[:, k], inverse[some], np.add.reduceat(v[k], ends)[::2])
            piece = pa.array(at // (replicas + 1))
            out = {c: batch.column(c).take(piece) for c in keys}
            out["replica"] = pa.array((at % (replicas + 1)).astype(np.int32))
            out["s"] = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width + 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    found = both.mapInArrow(sums, ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "replica int", "s array<double>"]))
    own = df.select(*keys, F.lit(0).alias("replica"), F.array(F.lit(1.0), *[F.col(v).cast("double") for v in values]).alias("s"))
    every = found.unionByName(own)
    return every.groupBy("replica", *keys).agg(F.sum(F.col("s")[0]).cast("bigint").alias("n"), *[F.sum(F.col("s")[k + 1]).alias(name) for k, name in enumerate(names)])


def bootstrap_intervals(estimates: DataFrame, value: str, keys: list[str], replicas: int, level: float = 0.95, least: float = 0.9) -> DataFrame:
    """of estimates (replica, keys, value), null where one failed: keys, estimate (replica 0), sd, low and high (interpolated percentiles), n_ok, enough (at least the share `least` of the replicas succeeded)."""
    real, again = F.col("replica") == 0, F.when(F.col("replica") > 0, F.col(value))
    tail = (1 - level) / 2
    return estimates.groupBy(*keys).agg(F.max(F.when(real, F.col(value))).alias("estimate"), F.stddev_samp(again).alias("sd"), F.percentile(again, tail).alias("low"), F.percentile(again, 1 - tail).alias("high"), F.count(again).alias("n_ok"), (F.count(again) >= F.lit(least * replicas)).alias("enough"))


def effective_samples(weights: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """per key the number of samples, Kish's effective number of them, and the share of the largest weight."""
    w = F.col(weight)
    return weights.groupBy(*keys).agg(F.count(w).alias("n"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_effective"), (F.max(w) / F.sum(w)).alias("largest"))


def _edges(u: DataFrame, states: int, beta: float, extra: list[str]) -> DataFrame:
    """Forward and reverse reduced work of neighbouring states, one row a sample, edge and direction."""
    both = F.array(F.struct(F.col("sample").alias("edge"), F.lit("f").alias("way"), F.col("sample").alias("a"), (F.col("sample") + 1).alias("b")), F.struct((F.col("sample") - 1).alias("edge"), F.lit("r").alias("way"), F.col("sample").alias("a"), (F.col("sample") - 1).alias("b")))
    x = u.select(*extra, "u", F.explode(both).alias("e")).where((F.col("e.b") >= 0) & (F.col("e.b") < states))
    return x.select(*extra, F.col("e.edge").alias("edge"), F.col("e.way").alias("way"), (beta * (F.get("u", F.col("e.b")) - F.get("u", F.col("e.a")))).alias("w"))


def fep_edges(u: DataFrame, states: int, kt: float, extra: list[str] = []) -> DataFrame:
    """F16: exponential averages of each edge in both directions and their difference."""
    x = _edges(u, states, 1 / kt, extra)
    m = x.groupBy(*extra, "edge", "way").agg(F.min("w").alias("_m"))
    y = x.join(m, [*extra, "edge", "way"]).groupBy(*extra, "edge").agg(*[(F.max(F.when(F.col("way") == d, F.col("_m"))) - F.log(F.avg(F.when(F.col("way") == d, F.exp(F.col("_m") - F.col("w")))))).alias(d) for d in "fr"])
    return y.select(*extra, "edge", (kt * F.col("f")).alias("forward"), (-kt * F.col("r")).alias("reverse"), (kt * (F.col("f") + F.col("r"))).alias("hysteresis"))


def bar_edges(u: DataFrame, states: int, kt: float, extra: list[str] = [], steps: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """Bennett's estimate of each edge for equal sample counts, all edges bisected together: one aggregation a step over the table of works.

    The bracket of an edge are the extremes of its forward works and reversed reverse works, where the two sums cannot
    balance. A step evaluates the sums at eight places inside every bracket in one aggregation and keeps the ninth of it
    that holds the root. Brackets stay in a table (one row an edge and key) that is joined to the works; an edge whose
    bracket is not narrower than the tolerance after `steps` is an error.
    """
    from ..runtime import materialise

    works = materialise(_edges(u, states, 1 / kt, extra))
    keys, inner = [*extra, "edge"], 8
    level = F.when(F.col("way") == "f", F.col("w")).otherwise(-F.col("w"))
    bounds = materialise(works.groupBy(*keys).agg((F.min(level) - 1).alias("a"), (F.max(level) + 1).alias("b")))
    for _ in range(steps):
        place = lambda j: F.col("a") + (F.col("b") - F.col("a")) * j / (inner + 1)
        off = lambda j: F.when(F.col("way") == "f", fermi(F.col("w") - place(j))).otherwise(-fermi(F.col("w") + place(j)))
        sums = works.join(bounds, keys).groupBy(*keys, "a", "b").agg(*[F.sum(off(j)).alias(f"g{j}") for j in range(1, inner + 1)])
        below = sum(((F.col(f"g{j}") < 0).cast("int") for j in range(2, inner + 1)), (F.col("g1") < 0).cast("int"))
        bounds = materialise(sums.select(*keys, place(below).alias("a"), F.when(below == inner, F.col("b")).otherwise(place(below + 1)).alias("b")))
        if bounds.where(F.col("b") - F.col("a") >= tolerance).isEmpty():
            break
    late = F.raise_error(F.lit(f"an edge has not converged in {steps} steps")).cast("double")
    return bounds.select(*keys, F.when(F.col("b") - F.col("a") < tolerance, kt * (F.col("a") + F.col("b")) / 2).otherwise(late).alias("bar"))


def mbar(u: DataFrame, states: int, kt: float, tolerance: float = 1e-10, most: int = 60) -> tuple[list[float], DataFrame, list[float]]:
    """free energies of all states, the overlap matrix (i, j, overlap), and the standard error of each free energy against state 0.

    u: (sample, u) with any number of samples of each state, also none. A step is one pass over the samples, of which each
    task returns sums of weights and of their products, states squared numbers. Steps are Newton's on the convex function
    that the equations minimise; one that does not bring the equations closer is cut to a quarter, and after three cuts
    replaced by plain substitution, which always does. Errors come from the same matrix at the end.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from ..runtime import materialise

    data = materialise(u.select(F.col("sample").cast("int").alias("sample"), F.transform("u", lambda e: e / kt).alias("u")))
    n = np.zeros(states)
    for r in data.groupBy("sample").count().collect():
        n[r["sample"]] = r["count"]
    logn = np.log(np.where(n > 0, n, 1.0))

    def sums(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over samples of the weights W_k = exp(f_k - u_k) / sum_j N_j exp(f_j - u_j), and of W_k W_l."""
        known, held = f.copy(), n > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, m = np.zeros(states), np.zeros((states, states))
            for batch in batches:
                x = known - batch.column(0).flatten().to_numpy().reshape(-1, states)
                y = np.where(held, x + logn, -np.inf)
                top = y.max(axis=1, keepdims=True)
                w = np.exp(x - top - np.log(np.exp(y - top).sum(axis=1, keepdims=True)))
                s += w.sum(axis=0)
                m += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(states + states * states, dtype=np.int32)), pa.array(np.concatenate([s, m.ravel()]))], names=["at", "v"])

        got = data.select("u").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(states + states * states)
        for r in got:
            flat[r["at"]] = r["v"]
        return flat[:states], flat[states:].reshape(states, states)

    off = lambda s: float(np.abs(1 - s)[n > 0].max(initial=0.0))
    f = np.zeros(states)
    s, m = sums(f)
    step, cuts, steps = None, 0, 0
    while off(s) > tolerance:
        if (steps := steps + 1) > most:
            raise ArithmeticError(f"MBAR has not converged in {most} passes")
        if step is None:
            hess = np.diag(n * s) - n[:, None] * n[None, :] * m
            free = np.flatnonzero(n > 0)[1:]  # one state stays where it is
            step = np.zeros(states)
            step[free] = np.linalg.lstsq(hess[np.ix_(free, free)], (n * (1 - s))[free], rcond=None)[0]
            step = np.clip(step, -20, 20)
        new = f + step / 4**cuts if cuts < 3 else f - np.log(s)
        s1, m1 = sums(new)
        if cuts < 3 and not off(s1) < off(s):
            cuts += 1
            continue
        f, s, m, step, cuts = new, s1, m1, None, 0
    f = f - np.log(s)  # states without samples follow from the others
    s, m = sums(f)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    half = vectors * np.sqrt(np.maximum(values, 0.0))
    theta = half @ np.linalg.pinv(np.eye(states) - half.T @ (n[:, None] * half), rcond=1e-10) @ half.T
    sd = np.sqrt(np.maximum(0.0, np.diag(theta) + theta[0, 0] - 2 * theta[0]))
    rows = [(i, j, float(m[i, j] * n[j])) for i in range(states) for j in range(states)]
    overlap = u.sparkSession.createDataFrame(rows, "i int, j int, overlap double")
    return [kt * float(v - f[0]) for v in f], overlap, [kt * float(v) for v in sd]


def ti(u: DataFrame, lambdas: list[float], blocks: int) -> DataFrame:
    """mean dU/dlambda of each state from a quadratic fit of every configuration's energies, with block standard error."""
    import numpy as np

    from .agg import block_sem

    lam = np.array(lambdas)
    proj = np.linalg.pinv(np.column_stack([lam**2, lam, np.ones_like(lam)]))
    row = F.element_at(F.array(*[F.array(*[F.lit(float(2 * proj[0, k] * x + proj[1, k])) for k in range(len(lam))]) for x in lam]), F.col("sample") + 1)
    d = F.aggregate(F.zip_with("u", row, lambda e, c: e * c), F.lit(0.0), lambda s, v: s + v)
    out = block_sem(u.select("sample", "frame", d.alias("d")), "d", blocks, ["sample"], "frame")
    return out.select("sample", F.element_at(F.array(*map(F.lit, map(float, lam))), F.col("sample") + 1).alias("lambda"), F.col("mean").alias("du_dl"), "sem")


def trapezoid(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Integral by the trapezoid rule over the rows of a key."""
    w = Window.partitionBy(*keys).orderBy(x)
    s = (F.col(y) + F.lead(y).over(w)) / 2 * (F.lead(x).over(w) - F.col(x))
    return df.withColumn("_s", s).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("integral"))


def convergence(u: DataFrame, ends: list[int]) -> DataFrame:
    """growing prefixes of frames as a grouping key `frames`."""
    return u.withColumn("frames", F.explode(F.array(*map(F.lit, ends)))).where(F.col("frame") <= F.col("frames"))


def orient(u: DataFrame, states: int) -> DataFrame:
    """the grid with states in reverse order."""
    return u.select((states - 1 - F.col("sample")).alias("sample"), "frame", F.reverse("u").alias("u"))


def smooth_pmf(fes: DataFrame, penalty: float, keys: list[str], x: str = "x", f: str = "f") -> DataFrame:
    """the curve s that minimises sum (s - f)^2 + penalty * sum (second differences of s)^2, one surface a group; a surface is as long as its grid."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(x)
        y = pdf[f].to_numpy(float)
        n = len(y)
        if n < 3:
            return pdf.assign(smooth=y)
        # I + penalty D'D has five bands: main, first and second; elimination without pivots (it is positive definite)
        d = np.zeros((3, n))
        for k, c in ((0, 1.0), (1, -2.0), (2, 1.0)):
            d[0, k : n - 2 + k] += c * c
        d[1, : n - 2] += -2.0
        d[1, 1 : n - 1] += -2.0
        d[2, : n - 2] += 1.0
        main, one, two, z = (1 + penalty * d[0]).tolist(), (penalty * d[1]).tolist(), (penalty * d[2]).tolist(), y.tolist()
        for i in range(n - 1):
            r = one[i] / main[i]
            main[i + 1] -= r * one[i]
            one[i + 1] -= r * two[i]
            z[i + 1] -= r * z[i]
            if i + 2 < n:
                q = two[i] / main[i]
                main[i + 2] -= q * two[i]
                z[i + 2] -= q * z[i]
        for i in range(n - 1, -1, -1):
            z[i] = (z[i] - (one[i] * z[i + 1] if i + 1 < n else 0.0) - (two[i] * z[i + 2] if i + 2 < n else 0.0)) / main[i]
        return pdf.assign(smooth=z)

    y = fes.select(*keys, x, f)
    return y.groupBy(*keys).applyInPandas(solve, ", ".join(f"`{c}` {k}" for c, k in y.dtypes) + ", smooth double")


def lowest_minima2d(fes: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """the k lowest interior cells (i, j) that are no higher than their eight neighbours."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    near = fes.withColumn("o", o).select(*keys, (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), "f")
    low = near.groupBy(*keys, "i", "j").agg(F.min("f").alias("_low"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("f", "i", "j")
    return fes.join(low, [*keys, "i", "j"]).where("_n = 8 and f <= _low").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_low", "_n")


def separate_minima(minima: DataFrame, da: float, db: float, most: int) -> DataFrame:
    """greedy choice of minima (a, b, f) from the lowest up, none within da and db of one already chosen: `most` steps, each of which takes one row and leaves out what lies near it."""
    from ..runtime import materialise

    chosen: list = []
    left = materialise(minima.select("a", "b", "f"))
    while len(chosen) < most and (r := left.agg(F.min(F.struct("f", "a", "b")).alias("m")).first()["m"]) is not None:
        chosen.append((len(chosen), r["a"], r["b"], r["f"]))
        left = left.where((F.abs(F.col("a") - r["a"]) >= da) | (F.abs(F.col("b") - r["b"]) >= db))
    return minima.sparkSession.createDataFrame(chosen, "basin int, a double, b double, f double")


def first_visit_order(basins: DataFrame, samples: DataFrame, keys: list[str], a: str, b: str, t: str, sa: float, sb: float) -> DataFrame:
    """basins by the time of the first sample that lies nearest to them (distances scaled by sa and sb)."""
    x = samples.select(*keys, t, a, b).crossJoin(F.broadcast(basins.select("basin", F.col("a").alias("_a"), F.col("b").alias("_b"))))  # a few chosen minima
    d = ((F.col(a) - F.col("_a")) / sa) ** 2 + ((F.col(b) - F.col("_b")) / sb) ** 2
    near = x.groupBy(*keys, t, a, b).agg(F.min_by("basin", F.struct(d, "basin")).alias("basin"))
    first = near.groupBy(*keys, "basin").agg(F.min(t).alias("first_t"))
    return first.withColumn("visit", F.row_number().over(Window.partitionBy(*keys).orderBy("first_t", "basin")))
