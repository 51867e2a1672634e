"""Histograms, densities and potentials of mean force. Counts are partial sums; grids are short ranges joined after the counting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import GAS_KCAL, bin_of, kernel


def _grid(df: DataFrame, lo: float, width: float, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), (lo + (F.col("id") + 0.5) * width).alias("x"))


def hist1d(df: DataFrame, value: str, lo: float, hi: float, n: int, keys: list[str]) -> DataFrame:
    """H1: n equal bins on [lo, hi], the last one closed, with counts (zeros included) and density per key."""
    width = (hi - lo) / n
    counts = df.select(*keys, bin_of(F.col(value), lo, width, n).alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = counts.select(*keys).distinct().crossJoin(F.broadcast(_grid(df, lo, width, n)))  # n rows
    x = frame.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    return x.select(*keys, "bin", "x", "n", (F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * width)).alias("density"))


def hist2d(df: DataFrame, a: str, b: str, ra: tuple[float, float, int], rb: tuple[float, float, int]) -> DataFrame:
    """H2: joint counts of two columns on (lo, hi, n) grids, and -log10 of them; empty cells are left out."""
    bins = [bin_of(F.col(c), lo, (hi - lo) / n, n).alias(k) for c, (lo, hi, n), k in ((a, ra, "i"), (b, rb, "j"))]
    return df.select(*bins).where("i is not null and j is not null").groupBy("i", "j").agg(F.count("*").alias("n")).withColumn("neg_log", -F.log10("n"))


def smooth2d(cells: DataFrame, ni: int, nj: int, value: str = "n") -> DataFrame:
    """H2: 3x3 (1-2-1) smoothing with edge padding: each cell gives to the cells whose clamped stencil holds it."""
    w = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit((2 - abs(di)) * (2 - abs(dj)) / 16).alias("w")) for di in (-1, 0, 1) for dj in (-1, 0, 1)])
    x = cells.select("i", "j", value, F.explode(w).alias("s")).select((F.col("i") + F.col("s.di")).alias("ti"), (F.col("j") + F.col("s.dj")).alias("tj"), "i", "j", "s.*", value)
    # an edge cell's padding repeats it, so what would leave the grid stays in the edge cell
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c)))
    return x.groupBy(clamp("ti", ni).alias("i"), clamp("tj", nj).alias("j")).agg(F.sum(F.col("w") * F.col(value)).alias("smooth"))


def kde1d(df: DataFrame, value: str, lo: float, hi: float, points: int, factor: float, keys: list[str]) -> DataFrame:
    """H3: Gaussian density at equally spaced points, bandwidth factor * sample sd."""
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"), (lo + F.col("id") * (hi - lo) / (points - 1)).alias("x"))
    s = df.groupBy(*keys).agg((factor * F.stddev_samp(value)).alias("h"))
    x = df.join(s, keys).crossJoin(F.broadcast(grid))  # a stated grid of points
    return x.groupBy(*keys, "g", "x").agg((F.avg(kernel((F.col("x") - F.col(value)) / F.col("h"))) / (F.first("h") * 2.5066282746310002)).alias("density"))


def bounded_kde(df: DataFrame, value: str, lo: float, hi: float, points: int, keys: list[str]) -> DataFrame:
    """H3: density on [lo, hi] with reflection at both ends and bandwidth 0.9 min(sd, iqr / 1.34) n^-1/5."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    s = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"), q.alias("q"), F.count(value).alias("n"))
    s = s.select(*keys, "n", (0.9 * F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow("n", F.lit(-0.2))).alias("h"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"), (lo + F.col("id") * (hi - lo) / (points - 1)).alias("x"))
    x = df.join(s, keys).crossJoin(F.broadcast(grid))  # a stated grid of points
    z = lambda c: kernel((F.col("x") - c) / F.col("h"))
    v = F.col(value)
    return x.groupBy(*keys, "g", "x").agg((F.sum(z(v) + z(2 * lo - v) + z(2 * hi - v)) / (F.first("n") * F.first("h") * 2.5066282746310002)).alias("density"))


def coordination_number(g: DataFrame, rho: float, keys: list[str]) -> DataFrame:
    """H5: 4 pi rho times the cumulative trapezoid of g r^2."""
    w = Window.partitionBy(*keys).orderBy("r")
    y = F.col("g") * F.col("r") ** 2
    step = (y + F.lag(y).over(w)) / 2 * (F.col("r") - F.lag("r").over(w))
    return g.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("cn", 4 * 3.141592653589793 * rho * F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def pmf_from_density(df: DataFrame, density: str, temperature: float, keys: list[str], shell: Column | None = None) -> DataFrame:
    """H6: -RT ln(density / shell), shifted to a minimum of 0 per key; null where the density is 0."""
    d = F.col(density) / (shell if shell is not None else F.lit(1.0))
    f = F.when(d > 0, -GAS_KCAL * temperature * F.log(d))
    return df.withColumn("pmf", f - F.min(f).over(Window.partitionBy(*keys)))


def extrema(df: DataFrame, x: str, f: str, separation: float, keys: list[str]) -> DataFrame:
    """H8: strict local minima and maxima; groups of minima closer than the separation keep the lowest, and maxima stand only between kept minima."""
    w = Window.partitionBy(*keys).orderBy(x)
    y = df.withColumns({"_l": F.lag(f).over(w), "_r": F.lead(f).over(w)})
    mins = y.where((F.col(f) < F.col("_l")) & (F.col(f) < F.col("_r"))).select(*keys, x, f)
    mins = mins.withColumn("_g", (F.coalesce(F.col(x) - F.lag(x).over(w) >= separation, F.lit(True))).cast("int")).withColumn("_g", F.sum("_g").over(w))
    low = mins.groupBy(*keys, "_g").agg(F.min(F.struct(f, x)).alias("m")).select(*keys, F.col(f"m.{x}").alias(x), F.col(f"m.{f}").alias(f))
    span = low.withColumn("_next", F.lead(x).over(w)).where("_next is not null").select(*keys, F.col(x).alias("_a"), F.col("_next").alias("_b"))
    top = df.join(span, keys).where((F.col(x) > F.col("_a")) & (F.col(x) < F.col("_b"))).groupBy(*keys, "_a").agg(F.max(F.struct(F.col(f), (-F.col(x)).alias("n"))).alias("m"))
    return low.withColumn("kind", F.lit("min")).unionByName(top.select(*keys, (-F.col("m.n")).alias(x), F.col(f"m.{f}").alias(f), F.lit("max").alias("kind")))


def basin_population(df: DataFrame, value: str, barriers: Sequence[float], keys: list[str]) -> DataFrame:
    """H9: share of samples between barrier positions, per key."""
    basin = sum(((F.col(value) >= b).cast("int") for b in barriers), F.lit(0))
    n = df.groupBy(*keys, basin.alias("basin")).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def level_crossings(df: DataFrame, x: str, f: str, level: float, keys: list[str]) -> DataFrame:
    """Interpolated places where f crosses the level above its minimum, going outward from the minimum; none across nulls."""
    w = Window.partitionBy(*keys)
    y = df.withColumns({"_x0": F.min_by(x, F.when(F.col(f).isNotNull(), F.struct(f, x))).over(w), "_f0": F.min(f).over(w)})
    o = Window.partitionBy(*keys).orderBy(x)
    z = F.col("_f0") + level
    y = y.withColumns({"_p": F.lag(f).over(o), "_px": F.lag(x).over(o), "_n": F.lead(f).over(o), "_nx": F.lead(x).over(o)})
    right = (F.col(x) >= F.col("_x0")) & (F.col(f) < z) & (F.col("_n") >= z)
    left = (F.col(x) <= F.col("_x0")) & (F.col(f) < z) & (F.col("_p") >= z)
    at = lambda fn, xn: F.col(x) + (F.col(xn) - F.col(x)) * (z - F.col(f)) / F.nullif(F.col(fn) - F.col(f), F.lit(0.0))
    return y.groupBy(*keys).agg(F.max(F.when(left, at("_p", "_px"))).alias("left"), F.min(F.when(right, at("_n", "_nx"))).alias("right"))


def local_parabola(df: DataFrame, x: str, f: str, half: float, keys: list[str]) -> DataFrame:
    """Curvature of the least-squares parabola through points within half of the minimum (centred there)."""
    w = Window.partitionBy(*keys)
    y = df.withColumn("_x0", F.min_by(x, F.struct(f, x)).over(w)).withColumn("u", F.col(x) - F.col("_x0")).where(F.abs("u") <= half)
    s = {k: F.sum(F.pow("u", F.lit(k))) for k in range(5)}
    t = {k: F.sum(F.pow("u", F.lit(k)) * F.col(f)) for k in range(3)}
    y = y.groupBy(*keys).agg(*[v.alias(f"s{k}") for k, v in s.items()], *[v.alias(f"t{k}") for k, v in t.items()])
    m = F.expr("s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)")
    a = F.expr("t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - t0 * s1) + s2 * (t1 * s1 - t0 * s2)")
    return y.select(*keys, F.try_divide(a, m).alias("curvature"))


def curve_minima(df: DataFrame, x: str, y: str, windows: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """In each named window the lowest point, refined by the vertex of the parabola through it and its neighbours (equal spacing)."""
    o = Window.partitionBy(*keys).orderBy(x)
    z = df.withColumns({"_l": F.lag(y).over(o), "_r": F.lead(y).over(o), "_dx": F.lead(x).over(o) - F.col(x)})
    out = None
    for name, (lo, hi) in windows.items():
        m = z.where(F.col(x).between(lo, hi)).groupBy(*keys).agg(F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"), "_l", "_r", "_dx")).alias("m"))
        bend = F.col("m._l") - 2 * F.col("m.y") + F.col("m._r")
        part = m.select(*keys, F.lit(name).alias("window"), (F.col("m.x") + F.coalesce(F.when(bend > 0, F.col("m._dx") * (F.col("m._l") - F.col("m._r")) / (2 * bend)), F.lit(0.0))).alias("x_min"), F.col("m.y").alias("y_min"))
        out = part if out is None else out.unionByName(part)
    return out


def pooled_distribution(parts: dict[str, DataFrame], value: str, lo: float, hi: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Histogram of all runs together, and each run's sample count."""
    both = None
    for name, df in parts.items():
        x = df.select(F.lit(name).alias("origin"), value)
        both = x if both is None else both.unionByName(x)
    return hist1d(both.withColumn("pool", F.lit(0)), value, lo, hi, n, ["pool"]), both.groupBy("origin").agg(F.count(value).alias("n"))


def _pointers(up: DataFrame, most: int = 60) -> DataFrame:
    """Follows pointers (cell, top) to their ends by joins, doubling the distance each round."""
    from ..runtime import materialise

    for _ in range(most):
        nxt = materialise(up.alias("a").join(up.select(F.col("cell").alias("top"), F.col("top").alias("far")), "top").select("cell", F.col("far").alias("top")))
        if nxt.join(up.withColumnRenamed("top", "was"), "cell").where("top <> was").isEmpty():
            return nxt
        up = nxt
    raise ArithmeticError(f"pointers have not ended in {most} rounds")


def merge_modes(modes: DataFrame, near: float, n: int) -> DataFrame:
    """(top, lead) for modes (top, n) of a grid of n cells a side: from the most populated down, a mode within `near` degrees of one that leads already joins the nearest such, else it leads itself.

    Rounds over the table of modes: a mode whose stronger neighbours are all settled is settled; there are few rounds, as
    a chain of ever weaker modes within reach of each other is as long as their number of ranks.
    """
    from ..runtime import materialise

    cell = lambda c: [F.floor(F.col(c) / (n * n)), F.floor(F.col(c) / n) % n, F.col(c) % n]
    # modes within reach of each other stand in one coarse cell, no narrower than the reach, or in neighbouring ones
    side = int(360 // near) if near > 0 else n
    side = side if side >= 4 else 1
    home = lambda c, shift: [F.pmod(F.floor((k + 0.5) * (side / n)) + s_, F.lit(side)) for k, s_ in zip(cell(c), shift)]
    m = modes.select("top", "n", *[h.alias(f"_c{i}") for i, h in enumerate(home("top", (0, 0, 0)))])
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)] if side > 1 else [(0, 0, 0)]
    x = modes.select(F.col("top").alias("u"), F.col("n").alias("nu"), F.inline(F.array(*[F.struct(*[h.alias(f"_c{i}") for i, h in enumerate(home("top", o))]) for o in steps])))
    gap = [F.abs(p - q) for p, q in zip(cell("top"), cell("u"))]
    far = F.sqrt(sum(((F.least(g, n - g) * (360.0 / n)) ** 2 for g in gap[1:]), (F.least(gap[0], n - gap[0]) * (360.0 / n)) ** 2))
    stronger = (F.col("nu") > F.col("n")) | ((F.col("nu") == F.col("n")) & (F.col("u") < F.col("top")))
    pairs = m.join(x, ["_c0", "_c1", "_c2"]).where(stronger).withColumn("d", far).where(F.col("d") <= near)
    pairs = materialise(pairs.select("top", "u", "nu", "d"))
    state = materialise(m.select("top", F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads is null").isEmpty():
        seen = pairs.join(state.select(F.col("top").alias("u"), F.col("leads").alias("ul")), "u").groupBy("top").agg(F.coalesce(F.bool_or("ul"), F.lit(False)).alias("under"), F.bool_and(F.col("ul").isNotNull()).alias("known"))
        y = state.join(seen, "top", "left")
        verdict = F.when(F.col("under"), False).when(F.coalesce("known", F.lit(True)), True)
        state = materialise(y.select("top", F.coalesce("leads", verdict).alias("leads")))
    lead = state.where("leads").select(F.col("top").alias("u"))
    best = pairs.join(lead, "u").groupBy("top").agg(F.min_by("u", F.struct("d", -F.col("nu"), "u")).alias("lead"))
    return state.join(best, "top", "left").select("top", F.when(F.col("leads"), F.col("top")).otherwise(F.col("lead")).alias("lead"))


def wrapped_gaussian(cells: DataFrame, n: int, sigma: float, value: str = "d", truncate: float = 4.0) -> DataFrame:
    """(cell, value) of a periodic grid of n cells a side, cells numbered x n n + y n + z, under a Gaussian of sigma cells cut at truncate * sigma: one pass an axis, each a sum over the kernel's cells. Cells that stay empty have no row."""
    reach = int(truncate * sigma + 0.5)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)] if reach else [1.0]
    total = sum(weight)
    around: dict[int, float] = {}  # a kernel wider than the circle goes round it
    for k, w in zip(range(-reach, reach + 1), weight):
        around[k % n] = around.get(k % n, 0.0) + w / total
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in sorted(around.items())]))
    x = cells.select("cell", value)
    for width in (n * n, n, 1):
        at = F.floor(F.col("cell") / width) % n
        moved = F.col("cell") + ((at + F.col("s.k")) % n - at) * width
        x = x.withColumn("s", shifts).select(moved.alias("cell"), (F.col("s.w") * F.col(value)).alias(value)).groupBy("cell").agg(F.sum(value).alias(value))
    return x


def density_basins3d(df: DataFrame, angles: Sequence[str], n: int, least: float, near: float = 30.0, keys: list[str] | None = None, bandwidth: float | None = None) -> DataFrame:
    """Basins of samples of three angles (degrees) in their wrapped, smoothed histogram of n cells a side: (basin, n, population, mode_<angle>, mean_<angle>, sd_<angle>).

    bandwidth: of a wrapped Gaussian, in degrees; without it cells are smoothed by the weights 1, 2, 1 an axis.

    Each cell climbs to the densest of its 27 wrapped neighbours; pointers are followed to their ends by joins on the
    table of occupied cells, doubling the distance each round. Basins whose modes lie within `near` degrees merge into the
    more populated one. Basins under the least share of samples are left out. Means and spreads are circular.
    """
    from ..runtime import materialise

    cell = [F.floor((F.col(a) - 360.0 * F.floor(F.col(a) / 360.0)) / (360.0 / n)) for a in angles]
    code = cell[0] * n * n + cell[1] * n + cell[2]
    trig = [f(F.sum(g(F.radians(F.col(a)))), a) for a in angles for f, g in ((lambda c, a: c.alias(f"s_{a}"), F.sin), (lambda c, a: c.alias(f"c_{a}"), F.cos))]
    counts = materialise(df.where(" and ".join(f"`{a}` is not null" for a in angles)).withColumn("cell", code).groupBy("cell").agg(F.count("*").alias("n"), *trig))
    part = [F.floor(F.col("cell") / (n * n)), F.floor(F.col("cell") / n) % n, F.col("cell") % n]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit((2 - abs(a)) * (2 - abs(b)) * (2 - abs(c)) / 64).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    move = F.pmod(part[0] + F.col("o.a"), F.lit(n)) * n * n + F.pmod(part[1] + F.col("o.b"), F.lit(n)) * n + F.pmod(part[2] + F.col("o.c"), F.lit(n))
    if bandwidth is None:
        smooth = counts.withColumn("o", offsets).select(move.alias("cell"), (F.col("o.w") * F.col("n")).alias("d")).groupBy("cell").agg(F.sum("d").alias("d"))
    else:
        smooth = wrapped_gaussian(counts.select("cell", F.col("n").cast("double").alias("d")), n, bandwidth * n / 360.0)
    smooth = materialise(smooth)
    around = smooth.withColumn("o", offsets).select("cell", move.alias("to")).join(smooth.select(F.col("cell").alias("to"), "d"), "to")
    up = materialise(around.groupBy("cell").agg(F.max(F.struct("d", (-F.col("to")).alias("k"))).alias("m")).select("cell", (-F.col("m.k")).alias("top")))
    own = materialise(counts.join(_pointers(up), "cell"))
    lead = merge_modes(own.groupBy("top").agg(F.sum("n").alias("n")), near, n)
    total = counts.agg(F.sum("n").alias("total"))
    sums = [F.sum(f"{f}_{a}").alias(f"{f}_{a}") for a in angles for f in "sc"]
    basins = own.join(lead, "top").groupBy("lead").agg(F.sum("n").alias("n"), *sums).crossJoin(F.broadcast(total)).where(F.col("n") >= least * F.col("total"))  # one row
    at = [F.floor(F.col("lead") / (n * n)), F.floor(F.col("lead") / n) % n, F.col("lead") % n]
    r = lambda a: F.least(F.lit(1.0), F.sqrt(F.col(f"s_{a}") ** 2 + F.col(f"c_{a}") ** 2) / F.col("n"))
    out = []
    for a, k in zip(angles, at):
        out += [((k + 0.5) * (360.0 / n)).alias(f"mode_{a}"), F.degrees(F.atan2(f"s_{a}", f"c_{a}")).alias(f"mean_{a}"), F.degrees(F.sqrt(-2 * F.log(F.greatest(r(a), F.lit(1e-300))))).alias(f"sd_{a}")]
    return basins.select(F.col("lead").cast("bigint").alias("basin"), "n", (F.col("n") / F.col("total")).alias("population"), *out)


def radial_kde(df: DataFrame, r: str, lo: float, hi: float, points: int, factor: float, bins: int, least: int, temperature: float, keys: list[str], wall: tuple[float, float, float] | None = None) -> DataFrame:
    """H7: smooth radial PMF on equally spaced points: density of the samples in [lo, hi] by a Gaussian kernel of width factor * sd, divided by r^2, -RT ln of it from its least supported value.

    supported: between the outermost bins of at least `least` samples, with at least `least` samples within the larger of a
    bin's width and two kernel widths. wall (sigma, anchor, scale): points up to the anchor take the modelled wall
    f(anchor) + scale * ((sigma / r)^12 - (sigma / anchor)^12), if samples reach within a bin of the anchor; wall tells which.
    """
    width, step = (hi - lo) / bins, (hi - lo) / (points - 1)
    x = df.where(F.col(r).between(lo, hi)).select(*keys, F.col(r).alias("v"))
    per_bin = x.groupBy(*keys, bin_of(F.col("v"), lo, width, bins).alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    range_ = per_bin.groupBy(*keys).agg((lo + F.min("bin") * width).alias("from"), (lo + (F.max("bin") + 1) * width).alias("to"))
    stats = x.groupBy(*keys).agg((factor * F.stddev_samp("v")).alias("h"), F.min("v").alias("first")).join(range_, keys, "left")
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"), (lo + F.col("id") * step).alias("r"))
    reach = F.greatest(F.lit(width), 2 * F.col("h"))
    y = x.join(stats, keys).crossJoin(F.broadcast(grid))  # a stated grid of points
    y = y.groupBy(*keys, "g", "r").agg((F.avg(kernel((F.col("r") - F.col("v")) / F.col("h"))) / (F.first("h") * 2.5066282746310002)).alias("density"), F.count_if(F.abs(F.col("r") - F.col("v")) <= reach).alias("local"), F.first("from").alias("from"), F.first("to").alias("to"), F.first("first").alias("first"))
    y = y.withColumn("supported", F.coalesce(F.col("r").between(F.col("from"), F.col("to")), F.lit(False)) & (F.col("local") >= least))
    d = F.col("density") / F.col("r") ** 2
    y = y.withColumn("f", F.when(d > 0, -GAS_KCAL * temperature * F.log(d)))
    by = Window.partitionBy(*keys)
    y = y.withColumn("pmf", F.col("f") - F.min(F.when(F.col("supported"), F.col("f"))).over(by))
    made = F.lit(False)
    if wall:
        sigma, anchor, scale = wall
        # the value at the anchor lies between its two grid points
        k = int((anchor - lo) // step)
        part = (anchor - lo) / step - k
        at = lambda j: F.max(F.when(F.col("g") == j, F.col("pmf"))).over(by)
        made = (F.col("r") <= anchor) & (F.col("first") <= anchor + width)
        y = y.withColumn("_a", at(k) * (1 - part) + at(k + 1) * part)
        y = y.withColumn("pmf", F.when(made, F.col("_a") + scale * (F.pow(sigma / F.col("r"), F.lit(12)) - (sigma / anchor) ** 12)).otherwise(F.col("pmf")))
    return y.select(*keys, "g", "r", "density", "local", "supported", "pmf", made.alias("wall"))


def radial_profile(df: DataFrame, r: str, lo: float, hi: float, bins: int, temperature: float, support: int, separation: float, keys: list[str]) -> DataFrame:
    """H7: radial PMF of each bin with its support (bins of at least `support` samples), and which supported bins are minima or maxima; populations between the maxima."""
    h = hist1d(df, r, lo, hi, bins, keys).withColumnRenamed("x", "r")
    p = pmf_from_density(h, "n", temperature, keys, F.col("r") * F.col("r")).withColumn("supported", F.col("n") >= support)
    e = extrema(p.where("supported").select(*keys, F.col("r").alias("x"), "pmf"), "x", "pmf", separation, keys).select(*keys, F.col("x").alias("r"), "kind")
    x = p.join(e, [*keys, "r"], "left")
    basin = F.count(F.when(F.col("kind") == "max", 1)).over(Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("basin", basin.cast("int"))
    share = F.sum("n").over(Window.partitionBy(*keys, "basin")) / F.sum("n").over(Window.partitionBy(*keys))
    return x.withColumn("basin_population", share)
