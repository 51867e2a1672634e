"""Queries over surfaces and cross energies (embeddings table), and titration and spectra (orders and events tables)."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions import exprs as X
from ..operators import density, freeenergy as FE, titration as T
from ..sources.tables import energies, equal_energies, read, series
from .registry import query

KT = 0.6
#: One surface a vector: 64 points, x = position / 50.
FES = "fes AS (SELECT vec_id AS surface, (i - 1) / 50.0 AS x, CAST(embedding[i] AS DOUBLE) AS f FROM embeddings, range(1, 65) r(i))"


def fes(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("surface"), F.posexplode("embedding").alias("i", "f"))
    return e.select("surface", (F.col("i") / 50.0).alias("x"), F.col("f").cast("double").alias("f"))


NEAR = lambda t: f"""SELECT surface, arg_min(x, (no, abs(x - {t}), f, x)) AS x_min, arg_min(f, (no, abs(x - {t}), f, x)) AS f_min FROM (SELECT *, NOT coalesce((f < l AND f < r) OR (l IS NULL AND f <= r) OR (r IS NULL AND f <= l), false) AS no FROM (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r FROM fes WHERE x BETWEEN {t} - 0.1 AND {t} + 0.1 WINDOW w AS (PARTITION BY surface ORDER BY x))) GROUP BY surface"""


@query("f1_min_near", f"WITH {FES} {NEAR(0.31)}", "x_min f_min")
def _(spark, d):
    return FE.min_near(fes(spark, d), 0.31, 0.1, ["surface"])


@query("f2_delta_f_pka", f"WITH {FES} SELECT surface, a.f_min - b.f_min AS delta_f, (a.f_min - b.f_min) / (0.004576 * 313.15) AS pka FROM ({NEAR(0.31)}) a JOIN ({NEAR(0.93)}) b USING (surface)", "delta_f pka")
def _(spark, d):
    return FE.delta_f(fes(spark, d), 0.31, 0.93, 0.1, 313.15, ["surface"])


@query("f3_side_minima", f'WITH {FES} SELECT surface, min(f) FILTER (x < 0.6) AS "left", min(f) FILTER (x >= 0.6) AS "right", min(f) FILTER (x >= 0.6) - min(f) FILTER (x < 0.6) AS gap FROM fes GROUP BY surface', '"left" "right" gap')
def _(spark, d):
    return FE.side_minima(fes(spark, d), 0.6, ["surface"])


@query("f4_local_minima", f"WITH {FES} SELECT surface, x, f FROM (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r FROM fes WINDOW w AS (PARTITION BY surface ORDER BY x)) WHERE (l IS NULL OR f <= l) AND (r IS NULL OR f <= r)", "x f")
def _(spark, d):
    return FE.local_minima(fes(spark, d), ["surface"])


@query("f4_bin_minima", f"WITH {FES} SELECT surface, CAST(floor(x / 0.25) AS INTEGER) AS bin, arg_min(x, (f, x)) AS x, min(f) AS f FROM fes GROUP BY ALL", "x f")
def _(spark, d):
    return FE.bin_minima(fes(spark, d), 0.0, 0.25, ["surface"])


@query("f4_basin_free_energy", f"""WITH {FES}, n AS (SELECT *, coalesce(f - lag(f) OVER w, 0) AS dl, coalesce(f - lead(f) OVER w, 0) AS dr FROM fes WINDOW w AS (PARTITION BY surface ORDER BY x)),
y AS (SELECT *, CASE WHEN dl > 0 AND dl >= dr THEN -1 WHEN dr > 0 THEN 1 ELSE 0 END AS way FROM n),
b AS (SELECT *, CASE way WHEN -1 THEN last_value(CASE WHEN way = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY surface ORDER BY x) WHEN 1 THEN first_value(CASE WHEN way = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY surface ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE x END AS basin FROM y)
SELECT surface, basin, -0.6 * ln(sum(exp(-f / 0.6))) AS free_energy, count(*) AS n_points FROM b GROUP BY ALL""", "basin free_energy")
def _(spark, d):
    return FE.basin_free_energy(fes(spark, d), KT, ["surface"])


FES2 = "fes2 AS (SELECT vec_id AS surface, ((i - 1) // 8) / 5.0 AS x, ((i - 1) % 8) / 5.0 AS y, CAST(embedding[i] AS DOUBLE) AS f FROM embeddings, range(1, 65) r(i))"


def fes2(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("surface"), F.posexplode("embedding").alias("i", "f"))
    return e.select("surface", (F.floor(F.col("i") / 8) / 5.0).alias("x"), (F.col("i") % 8 / 5.0).alias("y"), F.col("f").cast("double").alias("f"))


NEAR2 = lambda x, y: f"SELECT surface, arg_min(x, f) AS x_min, arg_min(y, f) AS y_min, min(f) AS f_min FROM fes2 WHERE abs(x - {x}) <= 0.25 AND abs(y - {y}) <= 0.25 GROUP BY surface"


@query("f5_fes2d_minimum", f"WITH {FES2} {NEAR2(1.0, 0.0)}", "x_min y_min f_min")
def _(spark, d):
    return FE.fes2d_minimum(fes2(spark, d), 1.0, 0.0, 0.25, ["surface"])


@query("f5_pka2d", f"WITH {FES2} SELECT surface, (a.f_min - b.f_min) / (0.004576 * 300) AS pka1, (a.f_min - c.f_min) / (0.004576 * 300) AS pka2 FROM ({NEAR2(1.0, 1.0)}) a JOIN ({NEAR2(0.0, 1.0)}) b USING (surface) JOIN ({NEAR2(1.0, 0.0)}) c USING (surface)", "pka1 pka2")
def _(spark, d):
    return FE.pka2d(fes2(spark, d), 0.25, 300.0, ["surface"])


@query("f6_stationary_points", f"""WITH {FES}, s AS (SELECT *, avg(f) OVER (PARTITION BY surface ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM fes), g AS (SELECT *, (lead(s) OVER w - lag(s) OVER w) / (lead(x) OVER w - lag(x) OVER w) AS g FROM s WINDOW w AS (PARTITION BY surface ORDER BY x)), n AS (SELECT *, lead(g) OVER w AS gn, lead(x) OVER w AS xn FROM g WINDOW w AS (PARTITION BY surface ORDER BY x))
SELECT surface, x + (xn - x) * g / (g - gn) AS x0, CASE WHEN g < 0 THEN 'min' ELSE 'max' END AS kind FROM n WHERE g * gn < 0""", "x0")
def _(spark, d):
    return FE.stationary_points(fes(spark, d), 2, ["surface"])


@query("f13_pmf_thermodynamics", f"""WITH {FES}, m AS (SELECT surface, min(f) FILTER (x <= 0.4) AS fa, min(f) FILTER (x >= 0.9) AS fb, max(f) FILTER (x BETWEEN 0.4 AND 0.9) AS ft, arg_max(x, (f, -x)) FILTER (x BETWEEN 0.4 AND 0.9) AS xt FROM fes GROUP BY surface),
w AS (SELECT surface, sum(CASE WHEN x <= xt THEN exp(-f / {X.GAS_KCAL * 300!r}) ELSE 0 END) AS wa, sum(CASE WHEN x > xt THEN exp(-f / {X.GAS_KCAL * 300!r}) ELSE 0 END) AS wb FROM fes JOIN m USING (surface) GROUP BY surface)
SELECT surface, fb - fa AS delta_pmf, ft - fa AS barrier_up, ft - fb AS barrier_down, wa / (wa + wb) AS fraction_low, -{X.GAS_KCAL * 300!r} * ln(wb / wa) AS population_dg FROM m JOIN w USING (surface)""", "delta_pmf barrier_up barrier_down fraction_low population_dg")
def _(spark, d):
    return FE.pmf_thermodynamics(fes(spark, d), (0.0, 0.4), (0.9, 2.0), (0.4, 0.9), 300.0, ["surface"])


@query("f14_hermite_dense", f"""WITH {FES}, m AS (SELECT *, coalesce((lead(f) OVER w - lag(f) OVER w) / (lead(x) OVER w - lag(x) OVER w), (f - lag(f) OVER w) / (x - lag(x) OVER w), (lead(f) OVER w - f) / (lead(x) OVER w - x)) AS m FROM fes WINDOW w AS (PARTITION BY surface ORDER BY x)),
n AS (SELECT *, lead(x) OVER w AS x1, lead(f) OVER w AS f1, lead(m) OVER w AS m1 FROM m WINDOW w AS (PARTITION BY surface ORDER BY x))
SELECT surface, x + u * (x1 - x) AS x, (2 * u**3 - 3 * u**2 + 1) * f + (u**3 - 2 * u**2 + u) * (x1 - x) * m + (3 * u**2 - 2 * u**3) * f1 + (u**3 - u**2) * (x1 - x) * m1 AS f FROM n, (SELECT i / 3.0 AS u FROM range(0, 3) r(i)) WHERE x1 IS NOT NULL""", "x f")
def _(spark, d):
    return FE.hermite_dense(fes(spark, d), 3, ["surface"])


@query("f15_pmf_features", f"""WITH {FES}, m AS (SELECT surface, min(f) FILTER (x <= 0.5) AS fa, arg_min(x, (f, x)) FILTER (x <= 0.5) AS xa, min(f) FILTER (x >= 0.8) AS fb, arg_min(x, (f, x)) FILTER (x >= 0.8) AS xb FROM fes GROUP BY surface),
t AS (SELECT surface, any_value(fa) AS fa, any_value(xa) AS xa, any_value(fb) AS fb, any_value(xb) AS xb, max(f) AS ft, arg_max(x, (f, -x)) AS xt FROM fes JOIN m USING (surface) WHERE x BETWEEN xa AND xb GROUP BY surface)
SELECT surface, xa AS x_low, xb AS x_high, xt AS x_top, fb - fa AS gap, ft - fa AS barrier_up, ft - fb AS barrier_down, -(fb - fa) / ({X.GAS_KCAL * 300!r} * ln(10)) AS delta_pka, 1 / (1 + exp(-(fb - fa) / {X.GAS_KCAL * 300!r})) AS fraction_low FROM t""", "x_low x_high x_top gap barrier_up barrier_down delta_pka fraction_low")
def _(spark, d):
    return FE.pmf_features(fes(spark, d), (0.0, 0.5), (0.8, 2.0), 300.0, ["surface"])


def extrema_sql(src: str, key: str, separation: float) -> str:
    """CTEs k (kept minima) and t (maxima between them) of a curve (key, x, f)."""
    return f"""e AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY x)), m AS (SELECT {key}, x, f, sum(CASE WHEN x - p >= {separation} OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY x) AS g FROM (SELECT *, lag(x) OVER (PARTITION BY {key} ORDER BY x) AS p FROM e WHERE f < l AND f < r)),
k AS (SELECT {key}, arg_min(x, (f, x)) AS x, min(f) AS f FROM m GROUP BY {key}, g), s AS (SELECT *, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS nx FROM k), t AS (SELECT {src}.{key}, s.x AS a, arg_max({src}.x, ({src}.f, -{src}.x)) AS x, max({src}.f) AS f FROM {src} JOIN s ON s.{key} = {src}.{key} AND {src}.x > s.x AND {src}.x < s.nx GROUP BY ALL)"""


@query("h8_extrema", f"WITH {FES}, {extrema_sql('fes', 'surface', 0.15)} SELECT surface, x, f, 'min' AS kind FROM k UNION ALL SELECT surface, x, f, 'max' FROM t", "x f")
def _(spark, d):
    return density.extrema(fes(spark, d), "x", "f", 0.15, ["surface"])


@query("h11_level_crossings", f"""WITH {FES}, m AS (SELECT *, min(f) OVER (PARTITION BY surface) + 0.2 AS z, arg_min(x, (f, x)) OVER (PARTITION BY surface) AS x0, lag(f) OVER w AS pf, lag(x) OVER w AS px, lead(f) OVER w AS nf, lead(x) OVER w AS nx FROM fes WINDOW w AS (PARTITION BY surface ORDER BY x))
SELECT surface, max(CASE WHEN x <= x0 AND f < z AND pf >= z THEN x + (px - x) * (z - f) / (pf - f) END) AS "left", min(CASE WHEN x >= x0 AND f < z AND nf >= z THEN x + (nx - x) * (z - f) / (nf - f) END) AS "right" FROM m GROUP BY surface""", '"left" "right"')
def _(spark, d):
    return density.level_crossings(fes(spark, d), "x", "f", 0.2, ["surface"])


@query("h11_local_parabola", f"""WITH {FES}, u AS (SELECT surface, x - arg_min(x, (f, x)) OVER (PARTITION BY surface) AS u, f FROM fes), s AS (SELECT surface, count(*) AS s0, sum(u) AS s1, sum(u**2) AS s2, sum(u**3) AS s3, sum(u**4) AS s4, sum(f) AS t0, sum(u * f) AS t1, sum(u * u * f) AS t2 FROM u WHERE abs(u) <= 0.05 GROUP BY surface)
SELECT surface, (t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - t0 * s1) + s2 * (t1 * s1 - t0 * s2)) / (s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)) * 1e-3 AS curvature FROM s""", "curvature")
def _(spark, d):
    return density.local_parabola(fes(spark, d), "x", "f", 0.05, ["surface"]).withColumn("curvature", F.col("curvature") * 1e-3)


@query("h12_curve_minima", f"""WITH {FES}, n AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r, lead(x) OVER w - x AS dx FROM fes WINDOW w AS (PARTITION BY surface ORDER BY x)), m AS (SELECT 'first' AS "window", * FROM n WHERE x BETWEEN 0.1 AND 0.5 UNION ALL SELECT 'second', * FROM n WHERE x BETWEEN 0.7 AND 1.1), k AS (SELECT *, row_number() OVER (PARTITION BY surface, "window" ORDER BY f, x) AS k FROM m)
SELECT surface, "window", x + CASE WHEN l - 2 * f + r > 0 THEN dx * (l - r) / (2 * (l - 2 * f + r)) ELSE 0 END AS x_min, f AS y_min FROM k WHERE k = 1""", "x_min y_min")
def _(spark, d):
    return density.curve_minima(fes(spark, d), "x", "f", {"first": (0.1, 0.5), "second": (0.7, 1.1)}, ["surface"])


WORK = f"work AS (SELECT sample AS edge, 'f' AS way, (u[sample + 2] - u[sample + 1]) / {KT} AS w FROM energies WHERE sample < 9 UNION ALL SELECT sample - 1, 'r', (u[sample] - u[sample + 1]) / {KT} FROM energies WHERE sample > 0)"


@query("f16_fep_edges", f"WITH {WORK} SELECT edge, -{KT} * ln(avg(exp(-w)) FILTER (way = 'f')) AS forward, {KT} * ln(avg(exp(-w)) FILTER (way = 'r')) AS reverse, -{KT} * ln(avg(exp(-w)) FILTER (way = 'f')) - {KT} * ln(avg(exp(-w)) FILTER (way = 'r')) AS hysteresis FROM work GROUP BY edge", "forward reverse hysteresis", "energies")
def _(spark, d):
    return FE.fep_edges(energies(spark, d), 10, KT)


@query("f17_bar_edges", f"""WITH {WORK.replace('FROM energies', 'FROM equal')}, it AS (SELECT 0 AS k, edge, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi FROM (SELECT DISTINCT edge FROM work) UNION ALL
SELECT k + 1, edge, CASE WHEN g < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g < 0 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT it.k, it.edge, it.lo, it.hi, sum(CASE WHEN way = 'f' THEN 1 / (1 + exp(w - (lo + hi) / 2)) ELSE -1 / (1 + exp(w + (lo + hi) / 2)) END) AS g FROM it JOIN work USING (edge) WHERE it.k < 45 GROUP BY it.k, it.edge, it.lo, it.hi))
SELECT edge, {KT} * (lo + hi) / 2 AS bar FROM it WHERE k = 45""", "bar", "energies")
def _(spark, d):
    return FE.bar_edges(equal_energies(spark, d), 10, KT)


def counted(spark, d):
    u = equal_energies(spark, d)
    return u, u.where("sample = 0").count()


U = ", ".join(f"-ln(sum(exp(-u[{k}] / {KT} - den)))" for k in range(1, 11))
NK = "nk AS (SELECT list(c ORDER BY sample) AS nk FROM (SELECT sample, count(*) AS c FROM energies GROUP BY sample))"
#: The self-consistent equations iterated 400 times from zero; `last` holds the free energies in units of kT.
MBAR = f"""{NK}, it AS (SELECT 0 AS k, [0.0::DOUBLE FOR x IN range(0, 10)] AS f UNION ALL SELECT k + 1, [v - g[1] FOR v IN g] FROM (SELECT k, [{U}] AS g FROM (SELECT it.k, e.u, ln(list_sum([nk[i] * exp(it.f[i] - e.u[i] / {KT}) FOR i IN range(1, 11)])) AS den FROM it, energies e, nk WHERE it.k < 400) GROUP BY k)), last AS (SELECT f FROM it WHERE k = 400)"""


@query("f18_mbar", f"WITH {MBAR} SELECT CAST(i - 1 AS BIGINT) AS state, f[i] * {KT} AS f FROM last, range(1, 11) r(i)", "f", "energies")
def _(spark, d):
    f, _o, _sd = FE.mbar(energies(spark, d), 10, KT)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(f)], "state bigint, f double")


@query("f18_mbar_overlap", f"""WITH {MBAR}, w AS (SELECT [exp(f[i] - u[i] / {KT} - ln(list_sum([nk[j] * exp(f[j] - u[j] / {KT}) FOR j IN range(1, 11)]))) FOR i IN range(1, 11)] AS w, nk FROM last, energies, nk)
SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, sum(w[i] * w[j] * nk[j]) AS overlap FROM w, range(1, 11) a(i), range(1, 11) b(j) GROUP BY ALL""", "overlap", "energies")
def _(spark, d):
    return FE.mbar(energies(spark, d), 10, KT)[1]


def ti_sql() -> str:
    """Mean dU/dlambda of the quadratic through ten equally spaced states, with block errors."""
    n = 10
    x = [k / (n - 1) for k in range(n)]
    p = [sum(v**k for v in x) for k in range(5)]
    det = p[4] * (p[2] * p[0] - p[1] ** 2) - p[3] * (p[3] * p[0] - p[1] * p[2]) + p[2] * (p[3] * p[1] - p[2] ** 2)

    def row(v: float) -> tuple[float, float]:
        # weights of one energy in the quadratic's leading two coefficients (inverse of the normal equations)
        a = ((p[2] * p[0] - p[1] ** 2) * v * v + (p[2] * p[1] - p[3] * p[0]) * v + (p[3] * p[1] - p[2] ** 2)) / det
        b = ((p[2] * p[1] - p[3] * p[0]) * v * v + (p[4] * p[0] - p[2] ** 2) * v + (p[3] * p[2] - p[4] * p[1])) / det
        return a, b

    d = " + ".join(f"u[{k + 1}] * (2 * ({row(v)[0]!r}) * sample / 9.0 + ({row(v)[1]!r}))" for k, v in enumerate(x))
    return f"""WITH d AS (SELECT sample, frame, {d} AS d FROM energies), b AS (SELECT sample, b, avg(d) AS m, sum(d) AS s, count(*) AS n FROM (SELECT *, ntile(5) OVER (PARTITION BY sample ORDER BY frame) AS b FROM d) GROUP BY ALL)
SELECT sample, sample / 9.0 AS "lambda", sum(s) / sum(n) AS du_dl, stddev_samp(m) / sqrt(count(*)) AS sem FROM b GROUP BY sample"""


@query("f19_ti", ti_sql(), '"lambda" du_dl sem', "energies")
def _(spark, d):
    return FE.ti(energies(spark, d), [k / 9 for k in range(10)], 5)


@query("f20_convergence", f"""WITH {WORK.replace('FROM energies', 'FROM pre').replace('SELECT sample AS edge', 'SELECT frames, sample AS edge').replace('SELECT sample - 1', 'SELECT frames, sample - 1').replace('work AS', 'pre AS (SELECT equal.*, e.frames FROM equal JOIN (SELECT DISTINCT n * k // 4 AS frames FROM least, (VALUES (1), (2), (4)) v(k)) e ON frame <= e.frames), work AS')}
SELECT frames, edge, -{KT} * ln(avg(exp(-w)) FILTER (way = 'f')) AS forward, {KT} * ln(avg(exp(-w)) FILTER (way = 'r')) AS reverse, -{KT} * ln(avg(exp(-w)) FILTER (way = 'f')) - {KT} * ln(avg(exp(-w)) FILTER (way = 'r')) AS hysteresis FROM work GROUP BY ALL""", "forward reverse hysteresis", "energies")
def _(spark, d):
    u, n = counted(spark, d)  # prefixes of a quarter, half and all of the frames
    return FE.fep_edges(FE.convergence(u, [n // 4, n // 2, n]).withColumn("frames", F.col("frames").cast("bigint")), 10, KT, ["frames"])


@query("f21_orient", "SELECT 9 - sample AS sample, frame, u[10] AS first_u, u[1] AS last_u FROM energies", "first_u last_u", "energies")
def _(spark, d):
    return FE.orient(energies(spark, d), 10).select("sample", "frame", F.get("u", F.lit(0)).alias("first_u"), F.get("u", F.lit(9)).alias("last_u"))


def hills(spark, d):
    return series(spark, d).where("idx % 6 = 0").select("run", F.col("t").alias("t_hill"), F.col("value").alias("center"), F.lit(0.3).alias("height"), F.lit(15.0).alias("width"))


def weighted(spark, d):
    return FE.tp_weights(series(spark, d).select("run", "t", "value"), hills(spark, d), 300.0, 0.0, 200.0, 41, ["run"])


WEIGHTED = f"""h AS (SELECT run, t AS th, value AS c FROM series WHERE idx % 6 = 0), b AS (SELECT s.run, s.t, s.value, coalesce(sum(0.3 * exp(-0.5 * ((s.value - h.c) / 15) ** 2)), 0) AS bias FROM series s LEFT JOIN h ON h.run = s.run AND h.th <= s.t GROUP BY ALL),
g AS (SELECT s.run, s.t, s.value, i, i * 5.0 AS x, coalesce(sum(0.3 * exp(-0.5 * ((i * 5.0 - h.c) / 15) ** 2)), 0) AS v FROM series s CROSS JOIN range(0, 41) r(i) LEFT JOIN h ON h.run = s.run AND h.th <= s.t GROUP BY ALL),
o AS (SELECT run, t, {X.GAS_KCAL * 300!r} * ln(sum(CASE WHEN i IN (0, 40) THEN 2.5 ELSE 5.0 END * exp(v / {X.GAS_KCAL * 300!r} - 0.5 * ((x - value) / 15) ** 2)) / (sqrt(2 * pi()) * 15)) AS off FROM g GROUP BY run, t),
l AS (SELECT run, t, value, bias, off, (bias - off) / {X.GAS_KCAL * 300!r} AS lw FROM b JOIN o USING (run, t)), m AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY run)) AS e FROM l)"""


@query("f7_tp_weights", f"""WITH {WEIGHTED}
SELECT run, t, value, bias, off AS "offset", lw AS log_weight, e / sum(e) OVER (PARTITION BY run) AS weight FROM m""", 't value bias "offset" log_weight weight', "series")
def _(spark, d):
    return weighted(spark, d)


RT = f"{X.GAS_KCAL * 300!r}"
JOINT = f"""{WEIGHTED}, x AS (SELECT run, t, value, value * value % 150 AS r, e / sum(e) OVER (PARTITION BY run) AS w FROM m),
d AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i * 10.0 AS a, j * 10.0 AS b, sum(w * exp(-0.5 * ((i * 10.0 - value) / 15) ** 2) * exp(-0.5 * ((j * 10.0 - r) / 12) ** 2)) AS p FROM x, range(0, 21) gi(i), range(0, 16) gj(j) GROUP BY ALL),
q AS (SELECT i, j, a, b, p / sum(p * CASE WHEN i IN (0, 20) THEN 0.5 ELSE 1 END * CASE WHEN j IN (0, 15) THEN 0.5 ELSE 1 END * 100) OVER () AS p FROM d),
jf AS (SELECT *, -{RT} * ln(p) - min(-{RT} * ln(p)) OVER () AS f FROM q)"""


@query("f8_joint_fes", f"WITH {JOINT} SELECT i, j, a, b, p, f FROM jf", "a b p f", "series")
def _(spark, d):
    x = weighted(spark, d).withColumn("r", F.col("value") * F.col("value") % 150)
    return FE.joint_fes(x, "value", "r", "weight", (0.0, 200.0, 21), (0.0, 150.0, 16), 15.0, 12.0, 300.0)


LOW = "lo AS (SELECT c.* FROM jf c WHERE f <= 5 AND NOT EXISTS (SELECT 1 FROM jf n WHERE abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND (n.i <> c.i OR n.j <> c.j) AND n.f <= c.f))"


@query("f9_joint_minima", f"WITH {JOINT}, {LOW} SELECT i, j, a, b, p, f FROM lo", "a b p f", "series")
def _(spark, d):
    x = weighted(spark, d).withColumn("r", F.col("value") * F.col("value") % 150)
    return FE.joint_minima(FE.joint_fes(x, "value", "r", "weight", (0.0, 200.0, 21), (0.0, 150.0, 16), 15.0, 12.0, 300.0), 5.0)


@query("f10_weighted_radial_hist", f"""WITH x AS (SELECT state, CAST(floor(value / 10) AS INTEGER) AS bin, sum(1.0 + idx % 3) AS w FROM series GROUP BY ALL), f AS (SELECT *, -{X.GAS_KCAL * 300!r} * ln(w / (((bin + 1) * 10.0) ** 3 - (bin * 10.0) ** 3)) AS f FROM x) SELECT state, bin, w, f - min(f) OVER (PARTITION BY state) AS pmf FROM f""", "w pmf", "series")
def _(spark, d):
    s = series(spark, d).withColumn("w", 1.0 + F.col("idx") % 3)
    return FE.weighted_radial_hist(s, "value", "w", 10.0, 300.0, ["state"])


def umbrella(spark, d):
    return series(spark, d).select((F.col("run") % 20).alias("window"), ((F.col("run") % 20) * 10.0).alias("target"), "value", "t_us", "run")


#: The WHAM equations iterated 300 times on the counts of 20 windows and 40 bins.
WHAM = f"""c AS (SELECT run % 20 AS w, CAST(least(floor(value / 5), 39) AS BIGINT) AS b FROM series WHERE value BETWEEN 0 AND 200), nw AS (SELECT w, count(*) AS n FROM c GROUP BY w), hb AS (SELECT i AS b, count(c.b) AS h FROM range(0, 40) r(i) LEFT JOIN c ON c.b = i GROUP BY i),
e AS (SELECT w, n, b, h, exp(-0.0005 * ((b + 0.5) * 5 - w * 10) ** 2 / {RT}) AS z FROM nw, hb),
it AS (SELECT 0 AS k, [0.0::DOUBLE FOR i IN range(0, 20)] AS f UNION ALL SELECT k + 1, [v - g[1] FOR v IN g] FROM (SELECT k, list(fw ORDER BY w) AS g FROM (SELECT k, e.w, -{RT} * ln(sum(e.z * p)) AS fw FROM e JOIN (SELECT it.k, e.b, any_value(h) / sum(n * exp(it.f[w + 1] / {RT}) * z) AS p FROM it, e WHERE it.k < 300 GROUP BY it.k, e.b) USING (b) GROUP BY k, e.w) GROUP BY k)),
p AS (SELECT b, any_value(h) AS h, any_value(h) / sum(n * exp(f[w + 1] / {RT}) * z) AS p FROM e, it WHERE k = 300 GROUP BY b)"""


@query("f11_wham", f"WITH {WHAM} SELECT CAST(b AS INTEGER) AS bin, (b + 0.5) * 5 AS x, h AS n, CASE WHEN h > 0 THEN -{RT} * ln(p) - min(CASE WHEN h > 0 THEN -{RT} * ln(p) END) OVER () END AS pmf FROM p", "x pmf", "series")
def _(spark, d):
    return FE.wham(umbrella(spark, d), 0.0005, 300.0, 0.0, 200.0, 40, tolerance=1e-12)


def some_start(n, replica, run, block):
    """Starts that both engines can tell: a stated congruence."""
    return f"(({replica}) * 7919 + ({block}) * 104729 + ({run}) * 1299709 + 11) % 2147483647 % ({n})"


BOOT = f"""n AS (SELECT run, count(*) AS n FROM series GROUP BY run), st AS (SELECT run, n, r AS replica, b, {some_start('n', 'r', 'run', 'b')} AS s FROM n, range(1, 41) a(r), range(0, 100000) c(b) WHERE b < ceil(n / 7.0)),
ats AS (SELECT run, replica, (s + o) % n AS idx FROM st, range(0, 7) d(o) WHERE b * 7 + o < n UNION ALL SELECT run, 0, idx FROM series), bm AS (SELECT run, replica, count(*) AS n, avg(value) AS mean FROM ats JOIN series USING (run, idx) GROUP BY ALL)"""


def replicas(spark, d):
    start = lambda n, *k: F.expr(some_start(n, "replica", "run", "block"))
    return FE.block_bootstrap(series(spark, d).select("run", "idx", "value"), ["value"], 40, 7, 11, ["run"], start=start)


@query("f12_block_bootstrap", f"WITH {BOOT} SELECT replica, run, n, round(mean * n, 4) AS total FROM bm", "total", "series")
def _(spark, d):
    return replicas(spark, d).select("replica", "run", "n", F.round("sum_value", 4).alias("total"))


@query("f12_intervals", f"WITH {BOOT}, pm AS (SELECT replica, run, mean * pi() AS mean FROM bm) SELECT run, max(mean) FILTER (replica = 0) AS estimate, stddev_samp(mean) FILTER (replica > 0) AS sd, quantile_cont(mean, 0.025) FILTER (replica > 0) AS low, quantile_cont(mean, 0.975) FILTER (replica > 0) AS high, count(*) FILTER (replica > 0 AND mean > 0) AS n_ok, count(*) FILTER (replica > 0 AND mean > 0) >= 36 AS enough FROM pm GROUP BY run", "estimate sd low high", "series")
def _(spark, d):
    mean = F.when(F.col("sum_value") > 0, F.col("sum_value") / F.col("n") * math.pi)  # a replica without a positive mean has failed; the factor keeps means of two decimals off rounding ties
    return FE.bootstrap_intervals(replicas(spark, d).withColumn("mean", mean), "mean", ["run"], 40, 0.95, 0.9)


@query("f7_effective_samples", f"WITH {WEIGHTED}, w AS (SELECT run, e / sum(e) OVER (PARTITION BY run) AS w FROM m) SELECT run, count(*) AS n, sum(w) ** 2 / sum(w * w) AS n_effective, max(w) / sum(w) AS largest FROM w GROUP BY run", "n_effective largest", "series")
def _(spark, d):
    return FE.effective_samples(weighted(spark, d), "weight", ["run"])


TITR = "titr AS (SELECT o_orderpriority AS site, CAST(month(o_orderdate) AS DOUBLE) AS ph, avg(CASE WHEN o_totalprice > 20000 * month(o_orderdate) THEN 1.0 ELSE 0.0 END) AS fraction FROM orders GROUP BY ALL)"


def titration_points(spark, d):
    o = read(spark, d, "orders")
    m = F.month("o_orderdate")
    return o.groupBy(F.col("o_orderpriority").alias("site"), m.cast("double").alias("ph")).agg(F.avg((F.col("o_totalprice") > 20000 * m).cast("double")).alias("fraction"))


@query("m1_fit_hh", f"WITH {TITR} SELECT site, -regr_intercept(y, ph) / regr_slope(y, ph) AS pka, -regr_slope(y, ph) AS hill, count(*) AS n FROM (SELECT *, log10((1 - fraction) / fraction) AS y FROM titr WHERE fraction > 0 AND fraction < 1) GROUP BY site", "pka hill")
def _(spark, d):
    return T.fit_hh(titration_points(spark, d), ["site"])


def grid_sql(lo: float, hi: float, points: int = 41, rounds: int = 4) -> str:
    n = points - 1
    out = [f"WITH {TITR}, b0 AS (SELECT DISTINCT site, {(lo + hi) / 2}::DOUBLE AS pka, 2.0::DOUBLE AS hill, {(hi - lo) / 2}::DOUBLE AS dp, 1.8::DOUBLE AS dh FROM titr)"]
    for k in range(rounds):
        out.append(f"g{k} AS (SELECT DISTINCT site, dp, dh, pka + (2 * i / {n}.0 - 1) * dp AS pka, greatest(0.05, hill + (2 * j / {n}.0 - 1) * dh) AS hill FROM b{k}, range(0, {points}) a(i), range(0, {points}) b(j))")
        out.append(f"s{k} AS (SELECT site, pka, hill, dp, dh, sum((1 - fraction - 1 / (1 + pow(10, hill * (pka - ph)))) ** 2) AS sse FROM titr JOIN g{k} USING (site) GROUP BY ALL)")
        out.append(f"b{k + 1} AS (SELECT site, arg_min(pka, (sse, pka, hill)) AS pka, arg_min(hill, (sse, pka, hill)) AS hill, min(sse) AS sse, any_value(dp) * 4 / {n} AS dp, any_value(dh) * 4 / {n} AS dh FROM s{k} GROUP BY site)")
    return ", ".join(out) + f" SELECT site, pka, hill, sse FROM b{rounds}"


@query("m2_fit_titration_grid", grid_sql(0.0, 14.0), "pka hill sse")
def _(spark, d):
    return T.fit_titration_grid(titration_points(spark, d).withColumn("fraction", 1 - F.col("fraction")), ["site"], 0.0, 14.0)


def wide_grid_sql(rounds: int = 3, points: int = 241, one: bool = False) -> str:
    """Rounds over a grid of pKa and Hill; the next one spans three steps on either side of the best point."""
    n = points - 1
    hills = "range(0, 1) b(j)" if one else f"range(0, {points}) b(j)"
    out = [f"WITH {TITR}, p AS (SELECT site, ph, 1 - fraction AS f FROM titr), b0 AS (SELECT site, min(ph) - 2 AS plo, max(ph) + 2 AS phi, {'1.0' if one else '0.15'}::DOUBLE AS hlo, {'1.0' if one else '2.0'}::DOUBLE AS hhi FROM p GROUP BY site)"]
    for k in range(rounds):
        out.append(f"g{k} AS (SELECT site, plo + i * ((phi - plo) / {n}) AS pka, hlo + j * ((hhi - hlo) / {n}) AS hill, (phi - plo) / {n} AS ps, (hhi - hlo) / {n} AS hs FROM b{k}, range(0, {points}) a(i), {hills})")
        out.append(f"s{k} AS (SELECT site, pka, hill, ps, hs, sum((f - 1 / (1 + pow(10, hill * (pka - ph)))) ** 2) AS sse FROM p JOIN g{k} USING (site) GROUP BY ALL)")
        out.append(f"m{k} AS (SELECT site, arg_min(pka, (sse, pka, hill)) AS pka, arg_min(hill, (sse, pka, hill)) AS hill, min(sse) AS sse, any_value(ps) AS ps, any_value(hs) AS hs FROM s{k} GROUP BY site), b{k + 1} AS (SELECT site, pka - 3 * ps AS plo, pka + 3 * ps AS phi, {'hill' if one else 'greatest(0.01, hill - 3 * hs)'} AS hlo, hill + 3 * hs AS hhi FROM m{k})")
    return ", ".join(out) + f" SELECT site, round(pka, 3) AS pka, round(hill, 3) AS hill, sse FROM m{rounds - 1}"


def raw_titration(spark, d):
    """A row an order: whether it is under its month's limit."""
    o = read(spark, d, "orders")
    m = F.month("o_orderdate")
    return o.select(F.col("o_orderpriority").alias("site"), m.cast("double").alias("ph"), (F.col("o_totalprice") <= 20000 * m).cast("double").alias("fraction"))


@query("m2_fit_wide_grid", wide_grid_sql(), "pka hill sse")
def _(spark, d):
    x = T.fit_titration_grid(titration_points(spark, d).withColumn("fraction", 1 - F.col("fraction")), ["site"], None, None, 241, 3, hills=(0.15, 2.0))
    return x.withColumns({"pka": F.round("pka", 3), "hill": F.round("hill", 3)})


@query("m2_fit_one_parameter", wide_grid_sql(4, 241, True).replace("sse FROM m3", "round(sse, 3) AS sse FROM m3"), "pka hill sse")
def _(spark, d):
    x = T.fit_titration_grid(titration_points(spark, d).withColumn("fraction", 1 - F.col("fraction")), ["site"], None, None, 241, 4, hills=1.0)
    return x.withColumns({"pka": F.round("pka", 3), "hill": F.round("hill", 3), "sse": F.round("sse", 3)})


@query("m3_fit_two_site")
def _(spark, d):
    p = titration_points(spark, d)
    a, b = 1 - F.col("fraction"), 1 - F.sqrt("fraction")
    x = p.select("site", "ph", ((1 - a) * (1 - b)).alias("p11"), (a * (1 - b)).alias("p01"), ((1 - a) * b).alias("p10"), (a * b).alias("p00"))
    return T.fit_two_site(x, ["site"])


@query("m4_fit_microstates")
def _(spark, d):
    p = titration_points(spark, d)
    x = p.select("site", "ph", F.col("fraction").alias("s0"), (0.3 * (1 - F.col("fraction"))).alias("s1"), (0.7 * (1 - F.col("fraction"))).alias("s2"))
    return T.fit_microstates(x, ["site"], 2)


def known_sites(spark, d):
    """pKas made of each site's points; the fits have to find them again."""
    p = titration_points(spark, d)
    s = p.groupBy("site").agg((3 + 2 * F.avg("fraction")).alias("a"), (4.5 + 2 * F.avg("fraction") + F.max("fraction")).alias("b"), F.min("fraction").alias("w"))
    return p.select("site", "ph").join(s, "site")


KNOWN = f"{TITR}, s AS (SELECT site, 3 + 2 * avg(fraction) AS a, 4.5 + 2 * avg(fraction) + max(fraction) AS b, min(fraction) AS w FROM titr GROUP BY site)"


@query("m3_two_site_recovered", f"WITH {KNOWN}, m AS (SELECT *, -log10(pow(10, -a) + pow(10, -b)) AS m1 FROM s) SELECT site, round(least(a, b), 4) AS pk_low, round(greatest(a, b), 4) AS pk_high, round(w, 4) AS w, round(m1, 4) AS macro_1, round(a + b + w - m1, 4) AS macro_2, 0.0 AS sse, true AS converged FROM m", "pk_low pk_high w macro_1 macro_2 sse")
def _(spark, d):
    ten, x = F.lit(10.0), F.col("ph")
    w = {"p11": F.lit(1.0), "p01": F.pow(ten, x - F.col("a")), "p10": F.pow(ten, x - F.col("b")), "p00": F.pow(ten, 2 * x - F.col("a") - F.col("b") - F.col("w"))}
    total = w["p11"] + w["p01"] + w["p10"] + w["p00"]
    y = T.fit_two_site(known_sites(spark, d).select("site", "ph", *[(v / total).alias(k) for k, v in w.items()]), ["site"])
    return y.select("site", F.round(F.least("pk_a", "pk_b"), 4).alias("pk_low"), F.round(F.greatest("pk_a", "pk_b"), 4).alias("pk_high"), *[F.round(c, 4).alias(c) for c in ("w", "macro_1", "macro_2")], "sse", "converged")


@query("m4_microstates_recovered", f"WITH {KNOWN} SELECT site, round(a, 4) AS pk1, round(b, 4) AS pk2, round(-log10(pow(10, -a) + pow(10, -b)), 4) AS macro, 0.0 AS sse, true AS converged FROM s", "pk1 pk2 macro sse")
def _(spark, d):
    p = known_sites(spark, d)
    x = p.select("site", "ph", *[v.alias(f"s{k}") for k, v in enumerate(T.microstate_weights(F.col("ph"), [F.col("a"), F.col("b")]))])
    return T.fit_microstates(x, ["site"], 2).select("site", *[F.round(c, 4).alias(c) for c in ("pk1", "pk2", "macro")], "sse", "converged")


@query("m5_titration_curve", f"WITH {TITR}, s AS (SELECT site, avg(fraction) * 10 AS pka FROM titr GROUP BY site) SELECT site, pka, 1.0 AS hill, 2 + i * 0.5 AS ph, 1 / (1 + pow(10, pka - (2 + i * 0.5))) AS fraction FROM s, range(0, 21) r(i)", "pka hill ph fraction")
def _(spark, d):
    s = titration_points(spark, d).groupBy("site").agg((F.avg("fraction") * 10).alias("pka")).withColumn("hill", F.lit(1.0))
    return T.titration_curve(s, 2.0, 12.0, 0.5)


@query("m6_binding_linkage", f"""WITH {TITR}, x AS (SELECT site, ph, 6.0 + fraction AS pka_bound, 5.0 AS pka_free, -7.0 AS dg0 FROM titr), y AS (SELECT *, 1 / (1 + pow(10, ph - pka_bound)) - 1 / (1 + pow(10, ph - pka_free)) AS dn_h,
dg0 + {X.GAS_KCAL * 300!r} * (ln(1 + pow(10, pka_free - ph)) - ln(1 + pow(10, pka_bound - ph)) - ln(1 + pow(10, pka_free - 7.0)) + ln(1 + pow(10, pka_bound - 7.0))) AS dg FROM x) SELECT site, ph, dn_h, dg, exp(dg / {X.GAS_KCAL * 300!r}) * 1e6 AS kd_um FROM y""", "ph dn_h dg kd_um")
def _(spark, d):
    p = titration_points(spark, d).select("site", "ph", (6.0 + F.col("fraction")).alias("pka_bound"), F.lit(5.0).alias("pka_free"), F.lit(-7.0).alias("dg0"))
    return T.binding_linkage(p, 300.0, 7.0).select("site", "ph", "dn_h", "dg", (F.col("kd") * 1e6).alias("kd_um"))


@query("m7_spectral_peak", f"""WITH {TITR}, s AS (SELECT state, wl, exp(-0.5 * ((wl - c) / 20.0) ** 2) AS a FROM (VALUES ('p', 400.0), ('d', 430.0)) c(state, c), (SELECT 350.0 + 5 * i AS wl FROM range(0, 31) r(i))), pop AS (SELECT site, ph, 'p' AS state, fraction AS p FROM titr UNION ALL SELECT site, ph, 'd', 1 - fraction FROM titr),
m AS (SELECT site, ph, wl, sum(p * a) AS a FROM pop JOIN s USING (state) GROUP BY ALL), n AS (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS r, row_number() OVER (PARTITION BY site, ph ORDER BY a DESC, wl) AS k FROM m WINDOW w AS (PARTITION BY site, ph ORDER BY wl))
SELECT site, ph, wl + CASE WHEN l - 2 * a + r < 0 THEN 5.0 * (l - r) / (2 * (l - 2 * a + r)) ELSE 0 END AS peak, a AS height FROM n WHERE k = 1""", "ph peak height")
def _(spark, d):
    p = titration_points(spark, d)
    pop = p.select("site", "ph", F.lit("p").alias("state"), F.col("fraction").alias("p")).unionByName(p.select("site", "ph", F.lit("d").alias("state"), (1 - F.col("fraction")).alias("p")))
    wl = spark.range(31).select((350.0 + 5 * F.col("id")).alias("wl"))
    s = spark.createDataFrame([("p", 400.0), ("d", 430.0)], "state string, c double").crossJoin(F.broadcast(wl)).select("state", "wl", X.kernel((F.col("wl") - F.col("c")) / 20.0).alias("a"))  # a stated grid
    return T.spectral_mixture_peak(pop, s, ["site", "ph"])


@query("m8_fit_sigmoid", f"""WITH {TITR}, g AS (SELECT site, 2 + i * 0.1 AS pka, 400 + 30 * (1 - fraction) AS y, 1 / (1 + pow(10, (2 + i * 0.1) - ph)) AS f FROM titr, range(0, 101) r(i)), s AS (SELECT site, pka, regr_slope(y, f) AS b, regr_intercept(y, f) AS a, regr_syy(y, f) - regr_sxy(y, f) ** 2 / regr_sxx(y, f) AS sse FROM g GROUP BY ALL)
SELECT site, arg_min(pka, (sse, pka)) AS pka, arg_min(a, (sse, pka)) AS low, arg_min(a + b, (sse, pka)) AS high, min(sse) AS sse FROM s GROUP BY site""", "pka low high sse")
def _(spark, d):
    p = titration_points(spark, d).select("site", "ph", (400 + 30 * (1 - F.col("fraction"))).alias("y"))
    return T.fit_sigmoid(p, ["site"], 2.0, 12.0, 101)
