"""Autocorrelation and regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.student import f_p_value, t_critical, t_p_value


def cosine_acf(df: DataFrame, deg: Column, lags: int, key: str = "run", idx: str = "idx", size: int | None = None) -> DataFrame:
    """Mean cosine of the change over each lag 0..lags, over all origins of a run.

    Each row sees the `lags` rows behind it in a sliding array, so rows are shuffled once, by run (long runs by block); the
    pairs are summed by lag before the next shuffle. A lag is a difference of idx: gaps in it give no pairs.
    """
    from .runs import with_windows

    x = df.select(key, F.col(idx).alias("i"), deg.alias("a"))
    ahead = lambda k: F.collect_list(F.struct("i", "a")).over(Window.partitionBy(k).orderBy("i").rowsBetween(0, lags))
    x = with_windows(x, {"_w": ahead}, 0, lags, key, "i", size)
    x = x.select(key, "i", "a", F.explode("_w").alias("b")).select(key, (F.col("b.i") - F.col("i")).cast("int").alias("lag"), F.cos(F.radians(F.col("a") - F.col("b.a"))).alias("c"))
    return x.where(F.col("lag") <= lags).groupBy(key, "lag").agg(F.avg("c").alias("c"), F.count("*").alias("n"))


def ensemble_acf(acf: DataFrame, key: str = "run") -> DataFrame:
    """R2: mean and sample sd over runs at each lag that every run has."""
    runs = acf.agg(F.count_distinct(key).alias("_r"))
    x = acf.groupBy("lag").agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("sd"), F.count("*").alias("_n"))
    return x.crossJoin(F.broadcast(runs)).where("_n = _r").select("lag", "mean", "sd")  # one row


def integrate_acf(acf: DataFrame, dt: float, key: str = "run", tail: int = 5) -> DataFrame:
    """Cumulative trapezoid of (c - plateau) / (c0 - plateau); the plateau is the mean of the last `tail` lags."""
    w = Window.partitionBy(key).orderBy("lag")
    n = F.max("lag").over(Window.partitionBy(key))
    x = acf.withColumn("_p", F.avg(F.when(F.col("lag") > n - tail, F.col("c"))).over(Window.partitionBy(key))).withColumn("_c0", F.first("c").over(w))
    x = x.withColumn("_y", F.try_divide(F.col("c") - F.col("_p"), F.col("_c0") - F.col("_p")))
    s = F.coalesce((F.col("_y") + F.lag("_y").over(w)) / 2 * dt, F.lit(0.0))
    return x.withColumn("_s", s).withColumn("integral", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "lag", "integral")


def fit_log_linear(acf: DataFrame, keys: list[str], x: str = "lag", y: str = "c") -> DataFrame:
    """Decay time of y = exp(-x / tau) from the line through the origin of -log y."""
    z = acf.where(F.col(y) > 0)
    return z.groupBy(*keys).agg(F.try_divide(F.sum(F.col(x) * F.col(x)), F.sum(-F.log(y) * F.col(x))).alias("tau"), F.count("*").alias("n"))


def fit_decay(acf: DataFrame, keys: list[str], tau0: float, rounds: int = 25, x: str = "lag", y: str = "c") -> DataFrame:
    """y = p + (1 - p) exp(-x / tau) by damped Gauss-Newton from several starts (tau0, a quarter and four times of it), all keys at once: tau, plateau p, sum of squares, whether the best start converged."""
    from .titration import gauss_newton

    e = lambda r: F.exp(-r * F.col(x))
    model = {y: (lambda r, p: p + (1 - p) * e(r), [lambda r, p: -(1 - p) * F.col(x) * e(r), lambda r, p: 1 - e(r)])}
    starts = [{"rate": 1 / (tau0 * k), "plateau": 0.0} for k in (1.0, 0.25, 4.0)]
    z = gauss_newton(acf.select(*keys, x, y), keys, model, starts, rounds)
    return z.select(*keys, F.try_divide(F.lit(1.0), F.col("rate")).alias("tau"), "plateau", "sse", "converged")


def fit_line(df: DataFrame, x: str, y: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """Least-squares line with R2, adjusted R2, RMSE, the standard errors of slope and intercept, their confidence intervals, and the slope's two-sided p-value."""
    g = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_avgx(y, x).alias("mx"), (F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), F.lit(2)), F.regr_sxx(y, x))).alias("sse"))
    v = F.try_divide(F.greatest(F.lit(0.0), F.col("sse")), F.col("n") - 2)
    g = g.select(*keys, "n", "slope", "intercept", "r2", (1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - 2)).alias("adj_r2"), F.sqrt(F.greatest(F.lit(0.0), F.col("sse")) / F.col("n")).alias("rmse"), F.sqrt(F.try_divide(v, F.col("sxx"))).alias("se_slope"), F.sqrt(v * (1 / F.col("n") + F.try_divide(F.pow("mx", F.lit(2)), F.col("sxx")))).alias("se_intercept"))
    return _intervals(g, {"slope": "se_slope", "intercept": "se_intercept"}, F.col("n") - 2, level).withColumn("p_slope", t_p_value(F.try_divide(F.col("slope"), F.col("se_slope")), F.col("n") - 2)).drop("n")


def _intervals(g: DataFrame, errors: dict[str, str], df: Column, level: float) -> DataFrame:
    g = g.withColumn("_t", t_critical(df, level))
    return g.withColumns({f"{c}_{side}": F.col(c) + sign * F.col("_t") * F.col(se) for c, se in errors.items() for side, sign in (("low", -1), ("high", 1))}).drop("_t")


def fit_plane(df: DataFrame, a: str, b: str, y: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """Least-squares plane y = c0 + c1 a + c2 b from centred sums of products, with R2, adjusted R2, RMSE, standard errors, confidence intervals and p-values of the slopes, and the p-value of the whole (F test)."""
    x = {"a": F.col(a), "b": F.col(b), "y": F.col(y)}
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.var_pop(y).alias("yy"), *[F.avg(c).alias(f"m{k}") for k, c in x.items()])
    s = s.withColumn("d", F.col("aa") * F.col("bb") - F.col("ab") ** 2)
    s = s.withColumns({"c1": F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), F.col("d")), "c2": F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), F.col("d"))})
    s = s.withColumns({"c0": F.col("my") - F.col("c1") * F.col("ma") - F.col("c2") * F.col("mb"), "r2": F.try_divide(F.col("c1") * F.col("ay") + F.col("c2") * F.col("by"), F.col("yy"))})
    s = s.withColumns({"sse": F.greatest(F.lit(0.0), F.col("n") * F.col("yy") * (1 - F.col("r2"))), "df": F.col("n") - 3})
    v = F.try_divide(F.col("sse"), F.col("df"))
    nd = F.col("n") * F.col("d")
    s = s.withColumns({"se_c1": F.sqrt(F.try_divide(v * F.col("bb"), nd)), "se_c2": F.sqrt(F.try_divide(v * F.col("aa"), nd))})
    spread = F.try_divide(F.col("ma") ** 2 * F.col("bb") - 2 * F.col("ma") * F.col("mb") * F.col("ab") + F.col("mb") ** 2 * F.col("aa"), nd)
    s = s.withColumns({"se_c0": F.sqrt(v * (1 / F.col("n") + spread)), "adj_r2": 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("df")), "rmse": F.sqrt(F.col("sse") / F.col("n"))})
    f = F.try_divide(F.col("n") * F.col("yy") * F.col("r2") / 2, v)
    s = s.withColumns({"p_c1": t_p_value(F.try_divide(F.col("c1"), F.col("se_c1")), F.col("df")), "p_c2": t_p_value(F.try_divide(F.col("c2"), F.col("se_c2")), F.col("df")), "p_plane": f_p_value(f, F.lit(2), F.col("df"))})
    s = _intervals(s, {"c0": "se_c0", "c1": "se_c1", "c2": "se_c2"}, F.col("df"), level)
    return s.select(*keys, "c0", "c1", "c2", "r2", "adj_r2", "rmse", "se_c0", "se_c1", "se_c2", *[f"{c}_{side}" for c in ("c0", "c1", "c2") for side in ("low", "high")], "p_c1", "p_c2", "p_plane")


def fit_model(acf: DataFrame, keys: list[str], form: str, start: dict[str, float] | list[dict[str, float]], rounds: int = 25, x: str = "lag", y: str = "c") -> DataFrame:
    """Damped Gauss-Newton fit of exp (rate), biexp (share, rate, slow), tail (scale, rate) or underdamped (rate, omega) decays: parameters, sse, r2, rmse, converged. start: one start, or several of which each key keeps the best."""
    from .titration import gauss_newton

    t = lambda: F.col(x)
    e = lambda r: F.exp(-r * t())
    forms = {
        "exp": (["rate"], lambda r: e(r), [lambda r: -t() * e(r)]),
        "tail": (["scale", "rate"], lambda a, r: a * e(r), [lambda a, r: e(r), lambda a, r: -a * t() * e(r)]),
        "biexp": (["share", "rate", "slow"], lambda a, r, s: a * e(r) + (1 - a) * e(s), [lambda a, r, s: e(r) - e(s), lambda a, r, s: -a * t() * e(r), lambda a, r, s: -(1 - a) * t() * e(s)]),
        "underdamped": (["rate", "omega"], lambda r, w: e(r) * F.cos(w * t()), [lambda r, w: -t() * e(r) * F.cos(w * t()), lambda r, w: -t() * e(r) * F.sin(w * t())]),
    }
    names, value, slopes = forms[form]
    starts = [{n: s[n] for n in names} for s in ([start] if isinstance(start, dict) else start)]
    z = gauss_newton(acf.select(*keys, x, y), keys, {y: (value, slopes)}, starts, rounds)
    v = acf.groupBy(*keys).agg((F.var_pop(y) * F.count(y)).alias("_v"), F.count(y).alias("_n"))
    return z.join(v, keys).select(*keys, *names, "sse", (1 - F.try_divide(F.col("sse"), F.col("_v"))).alias("r2"), F.sqrt(F.col("sse") / F.col("_n")).alias("rmse"), "converged")
