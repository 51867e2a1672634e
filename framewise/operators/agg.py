"""Aggregations with uncertainty. Sums and moments only, so Spark adds them up by task before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def block_sem(df: DataFrame, value: str, blocks: int, keys: list[str], t: str = "t") -> DataFrame:
    """A4: mean and standard error from the means of `blocks` consecutive blocks (null for one block)."""
    w = Window.partitionBy(*keys).orderBy(t)
    means = df.withColumn("_b", F.ntile(blocks).over(w)).groupBy(*keys, "_b").agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return means.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("sem"))


def circular_mean_std(df: DataFrame, deg: Column, keys: list[str]) -> DataFrame:
    """A5: mean direction, circular standard deviation in degrees, resultant length."""
    x = df.groupBy(*keys).agg(F.avg(F.sin(F.radians(deg))).alias("s"), F.avg(F.cos(F.radians(deg))).alias("c"))
    r = F.least(F.lit(1.0), F.hypot("s", "c"))
    return x.select(*keys, F.degrees(F.atan2("s", "c")).alias("mean_deg"), F.degrees(F.sqrt(-2 * F.log(r))).alias("sd_deg"), r.alias("resultant"))


def summary_stats(df: DataFrame, value: str, keys: list[str], run: str = "run") -> DataFrame:
    """N, runs, mean, sample sd, median, min, max."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.count_distinct(run).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def second_half(df: DataFrame, value: str, key: str = "run", t: str = "t") -> DataFrame:
    """Mean and linear slope over rows with index >= n // 2."""
    w = Window.partitionBy(key)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(t)) - 1, "_n": F.count("*").over(w)}).where("_i >= floor(_n / 2)")
    return x.groupBy(key).agg(F.avg(value).alias("mean"), F.regr_slope(value, t).alias("slope"))


def ensemble_band(df: DataFrame, x: str, value: str) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles across runs at each grid point."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(x).agg(F.avg(value).alias("mean"), q[0].alias("low"), q[1].alias("high"))


def weighted_ensemble(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Weighted mean, population sd, effective n = (sum w)^2 / sum w^2, standard error."""
    w, v = F.col(weight), F.col(value)
    x = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"))
    mean = F.col("wv") / F.col("w")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("wvv") / F.col("w") - mean * mean))
    n = F.col("w") * F.col("w") / F.col("w2")
    return x.select(*keys, mean.alias("mean"), sd.alias("sd"), n.alias("n_eff"), (sd / F.sqrt(n)).alias("sem"))


def state_populations(df: DataFrame, state: str, keys: list[str], blocks: int, t: str = "record") -> DataFrame:
    """Share of each state per key with block standard error and record count."""
    states = df.select(state).distinct().withColumnRenamed(state, "_s")
    w = Window.partitionBy(*keys).orderBy(t)
    b = df.withColumn("_b", F.ntile(blocks).over(w)).groupBy(*keys, "_b", state).agg(F.count("*").alias("_n"))
    total = b.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    part = total.crossJoin(F.broadcast(states)).join(b.withColumnRenamed(state, "_s"), [*keys, "_b", "_s"], "left").fillna(0, ["_n"])  # states: a handful by definition
    return part.groupBy(*keys, F.col("_s").alias(state)).agg((F.sum("_n") / F.sum("_t")).alias("fraction"), (F.stddev_samp(F.col("_n") / F.col("_t")) / F.sqrt(F.count("*"))).alias("sem"), F.sum("_t").alias("n_records"))


def syn_anti(df: DataFrame, syn: Column, anti: Column, keys: list[str]) -> DataFrame:
    """Counts and ratio (infinite without anti, null without both)."""
    x = df.groupBy(*keys).agg(F.count_if(syn).alias("n_syn"), F.count_if(anti).alias("n_anti"))
    return x.withColumn("ratio", F.when((F.col("n_anti") == 0) & (F.col("n_syn") > 0), F.lit(float("inf"))).otherwise(F.try_divide("n_syn", "n_anti")))


def joint_microstates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the four joint states (proton 0/1 of two sites), of 0, 1 and 2 protons, and the mean count; records of one site only raise."""
    x = a.select(*keys, "record", F.col("proton").alias("_a")).join(b.select(*keys, "record", F.col("proton").alias("_b")), [*keys, "record"], "full")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("sites have different records"))).otherwise(F.lit(1))
    share = {f"p{i}{j}": F.avg(((F.col("_a") == i) & (F.col("_b") == j)).cast("double") * whole) for i in (0, 1) for j in (0, 1)}
    y = x.groupBy(*keys).agg(*[v.alias(k) for k, v in share.items()], F.avg(F.col("_a") + F.col("_b")).alias("mean_protons"))
    return y.withColumn("one_proton", F.col("p01") + F.col("p10"))


def exchange_acceptance(df: DataFrame, keys: list[str], a: str = "replica", b: str = "partner", ok: str = "success") -> DataFrame:
    """Attempts, accepts and percent of each neighbour edge; mismatch counts attempts whose two records disagree."""
    e = df.select(*keys, "exchange", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col(ok).cast("int").alias("ok"))
    one = e.groupBy(*keys, "exchange", "low", "high").agg(F.max("ok").alias("ok"), (F.max("ok") != F.min("ok")).alias("bad"))
    return one.groupBy(*keys, "low", "high").agg(F.count("*").alias("attempts"), F.sum("ok").alias("accepts"), (100.0 * F.avg("ok")).alias("percent"), F.count_if("bad").alias("mismatches"))


def residence_percent(df: DataFrame, walker: str, place: str) -> DataFrame:
    """Percent of its records that each walker spends at each place."""
    n = df.groupBy(walker, place).agg(F.count("*").alias("n"))
    return n.select(walker, place, (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(walker))).alias("percent"))


def residence_lifetime(df: DataFrame, walker: str, place: str, t: str) -> DataFrame:
    """Visits, longest and mean visit (in records) of each walker at each place."""
    from .events import islands

    x = islands(df, F.lit(True), walker, t, value=F.col(place))
    return x.groupBy(walker, F.col("id").alias(place)).agg(F.count("*").alias("visits"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


def perf_summary(df: DataFrame, keys: list[str], seconds: str, steps: int) -> DataFrame:
    """Mean seconds a step and projected hours for 10 and 100 times the steps."""
    x = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_s"))
    return x.withColumns({f"hours_x{k}": F.col("mean_s") * steps * k / 3600.0 for k in (10, 100)})


def overlap(a: DataFrame, b: DataFrame, bin: str, keys: list[str]) -> DataFrame:
    """Bhattacharyya and minimum overlap of two histograms (keys, bin, n)."""
    share = lambda d, c: d.select(*keys, bin, (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(c))
    x = share(a, "_p").join(share(b, "_q"), [*keys, bin])
    return x.groupBy(*keys).agg(F.sum(F.sqrt(F.col("_p") * F.col("_q"))).alias("bhattacharyya"), F.sum(F.least("_p", "_q")).alias("minimum"))


def calibration_summary(df: DataFrame, value: str, skip: int, key: str, t: str) -> DataFrame:
    """Mean and sample sd after the first skip evaluations (sd 0 for one)."""
    x = df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(t))).where(F.col("_i") > skip)
    return x.groupBy(key).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))


def harmonic_width(df: DataFrame, value: str, k: float, temperature: float, keys: list[str]) -> DataFrame:
    """Observed sd of each window beside the one a harmonic bias allows, with k read in kJ and in kcal."""
    from ..functions.exprs import GAS_KCAL, KJ_PER_KCAL

    x = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    return x.withColumns({"expected_kcal": F.lit((GAS_KCAL * temperature / (2 * k)) ** 0.5), "expected_kj": F.lit((GAS_KCAL * temperature * KJ_PER_KCAL / (2 * k)) ** 0.5)})


def positive_defect(df: DataFrame, q: str, lo: float, hi: float, keys: list[str], atom: str = "atom_id") -> DataFrame:
    """A2: atom with the largest charge inside [lo, hi] of each frame (the larger id of equal ones), null where none is."""
    inside = F.col(q).between(lo, hi)
    return df.groupBy(*keys).agg(F.max(F.when(inside, F.struct(q, atom))).alias("_m")).select(*keys, F.col(f"_m.{atom}").alias("defect"), F.col(f"_m.{q}").alias("charge"))


def negative_defect(df: DataFrame, q: str, keys: list[str], atom: str = "atom_id") -> DataFrame:
    """A3: atom with the lowest charge of each frame and the second-lowest charge."""
    low = F.slice(F.array_sort(F.collect_list(F.struct(q, atom))), 1, 2)  # a frame's atoms are bounded
    return df.groupBy(*keys).agg(low.alias("_l")).select(*keys, F.get("_l", 0)[atom].alias("defect"), F.get("_l", 0)[q].alias("charge"), F.get("_l", 1)[q].alias("second"))


def atomic_charge(df: DataFrame, q: str, keys: list[str]) -> DataFrame:
    """A1: orbital populations added up by atom."""
    return df.groupBy(*keys).agg(F.sum(q).alias("q"), F.count("*").alias("n_orbitals"))


def basin_residence(df: DataFrame, minima: DataFrame, surface: str, key: str = "run", t: str = "t", value: str = "value") -> DataFrame:
    """A10: time spent nearest to each minimum (surface, basin, x) of the surface that holds at the time."""
    w = Window.partitionBy(key).orderBy(t)
    held = minima.groupBy(surface).agg(F.collect_list(F.struct("basin", "x")).alias("_minima"))  # a row a surface; samples stay where they are, whatever number of them a surface has
    x = df.withColumn("_dt", F.lead(t).over(w) - F.col(t)).join(F.broadcast(held), surface)
    nearest = F.array_min(F.transform(F.col("_minima"), lambda m: F.struct(F.abs(F.col(value) - m["x"]).alias("d"), m["basin"].alias("basin"))))
    return x.groupBy(key, nearest["basin"].alias("basin")).agg(F.sum("_dt").alias("residence"))
