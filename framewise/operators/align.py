"""Joins and alignment of series. Default columns: run (key), t (time), value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .runs import long_runs, spans, with_windows


def exact_time_join(a: DataFrame, b: DataFrame, columns: list[str], key: str = "run", t: str = "t", places: float = 1e8) -> DataFrame:
    """Rows of a with b's columns at the same time (rounded to 1 / places); null where none matches, never a nearest one."""
    tick = lambda d: F.rint(d[t] * places).cast("bigint")
    right = b.select(F.col(key).alias("_key"), tick(b).alias("_tick"), *columns)
    left = a.withColumn("_at", tick(a))
    return left.join(right, (left[key] == right["_key"]) & (left["_at"] == right["_tick"]), "left").drop("_key", "_tick", "_at")


def _beside(a: DataFrame, b: DataFrame, key: str, t: str, columns: list[str], size: int | None = None) -> DataFrame:
    """a's rows with the last row of b at or before (_p) and the first at or after (_n), one shuffle on the key.

    Keys with more than `size` rows (LONG by default) of both are cut into blocks of time; what a block does not hold comes
    from the table of blocks (the first and last row of b in each).
    """
    row = F.struct(F.col(t).alias("t"), *columns)
    every = a.select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.lit(1).alias("_a"), F.struct(*a.columns).alias("_row"), F.lit(None).cast(b.select(row.alias("r")).schema["r"].dataType).alias("_b"))
    every = every.unionByName(b.select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.lit(0).alias("_a"), F.lit(None).cast(every.schema["_row"].dataType).alias("_row"), row.alias("_b")))
    block = long_runs(every, "_k", size)
    if block:
        every = spans(every.withColumnRenamed("_k", "_key"), "_key", "_t", size).withColumnRenamed("_key", "_k")
    w = Window.partitionBy("_k", *(["_block"] if block else [])).orderBy("_t")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    both = every.withColumns({"_p": F.last("_b", ignorenulls=True).over(before), "_n": F.first("_b", ignorenulls=True).over(after)}).where("_a = 1")
    if block:
        at = F.when(F.col("_b").isNotNull(), F.col("_t"))
        ends = every.groupBy("_k", "_block").agg(F.min_by("_b", at).alias("_first"), F.max_by("_b", at).alias("_last"))
        o = Window.partitionBy("_k").orderBy("_block")
        ends = ends.select("_k", "_block", F.last("_last", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_bp"), F.first("_first", ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_bn"))
        ends = ends.select(F.col("_k").alias("_ek"), F.col("_block").alias("_eb"), "_bp", "_bn")
        both = both.join(ends, F.col("_k").eqNullSafe(F.col("_ek")) & (F.col("_block") == F.col("_eb"))).withColumns({"_p": F.coalesce("_p", "_bp"), "_n": F.coalesce("_n", "_bn")})
    return both.select("_row.*", "_p", "_n")


def asof_backward(a: DataFrame, b: DataFrame, columns: list[str], key: str = "run", t: str = "t", nearest: bool = True, size: int | None = None) -> DataFrame:
    """The latest row of b at or before each time; the first after it where none is before (nearest=False: null)."""
    x = _beside(a, b, key, t, columns, size)
    pick = F.coalesce("_p", "_n") if nearest else F.col("_p")
    return x.select(*a.columns, pick["t"].alias("t_b"), *[pick[c].alias(c) for c in columns])


def nearest_time_join(a: DataFrame, b: DataFrame, columns: list[str], tolerance: Column | float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Each row of a with the nearest row of b within the tolerance, the earlier of two equally near; nulls otherwise."""
    x = _beside(a, b, key, t, columns, size)
    dp, dn = F.col(t) - F.col("_p.t"), F.col("_n.t") - F.col(t)
    pick = F.when(F.col("_n").isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    x = x.withColumn("_x", pick)
    fits = F.abs(F.col("_x.t") - F.col(t)) <= (F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance)
    return x.select(*a.columns, F.when(fits, F.col("_x.t")).alias("t_b"), *[F.when(fits, F.col(f"_x.{c}")).alias(c) for c in columns])


def interp_join(grid: DataFrame, samples: DataFrame, value: str = "value", key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Linear interpolation of samples at the grid's times, null outside their range."""
    x = _beside(grid, samples, key, t, [value], size)
    t0, t1, y0, y1 = F.col("_p.t"), F.col("_n.t"), F.col(f"_p.{value}"), F.col(f"_n.{value}")
    y = F.when(t1 == t0, y0).otherwise(y0 + (y1 - y0) * (F.col(t) - t0) / F.nullif(t1 - t0, F.lit(0.0)))
    return x.select(*grid.columns, y.alias("interpolated"))


def station_times(df: DataFrame, dt: float, t_fill: float = 0.0, t_max: float | None = None, key: str = "run", t: str = "t", value: str = "value", size: int | None = None) -> DataFrame:
    """P5: the first sample at or after each point of the time grid t_fill, t_fill + dt, ..."""
    last = F.max(t) if t_max is None else F.least(F.max(t), F.lit(float(t_max)))
    grid = df.groupBy(key).agg(last.alias("_end")).where(F.col("_end") >= t_fill).select(key, F.explode(F.sequence(F.lit(0), F.floor((F.col("_end") - t_fill) / dt))).alias("station"))
    grid = grid.withColumn(t, t_fill + F.col("station") * dt)
    return _beside(grid, df, key, t, [value], size).select(key, "station", F.col(t).alias("target"), F.col("_n.t").alias(t), F.col(f"_n.{value}").alias(value))


def hill_number_join(fes: DataFrame, hills: DataFrame, key: str = "run") -> DataFrame:
    """Surfaces get the time of the deposition that their Gaussian count names."""
    return fes.join(hills.select(key, F.col("hill_no").alias("n_gauss"), F.col("t").alias("t_hill")), [key, "n_gauss"])


def validate_series(computed: DataFrame, logged: DataFrame, tolerance: float, key: str = "run", step: str = "idx", value: str = "value") -> DataFrame:
    """Per key: rows of each side, how many differ by more than the tolerance, the largest difference and its step."""
    a, b = computed.select(key, step, F.col(value).alias("_a")), logged.select(key, step, F.col(value).alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    return a.join(b, [key, step], "full").groupBy(key).agg(F.count("_a").alias("n_computed"), F.count("_b").alias("n_logged"), F.count_if(d > tolerance).alias("n_over"), F.max(d).alias("max_diff"), F.max_by(step, F.when(d.isNotNull(), F.struct(d, -F.col(step)))).alias("at_step"))


def stitch_restart(base: DataFrame, restart: DataFrame, key: str = "run", t: str = "t", shift: bool = False) -> DataFrame:
    """Base and, of the restart, what lies beyond base's end; shift=True moves a clock that starts anew behind that end."""
    end = base.groupBy(key).agg(F.max(t).alias("_end"))
    first = restart.groupBy(key).agg(F.max(t).alias("_last"))
    r = restart.join(end, key, "left").join(first, key)
    reset = F.col("_last") <= F.col("_end")
    if shift:
        r = r.withColumn(t, F.when(reset, F.col(t) + F.col("_end")).otherwise(F.col(t)))
    else:
        r = r.withColumn(t, F.when(reset, F.raise_error(F.lit("the restart's clock does not pass the end of its base"))).otherwise(F.col(t)))
    return base.unionByName(r.where(F.col("_end").isNull() | (F.col(t) > F.col("_end"))).select(*base.columns))


def clock_offset(child: DataFrame, parent: DataFrame, dt: float, key: str = "run", step: str = "idx", t: str = "t") -> DataFrame:
    """Per key, offset that puts the child's clock on the parent's: parent's time + steps since * dt - the child's first time."""
    c = child.groupBy(key).agg(F.min_by(F.struct(F.col(step).alias("s"), F.col(t).alias("t")), step).alias("c"))
    p = parent.groupBy(key).agg(F.max_by(F.struct(F.col(step).alias("s"), F.col(t).alias("t")), step).alias("p"))
    return c.join(p, key).select(key, (F.col("p.t") + (F.col("c.s") - F.col("p.s")) * dt - F.col("c.t")).alias("offset"))


def align_state_to_frames(frames: DataFrame, records: DataFrame, every: int, keys: list[str]) -> DataFrame:
    """Frame f takes the record f * every of the same keys."""
    return frames.withColumn("record", F.col("frame") * every).join(records, [*keys, "record"])


def missing_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are missing and actual ones that nobody expects."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("status", F.lit("unexpected")))


def nearest_to_targets(df: DataFrame, start: float, stop: float, spacing: float, key: str = "run", t: str = "t", value: str = "value") -> DataFrame:
    """For each target from start to stop (inclusive, either direction) the earliest row with the least distance to it."""
    n = int(round(abs(stop - start) / spacing))
    step = spacing if stop >= start else -spacing
    targets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: start + i * step))
    x = df.select(key, t, value, targets.alias("target"))
    best = F.struct(F.abs(F.col(value) - F.col("target")).alias("e"), F.col(t))
    return x.groupBy(key, "target").agg(F.min_by(F.struct(t, value), best).alias("b")).select(key, "target", f"b.{t}", f"b.{value}")


def nearest_label(value: Column, start: float, spacing: float, n: int) -> Column:
    """Index of the nearest of n equally spaced centres, ties to the lower."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((value - start) / spacing - 0.5))).cast("int")


def compare_estimates(a: DataFrame, b: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Difference of two keyed estimates (estimate, sd), its sd and its shift in pKa units."""
    y = b.select(*keys, F.col("estimate").alias("_e"), F.col("sd").alias("_s"))
    return a.join(y, keys).select(*keys, (F.col("estimate") - F.col("_e")).alias("difference"), F.hypot("sd", "_s").alias("sd"), ((F.col("estimate") - F.col("_e")) / factor).alias("pka_shift"))


def resolve_names(names: DataFrame, topology: DataFrame, key: str = "system") -> DataFrame:
    """Names (key, name) with the atom id of the one atom of that name; names with none or several are left out."""
    one = topology.groupBy(key, "name").agg(F.count("*").alias("_n"), F.min("atom_id").alias("atom_id")).where("_n = 1").drop("_n")
    return names.join(one, [key, "name"])


def _both_states(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x = a.select(*keys, F.col("q").alias("q0")).join(b.select(*keys, F.col("q").alias("q1")), keys, "full")
    return x.fillna(0.0, ["q0", "q1"]).where("q0 <> 0 or q1 <> 0")


def align_states(a: DataFrame, b: DataFrame, steps: int, keys: list[str]) -> DataFrame:
    """Charges q of two states on one order of atoms (absent: 0), atoms that are zero in both left out, with the linear path between them."""
    lam = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps))
    return _both_states(a, b, keys).withColumn("lambda", lam).withColumn("q", F.col("q0") + (F.col("q1") - F.col("q0")) * F.col("lambda"))


def state_totals(a: DataFrame, b: DataFrame, steps: int, keys: list[str], by: list[str]) -> DataFrame:
    """By, lambda, total: charges of align_states added up. The sums of all lambdas stand in one row of `by`, so atoms are not copied for each lambda."""
    sums = [F.sum(F.col("q0") + (F.col("q1") - F.col("q0")) * F.lit(i / steps)).alias(f"_s{i}") for i in range(steps + 1)]
    x = _both_states(a, b, keys).groupBy(*by).agg(*sums)
    return x.select(*by, F.inline(F.array(*[F.struct(F.lit(i / steps).alias("lambda"), F.col(f"_s{i}").alias("total")) for i in range(steps + 1)])))


def check_series(df: DataFrame, key: str = "run", t: str = "t", value: str = "value", rtol: float = 1e-7, least: int = 2, size: int | None = None) -> DataFrame:
    """Per key: samples, whether time increases, steps are uniform, values finite and samples enough."""
    by = "idx" if "idx" in df.columns else t
    x = with_windows(df, {"_dt": lambda k: F.col(t) - F.lag(t).over(Window.partitionBy(k).orderBy(by))}, 1, 0, key, by, size)
    uniform = F.max("_dt") - F.min("_dt") <= rtol * F.abs(F.max("_dt"))
    return x.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.min("_dt") > 0, F.lit(True)).alias("increasing"), F.coalesce(uniform, F.lit(True)).alias("uniform"), F.bool_and(F.coalesce(~F.isnan(value), F.lit(False))).alias("finite"), (F.count("*") >= least).alias("enough"))


def discard_and_cutoff(df: DataFrame, discard: float, cutoffs: DataFrame, key: str = "run", t: str = "t") -> DataFrame:
    """Rows from discard on and, for runs in cutoffs (key, keep_until), not beyond that time; excluded tells which rows go."""
    x = df.join(cutoffs.select(key, "keep_until"), key, "left")
    return x.withColumn("excluded", (F.col(t) < discard) | F.coalesce(F.col(t) > F.col("keep_until"), F.lit(False))).drop("keep_until")
