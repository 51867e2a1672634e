"""Window functions and event detection over series (run, t, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .runs import long_runs, settled, spans, with_windows


def _id(df: DataFrame, change: Column, key: str, t: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    return df.withColumn("_new", change.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, mask: Column, key: str = "run", t: str = "t", value: Column | None = None, gap: Column | float | None = None, dt: Column | float = 0.0, size: int | None = None) -> DataFrame:
    """Contiguous segments where mask holds: start, end, n, duration (last - first + dt). A segment also ends where value changes or time jumps by more than gap.

    Runs of more than `size` rows (LONG by default) are cut into blocks of time. Segments are found in each block; those
    that touch a block's edge (two a block at most) are then chained from block to block.
    """
    block = long_runs(df, key, size)
    at = [key, "_block"] if block else [key]
    x = df.withColumns({"_m": F.coalesce(mask, F.lit(False)), "_v": value if value is not None else F.lit(0)})
    if block:
        x = spans(x, key, t, size)
    w = Window.partitionBy(*at).orderBy(t)
    new = ~F.coalesce(F.lag("_m").over(w), F.lit(False)) | ~F.col("_v").eqNullSafe(F.lag("_v").over(w))
    if gap is not None:
        new = new | F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False))
    x = x.withColumns({"_new": (F.col("_m") & new).cast("int"), "_head": F.lag(t).over(w).isNull(), "_tail": F.lead(t).over(w).isNull()})
    blocks = x.select(*at).distinct() if block else None
    x = x.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_m")
    dt = F.lit(dt) if isinstance(dt, (int, float)) else F.max(dt)
    out = x.groupBy(*at, "island").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"), F.first("_v").alias("id"), dt.alias("_dt"), F.bool_or("_head").alias("_head"), F.bool_or("_tail").alias("_tail"))
    if block:
        nth = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.row_number().over(Window.partitionBy(key).orderBy("_block")).alias("_nth"))
        edge = out.where("_head or _tail").join(nth, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")
        o = Window.partitionBy(key).orderBy("_nth", "start")
        last = lambda c: F.lag(c).over(o)
        goes_on = F.col("_head") & last("_tail") & (last("_nth") == F.col("_nth") - 1) & last("id").eqNullSafe(F.col("id"))
        if gap is not None:
            goes_on = goes_on & (F.col("start") - last("end") <= gap)
        edge = edge.withColumn("_c", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("island", F.sum("_c").over(o.rowsBetween(Window.unboundedPreceding, 0)))
        whole = edge.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.first("id").alias("id"), F.max("_dt").alias("_dt"))
        cols = [key, "start", "end", "n", "id", "_dt"]
        out = whole.select(*cols).unionByName(out.where("not _head and not _tail").select(*cols))
    return out.select(key, "start", "end", "n", (F.col("end") - F.col("start") + F.col("_dt")).alias("duration"), *(["id"] if value is not None else []))


def first_sustained(df: DataFrame, mask: Column, persistence: float, key: str = "run", t: str = "t", after: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Per key the start of the first segment that lasts at least persistence; after (key, start): only rows later than start."""
    x = df if after is None else df.join(after.select(key, F.col("start").alias("_s")), key).where(F.col(t) > F.col("_s")).drop("_s")
    return islands(x, mask, key, t, size=size).where(F.col("end") - F.col("start") >= persistence).groupBy(key).agg(F.min("start").alias("start"))


def diffusive_regime(df: DataFrame, low: Column, back: Column, persistence: float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Start of the first sustained low state and of the first sustained recovery after it."""
    size = settled(df, key, size)
    a = first_sustained(df, low, persistence, key, t, size=size)
    b = first_sustained(df, back, persistence, key, t, after=a, size=size)
    return a.join(b.withColumnRenamed("start", "recovered"), key)


def persistent_ids(df: DataFrame, id: str, duration: float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """T4: ids that hold for at least duration without a break stay; others become null. Rows without an id have none to keep.

    A row's holding is the last one that started at or before it.
    """
    if not long_runs(df, key, size):
        w = Window.partitionBy(key).orderBy(t)
        x = _id(df, ~F.col(id).eqNullSafe(F.lag(id).over(w)), key, t)
        g = Window.partitionBy(key, "island")
        lasts = F.max(t).over(g) - F.min(t).over(g) >= duration
        return x.withColumn("persistent", F.when(lasts, F.col(id))).drop("island")
    held = islands(df, F.lit(True), key, t, value=F.col(id), size=size).select(key, F.col("start").alias(t), (F.col("end") - F.col("start") >= duration).alias("_lasts"))
    both = df.withColumn("_lasts", F.lit(None).cast("boolean")).withColumn("_real", F.lit(True)).unionByName(held.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    x = asof_flag(both, "_lasts", key, t, size)
    return x.where("_real").withColumn("persistent", F.when(F.col("_keep"), F.col(id))).drop("_lasts", "_keep", "_real")


def asof_flag(both: DataFrame, flag: str, key: str, t: str, size: int | None) -> DataFrame:
    """both with _keep: the last non-null flag at or before each time, of rows of the same time as well."""
    x = spans(both, key, t, size)
    w = Window.partitionBy(key, "_block").orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    ends = x.groupBy(key, "_block").agg(F.max_by(flag, F.when(F.col(flag).isNotNull(), F.col(t))).alias("_l"))
    o = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    ends = ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.last("_l", ignorenulls=True).over(o).alias("_c"))
    x = x.withColumn("_keep", F.last(flag, ignorenulls=True).over(w)).join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return x.withColumn("_keep", F.coalesce("_keep", "_c")).drop("_k", "_b", "_c", "_block")


def forward_fill(c: Column | str, key: str = "run", t: str = "t") -> Column:
    """T5: the last non-null value so far, as a window over whole runs; runs.filled cuts long ones."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))


def moving_average(c: Column | str, half: int, key: str = "run", t: str = "t", pad: str = "shrink") -> Column:
    """Centred mean over 2 * half + 1 rows. pad: "shrink" averages what is there, "edge" repeats the first and last value."""
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(key).orderBy(t)
    mean = F.avg(c).over(w.rowsBetween(-half, half))
    if pad == "shrink":
        return mean
    whole = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(Window.partitionBy(key)), F.row_number().over(w)
    left, right = F.greatest(F.lit(0), half + 1 - i), F.greatest(F.lit(0), i + half - n)
    return (F.sum(c).over(w.rowsBetween(-half, half)) + left * F.first(c).over(whole) + right * F.last(c).over(whole)) / (2 * half + 1)


def rolling_fraction(mask: Column, width: int, key: str = "run", t: str = "t") -> Column:
    """Share of true among the last width rows."""
    return F.avg(mask.cast("double")).over(Window.partitionBy(key).orderBy(t).rowsBetween(1 - width, 0))


def circular_running_average(deg: Column, half_us: int, key: str = "run", t_us: str = "t_us") -> Column:
    """Direction of the mean unit vector over a centred time window."""
    w = Window.partitionBy(key).orderBy(t_us).rangeBetween(-half_us, half_us)
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))).over(w), F.avg(F.cos(F.radians(deg))).over(w)))


def _with_last(df: DataFrame, columns: dict[str, str], key: str, t: str, size: int | None) -> DataFrame:
    """df with columns of the row before, by name."""
    return with_windows(df, {name: (lambda k, c=c: F.lag(c).over(Window.partitionBy(k).orderBy(t))) for name, c in columns.items()}, 1, 0, key, t, size)


def count_transitions(df: DataFrame, state: str, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Changes of state per key."""
    x = _with_last(df, {"_p": state}, key, t, size)
    return x.groupBy(key).agg(F.sum(F.coalesce(F.col("_p") != F.col(state), F.lit(False)).cast("int")).alias("n_transitions"))


def core_transitions(df: DataFrame, cores: Sequence[tuple[str, float, float]], value: str = "value", key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Transitions between cores (name, low, high); samples outside all cores keep the last core."""
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(cores):
        label = F.when(F.col(value).between(lo, hi), name).otherwise(label)
    x = _with_last(df.withColumn("core", label).where("core is not null"), {"from_core": "core"}, key, t, size)
    return x.where("from_core <> core").groupBy(key, "from_core", F.col("core").alias("to_core")).agg(F.count("*").alias("n"))


def bulk_audit(df: DataFrame, threshold: float, jump: float, value: str = "value", key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Per key: threshold reached, longest residence beyond it, outward crossings, and those whose step is at most jump."""
    size = settled(df, key, size)
    x = _with_last(df, {"_p": value}, key, t, size)
    out = (F.col("_p") < threshold) & (F.col(value) >= threshold)
    a = x.groupBy(key).agg((F.max(value) >= threshold).alias("reached"), F.count_if(out).alias("crossings"), F.count_if(out & (F.col(value) - F.col("_p") <= jump)).alias("continuous"))
    b = islands(df, F.col(value) >= threshold, key, t, size=size).groupBy(key).agg(F.max("duration").alias("longest"))
    return a.join(b, key, "left").withColumn("longest", F.coalesce("longest", F.lit(0.0)))


def truncate_at_departure(df: DataFrame, gone: Column, key: str = "run", t: str = "t") -> DataFrame:
    """Rows before the first one where gone holds."""
    cut = df.groupBy(key).agg(F.min(F.when(gone, F.col(t))).alias("_cut"))  # a row a run
    return df.join(cut, key).where(F.col("_cut").isNull() | (F.col(t) < F.col("_cut"))).drop("_cut")


def stitch_windows(df: DataFrame, per_window: int, idx: str = "idx", dt: float = 1.0) -> DataFrame:
    """Global sample number to (window, local frame, local time)."""
    return df.withColumns({"window": F.floor(F.col(idx) / per_window).cast("int"), "local": (F.col(idx) % per_window).cast("int")}).withColumn("local_t", F.col("local") * dt)


def pull_ladder(windows: DataFrame, key: str = "run") -> DataFrame:
    """Corner points of the target staircase: each window's target at its start and at the next one's start."""
    w = Window.partitionBy(key).orderBy("window")
    x = windows.withColumn("_next", F.lead("start").over(w))
    return x.select(key, "window", F.explode(F.array(F.struct(F.lit(0).alias("corner"), F.col("start").alias("t")), F.struct(F.lit(1).alias("corner"), F.coalesce("_next", "end").alias("t")))).alias("p"), "target").select(key, "window", "p.corner", "p.t", "target")


def peaks(df: DataFrame, fraction: float, value: str = "value", key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Strict local maxima above a fraction of the key's maximum."""
    beside = lambda f: lambda k: f(value).over(Window.partitionBy(k).orderBy(t))
    top = df.groupBy(key).agg(F.max(value).alias("_m"))  # a row a run
    x = with_windows(df, {"_l": beside(F.lag), "_r": beside(F.lead)}, 1, 1, key, t, size)
    x = x.where((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r"))).join(top, key)
    return x.where(F.col(value) > fraction * F.col("_m")).drop("_l", "_r", "_m")


def funnel_classify(runs: DataFrame, screens: Sequence[tuple[str, DataFrame]], key: str = "run") -> DataFrame:
    """The first screen that rejects each run (screens hold the rejected keys), or accepted."""
    x, stage = runs.select(key).distinct(), F.lit("accepted")
    for name, rejected in screens:
        x = x.join(rejected.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    for name, _ in reversed(screens):
        stage = F.when(F.col(f"_{name}"), name).otherwise(stage)
    return x.select(key, stage.alias("stage"))


def hop_events(df: DataFrame, id: str, limit: float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Changes of owner between consecutive holdings whose pause is at most limit: donor, acceptor, times, pause."""
    size = settled(df, key, size)
    x = islands(df, F.col(id).isNotNull(), key, t, value=F.col(id), size=size)
    after = lambda c: lambda k: F.lead(c).over(Window.partitionBy(k).orderBy("start"))
    x = with_windows(x, {"acceptor": after("id"), "t_on": after("start")}, 0, 1, key, "start", size)
    return x.where((F.col("acceptor") != F.col("id")) & (F.col("t_on") - F.col("end") <= limit)).select(key, F.col("id").alias("donor"), "acceptor", F.col("end").alias("t_off"), "t_on", (F.col("t_on") - F.col("end")).alias("pause"))


def longest_event(df: DataFrame, mask: Column, id: str, least: float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """Per key the longest holding of one acceptor id under mask that lasts at least `least`, the earliest of equal ones."""
    x = islands(df, mask, key, t, value=F.col(id), size=size).where(F.col("duration") >= least)
    return x.groupBy(key).agg(F.max_by(F.struct("id", "start", "end", "duration"), F.struct("duration", -F.col("start"))).alias("e")).select(key, "e.*")


def event_shift(events: DataFrame, samples: DataFrame, pre: float, post: float, key: str = "run", t: str = "t", value: str = "value") -> DataFrame:
    """Median after minus median before each event; null where either side is empty."""
    e = events.select(F.col(key).alias("_k"), F.col("start").alias("_s"))
    x = e.join(samples, (e["_k"] == samples[key]) & (samples[t] >= e["_s"] - pre) & (samples[t] <= e["_s"] + post), "left")
    late, early = F.col(t) > F.col("_s"), F.col(t) < F.col("_s")
    return x.groupBy(F.col("_k").alias(key), F.col("_s").alias("start")).agg((F.median(F.when(late, F.col(value))) - F.median(F.when(early, F.col(value)))).alias("shift"))


def round_trips(positions: DataFrame, low: int, high: int, walker: str = "walker", step: str = "step", place: str = "place") -> DataFrame:
    """Completed trips end - other end - end per walker, not overlapping, and their mean length in steps."""
    w = Window.partitionBy(walker).orderBy(step)
    x = positions.where(F.col(place).isin(low, high)).withColumn("_p", F.lag(place).over(w)).where("_p is null or _p <> " + place)
    x = x.withColumn("_n", F.row_number().over(w) - 1)
    x = x.withColumn("_back", F.lag(step, 2).over(w)).where("_n >= 2 and _n % 2 = 0")
    return x.groupBy(walker).agg(F.count("*").alias("n_trips"), F.avg(F.col(step) - F.col("_back")).alias("mean_steps"))


def walker_positions(exchanges: DataFrame, run: str = "run", step: str = "step", block: int = 1000) -> DataFrame:
    """Place of each walker after every exchange. exchanges: (run, step, low, accepted), neighbours low and low + 1 swap.

    Swaps don't commute, but they compose: a run's log is cut into blocks of `block` step numbers, each block's swaps are
    composed to one permutation, the permutations of a run (one row a block) are composed in order, and each block is
    then told out from the places it starts with. No task holds more than one block's rows, or one run's table of blocks.
    """
    import numpy as np
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in exchanges.schema}
    x = exchanges.where(F.col(step).isNotNull()).select(run, step, F.col("low").cast("int").alias("low"), "accepted", F.floor(F.col(step) / block).alias("_block"))
    size = x.groupBy(run).agg((F.max("low") + 2).alias("_n"))
    x = x.join(size, run)

    def told(rows: pd.DataFrame) -> tuple:
        """Steps of the rows in order, their lows, and whether they swap."""
        rows = rows.sort_values([step, "low"])
        return rows[step].to_numpy(), rows["low"].tolist(), (rows["accepted"] == True).tolist()  # noqa: E712

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = list(range(int(pdf["_n"].iloc[0])))
        _, lows, swaps = told(pdf)
        for low, yes in zip(lows, swaps):
            if yes:
                at[low], at[low + 1] = at[low + 1], at[low]
        return pd.DataFrame({run: [key[0]], "_block": [key[1]], "_moves": [at]})

    def chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        at, out = list(range(len(pdf["_moves"].iloc[0]))), []
        for moves in pdf["_moves"]:
            out.append(at)
            at = [at[i] for i in moves]
        return pd.DataFrame({run: key[0], "_block": pdf["_block"].to_numpy(), "_start": out})

    def tell(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=[run, step, "walker", "place"])
        at, out = list(start["_start"].iloc[0]), []
        steps, lows, swaps = told(rows)
        ends = np.append(steps[1:] != steps[:-1], True)
        for low, yes, end in zip(lows, swaps, ends.tolist()):
            if yes:
                at[low], at[low + 1] = at[low + 1], at[low]
            if end:
                out += at
        n = len(out) // len(at)
        return pd.DataFrame({run: key[0], step: np.repeat(steps[ends], len(at)), "walker": np.array(out, np.int32), "place": np.tile(np.arange(len(at), dtype=np.int32), n)})

    moves = x.groupBy(run, "_block").applyInPandas(compose, f"{run} {kind[run]}, _block bigint, _moves array<int>")
    starts = moves.groupBy(run).applyInPandas(chain, f"{run} {kind[run]}, _block bigint, _start array<int>")
    both = x.groupBy(run, "_block").cogroup(starts.groupBy(run, "_block"))
    return both.applyInPandas(tell, f"{run} {kind[run]}, {step} {kind[step]}, walker int, place int")


def gaussian_smooth(c: Column | str, sigma: float, key: str = "run", t: str = "t", truncate: float = 4.0) -> Column:
    """Gaussian kernel of sigma rows over truncate * sigma rows on either side; the ends repeat the first and last value."""
    import math

    c = F.col(c) if isinstance(c, str) else c
    half = int(truncate * sigma + 0.5)
    w = Window.partitionBy(key).orderBy(t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(half + 1)]
    total = weight[0] + 2 * sum(weight[1:])
    out = c * (weight[0] / total)
    for k in range(1, half + 1):
        out = out + (F.coalesce(F.lag(c, k).over(w), F.first(c).over(whole)) + F.coalesce(F.lead(c, k).over(w), F.last(c).over(whole))) * (weight[k] / total)
    return out
