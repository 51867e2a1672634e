"""Series operators over long runs cut into blocks give what they give over whole runs."""

import random

import pytest
from framewise.operators import align, events, runs
from pyspark.sql import Window, functions as F


@pytest.fixture(scope="module")
def series(spark):
    """One long run, a middling and a short one, with nulls, uneven times and a gap without samples."""
    rng = random.Random(8)
    rows = []
    for run, n in ((0, 400), (1, 45), (2, 3), (None, 30)):
        t, value, state = 0.0, 0.0, "a"
        for idx in range(n):
            t += rng.choice([1.0, 1.0, 1.0, 0.25, 3.0]) + (500.0 if run == 0 and idx == 200 else 0.0)
            value += rng.uniform(-1, 1)
            state = rng.choice("abc") if rng.random() < 0.2 else state
            rows.append((run, idx, t, value, state, None if rng.random() < 0.7 else value))
    return spark.createDataFrame(rows, "run int, idx int, t double, value double, state string, seldom double").repartition(5).cache()


def plain(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


LONG = 10**9


@pytest.mark.parametrize("size", [7, 60])
def test_blocks_change_nothing(series, size):
    s = series
    up = F.col("value") > 0
    cases = {
        "islands": lambda n: events.islands(s, up, value=F.col("state"), gap=2.5, dt=1.0, size=n),
        "sustained": lambda n: events.first_sustained(s, up, 8.0, size=n),
        "regime": lambda n: events.diffusive_regime(s.where("run is not null"), F.col("value") < 0, up, 4.0, size=n),
        "persistent": lambda n: events.persistent_ids(s, "state", 4.0, size=n),
        "transitions": lambda n: events.count_transitions(s, "state", size=n),
        "cores": lambda n: events.core_transitions(s, [("low", -99, -0.5), ("high", 0.5, 99)], size=n),
        "audit": lambda n: events.bulk_audit(s.where("run is not null"), 0.5, 0.4, size=n),
        "peaks": lambda n: events.peaks(s, 0.1, size=n),
        "hops": lambda n: events.hop_events(s, "state", 2.0, size=n),
        "longest": lambda n: events.longest_event(s, up, "state", 2.0, size=n),
        "checks": lambda n: align.check_series(s, size=n),
        "filled": lambda n: runs.filled(s, {"f": F.col("seldom"), "g": F.when(up, F.col("t"))}, size=n),
        "stations": lambda n: align.station_times(s.where("run is not null"), 7.0, size=n),
    }
    for name, f in cases.items():
        assert plain(f(size)) == plain(f(LONG)), name


@pytest.mark.parametrize("size", [11, 90])
def test_filters(series, size):
    made = {
        "shrink": lambda k: events.moving_average("value", 5, key=k), "edge": lambda k: events.moving_average("value", 5, key=k, pad="edge"),
        "gauss": lambda k: events.gaussian_smooth("value", 1.2, key=k), "share": lambda k: events.rolling_fraction(F.col("value") > 0, 6, key=k),
    }
    assert plain(runs.with_windows(series, made, 5, 5, size=size)) == plain(runs.with_windows(series, made, 5, 5, size=LONG))
    micros = series.withColumn("t_us", (F.col("t") * 1e6).cast("bigint"))
    turn = {"turn": lambda k: events.circular_running_average(F.col("value") * 40, 4_000_000, key=k)}
    assert plain(runs.time_halo(micros, turn, 4_000_000, t="t_us", size=size)) == plain(runs.time_halo(micros, turn, 4_000_000, t="t_us", size=LONG))


def test_ranks(series):
    got = runs.ranked(series, "run", ["t"])
    assert plain(got.select("run", "idx", "t", F.col("_rank"))) == plain(series.select("run", "idx", "t", F.col("idx").cast("bigint").alias("_rank")))


def test_one_run_spreads(spark):
    """A run of all rows: no task of the window stage holds more than three times the median block."""
    df = spark.range(60_000).select(F.lit(1).alias("run"), F.col("id").cast("double").alias("t"), (F.col("id") % 97).cast("double").alias("value"))
    sizes = [r["n"] for r in runs.spans(df, "run", "t", 1000).groupBy("_block").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 60 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    seen = []
    runs.halo(df, "run", "t", 2, 2, lambda x, k: seen.append(x) or x, 1000)
    sizes = [r["n"] for r in seen[0].groupBy("_run").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) in (60, 61) and max(sizes) <= 1004
    w = Window.partitionBy("run").orderBy("t")
    assert plain(runs.with_windows(df, {"p": lambda k: F.lag("value", 2).over(Window.partitionBy(k).orderBy("t"))}, 2, 0, size=1000)) == plain(df.withColumn("p", F.lag("value", 2).over(w)))
