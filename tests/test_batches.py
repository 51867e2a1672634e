"""Bootstrap sums by batches, walkers by loops, totals of two states without copies of atoms."""

import math
import time

import numpy as np
import pytest
from framewise.operators import align, events, freeenergy as FE
from pyspark.sql import functions as F


def test_bootstrap_keeps_infinite_values_apart(spark):
    """A value that is infinite reaches the replicas that hold it and no others, also those that hold other rows of its piece."""
    v = [math.inf, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "run int, idx int, a double")
    start = lambda n: F.expr(f"(replica * 3 + block * 5) % {n}")
    got = {r["replica"]: r["sum_a"] for r in FE.block_bootstrap(df, ["a"], 8, 4, 1, ["run"], start=start).collect()}
    for rep in range(1, 9):
        assert got[rep] == sum(v[((rep * 3 + b * 5) % 8 + o) % 8] for b in range(2) for o in range(4))
    assert not any(math.isnan(x) for x in got.values())


def test_bootstrap_deals_its_starts(spark):
    """The starts of a few keys are dealt before they multiply, and are not broadcast."""
    df = spark.range(300).select((F.col("id") % 3).alias("run"), F.floor(F.col("id") / 3).alias("idx"), F.lit(1.0).alias("a"))
    plan = FE.block_bootstrap(df, ["a"], 5, 4, 1, ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "SortMergeJoin" in plan and "MapInArrow" in plan


def test_walkers_take_no_table_a_step(spark):
    """Many exchanges of one run in a time that a table a step does not allow."""
    n = 40_000
    rng = np.random.default_rng(1)
    x = [(0, int(s), int(low), bool(yes)) for s, low, yes in zip(range(n), rng.integers(0, 3, n), rng.random(n) < 0.5)]
    df = spark.createDataFrame(x, "run int, step int, low int, accepted boolean").repartition(4).cache()
    df.count()
    began = time.time()
    got = events.walker_positions(df).where(f"step = {n - 1}").collect()
    assert time.time() - began < 15
    at = list(range(4))
    for _, _, low, yes in x:
        if yes:
            at[low], at[low + 1] = at[low + 1], at[low]
    assert {r["place"]: r["walker"] for r in got} == dict(enumerate(at))


def test_state_totals(spark):
    """The same totals as those of the copied atoms, and a plan that copies none."""
    a = spark.createDataFrame([(0, 1, 0.5), (0, 2, -1.0), (1, 1, 0.0), (2, 1, 2.0)], "frame int, atom_id int, q double")
    b = spark.createDataFrame([(0, 2, 3.0), (0, 3, 0.25), (1, 1, 0.0), (3, 4, 1.0)], "frame int, atom_id int, q double")
    want = align.align_states(a, b, 4, ["frame", "atom_id"]).groupBy("frame", "lambda").agg(F.sum("q").alias("total"))
    got = align.state_totals(a, b, 4, ["frame", "atom_id"], ["frame"])
    key = lambda rows: sorted((r["frame"], r["lambda"], r["total"]) for r in rows)
    assert key(got.collect()) == [pytest.approx(w) for w in key(want.collect())] and {r["frame"] for r in got.collect()} == {0, 2, 3}
    x = got._jdf.queryExecution().optimizedPlan().toString()
    assert x.index("Generate") < x.index("Aggregate")  # rows of a frame are multiplied, not its atoms
