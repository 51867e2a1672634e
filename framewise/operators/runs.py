"""Runs longer than a task should hold, cut into blocks.

Series operators are windows over a run in time order. Up to LONG rows a run that is what they stay: one shuffle on the run.
A run with more rows is cut, in one of two ways; which runs are, is found by a count, without a sort.

spans: blocks of equal time, as many as a run's rows need, so that rows of one time stay together. For operators that hand
something on from block to block (islands, as-of joins, fills) through a table of a row a block.
halo: blocks of equal numbers of rows, by rank, with the rows before and after that an operator looks at; the operator runs
on blocks as it does on runs, and what belongs to the neighbours is dropped. For lags and filters of a stated width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialise

#: Rows of a run that one task takes.
LONG = 1_000_000
PLACE = (1 << 33) - 1


#: A size that no run exceeds: nothing is counted.
WHOLE = 1 << 62


def long_runs(df: DataFrame, key: str, size: int | None = None) -> bool:
    """Whether a run has more rows than size."""
    if size is not None and size >= WHOLE:
        return False
    most = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > (size or LONG)


def settled(df: DataFrame, key: str, size: int | None = None) -> int:
    """size where a run is longer, else WHOLE, for operators that look at a table, or parts of it, several times."""
    return (size or LONG) if long_runs(df, key, size) else WHOLE


def spans(df: DataFrame, key: str, t: str, size: int | None = None) -> DataFrame:
    """df with _block: its place in equal cuts of the run's time range, one cut for every `size` rows; 0 in shorter runs."""
    size = size or LONG
    n = df.groupBy(key).agg(F.count("*").alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1")).where(F.col("_n") > size)
    n = n.select(F.col(key).alias("_k"), "_t0", ((F.col("_t1") - F.col("_t0")) / F.ceil(F.col("_n") / size)).alias("_w"))
    x = df.join(n, F.col(key).eqNullSafe(F.col("_k")), "left")  # a row for each long run; the optimizer broadcasts it
    return x.withColumn("_block", F.coalesce(F.floor((F.col(t) - F.col("_t0")) / F.nullif(F.col("_w"), F.lit(0.0))), F.lit(0))).drop("_k", "_t0", "_w")


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with _rank, a row's place in its run from 0: from a range partitioning on (key, order), the place in a task's sorted rows and the counts of earlier tasks, so no task holds a run."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # task and place in it
    x = materialise(dealt.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit(PLACE))}))
    parts = x.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that holds some of the run
    parts = parts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    x = x.join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return x.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_k", "_p", "_part", "_at", "_shift")


def halo(df: DataFrame, key: str, t: str, before: int, after: int, fn: Callable[[DataFrame, str], DataFrame], size: int | None = None) -> DataFrame:
    """fn(df, key), where fn adds to or filters the rows of each key by what stands at most `before` rows before and `after` rows behind in the order of t. Long runs are handed to it as blocks with these rows beside them."""
    if not long_runs(df, key, size):
        return fn(df, key)
    size = max(size or LONG, before, after, 1)  # so that a neighbour's rows reach one block only
    x = ranked(df, key, [t]).withColumns({"_block": F.floor(F.col("_rank") / size), "_place": F.col("_rank") % size})
    last = F.when(F.col("_place") >= size - before, F.col("_block") + 1)
    first = F.when((F.col("_place") < after) & (F.col("_block") > 0), F.col("_block") - 1)
    x = x.withColumn("_to", F.explode(F.array_compact(F.array("_block", first, last))))
    x = x.withColumns({"_own": F.col("_to") == F.col("_block"), "_run": F.struct(F.col(key), F.col("_to"))}).drop("_rank", "_block", "_place", "_to")
    return fn(x, "_run").where("_own").drop("_own", "_run")


def with_windows(df: DataFrame, columns: dict[str, Callable[[str], Column]], before: int, after: int, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """df with columns that window functions of a key give, each looking at most `before` rows back and `after` rows on."""
    return halo(df, key, t, before, after, lambda x, k: x.withColumns({name: f(k) for name, f in columns.items()}), size)


def time_halo(df: DataFrame, columns: dict[str, Callable[[str], Column]], reach: float, key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """As with_windows for windows that reach `reach` in t on either side: blocks of equal time, never narrower than the reach."""
    size = size or LONG
    if not long_runs(df, key, size):
        return df.withColumns({name: f(key) for name, f in columns.items()})
    n = df.groupBy(key).agg(F.count("*").alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    n = n.select(F.col(key).alias("_k"), "_t0", F.greatest(F.lit(reach), (F.col("_t1") - F.col("_t0")) / F.ceil(F.col("_n") / size)).cast("double").alias("_w"))
    x = df.join(n, F.col(key).eqNullSafe(F.col("_k")))
    at = lambda shift: F.floor((F.col(t) - F.col("_t0") + shift) / F.nullif(F.col("_w"), F.lit(0.0)))
    x = x.withColumn("_block", F.coalesce(at(0), F.lit(0))).withColumn("_to", F.explode(F.sequence(F.coalesce(at(-reach), F.lit(0)), F.coalesce(at(reach), F.lit(0)))))
    x = x.withColumns({"_own": F.col("_to") == F.col("_block"), "_run": F.struct(F.col(key), F.col("_to"))}).drop("_k", "_t0", "_w", "_block", "_to")
    return x.withColumns({name: f("_run") for name, f in columns.items()}).where("_own").drop("_own", "_run")


def filled(df: DataFrame, columns: dict[str, Column], key: str = "run", t: str = "t", size: int | None = None) -> DataFrame:
    """T5: df with columns that hold the last non-null value so far of an expression. Long runs: inside blocks, then from the last block before that has one."""
    w = lambda *by: Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    if not long_runs(df, key, size):
        return df.withColumns({name: F.last(c, ignorenulls=True).over(w(key)) for name, c in columns.items()})
    x = spans(df.withColumns({f"_v_{name}": c for name, c in columns.items()}), key, t, size)
    at = lambda name: F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(t)))
    ends = x.groupBy(key, "_block").agg(*[at(name).alias(f"_l_{name}") for name in columns])
    o = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    ends = ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), *[F.last(f"_l_{name}", ignorenulls=True).over(o).alias(f"_c_{name}") for name in columns])
    x = x.withColumns({name: F.last(f"_v_{name}", ignorenulls=True).over(w(key, "_block")) for name in columns})
    x = x.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return x.withColumns({name: F.coalesce(name, f"_c_{name}") for name in columns}).drop("_k", "_b", "_block", *[f"_{p}_{name}" for p in "vc" for name in columns])
