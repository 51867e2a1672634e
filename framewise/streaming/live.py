"""Live reports of output that is still being written, as Structured Streaming. Input streams have an event time column ts (timestamp)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def stream_records(spark: SparkSession, path: str, schema, late: str = "10 minutes", keys: tuple[str, ...] = ("run", "step"), per_trigger: int = 100) -> DataFrame:
    """L1: complete records from landed chunk files; a record that two chunks hold counts once."""
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return x.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def stream_window_stats(x: DataFrame, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """L2: running count, mean and extremes by key and time window (tumbling, or sliding)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return x.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "low", "high")


def missing_windows(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """L2: expected windows without data, for use inside foreachBatch."""
    return expected.join(seen.select(key).distinct(), key, "left_anti")


def stream_populations(x: DataFrame, key: str, state: str, states: list) -> DataFrame:
    """L3: live share of each state by key."""
    return x.groupBy(key).agg(F.count("*").alias("n"), *[(F.count_if(F.col(state) == s) / F.count("*")).alias(f"p_{s}") for s in states])


def stream_sessions(x: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """L4: intervals that close once no sample came for the gap."""
    s = x.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stream_calibration(x: DataFrame, key: str, value: str, index: str, skip: int) -> DataFrame:
    """Running mean of completed evaluations after the first skip."""
    return x.where(F.col(index) >= skip).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def count_late(x: DataFrame, late: str, limit: Column) -> DataFrame:
    """Rows under a watermark, with a metric `late` of those older than limit, counted before the watermark drops them."""
    return x.observe("lateness", F.count_if(F.col("ts") < limit).alias("late"), F.count("*").alias("rows")).withWatermark("ts", late)


def _in_time_order(x: DataFrame, key: str, flags: list[str], fold: Callable, state: str, out: str, late: str) -> DataFrame:
    """Rows of a key handed to fold(state, [(seconds, *flags), ...]) -> (state, results) in the order of event time, whatever batches they came in.

    Rows wait in list state until the watermark has passed them, when a timer at the earliest of them has them folded in
    order (rows of one time by their flags); what comes later is later in time, as Spark drops rows behind the watermark.
    A key's memory is what arrives within the watermark's delay or in one batch. The last `late` of a stream is folded
    once a later row, of any key, moves the watermark. Rows without a key are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names = [part.split()[0] for part in f"{key} -, {out}".split(", ")]
    rows_ddl = ", ".join(["t bigint", *(f"f{i} boolean" for i in range(len(flags)))])

    class Ordered(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.rows = handle.getListState("rows", rows_ddl)
            self.state = handle.getValueState("state", state)

        def wake(self, rows: list[tuple]) -> None:
            self.handle.registerTimer(-(-min(rows)[0] // 1000))

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new = [(int(t.value // 1000), *map(bool, f)) for pdf in rows for t, *f in zip(pdf["ts"], *(pdf[c] for c in flags))]
            self.rows.appendList(new)
            self.wake(new)
            yield pd.DataFrame([], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = 1000 * timerValues.getCurrentWatermarkInMs()
            held = sorted(tuple(r) for r in self.rows.get()) if self.rows.exists() else []
            ready = [r for r in held if r[0] <= passed]
            found = []
            if ready:
                now, found = fold(self.state.get() if self.state.exists() else None, [(r[0] / 1e6, *r[1:]) for r in ready])
                if now is None:
                    self.state.clear()
                else:
                    self.state.update(now)
                if rest := held[len(ready) :]:
                    self.rows.put(rest)
                    self.wake(rest)
                else:
                    self.rows.clear()
            yield pd.DataFrame([(key[0], *f) for f in found], columns=names)

        def close(self) -> None:
            pass

    kind = x.schema[key].dataType.simpleString()
    return x.select(key, "ts", *flags).where(F.col(key).isNotNull()).withWatermark("ts", late).groupBy(key).transformWithStateInPandas(Ordered(), f"{key} {kind}, {out}", "append", "eventTime")


def stream_sustained_events(x: DataFrame, key: str, on: str, persistence_s: float, late: str = "10 minutes") -> DataFrame:
    """(key, start, seen): a condition that has held from start for the persistence, told once for each holding, once the watermark has passed it.

    State of a key: the start of the holding and whether it was told.
    """

    def fold(state, rows):
        start, told = state or (None, False)
        found = []
        for t, yes in rows:
            if not yes:
                start, told = None, False
                continue
            start = t if start is None else start
            if not told and t - start >= persistence_s:
                told = True
                found.append((start, t))
        return (None if start is None else (start, told)), found

    return _in_time_order(x, key, [on], fold, "start double, told boolean", "start double, seen double", late)


def stream_regimes(x: DataFrame, key: str, low: str, back: str, low_s: float, back_s: float, late: str = "10 minutes") -> DataFrame:
    """(key, start, recovered): the first state `low` that held for low_s seconds, and the first state `back` after its start that held for back_s; told once a key, once the watermark has passed both.

    State of a key: its stage, the start of `low`, the start of the `back` under way after it, and the first that held
    before `low` was known to hold.
    """

    def fold(state, rows):
        stage, start, since, first = state or (0, None, None, None)
        found = []
        for t, is_low, is_back in rows:
            if stage == 2:
                break
            if stage == 0:
                if not is_low:
                    start, since, first = None, None, None
                    continue
                start = t if start is None else start
            if t > start:
                since = (t if since is None else since) if is_back else None
                if first is None and since is not None and t - since >= back_s:
                    first = since
            if stage == 0 and t - start >= low_s:
                stage = 1
            if stage == 1 and first is not None:
                found.append((start, first))
                stage = 2
        return (None if stage == 0 and start is None else (stage, start, since, first)), found

    return _in_time_order(x, key, [low, back], fold, "stage int, start double, since double, first double", "start double, recovered double", late)


def run_once(x: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what has landed and give its result, for reports and tests.

    Every micro-batch is written to a folder of its own under path, in a shared store; a batch that is run again replaces
    its folder, so each row counts once. Of a complete result the last batch is the table, of an appended one all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = x.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = x.sparkSession
    done = q.lastProgress["batchId"] if q.lastProgress else None
    if done is None:
        return spark.createDataFrame([], x.schema)
    out = spark.read.schema(x.schema).option("basePath", path)
    if mode == "complete":
        batches = spark.read.option("basePath", path).parquet(f"{path}/batch=*").agg(F.max("batch")).first()[0]
        return out.parquet(f"{path}/batch={done if batches is None else batches}").select(*x.columns)
    return out.parquet(f"{path}/batch=*").select(*x.columns)
