"""Streams fed in chunks give what a batch over the same rows gives."""

import pytest
from framewise.streaming import live
from pyspark.sql import functions as F

SCHEMA = "run int, step int, ts timestamp, value double"


@pytest.fixture()
def chunks(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id % 2 as int) as run", "cast(id div 2 as int) as step", "timestamp_seconds(1700000000 + id * 30) as ts", "cast(id % 7 as double) as value")
    for k in range(4):  # chunks overlap: a record may land twice
        rows.where(f"step between {k * 5 - 1} and {k * 5 + 4}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, f"{tmp_path}/in"


def stream(spark, path):
    return live.stream_records(spark, path, SCHEMA, "1 day", per_trigger=1)


def run(x, mode, name, tmp_path):
    return live.run_once(x, mode, f"{tmp_path}/out_{name}", f"{tmp_path}/ck_{name}")


def test_records_and_windows(spark, chunks, tmp_path):
    rows, path = chunks
    got = run(stream(spark, path), "append", "records", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    x = live.stream_populations(stream(spark, path), "run", "value", [0.0, 3.0])
    with pytest.raises(Exception):
        run(x.select("nope"), "complete", "bad", tmp_path)
    w = live.stream_window_stats(spark.readStream.schema(SCHEMA).parquet(path).dropDuplicates(["run", "step"]), "run", "value", "5 minutes")
    got = run(w, "complete", "windows", tmp_path).collect()
    want = rows.groupBy("run", F.window("ts", "5 minutes").start.alias("start")).agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()
    assert sorted((r["run"], r["start"], r["n"], r["mean"]) for r in got) == sorted(map(tuple, want))
    missing = live.missing_windows(spark.range(4).selectExpr("cast(id as int) as run"), rows, "run")
    assert sorted(r["run"] for r in missing.collect()) == [2, 3]


def landed(spark, tmp_path, rows, batches, name):
    """rows (run, k, low, back) in the given batches of indices, a file each, in order; a last row ends the stream."""
    import os
    import time

    frame = lambda r: spark.createDataFrame(r, "run int, k int, low boolean, back boolean").select("run", F.timestamp_seconds(F.lit(1700000000) + F.col("k")).alias("ts"), "low", "back")
    at = f"{tmp_path}/{name}"
    for n, part in enumerate([*[[rows[i] for i in b] for b in batches], [(-1, 10**6, False, False), (None, 10**6, True, True)]]):
        frame(part).coalesce(1).write.mode("append").parquet(at)
        for f in os.listdir(at):  # files are read in the order of their times
            if f.endswith(".parquet") and os.path.getmtime(f"{at}/{f}") > 10**9:
                os.utime(f"{at}/{f}", (10**6 + n, 10**6 + n))
        time.sleep(0.01)
    return spark.readStream.schema(frame([(0, 0, True, True)]).schema).option("maxFilesPerTrigger", 1).parquet(at)


def brute_sustained(rows, persistence):
    out = []
    for run in {r[0] for r in rows}:
        start, told = None, False
        for _, k, yes, _ in sorted(r for r in rows if r[0] == run):
            start, told = (None, False) if not yes else (k if start is None else start, told)
            if start is not None and not told and k - start >= persistence:
                out.append((run, start, k))
                told = True
    return sorted(out)


def brute_regimes(rows, low_s, back_s):
    def first(samples, held):
        start = None
        for k, yes in samples:
            start = (k if start is None else start) if yes else None
            if start is not None and k - start >= held:
                return start
        return None

    out = []
    for run in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == run)
        start = first([(k, low) for k, low, _ in mine], low_s)
        if start is not None and (end := first([(k, back) for k, _, back in mine if k > start], back_s)) is not None:
            out.append((run, start, end))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_do_not_matter(spark, tmp_path, seed):
    """Rows in random batches, out of order within the watermark, give what the sorted whole gives."""
    import random

    rng = random.Random(seed)
    rows = [(run, 10 * k, rng.random() < 0.8, rng.random() < 0.7) for run in range(6) for k in range(30)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, 100))  # up to 100 s late
    cuts = sorted(rng.sample(range(1, len(order)), 3))
    batches = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]
    x = landed(spark, tmp_path, rows, batches, "in")
    second = lambda v: round(v - 1.7e9)
    got = run(live.stream_sustained_events(x, "run", "low", 30.0, "200 seconds"), "append", "s", tmp_path).collect()
    assert sorted((r["run"], second(r["start"]), second(r["seen"])) for r in got) == brute_sustained(rows, 30)
    got = run(live.stream_regimes(x, "run", "low", "back", 40.0, 30.0, "200 seconds"), "append", "r", tmp_path).collect()
    want = brute_regimes(rows, 40, 30)
    assert want and sorted((r["run"], second(r["start"]), second(r["recovered"])) for r in got) == want


def test_late_off_and_split_recovery(spark, tmp_path):
    """A row that comes a batch later undoes a holding; samples of an earlier batch count for the recovery."""
    late = [(0, 0, True, True), (0, 30, True, True), (0, 10, False, False), (0, 500, False, False)]
    x = landed(spark, tmp_path, late, [[0, 1], [2], [3]], "a")
    assert run(live.stream_sustained_events(x, "run", "low", 20.0, "5 minutes"), "append", "a", tmp_path).count() == 0
    both = [(0, 1000 * k, True, True) for k in range(5)]
    x = landed(spark, tmp_path, both, [[0, 1], [2, 3, 4]], "b")
    got = run(live.stream_regimes(x, "run", "low", "back", 3000.0, 2000.0, "1 second"), "append", "b", tmp_path).collect()
    assert [(r["start"] - 1.7e9, r["recovered"] - 1.7e9) for r in got] == [(0.0, 1000.0)]


def test_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(0, t) for t in (0, 10, 20, 100, 110)], "run int, t int").select("run", F.timestamp_seconds(F.lit(1700000000) + F.col("t")).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    x = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = run(live.stream_sessions(x, "run", "30 seconds"), "complete", "sessions", tmp_path).collect()
    assert sorted(r["n"] for r in got) == [2, 3]
