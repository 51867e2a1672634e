"""Queries that write the tables in a simulation's text formats and read them back, and streaming reports over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import shared_dir
from ..sources import scans
from ..sources.tables import atoms, energies, series
from ..streaming import live
from .registry import query


def landed(df: DataFrame, by: str = "run", order: str = "t") -> scans.Packed:
    """Write rows (by, order, value) as text files, one a key, in order; packed, since a table has many keys of a few rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/scans/{uuid.uuid4().hex}"
    return scans.pack(df, F.concat(F.lit(f"/{by}="), F.col(by).cast("string"), F.lit("/part")), order, path)


@query("s1_scan_xyz", "SELECT run, frame * 0.5 AS t_ps, frame AS step, atom_id, element, x, y, z FROM atoms", "t_ps x y z", "atoms")
def _(spark, d):
    # a file holds frames of one size, as a trajectory does; its run number tells both
    rows = F.transform(F.array_sort(F.collect_list(F.struct("atom_id", "element", "x", "y", "z"))), lambda r: F.concat_ws(" ", r["element"], *[r[c].cast("string") for c in "xyz"]))
    f = atoms(spark, d).groupBy("run", F.col("frame").alias("t")).agg(rows.alias("rows"))
    text = F.concat(F.size("rows").cast("string"), F.lit("\n*** AT T= "), (F.col("t") * 500).cast("string"), F.lit(" FSEC, RUN STEP NO.= "), F.col("t").cast("string"), F.lit("\n"), F.array_join("rows", "\n"))
    x = scans.scan_xyz(spark, landed(f.select((F.col("run") * 1000 + F.size("rows")).alias("run"), "t", text.alias("value"))))
    return x.select(F.floor(F.col("run") / 1000).alias("run"), "t_ps", "step", "atom_id", "element", "x", "y", "z")


def bias_log(spark: SparkSession, d: str) -> str:
    s = series(spark, d)
    text = F.concat(F.lit("GAUSSIAN BIAS POTENTIAL: "), (F.col("idx") + 1).cast("string"), F.lit("\n*** AT T= "), (F.col("idx") * 40).cast("string"), F.lit(" FSEC, RUN STEP NO.= "), F.col("idx").cast("string"), F.lit("\nGaussian height = 0.0005\nCoordinate = "), F.regexp_replace(F.col("value").cast("string"), "E", "D"), F.lit("\nGaussian width = 0.1\n"))
    return landed(s.select("run", F.col("idx").alias("t"), text.alias("value")))


@query("s3_scan_hills", "SELECT run, idx + 1 AS hill_no, idx * 0.04 AS t_ps, value AS center, 0.0005 * 627.509474 AS height_kcal, 0.1 AS width FROM series", "t_ps center height_kcal width", "series")
def _(spark, d):
    x = scans.scan_hills(spark, bias_log(spark, d))
    return x.select(F.col("run").cast("bigint").alias("run"), "hill_no", "t_ps", "center", "height_kcal", "width")


@query("s4_scan_cv", "SELECT run, idx AS step, idx * 0.04 AS t_ps, value FROM series", "t_ps value", "series")
def _(spark, d):
    x = scans.scan_cv(spark, bias_log(spark, d))
    return x.select(F.col("run").cast("bigint").alias("run"), "step", "t_ps", "value")


@query("s5_scan_fes", "SELECT sample AS run, frame AS n_gauss, k / 10.0 AS x, u[k + 1] * 627.509474 AS f_kcal FROM energies, range(0, 10) r(k)", "x f_kcal", "energies")
def _(spark, d):
    u = energies(spark, d)
    rows = F.array_join(F.transform("u", lambda e, i: F.concat_ws(" ", (i / 10).cast("string"), e.cast("string"))), "\n")
    text = u.select(F.col("sample").alias("run"), F.col("frame").alias("t"), F.concat(F.lit("### FREE ENERGY SURFACE CONSISTING OF "), F.col("frame").cast("string"), F.lit(" GAUSSIANS\n"), rows).alias("value"))
    return scans.scan_fes(spark, landed(text)).drop("path")


@query("s6_scan_charges", "SELECT run, frame * 0.001 AS t_ps, CAST(atom_id AS INTEGER) AS atom_id, element, orbital, CASE orbital WHEN 's' THEN x / 100 ELSE -z / 100 END AS q FROM atoms a, (VALUES ('s'), ('p')) o(orbital) WHERE element <> 'H' OR orbital = 's'", "t_ps q", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    line = lambda orb, v: F.concat_ws(" ", F.col("atom_id").cast("string"), "element", F.lit(orb), v.cast("string"))
    lines = F.concat(F.array(line("s", F.col("x") / 100)), F.when(F.col("element") == "H", F.expr("cast(array() as array<string>)")).otherwise(F.array(line("p", -F.col("z") / 100))))
    f = a.withColumn("l", lines).groupBy("run", F.col("frame").alias("t")).agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("atom_id", "l"))), lambda r: r["l"])).alias("l"))
    text = F.concat(F.size("l").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit("\n*** AT T= "), F.col("t").cast("string"), F.lit(" FSEC\n"), F.array_join("l", "\n"))
    x = scans.scan_charges(spark, landed(f.select((F.col("run") * 1000 + F.size("l")).alias("run"), "t", text.alias("value")))).drop("path")
    return x.withColumn("run", F.floor(F.col("run") / 1000))


@query("s13_scan_columns", "SELECT idx AS step, t AS t_ps, value FROM series", "t_ps value", "series")
def _(spark, d):
    s = series(spark, d)
    path = landed(s.select("run", F.col("idx").alias("t"), F.concat_ws("   ", F.col("idx").cast("string"), F.col("t").cast("string"), F.col("value").cast("string")).alias("value")))
    return scans.scan_columns(spark, path, "step bigint, t_ps double, value double")


@query("s15_write_table", "SELECT run, count(*) AS n, sum(value) AS total FROM series GROUP BY run", "total", "series")
def _(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    scans.write_table(series(spark, d).withColumn("part", F.col("run") % 4), path, ["part"])
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: (run, ts, value, state)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    x = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{d}/events.parquet*")
    return x.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), F.col("event_type").alias("state"))


def finish(x: DataFrame, mode: str) -> DataFrame:
    at = f"{shared_dir(x.sparkSession).rstrip('/')}/streams/{uuid.uuid4().hex}"
    return live.run_once(x, mode, f"{at}/out", f"{at}/checkpoint")


def ended(spark: SparkSession, d: str, flags: dict) -> DataFrame:
    """The events table as a stream that has ended: a last row, of a key that no other has, is a day behind all others, so that the watermark passes them."""
    path = f"{shared_dir(spark).rstrip('/')}/scans/{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).select("run", "ts", *[c.alias(k) for k, c in flags.items()])
    e.write.parquet(path)
    e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("run"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), *[F.lit(False).alias(k) for k in flags]).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("l2_stream_window_stats", "SELECT run % 20 AS window_index, count(*) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high FROM (SELECT user_id AS run, date_trunc('day', ts) AS d, CAST(value AS DOUBLE) AS value FROM events) GROUP BY run % 20, d", "mean low high")
def _(spark, d):
    x = stream(spark, d).withColumn("window_index", F.col("run") % 20)
    return finish(live.stream_window_stats(x, "window_index", "value", "1 day"), "complete").select("window_index", "n", "mean", "low", "high")


@query("l3_stream_populations", "SELECT user_id % 15 AS site, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS p_click, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS p_view FROM events GROUP BY 1", "p_click p_view")
def _(spark, d):
    return finish(live.stream_populations(stream(spark, d).withColumn("site", F.col("run") % 15), "site", "state", ["click", "view"]), "complete")


@query("l4_stream_sessions", """WITH e AS (SELECT user_id AS run, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY t) AS g FROM e) SELECT run, count(*) AS n FROM g GROUP BY run, g""")
def _(spark, d):
    return finish(live.stream_sessions(stream(spark, d), "run", "2 hours"), "complete").select("run", "n")


@query("l5_stream_sustained_events", """WITH s AS (SELECT user_id AS run, epoch_us(ts) / 1e6 AS t, value > 60 AS m, lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts) AS pm FROM events), g AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS g FROM s), h AS (SELECT run, g, t, min(t) OVER (PARTITION BY run, g) AS "start" FROM g WHERE m)
SELECT run, "start", min(t) AS seen FROM h WHERE t - "start" >= 2000 GROUP BY run, g, "start\"""", '"start" seen')
def _(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = ended(spark, d, {"on": F.col("value") > 60})
    return finish(live.stream_sustained_events(x, "run", "on", 2000.0), "append")


@query("l5_stream_regimes", """WITH s AS (SELECT user_id AS run, epoch_us(ts) / 1e6 AS t, value < 60 AS a, value > 40 AS b FROM events), i AS (SELECT *, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER w AS ga FROM s WINDOW w AS (PARTITION BY run ORDER BY t)),
f AS (SELECT run, min(st) AS "start" FROM (SELECT run, ga, min(t) AS st, max(t) AS en FROM i WHERE a GROUP BY ALL) WHERE en - st >= 3000 GROUP BY run), r AS (SELECT s.run, s.t, s.b, f."start", sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY s.run ORDER BY t) AS gb FROM s JOIN f ON f.run = s.run AND s.t > f."start")
SELECT run, "start", min(st) AS recovered FROM (SELECT run, "start", gb, min(t) AS st, max(t) AS en FROM r WHERE b GROUP BY ALL) WHERE en - st >= 2000 GROUP BY run, "start\"""", '"start" recovered')
def _(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = ended(spark, d, {"low": F.col("value") < 60, "back": F.col("value") > 40})
    return finish(live.stream_regimes(x, "run", "low", "back", 3000.0, 2000.0), "append")


@query("l6_stream_calibration", "SELECT run, count(*) AS n, avg(value) AS mean FROM (SELECT user_id AS run, event_id, CAST(value AS DOUBLE) AS value FROM events) WHERE event_id % 100 >= 10 GROUP BY run", "mean")
def _(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    x = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    x = x.select(F.col("user_id").alias("run"), F.col("value").cast("double").alias("value"), (F.col("event_id") % 100).alias("k"))
    return finish(live.stream_calibration(x, "run", "value", "k", 10), "complete")
