"""Adapters: the driver's tables read as trajectory, series, energy and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BOX = 50.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, frame, atom_id, element, x, y, z), one frame an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 10).alias("run"),
        F.col("l_orderkey").alias("frame"),
        F.row_number().over(w).cast("bigint").alias("atom_id"),
        F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "R", "H").otherwise("C").alias("element"),
        F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice").cast("double") / 2100.0).alias("y"),
        (F.col("l_discount").cast("double") * 500.0).alias("z"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, t_us, t, idx, value, state): samples of a run in time order, t in seconds from the run's first."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("value").cast("double").alias("value"), F.col("event_type").alias("state"))
    w = Window.partitionBy("run").orderBy("t_us")
    return e.withColumns({"idx": (F.row_number().over(w) - 1).cast("bigint"), "t": (F.col("t_us") - F.first("t_us").over(w)) / 1e6})


def energies(spark: SparkSession, sf_dir: str, states: int = 10) -> DataFrame:
    """(sample, frame, u array<double>): energies of each frame in all states."""
    e = read(spark, sf_dir, "embeddings").where(F.col("label") < states)
    w = Window.partitionBy("label").orderBy("vec_id")
    u = F.transform(F.slice("embedding", 1, states), lambda x: x.cast("double"))
    return e.select(F.col("label").cast("int").alias("sample"), F.row_number().over(w).cast("bigint").alias("frame"), u.alias("u"))


def equal_energies(spark: SparkSession, sf_dir: str, states: int = 10) -> DataFrame:
    """energies with as many frames of each state as the state with the fewest has, for estimators of equal counts."""
    u = energies(spark, sf_dir, states)
    n = u.groupBy("sample").count().agg(F.min("count").alias("least"))
    return u.crossJoin(F.broadcast(n)).where("frame <= least").drop("least")  # one row


#: The same adapters as DuckDB common table expressions, for the oracle.
SQL = {
    "atoms": """atoms AS (SELECT l_orderkey % 10 AS run, l_orderkey AS frame,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS atom_id,
  CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'R' THEN 'H' ELSE 'C' END AS element,
  CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 2100.0 AS y, CAST(l_discount AS DOUBLE) * 500.0 AS z FROM lineitem)""",
    "series": """series AS (SELECT user_id AS run, epoch_us(ts) AS t_us, CAST(value AS DOUBLE) AS value, event_type AS state,
  row_number() OVER w - 1 AS idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
    "energies": """en AS (SELECT CAST(label AS INT) AS sample, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame, embedding FROM embeddings WHERE label < 10),
least AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM en GROUP BY sample)),
energies AS (SELECT sample, frame, [CAST(e AS DOUBLE) FOR e IN embedding[1:10]] AS u FROM en),
equal AS (SELECT energies.* FROM energies, least WHERE frame <= n)""",
}
