"""Registered queries: a function of (spark, sf_dir) and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", needs: str = ""):
    """Register a query. doubles: columns rounded to 6 decimals on both sides; needs: adapters that the SQL reads."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, 6) for c in doubles.replace('"', "").split()}) if doubles else df

        QUERIES[name] = run
        if (text := sql) is not None:
            if text.startswith("WITH ") and not text.startswith("WITH RECURSIVE"):
                text = "WITH RECURSIVE " + text[5:]
            ctes = ", ".join([SQL[n] for n in needs.split()] + [f"_q AS ({text})"])
            cols = f" REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in doubles.split())})" if doubles else ""
            ORACLES[name] = f"WITH RECURSIVE {ctes} SELECT *{cols} FROM _q"
        return run

    return add
