"""Runs found in packed files are those found in the same files in folders."""

import os

from framewise.plans import QUERIES
from framewise.sources import scans
from pyspark.sql import functions as F


def test_packed_runs(spark, tmp_path):
    files = [(n, s, name) for n in (1, 2, 10, 77) for s in ("meta", "stage=1", "meta2") for name in ("a", "b") if (n, name) != (2, "b") and not (s == "stage=1" and n == 10)]
    for n, s, name in files:
        at = tmp_path / f"sys/run={n}/{s}"
        os.makedirs(at, exist_ok=True)
        (at / name).write_text("x\ny\n")
    df = spark.createDataFrame([(f"/run={n}/{s}/{name}", k, v) for n, s, name in files for k, v in enumerate("xy")], "path string, t int, value string")
    packed = scans.pack(df, F.col("path"), "t", f"{tmp_path}/packed", 1)
    for stage in ("meta", "stage=1"):
        for required in (["a"], ["a", "b"], ["[ab]", "c"]):
            for spec in (None, "1-5", "2,77"):
                got, want = ([(r["run"], r["path"].rpartition("/run=")[2]) for r in scans.discover_runs(spark, x, stage, required, spec).collect()] for x in (packed, f"{tmp_path}/sys"))
                assert got == want
    assert [r["run"] for r in scans.discover_runs(spark, packed, "meta", ["a", "b"]).collect()] == [1, 10, 77]


def test_query_writes_few_files(spark):
    """The query's files do not grow with its runs."""
    from framewise.runtime import shared_dir

    at = f"{shared_dir(spark)}/scans"
    seen = set(os.listdir(at)) if os.path.isdir(at) else set()
    QUERIES["s14_discover_runs"](spark, "/root/testdata/sf0.001").collect()
    new = [f for d in set(os.listdir(at)) - seen for _, _, names in os.walk(f"{at}/{d}") for f in names if f.startswith("part-")]
    assert 0 < len(new) <= 4
