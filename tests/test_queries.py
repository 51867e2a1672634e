"""A spread of registered queries against their SQL in DuckDB, at the smallest scale."""

import collections
import glob
import math
import os

import __spark_entry__
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ["p5_station_times", "j2_nearest_time_join", "j4_interp_join", "j7_stitch_restart", "j9_neighbour_pairs", "j10_nearest_owner", "g7_dihedral", "g15_hbonds", "h4_rdf", "n1_shortest_path", "t1_islands", "t10_hop_events", "a4_block_sem", "a11_state_populations", "h2_smooth2d", "f1_min_near", "f4_basin_free_energy", "f7_tp_weights", "f16_fep_edges", "g13_rmsd", "g13_rmsd_moved", "m4_microstates_recovered", "r4_underdamped_recovered", "m7_spectral_peak", "r3_integrate_acf", "s1_scan_xyz", "l4_stream_sessions"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) + 0.0 if hasattr(v, "quantize") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = collections.Counter(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
