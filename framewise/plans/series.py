"""Queries over series: expressions, alignment, events, aggregates, histograms, correlation. Series come from the events table."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions import exprs as X
from ..operators import agg, align, density, events, regress, runs
from ..sources.tables import read, series
from .registry import query

EVEN, ODD = "idx % 2 = 0", "idx % 2 = 1"


def DEG():
    """The value read as an angle."""
    return F.col("value") * 3.0


@query("p1_frame_window", "SELECT run, idx, value FROM series WHERE idx >= 3 AND idx <= 40 AND (idx - 3) % 4 = 0", "value", "series")
def _(spark, d):
    return series(spark, d).where(F.col("idx").between(3, 40) & (F.pmod(F.col("idx") - 3, F.lit(4)) == 0)).select("run", "idx", "value")


@query("p3_time_window", "SELECT run, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM series WHERE t BETWEEN 50 AND 100000 AND value BETWEEN 1 AND 400 GROUP BY run", "first_t last_t", "series")
def _(spark, d):
    x = series(spark, d).where(F.col("t").between(50, 100000) & F.col("value").between(1, 400) & ~F.isnan("value"))
    return x.groupBy("run").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("p4_discard_and_cutoff", """SELECT s.run, count(*) FILTER (NOT x) AS n_kept, count(*) FILTER (x) AS n_excluded
FROM (SELECT series.run, t < 1000 OR coalesce(t > c.keep_until, false) AS x FROM series LEFT JOIN (SELECT DISTINCT run, 50000.0 + run AS keep_until FROM series WHERE run % 3 = 0) c USING (run)) s GROUP BY s.run""", "", "series")
def _(spark, d):
    s = series(spark, d)
    cut = s.where("run % 3 = 0").select("run", (F.lit(50000.0) + F.col("run")).alias("keep_until")).distinct()
    return align.discard_and_cutoff(s, 1000.0, cut).groupBy("run").agg(F.count_if(~F.col("excluded")).alias("n_kept"), F.count_if("excluded").alias("n_excluded"))


@query("p5_station_times", """SELECT g.run, g.station, g.target, s.t, s.value FROM
(SELECT run, unnest(range(0, CAST(floor(e / 20000.0) AS BIGINT) + 1)) AS station, station * 20000.0 AS target FROM (SELECT run, max(t) AS e FROM series GROUP BY run)) g
ASOF LEFT JOIN series s ON g.run = s.run AND g.target <= s.t""", "target t value", "series")
def _(spark, d):
    return align.station_times(series(spark, d), 20000.0).withColumn("station", F.col("station").cast("bigint"))


@query("p7_wrap_angles", """SELECT run, idx, a - 360.0 * floor((a + 180) / 360.0) AS wrapped, a - 360.0 * floor(a / 360.0) AS full_turn, 90 + (a - 90 + 180 - 360.0 * floor((a - 90 + 180) / 360.0)) - 180 AS near_90
FROM (SELECT run, idx, value * 3.0 AS a FROM series)""", "wrapped full_turn near_90", "series")
def _(spark, d):
    return series(spark, d).select("run", "idx", X.wrap_deg(DEG()).alias("wrapped"), X.range360(DEG()).alias("full_turn"), X.branch_near(DEG(), F.lit(90.0)).alias("near_90"))


@query("p8_convert_units", "SELECT run, idx, value * 0.001 AS ps, value / 4.184 AS kcal, value / 7.0 * 627.509474 AS hartree_kcal, 2 * value / 4.184 AS half_k FROM series", "ps kcal hartree_kcal half_k", "series")
def _(spark, d):
    v = F.col("value")
    return series(spark, d).select("run", "idx", X.to_ps(v, "fs").alias("ps"), X.to_kcal(v, "kj").alias("kcal"), X.to_kcal(v / 7.0, "hartree").alias("hartree_kcal"), X.half_k(v).alias("half_k"))


@query("p9_check_series", """SELECT run, count(*) AS n, coalesce(min(dt) > 0, true) AS increasing, coalesce(max(dt) - min(dt) <= 1e-7 * abs(max(dt)), true) AS uniform, true AS finite, count(*) >= 2 AS enough
FROM (SELECT run, t - lag(t) OVER (PARTITION BY run ORDER BY idx) AS dt FROM series) GROUP BY run""", "", "series")
def _(spark, d):
    return align.check_series(series(spark, d))


@query("p10_rotamers", """SELECT label, count(*) AS n FROM (SELECT CASE WHEN abs(c1) >= 120 THEN 't' WHEN c1 >= 0 THEN 'gp' ELSE 'gm' END || CASE WHEN c2 >= 0 THEN 'p' ELSE 'm' END AS label
FROM (SELECT value * 3.0 - 360.0 * floor((value * 3.0 + 180) / 360.0) AS c1, value * 7.0 - 360.0 * floor((value * 7.0 + 180) / 360.0) AS c2 FROM series)) GROUP BY label""", "", "series")
def _(spark, d):
    s = series(spark, d).select(X.rotamer_label(X.wrap_deg(DEG()), X.wrap_deg(F.col("value") * 7.0)).alias("label"))
    return s.groupBy("label").agg(F.count("*").alias("n"))


@query("p11_planar_deviation", "SELECT run, avg(abs(b - 180.0 * floor(b / 180.0) - 90)) AS mean_dev FROM (SELECT run, value * 3.0 + 90 AS b FROM series) GROUP BY run", "mean_dev", "series")
def _(spark, d):
    return series(spark, d).groupBy("run").agg(F.avg(X.planar_deviation(DEG())).alias("mean_dev"))


@query("p13_time_snap", "SELECT run, floor(t / 5000.0) * 5000.0 AS window_start, count(*) AS n FROM series GROUP BY ALL", "window_start", "series")
def _(spark, d):
    return series(spark, d).groupBy("run", X.time_snap(F.col("t"), 5000.0).alias("window_start")).agg(F.count("*").alias("n"))


@query("j1_exact_time_join", """SELECT a.run, a.idx, b.value AS other FROM series a LEFT JOIN (SELECT run, t, value FROM series WHERE idx % 2 = 0) b ON a.run = b.run AND round_even(a.t * 1e3, 0) = round_even(b.t * 1e3, 0)""", "other", "series")
def _(spark, d):
    s = series(spark, d)
    return align.exact_time_join(s.select("run", "idx", "t"), s.where(EVEN).select("run", "t", F.col("value").alias("other")), ["other"], places=1e3).select("run", "idx", "other")


@query("j2_nearest_time_join", """SELECT run, idx, CASE WHEN least(dp, dn) <= 3000 THEN CASE WHEN dn IS NULL OR dp <= dn THEN pv ELSE nv END END AS near FROM (
SELECT a.run, a.idx, a.t - p.t AS dp, p.value AS pv, n.t - a.t AS dn, n.value AS nv FROM (SELECT * FROM series WHERE idx % 2 = 1) a
ASOF LEFT JOIN (SELECT * FROM series WHERE idx % 2 = 0) p ON a.run = p.run AND a.t >= p.t ASOF LEFT JOIN (SELECT * FROM series WHERE idx % 2 = 0) n ON a.run = n.run AND a.t <= n.t)""", "near", "series")
def _(spark, d):
    s = series(spark, d)
    x = align.nearest_time_join(s.where(ODD).select("run", "idx", "t"), s.where(EVEN).select("run", "t", F.col("value").alias("near")), ["near"], 3000.0)
    return x.select("run", "idx", "near")


@query("j3_asof_backward", """SELECT a.run, a.idx, p.t AS t_b, p.value AS before FROM series a ASOF LEFT JOIN (SELECT * FROM series WHERE idx % 3 = 1) p ON a.run = p.run AND a.t >= p.t""", "t_b before", "series")
def _(spark, d):
    s = series(spark, d)
    return align.asof_backward(s.select("run", "idx", "t"), s.where("idx % 3 = 1").select("run", "t", F.col("value").alias("before")), ["before"], nearest=False).select("run", "idx", "t_b", "before")


@query("j4_interp_join", """SELECT a.run, a.idx, CASE WHEN n.t = p.t THEN p.value ELSE p.value + (n.value - p.value) * (a.t - p.t) / (n.t - p.t) END AS interpolated FROM (SELECT * FROM series WHERE idx % 2 = 1) a
ASOF LEFT JOIN (SELECT * FROM series WHERE idx % 2 = 0) p ON a.run = p.run AND a.t >= p.t ASOF LEFT JOIN (SELECT * FROM series WHERE idx % 2 = 0) n ON a.run = n.run AND a.t <= n.t""", "interpolated", "series")
def _(spark, d):
    s = series(spark, d)
    return align.interp_join(s.where(ODD).select("run", "idx", "t"), s.where(EVEN)).select("run", "idx", "interpolated")


@query("j5_hill_number_join", "SELECT f.run, f.idx AS n_gauss, f.value AS f, h.t AS t_hill FROM (SELECT * FROM series WHERE idx % 5 = 0) f JOIN series h ON f.run = h.run AND h.idx = f.idx", "f t_hill", "series")
def _(spark, d):
    s = series(spark, d)
    return align.hill_number_join(s.where("idx % 5 = 0").select("run", F.col("idx").alias("n_gauss"), F.col("value").alias("f")), s.withColumnRenamed("idx", "hill_no"))


@query("j6_validate_series", """SELECT run, count(a) AS n_computed, count(b) AS n_logged, count(*) FILTER (abs(a - b) > 0.5) AS n_over, max(abs(a - b)) AS max_diff, arg_max(idx, (abs(a - b), -idx)) FILTER (abs(a - b) IS NOT NULL) AS at_step
FROM (SELECT run, idx, value AS a FROM series) x FULL JOIN (SELECT run, idx, value * 1.01 AS b FROM series WHERE idx < 50) y USING (run, idx) GROUP BY run""", "max_diff", "series")
def _(spark, d):
    s = series(spark, d)
    return align.validate_series(s, s.where("idx < 50").withColumn("value", F.col("value") * 1.01), 0.5)


@query("j7_stitch_restart", """SELECT run, count(*) AS n, sum(t) AS sum_t, sum(value) AS sum_v FROM (SELECT run, t, value FROM series WHERE idx < 30 UNION ALL
SELECT r.run, r.t, r.value FROM (SELECT * FROM series WHERE idx >= 25) r JOIN (SELECT run, max(t) AS e FROM series WHERE idx < 30 GROUP BY run) USING (run) WHERE r.t > e) GROUP BY run""", "sum_t sum_v", "series")
def _(spark, d):
    s = series(spark, d).select("run", "t", "value", "idx")
    return align.stitch_restart(s.where("idx < 30"), s.where("idx >= 25")).groupBy("run").agg(F.count("*").alias("n"), F.sum("t").alias("sum_t"), F.sum("value").alias("sum_v"))


@query("j8_clock_offset", """SELECT run, pt + (cs - ps) * 2.5 - ct AS "offset" FROM (SELECT run, arg_min(idx, idx) AS cs, arg_min(t, idx) AS ct FROM series WHERE idx >= 20 GROUP BY run) JOIN (SELECT run, max(idx) AS ps, arg_max(t, idx) AS pt FROM series WHERE idx < 20 GROUP BY run) USING (run)""", '"offset"', "series")
def _(spark, d):
    s = series(spark, d)
    return align.clock_offset(s.where("idx >= 20"), s.where("idx < 20"), 2.5)


@query("j11_align_state_to_frames", "SELECT f.run, f.idx AS frame, r.state FROM series f JOIN series r ON f.run = r.run AND r.idx = f.idx * 3", "", "series")
def _(spark, d):
    s = series(spark, d)
    x = align.align_state_to_frames(s.select("run", F.col("idx").alias("frame")), s.select("run", F.col("idx").alias("record"), "state"), 3, ["run"])
    return x.select("run", "frame", "state")


@query("j12_missing_keys", """WITH e AS (SELECT DISTINCT run, s.state FROM series, (SELECT DISTINCT state FROM series) s WHERE run % 2 = 0), a AS (SELECT DISTINCT run, state FROM series WHERE value > 60)
SELECT *, 'missing' AS status FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'unexpected' AS status FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""", "", "series")
def _(spark, d):
    s = series(spark, d).select("run", "state", "value")
    e = s.where("run % 2 = 0").select("run").distinct().crossJoin(F.broadcast(s.select("state").distinct()))  # five event types
    return align.missing_keys(e, s.where("value > 60"), ["run", "state"])


@query("j13_nearest_to_targets", """SELECT run, target, arg_min(t, (abs(value - target), t)) AS t, arg_min(value, (abs(value - target), t)) AS value FROM series, (SELECT 100.0 - 20.0 * i AS target FROM range(0, 6) r(i)) GROUP BY ALL""", "target t value", "series")
def _(spark, d):
    return align.nearest_to_targets(series(spark, d), 100.0, 0.0, 20.0)


@query("j14_nearest_label", """SELECT label, count(*) AS n FROM (SELECT run, idx, CAST(arg_min(i, (abs(value - i * 25.0), i)) AS INTEGER) AS label FROM series, range(0, 8) r(i) GROUP BY run, idx) GROUP BY label""", "", "series")
def _(spark, d):
    return series(spark, d).groupBy(align.nearest_label(F.col("value"), 0.0, 25.0, 8).alias("label")).agg(F.count("*").alias("n"))


@query("j15_compare_estimates", """SELECT a.run, a.m - b.m AS difference, sqrt(a.s * a.s + b.s * b.s) AS sd, (a.m - b.m) / (0.004576 * 300) AS pka_shift FROM
(SELECT run, avg(value) AS m, stddev_samp(value) AS s FROM series WHERE idx % 2 = 0 GROUP BY run) a JOIN (SELECT run, avg(value) AS m, stddev_samp(value) AS s FROM series WHERE idx % 2 = 1 GROUP BY run) b USING (run)""", "difference sd pka_shift", "series")
def _(spark, d):
    s = series(spark, d)
    e = lambda m: s.where(m).groupBy("run").agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("sd"))
    return align.compare_estimates(e(EVEN), e(ODD), ["run"], X.PKA_FACTOR * 300)


ISLANDS = """isl AS (SELECT run, t, m, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS island FROM (SELECT run, t, value > 60 AS m, lag(value > 60) OVER (PARTITION BY run ORDER BY t) AS pm FROM series)),
seg AS (SELECT run, island, min(t) AS "start", max(t) AS "end", count(*) AS n FROM isl WHERE m GROUP BY run, island)"""


@query("t1_islands", f'WITH {ISLANDS} SELECT run, "start", "end", n, "end" - "start" + 10.0 AS duration FROM seg', '"start" "end" duration', "series")
def _(spark, d):
    return events.islands(series(spark, d), F.col("value") > 60, dt=10.0)


#: All events as one run, in the order of their ids.
ONE = "one AS (SELECT 0 AS run, CAST(event_id AS DOUBLE) AS t, CAST(value AS DOUBLE) AS value, event_type AS state FROM events)"
#: Rows of a block in the queries over one long run.
BLOCK = 1500


def one_run(spark, d):
    e = read(spark, d, "events")
    return e.select(F.lit(0).alias("run"), F.col("event_id").cast("double").alias("t"), F.col("value").cast("double").alias("value"), F.col("event_type").alias("state"))


@query("t1_one_run", f"""WITH {ONE}, a AS (SELECT *, value > 60 AS m, lag(value > 60) OVER (ORDER BY t) AS pm FROM one), b AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS g FROM a)
SELECT run, min(t) AS "start", max(t) AS "end", count(*) AS n, max(t) - min(t) AS duration FROM b WHERE m GROUP BY run, g""", '"start" "end" duration')
def _(spark, d):
    return events.islands(one_run(spark, d), F.col("value") > 60, size=BLOCK)


@query("t6_one_run", f"""WITH {ONE} SELECT t, avg(value) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS shrink, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * pi() AS fraction,
last_value(CASE WHEN value > 120 THEN value END IGNORE NULLS) OVER (ORDER BY t) AS filled FROM one""", "t shrink fraction filled")
def _(spark, d):
    means = {"shrink": lambda k: events.moving_average("value", 5, key=k), "fraction": lambda k: events.rolling_fraction(F.col("value") > 50, 10, key=k) * math.pi}
    x = runs.filled(one_run(spark, d), {"filled": F.when(F.col("value") > 120, F.col("value"))}, size=BLOCK)
    return runs.with_windows(x, means, 9, 5, size=BLOCK).select("t", "shrink", "fraction", "filled")


@query("j3_one_run", f"""WITH {ONE} SELECT a.t, a.value, b.t AS t_b, b.state FROM (SELECT * FROM one WHERE value <= 100) a ASOF LEFT JOIN (SELECT * FROM one WHERE value > 100) b ON a.run = b.run AND a.t >= b.t""", "t value t_b")
def _(spark, d):
    s = one_run(spark, d)
    return align.asof_backward(s.where("value <= 100").select("run", "t", "value"), s.where("value > 100"), ["state"], nearest=False, size=BLOCK).select("t", "value", "t_b", "state")


@query("t2_first_sustained", f'WITH {ISLANDS} SELECT run, min("start") AS "start" FROM seg WHERE "end" - "start" >= 2000 GROUP BY run', '"start"', "series")
def _(spark, d):
    return events.first_sustained(series(spark, d), F.col("value") > 60, 2000.0)


@query("t3_diffusive_regime", """WITH a AS (SELECT run, t, value, value < 50 AS m, lag(value < 50) OVER (PARTITION BY run ORDER BY t) AS pm FROM series),
b AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS g FROM a),
c AS (SELECT run, min(s) AS "start" FROM (SELECT run, g, min(t) AS s, max(t) AS e FROM b WHERE m GROUP BY run, g) WHERE e - s >= 3000 GROUP BY run),
d AS (SELECT run, t, value >= 50 AS m, lag(value >= 50) OVER (PARTITION BY run ORDER BY t) AS pm FROM series JOIN c USING (run) WHERE t > c."start"),
e AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS g FROM d),
f AS (SELECT run, min(s) AS recovered FROM (SELECT run, g, min(t) AS s, max(t) AS e FROM e WHERE m GROUP BY run, g) WHERE e - s >= 3000 GROUP BY run)
SELECT run, "start", recovered FROM c JOIN f USING (run)""", '"start" recovered', "series")
def _(spark, d):
    return events.diffusive_regime(series(spark, d), F.col("value") < 50, F.col("value") >= 50, 3000.0)


@query("t4_persistent_ids", """SELECT run, idx, CASE WHEN max(t) OVER w - min(t) OVER w >= 1500 THEN state END AS persistent FROM (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY t) AS g FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY run ORDER BY t) THEN 0 ELSE 1 END AS c FROM series)) WINDOW w AS (PARTITION BY run, g)""", "", "series")
def _(spark, d):
    return events.persistent_ids(series(spark, d), "state", 1500.0).select("run", "idx", "persistent")


@query("t5_forward_fill", "SELECT run, idx, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY run ORDER BY t) AS filled FROM series", "filled", "series")
def _(spark, d):
    return series(spark, d).select("run", "idx", events.forward_fill(F.when(F.col("value") > 50, F.col("value"))).alias("filled"))


@query("t6_moving_averages", """SELECT run, idx, avg(value) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS shrink,
(sum(value) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - idx) * first_value(value) OVER w + greatest(0, idx + 4 - count(*) OVER (PARTITION BY run)) * last_value(value) OVER w) / 7 AS edge,
avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS fraction FROM series WINDOW w AS (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "shrink edge fraction", "series")
def _(spark, d):
    return series(spark, d).select("run", "idx", events.moving_average("value", 3).alias("shrink"), events.moving_average("value", 3, pad="edge").alias("edge"), events.rolling_fraction(F.col("value") > 50, 10).alias("fraction"))


@query("t6_circular_running_average", """SELECT run, idx, degrees(atan2(avg(sin(radians(value * 3.0))) OVER w, avg(cos(radians(value * 3.0))) OVER w)) AS direction FROM series WINDOW w AS (PARTITION BY run ORDER BY t_us RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING)""", "direction", "series")
def _(spark, d):
    return series(spark, d).select("run", "idx", events.circular_running_average(DEG(), 3_600_000_000).alias("direction"))


@query("t7_count_transitions", "SELECT run, CAST(sum(CASE WHEN state <> p THEN 1 ELSE 0 END) AS BIGINT) AS n_transitions FROM (SELECT run, state, lag(state) OVER (PARTITION BY run ORDER BY t) AS p FROM series) GROUP BY run", "", "series")
def _(spark, d):
    return events.count_transitions(series(spark, d), "state")


@query("t8_core_transitions", """SELECT run, p AS from_core, core AS to_core, count(*) AS n FROM (SELECT run, core, lag(core) OVER (PARTITION BY run ORDER BY t) AS p FROM (SELECT run, t, CASE WHEN value BETWEEN 0 AND 30 THEN 'low' WHEN value BETWEEN 70 AND 1000 THEN 'high' END AS core FROM series) WHERE core IS NOT NULL) WHERE p <> core GROUP BY ALL""", "", "series")
def _(spark, d):
    return events.core_transitions(series(spark, d), [("low", 0, 30), ("high", 70, 1000)])


@query("t9_bulk_audit", f"""WITH {ISLANDS}, a AS (SELECT run, max(value) >= 60 AS reached, count(*) FILTER (p < 60 AND value >= 60) AS crossings, count(*) FILTER (p < 60 AND value >= 60 AND value - p <= 40) AS continuous FROM (SELECT *, lag(value) OVER (PARTITION BY run ORDER BY t) AS p FROM series) GROUP BY run)
SELECT run, reached, crossings, continuous, coalesce(longest, 0.0) AS longest FROM a LEFT JOIN (SELECT run, max("end" - "start") AS longest FROM seg GROUP BY run) USING (run)""".replace("value > 60", "value >= 60"), "longest", "series")
def _(spark, d):
    return events.bulk_audit(series(spark, d), 60.0, 40.0)


@query("t10_hop_events", """WITH a AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY t) AS g FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY run ORDER BY t) THEN 0 ELSE 1 END AS c FROM series)),
b AS (SELECT run, g, first(state) AS donor, min(t) AS s, max(t) AS t_off FROM a GROUP BY run, g), c AS (SELECT *, lead(donor) OVER w AS acceptor, lead(s) OVER w AS t_on FROM b WINDOW w AS (PARTITION BY run ORDER BY s))
SELECT run, donor, acceptor, t_off, t_on, t_on - t_off AS pause FROM c WHERE acceptor <> donor AND t_on - t_off <= 2000""", "t_off t_on pause", "series")
def _(spark, d):
    return events.hop_events(series(spark, d), "state", 2000.0)


@query("t11_longest_event", """WITH a AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY t) AS g FROM (SELECT *, CASE WHEN m AND NOT (coalesce(lag(m) OVER w, false) AND state = lag(state) OVER w) THEN 1 ELSE 0 END AS c FROM (SELECT *, value < 80 AS m FROM series) WINDOW w AS (PARTITION BY run ORDER BY t))),
b AS (SELECT run, g, first(state) AS id, min(t) AS s, max(t) AS e FROM a WHERE m GROUP BY run, g), c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY e - s DESC, s) AS k FROM b WHERE e - s >= 500)
SELECT run, id, s AS "start", e AS "end", e - s AS duration FROM c WHERE k = 1""", '"start" "end" duration', "series")
def _(spark, d):
    return events.longest_event(series(spark, d), F.col("value") < 80, "state", 500.0)


@query("t14_truncate_at_departure", "SELECT run, count(*) AS n, max(t) AS last_t FROM (SELECT *, min(CASE WHEN value > 150 THEN t END) OVER (PARTITION BY run) AS cut FROM series) WHERE cut IS NULL OR t < cut GROUP BY run", "last_t", "series")
def _(spark, d):
    return events.truncate_at_departure(series(spark, d), F.col("value") > 150).groupBy("run").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query("t15_stitch_windows", """SELECT run, CAST(floor(idx / 8.0) AS INTEGER) AS "window", CAST(idx % 8 AS INTEGER) AS "local", (idx % 8) * 0.5 AS local_t, value FROM series""", "local_t value", "series")
def _(spark, d):
    return events.stitch_windows(series(spark, d), 8, dt=0.5).select("run", "window", "local", "local_t", "value")


@query("t15_pull_ladder", """WITH w AS (SELECT run, idx // 10 AS "window", min(t) AS s, max(t) AS e, avg(value) AS target FROM series GROUP BY ALL), x AS (SELECT *, lead(s) OVER (PARTITION BY run ORDER BY "window") AS nx FROM w)
SELECT run, "window", 0 AS corner, s AS t, target FROM x UNION ALL SELECT run, "window", 1, coalesce(nx, e), target FROM x""", "t target", "series")
def _(spark, d):
    w = series(spark, d).groupBy("run", F.floor(F.col("idx") / 10).alias("window")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.avg("value").alias("target"))
    return events.pull_ladder(w)


@query("t16_peaks", "SELECT run, idx, value FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r, max(value) OVER (PARTITION BY run) AS m FROM series WINDOW w AS (PARTITION BY run ORDER BY t)) WHERE value > l AND value > r AND value > 0.6 * m", "value", "series")
def _(spark, d):
    return events.peaks(series(spark, d), 0.6).select("run", "idx", "value")


@query("t17_funnel", """SELECT run, CASE WHEN max(value) < 120 THEN 'never_far' WHEN avg(value) > 55 THEN 'too_far' WHEN count(*) < 60 THEN 'too_short' ELSE 'accepted' END AS stage FROM series GROUP BY run""", "", "series")
def _(spark, d):
    s = series(spark, d)
    g = s.groupBy("run").agg(F.max("value").alias("m"), F.avg("value").alias("a"), F.count("*").alias("n"))
    return events.funnel_classify(s, [("never_far", g.where("m < 120")), ("too_far", g.where("a > 55")), ("too_short", g.where("n < 60"))])


@query("a4_block_sem", """SELECT run, sum(s) / sum(n) AS mean, stddev_samp(m) / sqrt(count(*)) AS sem FROM (SELECT run, b, avg(value) AS m, sum(value) AS s, count(*) AS n FROM (SELECT run, value, ntile(5) OVER (PARTITION BY run ORDER BY t) AS b FROM series) GROUP BY run, b) GROUP BY run""", "mean sem", "series")
def _(spark, d):
    return agg.block_sem(series(spark, d), "value", 5, ["run"])


@query("a5_circular", """SELECT run, degrees(atan2(s, c)) AS mean_deg, degrees(sqrt(-2 * ln(least(1.0, sqrt(s * s + c * c))))) AS sd_deg, least(1.0, sqrt(s * s + c * c)) AS resultant FROM (SELECT run, avg(sin(radians(value * 3.0))) AS s, avg(cos(radians(value * 3.0))) AS c FROM series GROUP BY run)""", "mean_deg sd_deg resultant", "series")
def _(spark, d):
    return agg.circular_mean_std(series(spark, d), DEG(), ["run"])


@query("a6_summary_stats", "SELECT state, count(value) AS n, count(DISTINCT run) AS runs, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS median, min(value) AS min, max(value) AS max FROM series GROUP BY state", "mean sd median min max", "series")
def _(spark, d):
    return agg.summary_stats(series(spark, d), "value", ["state"])


@query("a7_second_half", "SELECT run, avg(value) AS mean, regr_slope(value, t) AS slope FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM series) WHERE idx >= n // 2 GROUP BY run", "mean slope", "series")
def _(spark, d):
    return agg.second_half(series(spark, d), "value")


@query("a8_ensemble_band", "SELECT idx, avg(value) AS mean, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM series GROUP BY idx", "mean low high", "series")
def _(spark, d):
    return agg.ensemble_band(series(spark, d), "idx", "value")


@query("a9_weighted_ensemble", "SELECT state, sum(w * value) / sum(w) AS mean, sqrt(greatest(0, sum(w * value * value) / sum(w) - (sum(w * value) / sum(w)) ** 2)) AS sd, sum(w) * sum(w) / sum(w * w) AS n_eff, sqrt(greatest(0, sum(w * value * value) / sum(w) - (sum(w * value) / sum(w)) ** 2)) / sqrt(sum(w) * sum(w) / sum(w * w)) AS sem FROM (SELECT state, value, CAST(1 + idx % 4 AS DOUBLE) AS w FROM series) GROUP BY state", "mean sd n_eff sem", "series")
def _(spark, d):
    return agg.weighted_ensemble(series(spark, d).withColumn("w", (1 + F.col("idx") % 4).cast("double")), "value", "w", ["state"])


PROT = "prot AS (SELECT 2 + (run % 15) * 0.5 AS ph, state, row_number() OVER (PARTITION BY run % 15 ORDER BY t_us, run) AS record FROM series)"


def protonation(spark, d):
    w = Window.partitionBy(F.col("run") % 15).orderBy("t_us", "run")
    return series(spark, d).select((2 + (F.col("run") % 15) * 0.5).alias("ph"), "state", F.row_number().over(w).alias("record"))


@query("a11_state_populations", f"""WITH {PROT}, b AS (SELECT ph, state, ntile(4) OVER (PARTITION BY ph ORDER BY record) AS b FROM prot), t AS (SELECT ph, b, count(*) AS t FROM b GROUP BY ALL), n AS (SELECT ph, b, state, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT t.ph, t.b, s.state, t.t, coalesce(n.n, 0) AS n FROM t CROSS JOIN (SELECT DISTINCT state FROM prot) s LEFT JOIN n ON n.ph = t.ph AND n.b = t.b AND n.state = s.state)
SELECT CAST(ph AS DOUBLE) AS ph, state, sum(n) / sum(t) AS fraction, stddev_samp(n / t) / sqrt(count(*)) AS sem, CAST(sum(t) AS BIGINT) AS n_records FROM x GROUP BY ph, state""", "ph fraction sem", "series")
def _(spark, d):
    x = protonation(spark, d).withColumn("ph", F.col("ph").cast("double"))
    return agg.state_populations(x, "state", ["ph"], 4)


@query("a12_syn_anti", "SELECT run, a AS n_syn, b AS n_anti, CASE WHEN b = 0 AND a > 0 THEN 1e308 ELSE a / nullif(b, 0) END AS ratio FROM (SELECT run, count(*) FILTER (value < 20) AS a, count(*) FILTER (value > 150) AS b FROM series GROUP BY run)", "ratio", "series")
def _(spark, d):
    x = agg.syn_anti(series(spark, d), F.col("value") < 20, F.col("value") > 150, ["run"])
    return x.withColumn("ratio", F.least(F.lit(1e308), "ratio"))


@query("a13_joint_microstates", """WITH p AS (SELECT run, CASE WHEN a.value > 40 THEN 1 ELSE 0 END AS a, CASE WHEN a.value * 7 % 50 > 25 THEN 1 ELSE 0 END AS b FROM series a)
SELECT run, avg(CASE WHEN a = 0 AND b = 0 THEN 1.0 ELSE 0 END) AS p00, avg(CASE WHEN a = 0 AND b = 1 THEN 1.0 ELSE 0 END) AS p01, avg(CASE WHEN a = 1 AND b = 0 THEN 1.0 ELSE 0 END) AS p10, avg(CASE WHEN a = 1 AND b = 1 THEN 1.0 ELSE 0 END) AS p11, avg(a + b) AS mean_protons,
avg(CASE WHEN a = 0 AND b = 1 THEN 1.0 ELSE 0 END) + avg(CASE WHEN a = 1 AND b = 0 THEN 1.0 ELSE 0 END) AS one_proton FROM p GROUP BY run""", "p00 p01 p10 p11 mean_protons one_proton", "series")
def _(spark, d):
    s = series(spark, d).withColumn("record", F.col("idx"))
    site = lambda m: s.select("run", "record", m.cast("int").alias("proton"))
    return agg.joint_microstates(site(F.col("value") > 40), site(F.col("value") * 7 % 50 > 25), ["run"])


@query("a15_residence", "SELECT run, state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY run) AS percent FROM series GROUP BY run, state", "percent", "series")
def _(spark, d):
    return agg.residence_percent(series(spark, d), "run", "state")


@query("a15_residence_lifetime", """SELECT run, state, count(*) AS visits, max(n) AS longest, avg(n) AS mean FROM (SELECT run, g, first(state) AS state, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY t) AS g FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY run ORDER BY t) THEN 0 ELSE 1 END AS c FROM series)) GROUP BY run, g) GROUP BY run, state""", "mean", "series")
def _(spark, d):
    return agg.residence_lifetime(series(spark, d), "run", "state", "t")


@query("a16_perf_summary", "SELECT state, count(*) AS n, avg(value) AS mean_s, avg(value) * 1000 * 10 / 3600.0 AS hours_x10, avg(value) * 1000 * 100 / 3600.0 AS hours_x100 FROM series GROUP BY state", "mean_s hours_x10 hours_x100", "series")
def _(spark, d):
    return agg.perf_summary(series(spark, d), ["state"], "value", 1000)


@query("a17_event_shift", """SELECT e.run, e."start", median(value) FILTER (t > e."start") - median(value) FILTER (t < e."start") AS shift FROM (SELECT run, t AS "start" FROM series WHERE value > 150) e LEFT JOIN series s ON e.run = s.run AND s.t BETWEEN e."start" - 5000 AND e."start" + 5000 GROUP BY ALL""", '"start" shift', "series")
def _(spark, d):
    s = series(spark, d)
    return agg_shift(s)


def agg_shift(s):
    return events.event_shift(s.where("value > 150").select("run", F.col("t").alias("start")), s, 5000.0, 5000.0)


@query("a18_overlap", """WITH h AS (SELECT run, idx % 2 AS side, CAST(floor(value / 20) AS BIGINT) AS bin, count(*) AS n FROM series GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY run, side) AS p FROM h)
SELECT a.run, sum(sqrt(a.p * b.p)) AS bhattacharyya, sum(least(a.p, b.p)) AS minimum FROM p a JOIN p b ON a.run = b.run AND a.bin = b.bin AND a.side = 0 AND b.side = 1 GROUP BY a.run""", "bhattacharyya minimum", "series")
def _(spark, d):
    s = series(spark, d).withColumn("bin", F.floor(F.col("value") / 20))
    h = lambda m: s.where(m).groupBy("run", "bin").agg(F.count("*").alias("n"))
    return agg.overlap(h(EVEN), h(ODD), "bin", ["run"])


@query("a19_calibration_summary", "SELECT run, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS sd, count(*) AS n FROM series WHERE idx >= 40 GROUP BY run", "mean sd", "series")
def _(spark, d):
    return agg.calibration_summary(series(spark, d), "value", 40, "run", "t")


@query("a20_harmonic_width", f"SELECT run, stddev_samp(value) AS sd, {math.sqrt(X.GAS_KCAL * 300 / 20)!r} AS expected_kcal, {math.sqrt(X.GAS_KCAL * 300 * 4.184 / 20)!r} AS expected_kj FROM series GROUP BY run", "sd expected_kcal expected_kj", "series")
def _(spark, d):
    return agg.harmonic_width(series(spark, d), "value", 10.0, 300.0, ["run"])


@query("a10_basin_residence", """WITH m AS (SELECT * FROM (VALUES (0, 'a', 10.0), (0, 'b', 90.0), (1, 'a', 30.0), (1, 'c', 120.0)) v(surface, basin, x)), s AS (SELECT run, t, value, run % 2 AS surface, lead(t) OVER (PARTITION BY run ORDER BY t) - t AS dt FROM series),
n AS (SELECT run, t, any_value(dt) AS dt, arg_min(basin, (abs(value - x), basin)) AS basin FROM s JOIN m USING (surface) GROUP BY run, t) SELECT run, basin, sum(dt) AS residence FROM n GROUP BY run, basin""", "residence", "series")
def _(spark, d):
    m = spark.createDataFrame([(0, "a", 10.0), (0, "b", 90.0), (1, "a", 30.0), (1, "c", 120.0)], "surface bigint, basin string, x double")
    return agg.basin_residence(series(spark, d).withColumn("surface", F.col("run") % 2), m, "surface")


GRID = "SELECT CAST(i AS INTEGER) AS bin, 0.0 + (i + 0.5) * 10.0 AS x FROM range(0, 20) r(i)"


@query("h1_hist1d", f"""WITH c AS (SELECT state, CAST(least(floor(value / 10.0), 19) AS INTEGER) AS bin, count(*) AS n FROM series WHERE value BETWEEN 0 AND 200 GROUP BY ALL)
SELECT s.state, g.bin, g.x, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY s.state) * 10.0) AS density FROM (SELECT DISTINCT state FROM c) s CROSS JOIN ({GRID}) g LEFT JOIN c ON c.state = s.state AND c.bin = g.bin""", "x density", "series")
def _(spark, d):
    return density.hist1d(series(spark, d), "value", 0.0, 200.0, 20, ["state"])


HIST2 = "cells AS (SELECT CAST(least(floor(value / 20.0), 9) AS INTEGER) AS i, CAST(least(floor(v2 / 20.0), 9) AS INTEGER) AS j, count(*) AS n FROM (SELECT value, lead(value) OVER (PARTITION BY run ORDER BY t) AS v2 FROM series) WHERE value BETWEEN 0 AND 200 AND v2 BETWEEN 0 AND 200 GROUP BY ALL)"


def pairs2d(spark, d):
    s = series(spark, d).withColumn("v2", F.lead("value").over(Window.partitionBy("run").orderBy("t")))
    return density.hist2d(s, "value", "v2", (0.0, 200.0, 10), (0.0, 200.0, 10))


@query("h2_hist2d", f"WITH {HIST2} SELECT i, j, n, -log10(n) AS neg_log FROM cells", "neg_log", "series")
def _(spark, d):
    return pairs2d(spark, d)


@query("h2_smooth2d", f"""WITH {HIST2} SELECT CAST(greatest(0, least(9, i + a)) AS INTEGER) AS i, CAST(greatest(0, least(9, j + b)) AS INTEGER) AS j, sum((2 - abs(a)) * (2 - abs(b)) / 16.0 * n) AS smooth FROM cells, (SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b)) GROUP BY ALL""", "smooth", "series")
def _(spark, d):
    return density.smooth2d(pairs2d(spark, d), 10, 10)


@query("h3_kde1d", """WITH s AS (SELECT state, 0.4 * stddev_samp(value) AS h FROM series GROUP BY state)
SELECT state, CAST(i AS INTEGER) AS g, i * 200.0 / 20 AS x, avg(exp(-0.5 * ((i * 200.0 / 20 - value) / h) ** 2)) / (any_value(h) * sqrt(2 * pi())) AS density FROM series JOIN s USING (state), range(0, 21) r(i) GROUP BY ALL""", "x density", "series")
def _(spark, d):
    return density.kde1d(series(spark, d), "value", 0.0, 200.0, 21, 0.4, ["state"])


@query("h3_bounded_kde", """WITH s AS (SELECT state, count(value) AS n, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(value), -0.2) AS h FROM series GROUP BY state), x AS (SELECT *, i * 500.0 / 10 AS x FROM series JOIN s USING (state), range(0, 11) r(i))
SELECT state, CAST(i AS INTEGER) AS g, x, sum(exp(-0.5 * ((x - value) / h) ** 2) + exp(-0.5 * ((x + value) / h) ** 2) + exp(-0.5 * ((x - 1000 + value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM x GROUP BY state, i, x""", "x density", "series")
def _(spark, d):
    return density.bounded_kde(series(spark, d), "value", 0.0, 500.0, 11, ["state"])


@query("h6_pmf", f"""WITH c AS (SELECT state, CAST(least(floor(value / 10.0), 19) AS INTEGER) AS bin, count(*) AS n FROM series WHERE value BETWEEN 0 AND 200 GROUP BY ALL), g AS (SELECT s.state, g.bin, g.x, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT state FROM c) s CROSS JOIN ({GRID}) g LEFT JOIN c ON c.state = s.state AND c.bin = g.bin),
f AS (SELECT state, bin, CASE WHEN n > 0 THEN -{X.GAS_KCAL} * 300 * ln(n / (x * x)) END AS f FROM g) SELECT state, bin, f - min(f) OVER (PARTITION BY state) AS pmf FROM f""", "pmf", "series")
def _(spark, d):
    h = density.hist1d(series(spark, d), "value", 0.0, 200.0, 20, ["state"])
    return density.pmf_from_density(h, "n", 300.0, ["state"], F.col("x") * F.col("x")).select("state", "bin", "pmf")


@query("h9_basin_population", "SELECT state, basin, n, n / sum(n) OVER (PARTITION BY state) AS fraction FROM (SELECT state, CAST((value >= 30)::INT + (value >= 90)::INT AS INTEGER) AS basin, count(*) AS n FROM series GROUP BY ALL)", "fraction", "series")
def _(spark, d):
    return density.basin_population(series(spark, d), "value", [30.0, 90.0], ["state"]).withColumn("basin", F.col("basin").cast("int"))


@query("h13_pooled_distribution", """SELECT CAST(least(floor(value / 20.0), 9) AS INTEGER) AS bin, count(*) AS n FROM series WHERE value BETWEEN 0 AND 200 AND state IN ('click', 'view', 'purchase') GROUP BY ALL""", "", "series")
def _(spark, d):
    s = series(spark, d)
    parts = {k: s.where(F.col("state") == k) for k in ("click", "view", "purchase")}
    return density.pooled_distribution(parts, "value", 0.0, 200.0, 10)[0].where("n > 0").select("bin", "n")


ACF = "acf AS (SELECT a.run, CAST(b.idx - a.idx AS INTEGER) AS lag, avg(cos(radians(a.value * 3.0 - b.value * 3.0))) AS c, count(*) AS n FROM series a JOIN series b ON a.run = b.run AND b.idx BETWEEN a.idx AND a.idx + 12 GROUP BY ALL)"


def acf(spark, d):
    return regress.cosine_acf(series(spark, d), DEG(), 12)


@query("r1_cosine_acf", f"WITH {ACF} SELECT * FROM acf", "c", "series")
def _(spark, d):
    return acf(spark, d)


@query("r2_ensemble_acf", f"WITH {ACF} SELECT lag, avg(c) AS mean, stddev_samp(c) AS sd FROM acf GROUP BY lag HAVING count(*) = (SELECT count(DISTINCT run) FROM acf)", "mean sd", "series")
def _(spark, d):
    return regress.ensemble_acf(acf(spark, d))


@query("r3_integrate_acf", f"""WITH {ACF}, p AS (SELECT *, avg(c) FILTER (lag > 7) OVER (PARTITION BY run) AS p, first_value(c) OVER (PARTITION BY run ORDER BY lag) AS c0 FROM acf), y AS (SELECT run, lag, (c - p) / nullif(c0 - p, 0) AS y FROM p)
SELECT run, lag, sum(s) OVER (PARTITION BY run ORDER BY lag) AS integral FROM (SELECT run, lag, coalesce((y + lag(y) OVER (PARTITION BY run ORDER BY lag)) / 2 * 0.5, 0) AS s FROM y)""", "integral", "series")
def _(spark, d):
    return regress.integrate_acf(acf(spark, d), 0.5)


@query("r4_log_linear", f"WITH {ACF} SELECT run, sum(lag * lag) / nullif(sum(-ln(c) * lag), 0) AS tau, count(*) AS n FROM acf WHERE c > 0 GROUP BY run", "tau", "series")
def _(spark, d):
    return regress.fit_log_linear(acf(spark, d), ["run"])


@query("r5_fit_line", """SELECT state, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept, regr_r2(value, idx) AS r2, 1 - (1 - regr_r2(value, idx)) * (count(*) - 1) / (count(*) - 2) AS adj_r2, sqrt(sse / n) AS rmse, sqrt(sse / (n - 2) / sxx) AS se_slope, sqrt(sse / (n - 2) * (1 / n + mx * mx / sxx)) AS se_intercept
FROM series JOIN (SELECT state, count(*) AS n, regr_sxx(value, idx) AS sxx, regr_avgx(value, idx) AS mx, regr_syy(value, idx) - regr_sxy(value, idx) ** 2 / regr_sxx(value, idx) AS sse FROM series GROUP BY state) USING (state) GROUP BY state, sse, n, sxx, mx""", "slope intercept r2 adj_r2 rmse se_slope se_intercept", "series")
def _(spark, d):
    x = regress.fit_line(series(spark, d).withColumn("idx", F.col("idx").cast("double")), "idx", "value", ["state"])
    return x.select("state", "slope", "intercept", "r2", "adj_r2", "rmse", "se_slope", "se_intercept")


@query("r5_fit_plane", """WITH x AS (SELECT state, value AS y, CAST(idx AS DOUBLE) AS a, CAST(idx * idx % 17 AS DOUBLE) AS b FROM series), s AS (SELECT state, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x GROUP BY state),
c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM s) SELECT state, my - c1 * ma - c2 * mb AS c0, c1, c2, (c1 * ay + c2 * byy) / yy AS r2 FROM c""", "c0 c1 c2 r2", "series")
def _(spark, d):
    x = series(spark, d).select("state", "value", F.col("idx").cast("double").alias("a"), (F.col("idx") * F.col("idx") % 17).cast("double").alias("b"))
    return regress.fit_plane(x, "a", "b", "value", ["state"]).select("state", "c0", "c1", "c2", "r2")


TAIL = """CASE WHEN (n - 2) % 2 = 0 THEN sin(th) * list_sum([exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * cos(th) ** (2 * k) FOR k IN range((n - 2) // 2)])
ELSE 2 / pi() * (th + sin(th) * list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * cos(th) ** (2 * k + 1) FOR k IN range((n - 3) // 2)])) END"""


@query("r5_slope_p", f"""WITH s AS (SELECT state, count(*) AS n, regr_slope(value, idx) AS slope, sqrt((regr_syy(value, idx) - regr_sxy(value, idx) ** 2 / regr_sxx(value, idx)) / (count(*) - 2) / regr_sxx(value, idx)) AS se FROM series GROUP BY state), t AS (SELECT *, atan(abs(slope / se) / sqrt(n - 2.0)) AS th FROM s)
SELECT state, slope, 1 - ({TAIL}) AS p_slope FROM t""", "slope p_slope", "series")
def _(spark, d):
    return regress.fit_line(series(spark, d).withColumn("idx", F.col("idx").cast("double")), "idx", "value", ["state"]).select("state", "slope", "p_slope")


@query("r4_fit_decay")
def _(spark, d):
    return regress.fit_decay(acf(spark, d), ["run"], 2.0)


@query("a14_exchange_acceptance", """WITH x AS (SELECT turn AS exchange, conv_id % 7 AS low, conv_id % 7 + 1 AS high, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS ok, conv_id FROM conversations), o AS (SELECT conv_id // 7 AS grp, exchange, low, high, max(ok) AS ok, max(ok) <> min(ok) AS bad FROM x GROUP BY ALL)
SELECT low, high, count(*) AS attempts, CAST(sum(ok) AS BIGINT) AS accepts, 100.0 * avg(ok) AS percent, count(*) FILTER (bad) AS mismatches FROM o GROUP BY low, high""", "percent")
def _(spark, d):
    c = read(spark, d, "conversations").select((F.floor(F.col("conv_id") / 7)).alias("grp"), F.col("turn").alias("exchange"), (F.col("conv_id") % 7).alias("replica"), (F.col("conv_id") % 7 + 1).alias("partner"), (F.coalesce("role", F.lit("")) == "user").alias("success"))
    one = c.select("grp", F.struct("grp", "exchange").alias("exchange"), "replica", "partner", "success")
    return agg.exchange_acceptance(one, [])


def walkers(spark, d):
    c = read(spark, d, "conversations").where("turn is not null")
    x = c.select((F.col("conv_id") % 20).alias("run"), (F.floor(F.col("conv_id") / 20) * 10 + F.col("turn")).alias("step"), (F.col("turn") % 4).cast("int").alias("low"), (F.coalesce("role", F.lit("")) == "user").alias("accepted"))
    return events.walker_positions(x.groupBy("run", "step", "low").agg(F.max("accepted").alias("accepted")))


WALK = """x AS (SELECT conv_id % 20 AS run, conv_id // 20 * 10 + turn AS step, turn % 4 AS low, bool_or(coalesce(role, '') = 'user') AS ok FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, low) AS k, max(low) OVER (PARTITION BY run) + 2 AS n, lead(step) OVER (PARTITION BY run ORDER BY step, low) IS DISTINCT FROM step AS ends FROM x),
wk AS (SELECT run, 0 AS k, range(max(n)) AS here, 0::BIGINT AS step, false AS ends FROM o GROUP BY run UNION ALL SELECT wk.run, o.k, CASE WHEN o.ok THEN [CASE WHEN i = o.low THEN wk.here[o.low + 2] WHEN i = o.low + 1 THEN wk.here[o.low + 1] ELSE wk.here[i + 1] END FOR i IN range(o.n)] ELSE wk.here END, o.step, o.ends FROM wk JOIN o ON o.run = wk.run AND o.k = wk.k + 1),
pos AS (SELECT run, step, CAST(here[i + 1] AS INTEGER) AS walker, CAST(i AS INTEGER) AS place FROM (SELECT *, unnest(range(len(here))) AS i FROM wk WHERE k > 0 AND ends))"""


@query("t12_walker_positions", f"WITH {WALK} SELECT run, step, walker, place FROM pos")
def _(spark, d):
    return walkers(spark, d)


@query("t13_round_trips", f"""WITH {WALK}, e AS (SELECT run || '-' || walker AS walker, step, place, lag(place) OVER (PARTITION BY run, walker ORDER BY step) AS p FROM pos WHERE place IN (0, 2)), d AS (SELECT *, row_number() OVER w - 1 AS n, lag(step, 2) OVER w AS back FROM e WHERE p IS NULL OR p <> place WINDOW w AS (PARTITION BY walker ORDER BY step))
SELECT walker, count(*) AS n_trips, avg(step - back) AS mean_steps FROM d WHERE n >= 2 AND n % 2 = 0 GROUP BY walker""", "mean_steps")
def _(spark, d):
    w = walkers(spark, d)
    return events.round_trips(w.withColumn("walker", F.concat_ws("-", "run", "walker")), 0, 2)
