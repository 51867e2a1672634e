"""Queries over frames of atoms: selections, pair joins, geometry, graphs. Atoms come from the lineitem table."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions import exprs as X
from ..operators import agg, align, density, events, geometry, graph, pairs
from ..operators.cells import with_cells
from ..sources import scans
from ..sources.tables import BOX, atoms
from .live import landed
from .registry import query



def O():  # noqa: E743
    return F.col("element") == "O"


def H():
    return F.col("element") == "H"


def C():
    return F.col("element") == "C"


#: Minimum-image distance of a and b, and single components, in SQL.
D = "sqrt((a.x-b.x - 50*round_even((a.x-b.x)/50, 0))**2 + (a.y-b.y - 50*round_even((a.y-b.y)/50, 0))**2 + (a.z-b.z - 50*round_even((a.z-b.z)/50, 0))**2)"


def pairs_sql(ea: str, eb: str, cutoff: float | None = None, more: str = "") -> str:
    cut = f" AND {D} <= {cutoff}" if cutoff else ""
    return f"SELECT a.frame, a.run, a.atom_id AS i, b.atom_id AS j, {D} AS d{more} FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id <> b.atom_id WHERE a.element IN ({ea}) AND b.element IN ({eb}){cut}"


@query("p2_atom_group", "SELECT frame, count(*) AS n FROM atoms WHERE (element = 'H' AND atom_id > 2) OR atom_id IN (1, 2) GROUP BY frame", "", "atoms")
def _(spark, d):
    return atoms(spark, d).where((H() & (F.col("atom_id") > 2)) | F.col("atom_id").isin(1, 2)).groupBy("frame").agg(F.count("*").alias("n"))


def solvent_start(df):
    """Atom id at which the first O, H, H pattern of a frame starts."""
    w = Window.partitionBy("frame").orderBy("atom_id")
    p = df.withColumns({"_1": F.lead("element", 1).over(w), "_2": F.lead("element", 2).over(w)})
    return p.where((F.col("element") == "O") & (F.col("_1") == "H") & (F.col("_2") == "H")).groupBy("frame").agg(F.min("atom_id").alias("start"))


@query("p6_infer_solvent", """WITH p AS (SELECT frame, atom_id, element, lead(element, 1) OVER w AS e1, lead(element, 2) OVER w AS e2 FROM atoms WINDOW w AS (PARTITION BY frame ORDER BY atom_id)), s AS (SELECT frame, min(atom_id) AS start FROM p WHERE element = 'O' AND e1 = 'H' AND e2 = 'H' GROUP BY frame)
SELECT a.frame, a.atom_id FROM atoms a JOIN s USING (frame) WHERE a.element = 'O' AND a.atom_id >= s.start""", "", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return a.join(solvent_start(a), "frame").where(O() & (F.col("atom_id") >= F.col("start"))).select("frame", "atom_id")


@query("p12_water_density", """SELECT run, n, n * 18.01528 / (0.602214076 * 50.0**3) AS rho, cbrt(n * 18.01528 / (0.602214076 * 50.0**3) / 0.997) AS scale FROM (SELECT run, count(*) AS n FROM atoms WHERE element = 'O' GROUP BY run)""", "rho scale", "atoms")
def _(spark, d):
    rho = F.col("n") * 18.01528 / (0.602214076 * BOX**3)
    return atoms(spark, d).where(O()).groupBy("run").agg(F.count("*").alias("n")).select("run", "n", rho.alias("rho"), F.cbrt(rho / 0.997).alias("scale"))


@query("g1_min_image", f"SELECT a.frame, {D} AS d FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id = 1 AND b.atom_id = 2", "d", "atoms")
def _(spark, d):
    return geometry.distance(atoms(spark, d), 1, 2, BOX)


@query("g2_centroid_distance", """SELECT frame, sqrt((ax-bx)**2 + (ay-byy)**2 + (az-bz)**2) AS d FROM (SELECT frame, avg(x) FILTER (element='O') AS ax, avg(y) FILTER (element='O') AS ay, avg(z) FILTER (element='O') AS az, avg(x) FILTER (element='H') AS bx, avg(y) FILTER (element='H') AS byy, avg(z) FILTER (element='H') AS bz FROM atoms GROUP BY frame) WHERE ax IS NOT NULL AND bx IS NOT NULL""", "d", "atoms")
def _(spark, d):
    return geometry.centroid_distance(atoms(spark, d), O(), H())


@query("g3_coordination", f"WITH p AS ({pairs_sql(chr(39) + 'O' + chr(39), chr(39) + 'H' + chr(39))}) SELECT frame, sum(CASE WHEN abs(1 - (d/10.0)**12) < 1e-12 THEN 0.5 ELSE (1 - (d/10.0)**6) / (1 - (d/10.0)**12) END) AS coordination FROM p GROUP BY frame", "coordination", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.coordination(a.where(O()), a.where(H()), 10.0, 6, 12, BOX)


@query("g4_mean_group_distance", f"WITH p AS ({pairs_sql(chr(39) + 'O' + chr(39), chr(39) + 'H' + chr(39))}) SELECT frame, avg(d) AS mean_d FROM p GROUP BY frame", "mean_d", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.mean_group_distance(a.where(O()), a.where(H()), BOX)


@query("g5_soft_min_distance", f"WITH p AS ({pairs_sql(chr(39) + 'O' + chr(39), chr(39) + 'C' + chr(39))}) SELECT frame, CASE WHEN min(d) <= 1e-12 THEN 0 ELSE 20.0 / ln(sum(exp(20.0 / d))) END AS soft_min FROM p GROUP BY frame", "soft_min", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.soft_min_distance(a.where(O()), a.where(C()), 20.0, BOX)


@query("g6_lcod", f"""SELECT frame, p.d - q.d AS lcod FROM (SELECT a.frame, {D} AS d FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id = 1 AND b.atom_id = 2) p JOIN (SELECT a.frame, {D} AS d FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id = 2 AND b.atom_id = 3) q USING (frame)""", "lcod", "atoms")
def _(spark, d):
    return geometry.lcod(atoms(spark, d), 1, 2, 2, 3, BOX)


def vec(p: str, q: str) -> str:
    return ", ".join(f"p{q}{c}-p{p}{c} - 50*round_even((p{q}{c}-p{p}{c})/50, 0) AS {p}{q}{c}" for c in "xyz")


def pivot(n: int) -> str:
    """One row a frame with coordinates p<id><axis> of the first n atoms."""
    cols = ", ".join(f"max({c}) FILTER (atom_id = {i}) AS p{i}{c}" for i in range(1, n + 1) for c in "xyz")
    return f"pv AS (SELECT frame, {cols} FROM atoms GROUP BY frame)"


def imaged(e: str) -> str:
    return f"(({e}) - 50*round_even(({e})/50, 0))"


def arrow(i: int, j: int) -> list[str]:
    """Imaged vector between two pivoted atoms."""
    return [imaged(f"p{j}{c} - p{i}{c}") for c in "xyz"]


def named(name: str, v: list[str]) -> str:
    return ", ".join(f"{e} AS {name}{c}" for e, c in zip(v, "xyz"))


def col(name: str) -> list[str]:
    return [f"{name}{c}" for c in "xyz"]


def crossed(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]}*{b[j]} - {a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def dotted(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"


def length(a: list[str]) -> str:
    return f"sqrt{dotted(a, a)}"


def torsion(u: list[str], v: list[str], w: list[str]) -> str:
    m, n = crossed(u, v), crossed(v, w)
    return f"CASE WHEN {length(m)} > 1e-12 AND {length(n)} > 1e-12 THEN degrees(atan2({dotted(crossed(m, n), v)} / nullif({length(v)}, 0), {dotted(m, n)})) END"


PIVOT = "pv AS (SELECT frame, " + ", ".join(f"max({c}) FILTER (atom_id = {i}) AS p{n}{c}" for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")) for c in "xyz") + " FROM atoms GROUP BY frame)"


@query("g7_dihedral", f"""WITH {PIVOT}, v AS (SELECT frame, {vec('a', 'b')}, {vec('b', 'c')}, {vec('c', 'd')} FROM pv WHERE pdx IS NOT NULL),
n AS (SELECT *, aby*bcz-abz*bcy AS mx, abz*bcx-abx*bcz AS my, abx*bcy-aby*bcx AS mz, bcy*cdz-bcz*cdy AS nx, bcz*cdx-bcx*cdz AS ny, bcx*cdy-bcy*cdx AS nz FROM v)
SELECT frame, CASE WHEN sqrt(mx*mx+my*my+mz*mz) > 1e-12 AND sqrt(nx*nx+ny*ny+nz*nz) > 1e-12 THEN degrees(atan2(((my*nz-mz*ny)*bcx + (mz*nx-mx*nz)*bcy + (mx*ny-my*nx)*bcz) / nullif(sqrt(bcx*bcx+bcy*bcy+bcz*bcz), 0), mx*nx+my*ny+mz*nz)) END AS phi FROM n""", "phi", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    some = a.groupBy("frame").agg(F.max("atom_id").alias("n")).where("n >= 4").select("frame")
    return geometry.dihedrals(a.join(some, "frame", "left_semi"), {"phi": (1, 2, 3, 4)}, BOX)


@query("g8_improper_bend", f"""WITH {pivot(4)}, v AS (SELECT frame, {named('a', arrow(1, 2))}, {named('q', arrow(1, 3))}, {named('t', arrow(3, 4))} FROM pv), n AS (SELECT *, {named('n', crossed(col('a'), col('q')))} FROM v)
SELECT frame, degrees(asin(greatest(-1, least(1, {dotted(col('n'), col('t'))} / ({length(col('n'))} * {length(col('t'))}))))) AS bend FROM n WHERE {length(col('n'))} * {length(col('t'))} > 0""", "bend", "atoms")
def _(spark, d):
    return known(geometry.improper_bend(atoms(spark, d), [1, 2, 3], 3, 4, BOX), "bend")


@query("g9_ring_center", f"""WITH {PIVOT}, v AS (SELECT *, {vec('a', 'b')}, {vec('a', 'c')} FROM pv WHERE pcx IS NOT NULL) SELECT frame, {', '.join(f'pa{c} + (ab{c} + ac{c}) / 3 AS {c}' for c in 'xyz')} FROM v""", "x y z", "atoms")
def _(spark, d):
    return geometry.ring_center(atoms(spark, d), [1, 2, 3], BOX)


@query("g9_ring_distance", f"""WITH {pivot(3)}, c AS (SELECT frame, {', '.join(f"p1{c} + ({imaged(f'p2{c} - p1{c}')} + {imaged(f'p3{c} - p1{c}')}) / 3 AS c{c}" for c in 'xyz')} FROM pv),
q AS (SELECT frame, arg_max(atom_id, (-z / 100, atom_id)) AS atom_id FROM atoms WHERE element = 'O' AND atom_id > 3 AND -z / 100 BETWEEN -0.4 AND -0.1 GROUP BY frame)
SELECT a.frame, sqrt({' + '.join(imaged(f'c{c} - a.{c}') + '**2' for c in 'xyz')}) AS ring_a FROM q JOIN atoms a ON a.frame = q.frame AND a.atom_id = q.atom_id LEFT JOIN c ON c.frame = a.frame""", "ring_a", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    q = agg.positive_defect(a.where("element = 'O' and atom_id > 3").withColumn("q", -F.col("z") / 100), "q", -0.4, -0.1, ["frame"]).where("defect is not null")
    return geometry.ring_distance(a, q.select("frame", F.col("defect").alias("atom_id")), {"ring_a": [1, 2, 3]}, BOX)


@query("g10_helicity", f"""WITH {pivot(7)}, r AS (SELECT frame, {', '.join(f"p{i}{c} + {imaged(f'p{j}{c} - p{i}{c}')} / 2 AS r{k}{c}" for k, (i, j) in enumerate(((1, 2), (3, 4), (5, 6), (6, 7))) for c in 'xyz')} FROM pv WHERE p7x IS NOT NULL),
b AS (SELECT frame, {', '.join(named(f'b{k}', [imaged(f'r{k + 1}{c} - r{k}{c}') for c in 'xyz']) for k in range(3))} FROM r) SELECT frame, {torsion(col('b0'), col('b1'), col('b2'))} AS helicity FROM b""", "helicity", "atoms")
def _(spark, d):
    return geometry.helicity(atoms(spark, d), [[1, 2], [3, 4], [5, 6], [6, 7]], BOX)


@query("g11_ring_planarity", f"""WITH {pivot(6)}, v AS (SELECT frame, {', '.join(named(f'v{k}', arrow(k + 1, (k + 1) % 6 + 1)) for k in range(6))} FROM pv WHERE p6x IS NOT NULL),
t AS (SELECT frame, {', '.join(f"{torsion(col(f'v{k}'), col(f'v{(k + 1) % 6}'), col(f'v{(k + 2) % 6}'))} + 90 AS t{k}" for k in range(6))} FROM v)
SELECT frame, ({' + '.join(f'abs(t{k} - 180 * floor(t{k} / 180) - 90)' for k in range(6))}) / 6 AS planarity FROM t WHERE {' AND '.join(f't{k} IS NOT NULL' for k in range(6))}""", "planarity", "atoms")
def _(spark, d):
    return known(geometry.ring_planarity(atoms(spark, d), [1, 2, 3, 4, 5, 6], BOX), "planarity")


@query("g12_bond_angle", f"""WITH {PIVOT}, v AS (SELECT frame, {vec('b', 'a')}, {vec('b', 'c')} FROM pv WHERE pcx IS NOT NULL), l AS (SELECT *, sqrt(bax*bax+bay*bay+baz*baz) AS la, sqrt(bcx*bcx+bcy*bcy+bcz*bcz) AS lc FROM v)
SELECT frame, degrees(acos(greatest(-1, least(1, (bax*bcx+bay*bcy+baz*bcz) / (la * lc))))) AS angle FROM l WHERE la * lc > 0""", "angle", "atoms")
def _(spark, d):
    return geometry.bond_angle(atoms(spark, d), 1, 2, 3, BOX)


#: The trace of the rotated products is the largest root of (L^2 - tr H'H)^2 - 8 det(H) L - 4 C; from half of e0, which is above it, Newton steps only fall. Straight groups (C = 0) have a double root there, the root of the trace.
RMSD = """f AS (SELECT run, frame, count(*) AS n FROM atoms GROUP BY ALL), r0 AS (SELECT run, arg_min(frame, (-n, frame)) AS frame FROM f GROUP BY run), r AS (SELECT a.run, a.atom_id, a.x AS u, a.y AS v, a.z AS w FROM atoms a JOIN r0 USING (run, frame)),
j AS (SELECT a.run, a.frame, a.x, a.y, a.z, u, v, w FROM atoms a JOIN r USING (run, atom_id)), c AS (SELECT run, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(u) AS cu, avg(v) AS cv, avg(w) AS cw FROM j GROUP BY ALL),
k AS (SELECT run, frame, x - cx AS x, y - cy AS y, z - cz AS z, u - cu AS u, v - cv AS v, w - cw AS w FROM j JOIN c USING (run, frame)),
h AS (SELECT run, frame, count(*) AS n, sum(x*x + y*y + z*z + u*u + v*v + w*w) AS e0, sum(x*u) AS a, sum(x*v) AS b, sum(x*w) AS c, sum(y*u) AS d, sum(y*v) AS e, sum(y*w) AS f, sum(z*u) AS g, sum(z*v) AS h, sum(z*w) AS i FROM k GROUP BY ALL),
p AS (SELECT run, frame, n, e0, a*a+b*b+c*c+d*d+e*e+f*f+g*g+h*h+i*i AS t, a*(e*i-f*h) - b*(d*i-f*g) + c*(d*h-e*g) AS det, (e*i-f*h)**2+(d*i-f*g)**2+(d*h-e*g)**2+(b*i-c*h)**2+(a*i-c*g)**2+(a*h-b*g)**2+(b*f-c*e)**2+(a*f-c*d)**2+(a*e-b*d)**2 AS m FROM h),
s AS (SELECT *, 0 AS step, e0 / 2 AS l FROM p UNION ALL SELECT run, frame, n, e0, t, det, m, step + 1, CASE WHEN 4*l*(l*l - t) - 8*det > 1e-9 * l*l*l THEN l - ((l*l - t)**2 - 8*det*l - 4*m) / (4*l*(l*l - t) - 8*det) ELSE l END FROM s WHERE step < 60)"""


@query("g13_rmsd", f"WITH {RMSD} SELECT run, frame, n, round(sqrt(greatest(0, (e0 - 2 * CASE WHEN m <= 1e-20 * t * t THEN sqrt(t) ELSE l END) / n)), 4) AS rmsd FROM s WHERE step = 60", "rmsd", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    first = a.groupBy("run", "frame").agg(F.count("*").alias("n")).groupBy("run").agg(F.min(F.struct(-F.col("n"), "frame")).alias("m")).select("run", "m.frame")
    return geometry.rmsd(a, a.join(first, ["run", "frame"]).select("run", "atom_id", "x", "y", "z")).withColumn("rmsd", F.round("rmsd", 4))


@query("g13_rmsd_moved", """WITH c AS (SELECT frame, count(*) AS n, var_pop(x) + var_pop(y) + var_pop(z) AS v FROM atoms GROUP BY frame) SELECT frame, n, round((0.05 + frame % 7 * 0.02) * sqrt(v), 4) AS rmsd FROM c""", "rmsd", "atoms")
def _(spark, d):
    # frames turned about two axes, moved and stretched: what is left after the best fit is the stretch of the radius of gyration
    a = atoms(spark, d)
    by, p, q = 1.05 + F.col("frame") % 7 * 0.02, F.col("frame") % 11 * 0.3, F.col("frame") % 13 * 0.4
    x, y = F.cos(p) * F.col("x") - F.sin(p) * F.col("y"), F.sin(p) * F.col("x") + F.cos(p) * F.col("y")
    moved = a.select("frame", "atom_id", (by * x + F.col("frame") % 5).alias("x"), (by * (F.cos(q) * y - F.sin(q) * F.col("z")) - 3).alias("y"), (by * (F.sin(q) * y + F.cos(q) * F.col("z"))).alias("z"))
    return geometry.rmsd(moved, a.select("frame", "atom_id", "x", "y", "z"), ("frame",), ("frame",)).withColumn("rmsd", F.round("rmsd", 4))


@query("g14_radgyr", """WITH m AS (SELECT a.*, CASE element WHEN 'O' THEN 15.999 WHEN 'H' THEN 1.008 ELSE 12.011 END AS mass FROM atoms a), c AS (SELECT frame, sum(mass) AS w, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM m GROUP BY frame)
SELECT frame, sqrt(sum(mass*((x-cx)**2+(y-cy)**2+(z-cz)**2)) / any_value(w)) AS rg, sqrt(max((x-cx)**2+(y-cy)**2+(z-cz)**2)) AS max_d FROM m JOIN c USING (frame) GROUP BY frame""", "rg max_d", "atoms")
def _(spark, d):
    masses = spark.createDataFrame([("O", 15.999), ("H", 1.008), ("C", 12.011)], "element string, mass double")
    return geometry.radgyr(atoms(spark, d), masses)


DOT = " + ".join(f"(a.{k}-h.{k} - 50*round_even((a.{k}-h.{k})/50, 0)) * (c.{k}-h.{k} - 50*round_even((c.{k}-h.{k})/50, 0))" for k in "xyz")
HB = f"""hb AS (SELECT a.frame, a.atom_id AS donor, h.atom_id AS h, c.atom_id AS acceptor, c.d, degrees(acos(greatest(-1, least(1, ({DOT}) / nullif(g.d * e.d, 0))))) AS angle FROM atoms a
JOIN ({pairs_sql("'O'", "'H'", 12)}) g ON g.frame = a.frame AND g.i = a.atom_id JOIN atoms h ON h.frame = g.frame AND h.atom_id = g.j
JOIN (SELECT p.*, q.atom_id, q.x, q.y, q.z FROM ({pairs_sql("'O'", "'O'", 16)}) p JOIN atoms q ON q.frame = p.frame AND q.atom_id = p.j) c ON c.frame = a.frame AND c.i = a.atom_id
JOIN ({pairs_sql("'H'", "'O'")}) e ON e.frame = a.frame AND e.i = h.atom_id AND e.j = c.atom_id)"""


def known(df, name: str):
    """Rows with a value. The explode of one value keeps the filter above the formula; moved below it, it would hold the whole formula written out."""
    return df.withColumn(name, F.explode(F.array(name))).where(F.col(name).isNotNull())


def bonds(spark, d):
    a = atoms(spark, d)
    return pairs.hbonds(a.where(O()), a.where(H()), a.where(O()), 12.0, 16.0, 90.0, BOX)


@query("g15_hbonds", f"WITH {HB} SELECT frame, donor, h, acceptor, d, angle FROM hb WHERE angle >= 90", "d angle", "atoms")
def _(spark, d):
    return bonds(spark, d)


@query("g16_hbond_lifetime", f"""WITH {HB}, s AS (SELECT run, frame, row_number() OVER (PARTITION BY run ORDER BY frame) AS t, frame IN (SELECT frame FROM hb WHERE angle >= 90) AS bound FROM (SELECT DISTINCT run, frame FROM atoms)),
i AS (SELECT run, count(*) AS n FROM (SELECT run, t - row_number() OVER (PARTITION BY run ORDER BY t) AS g FROM s WHERE bound) GROUP BY run, g) SELECT run, count(*) AS n, max(n) AS longest, avg(n) AS mean FROM i GROUP BY run""", "mean", "atoms")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("frame")
    b = bonds(spark, d).select("frame").distinct().withColumn("on", F.lit(True))
    a = atoms(spark, d).select("run", "frame").distinct().join(b, "frame", "left").withColumn("t", F.row_number().over(w).cast("double"))
    x = events.islands(a, F.col("on"))
    return x.groupBy("run").agg(F.count("*").alias("n"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


@query("g17_nearest_solute_atom", f"""WITH q AS (SELECT frame, atom_id, x, y, z, run FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY atom_id) AS k FROM atoms WHERE element = 'H') WHERE k = 1)
SELECT q.frame, CAST(coalesce(m.j, -1) AS BIGINT) AS nearest, m.d FROM q LEFT JOIN (SELECT a.frame, arg_min(b.atom_id, ({D}, b.atom_id)) AS j, min({D}) AS d FROM q a JOIN atoms b ON a.frame = b.frame AND a.atom_id <> b.atom_id WHERE b.element = 'C' GROUP BY a.frame) m USING (frame)""", "d", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    first = a.where(H()).groupBy("frame").agg(F.min("atom_id").alias("atom_id"))
    return pairs.nearest_solute_atom(a.join(first, ["frame", "atom_id"]), a.where(C()), BOX)


@query("g18_farthest_water", f"""WITH p AS ({pairs_sql("'O'", "'C'")}), m AS (SELECT frame, i, min(d) AS d FROM p GROUP BY frame, i) SELECT frame, arg_max(i, (d, -i)) AS water, max(d) AS d FROM m GROUP BY frame""", "d", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.farthest_water(a.where(O()), a.where(C()), BOX)


@query("g18_common_water", f"""WITH w AS (SELECT *, frame // 2 AS grp FROM atoms WHERE element = 'O'), n AS (SELECT grp, count(DISTINCT frame) AS n FROM w GROUP BY grp),
x AS (SELECT a.grp, a.frame, a.atom_id AS i, min({D}) AS d FROM w a JOIN atoms b ON a.frame = b.frame AND a.atom_id <> b.atom_id AND b.element = 'C' GROUP BY ALL),
y AS (SELECT grp, i, min(d) AS least, avg(d) AS mean, count(*) AS c FROM x GROUP BY ALL) SELECT grp, arg_max(i, (least, mean, -i)) AS water, max(least) AS least, arg_max(mean, (least, mean, -i)) AS mean FROM y JOIN n USING (grp) WHERE c = n GROUP BY grp""", "least mean", "atoms")
def _(spark, d):
    a = atoms(spark, d).withColumn("grp", F.floor(F.col("frame") / 2))
    return pairs.common_water(a.where(O()), a.where(C()).select("grp", "frame", "atom_id", "x", "y", "z"), BOX, "grp")


@query("g19_select_acceptor", f"""WITH own AS (SELECT frame, i AS h, arg_min(j, (d, j)) AS donor FROM ({pairs_sql("'H'", "'O'", 3)}) GROUP BY ALL), x AS (SELECT p.frame, p.i AS h, p.j AS acceptor, p.d, own.donor FROM ({pairs_sql("'H'", "'O'", 16)}) p JOIN own ON own.frame = p.frame AND own.h = p.i WHERE p.j <> own.donor),
y AS (SELECT x.*, {DOT} AS dot, {D.replace('a.', 'h.').replace('b.', 'a.')} * {D.replace('a.', 'h.').replace('b.', 'c.')} AS len FROM x JOIN atoms h ON h.frame = x.frame AND h.atom_id = x.h JOIN atoms a ON a.frame = x.frame AND a.atom_id = x.donor JOIN atoms c ON c.frame = x.frame AND c.atom_id = x.acceptor),
z AS (SELECT *, NOT coalesce(d <= 8 AND degrees(acos(greatest(-1, least(1, dot / nullif(len, 0))))) >= 100 AND len > 0, false) AS no FROM y)
SELECT frame, h, arg_min(acceptor, (no, d, acceptor)) AS acceptor, arg_min(d, (no, d, acceptor)) AS d, NOT arg_min(no, (no, d, acceptor)) AS is_hbond FROM z GROUP BY ALL""", "d", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.select_acceptor(a.where(H()), a.where(O()), a.where(O()), 8.0, 100.0, BOX)


@query("g20_sasa", """WITH k AS (SELECT k, 1 - (2 * k + 1) / 60.0 AS kz, sqrt(1 - (1 - (2 * k + 1) / 60.0) ** 2) AS rho, k * 2.399963229728653 AS phi FROM range(0, 60) r(k)),
t AS (SELECT frame, atom_id AS i, k, x + 8 * rho * cos(phi) AS px, y + 8 * rho * sin(phi) AS py, z + 8 * kz AS pz FROM atoms, k WHERE element = 'C'),
h AS (SELECT DISTINCT t.frame, t.i, t.k FROM t JOIN atoms b ON b.frame = t.frame AND b.atom_id <> t.i WHERE sqrt((b.x-px - 50*round_even((b.x-px)/50, 0))**2 + (b.y-py - 50*round_even((b.y-py)/50, 0))**2 + (b.z-pz - 50*round_even((b.z-pz)/50, 0))**2) < 8)
SELECT t.frame, t.i, count(*) FILTER (h.k IS NULL) / 60.0 * 4 * pi() * 64 AS area FROM t LEFT JOIN h USING (frame, i, k) GROUP BY ALL""", "area", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.sasa(a.where(C()), a, 8.0, 60, BOX)


@query("g21_group_min_distance", f"""WITH p AS ({pairs_sql("'O','C','H'", "'O','C','H'", 12)}) SELECT frame, least((i - 1) // 3, (j - 1) // 3) AS mol_a, greatest((i - 1) // 3, (j - 1) // 3) AS mol_b, min(d) AS d, min(d) <= 6 AS contact FROM p WHERE (i - 1) // 3 <> (j - 1) // 3 GROUP BY ALL""", "d", "atoms")
def _(spark, d):
    a = atoms(spark, d).withColumn("mol", F.floor((F.col("atom_id") - 1) / 3))
    return pairs.contacts(a, "mol", 6.0, 12.0, BOX)


@query("g23_slab_density", """WITH c AS (SELECT frame, CAST(least(floor(z / 5.0), 9) AS INTEGER) AS slab, count(*) AS c FROM atoms GROUP BY ALL), n AS (SELECT count(DISTINCT frame) AS n FROM atoms)
SELECT slab, sum(c) / n / 12500.0 AS mean, sqrt(greatest(0, sum(c * c) / n - (sum(c) / n) ** 2)) / 12500.0 AS sd FROM c, n GROUP BY slab, n""", "mean sd", "atoms")
def _(spark, d):
    return geometry.slab_density(atoms(spark, d), "z", 5.0, BOX, BOX * BOX)


@query("g24_endpoint_coordination", f"""SELECT a.frame, a.atom_id AS endpoint, sum(1 / (1 + ({D} / 8.0) ** 6)) AS coordination FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id <> b.atom_id WHERE a.atom_id IN (1, 2) AND b.element = 'H' GROUP BY ALL""", "coordination", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    x = pairs.all_pairs(a.where("atom_id in (1, 2)"), a.where(H()), BOX)
    return x.groupBy("frame", F.col("i").alias("endpoint")).agg(F.sum(1 / (1 + F.pow(F.col("d") / 8.0, F.lit(6)))).alias("coordination"))


@query("j9_neighbour_pairs", pairs_sql("'O'", "'H'", 9).replace("a.run, ", ""), "d", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.neighbour_pairs(a.where(O()), a.where(H()), 9.0, BOX).select("frame", "i", "j", "d")


#: Frames of a few hundred atoms: many orders as one frame.
DENSE = "dn AS (SELECT run, frame // 800 AS frame, frame * 100 + atom_id AS atom_id, element, x, y, z FROM atoms)"


def dense(spark, d):
    a = atoms(spark, d)
    return a.select("run", F.floor(F.col("frame") / 800).alias("frame"), (F.col("frame") * 100 + F.col("atom_id")).alias("atom_id"), "element", "x", "y", "z")


@query("j9_dense_frames", f"WITH {DENSE} SELECT a.frame, a.atom_id AS i, b.atom_id AS j, {D} AS d FROM dn a JOIN dn b ON a.frame = b.frame AND a.atom_id < b.atom_id WHERE a.element = 'O' AND b.element = 'O' AND {D} <= 4", "d", "atoms")
def _(spark, d):
    a = dense(spark, d).where(O())
    return pairs.neighbour_pairs(a, a, 4.0, BOX, half=True).select("frame", "i", "j", "d")


@query("h4_dense_rdf", f"""WITH {DENSE}, p AS (SELECT {D} AS d FROM dn a JOIN dn b ON a.frame = b.frame AND a.atom_id <> b.atom_id WHERE a.element = 'O' AND b.element = 'H' AND {D} < 6), c AS (SELECT count(*) AS centres FROM dn WHERE element = 'O' AND frame IS NOT NULL),
h AS (SELECT CAST(floor(d / 0.25) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY 1), b AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.25 AS lo FROM range(0, 24) r(i)), x AS (SELECT b.bin, lo, coalesce(h.n, 0) AS n FROM b LEFT JOIN h USING (bin))
SELECT bin, lo + 0.125 AS r, n, n / (centres * 0.0334 * 4.0 / 3.0 * pi() * ((lo + 0.25)**3 - lo**3)) AS g, sum(n) OVER (ORDER BY bin) / centres AS running FROM x, c""", "r g running", "atoms")
def _(spark, d):
    a = dense(spark, d)
    return pairs.rdf(a.where(O()), a.where(H()), 0.25, 6.0, BOX, rho=0.0334)


#: Cells by run: odd runs are triclinic. Rows of the cell are (ax, 0, 0), (bx, b, 0), (cx, cy, c).
CELL = {"ax": "50 + run", "bx": "run % 2 * 6", "b": "50 - run % 2 * 2", "cx": "run % 2 * -4", "cy": "run % 2 * 5", "c": "60 - run % 2 * 5"}
CELLED = f"""cl AS (SELECT run, frame // 8000 * 10 + run AS frame, frame * 100 + atom_id AS atom_id, element, x, y, z, {', '.join(f'{v} AS {k}' for k, v in CELL.items())} FROM atoms),
pr AS (SELECT a.frame, a.run, a.atom_id AS i, b.atom_id AS j, a.element AS ei, b.element AS ej, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, a.ax, a.bx, a.b, a.cx, a.cy, a.c FROM cl a JOIN cl b ON a.frame = b.frame AND a.atom_id <> b.atom_id),
n3 AS (SELECT *, round_even(dz / c, 0) AS n3, dz / c AS f3 FROM pr), n2 AS (SELECT *, (dy - f3 * cy) / b AS f2 FROM n3), n1 AS (SELECT *, round_even(f2, 0) AS n2, round_even((dx - f2 * bx - f3 * cx) / ax, 0) AS n1 FROM n2),
im AS (SELECT frame, run, i, j, ei, ej, sqrt((dx - (n1 * ax + n2 * bx + n3 * cx))**2 + (dy - (n2 * b + n3 * cy))**2 + (dz - n3 * c)**2) AS d FROM n1)"""


def celled(spark, d):
    """Atoms of runs with cells of their own, read back from text files with the cells' vectors."""
    e = lambda k: F.expr(CELL[k]).cast("string")
    text = F.concat(F.lit("header\nTV "), e("ax"), F.lit(" 0 0\nTV "), e("bx"), F.lit(" "), e("b"), F.lit(" 0\nTV "), e("cx"), F.lit(" "), e("cy"), F.lit(" "), e("c"), F.lit("\n"))
    a = atoms(spark, d)
    boxes = scans.scan_box(spark, landed(a.select("run").distinct().select("run", F.lit(0).alias("t"), text.alias("value"))))
    a = a.select("run", (F.floor(F.col("frame") / 8000) * 10 + F.col("run")).alias("frame"), (F.col("frame") * 100 + F.col("atom_id")).alias("atom_id"), "element", "x", "y", "z")
    return with_cells(a, boxes.select(F.col("run").cast("bigint").alias("run"), "cell"))


@query("j9_cells", f"WITH {CELLED} SELECT frame, run, i, j, d FROM im WHERE ei = 'O' AND ej = 'H' AND d <= 4.5", "d", "atoms")
def _(spark, d):
    a = celled(spark, d)
    return pairs.neighbour_pairs(a.where(O()), a.where(H()), 4.5, "cell", ("run", "frame")).select("frame", "run", "i", "j", "d")


@query("j10_cells", f"""WITH {CELLED}, r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS d2 FROM im WHERE ei = 'H' AND ej = 'O' AND d <= 6 WINDOW w AS (PARTITION BY frame, i ORDER BY d, j))
SELECT frame, i AS h, j AS nearest, CASE WHEN d2 IS NULL OR d2 - d >= 0.5 THEN j END AS owner, d AS d1, d2 FROM r WHERE k = 1 AND d <= 5.5""", "d1 d2", "atoms")
def _(spark, d):
    a = celled(spark, d)
    return pairs.nearest_owner(a.where(H()), a.where(O()), 5.5, 0.5, "cell")


@query("j10_nearest_owner", f"""WITH p AS ({pairs_sql("'H'", "'O','C'", 12)}), r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY frame, i ORDER BY d, j))
SELECT frame, i AS h, j AS nearest, CASE WHEN d2 IS NULL OR d2 - d >= 2 THEN j END AS owner, d AS d1, d2 FROM r WHERE k = 1 AND d <= 10""", "d1 d2", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return pairs.nearest_owner(a.where(H()), a.where(O() | C()), 10.0, 2.0, BOX)


@query("j16_resolve_names", """WITH t AS (SELECT frame AS "system", element || CAST(atom_id % 3 AS VARCHAR) AS name, atom_id FROM atoms) SELECT "system", name, min(atom_id) AS atom_id FROM t WHERE name IN ('O1', 'H2') GROUP BY ALL HAVING count(*) = 1""", "", "atoms")
def _(spark, d):
    t = atoms(spark, d).select(F.col("frame").alias("system"), F.concat("element", (F.col("atom_id") % 3).cast("string")).alias("name"), "atom_id")
    names = t.where(F.col("name").isin("O1", "H2")).select("system", "name").distinct()
    return align.resolve_names(names, t)


@query("j17_align_states", """WITH a AS (SELECT frame, atom_id, x / 97 AS q FROM atoms WHERE element <> 'H' AND x > 10), b AS (SELECT frame, atom_id, y / 89 AS q FROM atoms WHERE element <> 'O'), c AS (SELECT frame, atom_id, coalesce(a.q, 0) AS q0, coalesce(b.q, 0) AS q1 FROM a FULL JOIN b USING (frame, atom_id))
SELECT frame, l / 4.0 AS "lambda", sum(q0 + (q1 - q0) * (l / 4.0)) AS total FROM c, range(0, 5) r(l) WHERE q0 <> 0 OR q1 <> 0 GROUP BY ALL""", '"lambda" total', "atoms")
def _(spark, d):
    a = atoms(spark, d)
    return align.state_totals(a.where(~H() & (F.col("x") > 10)).select("frame", "atom_id", (F.col("x") / 97).alias("q")), a.where(~O()).select("frame", "atom_id", (F.col("y") / 89).alias("q")), 4, ["frame", "atom_id"], ["frame"])


@query("h4_rdf", f"""WITH p AS ({pairs_sql("'O'", "'O'", 15)}), c AS (SELECT frame, count(*) AS n FROM atoms WHERE element = 'O' GROUP BY frame), t AS (SELECT sum(n) AS centres, sum(n * n) AS pairs FROM c),
h AS (SELECT CAST(floor(d / 0.5) AS INTEGER) AS bin, count(*) AS n FROM p WHERE d < 15 GROUP BY 1), b AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.5 AS lo FROM range(0, 30) r(i)), x AS (SELECT b.bin, lo, coalesce(h.n, 0) AS n FROM b LEFT JOIN h USING (bin))
SELECT bin, lo + 0.25 AS r, n, n * 125000.0 / (pairs * 4.0 / 3.0 * pi() * ((lo + 0.5)**3 - lo**3)) AS g, sum(n) OVER (ORDER BY bin) / centres AS running FROM x, t""", "r g running", "atoms")
def _(spark, d):
    a = atoms(spark, d).where(O())
    return pairs.rdf(a, a, 0.5, 15.0, BOX)


RDF = f"""p AS ({pairs_sql("'O'", "'O'", 15)}), c AS (SELECT frame, count(*) AS n FROM atoms WHERE element = 'O' GROUP BY frame), t AS (SELECT sum(n * n) AS pairs FROM c),
h AS (SELECT CAST(floor(d / 0.5) AS INTEGER) AS bin, count(*) AS n FROM p WHERE d < 15 GROUP BY 1), b AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.5 AS lo FROM range(0, 30) r(i)), g AS (SELECT b.bin, lo + 0.25 AS r, coalesce(h.n, 0) * 125000.0 / (pairs * 4.0 / 3.0 * pi() * ((lo + 0.5)**3 - lo**3)) AS g FROM t, b LEFT JOIN h USING (bin))"""


@query("h5_coordination_number", f"WITH {RDF}, s AS (SELECT bin, r, coalesce((g * r * r + lag(g * r * r) OVER w) / 2 * (r - lag(r) OVER w), 0) AS s FROM g WINDOW w AS (ORDER BY bin)) SELECT bin, r, 4 * pi() * 0.001 * sum(s) OVER (ORDER BY bin) AS cn FROM s", "r cn", "atoms")
def _(spark, d):
    a = atoms(spark, d).where(O())
    g = pairs.rdf(a, a, 0.5, 15.0, BOX).withColumn("key", F.lit(0))
    return density.coordination_number(g, 0.001, ["key"]).select("bin", "r", "cn")


@query("h10_density_basins3d")
def _(spark, d):
    a = atoms(spark, d).select((F.col("x") * 7.2).alias("a"), (F.col("y") * 7.2).alias("b"), (F.col("z") * 7.2).alias("c"))
    return density.density_basins3d(a, ["a", "b", "c"], 12, 0.001, bandwidth=24.0)


def wrapped_sql(n: int, sigma: float) -> str:
    """Three passes of a wrapped Gaussian over cells i, j, k."""
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = ", ".join(f"({k}, {v / sum(w)!r}::DOUBLE)" for k, v in zip(range(-reach, reach + 1), w))
    out = [f"WITH kn AS (SELECT * FROM (VALUES {kernel}) v(s, w)), c0 AS (SELECT CAST(floor(x * {n} / 50.0) AS BIGINT) % {n} AS i, CAST(floor(y * {n} / 50.0) AS BIGINT) % {n} AS j, CAST(floor(z * {n} / 50.0) AS BIGINT) % {n} AS k, CAST(count(*) AS DOUBLE) AS d FROM atoms GROUP BY 1, 2, 3)"]
    for m, axis in enumerate("ijk"):
        cols = ", ".join(f"(({c} + s) % {n} + {n}) % {n} AS {c}" if c == axis else c for c in "ijk")
        out.append(f"c{m + 1} AS (SELECT i, j, k, sum(d) AS d FROM (SELECT {cols}, d * w AS d FROM c{m}, kn) GROUP BY i, j, k)")
    return ", ".join(out) + f" SELECT i * {n * n} + j * {n} + k AS cell, d FROM c3"


@query("h10_wrapped_density", wrapped_sql(12, 0.8), "d", "atoms")
def _(spark, d):
    place = lambda c: F.floor(F.col(c) * 12 / 50.0) % 12
    counts = atoms(spark, d).groupBy((place("x") * 144 + place("y") * 12 + place("z")).alias("cell")).agg(F.count("*").cast("double").alias("d"))
    return density.wrapped_gaussian(counts, 12, 0.8)


@query("a1_atomic_charge", "SELECT frame, atom_id, sum(q) AS q, count(*) AS n_orbitals FROM (SELECT frame, atom_id, x / 100 AS q FROM atoms UNION ALL SELECT frame, atom_id, -z / 100 FROM atoms WHERE element <> 'H') GROUP BY ALL", "q", "atoms")
def _(spark, d):
    a = atoms(spark, d)
    orb = a.select("frame", "atom_id", (F.col("x") / 100).alias("q")).unionByName(a.where(~H()).select("frame", "atom_id", (-F.col("z") / 100).alias("q")))
    return agg.atomic_charge(orb, "q", ["frame", "atom_id"])


@query("a2_positive_defect", """SELECT frame, arg_max(atom_id, (q, atom_id)) FILTER (q BETWEEN -0.4 AND -0.1) AS defect, max(q) FILTER (q BETWEEN -0.4 AND -0.1) AS charge FROM (SELECT frame, atom_id, -z / 100 AS q FROM atoms WHERE element = 'O') GROUP BY frame""", "charge", "atoms")
def _(spark, d):
    return agg.positive_defect(atoms(spark, d).where(O()).withColumn("q", -F.col("z") / 100), "q", -0.4, -0.1, ["frame"])


@query("a3_negative_defect", """SELECT frame, max(atom_id) FILTER (k = 1) AS defect, max(q) FILTER (k = 1) AS charge, max(q) FILTER (k = 2) AS second FROM (SELECT frame, atom_id, -z / 100 AS q, row_number() OVER (PARTITION BY frame ORDER BY -z / 100, atom_id) AS k FROM atoms WHERE element = 'O') GROUP BY frame""", "charge second", "atoms")
def _(spark, d):
    return agg.negative_defect(atoms(spark, d).where(O()).withColumn("q", -F.col("z") / 100), "q", ["frame"])


EDGES = f"edges AS (SELECT frame, i AS a, j AS b FROM ({pairs_sql(chr(39) + 'O' + chr(39) + ',' + chr(39) + 'C' + chr(39), chr(39) + 'O' + chr(39) + ',' + chr(39) + 'C' + chr(39), 16)}))"


def edges(spark, d):
    a = atoms(spark, d).where(O() | C())
    return pairs.neighbour_pairs(a, a, 16.0, BOX, half=True).select("frame", F.col("i").alias("a"), F.col("j").alias("b"))


def ends(spark, d):
    return atoms(spark, d).where(O() | C()).groupBy("frame").agg(F.min("atom_id").alias("source"), F.max("atom_id").alias("target"))


def path_sql(edges: str, elements: str) -> str:
    """CTEs ending in b (frame, path): least of the shortest paths of up to five edges from the first to the last atom of some elements."""
    return f"""{edges}, ends AS (SELECT frame, min(atom_id) AS source, max(atom_id) AS target FROM atoms WHERE element IN ({elements}) GROUP BY frame),
w AS (SELECT frame, source, target, source AS here, [source] AS path FROM ends UNION ALL SELECT w.frame, w.source, w.target, e.b, list_append(w.path, e.b) FROM w JOIN edges e ON e.frame = w.frame AND e.a = w.here WHERE w.here <> w.target AND len(w.path) <= 5 AND NOT list_contains(w.path, e.b)),
b AS (SELECT frame, arg_min(path, (len(path), path)) AS path FROM w WHERE here = target GROUP BY frame)"""


PATHS = "SELECT ends.frame, source, target, path IS NOT NULL AS connected, CAST(coalesce(len(path) - 2, -1) AS INTEGER) AS n_bridging, CASE WHEN path IS NULL THEN NULL ELSE array_to_string(path, '-') END AS path FROM ends LEFT JOIN b USING (frame)"
PATH = f"WITH {path_sql(EDGES, chr(39) + 'O' + chr(39) + ', ' + chr(39) + 'C' + chr(39))} {PATHS}"
BONDED = HB + ", hu AS (SELECT DISTINCT frame, donor, acceptor FROM hb WHERE angle >= 90), edges AS (SELECT frame, donor AS a, acceptor AS b FROM hu UNION SELECT frame, acceptor, donor FROM hu)"


@query("n1_shortest_path", PATH, "", "atoms")
def _(spark, d):
    x = graph.shortest_path(edges(spark, d), ends(spark, d), 5, ["frame"])
    return x.withColumn("path", F.when(F.col("path").isNotNull(), F.array_join(F.transform("path", lambda i: i.cast("string")), "-")))


@query("n2_hbond_path", f"WITH {path_sql(BONDED, chr(39) + 'O' + chr(39))} {PATHS}", "", "atoms")
def _(spark, d):
    e = graph.hbond_edges(bonds(spark, d), ["frame"])
    a = atoms(spark, d).where(O()).groupBy("frame").agg(F.min("atom_id").alias("source"), F.max("atom_id").alias("target"))
    return graph.shortest_path(e, a, 5, ["frame"]).withColumn("path", F.array_join(F.transform("path", lambda i: i.cast("string")), "-"))


@query("n3_path_shape", f"""WITH {path_sql(EDGES, chr(39) + 'O' + chr(39) + ', ' + chr(39) + 'C' + chr(39))}, p AS (SELECT frame, unnest(path) AS atom_id, generate_subscripts(path, 1) AS k FROM b WHERE len(path) >= 2), c AS (SELECT p.frame, p.k, a.x, a.y, a.z FROM p JOIN atoms a ON a.frame = p.frame AND a.atom_id = p.atom_id),
e AS (SELECT frame, k, {', '.join(f"{imaged(f'lead({c}) OVER w - {c}')} AS d{c}" for c in 'xyz')} FROM c WINDOW w AS (PARTITION BY frame ORDER BY k)), f AS (SELECT *, {', '.join(f'-lead(d{c}) OVER w AS n{c}' for c in 'xyz')} FROM e WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY frame ORDER BY k)),
g AS (SELECT frame, sum({length(col('d'))}) AS contour, avg(CASE WHEN {length(col('d'))} * {length(col('n'))} > 0 THEN degrees(acos(greatest(-1, least(1, {dotted(col('d'), col('n'))} / ({length(col('d'))} * {length(col('n'))}))))) END) AS mean_angle, sqrt(sum(dx)**2 + sum(dy)**2 + sum(dz)**2) AS end_to_end FROM f GROUP BY frame)
SELECT frame, contour, end_to_end, mean_angle, 1 - end_to_end / nullif(contour, 0) AS loopiness FROM g""", "contour end_to_end mean_angle loopiness", "atoms")
def _(spark, d):
    p = graph.shortest_path(edges(spark, d), ends(spark, d), 5, ["frame"])
    return graph.path_shape(p.where("connected"), atoms(spark, d), BOX, ["frame"])


@query("n4_path_orientation", """SELECT frame, sum(s) / count(*) AS ksi, coalesce(string_agg(CASE WHEN s > 0 AND n > 0 THEN 'P' WHEN s > 0 THEN 'D' WHEN n > 0 THEN 'L' ELSE 'R' END, '' ORDER BY atom_id) FILTER (n IS NOT NULL), '') AS topology FROM (SELECT *, lead(s) OVER (PARTITION BY frame ORDER BY atom_id) AS n FROM (SELECT frame, atom_id, CASE WHEN x > 25 THEN 1 ELSE -1 END AS s FROM atoms)) GROUP BY frame""", "ksi", "atoms")
def _(spark, d):
    s = F.transform(F.array_sort(F.collect_list(F.struct("atom_id", F.when(F.col("x") > 25, 1).otherwise(-1).alias("s")))), lambda x: x["s"])
    x = atoms(spark, d).groupBy("frame").agg(s.alias("signs"))
    o = graph.path_orientation(F.col("signs"))
    return x.select("frame", o["ksi"].alias("ksi"), o["topology"].alias("topology"))


@query("n5_degree", f"WITH {EDGES} SELECT n.frame, n.node, count(DISTINCT e.b) AS degree FROM (SELECT frame, min(atom_id) AS node FROM atoms WHERE element IN ('O', 'C') GROUP BY frame) n LEFT JOIN edges e ON e.frame = n.frame AND e.a = n.node GROUP BY ALL", "", "atoms")
def _(spark, d):
    return graph.degree(edges(spark, d), ends(spark, d).withColumnRenamed("source", "node"), ["frame"])


@query("n6_largest_component", f"""WITH {EDGES}, r AS (SELECT frame, a AS root, a AS node FROM edges UNION SELECT r.frame, r.root, e.b FROM r JOIN edges e ON e.frame = r.frame AND e.a = r.node), l AS (SELECT frame, node, min(root) AS label FROM r GROUP BY frame, node)
SELECT frame, max(n) AS largest FROM (SELECT frame, label, count(*) AS n FROM l GROUP BY frame, label) GROUP BY frame""", "", "atoms")
def _(spark, d):
    return graph.largest_component(edges(spark, d), ["frame"])


@query("n7_five_rings", f"""WITH {EDGES}, s AS (SELECT frame, min(atom_id) AS n0 FROM atoms WHERE element IN ('O', 'C') GROUP BY frame),
r AS (SELECT DISTINCT s.frame, list_sort([n0, e1.b, e2.b, e3.b, e4.b]) AS ring FROM s {' '.join(f"JOIN edges e{k} ON e{k}.frame = s.frame AND e{k}.a = {'n0' if k == 1 else f'e{k - 1}.b'} AND e{k}.b NOT IN ({', '.join(['n0', *(f'e{m}.b' for m in range(1, k))])})" for k in range(1, 5))} JOIN edges z ON z.frame = s.frame AND z.a = e4.b AND z.b = n0)
SELECT frame, count(*) AS n_rings FROM r GROUP BY frame""", "", "atoms")
def _(spark, d):
    near = edges(spark, d)
    x = graph.five_rings(near, ends(spark, d).withColumnRenamed("source", "node"), ["frame"])
    return x.groupBy("frame").agg(F.count("*").alias("n_rings"))


@query("n8_network_potentials", """SELECT frame, atom_id AS node, 5.0 + sum(g) OVER (PARTITION BY frame ORDER BY atom_id) AS potential, 0.0 AS spread FROM (SELECT frame, atom_id, coalesce(x - lag(x) OVER (PARTITION BY frame ORDER BY atom_id), 0.0) / 10 AS g FROM atoms)""", "potential spread", "atoms")
def _(spark, d):
    w = Window.partitionBy("frame").orderBy("atom_id")
    a = atoms(spark, d)
    e = a.select("frame", F.lag("atom_id").over(w).alias("a"), F.col("atom_id").alias("b"), ((F.col("x") - F.lag("x").over(w)) / 10).alias("gap")).where("a is not null")
    start = a.where("atom_id = 1").select("frame", F.col("atom_id").alias("node"), F.lit(5.0).alias("potential"))
    return graph.network_potentials(e, start, None, ["frame"])
