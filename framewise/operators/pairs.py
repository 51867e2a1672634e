"""Periodic neighbour joins by cell list, and what is built on them. Atoms: (run, frame, atom_id, element, x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import angle_deg, norm, switching
from .cells import XYZ, Box, Grid, fractional, imaged, moved, volume

#: Atoms of a frame from which cells are worth their copies of atoms.
FEW = 64


def _carried(box: Box) -> tuple[str, ...]:
    """What a side of a pair needs for distances: coordinates, and the cell where the box is a column."""
    return (*XYZ, box) if isinstance(box, str) else XYZ


def _delta(a: str, b: str, box: Box) -> list[Column]:
    """Imaged difference of two structs of coordinates."""
    return imaged([F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in XYZ], box, F.col(f"{a}.{box}") if isinstance(box, str) else None)


def crowded(atoms: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether frames hold more than FEW atoms on average: one pass over the keys, without a shuffle of rows."""
    n = atoms.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*keys)).alias("f")).first()
    return n["n"] > FEW * n["f"]


def neighbour_pairs(a: DataFrame, b: DataFrame, cutoff: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None, carry: tuple[str, ...] = (), half: bool = False) -> DataFrame:
    """All pairs (i of a, j of b, i <> j) within cutoff under periodic images: keys, i, j, element_i, element_j, d.

    box: see cells.py; where it names a column, runs with their own cells, rectangular or triclinic, stand in one table.
    An atom of b is looked for in its wrapped neighbour cells, so the join is an equi-join on frame and cell whose pairs
    are bounded by the density times the cutoff volume. Frames of a few atoms, which copies of atoms would only slow, are
    joined on the frame alone. dense says which; None: by the number of atoms a frame, counted.
    carry: columns of both sides to hand on in structs p and q (coordinates among them). half: a and b are the same atoms
    and each pair is wanted once, i < j; then half of the neighbour cells are enough.
    """
    grid = Grid(box, cutoff)
    cells = grid.useful() and (crowded(b, keys) if dense is None else dense)
    at = [c for c in dict.fromkeys((*_carried(box), *carry))]
    left = a.select(*keys, F.col("atom_id").alias("i"), F.col("element").alias("element_i"), *[F.col(c).alias(f"_p_{c}") for c in at])
    # the cell travels on one side: copies of atoms are many
    seen = at if half and carry else [c for c in dict.fromkeys((*XYZ, *carry))]
    right = b.select(*keys, F.col("atom_id").alias("j"), F.col("element").alias("element_j"), *[F.col(c).alias(f"_q_{c}") for c in dict.fromkeys((*seen, *_carried(box)))])
    on = [*keys]
    cell = lambda side: F.col(f"_{side}_{box}") if isinstance(box, str) else None
    if cells:
        place = lambda side: [F.col(f"_{side}_{c}") for c in XYZ]
        on, names = [*keys, "_cx", "_cy", "_cz"], ["_cx", "_cy", "_cz"]
        left = left.withColumns(dict(zip(names, grid.home(place("p"), cell("p"), grid.counts(cell("p"))))))
        held = {f"_n{c}": m for c, m in zip(XYZ, grid.counts(cell("q")))}
        n = [F.col(c) for c in held]
        right = right.withColumns(held)
        scale = dict(zip(["_ux", "_uy", "_uz", "_rx", "_ry", "_rz"], [*grid.scaled(place("q"), cell("q"), n), *grid.reach(cell("q"), n)]))
        right = right.withColumns(scale).withColumns({c: F.coalesce(F.pmod(F.floor(f"_u{k}"), m).cast("int"), F.lit(0)) for c, k, m in zip(names, XYZ, n)})
        right = grid.spread(right.select(*on, "j", "element_j", *[f"_q_{c}" for c in seen], *held, *scale), n, half)
        right = right.withColumns({c: F.pmod(F.col(c) + F.col(f"_o{k}"), m) for c, k, m in zip(names, XYZ, n)})
        more = [F.expr("_ox = 0 and _oy = 0 and _oz = 0").alias("_own"), grid.wide(n).alias("_wide")] if half else []
        right = right.select(*on, "j", "element_j", *[f"_q_{c}" for c in seen], *more)
    else:
        right = right.select(*on, "j", "element_j", *[f"_q_{c}" for c in seen])
    x = left.join(right, on)
    if not half:
        x = x.where("i <> j")
    elif not cells:
        x = x.where("i < j")
    else:  # of wide grids pairs of different cells come once, in either order
        x = x.where("i < j or (_wide and not _own)")
    apart = [F.col(f"_q_{c}") - F.col(f"_p_{c}") for c in XYZ]
    if isinstance(box, str):
        # whole cells between the two, computed once a pair: a generator, as a filter on plain columns would spell the formula out several times in the join
        whole = F.struct(*[F.rint(f).alias(f"n{k}") for k, f in enumerate(fractional(apart, cell("p")))])
        x = x.withColumn("_w", F.explode_outer(F.array(whole)))
        near = moved(apart, [F.col(f"_w.n{k}") for k in range(3)], cell("p"))
    else:
        near = imaged(apart, box)
    x = x.withColumn("d", norm(near)).where(F.col("d") <= cutoff)
    turned = [("i", "j"), ("element_i", "element_j"), *[(f"_p_{c}", f"_q_{c}") for c in at if carry]]
    if half and cells:
        turn = F.col("i") > F.col("j")
        x = x.select(*keys, *[F.when(turn, F.col(v)).otherwise(F.col(u)).alias(u) for pair in turned for u, v in (pair, pair[::-1])], "d")
    ends = [F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in held]).alias(side) for side, held in (("p", at), ("q", seen))] if carry else []
    return x.select(*keys, "i", "j", "element_i", "element_j", "d", *ends)


def all_pairs(a: DataFrame, b: DataFrame, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Pairs of two atom groups of a frame without a cutoff, for measures defined over all of them; groups are small selections."""
    left = a.select(*keys, F.col("atom_id").alias("i"), F.struct(*_carried(box)).alias("p"))
    right = b.select(*keys, F.col("atom_id").alias("j"), F.struct(*_carried(box)).alias("q"))
    return left.join(right, [*keys]).where("i <> j").select(*keys, "i", "j", norm(_delta("p", "q", box)).alias("d"))


def nearest_owner(h: DataFrame, heavy: DataFrame, cutoff: float, margin: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The nearest heavy atom of each hydrogen, with the second distance; owner is null where another is within margin. carry: columns of the nearest atom to hand on in struct q.

    The two nearest come from one aggregation over the neighbours of a hydrogen, as many as the density allows.
    """
    x = neighbour_pairs(h, heavy, cutoff + margin, box, keys, dense, carry or ("x",))
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "j", *(["q"] if carry else [])))), 1, 2)
    y = x.groupBy(*keys, F.col("i").alias("h")).agg(near.alias("n")).select(*keys, "h", F.get("n", F.lit(0)).alias("a"), F.get("n", F.lit(1)).alias("b")).where(F.col("a.d") <= cutoff)
    clear = F.col("b").isNull() | (F.col("b.d") - F.col("a.d") >= margin)
    return y.select(*keys, "h", F.col("a.j").alias("nearest"), F.when(clear, F.col("a.j")).alias("owner"), F.col("a.d").alias("d1"), F.col("b.d").alias("d2"), *([F.col("a.q").alias("q")] if carry else []))


def coordination(a: DataFrame, b: DataFrame, r0: float, p: int, q: int, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Sum of the switching function over all pairs of each frame."""
    return all_pairs(a, b, box, keys).groupBy(*keys).agg(F.sum(switching(F.col("d") / r0, p, q)).alias("coordination"))


def mean_group_distance(a: DataFrame, b: DataFrame, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Mean of all pair distances of each frame."""
    return all_pairs(a, b, box, keys).groupBy(*keys).agg(F.avg("d").alias("mean_d"))


def soft_min_distance(a: DataFrame, b: DataFrame, beta: float, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Beta / log(sum exp(beta / d)), 0 where a distance is 0."""
    x = all_pairs(a, b, box, keys).withColumn("_z", beta / F.when(F.col("d") > 1e-12, F.col("d")))
    m = x.groupBy(*keys).agg(F.max("_z").alias("_m"), F.min("d").alias("_d"))
    y = x.join(m, [*keys]).groupBy(*keys).agg(F.first("_m").alias("_m"), F.first("_d").alias("_d"), F.sum(F.exp(F.col("_z") - F.col("_m"))).alias("_s"))
    return y.select(*keys, F.when(F.col("_d") <= 1e-12, 0.0).otherwise(beta / (F.col("_m") + F.log("_s"))).alias("soft_min"))


def hbonds(donors: DataFrame, h: DataFrame, acceptors: DataFrame, covalent: float, most: float, angle: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """Donor, hydrogen, acceptor triples: hydrogen within covalent of the donor, heavy distance at most `most`, angle at the hydrogen at least `angle` degrees. Coordinates travel with the pairs, so one join makes a triple."""
    bond = neighbour_pairs(donors, h, covalent, box, keys, dense, _carried(box)).select(*keys, F.col("i").alias("donor"), F.col("j").alias("h"), F.col("p").alias("p_donor"), F.col("q").alias("p_h"))
    reach = neighbour_pairs(donors, acceptors, most, box, keys, dense, _carried(box)).select(*keys, F.col("i").alias("donor"), F.col("j").alias("acceptor"), "d", F.col("q").alias("p_acceptor"))
    x = bond.join(reach, [*keys, "donor"]).where("h <> acceptor")
    x = x.withColumn("angle", angle_deg(_delta("p_h", "p_donor", box), _delta("p_h", "p_acceptor", box))).where(F.col("angle") >= angle)
    return x.select(*keys, "donor", "h", "acceptor", "d", "angle")


def hbond_averages(bonds: DataFrame, n_frames: Column) -> DataFrame:
    """Per bond its share of frames, mean distance and mean angle."""
    return bonds.groupBy("donor", "h", "acceptor").agg((F.count("*") / n_frames).alias("fraction"), F.avg("d").alias("mean_d"), F.avg("angle").alias("mean_angle"))


def nearest_solute_atom(defects: DataFrame, solute: DataFrame, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Nearest solute atom (the lower id of equal ones) to one defect atom a frame; -1 and null where there is none."""
    x = all_pairs(defects, solute, box, keys).groupBy(*keys).agg(F.min(F.struct("d", "j")).alias("m"))
    return defects.select(*keys).distinct().join(x, [*keys], "left").select(*keys, F.coalesce("m.j", F.lit(-1)).alias("nearest"), F.col("m.d").alias("d"))


def farthest_water(waters: DataFrame, solute: DataFrame, box: Box, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The water whose nearest solute atom is farthest, the lower id of equal ones."""
    x = all_pairs(waters, solute, box, keys).groupBy(*keys, "i").agg(F.min("d").alias("d"))
    return x.groupBy(*keys).agg(F.max(F.struct("d", (-F.col("i")).alias("n"))).alias("m")).select(*keys, (-F.col("m.n")).alias("water"), F.col("m.d").alias("d"))


def common_water(waters: DataFrame, solute: DataFrame, box: Box, group: str) -> DataFrame:
    """Over a group's frames, the water seen in every one of them whose least solute distance is largest (ties: mean, then lower id)."""
    keys = (group, "frame")
    x = all_pairs(waters, solute, box, keys).groupBy(*keys, "i").agg(F.min("d").alias("d"))
    n = waters.groupBy(group).agg(F.count_distinct("frame").alias("_n"))
    y = x.groupBy(group, "i").agg(F.min("d").alias("least"), F.avg("d").alias("mean"), F.count("*").alias("_c")).join(n, group).where("_c = _n")
    best = F.max(F.struct("least", "mean", (-F.col("i")).alias("k"))).alias("m")
    return y.groupBy(group).agg(best).select(group, (-F.col("m.k")).alias("water"), F.col("m.least").alias("least"), F.col("m.mean").alias("mean"))


def select_acceptor(h: DataFrame, donors: DataFrame, acceptors: DataFrame, reach: float, angle: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """For each hydrogen (owner donor by nearest), the nearest acceptor that passes distance and angle, else the nearest of all within reach; is_hbond tells which."""
    own = nearest_owner(h, donors, 3.0, 0.0, box, keys, dense, _carried(box)).select(*keys, "h", F.col("nearest").alias("donor"), F.col("q").alias("p_donor"))
    x = neighbour_pairs(h, acceptors, 2 * reach, box, keys, dense, _carried(box)).select(*keys, F.col("i").alias("h"), F.col("j").alias("acceptor"), "d", F.col("p").alias("p_h"), F.col("q").alias("p_acceptor"))
    x = x.join(own, [*keys, "h"]).where("acceptor <> donor")
    ok = (F.col("d") <= reach) & (angle_deg(_delta("p_h", "p_donor", box), _delta("p_h", "p_acceptor", box)) >= angle)
    return x.groupBy(*keys, "h").agg(F.min(F.struct((~F.coalesce(ok, F.lit(False))).alias("no"), "d", "acceptor")).alias("m")).select(*keys, "h", F.col("m.acceptor").alias("acceptor"), F.col("m.d").alias("d"), (~F.col("m.no")).alias("is_hbond"))


def group_min_distance(a: DataFrame, group: str, cutoff: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """Least imaged distance of each pair of groups (molecules) of a frame, of those within the cutoff."""
    x = neighbour_pairs(a, a, cutoff, box, keys, dense, (group,), half=True).select(*keys, F.col(f"p.{group}").alias("gi"), F.col(f"q.{group}").alias("gj"), "d").where("gi <> gj")
    return x.groupBy(*keys, F.least("gi", "gj").alias("mol_a"), F.greatest("gi", "gj").alias("mol_b")).agg(F.min("d").alias("d"))


def contacts(a: DataFrame, group: str, contact: float, reach: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """group_min_distance within reach, with whether each pair of groups is in contact."""
    return group_min_distance(a, group, reach, box, keys, dense).withColumn("contact", F.col("d") <= contact)


def pair_histogram(a: DataFrame, b: DataFrame, dr: float, rmax: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """Counts of pair distances below rmax by bin of width dr; pairs of a set with itself are found once and counted twice."""
    same = a is b
    x = neighbour_pairs(a, b, rmax, box, keys, dense, half=same).where(F.col("d") < rmax)
    return x.groupBy(F.floor(F.col("d") / dr).cast("int").alias("bin")).agg((F.count("*") * (2 if same else 1)).alias("n"))


def rdf(a: DataFrame, b: DataFrame, dr: float, rmax: float, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None, rho: float | None = None) -> DataFrame:
    """H4: radial distribution g(r) of b around a over all frames, with raw counts and the running number of neighbours.

    Ideal counts of a shell: by volume, the pairs of every frame times the shell's share of its cell; with rho, a stated
    number density, the centres times rho times the shell's volume.
    """
    hist = pair_histogram(a, b, dr, rmax, box, keys, dense)
    cell = F.first(volume(box, F.col(box) if isinstance(box, str) else None)).alias("v")
    na, nb = a.groupBy(*keys).agg(F.count("*").alias("na"), cell), b.groupBy(*keys).agg(F.count("*").alias("nb"))
    tot = na.join(nb, [*keys], "left").agg(F.sum("na").alias("centres"), F.sum(F.col("na") * F.coalesce("nb", F.lit(0)) / F.col("v")).alias("ideal"))
    bins = a.sparkSession.range(int(round(rmax / dr))).select(F.col("id").cast("int").alias("bin"))
    lo = F.col("bin") * dr
    shell = 4.0 / 3.0 * 3.141592653589793 * (F.pow(lo + dr, F.lit(3)) - F.pow(lo, F.lit(3)))
    x = bins.join(hist, "bin", "left").fillna(0, ["n"]).crossJoin(F.broadcast(tot))  # one row of totals
    run = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # rmax / dr rows
    ideal = F.col("ideal") if rho is None else F.col("centres") * rho
    return x.select("bin", (lo + dr / 2).alias("r"), "n", (F.col("n") / (ideal * shell)).alias("g"), (run / F.col("centres")).alias("running"))


def sasa(target: DataFrame, blockers: DataFrame, radius: float, points: int, box: Box, keys: tuple[str, ...] = ("frame",), dense: bool | None = None) -> DataFrame:
    """Accessible area of each target atom: share of golden-spiral points on its sphere outside every other blocker's sphere, times the sphere's area.

    Only blockers within two radii can hide a point; they come by the cell join and stand in an array beside the atom, as
    many as the density allows, so no point meets an atom it cannot touch.
    """
    near = neighbour_pairs(target, blockers, 2 * radius, box, keys, dense, _carried(box))
    held = near.groupBy(*keys, "i").agg(F.collect_list("q").alias("q"))
    t = target.select(*keys, F.col("atom_id").alias("i"), F.struct(*_carried(box)).alias("c")).join(held, [*keys, "i"], "left")
    cell = F.col(f"c.{box}") if isinstance(box, str) else None

    # the sphere's points are numbers; each atom's are made once, not once for every blocker
    steps = [(1 - (2 * k + 1) / points, k * 2.399963229728653) for k in range(points)]
    sphere = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(XYZ, (radius * math.sqrt(1 - z * z) * math.cos(phi), radius * math.sqrt(1 - z * z) * math.sin(phi), radius * z))]) for z, phi in steps])
    spots = F.transform(sphere, lambda u: F.struct(*[(F.col(f"c.{c}") + u[c]).alias(c) for c in XYZ]))
    hidden = lambda p: F.exists("q", lambda q: norm(imaged([q[c] - p[c] for c in XYZ], box, cell)) < radius)
    free = F.when(F.col("q").isNull(), points).otherwise(points - F.size(F.filter(spots, hidden)))
    return t.select(*keys, "i", (free / points * 4 * 3.141592653589793 * radius**2).alias("area"))
