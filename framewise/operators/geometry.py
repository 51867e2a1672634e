"""Collective variables of a frame. Atoms: (run, frame, atom_id, element, x, y, z); selections are pivoted by conditional aggregation in one shuffle on the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from ..functions.exprs import angle_deg, cross, dot, min_image, norm, planar_deviation, torsion_deg, torsion_of, unit
from .cells import imaged

XYZ = ("x", "y", "z")


def pick(atoms: DataFrame, ids: list[int], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row a frame with a struct a<id> for each of the atoms (null where it is absent)."""
    at = F.struct(*XYZ)
    return atoms.where(F.col("atom_id").isin(ids)).groupBy(*keys).agg(*[F.max(F.when(F.col("atom_id") == i, at)).alias(f"a{i}") for i in dict.fromkeys(ids)])


def pick_flat(atoms: DataFrame, ids: list[int], keys: tuple[str, ...]) -> DataFrame:
    """As pick, with plain columns a<id><axis> that are NaN where an atom is absent: columns without nulls make far less code of long formulas."""
    x = pick(atoms, ids, keys)
    return x.select(*keys, *[F.coalesce(F.col(f"a{i}.{c}"), F.lit(float("nan"))).alias(f"a{i}{c}") for i in dict.fromkeys(ids) for c in XYZ])


def flat_vector(i: int, j: int, box: float | None) -> list[Column]:
    d = [F.col(f"a{j}{c}") - F.col(f"a{i}{c}") for c in XYZ]
    return imaged(d, box)


def vector(a: int | str, b: int | str, box: float | None) -> list[Column]:
    """From a to b, imaged."""
    a, b = (f"a{i}" if isinstance(i, int) else i for i in (a, b))
    d = [F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in XYZ]
    return imaged(d, box)


def distance(atoms: DataFrame, i: int, j: int, box: float | None, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Distance of two atoms in each frame that has both."""
    return pick(atoms, [i, j], keys).select(*keys, norm(vector(i, j, box)).alias("d")).where("d is not null")


def centroid_distance(atoms: DataFrame, a: Column, b: Column, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Distance of the mean positions of two groups, without images."""
    x = atoms.groupBy(*keys).agg(F.struct(*[F.avg(F.when(a, F.col(c))).alias(c) for c in XYZ]).alias("p"), F.struct(*[F.avg(F.when(b, F.col(c))).alias(c) for c in XYZ]).alias("q"))
    return x.select(*keys, norm(vector("p", "q", None)).alias("d")).where("d is not null")


def lcod(atoms: DataFrame, a: int, b: int, c: int, d: int, box: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """r(a, b) - r(c, d)."""
    return pick(atoms, [a, b, c, d], keys).select(*keys, (norm(vector(a, b, box)) - norm(vector(c, d, box))).alias("lcod")).where("lcod is not null")


def dihedrals(atoms: DataFrame, quartets: dict[str, tuple[int, int, int, int]], box: float | None, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Signed torsion of each named quartet, one column a name; null if degenerate or incomplete."""
    x = pick_flat(atoms, [i for q in quartets.values() for i in q], keys)
    # bonds, then normals, then angles as columns of their own, so that no expression holds another several times over
    bonds = {b: f"_b{k}" for k, b in enumerate(dict.fromkeys(b for i, j, k, m in quartets.values() for b in ((i, j), (j, k), (k, m))))}
    parts = lambda n: [F.col(f"{n}{c}") for c in XYZ]
    x = x.select(*keys, *[v.alias(f"{n}{c}") for b, n in bonds.items() for v, c in zip(flat_vector(*b, box), XYZ)])
    normals = {p: f"_n{k}" for k, p in enumerate(dict.fromkeys(p for i, j, k, m in quartets.values() for p in (((i, j), (j, k)), ((j, k), (k, m)))))}
    x = x.select("*", *[v.alias(f"{n}{c}") for (p, q), n in normals.items() for v, c in zip(cross(parts(bonds[p]), parts(bonds[q])), XYZ)])
    angle = lambda i, j, k, m: torsion_of(parts(normals[(i, j), (j, k)]), parts(normals[(j, k), (k, m)]), parts(bonds[j, k]))
    x = x.select(*keys, *[angle(*q).alias(n) for n, q in quartets.items()])
    return x.select(*keys, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in quartets])


def improper_bend(atoms: DataFrame, ring: list[int], hub: int, tip: int, box: float | None, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Degrees by which hub -> tip leaves the ring's plane, signed by the side of its area normal."""
    x = pick_flat(atoms, [*ring, hub, tip], keys)
    parts = lambda n: [F.col(f"{n}{c}") for c in XYZ]
    x = x.select(*keys, *[v.alias(f"_r{k}{c}") for k, i in enumerate(ring) for v, c in zip(flat_vector(ring[0], i, box), XYZ)], *[v.alias(f"_t{c}") for v, c in zip(flat_vector(hub, tip, box), XYZ)])
    n = len(ring)
    normal = [sum(c) for c in zip(*[cross(parts(f"_r{k}"), parts(f"_r{(k + 1) % n}")) for k in range(n)])]
    x = x.select(*keys, *[v.alias(f"_n{c}") for v, c in zip(normal, XYZ)], *parts("_t"))
    s = F.try_divide(dot(parts("_n"), parts("_t")), norm(parts("_n")) * norm(parts("_t")))
    x = x.select(*keys, s.alias("_s"))
    return x.select(*keys, F.when(~F.isnan("_s"), F.degrees(F.asin(unit(F.col("_s"))))).alias("bend"))


def ring_center(atoms: DataFrame, ring: list[int], box: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Mean of the ring atoms, each imaged to the first."""
    x = pick(atoms, ring, keys)
    mean = [F.col(f"a{ring[0]}.{c}") + sum(vector(ring[0], i, box)[k] for i in ring) / len(ring) for k, c in enumerate(XYZ)]
    return x.select(*keys, *[m.alias(c) for m, c in zip(mean, XYZ)]).where("x is not null")


def ring_distance(atoms: DataFrame, defects: DataFrame, rings: dict[str, list[int]], box: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Distance of one atom a frame (keys, atom_id) to the centre of each ring."""
    at = atoms.join(defects.select(*keys, "atom_id"), [*keys, "atom_id"]).select(*keys, F.struct(*XYZ).alias("p"))
    for name, ring in rings.items():
        c = ring_center(atoms, ring, box, keys).select(*keys, F.struct(*XYZ).alias("c"))
        at = at.join(c, [*keys], "left").withColumn(name, norm(vector("p", "c", box))).drop("c")
    return at.drop("p")


def helicity(atoms: DataFrame, rings: list[list[int]], box: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Torsion of four ring centres."""
    x = None
    for k, ring in enumerate(rings):
        c = ring_center(atoms, ring, box, keys).select(*keys, F.struct(*XYZ).alias(f"r{k}"))
        x = c if x is None else x.join(c, [*keys])
    return x.select(*keys, torsion_deg(*[vector(f"r{k}", f"r{k + 1}", box) for k in range(3)]).alias("helicity"))


def ring_planarity(atoms: DataFrame, ring: list[int], box: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Mean planar deviation of the six torsions of a ring, null if one is degenerate."""
    n = len(ring)
    quartets = {f"t{k}": tuple(ring[(k + m) % n] for m in range(4)) for k in range(n)}
    return dihedrals(atoms, quartets, box, keys).select(*keys, (sum(planar_deviation(F.col(q)) for q in quartets) / n).alias("planarity"))


def bond_angle(atoms: DataFrame, i: int, j: int, k: int, box: float | None, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Angle at j."""
    return pick(atoms, [i, j, k], keys).select(*keys, angle_deg(vector(j, i, box), vector(j, k, box)).alias("angle")).where("angle is not null")


def rmsd(atoms: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("run", "frame"), ref_keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Best-fit deviation from a reference (ref_keys, atom_id, x, y, z) over the atoms both have.

    The sums of products of a frame give its 3x3 covariance H; the eigenvalues of its square are in closed form, so a frame
    never leaves Spark's aggregation. s1 >= s2 >= s3 its singular values, the trace of the rotated products is s1 + s2 + s3,
    the last with the sign of det H. s2 + s3 is the root of s2^2 + s3^2 + 2 s2 s3, and these come from the squared minors
    (their sum is s1^2 s2^2 + s1^2 s3^2 + s2^2 s3^2) and det H = s1 s2 s3, not from the smaller eigenvalues, which have lost
    their digits in flat or straight groups.
    """
    r = reference.select(*ref_keys, "atom_id", *[F.col(c).alias(f"r{c}") for c in XYZ])
    x = atoms.join(r, [*ref_keys, "atom_id"])
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ], *[F.sum(f"r{c}").alias(f"t{c}") for c in XYZ], F.sum(sum(F.col(c) * F.col(c) for c in XYZ)).alias("pp"), F.sum(sum(F.col(f"r{c}") * F.col(f"r{c}") for c in XYZ)).alias("qq"), *[F.sum(F.col(a) * F.col(f"r{b}")).alias(f"m{a}{b}") for a in XYZ for b in XYZ]]
    g = x.groupBy(*keys).agg(*sums)
    h = {(a, b): F.col(f"m{a}{b}") - F.col(f"s{a}") * F.col(f"t{b}") / F.col("n") for a in XYZ for b in XYZ}
    g = g.select(*keys, "n", (F.col("pp") - sum(F.col(f"s{c}") * F.col(f"s{c}") for c in XYZ) / F.col("n") + F.col("qq") - sum(F.col(f"t{c}") * F.col(f"t{c}") for c in XYZ) / F.col("n")).alias("e0"), *[v.alias(f"h{a}{b}") for (a, b), v in h.items()])
    k = {(a, b): sum(F.col(f"h{c}{a}") * F.col(f"h{c}{b}") for c in XYZ) for a in XYZ for b in XYZ}
    det = dot([F.col(f"h{XYZ[0]}{c}") for c in XYZ], cross([F.col(f"h{XYZ[1]}{c}") for c in XYZ], [F.col(f"h{XYZ[2]}{c}") for c in XYZ]))
    rows = [[F.col(f"h{a}{c}") for c in XYZ] for a in XYZ]
    minors = sum(m * m for i in range(3) for m in cross(rows[i], rows[(i + 1) % 3]))
    g = g.select(*keys, "n", "e0", det.alias("det"), minors.alias("minors"), *[k[a, b].alias(f"k{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]])
    q = (F.col("kxx") + F.col("kyy") + F.col("kzz")) / 3
    off = F.col("kxy") ** 2 + F.col("kxz") ** 2 + F.col("kyz") ** 2
    p = F.sqrt(((F.col("kxx") - q) ** 2 + (F.col("kyy") - q) ** 2 + (F.col("kzz") - q) ** 2 + 2 * off) / 6)
    g = g.withColumns({"q": q, "p": p})
    b = {c: (F.col(f"k{c}{c}") - F.col("q")) / F.nullif("p", F.lit(0.0)) for c in XYZ}
    o = {c: F.col(f"k{c}") / F.nullif("p", F.lit(0.0)) for c in ("xy", "xz", "yz")}
    half = (b["x"] * (b["y"] * b["z"] - o["yz"] ** 2) - o["xy"] * (o["xy"] * b["z"] - o["yz"] * o["xz"]) + o["xz"] * (o["xy"] * o["yz"] - b["y"] * o["xz"])) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(half, F.lit(1.0))))) / 3
    g = g.withColumn("phi", phi)
    g = g.withColumn("s1", F.nullif(F.sqrt(F.greatest(F.lit(0.0), F.col("q") + 2 * F.col("p") * F.cos("phi"))), F.lit(0.0)))
    g = g.withColumn("s23", F.col("det") / F.col("s1"))
    g = g.withColumn("squares", F.greatest(F.lit(0.0), (F.col("minors") - F.col("s23") ** 2) / F.col("s1") ** 2))
    twice = F.greatest(-F.col("squares"), F.least(F.col("squares"), 2 * F.col("s23")))  # 2 s2 s3 is at most s2^2 + s3^2
    g = g.withColumn("trace", F.coalesce(F.col("s1") + F.sqrt(F.col("squares") + twice), F.lit(0.0)))
    return g.select(*keys, "n", F.sqrt(F.greatest(F.lit(0.0), (F.col("e0") - 2 * F.col("trace")) / F.col("n"))).alias("rmsd"))


def radgyr(atoms: DataFrame, masses: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Mass-weighted radius of gyration and largest distance from the centre of mass. masses: (element, mass)."""
    x = atoms.join(F.broadcast(masses), "element")  # one row an element
    m = x.groupBy(*keys).agg(F.sum("mass").alias("_w"), *[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"_{c}") for c in XYZ])
    d2 = sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in XYZ)
    return x.join(m, [*keys]).groupBy(*keys).agg(F.sqrt(F.sum(F.col("mass") * d2) / F.first("_w")).alias("rg"), F.sqrt(F.max(d2)).alias("max_d"))


def slab_density(atoms: DataFrame, axis: str, width: float, length: float, area: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Number density of each slab along an axis, mean and population sd over all frames."""
    n = int(round(length / width))
    slab = F.least(F.floor(F.col(axis) / width), F.lit(n - 1)).cast("int")
    counts = atoms.groupBy(*keys, slab.alias("slab")).agg(F.count("*").alias("c"))
    frames = atoms.select(*keys).distinct().agg(F.count("*").alias("frames"))
    sums = counts.groupBy("slab").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    v = width * area
    x = sums.crossJoin(F.broadcast(frames))  # one row
    mean = F.col("s") / F.col("frames")
    return x.select("slab", (mean / v).alias("mean"), (F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("frames") - mean * mean)) / v).alias("sd"))


def unwrap_molecule(atoms: DataFrame, bonds: DataFrame, box: float, most: int | None, keys: tuple[str, ...] = ("frame",), molecule: str = "mol") -> DataFrame:
    """Atoms imaged along a spanning tree of their bonds (molecule, a, b) from each molecule's least atom; an atom no bond reaches is null in x, y, z.

    The tree is found once on the bond table, level by level up to `most` bonds deep (None: to its end); a frame then adds
    up imaged bond vectors along each atom's path.
    """
    both = bonds.select(molecule, "a", "b").unionByName(bonds.select(molecule, F.col("b").alias("a"), F.col("a").alias("b")))
    front = both.groupBy(molecule).agg(F.min("a").alias("node")).select(molecule, "node", F.array("node").alias("path"))
    tree = front
    level = 0
    while most is None or level < most:
        level += 1
        nxt = front.withColumnRenamed("node", "a").join(both, [molecule, "a"]).groupBy(molecule, F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        front = materialise(nxt.join(tree.select(molecule, "node"), [molecule, "node"], "left_anti"))
        if front.isEmpty():
            break
        tree = tree.unionByName(front)
    at = atoms.select(*keys, molecule, "atom_id", F.struct(*XYZ).alias("p"))
    step = tree.select(molecule, F.col("node").alias("atom_id"), F.posexplode("path").alias("k", "via"))
    x = at.select(*keys, molecule, "atom_id").join(step, [molecule, "atom_id"]).join(at.withColumnsRenamed({"atom_id": "via"}), [*keys, molecule, "via"])
    steps = F.array_sort(F.collect_list(F.struct("k", "p")))  # as many as bonds on the path
    g = x.groupBy(*keys, molecule, "atom_id").agg(steps.alias("s"), F.max("k").alias("last"))
    moved = []
    for c in XYZ:
        first = F.element_at("s", 1)["p"][c]
        d = F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.get("s", i)["p"][c] - F.get("s", i - 1)["p"][c])
        total = F.aggregate(F.transform(d, lambda v: min_image(v, box)), F.lit(0.0), lambda s, v: s + v)
        moved.append(F.when(F.col("last") == 0, first).when(F.size("s") == F.col("last") + 1, first + total).alias(c))
    y = g.select(*keys, molecule, "atom_id", *moved)
    return at.select(*keys, molecule, "atom_id").join(y, [*keys, molecule, "atom_id"], "left")
