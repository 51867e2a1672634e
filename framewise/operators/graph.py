"""Graph operators on edges (keys, a, b), per frame or per molecule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialise


def both_ways(edges: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return edges.select(*keys, "a", "b", *more).unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), *more)).distinct()


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _firsts(rows: Column) -> Column:
    """The least struct of each value of the structs' field `at`, their first."""
    return _let(F.array_sort(rows), lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["at"] != x["at"])))


def _parted(edges: DataFrame, keys: list[str], small: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The edges, written once, with both ends; those of keys with up to `small`; the keys with more (None: no key has)."""
    e = materialise(edges.where(" and ".join(f"`{c}` is not null" for c in (*keys, "a", "b"))))
    large = materialise(e.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*keys))
    return (e, e, None) if large.isEmpty() else (e, e.join(large, keys, "left_anti"), large)


def shortest_path(edges: DataFrame, ends: DataFrame, most: int, keys: list[str], small: int = 64) -> DataFrame:
    """Fewest-edge path from source to target of each key (keys, source, target) over at most `most` undirected edges.

    Keys of up to `small` edges hold them in one array beside their ends, and all steps are taken in that row: one
    aggregation and one join for all such keys, whatever the number of steps. Larger keys go by rounds of a join and an
    aggregation. Of equal paths the least in order. Returns connected, n_bridging (-1 if none) and path.
    """
    e, some, large = _parted(edges.select(*keys, "a", "b"), keys, small)
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    held = some.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(F.array(way("a", "b"), way("b", "a"))))).alias("_e"))

    def step(s, i):
        ahead = lambda f: F.transform(F.filter("_e", lambda g: g["a"] == f["at"]), lambda g: F.struct(g["b"].alias("at"), F.concat(f["path"], F.array(g["b"])).alias("path")))
        more = F.flatten(F.transform(F.filter(s, lambda x: (F.size(x["path"]) == i) & (x["at"] != F.col("target"))), ahead))
        return F.concat(s, _firsts(F.filter(more, lambda m: ~F.exists(s, lambda y: y["at"] == m["at"]))))

    start = F.array(F.struct(F.col("source").alias("at"), F.array("source").alias("path")))
    reached = F.when(F.col("_e").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)).otherwise(start) if most > 0 else start
    path = F.get(F.filter(reached, lambda x: x["at"] == F.col("target")), F.lit(0))["path"]
    mine = ends if large is None else ends.join(large, keys, "left_anti")
    out = mine.select(*keys, "source", "target").join(held, keys, "left").select(*keys, "source", "target", path.alias("path"))
    if large is not None:
        out = out.unionByName(_path_rounds(e.join(large, keys, "left_semi"), ends.join(large, keys, "left_semi"), most, keys))
    return out.select(*keys, "source", "target", F.col("path").isNotNull().alias("connected"), F.coalesce(F.size("path") - 2, F.lit(-1)).alias("n_bridging"), "path")


def _path_rounds(edges: DataFrame, ends: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """Paths (null if none) of keys of any number of edges.

    One row a reached node carries its path and depth. A step joins the rows with the node's neighbours, keeps each row
    beside its extensions, and takes per node the shortest path, of equal ones the least in order: one join and one
    aggregation a step, every row of the step before read once. Rows are written to the shared folder every fourth step,
    and the steps end when none is left to extend.
    """
    near = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.groupBy(*keys, F.col("a").alias("at")).agg(F.collect_set("b").alias("near"))  # a node's degree
    at = [*keys, "source", "target", "at"]
    reached = ends.select(*keys, "source", "target", F.col("source").alias("at"), F.array("source").alias("path"))
    for step in range(most):
        grows = (F.size("path") == step + 1) & (F.col("at") != F.col("target")) & F.col("near").isNotNull()
        more = F.transform(F.filter("near", lambda v: ~F.array_contains("path", v)), lambda v: F.struct(v.alias("at"), F.concat("path", F.array(v)).alias("path")))
        rows = F.concat(F.array(F.struct("at", "path")), F.when(grows, more).otherwise(F.slice(more, 1, 0)))
        x = reached.join(near, [*keys, "at"], "left").select(*keys, "source", "target", F.inline(F.coalesce(rows, F.array(F.struct("at", "path")))))
        best = x.groupBy(*at).agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("m"))
        reached = best.select(*at, F.col("m.path").alias("path"))
        if step % 4 == 3 and step + 1 < most:
            reached = materialise(reached)
            if reached.where((F.size("path") == step + 2) & (F.col("at") != F.col("target"))).isEmpty():
                break
    best = reached.where("at = target").select(*keys, "source", "target", "path")
    return ends.select(*keys, "source", "target").join(best, [*keys, "source", "target"], "left")


def hbond_edges(bonds: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected edges between heavy atoms that share a hydrogen bond (keys, donor, h, acceptor, angle), each with its widest hydrogen."""
    a, b = F.least("donor", "acceptor"), F.greatest("donor", "acceptor")
    return bonds.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.max(F.struct("angle", "h", "donor")).alias("m")).select(*keys, "a", "b", F.col("m.h").alias("h"), F.col("m.donor").alias("donor"), F.col("m.angle").alias("angle"))


def path_shape(paths: DataFrame, atoms: DataFrame, box: float, keys: list[str]) -> DataFrame:
    """Contour length, end-to-end distance, mean angle between consecutive edges, loopiness 1 - end / contour."""
    from ..functions.exprs import angle_deg, min_image, norm

    p = paths.where("size(path) >= 2").select(*keys, F.posexplode("path").alias("k", "atom_id")).join(atoms.select(*keys, "atom_id", "x", "y", "z"), [*keys, "atom_id"])
    w = Window.partitionBy(*keys).orderBy("k")
    d = [min_image(F.lead(c).over(w) - F.col(c), box) for c in "xyz"]
    p = p.withColumns({f"d{c}": v for c, v in zip("xyz", d)}).where("dx is not null")
    p = p.withColumns({f"n{c}": F.lead(f"d{c}").over(w) for c in "xyz"})
    a, b = [F.col(f"d{c}") for c in "xyz"], [-F.col(f"n{c}") for c in "xyz"]
    g = p.groupBy(*keys).agg(F.sum(norm(a)).alias("contour"), F.avg(angle_deg(a, b)).alias("mean_angle"), *[F.sum(c).alias(f"e{i}") for i, c in enumerate(a)])
    end = norm([F.col(f"e{i}") for i in range(3)])
    return g.select(*keys, "contour", end.alias("end_to_end"), "mean_angle", (1 - F.try_divide(end, F.col("contour"))).alias("loopiness"))


def path_orientation(signs: Column) -> dict[str, Column]:
    """Mean sign and topology letters (P, D, L, R of consecutive signs) of an array of +1 / -1."""
    n = F.size(signs)
    pair = F.zip_with(F.slice(signs, F.lit(1), n - 1), F.slice(signs, F.lit(2), n - 1), lambda a, b: F.when((a > 0) & (b > 0), "P").when((a > 0) & (b < 0), "D").when((a < 0) & (b > 0), "L").otherwise("R"))
    return {"ksi": F.try_divide(F.aggregate(signs, F.lit(0.0), lambda s, x: s + x), n), "topology": F.when(n > 1, F.array_join(pair, "")).otherwise("")}


def degree(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct neighbours of one node a key (keys, node), 0 where it has none."""
    n = both_ways(edges, keys).groupBy(*keys, F.col("a").alias("node")).agg(F.count_distinct("b").alias("degree"))
    return nodes.select(*keys, "node").join(n, [*keys, "node"], "left").fillna(0, ["degree"])


def component_labels(edges: DataFrame, keys: list[str], small: int = 64) -> DataFrame:
    """Label (smallest node) of every linked node per key.

    Keys of up to `small` edges hold them in one array, and each edge in turn gives both its classes the smaller label:
    one aggregation for all such keys. Larger keys go by rounds of minima of neighbours' labels, then of the label's own
    label, until nothing changes.
    """
    e = edges.select(*keys, "a", "b").where("a is not null and b is not null")
    sizes = materialise(e.groupBy(*keys).agg(F.count("*").alias("_n")))
    some = e.join(sizes.where(F.col("_n") <= small).select(*keys), [*keys], "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("e"))
    nodes = F.array_sort(F.array_distinct(F.concat("e.a", "e.b")))
    start = F.transform(nodes, lambda v: F.struct(v.alias("node"), v.alias("label")))
    label = lambda s, v: F.get(F.filter(s, lambda x: x["node"] == v), F.lit(0))["label"]

    def merge(s, x):
        ends = F.array(label(s, x["a"]), label(s, x["b"]))
        return F.transform(s, lambda v: F.struct(v["node"].alias("node"), F.when(F.array_contains(ends, v["label"]), F.array_min(ends)).otherwise(v["label"]).alias("label")))

    out = some.select(*keys, F.inline(F.aggregate("e", start, merge)))
    if sizes.where(F.col("_n") > small).isEmpty():
        return out
    return out.unionByName(_spread_labels(e.join(sizes.where(F.col("_n") > small).select(*keys), [*keys], "left_semi"), keys))


def _spread_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    e = materialise(both_ways(edges, keys))
    lab = materialise(e.select(*keys, F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = e.join(lab.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("m"))
        nxt = lab.join(near, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "m").alias("m"))
        jump = nxt.select(*keys, F.col("node").alias("m"), F.col("m").alias("far"))
        nxt = materialise(nxt.join(jump, [*keys, "m"]).select(*keys, "node", "label", "far"))
        done = nxt.where("label <> far").isEmpty()
        lab = nxt.select(*keys, "node", F.col("far").alias("label"))
        if done:
            return lab


def largest_component(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Number of nodes in the largest connected component of each key."""
    return component_labels(edges, keys).groupBy(*keys, "label").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("largest"))


def five_rings(edges: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Five-membered cycles through an anchor (keys, node), as sorted node arrays."""
    e = both_ways(edges, keys)
    step = lambda i: e.select(*keys, F.col("a").alias(f"n{i}"), F.col("b").alias(f"n{i + 1}"))
    x = anchors.select(*keys, F.col("node").alias("n0"))
    for i in range(4):
        x = x.join(step(i), [*keys, f"n{i}"]).where(" and ".join(f"n{i + 1} <> n{j}" for j in range(i + 1)))
    x = x.join(e.select(*keys, F.col("a").alias("n4"), F.col("b").alias("n0")), [*keys, "n4", "n0"])
    return x.select(*keys, F.col("n0").alias("anchor"), F.array_sort(F.array(*[f"n{i}" for i in range(5)])).alias("ring")).distinct()


def network_potentials(edges: DataFrame, anchor: DataFrame, most: int | None, keys: list[str], small: int = 64) -> DataFrame:
    """Potential of every node from signed gaps (a to b: + gap) outward from the anchor (keys, node, potential); spread tells how far cycles fail to close.

    Networks are molecules: keys of up to `small` edges stand in one array, and all rounds are taken in that row, one
    aggregation and one join for all such keys; larger ones go by rounds of a join and an aggregation, each of which
    reaches the next nodes. most: rounds (None: until no key gains a node). A node that several edges reach in one round
    takes the least value. An edge without an end is none.
    """
    e, some, large = _parted(edges.select(*keys, "a", "b", "gap"), keys, small)
    way = lambda a, b, gap: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), gap.alias("gap"))
    held = some.groupBy(*keys).agg(F.flatten(F.collect_list(F.array(way("a", "b", F.col("gap")), way("b", "a", -F.col("gap"))))).alias("_e"))
    mine = anchor if large is None else anchor.join(large, keys, "left_anti")
    # a key that is null meets no edges, but its anchors stand
    x = mine.groupBy(*keys).agg(F.collect_list(F.struct(F.col("node").alias("at"), F.col("potential").alias("v"), F.lit(0).alias("step"))).alias("_at")).join(held, keys, "left")

    def step(s, i):
        ahead = lambda f: F.transform(F.filter("_e", lambda g: g["a"] == f["at"]), lambda g: F.struct(g["b"].alias("at"), (f["v"] + g["gap"]).alias("v"), (i + 1).alias("step")))
        more = F.flatten(F.transform(F.filter(s, lambda y: y["step"] == i), ahead))
        return F.concat(s, _firsts(F.filter(more, lambda m: ~F.exists(s, lambda y: y["at"] == m["at"]))))

    rounds = F.coalesce(F.size("_e") / 2, F.lit(0)).cast("int")  # no path has more edges than there are
    rounds = rounds if most is None else F.least(rounds, F.lit(most))
    seen = F.when(rounds > 0, F.aggregate(F.sequence(F.lit(0), rounds - 1), _firsts(F.col("_at")), step)).otherwise(_firsts(F.col("_at")))
    off = lambda s, y: F.array_max(F.transform(F.filter("_e", lambda g: g["a"] == y["at"]), lambda g: F.abs(y["v"] + g["gap"] - F.get(F.filter(s, lambda z: z["at"] == g["b"]), F.lit(0))["v"])))
    told = _let(seen, lambda s: F.transform(s, lambda y: F.struct(y["at"].alias("node"), y["v"].alias("potential"), off(s, y).alias("spread"))))
    out = x.select(*keys, F.inline(told))
    if large is not None:
        out = out.unionByName(_potential_rounds(e.join(large, keys, "left_semi"), anchor.join(large, keys, "left_semi"), most, keys))
    return out.fillna(0.0, ["spread"])


def _potential_rounds(edges: DataFrame, anchor: DataFrame, most: int | None, keys: list[str]) -> DataFrame:
    """Potentials of keys of any number of edges."""
    both = materialise(edges.select(*keys, "a", "b", "gap").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("gap")).alias("gap"))))
    reach = both.groupBy(*keys, "a").agg(F.collect_list(F.struct("b", "gap")).alias("near"))  # a node's degree
    seen = anchor.select(*keys, F.col("node").alias("a"), F.col("potential").alias("v"), F.lit(0).alias("step"))
    step = 0
    while most is None or step < most:
        for _ in range(4 if most is None else min(4, most - step)):
            more = F.when(F.col("step") == step, F.transform("near", lambda e: F.struct(e["b"].alias("a"), (F.col("v") + e["gap"]).alias("v"), F.lit(step + 1).alias("step"))))
            rows = F.concat(F.array(F.struct("a", "v", "step")), F.coalesce(more, F.slice(F.array(F.struct("a", "v", "step")), 1, 0)))
            x = seen.join(reach, [*keys, "a"], "left").select(*keys, F.inline(rows))
            seen = x.groupBy(*keys, "a").agg(F.min(F.struct("step", "v")).alias("m")).select(*keys, "a", F.col("m.v").alias("v"), F.col("m.step").alias("step"))
            step += 1
        seen = materialise(seen)
        if seen.where(F.col("step") == step).isEmpty():
            break
    v = seen.select(*keys, F.col("a").alias("node"), F.col("v").alias("potential"))
    ends = both.join(v.select(*keys, F.col("node").alias("a"), F.col("potential").alias("va")), [*keys, "a"]).join(v.select(*keys, F.col("node").alias("b"), F.col("potential").alias("vb")), [*keys, "b"])
    off = ends.groupBy(*keys, F.col("a").alias("node")).agg(F.max(F.abs(F.col("va") + F.col("gap") - F.col("vb"))).alias("spread"))
    return v.join(off, [*keys, "node"], "left")
