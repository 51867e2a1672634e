"""Merkle manifest of a dataset with nested-interval labels.

Leaves are digests of rows. In each group they stand in key order, and every `fan` consecutive nodes of a level become one
node above, until one is left; the groups' subroots form a tree of the same kind.

Every node carries the half-open interval of leaf ranks that it covers. At a level, a node's bucket is the start of its
interval over the level's width, so containment in the interval above is an equi-join on (group, bucket) with the two bounds
beside it: at most `fan` rows meet a parent, whatever the size of a group. Ancestors come down this way level by level, and
the children of a parent whose interval is not the node's own are its siblings.

Ranks come from a range partitioning on (group, keys, digest): the place in a task's sorted rows, less the group's first place
there, plus the counts of earlier tasks. No window holds a group. All work is in built-in functions.

Edge cases: groups and keys may be null (first); rows with equal keys stand in the order of their digests, equal rows in any,
which changes nothing. A single leaf is its group's subroot, a single subroot the root, and their proofs are empty. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialise

PLACE = (1 << 33) - 1


def canonical(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row: its columns in order, `-` if null, else byte count, colon, value as text. changed: values that stand in for columns."""
    fields = []
    for c in columns:
        v = (changed or {}).get(c, F.col(f"`{c}`")).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0, by group in the given order, nulls first) and n, the group's number of rows."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # groups and keys alone could be one value for most rows: a unique number beside them lets any range be split
    rows = rows.withColumn("_uid", F.monotonically_increasing_id())
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(tasks, *keys, "_uid").sortWithinPartitions(*keys, "_uid").drop("_uid")
    at = F.monotonically_increasing_id()  # task and place in it
    placed = materialise(dealt.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit(PLACE))}))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)  # a row for each task that holds some of the group
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    both = placed.join(parts, placed[group].eqNullSafe(parts["_g"]) & (placed["_part"] == parts["_p"]))
    return both.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_g", "_p", "_part", "_at", "_shift")


def parents(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """Nodes (g, lo, hi, n, digest) of `level` from those below, with their children (lo, hi, digest) in order. A group that has one node left gives none."""
    width = fan**level
    below = nodes.where(F.col("n") > width // fan)
    child = F.struct("lo", "hi", "digest")
    up = below.groupBy("g", F.floor(F.col("lo") / width).alias("bucket"), "n").agg(F.array_sort(F.collect_list(child)).alias("children"))
    return up.select("g", (F.col("bucket") * width).alias("lo"), F.least((F.col("bucket") + 1) * width, F.col("n")).alias("hi"), "n", F.sha2(F.array_join(F.col("children.digest"), ""), 256).alias("digest"), "children")


def apart(children: Column, lo: Column, hi: Column) -> Column:
    """Siblings of the node [lo, hi): what its parent's interval holds beside its own, as digests joined to the left and to the right of it."""
    joined = lambda of: F.array_join(F.transform(F.filter(children, of), lambda c: c["digest"]), "")
    return F.struct(joined(lambda c: c["hi"] <= lo).alias("left"), joined(lambda c: c["lo"] >= hi).alias("right"))


NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def levels_of(leaves: DataFrame, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """From leaves (g, rank, n, digest, row): the runs of `fan` leaves, which hold them in order, and the nodes of each level from the runs up."""
    leaf = F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "row")
    runs = leaves.groupBy("g", F.floor(F.col("rank") / fan).alias("bucket"), "n").agg(F.array_sort(F.collect_list(leaf), lambda a, b: F.signum(a["lo"] - b["lo"]).cast("int")).alias("leaves"))
    children = F.transform("leaves", lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest")))
    runs = runs.select("g", (F.col("bucket") * fan).alias("lo"), F.least((F.col("bucket") + 1) * fan, F.col("n")).alias("hi"), "n", "leaves", children.alias("children"))
    # a lone leaf is its subroot and stands for itself
    runs = materialise(runs.withColumn("digest", F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("children.digest"), ""), 256))))
    levels = [runs.select("g", "lo", "hi", "n", "digest")]
    most = runs.agg(F.max("n")).first()[0] or 0
    while fan ** len(levels) < most:
        levels.append(materialise(parents(levels[-1], len(levels) + 1, fan)))
    return runs, levels


def whole(levels: list[DataFrame]) -> DataFrame:
    """(g, digest) of the subroots: the nodes that cover their group."""
    return reduce(DataFrame.union, [x.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("g", "digest") for x in levels])


def with_paths(runs: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """Leaves as (digest, row, path, beside): path their siblings level by level, from the run up to the subroot and on by the path of tops, (g, path, beside), a row a group."""
    names = lambda df, *c: df.select(*[F.col(x).alias(f"_{x}") for x in c])
    above = None
    for k in range(len(levels) - 1, -1, -1):
        width = fan ** (k + 2)
        nodes = levels[k].select("g", "lo", "hi", "n")
        top = nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).join(names(tops, "g", "path", "beside"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "lo", "hi", F.col("_path").alias("path"), F.col("_beside").alias("beside"))
        if above is not None:
            up = names(levels[k + 1], "g", "lo", "hi", "children").join(above.select(F.col("g").alias("_h"), F.col("lo").alias("_l"), "path", "beside"), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_lo") == F.col("_l")))
            inside = F.col("g").eqNullSafe(F.col("_g")) & (F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width)) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            top = top.union(nodes.join(up, inside).select("g", "lo", "hi", F.concat(F.array(apart(F.col("_children"), F.col("lo"), F.col("hi"))), F.col("path")).alias("path"), "beside"))
        above = materialise(top)
    met = runs.join(names(above, "g", "lo", "path", "beside"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")))
    each = met.select("n", "children", F.col("_path").alias("path"), F.col("_beside").alias("beside"), F.explode("leaves").alias("leaf"))
    own = F.when(F.col("n") > 1, F.array(apart(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi")))).otherwise(F.expr(NO_PATH))
    return each.select(F.col("leaf.digest").alias("digest"), F.col("leaf.row").alias("row"), F.concat(own, F.col("path")).alias("path"), "beside")


def folded(digest: Column, path: Column) -> Column:
    """Root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, keep: list[str], changed: dict[str, Column] | None = None, altered: Column | None = None, fan: int = 8) -> DataFrame:
    """A row for each row of docs: the columns in keep, leaf, subroot, root, path (siblings level by level up to the root), proof_sha256, folded_root, verified.

    columns: what a leaf covers. changed: values of columns as they are found when the proof is held against a row, where `altered` is true; null counts as false.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *([] if changed is None else [F.when(F.coalesce(altered, F.lit(False)), canonical(docs, columns, changed)).alias("_now")]))
    rows = materialise(docs.select(F.col(f"`{group}`").alias("g"), F.col(f"`{order}`").alias("k"), canonical(docs, columns).alias("digest"), row.alias("row")))
    runs, levels = levels_of(ranked(rows, "g", ["k", "digest"]).drop("k"), fan)
    subroots = materialise(whole(levels)).select(F.lit(0).alias("one"), F.col("g").alias("k"), "digest", F.struct(F.col("g").alias("of")).alias("row"))
    top_runs, top_levels = levels_of(ranked(subroots, "one", ["k"]).select(F.col("one").alias("g"), "rank", "n", "digest", "row"), fan)
    root = (whole(top_levels).first() or {"digest": None})["digest"]
    end = docs.sparkSession.range(1).select(F.lit(0).alias("g"), F.expr(NO_PATH).alias("path"), F.lit(0).alias("beside"))
    tops = with_paths(top_runs, top_levels, end, fan).select(F.col("row.of").alias("g"), "path", F.col("digest").alias("beside"))
    leaves = with_paths(runs, levels, materialise(tops), fan)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    now = F.col("digest") if changed is None else F.coalesce("row._now", "digest")
    out = leaves.select("row", F.col("digest").alias("leaf"), F.col("beside").alias("subroot"), F.lit(root).cast("string").alias("root"), "path", proof.alias("proof_sha256"), folded(now, F.col("path")).alias("folded_root"))
    made = ["leaf", "subroot", "root", "path", "proof_sha256", "folded_root"]
    return out.select(*[F.col(f"row._k{i}").alias(c) for i, c in enumerate(keep) if c not in made], *made, (F.col("folded_root") == F.col("root")).alias("verified"))
