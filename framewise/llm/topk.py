"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are cut by dimension into `lists` parts, each a table of its own; a score is the sum of what the lists give. For a
block of queries:

1. Each task over a list keeps its local list of the highest partial scores of each query; the highest of all tasks name the
   first candidates, whose whole scores give a k-th best, and so a lower bound t of the final one.
2. t is broadcast. What has less than t / lists in every list has less than t altogether, so each list sends only its entries
   of t / lists or more. Entries that all lists sent are whole; they raise the bound.
3. The others could reach at most what was sent plus t / lists for each list that did not send; those that can still reach
   the bound are scored from their whole vectors.

No step leaves out a row that could be among the k best. Equal vectors are one entry with its k + 1 first rows (no more of
them can be wanted by one query), and equal queries are searched once, so a vector that a third of all rows share costs no
more than another. Queries pass in blocks of a bounded number, which are broadcast.

Scores are exact integers: doubles where all products are below 2**53, longs below 2**63; beyond that an error is raised.

Edge cases: vectors that are null or hold null or non-finite components take no part; shorter vectors end in zeros; an empty
vector scores 0 with all. Ties go to the smaller id, null ids last. A repeated row is a row: the copy of a query's own row is
one of its candidates. A query with fewer than k candidates gets all. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import materialise
from .text import share
from .vectors import matrix

#: Queries and rows that are multiplied at a time: 16 MB of scores.
TILE = 1024


def _coded(scale: int):
    """Arrow function: rows (id, wanted, v) to (id, wanted, code), code the components floor(scale * x) as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = matrix(batch.column(2))
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)[usable].astype(int)
            x = np.floor(scale * x)
            if x.size and np.abs(x).max() >= 2.0**63:
                raise ValueError("a component does not fit a long")
            x = x.astype("<i8")
            kept = pa.array(np.flatnonzero(usable))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array([r[:n].tobytes() for r, n in zip(x, size)], pa.binary())], names=["id", "wanted", "code"])

    return run


def _longs(codes: pa.Array, dim: int) -> np.ndarray:
    """Codes as rows of longs, zeros at the end of shorter ones."""
    whole = [c.ljust(8 * dim, b"\0") for c in codes.to_pylist()]
    return np.frombuffer(b"".join(whole), "<i8").reshape(len(whole), dim)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with those of y, as doubles where these hold them, else as longs."""
    most = [max((abs(int(f(a))) for f in (np.min, np.max)), default=0) if a.size else 0 for a in (x, y)]
    bound = most[0] * most[1] * x.shape[1]
    if bound < 2**53:
        return x.astype(np.float64) @ y.astype(np.float64).T
    if bound < 2**63:
        return x @ y.T
    raise ValueError("inner products do not fit a long")


class Queries:
    """A block of queries, as broadcast: their longs and, by query, the bound of the second phase (None: all entries are wanted)."""

    def __init__(self, x: np.ndarray, least: list[int | None] | None = None):
        self.x, self.least = x, least


SENT = pa.schema([("q", pa.int32()), ("eid", pa.int64()), ("s", pa.int64())])


def _sent(q: np.ndarray, eid: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(eid), pa.array(s.astype(np.int64))], schema=SENT)


def _local_lists(queries, low: int, high: int, k: int):
    """Arrow function over a list's rows (eid, part): the k highest partial scores of each query among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = queries().x[:, low:high]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                eid, y = part.column(0).to_numpy(), _longs(part.column(1), high - low)
                for i in range(0, len(x), TILE):
                    s = _products(x[i : i + TILE], y)
                    e = np.broadcast_to(eid, s.shape)
                    if i in best:
                        s, e = np.concatenate([best[i][0], s], axis=1), np.concatenate([best[i][1], e], axis=1)
                    if s.shape[1] > k:
                        top = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
                        s, e = np.take_along_axis(s, top, 1), np.take_along_axis(e, top, 1)
                    best[i] = s, e
        for i, (s, e) in best.items():
            yield _sent(np.repeat(np.arange(i, i + len(s)), s.shape[1]), e.ravel(), s.ravel())

    return run


def _above(queries, low: int, high: int, lists: int):
    """Arrow function over a list's rows (eid, part): the entries whose partial score is at least the query's bound divided by lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = queries()
        x = block.x[:, low:high]
        least = np.array([-(1 << 62) if t is None else -(-t // lists) for t in block.least], np.int64)  # s >= t / lists
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                eid, y = part.column(0).to_numpy(), _longs(part.column(1), high - low)
                for i in range(0, len(x), TILE):
                    s = _products(x[i : i + TILE], y)
                    q, j = np.nonzero(s >= least[i : i + TILE, None])
                    yield _sent(q + i, eid[j], s[q, j])

    return run


def _whole(queries):
    """Arrow function over rows (eid, qs, code): the whole scores of an entry with the queries in qs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = queries().x
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                eid, y = part.column(0).to_numpy(), _longs(part.column(2), x.shape[1])
                held = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(int)
                q, j = part.column(1).flatten().to_numpy(), np.repeat(np.arange(len(eid)), held)
                for a in range(0, len(q), 16 * TILE):
                    u, v = x[q[a : a + 16 * TILE]], y[j[a : a + 16 * TILE]]
                    bound = int(np.abs(u).max(initial=0)) * int(np.abs(v).max(initial=0)) * u.shape[1]
                    if bound >= 2**63:
                        raise ValueError("inner products do not fit a long")
                    yield _sent(q[a : a + 16 * TILE], eid[j[a : a + 16 * TILE]], np.einsum("ij,ij->i", u, v))

    return run


def _of(spark: SparkSession, codes: pa.Table, dim: int, least=None):
    return share(spark, Queries(_longs(codes.column("code").combine_chunks(), dim), least))


def _best(df: DataFrame, by: list[str], k: int, *ties: Column) -> DataFrame:
    """The k rows of highest s in each group; tasks cut their groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("s").desc(), *ties)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= k).drop("_nth")


def _block(entries: DataFrame, parts: list[tuple[DataFrame, int, int]], codes: pa.Table, dim: int, k: int) -> DataFrame:
    """(q, eid, s, members): for the queries of one block, by place in codes, the k best entries."""
    spark, lists = entries.sparkSession, len(parts)
    block = _of(spark, codes, dim)
    ddl = "q int, eid bigint, s bigint"

    def resolved(pairs: DataFrame, bounded: bool) -> DataFrame:
        asked = pairs.groupBy("eid").agg(F.collect_set("q").alias("qs"))  # a block's queries at most
        rows = entries.select("eid", "code").join(F.broadcast(asked) if bounded else asked, "eid").select("eid", "qs", "code")
        return rows.mapInArrow(_whole(block), ddl)

    local = [part.mapInArrow(_local_lists(block, low, high, k), ddl).withColumn("list", F.lit(j)) for j, (part, low, high) in enumerate(parts)]
    named = _best(reduce(DataFrame.union, local), ["q", "list"], k, F.col("eid"))
    first = materialise(resolved(named.select("q", "eid").distinct(), bounded=True))  # at most lists * k pairs a query
    kth = first.groupBy("q").agg(F.try_element_at(F.sort_array(F.collect_list("s"), False), F.lit(k)).alias("t")).collect()
    least: list[int | None] = [None] * codes.num_rows
    for r in kth:
        least[r["q"]] = r["t"]
    cut = _of(spark, codes, dim, least)
    sent = reduce(DataFrame.union, [part.mapInArrow(_above(cut, low, high, lists), ddl) for part, low, high in parts])
    second = materialise(sent.groupBy("q", "eid").agg(F.sum("s").alias("s"), F.count("*").alias("seen")).join(first.select("q", "eid"), ["q", "eid"], "left_anti"))
    known = first.union(second.where(F.col("seen") == lists).select("q", "eid", "s"))
    top = _best(known, ["q"], k, F.col("eid")).groupBy("q").agg(F.when(F.count("*") == k, F.min("s")).alias("low"))
    first_cut = spark.createDataFrame([(q, t) for q, t in enumerate(least)], "q int, t bigint")
    bounds = F.broadcast(materialise(top.join(first_cut, "q")))  # a row a query of the block
    open_ = second.where(F.col("seen") < lists).join(bounds, "q").where(lists * F.col("s") + (lists - F.col("seen")) * F.col("t") > lists * F.col("low"))
    every = known.union(resolved(open_.select("q", "eid"), bounded=False))
    kept = every.join(bounds.select("q", "low"), "q").where("low is null or s >= low").select("q", "eid", "s")
    ends = kept.join(entries.select("eid", "members"), "eid")
    m = F.col("members")[0]
    return _best(ends, ["q"], k, m["none"], m["id"], m["uid"])


def search(vectors: DataFrame, wanted: Column, k: int = 10, lists: int = 2, scale: int = 1024, block: int = 8192, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): for each row of vectors where `wanted` holds, its k best other rows by the inner product of floor(scale * x).

    lists: parts of the dimensions, one threshold each; more of them send more entries. block: about so many queries are broadcast at a time (8 bytes a component).
    """
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.coalesce(wanted, F.lit(False)).alias("wanted"), F.col(f"`{embedding}`").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = materialise(rows.mapInArrow(_coded(scale), f"id {kind}, wanted boolean, code binary").withColumn("uid", F.monotonically_increasing_id()))
    spark, more = rows.sparkSession, k + 1  # one more than asked for, as the query's own row is among them
    w = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last(), "uid")
    few = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= more)
    member = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    entries = materialise(few.groupBy("code").agg(F.array_sort(F.collect_list(member)).alias("members")).withColumn("eid", F.monotonically_increasing_id()))
    asked = rows.where("wanted").select("code").distinct()
    queries = materialise(entries.join(asked, "code", "left_semi").select("eid", "code"))
    blocks = -(-queries.count() // block)
    if blocks > 1:
        queries = materialise(queries.repartition(blocks).withColumn("block", F.spark_partition_id()))
    else:
        queries = queries.withColumn("block", F.lit(0))
    dim = (entries.agg(F.max(F.length("code"))).first()[0] or 0) // 8
    cuts = [round(i * dim / lists) for i in range(lists + 1)]
    parts = [(materialise(entries.select("eid", F.expr(f"substring(code, {8 * a + 1}, {8 * (b - a)})").alias("part"))), a, b) for a, b in zip(cuts, cuts[1:])]
    found = []
    for i in range(blocks):
        codes = queries.where(F.col("block") == i).select("eid", "code").toArrow()
        names = spark.createDataFrame([(q, e) for q, e in enumerate(codes.column("eid").to_pylist())], "q int, query bigint")
        found.append(materialise(_block(entries, parts, codes, dim, more).join(F.broadcast(names), "q").select("query", F.col("s").alias("score"), "members")))
    out = f"query_id {kind}, rank int, `{id}` {kind}, score bigint"
    if not found:
        return spark.createDataFrame([], out)
    # of each query's entries, rows in order; as many as can be wanted
    each = F.transform("members", lambda m: F.struct((-F.col("score")).alias("minus"), m["none"].alias("none"), m["id"].alias("id"), m["uid"].alias("uid")))
    tops = reduce(DataFrame.union, found).groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, more).alias("top"))
    tops = tops.join(entries.select(F.col("eid").alias("query"), "code"), "query").select("code", "top")
    own = rows.where("wanted").select("code", F.col("id").alias("query_id"), F.col("uid").alias("own")).join(tops, "code")
    listed = own.select("query_id", F.posexplode(F.slice(F.filter("top", lambda t: t["uid"] != F.col("own")), 1, k)).alias("at", "t"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias(id), (-F.col("t.minus")).alias("score"))
