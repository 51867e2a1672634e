"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints: XXH64 of word shingles, one bit a hash majority. Links: pairs at `distance` or fewer differing bits.
Upper nodes of the index are masked bit patterns: the 64 bits are dealt into distance + 2 blocks, and two fingerprints
within the distance agree in at least two whole blocks, so they share one of the C(distance + 2, 2) nodes (mask, pattern)
of about 25 bits. Nodes are shuffle keys: each holds its fingerprints in Gray order, and inside a node a tree of runs in
Gray order carries the bits that all members of a run share. A pair of runs is left out as a whole when their shared
bits already differ by more than the distance, or when both lie in one component. A node beyond max_node fingerprints
is cut into tiles in Gray order; tile pairs that may hold links are searched as tasks of their own. Equal fingerprints
are one entry throughout, so groups of copies cost one row here.

Edge cases: a null or empty text has fingerprint zero and is linked like any other. Rows with a null id are linked but
never name a component unless all ids in it are null. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .text import components, kept_rows, map_rows, numbered, utf8

LEAF, FAN = 16, 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of one text."""
    parts = utf8(text).lower().split()
    if not parts:
        return 0
    line, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        h = [digest(line, seed)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        h = [digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :])]
    n = len(h)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits += np.unpackbits(np.array(h[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in keep) with fp, the fingerprint as a signed long."""

    def make():
        return lambda t: ((f := fingerprint(t, words)) - (f >> 63 << 64),)

    return map_rows(docs, ["text"], make, "fp bigint", keep=keep)


def gray_rank(fp: Column) -> Column:
    """Position of a code in Gray order, as a signed long that sorts like the unsigned rank."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def masks(distance: int) -> list[int]:
    """Masks of the upper nodes: two of distance + 2 blocks of bits."""
    n = distance + 2
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(block, 2)]


class Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up != (two := up[up])).any():
            up = two
        self.up = up.tolist()
        return up


def forest(codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what all pairs within the distance connect. codes: distinct, in Gray order."""
    n, sets, out = len(codes), Sets(len(codes)), []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(codes[i] ^ codes[j]) <= distance
        out.extend(p for p in zip(i[near].tolist(), j[near].tolist()) if sets.join(*p))

    every = np.arange(n)
    for step in range(1, min(n, LEAF)):
        add(every[:-step], every[step:])
    if n <= LEAF:
        return out
    levels, width = [], LEAF
    while True:
        at = np.arange(0, n, width)
        low, high = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        levels.append((at, low, ~(low ^ high)))
        if len(at) <= FAN:
            break
        width *= FAN
    k = len(levels[-1][0])
    stack = [(len(levels) - 1, *np.triu_indices(k))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 4096:
            stack += [(level, a[4096:], b[4096:]), (level, a[:4096], b[:4096])]
            continue
        at, pattern, shared = levels[level]
        roots = sets.roots()
        first, last = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        one = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b])
        open_ = ~one & (np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b]) <= distance)
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        size, span = (len(levels[level - 1][0]), FAN) if level else (n, LEAF)
        i = (a[:, None, None] * span + np.arange(span)[None, :, None] + np.zeros((1, 1, span), int)).ravel()
        j = (b[:, None, None] * span + np.arange(span)[None, None, :] + np.zeros((1, span, 1), int)).ravel()
        fits = (i < size) & (j < size) & (i <= j if level else i < j)
        i, j = i[fits], j[fits]
        if level:
            stack.append((level - 1, i, j))
        else:
            add(i, j)
    return out


def _search(distance: int, max_node: int):
    """Arrow function over rows (node..., fp) that come sorted by node, then Gray rank: links of each node, and the rows of nodes that are too large, with their tile."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tile", pa.int32())])

    def small(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        """Links of whole nodes, the small ones together."""
        cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]])
        size, out = np.diff(cut), []
        home = np.repeat(np.arange(len(size)), size)
        some, sets = np.flatnonzero((size > 1) & (size <= LEAF)), None
        if len(some):
            pick = np.flatnonzero(np.isin(home, some))
            f, h, sets = fps[pick], home[pick], Sets(len(pick))
            for step in range(1, int(size[some].max())):
                i = np.flatnonzero((h[step:] == h[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance))
                out += [(int(f[x]), int(f[x + step])) for x in i.tolist() if sets.join(x, x + step)]
        for g in np.flatnonzero(size > LEAF):
            f = fps[cut[g] : cut[g + 1]]
            out += [(int(f[i]), int(f[j])) for i, j in forest(f, distance)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over, done = None, None, None, 0
        signed = lambda x: x - (x >> 63 << 64)

        def links(found):
            return pa.RecordBatch.from_arrays([pa.array([signed(x) for x, _ in found], pa.int64()), pa.array([signed(y) for _, y in found], pa.int64()), pa.array([None] * len(found), pa.int32())], schema=schema)

        def spill(k, f):
            tile = (np.arange(done, done + len(f)) // (max_node // 2)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(k[:, -1]), pa.array(f.view(np.int64)), pa.array(tile)], schema=schema)

        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns - 1)], axis=1)
            f = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(f):
                continue
            keys, fps = (k, f) if keys is None else (np.concatenate([keys, k]), np.concatenate([fps, f]))
            if over is not None:
                same = (keys == over).all(axis=1)
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield spill(keys[:n], fps[:n])
                    done += n
                keys, fps = keys[n:], fps[n:]
                if not len(fps):
                    continue
                over = None
            # nodes before the last one are whole; those beyond max_node go out as tiles
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for i, j in zip(cut, [*cut[1:], len(fps)]):
                if j - i > max_node:
                    done = 0
                    yield spill(keys[i:j], fps[i:j])
                    if j == len(fps):
                        over, done = keys[i].copy(), j - i
            whole = [(i, j) for i, j in zip(cut, cut[1:]) if j - i <= max_node]
            if whole:
                pick = np.concatenate([np.arange(i, j) for i, j in whole]) if len(whole) < len(cut) - 1 else np.arange(cut[-1])
                yield links(small(keys[pick], fps[pick]))
            at = len(fps) if over is not None else cut[-1]
            keys, fps = keys[at:], fps[at:]
        if fps is not None and len(fps):
            yield links(small(keys, fps))

    return run


def links(codes: DataFrame, distance: int = 3, max_node: int = 65536) -> DataFrame:
    """Links (a, b) between the distinct longs in codes.fp that connect all that lie within the distance of each other."""
    nodes = F.explode(F.array(*[F.struct(F.lit(c).alias("node"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("pattern")) for c, m in enumerate(masks(distance))]))
    entry = codes.select(nodes.alias("n"), "fp").select("n.node", "n.pattern", "fp")
    grouped = entry.repartition("node", "pattern").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("node", "pattern", "rank").select("node", "pattern", "fp")
    found = materialise(grouped.mapInArrow(_search(distance, max_node), "a bigint, b bigint, tile int"))
    large = found.where("tile is not null").select(F.col("a").alias("pattern"), F.col("b").alias("fp"), "tile")
    done = found.where("tile is null").select("a", "b")
    if large.isEmpty():
        return done
    # patterns of different masks never meet here unless they are equal, and then a pair more is searched, none lost
    top = large.groupBy("pattern", "tile").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    x, y = top.alias("x"), top.alias("y")
    differ = "bit_count((x.low ^ y.low) & ~(x.low ^ x.high) & ~(y.low ^ y.high))"
    pairs = x.join(y, (F.col("x.pattern") == F.col("y.pattern")) & (F.col("x.tile") <= F.col("y.tile"))).where(f"{differ} <= {distance}")
    pairs = pairs.select(F.col("x.pattern").alias("pattern"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    both = pairs.select("pattern", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    rows = large.join(both, ["pattern", "tile"]).select("pattern", "i", "j", "fp").distinct()
    rows = rows.repartition("pattern", "i", "j").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("pattern", "i", "j", "rank").select("pattern", "i", "j", "fp")
    return done.union(rows.mapInArrow(_search(distance, 1 << 40), "a bigint, b bigint, tile int").select("a", "b"))


def classes(marked: DataFrame, distance: int = 3, max_node: int = 65536) -> DataFrame:
    """For each distinct fp of marked (already materialised): fp, root (the fp that stands for its component)."""
    codes = marked.select("fp").distinct()
    roots = components(links(codes, distance, max_node))
    return codes.join(roots, codes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, max_node: int = 65536) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    marked = materialise(fingerprints(docs, words, ["doc_id"]))
    found = materialise(classes(marked, distance, max_node))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("d")).join(found, "fp")
    names = least.groupBy("root").agg(F.min("d").alias("component_id")).join(found, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3, max_node: int = 65536) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (nulls last); among repeated rows, any one of the equal ones. Columns of docs may have any name and type."""
    rows = numbered(docs)
    marked = materialise(fingerprints(rows.select("uid", "row.doc_id", "row.text"), words, ["uid", "doc_id"]))
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"))
    kept = best.join(classes(marked, distance, max_node), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.uid")
    return kept_rows(rows, marked, kept)
