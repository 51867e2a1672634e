"""Near duplicates by the exact Jaccard similarity of word shingles.

Candidates: the Gray-order index of simhash.py over fingerprints of the shingles (NEAR bits), and for the similar texts whose
fingerprints lie farther apart, as most of a similarity under 0.95 do, MinHash of the shingle set, `bands` keys of `rows` minima each. Two texts of similarity s share a key but with
probability (1 - s ** rows) ** bands: 7e-5 at 0.8 for 24 bands of 5, less above. Links: candidates whose shingle sets,
made anew from the texts, have at least the asked similarity.

Texts of one shingle set, by two hashes of it, are one entry. Each entry is first held against the least and the largest
entry of its keys, so that a large group of near copies costs a few pairs a member. Then all pairs of a key that are not yet
in one component and can still be links are held against each other.

Which can: a shingle that one component alone holds is in no pair across components. So of an entry with n shingles, c of
them held by more than one component of such keys, at most c can be shared, and a pair has a similarity of at most
m / (n1 + n2 - m), m the lesser c. Entries with c under similarity * n leave; in keys with more than CROWD components, where
a group of texts just under the similarity would else cost the square of its size, the entry with the largest share c / n is
a second pivot; then c is counted again among those that stay, since the shingles that only those share which have left, and
those of components that have become one, are in no pair. A pair with several keys meets in the least of them. Each candidate
also has a parity bitmap of its shingles, two bits and more for each: a shingle that one of two texts has alone flips one
bit, so the bits in which two bitmaps differ are at most the shingles in which the texts differ, and bound what they share;
no pair's texts are fetched before this test. Both bounds are exact: no pair that could be a link is left out.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty texts have none and are one entry. Letters
are lower-cased in the ASCII range only, and white space is a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from . import simhash
from .text import components, kept_rows, map_rows, numbered, trim, utf8

#: Entries whose keys are broadcast to fetch their texts; more of them are joined by a shuffle.
MOST = 1_000_000
#: Keys with more components than this have a second pivot.
CROWD = 64
#: About so many texts are held against one in one run of rows; a text with more candidates gets several runs.
CHUNK = 128
#: Differing bits of fingerprints up to which the Gray-order index links them.
NEAR = 3


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """Distinct word shingles of one text."""
    parts = utf8(text).lower().split()
    if len(parts) <= words:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def similar(x: set[bytes], y: set[bytes], similarity: float = 0.8) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least `similarity`, held to six decimals."""
    both = len(x & y)
    return 1_000_000 * both >= round(1_000_000 * similarity) * (len(x) + len(y) - both)


def sketch(found: set[bytes], bands: int, rows: int) -> tuple[int, int, list[int]]:
    """Two hashes of a shingle set, and its band keys (none for an empty set)."""
    if not found:
        return 0, 0, []
    digest = xxhash.xxh64_intdigest
    h = np.sort(np.array([digest(s, 42) for s in found], np.uint64))
    rng = np.random.default_rng(42)
    a, b = rng.integers(0, 1 << 63, (2, bands * rows, 1), np.uint64)
    a = 2 * a + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (a * h[None, i : i + 2048] + b).min(axis=1), out=least)
    signed = lambda x: x - (x >> 63 << 64)
    return signed(digest(h.tobytes(), 1)), signed(digest(h.tobytes()[::-1], 2)), [signed(digest(k.tobytes(), i)) for i, k in enumerate(least.reshape(bands, rows))]


def _near(similarity: float, words: int):
    """Arrow function over rows (a, b, text) that come as runs of a text (b null) and the texts held against it: pairs (a, b) of the asked similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = set()
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):  # bounds what the Python lists hold
                for a, b, t in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    y = shingles(t, words)
                    if b is None:
                        x = y
                    elif similar(x, y, similarity):
                        found.append((a, b))
            batch = y = None
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=schema)
        x = None
        trim()

    return run


def _hashes(words: int):
    """Arrow function over rows (sid, text): the text's distinct shingle hashes, one a row."""
    schema = pa.schema([("sid", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.unique(np.array([xxhash.xxh64_intdigest(s, 7) for s in shingles(text, words)], np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sid)), pa.array(h)], schema=schema)
        trim()

    return run


def _parities(words: int):
    """Arrow function over rows (sid, text): the parity bitmap of the text's shingles, in a power of two of longs, two to four bits a shingle."""
    schema = pa.schema([("sid", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def bitmap(text: str | None) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(s, 7) for s in shingles(text, words)], np.uint64)
        size = 1 << max(0, (2 * len(h) - 1).bit_length() - 6)
        odd = np.bincount((h % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([bitmap(t) for t in texts], pa.list_(pa.int64()))], schema=schema)
        trim()

    return run


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two parity bitmaps differ; the longer one is folded to the length of the other."""
    size = F.least(F.size(x), F.size(y))
    zero = F.lit(0).cast("bigint")
    folded = lambda b: F.when(F.size(b) == size, b).otherwise(
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.sequence(i, F.size(b) - 1, size), zero, lambda s, k: s.bitwiseXOR(F.get(b, k))))
    )
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda s, v: s + F.bit_count(v))


def _fits(similarity: float, na: Column, ca: Column, nb: Column, cb: Column) -> Column:
    """Whether two entries of n shingles, at most c of them shared, can be links: the test of `similar` with the most they could share."""
    both = F.least(ca, cb).cast("bigint")
    return 1_000_000 * both >= round(1_000_000 * similarity) * (na + nb - both)


def _close(similarity: float, na: Column, x: Column, nb: Column, y: Column) -> Column:
    """Whether two entries of n shingles can be links by their parity bitmaps."""
    both = F.floor((na + nb - _differ(x, y)) / 2)
    return _fits(similarity, na, both, nb, both)


def indexed(entries: DataFrame) -> DataFrame:
    """Candidates (a, b) of the Gray-order index over the entries (sid, fp): entries of one fingerprint beside the least of them, and that one for each linked fingerprint."""
    first = materialise(entries.groupBy("fp").agg(F.min("sid").alias("low"), F.max("sid").alias("high")))
    same = entries.join(first.where("low <> high"), "fp").where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    end = lambda e: first.select(F.col("fp").alias(e), F.col("low").alias(f"low{e}"))
    linked = simhash.links(first.select("fp"), NEAR).join(end("a"), "a").join(end("b"), "b")
    return same.union(linked.select("lowa", "lowb"))


def links(entries: DataFrame, texts, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Links (a, b) between the entries (sid, n shingles, fp, keys) that connect all candidates of the asked similarity. texts: function from sids to (sid, text)."""
    near = materialise(indexed(entries))
    key = entries.select("sid", "n", F.explode("keys").alias("key"))
    ends = key.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high")
    shared = materialise(key.join(ends, "key"))
    text = materialise(texts(shared.select("sid").union(near.select("a")).union(near.select("b")).distinct()))
    bits = materialise(text.mapInArrow(_parities(words), "sid bigint, bits array<bigint>"))

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs that can be links by their bitmaps."""
        side = lambda e: bits.join(entries.select("sid", "n"), "sid").select(F.col("sid").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"bits{e}"))
        x = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
        return x.where(_close(similarity, F.col("na"), F.col("bitsa"), F.col("nb"), F.col("bitsb"))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = materialise(both)
        dealt = both.join(both.groupBy("a").agg(F.count("*").alias("_n")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.floor(1 + F.col("_n") / CHUNK)).alias("chunk"))
        heads = dealt.select("a", "chunk").distinct().join(text, F.col("a") == F.col("sid")).select("a", "chunk", F.lit(None).cast("bigint").alias("b"), "text")
        rows = heads.union(dealt.join(text, F.col("b") == F.col("sid")).select("a", "chunk", "b", "text"))
        rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()).select("a", "b", "text")
        return materialise(rows.mapInArrow(_near(similarity, words), "a bigint, b bigint"))

    def opened(found: DataFrame) -> DataFrame:
        """Members (key, root, n, sid) of the keys that hold more than one component, with their number of components."""
        roots = components(found)
        rooted = shared.join(roots, shared.sid == roots.node, "left").select("key", F.coalesce("root", "sid").alias("root"), "n", "sid")
        some = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        live = rooted.join(some, "key")
        return materialise(live.join(live.select("key", "root").distinct().groupBy("key").agg(F.count("*").alias("crowd")), "key"))

    found = verified(close(near.union(shared.select(F.col("sid").alias("a"), F.explode(F.array("low", "high")).alias("b")))))
    live = opened(found)
    held = materialise(live.select("sid").distinct().join(text, "sid").mapInArrow(_hashes(words), "sid bigint, h bigint"))

    def able(live: DataFrame) -> DataFrame:
        """The members that can still be in a link to another component of those given, with c; those that leave take with them the shingles that only they share."""
        who = live.select("sid", "root").distinct()
        each = held.join(who, "sid")
        both = each.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        c = each.join(both, "h").groupBy("sid").agg(F.count("*").alias("c"))
        return materialise(live.join(c, "sid").where(_fits(similarity, F.col("n"), F.col("c"), F.col("c"), F.col("c"))))

    live = able(live)
    crowded = live.where(F.col("crowd") > CROWD)
    if not crowded.isEmpty():
        pivots = crowded.groupBy("key").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("sid")).alias("s"))).alias("p")).select("key", (-F.col("p.s")).alias("b"))
        found = found.union(verified(close(crowded.join(pivots, "key").select(F.col("sid").alias("a"), "b"))))
    live = able(opened(found).join(live.select("sid").distinct(), "sid", "left_semi"))
    # a pair meets in the least of its keys alone
    own = live.groupBy("sid").agg(F.collect_set("key").alias("keys"))
    live = materialise(live.select("key", "root", "sid", "n", "c").join(own, "sid").join(bits, "sid"))
    x, y = live.alias("x"), live.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _fits(similarity, F.col("x.n"), F.col("x.c"), F.col("y.n"), F.col("y.c"))
    pairs = x.join(y, meet & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")))
    pairs = pairs.where(_close(similarity, F.col("x.n"), F.col("x.bits"), F.col("y.n"), F.col("y.bits")))
    return found.union(verified(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (nulls last); among repeated rows, any one of the equal ones. Columns of docs may have any name and type."""
    boxes = numbered(docs)

    def make():
        def row(text):
            found = shingles(text, words)
            f = simhash.fingerprint(text, words)
            return (len(found), f - (f >> 63 << 64), *sketch(found, bands, rows))

        return row

    marked = materialise(map_rows(boxes.select("uid", "row.doc_id", "row.text"), ["text"], make, "n int, fp bigint, h1 bigint, h2 bigint, keys array<bigint>", keep=["uid", "doc_id"]))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    entries = marked.groupBy("n", "h1", "h2").agg(best, F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    entries = materialise(entries.withColumn("sid", F.monotonically_increasing_id()))

    def texts(sids: DataFrame) -> DataFrame:
        wanted = materialise(entries.join(sids, "sid").select("sid", "best.uid"))
        return boxes.select("uid", "row.text").join(F.broadcast(wanted) if wanted.count() <= MOST else wanted, "uid").select("sid", "text")

    roots = components(links(entries.select("sid", "n", "fp", "keys"), texts, similarity, words))
    kept = entries.join(roots, entries.sid == roots.node, "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("best").alias("best")).select("best.uid")
    return kept_rows(boxes, marked, kept)
