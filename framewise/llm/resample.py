"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Hashed counts of words, neighbouring pairs of words and runs of other signs give two multinomial models with add-one smoothing: one of the target
documents (a bounded sample of labelled rows), one of all documents. Whole texts are counted where they are read: tasks
add up dense counts of `buckets` cells, and only those are shuffled. A document's log weight is the mean log ratio of its n-grams, scaled to
`chunk` n-grams, so that long and short texts compete on equal terms. A Gumbel variate, a function of the id and seed,
is added to it, and the k largest keys are drawn, which samples without replacement in proportion to the weights. The
k-th largest key comes from counts over ever smaller ranges, so no rows are gathered or sorted in one place.

Edge cases: null and empty texts have no n-grams, log weight 0, and never enter the sample. Rows that tie at the k-th key
(repeated rows) are told apart by a row number, so that exactly k rows are drawn, or all rows with n-grams where these
are fewer. Without target rows the models are equal and the sample is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .text import WORD_BYTES, map_rows, share, utf8, words_of

CACHE = 100_000


#: What is no word byte and no white space stays, all else becomes a space.
SIGNS = bytes(c if WORD_BYTES[c] == 32 and chr(c) not in " \t\n\r\x0b\x0c" else 32 for c in range(256))


class Grams:
    """Buckets of a text's words, neighbouring pairs of words, and runs of other signs."""

    def __init__(self, buckets: int):
        self.buckets = buckets

        class Cache(dict):
            def __missing__(cache, w):
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = h = xxhash.xxh32_intdigest(w)
                return h

        self.of = Cache()

    def __call__(self, text: str | None) -> np.ndarray:
        h = np.array([self.of[w] for w in words_of(text)], np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20) if len(h) else h
        signs = np.array([self.of[b" " + w] for w in utf8(text).translate(SIGNS).split()], np.uint64)
        return (np.concatenate([h, pair, signs]) % np.uint64(self.buckets)).astype(np.int64)


def counts(docs: DataFrame, buckets: int, wanted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams by bucket over all of docs.text, and over the documents whose doc_id is in wanted (small, broadcast).

    One dense array a task, added up in Spark by bucket; the texts stay where they are read.
    """
    if wanted is None:
        x = docs.select("text", F.lit(False).alias("_w"))
    else:
        x = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id", F.lit(True).alias("_w"))), "doc_id", "left").select("text", F.coalesce("_w", F.lit(False)).alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, held, size = Grams(buckets), np.zeros((2, buckets), np.int64), ([], []), 0

        def add():
            for k in (0, 1):
                if held[k]:
                    total[k] += np.bincount(np.concatenate(held[k]), minlength=buckets)
                    held[k].clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for text, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held[w].append(g := of(text))
                    size += len(g)
                    if size > 1 << 20:
                        add()
                        size = 0
        add()
        some = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.sum(axis=0)[some]), pa.array(total[1][some])], names=["bucket", "n", "w"])

    got = x.mapInArrow(run, "bucket bigint, n bigint, w bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    out = np.zeros((2, buckets), np.int64)
    out[0, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    out[1, got.column("bucket").to_numpy()] = got.column("w").to_numpy()
    return out[0], out[1]


def weigh(docs: DataFrame, ratio: np.ndarray, chunk: int, keep: list[str]) -> DataFrame:
    """docs (keep) with n_grams and log_weight."""
    shared = share(docs.sparkSession, ratio)

    def make():
        r = shared()
        of = Grams(len(r))

        def row(text):
            x = of(text)
            return len(x), float(r[x].mean() * chunk) if len(x) else 0.0

        return row

    return map_rows(docs, ["text"], make, "n_grams bigint, log_weight double", keep=keep)


def gumbel(seed: int, *cols: str) -> Column:
    """Gumbel variate that is a function of cols."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> tuple[float, int] | None:
    """The k-th largest value of a double column and how many of the rows that hold it are among the k largest; None if there are fewer than k rows.

    Counts by 4096 equal cells of the range that holds it, over and over, until that range is one value.
    """
    low, high, n = (lambda r: (r["a"], r["b"], r["n"]))(rows.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(key).alias("n")).first())
    if k <= 0 or n < k:
        return None
    left = k
    while low < high:
        width = (high - low) / 4096
        inside = rows.where(F.col(key).between(low, high))
        if low + width > low:
            cell = F.least(F.floor((F.col(key) - low) / width), F.lit(4095)).cast("int")
        else:  # so few values are left between them that each is a cell
            cell = F.col(key)
        seen = {r["c"]: r for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()}
        for c in sorted(seen, reverse=True):
            if left <= seen[c]["n"]:
                low, high = seen[c]["a"], seen[c]["b"]
                break
            left -= seen[c]["n"]
    return low, left


def resample(docs: DataFrame, labelled: DataFrame, fraction: float = 0.5, sample: int = 50_000, buckets: int = 10_000, chunk: int = 100, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """docs (keep) with n_grams, log_weight, key and selected; `fraction` of all rows are selected, rounded down.

    labelled: rows whose doc_id names a document of the wanted kind. The target model is fitted on at most `sample` of
    them, in order of a hash of their ids; the raw model is counted over all documents.
    """
    wanted = labelled.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    raw, want = counts(docs, buckets, wanted)
    ratio = np.log((want + 1) / (want.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    keep = keep or docs.columns
    uid = "_uid"
    while uid in keep:  # a column of docs
        uid += "_"
    rows = weigh(docs, ratio, chunk, keep).withColumns({"key": F.col("log_weight") + gumbel(seed, "doc_id"), uid: F.monotonically_increasing_id().cast("double")})
    rows = materialise(rows)
    full, k = rows.where("n_grams > 0"), int(rows.count() * fraction)
    last = kth_largest(full, "key", k)
    if last is None:
        chosen = F.lit(k > 0) & (F.col("n_grams") > 0)
    else:
        # of the rows that tie at the last key, those with the largest row numbers (doubles hold them exactly up to a million files)
        ties = full.where(F.col("key") == last[0])
        chosen = (F.col("n_grams") > 0) & ((F.col("key") > last[0]) | (F.col("key") == last[0]) & (F.col(uid) >= kth_largest(ties, uid, last[1])[0]))
    return rows.withColumn("selected", chosen).drop(uid)
