"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over the words of whole documents.

Items are cut into windows of n consecutive words (an item of fewer words, but not none, is one window). The windows
travel as a broadcast table of arrays of bounded size, about 130 bytes a window: a benchmark of more than max_windows
windows is dealt into blocks by window, and the documents pass each block in turn, carrying their hits. Documents are
never shuffled. In a task, a rolling polynomial hash over word hashes finds candidate windows, and each candidate is
verified word by word.

Edge cases: null and empty texts have no words and no hits. Items without words are skipped. Windows of items with a
null id count as hits but are not listed. Repeated documents each get their row. Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from .text import Hashes, boxed, map_rows, share, utf8, words_of

#: Odd multiplier of the rolling hash (fixed value).
BASE = 0x9E3779B97F4A7C15
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHOLE = (1 << 64) - 1


def windows(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def window_hash(words: tuple[bytes, ...]) -> int:
    h = 0
    for w in words:
        h = (h * BASE + xxhash.xxh64_intdigest(w)) & WHOLE
    return h


def item_windows(benchmark: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """Distinct (size, hash, words, item) of all items' windows, written to the shared folder."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("t")).where("t is not null")

    def make():
        return lambda t: ([{"size": len(w), "hash": (h := window_hash(w)) - (h >> 63 << 64), "words": b" ".join(w)} for w in windows(words_of(t), n)],)

    cut = map_rows(items, ["t"], make, "windows array<struct<size: int, hash: bigint, words: binary>>", keep=["item"])
    return materialise(cut.select("item", F.inline("windows")).distinct())


class Table:
    """Windows of one block: by size, the sorted hashes; for each window its words and the items that hold it."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([(c, "ascending") for c in ("size", "hash", "words", "item")]).combine_chunks()
        size, h, words = rows.column("size").to_numpy(), rows.column("hash").to_numpy(), rows.column("words")
        new = np.ones(len(size), bool)
        if len(size) > 1:
            new[1:] = (size[1:] != size[:-1]) | (h[1:] != h[:-1]) | pc.not_equal(words[1:], words[:-1]).to_numpy()
        first = np.flatnonzero(new)
        self.words = words.take(pa.array(first)).combine_chunks()
        items = rows.column("item").combine_chunks().dictionary_encode()
        self.names = items.dictionary.to_pylist()
        self.item = items.indices.fill_null(-1).to_numpy().astype(np.int32)
        self.start = np.append(first, len(size))
        self.by_size = {}
        for k in np.unique(size[first]).tolist():
            at = np.flatnonzero(size[first] == k)
            known = h[first][at].view(np.uint64)
            order = np.argsort(known, kind="stable")
            bits = max(10, int(len(at)).bit_length() + 4)
            seen = np.zeros(1 << bits, bool)  # most words are told from item words by one look
            seen[known >> np.uint64(64 - bits)] = True
            self.by_size[k] = (known[order], at[order], seen, np.uint64(64 - bits))

    def hits(self, words: list[bytes], hash_of: Hashes) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the ids of the items that occur."""
        hit, found = np.zeros(len(words), bool), set()
        one = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
        h = np.zeros(len(words) + 1, np.uint64)
        for k in range(1, min(max(self.by_size, default=0), len(words)) + 1):
            h = h[:-1] * np.uint64(BASE) + one[k - 1 :]  # hashes of all runs of k words
            if k not in self.by_size:
                continue
            known, at, seen, shift = self.by_size[k]
            some = np.flatnonzero(seen[h >> shift])
            place = np.searchsorted(known, h[some])
            for i, p in zip(some.tolist(), place.tolist()):
                while p < len(known) and known[p] == h[i]:
                    w = int(at[p])
                    if self.words[w].as_py() == b" ".join(words[i : i + k]):
                        hit[i : i + k] = True
                        found.update(self.names[x] for x in self.item[self.start[w] : self.start[w + 1]].tolist() if x >= 0)
                    p += 1
        return hit, found


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 1_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, hit_words (word spans [from, to)), hit_items (sorted ids), n_hit, n_items."""
    every = item_windows(benchmark, n, item_id, item_text)
    blocks = max(1, -(-every.count() // max_windows))
    out = docs.withColumns({"hit_words": F.expr("cast(array() as array<array<int>>)"), "hit_items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("bigint")})
    for b in range(blocks):
        # a block holds about max_windows rows; the items of one window stay together
        part = every if blocks == 1 else every.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        table = share(docs.sparkSession, Table(part.select("size", "hash", "words", "item").toArrow()))

        def scan(table=table):
            known, hash_of = table(), Hashes()

            def row(t, spans, found):
                words = words_of(t)
                hit, more = known.hits(words, hash_of)
                if spans and len(words):
                    for i, j in spans:
                        hit[i:j] = True
                spans = runs(hit)
                return [list(s) for s in spans], sorted(more.union(found)), len(words)

            return row

        keep = [c for c in out.columns if c not in ("hit_words", "hit_items", "n_words")]
        out = map_rows(out, [text, "hit_words", "hit_items"], scan, "hit_words array<array<int>>, hit_items array<string>, n_words bigint", keep=keep)
        if b + 1 < blocks:
            out = materialise(out)
    return out.withColumns({"n_hit": F.expr("aggregate(hit_words, 0L, (s, x) -> s + x[1] - x[0])"), "n_items": F.size("hit_items").cast("bigint")})


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **how) -> DataFrame:
    """docs without the marked text, in their own columns. remove: "spans" cuts the hit words (and what stands between them), "documents" drops every contaminated document."""
    x = boxed(docs, _text=text)
    marked = mark(x, benchmark, text="_text", **how)
    if remove == "documents":
        return marked.where("n_hit = 0").select("_row.*")
    if remove != "spans":
        raise ValueError(remove)

    def cut():
        def row(t, spans):
            if not spans:
                return (t,)
            raw = utf8(t)
            at = [m.span() for m in WORD.finditer(raw.lower())]
            out, end = [], 0
            for i, j in spans:
                out.append(raw[end : at[i][0]])
                end = at[j - 1][1]
            return (b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass"),)

        return row

    cleaned = map_rows(marked, ["_text", "hit_words"], cut, "_clean string", keep=["_row"])
    return cleaned.select(F.col("_row").withField(f"`{text}`", F.col("_clean")).alias("_row")).select("_row.*")


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 of the comma-joined sorted ids, contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark, **how)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
