"""Toxicity scores by a factorisation machine over hashed terms.

Terms (lower-cased words and word beginnings) are hashed; a text is the set of its hashes. From a bounded
sample of labelled rows the terms that tell most about the label are chosen (by their chi-square, counted in Spark), and a
factorisation machine is trained on them in numpy: a weight for each term and a factor vector, whose products are the weights of
pairs of terms, so an insult beside a group mention can count for more than both alone. Scoring reads whole texts.

Edge cases: null and empty texts have no terms and score the machine's bias. Without labels every text scores 0.
Repeated rows are scored one by one; of several labels for an id the highest counts, and of several texts under one id
one is learnt from (that whose sorted terms come last), so the sample bounds what reaches the driver.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .text import map_rows, share, words_of

CACHE = 100_000


#: Lengths in bytes of the word beginnings that count as terms beside the words.
PREFIXES = (4, 6, 7)


def term_hashes(word: bytes, bits: int) -> list[int]:
    """Hashes of a word and of its beginnings."""
    mask = (1 << bits) - 1
    return [xxhash.xxh32_intdigest(word) & mask, *(xxhash.xxh32_intdigest(word[:k], k) & mask for k in PREFIXES if len(word) >= k)]


class Machine:
    """w0 + sum of w_i + sum over pairs of v_i . v_j, over the chosen terms of a text."""

    def __init__(self, chosen: np.ndarray, factors: int, seed: int):
        rng = np.random.default_rng(seed)
        self.chosen = chosen  # sorted hashes
        self.w0, self.w, self.v = 0.0, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors))

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Which of the chosen terms are among terms (distinct)."""
        if not len(self.chosen) or not len(terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, terms), len(self.chosen) - 1)
        return at[self.chosen[at] == terms]

    def reader(self, bits: int):
        """A function from a text to the places of its chosen terms."""
        place = {int(h): i for i, h in enumerate(self.chosen)}

        class Known(dict):
            def __missing__(cache, w):
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = out = tuple(place[h] for h in term_hashes(w, bits) if h in place)
                return out

        of = Known()
        return lambda text: np.array(sorted({p for w in set(words_of(text)) for p in of[w]}), np.int64)

    def raw(self, at: np.ndarray) -> float:
        """Score before the logistic of one text with terms at these places."""
        v = self.v[at]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, decay: float, seed: int, size: int = 64) -> "Machine":
        """AdaGrad on the logistic loss, in batches of rows laid end to end."""
        n, k = self.v.shape
        rng = np.random.default_rng(seed)
        add = lambda at, x, m: np.stack([np.bincount(at, x[:, f], m) for f in range(k)], axis=1)
        self.w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, k), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), size):
                b = order[i : i + size]
                at, seg = np.concatenate([rows[j] for j in b]), np.repeat(np.arange(len(b)), [len(rows[j]) for j in b])
                v = self.v[at]
                s, own = add(seg, v, len(b)), np.bincount(seg, self.w[at] - 0.5 * (v * v).sum(axis=1), len(b))
                d = (1 / (1 + np.exp(-np.clip(self.w0 + own + 0.5 * (s * s).sum(axis=1), -30, 30))) - y[b]) / len(b)
                dw = np.bincount(at, d[seg], n) + decay * self.w
                dv = add(at, d[seg][:, None] * (s[seg] - v), n) + decay * self.v
                g0 += d.sum() ** 2
                gw += dw * dw
                gv += dv * dv
                self.w0 -= rate * d.sum() / np.sqrt(g0)
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)
        return self


def train(docs: DataFrame, labels: DataFrame, chosen: Column, label: str = "toxic", sample: int = 12_000, bits: int = 20, terms: int = 1500, factors: int = 6, epochs: int = 25, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> Machine | None:
    """The machine, or None without labels. chosen: which labels may be learnt from. sample bounds the labelled rows, in order of a hash of their ids."""
    picked = labels.where(chosen & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by sample, so it can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def make():
        return lambda t: (sorted({h for w in set(words_of(t)) for h in term_hashes(w, bits)}),)

    # one row an id, so that repeated ids cannot outgrow the sample
    terms_of = materialise(map_rows(rows, ["text"], make, "terms array<int>", keep=["doc_id", "y"]).groupBy("doc_id", "y").agg(F.max("terms").alias("terms")))
    n, p = terms_of.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    if not n:
        return None
    counts = terms_of.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("toxic")).where("n >= 4")
    expect = F.col("n") * F.lit(p / n)
    chi = (F.col("toxic") - expect) ** 2 / F.greatest(expect * F.lit(1 - p / n), F.lit(1e-9))
    best = [r.term for r in counts.withColumn("chi", chi).where("chi > 6.6").orderBy(F.desc("chi"), "term").limit(terms).select("term").collect()]
    model = Machine(np.sort(np.array(best, np.int64)), factors, seed)
    shared = share(docs.sparkSession, model.chosen)

    def placed():
        of = Machine(shared(), 0, seed)
        return lambda found: (of.places(np.array(found, np.int64)).tolist(),)

    got = map_rows(terms_of, ["terms"], placed, "places array<int>", keep=["doc_id", "y"]).toArrow().sort_by("doc_id")  # at most `terms` places a row
    y = got.column("y").to_numpy().astype(float)
    rows = [np.array(x, np.int64) for x in got.column("places").to_pylist()]
    return model.fit(rows, y, epochs, rate, decay, seed)


def score(docs: DataFrame, model: Machine | None, bits: int = 20, keep: list[str] | None = None) -> DataFrame:
    """docs (keep) with score, from the text alone."""
    shared = share(docs.sparkSession, model)

    def make():
        m = shared()
        of = m and m.reader(bits)

        def row(text):
            if m is None:
                return (0.0,)
            z = m.raw(of(text))
            return (float(1 / (1 + np.exp(-np.clip(z, -30, 30)))),)

        return row

    return map_rows(docs, ["text"], make, "score double", keep=keep)
