"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's maximum over the window feeds
a softmax. Training windows come from a bounded sample of labelled rows (per_lang documents a language, chosen by hash).
A whole text is cut into consecutive windows (the last one may overlap its predecessor), and their probabilities are
averaged, weighted by the new bytes each brings. Label, source and id are never inputs of a prediction.

Edge cases: null texts and texts without a letter are `und` with score 0. Without any labelled row every text is `und`.
Rows with a null label only serve prediction. Repeated rows are predicted one by one; an id repeated under one label is
learnt from once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import map_lists, map_rows, share, utf8

WINDOW, DIM, WIDTHS, FILTERS = 160, 8, (2, 3, 4), 16  # bytes of a window, embedding, filter widths, filters of each


def pad(raw: bytes, at: int) -> np.ndarray:
    """Window of raw from at, padded by zeros to WINDOW + 3, so that each place starts a filter of any width."""
    out = np.zeros(WINDOW + 3, np.uint8)
    part = raw[at : at + WINDOW]
    out[: len(part)] = np.frombuffer(part, np.uint8)
    return out


class Net:
    """Parameters of the network; byte 0 is padding as well."""

    def __init__(self, names: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.names = names
        self.p = {"e": rng.normal(0, 0.5, (256, DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))
        self.p["c"] = np.zeros(len(names))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Largest value of each filter over the WINDOW places of each row of x (n, WINDOW + 3), and the values."""
        e, parts, where = self.p["e"][x], [], {}
        for w in WIDTHS:
            flat = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), w * DIM, axis=1)[:, : WINDOW * DIM : DIM]
            y = flat.reshape(-1, w * DIM) @ self.p[f"w{w}"]
            where[w] = y = y.reshape(len(x), WINDOW, FILTERS)
            parts.append(y.max(axis=1) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(parts, axis=1), 0), where

    def tables(self) -> None:
        """For prediction: what each pair of bytes (first, and last two of four) and each third byte add to the filters."""
        e, pair = self.p["e"], np.arange(1 << 16)
        two = np.concatenate([e[pair & 255], e[pair >> 8]], axis=1)  # little-endian pairs
        w2, w3, w4 = (self.p[f"w{w}"] for w in WIDTHS)
        self.t = [two @ w2, two @ w3[: 2 * DIM], e @ w3[2 * DIM :], two @ w4[: 2 * DIM], two @ w4[2 * DIM :]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of x (n, WINDOW + 3): the same network, its first layers looked up by byte pairs."""
        if not hasattr(self, "t"):
            self.tables()
        pair = x[:, :-1].astype(np.uint16) | x[:, 1:].astype(np.uint16) << 8
        first, last, third = pair[:, :WINDOW].ravel(), pair[:, 2 : WINDOW + 2].ravel(), x[:, 2 : WINDOW + 2].ravel()
        t, parts = self.t, []
        for y in (t[0][first], t[1][first] + t[2][third], t[3][first] + t[4][last]):
            y = y.reshape(len(x), WINDOW, FILTERS)
            while y.shape[1] % 2 == 0:
                y = np.maximum(y[:, : y.shape[1] // 2], y[:, y.shape[1] // 2 :])
            parts.append(y.max(axis=1))
        h = np.maximum(np.concatenate(parts, axis=1) + np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), 0)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, where = self.pooled(x)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        g = {"o": h.T @ z, "c": z.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        back = (z @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = where[w].argmax(axis=1)  # (n, filters): only the largest position learns
            ids = x[rows[:, :, None], at[:, :, None] + np.arange(w)]  # (n, filters, w)
            seen = self.p["e"][ids].reshape(len(x), FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, seen)
            g[f"b{w}"] = d.sum(axis=0)
            np.add.at(g["e"], ids.reshape(-1), (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, DIM))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 4e-3, seed: int = 7) -> "Net":
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                step += 1
                for k, g in self.gradients(x[order[i : i + size]], y[order[i : i + size]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def sample_windows(docs: DataFrame, train: Column, per_lang: int, per_doc: int, most: int = 50_000, most_langs: int = 500) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels from at most per_lang documents of each of the most_langs commonest labels, per_doc windows each, spread over the whole text; `most` documents in all. One row an id and label is learnt from."""
    chosen = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    langs = chosen.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not langs:
        return np.zeros((0, WINDOW + 3), np.uint8), np.zeros(0, np.int64), []
    # common labels are thinned by the hash before the window, so that no task gets more than a few times per_lang ids
    part = F.create_map(*[F.lit(v) for r in langs for v in (r["lang"], min(1.0, 4.0 * per_lang / max(1, r["n"])))])
    thin = chosen.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.try_element_at(part, F.col("lang"))).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = thin.withColumn("nth", nth).where(F.col("nth") <= per_lang).orderBy("nth", "h").limit(most).select("doc_id", "lang")

    def make():
        def row(text, key):
            raw = utf8(text)
            rng = np.random.default_rng(key & 0xFFFFFFFF)
            last = max(0, len(raw) - WINDOW)
            return (b"".join(pad(raw, int(a)).tobytes() for a in rng.integers(0, last + 1, per_doc)),)

        return row

    rows = docs.where("text is not null").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("text", "lang", F.xxhash64("doc_id").alias("key"))
    got = map_rows(rows, ["text", "key"], make, "windows binary", keep=["lang", "key"]).groupBy("lang", "key").agg(F.max("windows").alias("windows"))
    got = got.toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    names = sorted(set(got.column("lang").to_pylist()))
    at = {n: i for i, n in enumerate(names)}
    x = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW + 3) for b in got.column("windows").to_pylist()]
    y = np.repeat([at[n] for n in got.column("lang").to_pylist()], per_doc) if x else np.zeros(0, int)
    return (np.concatenate(x) if x else np.zeros((0, WINDOW + 3), np.uint8)), y.astype(np.int64), names


def train(docs: DataFrame, chosen: Column, per_lang: int = 1500, per_doc: int = 2) -> Net | None:
    """The network, or None if no labelled row is there. chosen: which rows may be learnt from. per_lang bounds the sample."""
    x, y, names = sample_windows(docs, chosen, per_lang, per_doc)
    return Net(names).fit(x, y) if len(names) else None


def predict(docs: DataFrame, net: Net | None, block: int = 256, keep: list[str] | None = None) -> DataFrame:
    """docs (keep) with lang_pred and score, from the text alone."""
    net_ = share(docs.sparkSession, net)

    def make():
        model = net_()

        def rows(texts):
            if model is None:
                return [("und", 0.0)] * len(texts)
            total, size, held = np.zeros((len(texts), len(model.names))), np.zeros(len(texts), np.int64), []

            def flush():
                x, weight, owner = (np.concatenate([h[k] for h in held]) for k in range(3))
                held.clear()
                for i in range(0, len(x), block):
                    np.add.at(total, owner[i : i + block], model.predict(x[i : i + block]) * weight[i : i + block, None])

            n = 0
            for k, text in enumerate(texts):
                if not text or not any(map(str.isalpha, text)):
                    continue
                raw = utf8(text)
                size[k], step = len(raw), block * WINDOW
                for i in range(0, len(raw), step):  # whole windows of a part, then what is left of the text
                    part = raw[i : i + step]
                    whole = len(part) // WINDOW
                    x = np.zeros((-(-len(part) // WINDOW), WINDOW + 3), np.uint8)
                    x[:whole, :WINDOW] = np.frombuffer(part[: whole * WINDOW], np.uint8).reshape(-1, WINDOW)
                    weight = np.full(len(x), WINDOW)
                    if whole < len(x):
                        x[-1] = pad(raw, max(0, len(raw) - WINDOW))
                        weight[-1] = len(part) - whole * WINDOW
                    held.append((x, weight, np.full(len(x), k)))
                    n += len(x)
                    if n >= block:
                        flush()
                        n = 0
            if held:
                flush()
            best, mean = total.argmax(axis=1), total / np.maximum(size, 1)[:, None]
            return [(model.names[b], float(min(1.0, mean[k, b]))) if size[k] else ("und", 0.0) for k, b in enumerate(best.tolist())]

        return rows

    return map_lists(docs, ["text"], make, "lang_pred string, score double", keep=keep)
