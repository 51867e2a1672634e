"""Quality rules, with tokeniser fertility as the verdict.

Base counts come from the words of the whole text. The verdict asks public vocabularies how a text falls apart: code
points per token of a byte-level BPE, share of byte-fallback pieces of a BPE with byte fallback, entropy of the token
distribution, normalised by its maximum for the text's length. Each group (language, or script where the language is
unknown or rare) and length class (powers of two of the token count, since both measures depend on length) has a band
for each measure: the median over all its documents, give or take `width` times the distance between its quartiles, and
never narrower than a floor. A document outside a band is rejected. Bands are one row for each group and class, from
exact quantiles of the measures in steps of 0.001, so that counts of a bounded number of values are merged, whatever the
partitions, and a verdict never changes between runs. A document whose language and script have fewer than min_group
documents in its length class is held against its script's neighbouring classes, pooled on both sides until they hold
min_group; where the whole script holds fewer, against all documents pooled so; and where the table does, against all.

Edge cases: a null or empty text has no words and fails the base rules. A text of fewer than min_tokens tokens has no
verdict of its own (measures of so few tokens say nothing) and keeps the base verdict. Repeated rows count each time.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialise
from .packing import Encoder
from .text import map_rows, utf8

WHITE = set(" \t\n\r\x0b\x0c")
#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list, window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # candidates of equal hash are told apart by their words
    some = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    seen: dict = {}
    for i in some.tolist():
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    hit = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit[i] += 1
                hit[min(i + window, len(words))] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(letters: set[str]) -> str:
    """The first word of the Unicode names of most of a text's distinct letters."""
    names: dict[str, int] = {}
    for c in letters:
        if c.isalpha():
            name = "LATIN" if c < "\u0250" else unicodedata.name(c, "OTHER").split(" ")[0]
            names[name] = names.get(name, 0) + 1
    return max(sorted(names), key=names.get) if names else "NONE"


def measured(docs: DataFrame, ranks: str, pattern: str, pieces: str, keep: list[str]) -> DataFrame:
    """docs[keep] with the base counts and the measures n_tokens, chars_per_token, fallback_share, entropy, and script.

    fallback_share: byte pieces that the vocabulary with byte fallback needs, for each code point of the words.
    """

    def make():
        import sentencepiece

        bpe = Encoder(ranks, pattern, {})
        piece = sentencepiece.SentencePieceProcessor(model_file=pieces)
        plain = {p for i in range(piece.get_piece_size()) if len(p := piece.id_to_piece(i)) == 1}

        def row(text):
            raw = utf8(text)
            words = raw.split()
            symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            if not words:
                return 0, 0, symbols, 0, 0, 0, 0.0, 0.0, 0.0, "NONE"
            spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
            chars, letters = len(text) - spaces, set(text)
            ids = bpe.ids(text)
            low = sum(text.count(c) * len(c.encode("utf-8", "surrogatepass")) for c in letters - plain - WHITE)
            share = np.bincount(ids)
            share = share[share > 0] / len(ids)
            entropy = float(-(share * np.log2(share)).sum() / np.log2(len(ids))) if len(ids) > 1 else 0.0
            return len(words), chars, symbols, repeated_lines(raw), repeated_words(words), len(ids), chars / len(ids), low / chars, entropy, script_of(letters)

        return row

    return map_rows(docs, ["text"], make, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, fallback_share double, entropy double, script string", keep=keep)


#: The least half-width of each measure's band.
MEASURES = {"chars_per_token": 0.02, "fallback_share": 0.02, "entropy": 0.01}


def bands(rows: DataFrame, group: list[str], width: float) -> DataFrame:
    """One row for each group and length class: n_docs, and median and half-width of each measure over all its documents."""
    q = {m: F.percentile(F.round(m, 3), [0.25, 0.5, 0.75]) for m in MEASURES}
    out = rows.groupBy(*group, "size").agg(F.count("*").alias("n_docs"), *[v.alias(m) for m, v in q.items()])
    return out.select(*group, "size", "n_docs", *[F.col(m)[1].alias(f"{m}_mid") for m in MEASURES], *[F.greatest(F.lit(floor), width * (F.col(m)[2] - F.col(m)[0])).alias(f"{m}_half") for m, floor in MEASURES.items()])


def pooled(rows: DataFrame, group: list[str], width: float, min_group: int) -> DataFrame:
    """One row for each group and length class that hold a document together: the band of the nearest length classes, pooled on both sides until they hold min_group documents; none where the whole group holds fewer."""
    counts = rows.groupBy(*group, "size").agg(F.count("*").alias("_n"))
    x, y = counts.alias("x"), counts.alias("y")
    same = [F.col(f"x.{g}") == F.col(f"y.{g}") for g in group]
    far = F.abs(F.col("x.size") - F.col("y.size"))
    steps = x.join(y, reduce(and_, same, F.lit(True))).groupBy(*[F.col(f"x.{g}").alias(g) for g in group], F.col("x.size").alias("size"), far.alias("reach")).agg(F.sum("y._n").alias("_n"))
    held = F.sum("_n").over(Window.partitionBy(*group, "size").orderBy("reach"))
    reach = steps.withColumn("_n", held).where(F.col("_n") >= min_group).groupBy(*group, "size").agg(F.min("reach").alias("reach"))
    # classes of few documents only: those with a band of their own are reach 0 and never read this one
    reach = materialise(reach.where("reach > 0"))
    own = reach.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("size").alias("_size"), "reach")
    near = F.abs(F.col("size") - F.col("_size")) <= F.col("reach")
    more = rows.join(F.broadcast(own), reduce(and_, [F.col(g) == F.col(f"_{g}") for g in group], near))
    more = more.drop("size", *group).withColumnsRenamed({f"_{c}": c for c in (*group, "size")})
    return bands(more, group, width)


def judge(rows: DataFrame, width: float = 2.5, min_group: int = 30, min_tokens: int = 30, most_bands: int = 20_000) -> DataFrame:
    """rows (materialised measures with lang and script) with base_failed, kept and outside, the measures out of their bands.

    Up to most_bands rows of bands are broadcast; more of them are joined by a shuffle. A column `size` of rows stays.
    """
    if "size" in rows.columns:
        return judge(rows.withColumnRenamed("size", "_users_size"), width, min_group, min_tokens, most_bands).withColumnRenamed("_users_size", "size")
    rows = rows.withColumn("size", F.floor(F.log2(F.greatest(F.lit(1), "n_tokens"))))
    sized = rows.where(F.col("n_tokens") >= min_tokens)
    cols = [f"{m}_{s}" for m in MEASURES for s in ("mid", "half")]
    x = rows
    names = []
    for name, group, pool in (("lang", ["lang"], False), ("script", ["script"], False), ("near", ["script"], True), ("all", [], True), ("every", [], None)):
        known = reduce(and_, [F.col(g).isNotNull() for g in group], F.lit(True))
        if pool is None:  # fewer than min_group documents in all
            band = bands(sized.withColumn("size", F.lit(0)), [], width).drop("size")
        elif pool:
            band = pooled(sized.where(known), group, width, min_group)
        else:
            band = bands(sized.where(known), group, width).where(F.col("n_docs") >= min_group)
        on = [] if pool is None else [*group, "size"]
        band = materialise(band.select(*on, *[F.col(c).alias(f"{name}_{c}") for c in cols]))
        small = F.broadcast(band) if band.count() <= most_bands else band
        x = x.join(small, on, "left") if on else x.join(small, how="left")
        names.append(name)
    far = {m: (F.col("n_tokens") >= min_tokens) & (F.abs(F.col(m) - F.coalesce(*[f"{g}_{m}_mid" for g in names])) > F.coalesce(*[f"{g}_{m}_half" for g in names])) for m in MEASURES}
    x = x.withColumns({"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "outside": F.concat_ws(",", *[F.when(y, m) for m, y in far.items()])})
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("outside") == "")).drop("size", *[f"{g}_{c}" for g in names for c in cols])
