"""Near duplicates in large groups of texts around and just under the similarity."""

import random

import pytest
from framewise.llm import shingles
from pyspark.sql import functions as F


def group(seed, n, most, twins):
    """Copies of one text with up to `most` words replaced; some stand twice with one more change."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    out = []
    for _ in range(n):
        t = [*base]
        for at in rng.sample(range(150), rng.randint(0, most)):
            t[at] = f"w{rng.randrange(1 << 30)}"
        out.append(t)
        if rng.random() < twins:
            t = [*t]
            t[rng.randrange(150)] = "twin"
            out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("seed, n, most, twins", [(1, 350, 14, 0.3), (2, 500, 8, 0.0)])
def test_crowds_against_all_pairs(spark, seed, n, most, twins):
    texts = group(seed, n, most, twins) + [None, "", "short text"]
    sets = [shingles.shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if shingles.similar(x, sets[j]) and (x or not sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) > 40  # many texts have no near copy
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = sorted(r["doc_id"] for r in shingles.keep_one(docs).select("doc_id").collect())
    assert got == want


def test_crowd_costs_no_square(spark, monkeypatch):
    """5,000 texts that share three quarters of one text: the pairs that are verified stay a few a text."""
    texts = []
    for k in range(5000):
        t = [f"b{i}" for i in range(90)]
        t[-13:] = [f"x{k}y{i}" for i in range(13)]
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    seen, made = [], shingles.materialise

    def counting(df):
        out = made(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(shingles, "materialise", counting)
    assert shingles.keep_one(docs).count() == 5000
    assert sum(seen) < 40 * 5000


def test_parity_bitmaps_bound_the_difference(spark):
    """The bits in which two bitmaps differ are at most the shingles in which the texts differ, for any two lengths, and all of them where none share a bit."""
    rng = random.Random(3)
    pairs = [(None, ""), ("a", "a b"), ("x " * 400, "x " * 700)]
    for n in (3, 40, 150, 900, 5000):
        x = [f"w{rng.randrange(3 * n)}" for _ in range(n)]
        for m in (n, n + 7, 3 * n):
            y = [f"w{rng.randrange(3 * n)}" if rng.random() < 0.05 else w for w in (x * 3)[:m]]
            pairs.append((" ".join(x), " ".join(y)))
    texts = [t for p in pairs for t in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "sid bigint, text string").repartition(3)
    bits = docs.mapInArrow(shingles._parities(5), "sid bigint, bits array<bigint>")
    x = bits.where("sid % 2 = 0").select((F.col("sid") / 2).cast("int").alias("k"), F.col("bits").alias("x"))
    y = bits.where("sid % 2 = 1").select(((F.col("sid") - 1) / 2).cast("int").alias("k"), F.col("bits").alias("y"))
    got = {r["k"]: r["d"] for r in x.join(y, "k").select("k", shingles._differ(F.col("x"), F.col("y")).alias("d")).collect()}
    for k, (a, b) in enumerate(pairs):
        d = len(shingles.shingles(a) ^ shingles.shingles(b))
        assert got[k] <= d and (d - got[k]) % 2 == 0
        assert got[k] >= 0.4 * d or d > min(len(shingles.shingles(a)), len(shingles.shingles(b)))  # far apart, the shorter bitmap is full


def test_gray_order_index_gives_candidates(spark, monkeypatch):
    """Texts that share no MinHash key but have fingerprints within three bits are held against each other, and only those similar by the exact check are linked."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    other = [f"o{k}" for k in range(400)]
    near = [*base]
    near[399] = "end"
    texts = [" ".join(t) for t in (base, near, other)] + [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(50)) for _ in range(20)]
    assert (shingles.simhash.fingerprint(texts[0], 5) ^ shingles.simhash.fingerprint(texts[1], 5)).bit_count() <= 3
    sketch = shingles.sketch
    monkeypatch.setattr(shingles, "sketch", lambda found, bands, rows: (*sketch(found, bands, rows)[:2], []))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs).select("doc_id").collect()) == [0, *range(2, 23)]


def test_small_groups_cost_no_square(spark, monkeypatch):
    """Groups too small to be crowded, of texts just under the similarity: their bitmaps tell them apart, and hardly a text is fetched."""
    texts = []
    for g in range(20):
        for k in range(50):
            t = [f"g{g}b{i}" for i in range(120)]
            t[-18:] = [f"g{g}x{k}y{i}" for i in range(18)]
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    seen, made = [], shingles.materialise

    def counting(df):
        out = made(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(shingles, "materialise", counting)
    assert shingles.keep_one(docs).count() == 1000
    assert sum(seen) < 5 * 1000


def test_small_crowds_leave_by_their_own_shingles(spark, monkeypatch):
    """In keys of few texts, too, those with too many shingles of their own meet no other text."""
    texts = [" ".join([f"b{i}" for i in range(70)] + [f"x{k}y{i}" for i in range(13)] + ["z"] * (k % 2)) for k in range(40)]
    docs = spark.createDataFrame([(k, t.replace("b3 ", f"q{k} ")) for k, t in enumerate(texts)], "doc_id bigint, text string")
    left, made = [], shingles.materialise

    def counting(df):
        out = made(df)
        if {"key", "bits"} <= set(out.columns):
            left.append(out.count())
        return out

    monkeypatch.setattr(shingles, "materialise", counting)
    assert shingles.keep_one(docs).count() == 40
    assert left == [0]
