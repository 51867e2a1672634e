"""Exact search, Merkle manifest and whitening against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from framewise.llm import merkle, queries, topk, whitening
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    """Vectors with a value that a third of them share, repeated rows and ids, nulls, bad components and short ones."""
    rng = np.random.default_rng(5)
    made = [(i, rng.normal(0, 0.4, 12).astype(np.float32).tolist()) for i in range(700)]
    made += [(1000 + i, made[3][1]) for i in range(350)]
    made += [(100, made[9][1]), (100, made[100][1]), (200, made[200][1]), (None, made[11][1]), (None, made[3][1])]
    made += [(2000, None), (2100, []), (2200, [0.5, None] * 6), (2300, [NAN] * 12), (2400, [INF] + [0.0] * 11), (2500, made[7][1][:5]), (2600, [0.0] * 12)]
    return made


SCHEMA = "vec_id bigint, embedding array<float>, score string, rank string, uid int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "r", 1) for i, v in rows], SCHEMA).repartition(5)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_topk(rows, k, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if good(v)]
    x = np.zeros((len(kept), max((len(v) for _, v in kept), default=0)), np.int64)
    for n, (_, v) in enumerate(kept):
        x[n, : len(v)] = v
    out = []
    for q, (qid, _) in enumerate(kept):
        if qid is not None and qid % 100 == 0:
            s = x @ x[q]
            order = sorted((j for j in range(len(kept)) if j != q), key=lambda j: (-int(s[j]), kept[j][0] is None, kept[j][0] or 0))[:k]
            out += [(qid, r + 1, kept[j][0], int(s[j])) for r, j in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, lists, block", [(10, 2, 8192), (3, 4, 7), (10, 1, 5)])
def test_topk(spark, vectors, k, lists, block):
    got = topk.search(frame(spark, vectors), F.col("vec_id") % 100 == 0, k, lists, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_topk(vectors, k)


def test_topk_small(spark):
    wanted = F.col("vec_id") % 100 == 0
    assert topk.search(frame(spark, []), wanted).count() == 0
    assert topk.search(frame(spark, [(0, [1.0])]), wanted).count() == 0  # no other row
    assert topk.search(frame(spark, [(1, [1.0])]), wanted).count() == 0  # no query
    few = [(0, [1.0, -1.0]), (1, [-1.0, 1.0]), (2, [-2.0, 0.5]), (300, [])]  # all scores below zero, fewer than k
    assert sorted(map(tuple, topk.search(frame(spark, few), wanted).collect()), key=str) == brute_topk(few, 10)
    large = [(0, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [9e5, 7.0])]  # products beyond 2**53
    assert sorted(map(tuple, topk.search(frame(spark, large), wanted).collect()), key=str) == brute_topk(large, 10)
    with pytest.raises(Exception, match="do not fit a long"):
        topk.search(frame(spark, [(0, [1e8]), (1, [1e8])]), wanted).count()


def test_topk_sends_little(spark, vectors):
    """The second phase sends a part of the entries only, and the bound never costs a result."""
    codes = np.random.default_rng(1).integers(-500, 500, (3000, 16))
    x = topk.Queries(codes[:5].astype(np.int64), [int(np.sort(codes @ codes[q])[-11]) for q in range(5)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([r[:8].astype("<i8").tobytes() for r in codes])], names=["eid", "part"])
    sent = sum(b.num_rows for b in topk._above(lambda: x, 0, 8, 2)(iter([batch])))
    assert 0 < sent < 0.2 * 5 * 3000


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests, fan=8):
    """Root, and by leaf the siblings (left, right) level by level."""
    paths, where, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = at // fan * fan
            paths[leaf].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fan])))
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        where = [at // fan for at in where]
    return nodes[0], paths


def brute_merkle(docs):
    def leaf(row, text):
        doc, lang, source, n, _ = row
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])

    groups = defaultdict(list)
    for row in docs:
        groups[row[1]].append((row[0] is not None, row[0], leaf(row, row[4]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = brute_tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, rest in zip(names, above):
        for (_, doc, digest, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + rest
            now = digest
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and row[4] is not None:
                now = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            for left, right in path:
                now = h(left, now, right)
            out.append((doc, digest, trees[g][0], root, h(*[p for s in path for p in s]), now, now == root))
    return sorted(out, key=str)


def documents(n_langs=3, n=400):
    rows = [(i, ["en", None, "dé", "fr", *(f"l{k:02}" for k in range(80))][i * i % n_langs], "S" if i % 7 else None, i if i % 5 else None, f"Text {i} Ünï ÀB" if i % 11 else None) for i in range(n)]
    return rows + [(3, "en", "S", 3, "Text 3"), rows[5], rows[5], (None, "en", None, None, None), (None, None, None, None, "A"), (9000, "xx", "", 0, ""), (9001, "en", "s", 1, "Word " * 40000)]


DOCS = "doc_id bigint, lang string, source string, n_chars bigint, text string, leaf string, g int, rank int"


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(4)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", ["doc_id"], {"text": low}, queries.fold(3) == 0)


@pytest.mark.parametrize("rows", [documents(), documents(70, 700), [], [(1, "en", None, None, "Á B")], [(i, "en", None, None, str(i)) for i in range(9)], [(7, None, None, None, None)] * 20], ids=["mixed", "languages", "empty", "one", "nine", "copies"])
def test_merkle(spark, rows):
    got = manifest(spark, rows).drop("path")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_merkle(rows)


def test_merkle_plain(spark):
    """Without changes all rows hold; a proof of one row against another root fails."""
    docs = spark.createDataFrame([(i, "a.b", {"k": i}) for i in range(20)], "`doc.id` int, `l.g` string, extra map<string,int>")
    got = merkle.manifest(docs, ["doc.id", "l.g"], "l.g", "doc.id", ["doc.id", "extra"]).collect()
    assert len(got) == 20 and all(r["verified"] for r in got) and {r["extra"]["k"] for r in got} == set(range(20))


def brute_whitening(rows, components=32, scale=64, shift=1_000_000):
    kept = [(i, [math.floor(scale * c) + shift for c in v]) for i, v in rows if good(v)]
    dim = max(len(v) for _, v in kept)
    x = np.array([v + [shift] * (dim - len(v)) for _, v in kept], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    return [i for i, _ in kept], n, [sum(int(d) ** 2 for d in r) for r in n * x - s], y @ w / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_whitening(spark, vectors):
    got = whitening.whitened(frame(spark, vectors)).collect()
    ids, n, deviation, z, explained = brute_whitening(vectors)
    assert len(got) == len(ids) * 12 and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    sign = {}
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append((round(r["whitened"], 6), r["deviation"], r["explained"]))
    want = defaultdict(list)
    for c in range(12):
        have = {v for v in np.array([r["whitened"] for r in got if r["component"] == c + 1]).round(6)}
        sign[c] = 1 if all(min(abs(v - np.array(list(have)))) < 2e-6 for v in z[:50, c]) else -1
        for k, i in enumerate(ids):
            want[i, c + 1].append((sign[c] * z[k, c], deviation[k], explained[c]))
    for key, rows in want.items():
        for a, b in zip(sorted(by[key]), sorted(rows)):
            assert a[0] == pytest.approx(b[0], abs=1e-5) and a[1] == b[1] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_whitening_small(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [NAN])])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    flat = whitening.whitened(frame(spark, [(i, [i / 10, 1.0, i / 10]) for i in range(30)])).collect()  # one direction varies
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)} and flat[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [7, 7, 7, 1, 1, 0], [1e6, 1, 1e-6, 0], [3], list(range(64, 0, -1)), [1 + 1e-9, 1, 1 - 1e-9, 0.5]])
def test_spectral_division(values):
    """QDWH divide and conquer against the known spectrum: values, orthonormal vectors, residuals."""
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((n, n)))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, w = whitening.spectrum(v)
    scale = max(map(abs, values))
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * scale)
    assert np.allclose(w.T @ w, np.eye(n), atol=1e-12) and np.allclose(v @ w, w * e, atol=1e-11 * scale)


def test_polar():
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((8, 8)))[0]
    a = (q * np.array([9, 3, 1, 1e-8, -1e-3, -1, -2, -50.0])) @ q.T
    assert np.allclose(whitening.polar((a + a.T) / 2), (q * np.array([1, 1, 1, 1, -1, -1, -1, -1.0])) @ q.T, atol=1e-6)


def test_queries_match_sql(spark):
    """The Merkle SQL on a table with nulls, repeated rows and many languages."""
    duckdb = pytest.importorskip("duckdb")
    rows = documents(70, 300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r for r in rows if r[0] is not None]
    con.execute("DELETE FROM documents WHERE doc_id IS NULL")
    got = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.merkle_sql()})").fetchall()
    assert sorted(got, key=str) == brute_merkle(rows)
