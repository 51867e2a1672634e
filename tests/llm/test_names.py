"""Operators over tables whose columns have dotted or clashing names, ids of other types, or no rows."""

import pytest
from framewise.llm import chat, decontam, fertility, html, langid, licenses, merkle, resample, simhash, shingles, topk, toxicity, whitening
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"the house of stone {k} and the river of light {k % 3} {'over ' * (k % 5)}", "en" if k % 2 else "de", "s", 1.5, {"a": k}, k, k, "x") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `a.b` string, score double, `m.x` map<string,int>, _uid int, size int, _row string")


def tox(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.train(docs, labels, F.lit(True)))


OPERATORS = {
    "decontaminate": lambda d: decontam.mark(d, d.where("doc_id < 3").select(F.col("doc_id").cast("string").alias("item_id"), "text")),
    "fingerprints": lambda d: simhash.fingerprints(d),
    "simhash": lambda d: simhash.keep_one(d),
    "shingles": lambda d: shingles.keep_one(d),
    "language": lambda d: langid.predict(d, langid.train(d, F.lit(True))),
    "licenses": lambda d: licenses.scan(d),
    "toxicity": tox,
    "resample": lambda d: resample.resample(d, d.where("doc_id < 9")),
    "merkle": lambda d: merkle.manifest(d, ["doc_id", "a.b", "text"], "lang", "doc_id", ["doc_id", "a.b", "m.x", "_uid", "size"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_dotted_and_clashing_names(docs, name):
    out = OPERATORS[name](docs)
    assert {"doc_id", "a.b", "m.x", "_uid", "size"} <= set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got and all(r["a.b"] == "s" and r["m.x"]["a"] == k and r["_uid"] == r["size"] == k for k, r in got.items())


def test_judge_keeps_size(spark):
    cols = ["n_tokens", *fertility.MEASURES]
    rows = spark.range(50).select("id", F.lit("en").alias("lang"), F.lit("Latn").alias("script"), F.lit(20).alias("n_words"), F.lit(0).alias("n_repeat_words"), (F.col("id") * 7).alias("size"), *[(F.lit(40) + F.col("id") % 5).cast("double").alias(c) for c in cols])
    got = fertility.judge(rows).collect()
    assert {r["id"]: r["size"] for r in got} == {k: 7 * k for k in range(50)} and {r["kept"] for r in got} == {True}


@pytest.mark.parametrize("kind, make", [("string", str), ("int", int), ("bigint", int)])
def test_conversation_ids(spark, kind, make):
    rows = [(make(k), t, ("user", "assistant")[t % 2], f"text {k} {t}") for k in range(4) for t in range(2)]
    got = chat.conversations(spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string"))
    assert got.schema["conv_id"].dataType.simpleString() == kind
    assert sorted((r["conv_id"], r["n_turns"], r["valid"]) for r in got.collect()) == sorted((make(k), 2, True) for k in range(4))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, vec_id bigint, embedding array<float>, url string, html string")
    for out in (simhash.keep_one(none), shingles.keep_one(none), licenses.scan(none), merkle.manifest(none, ["doc_id"], "lang", "doc_id", ["doc_id"]), topk.search(none, F.lit(True)), whitening.whitened(none), html.extract(none)):
        assert out.count() == 0
