"""A training-data pipeline over the documents table: toxicity, language, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewise.llm import decontam, langid, packing, shingles, toxicity
from framewise.llm.queries import fold, split_pattern, table, vocabulary
from framewise.llm.text import boxed
from framewise.runtime import shared_dir

#: Score from which a document is rejected as toxic.
TOXIC = 0.3
#: Least mean probability of the predicted language.
SURE = 0.35
#: Jaccard similarity of word shingles from which documents are near duplicates, and the words of a shingle.
SIMILAR, SHINGLE = 0.8, 5


#: Most rows of an Arrow batch: long texts make batches large, and each running task holds a few of them on both sides.
BATCH = 1000


def small_batches(stage):
    """The stage with the session's Arrow batches held to BATCH rows; a smaller setting of the session stays."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4).isin(0, 1, 3))
    return toxicity.score(boxed(docs, text="text"), model).where(F.col("score") < TOXIC).select("_row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs, fold(3).isin(0, 2))
    return langid.predict(boxed(docs, text="text"), net).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("_row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one(docs, similarity=SIMILAR, words=SHINGLE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="spans")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), {"<|endoftext|>": 50256})


STAGES = [(name, small_batches(stage)) for name, stage in (("toxicity", without_toxic), ("language", known_language), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("packing", packed))]

#: SQL can express neither the trained stages nor shingle similarity; tests hold near duplicates against all pairs, and the other stages against planted cases and the operators' own brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
