"""Helpers that the text operators share: byte tables for words, Arrow row mapping, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialise

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space; UTF-8 letters beyond ASCII stay whole.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return utf8(text).translate(WORD_BYTES).split()


def share(spark: SparkSession, thing) -> Callable[[], object]:
    """Broadcast an object whose class executors need not have; the result, called in a task, gives the worker's one copy of it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def load():
        if not hasattr(sent, "loaded"):  # workers serve many tasks and keep a broadcast between them
            sent.loaded = cloudpickle.loads(sent.value)
        return sent.loaded

    return load


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def columns_of(df: DataFrame) -> list:
    """Every column of df, dots in names taken literally."""
    return [F.col(f"`{c}`") for c in df.columns]


def boxed(df: DataFrame, **beside: str) -> DataFrame:
    """df with each row in one column _row and the named columns beside it, so that no column of df can clash with an operator's."""
    return df.select(F.struct(*columns_of(df)).alias("_row"), *[F.col(f"`{c}`").alias(name) for name, c in beside.items()])


def numbered(df: DataFrame) -> DataFrame:
    """(uid, row): df written once to the shared folder, each row boxed beside a unique long."""
    return materialise(df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*columns_of(df)).alias("row")))


#: Up to so many ids of rows to leave out are broadcast (8 bytes each, about 32 MB as a hash table).
MOST_DROPPED = 1_000_000


def kept_rows(rows: DataFrame, uids: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows (uid, row) whose uid is in kept, unboxed. uids: all ids. Up to MOST_DROPPED ids that are not kept are broadcast and the rows stay where they are; beyond that rows and ids meet by a shuffle on the id."""
    dropped = materialise(uids.select("uid").join(kept.select("uid"), "uid", "left_anti"))
    if dropped.count() <= MOST_DROPPED:
        return rows.join(F.broadcast(dropped), "uid", "left_anti").select("row.*")
    return rows.join(kept.select("uid"), "uid", "left_semi").select("row.*")


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[], Callable[..., tuple]], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Append fn()(row values of columns) to the kept columns, row by row inside Arrow batches.

    fn is called once a task to set up caches and models. keep: columns to hand on (all by default).
    A column of df that clashes with a new name gives way to it.
    """

    def make():
        each = fn()
        return lambda *cols: [each(*x) for x in zip(*cols)]

    return map_lists(df, columns, make, schema, keep)


def map_lists(df: DataFrame, columns: list[str], fn: Callable[[], Callable[..., list[tuple]]], schema: str, keep: list[str] | None = None) -> DataFrame:
    """As map_rows, but the function takes a list of values for each column, of 500 rows at most, and returns a list of rows."""
    if any("." in c or "`" in c for c in df.columns):  # such names go by number meanwhile
        named = {c: f"_c{i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)}
        plain = df.toDF(*named.values())
        out = map_lists(plain, [named[c] for c in columns], fn, schema, None if keep is None else [named[c] for c in keep])
        back = {v: k for k, v in named.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])
    made = T.StructType.fromDDL(schema)
    keep = [c for c in (df.columns if keep is None else keep) if c not in made.fieldNames()]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *columns])])
    out = T.StructType([source.schema[c] for c in keep] + made.fields)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds what the Python lists hold
                part = batch.slice(at, 500)
                rows = each(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))
                cols = list(zip(*rows)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(v, f.type) for v, f in zip(cols, arrow)], names=keep + arrow.names)
                part = rows = cols = None
            batch = None
        each = None
        trim()

    return source.mapInArrow(run, out)


def trim() -> None:
    """Give freed memory back to the system at the end of a task: a worker lives on through tasks and stages, and would else keep the most that any of them took."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a system without it
        pass


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each linked node; root is the smallest node id.

    Alternating large-star and small-star rounds. Every round is joins and minima by node, written to the shared
    folder; nothing but a row count and a checksum reaches the driver. Null ends are dropped.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
