"""Best-fit packing of token sequences, repacked until a lower bound certifies the bin count.

Every document is tokenised once, cut only where it is longer than a sequence, and its pieces become rows (uid, length).
Full pieces are sequences by themselves. The rest are dealt by hash into partitions of about part_size pieces; each is
packed by best-fit decreasing, and dual-feasible functions give a lower bound on its bins. A partition that meets its
bound is certified. One with a gap gives up the pieces of its unfilled bins; all pieces so given up are dealt anew and
packed together, and the new packing stands where it takes fewer bins. Rounds end when all partitions are certified, when
a round saves nothing, or after max_rounds. No partition holds more than about part_size pieces in memory, and only row
counts reach the driver.

Edge cases: a null or empty text is one piece that holds the end token. Repeated rows are packed as documents of their
own. An empty table gives an empty packing.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from .text import map_rows


#: White space as the pattern's \s has it. Runs longer than LONG_RUN go past the pattern, whose matcher keeps a stack entry for each of their characters.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
LONG_RUN = 100_000


class Encoder:
    """Byte-level BPE ids of whole texts. Special strings in a text become their ids.

    The pattern makes one piece of a white-space run but for its last character, which joins what follows; a run that
    ends a text, or stands before a special string, is one piece. Very long runs are cut out by that rule and merged as
    the one piece they are; white space never joins what stands before it, so the rest is encoded as it stands.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        self.special = {*special}

    def plain(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        long = [m.span() for m in WHITE.finditer(text) if m.end() - m.start() > LONG_RUN] if len(text) > LONG_RUN else ()
        if not long:
            return self.plain(text)
        out, at = [], 0
        for start, end in long:
            if end < len(text) and not any(text.startswith(s, end) for s in self.special):
                end -= 1
            out += [self.plain(text[at:start]), np.array(self.bpe._encode_single_piece(text[start:end]), np.uint32)]
            at = end
        return np.concatenate([*out, self.plain(text[at:])])


def tokenised(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], end: int, most: int) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    stop = np.array([end], "<u4").tobytes()

    def make():
        encode = Encoder(ranks, pattern, special)

        def row(text):
            ids = encode.ids(text or "").tobytes() + stop
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % most + 1, n + 1, most)]
            return ([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))],)

        return row

    pieces = "pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
    return map_rows(docs, ["text"], make, pieces, keep=["doc_id"]).select("doc_id", F.inline("pieces"))


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Bin of each piece by best-fit decreasing; number of bins."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(most + 1)]  # bins by free space
    free: list[int] = []  # free spaces that have bins, ascending
    bins, n = np.empty(len(lengths), np.int64), 0
    for i in order.tolist():
        x = int(lengths[i])
        at = bisect.bisect_left(free, x)
        if at < len(free):
            space = free[at]
            b = room[space].pop()
            if not room[space]:
                free.pop(at)
        else:
            space, b, n = most, n, n + 1
        bins[i] = b
        left = space - x
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(b)
    return bins, n


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions u_k (k = 1..20) and of those that lift lengths over most - t and drop those under t, for every threshold t."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1)[: most + 1].astype(np.int64)
    x = np.arange(most + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // most)
    for k in range(1, 21):
        whole = (k + 1) * x % most == 0
        scaled = np.where(whole, x * k, (k + 1) * x // most * most)  # u_k times k * most
        best = max(best, -(-int((count * scaled).sum()) // (k * most)))
    many, mass = np.cumsum(count), np.cumsum(count * x)
    for t in range(0, most // 2 + 1):
        large = int(many[most] - many[most - t])  # length > most - t counts as a whole bin
        middle = int(mass[most - t] - (mass[t - 1] if t else 0))
        best = max(best, large + -(-middle // most))
    return best


def _pack(most: int, name: int):
    """Arrow function over rows (grp, uid, length, was) sorted by grp: bin (local), gap and old bin count of each group."""
    schema = pa.schema([("grp", pa.int64()), ("uid", pa.int64()), ("length", pa.int64()), ("was", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("gap", pa.int64()), ("better", pa.bool_())])

    def group(rows: pa.Table) -> pa.RecordBatch:
        grp, uid, length, was = (rows.column(i).to_numpy() for i in range(4))
        bins, n = best_fit(length, most)
        order = np.argsort(bins, kind="stable")
        run = np.concatenate([[0], np.cumsum(length[order])[:-1]])
        start = np.zeros(n, np.int64)
        sorted_bins = bins[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_bins[1:] != sorted_bins[:-1]]))
        start[sorted_bins[first]] = run[first]
        offset = np.empty(len(uid), np.int64)
        offset[order] = run - start[sorted_bins]
        fill = np.bincount(bins, weights=length, minlength=n).astype(np.int64)
        same = np.ones(len(uid), np.int64)
        old = len(np.unique(was)) if was[0] >= 0 else n + 1
        ids = (name << 52) + (grp << 20) + bins  # round, group, bin
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (grp, uid, length, was, ids, offset, fill[bins], same * (n - lower_bound(length, most)))] + [pa.array(np.full(len(uid), n < old))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []
            for a, b in zip(cut, cut[1:]):
                if held and held[0].column(0)[0].as_py() != int(g[a]):
                    yield group(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield group(pa.Table.from_batches(held))

    return run, "grp bigint, uid bigint, length bigint, was bigint, bin bigint, offset bigint, fill bigint, gap bigint, better boolean"


def pack(pieces: DataFrame, most: int = 1024, part_size: int = 100_000, max_rounds: int = 4) -> DataFrame:
    """Sequences of pieces (uid long, length long): uid, sequence_id, offset. No sequence holds more than `most`."""
    done = pieces.where(F.col("length") >= most).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    pool = pieces.where(F.col("length") < most).select("uid", "length", F.lit(-1).cast("bigint").alias("was"), F.lit(0).cast("bigint").alias("at"))
    for turn in range(max_rounds):
        n = pool.count()
        if not n:
            break
        run, schema = _pack(most, turn + 1)
        groups = -(-n // part_size)
        # bins given up stay whole within a group, so that a group's new packing can be held against its old one
        deal = F.xxhash64(F.lit(turn), F.when(F.col("was") >= 0, F.col("was")).otherwise(F.col("uid")))
        rows = pool.withColumn("grp", F.pmod(deal, F.lit(groups)))
        packed = materialise(rows.repartition(groups, "grp").sortWithinPartitions("grp", "uid").select("grp", "uid", "length", "was").mapInArrow(run, schema))
        if turn:
            worse = packed.where("not better").join(pool.select("uid", "at"), "uid").select("uid", F.col("was").alias("sequence_id"), F.col("at").alias("offset"))
            done = done.union(worse)
            packed = packed.where("better")
        final = turn == max_rounds - 1
        stays = packed if final else packed.where(f"gap = 0 or fill = {most}")
        done = done.union(stays.select("uid", F.col("bin").alias("sequence_id"), "offset"))
        if final:
            break
        pool = packed.where(f"gap > 0 and fill < {most}").select("uid", "length", F.col("bin").alias("was"), F.col("offset").alias("at"))
    return done


def packed(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], end: int = 2, most: int = 1024, part_size: int = 100_000, max_rounds: int = 4) -> DataFrame:
    """Per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = tokenised(docs, ranks, pattern, special, end, most)
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()))
    placed = pack(rows.select("uid", "length"), most, part_size, max_rounds)
    return rows.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
