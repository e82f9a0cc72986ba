"""Best-fit packing: best-two-fit over the histogram of lengths.

How documents fill sequences depends on their lengths alone, and there are at most ``capacity``
lengths.  So the fill patterns are found once on the histogram (bounded by the capacity, whatever
the size of the corpus), and every piece finds its place by its rank among the pieces of its length.
Ranks come from counters inside the written partitions plus a sum over partitions, so no length,
however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import stored
from ridgeline.llm.tokens import default_files, document_ids, encoder, pieces

CAPACITY = 1024
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of every document (doc_id, text): ids, end id, then pieces of at most ``capacity``.

    Null text is empty and still yields its end id; repeated rows yield their pieces each time.
    ``part`` and ``nth`` count pieces of a length inside a task; they hold once the result is written.
    """
    json_path, ranks_path = files or default_files()

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(json_path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document_ids(encode, text.as_py(), end_id)
                for k, (start, length) in enumerate(pieces(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use up ``counts`` {length: number}.

    A sequence starts with the longest length left and takes the longest that still fits until
    nothing does.  Then its smallest member gives way to the two unpacked lengths that fill the
    widened gap best, if they fill it further; this repeats while it helps.  The found pattern is
    used as often as the counts allow.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        bin_: list[int] = []
        gap = capacity
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            take = int(fits[-1]) + 1
            bin_.append(take)
            left[take] -= 1
            gap -= take
        while gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            pair = _best_pair(left, room, small)
            if pair is None:
                break
            bin_.remove(small)
            left[small] += 1
            for x in pair:
                bin_.append(x)
                left[x] -= 1
            gap = room - sum(pair)
        uses = {x: bin_.count(x) for x in bin_}
        again = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= again * n
        out.append((tuple(sorted(bin_, reverse=True)), again + 1))
    return out


def _best_pair(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (least, room]; the most unequal pair of those."""
    have = np.flatnonzero(left[: room + 1])
    have = have[have > 0]
    best, pair = least, None
    for a in have[::-1]:
        rest = have[have <= min(a, room - a)]
        if len(rest) and rest[-1] == a and left[a] < 2:
            rest = rest[:-1]
        if len(rest) and a + rest[-1] > best:
            best, pair = int(a + rest[-1]), (int(a), int(rest[-1]))
            if best == room:
                break
    return pair


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, ranks per sequence, offset of the first).

    Pieces of one length that share a sequence follow one another in it.
    """
    used: dict[int, int] = {}
    out, base = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            lo = used.get(x, 0)
            out.append((x, lo, lo + per * times, base, per, offset))
            used[x] = lo + per * times
            offset += per * x
        base += times
    return out


def ranked(cuts: DataFrame) -> DataFrame:
    """Written pieces plus ``rank`` among the pieces of their length."""
    counts = cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return cuts.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls, empty texts and repeated rows as in :func:`cut`; no rows give no rows.  Other columns
    of ``docs`` are ignored.
    """
    cuts = stored(cut(docs, capacity, end_id, files), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = layout(best_two_fit(counts, capacity))
    places = docs.sparkSession.createDataFrame(plan, "length int, lo long, hi long, base long, per int, at long")
    spot = F.col("rank") - F.col("lo")
    return (
        ranked(cuts).alias("r").join(F.broadcast(places), "length")  # a few rows for each length, see best_two_fit
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
            (F.col("base") + F.floor(spot / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(spot, F.col("per").cast("long")) * F.col("length")).cast("long").alias("offset"),
        )
    )
