"""Periodic runs of words: maximal repetitions found by uniting suffixes in order of falling LCP.

The suffixes of a text are ordered by prefix doubling, and neighbours in that order are edges weighted by
their longest common prefix (LCP); edges too short for any run are left out.
Kruskal's walk takes the edges from the largest LCP down and unites classes with union-find; a class
keeps its positions in order, and the smaller class moves into the larger one.  Two positions i < j that
become neighbours at LCP l agree on l words exactly, so with j - i <= l the words i .. j + l - 1 have the
smallest period j - i and end where the period ends.  The leftmost such i for a period and an end is the
run's start: nothing has to be extended by hand.

A text is handled within its own task; slices of texts are worked on together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import coded, mix, slices, split_words

SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
_WORD = r"[\x20\x09-\x0D]+"


def least_prefix(length: int, exponent: int) -> int:
    """Words that the first two periods' starts of any run have in common at least."""
    return min(max(length, exponent * q) - q for q in range(1, length + 1))


def _repeated(codes: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` words occur again in the same row (by hash: a few more may come along)."""
    n = len(codes) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    word, h = mix(codes.astype(np.uint64) + np.uint64(1)), mix(row[:n].astype(np.uint64) + np.uint64(0x51ED27))
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    h = mix(h)
    inside = np.flatnonzero(row[:n] == row[width - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    if not len(order):
        return order
    same = h[order][1:] == h[order][:-1]
    return np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])


class _Suffixes:
    """Order of all suffixes of the rows of a slice by prefix doubling, with the LCP of neighbours.

    A rank is the place of the suffix's class in the order; a level compares twice as many words as
    the one before, and only what still shares its rank is sorted again.
    """

    def __init__(self, codes: np.ndarray, row: np.ndarray):
        self.n = n = len(codes)
        self.end = np.searchsorted(row, row, side="right")
        order = np.lexsort((codes, row))
        self.levels = [self._placed(order, row[order] * (int(codes.max()) + 1) + codes[order], np.zeros(n, np.int64))]
        while True:
            rank = self.levels[-1]
            open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(open_):
                break
            second = self._rank(rank, open_ + (1 << (len(self.levels) - 1)), self.end[open_]) + 1
            key = rank[open_] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            new = rank.copy()
            where, key = open_[by], key[by]
            start = np.concatenate([[True], rank[where][1:] != rank[where][:-1]])
            since = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
            first = np.concatenate([[True], key[1:] != key[:-1]])
            new[where] = rank[where] + since[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
            self.levels.append(new)
        self.order = np.argsort(self.levels[-1])

    @staticmethod
    def _placed(order: np.ndarray, key: np.ndarray, out: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        out[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return out

    def _rank(self, level: np.ndarray, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks at ``pos``; -1 past the row's end."""
        return np.where(pos < end, level[np.minimum(pos, self.n - 1)], -1)

    def edges(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, position, LCP) of neighbours that share ``least`` words or more, largest LCP first."""
        a, b = self.order[:-1], self.order[1:]
        near = self.levels[0][a] == self.levels[0][b]
        a, b = a[near], b[near]
        p, q, end_p, end_q = a.copy(), b.copy(), self.end[a], self.end[b]
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = self._rank(self.levels[k], p, end_p), self._rank(self.levels[k], q, end_q)
            step = np.where((x >= 0) & (x == y), 1 << k, 0)
            p, q = p + step, q + step
        lcp = p - a
        order = np.argsort(-lcp, kind="stable")
        order = order[: int((lcp >= least).sum())]
        return a[order], b[order], lcp[order]


def _kruskal(left: list[int], right: list[int], lcp: list[int], length: int, exponent: int) -> dict[tuple[int, int], int]:
    """{(end, period): start} of the runs among the positions that the edges join."""
    parent = {p: p for p in (*left, *right)}
    places = {p: [p] for p in parent}
    found: dict[tuple[int, int], int] = {}

    def seed(i: int, j: int, common: int) -> None:
        period = j - i
        if exponent * period <= period + common >= length:
            key = (j + common, period)
            found[key] = min(i, found.get(key, i))

    for a, b, common in zip(left, right, lcp, strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(places[a]) < len(places[b]):
            a, b = b, a
        large, small = places[a], places[b]
        last = len(small) - 1
        for k, p in enumerate(small):
            at_ = len(large) if large[-1] < p else bisect_left(large, p)
            # only neighbours of different classes are new
            if at_ and not (k and large[at_ - 1] == small[k - 1]):
                seed(large[at_ - 1], p, common)
            if at_ < len(large) and not (k < last and small[k + 1] < large[at_]):
                seed(p, large[at_], common)
            large.insert(at_, p)
        parent[b], places[b] = a, []
    return found


def runs_of(codes: np.ndarray, offsets: np.ndarray, length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every row of a slice, by start and period."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    width = least_prefix(length, exponent)
    some = np.zeros(len(out), bool)
    some[row[_repeated(codes, row, width)]] = True
    at = np.flatnonzero(some[row])  # rows in which nothing of that length repeats have no runs
    if len(at):
        left, right, lcp = _Suffixes(codes[at], row[at]).edges(width)
        for (end, period), start in _kruskal(left.tolist(), right.tolist(), lcp.tolist(), length, exponent).items():
            k = int(row[at[start]])
            out[k].append((int(at[start] - offsets[k]), end - start, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def detect(docs: DataFrame, length: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, runs and collapsed text of every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, numbered from 0.  A run is a stretch of words of
    smallest period q, at least ``length`` words and ``exponent`` periods long, that no neighbouring
    word extends; ``collapsed`` holds the words left when every run keeps its first period only,
    joined by single blanks.  Null and blank texts have no runs and an empty collapsed text; a null id
    is kept; rows that repeat come out as often; other columns are ignored; no rows give no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                offsets, words = split_words(texts)
                codes, _ = coded(words)
                found, collapsed = runs_of(codes, offsets, length, exponent), []
                for text, runs in zip(texts, found, strict=True):
                    kept = (text.as_py() or "").encode().split()
                    if runs:
                        keep = np.ones(len(kept), bool)
                        for start, size, period in runs:
                            keep[start + period : start + size] = False
                        kept = compress(kept, keep.tolist())
                    collapsed.append(b" ".join(kept).decode())
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUNS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return plain.mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail put into every document whose id asks for it.

    With h the CRC-32 of the decimal id and g = h div 10: where h ends in 0, the words from a = g mod n
    on repeat the first p = 1 + (n - a) div (3 + g mod 8) of them.  Rows without id or words stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, _WORD), lambda w: w != "")
    g = F.floor(h / 10).cast("long")

    def tile(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tile(w)).otherwise(""))[0]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(h % 10 == 0, tail).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent and digests of the rows of :func:`detect`; see there for odd rows."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[n].alias(n) for n in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
