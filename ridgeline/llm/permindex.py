"""Approximate nearest neighbours with a permutation index.

Pivots are drawn from a bounded sample.  Every vector is the order of its nearest pivots; a block of
vectors posts them in one inverted file per pivot, with the place the pivot has in the vector's order.
A query walks the files of its own pivots, which adds up the footrule distance of the truncated
orders, and the best of each block are reranked by their true inner product.

Every block answers every query, so a query's candidates are a fixed share of all rows, whatever
their number, and the rows that tie with the last of them; blocks of rows and of queries have bounded size, however the vectors crowd.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 256
PREFIX = 64
BLOCK = 8192
QUERIES = 1024
#: Share of a block's rows that is reranked, and the least number.
SHARE, LEAST = 0.35, 400


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is neither null, zero, nor holds null or non-finite parts."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))


def choose_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The ``n`` directions of lowest hash among the different ones of the rows, scaled to length one.

    Rows of one direction count once, however many there are: equal pivots would fill the orders of all that is near.
    """
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # adding zero turns -0.0 into 0.0; the hash tells them apart
    ways = rows.select("v", largest.alias("m")).select(F.transform("v", lambda x: F.round(x / F.col("m"), 9) + F.lit(0.0)).alias("v")).distinct()
    got = ways.orderBy(F.xxhash64("v", F.lit(5)), "v").limit(n).collect()
    p = np.array([r["v"] for r in got])
    return p / np.linalg.norm(p, axis=1, keepdims=True) if len(p) else p


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots in order (ties to the smaller number); norms do not matter for the order."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Postings of one block: for each pivot its vectors, with the pivot's place in their order."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.rows, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.owner, self.place = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.cuts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Truncated footrule distance of every row to a query's order; a missing pivot counts as placed at the end.

        A shared pivot at places p and q lowers the distance of disjoint orders by twice
        prefix - max(p, q).
        """
        shared = np.zeros(self.rows, np.int32)
        for p, pivot in enumerate(order.tolist()):
            lo, hi = self.cuts[pivot], self.cuts[pivot + 1]
            shared[self.owner[lo:hi]] += self.prefix - np.maximum(self.place[lo:hi], p)
        return self.prefix * (self.prefix + 1) - 2 * shared


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, n_pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK,
    share: float = SHARE, least: int = LEAST,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` found nearest to each row of ``queries`` by inner product: query_id, rank, vec_id, score.

    Both are (vec_id, embedding); a query's own id is no candidate.  Nearest first, ties to the
    smaller vec_id.  Vectors that are null, zero, or hold null or non-finite parts take no part, nor
    do rows without an id; rows that repeat are candidates each; vectors of another length than the
    pivots' are an error.
    """
    rows, asked = usable(vectors), usable(queries)
    pivots = choose_pivots(rows, n_pivots)
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], empty)
    prefix = min(prefix, len(pivots))
    n_blocks = max(1, math.ceil(rows.count() / block))
    n_asked = max(1, math.ceil(asked.count() / QUERIES))

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.asarray(flat, np.float64).reshape(len(column), -1)

    def answer(base: pa.Table, query: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        out: list[tuple] = []
        if base.num_rows and query.num_rows:
            ids, x = base.column("vec_id").to_numpy(), matrix(base.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            files = InvertedFiles(prefixes(x, pivots, prefix), len(pivots))
            take = min(len(ids), max(least, math.ceil(share * len(ids))))
            q = matrix(query.column("v"))
            for qid, vector, own in zip(query.column("vec_id").to_pylist(), q, prefixes(q, pivots, prefix), strict=True):
                far = files.footrule(own)
                last = np.partition(far, take - 1)[take - 1]
                near = np.flatnonzero(far <= last)  # rows as far as the last one come along: no tie is cut
                near = near[ids[near] != qid]
                scores = x[near] @ vector
                best = np.lexsort((ids[near], -scores))[:k]
                out.append((np.full(len(best), qid, np.int64), ids[near][best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", deal(n_blocks, 1).alias("block"), all_of(n_asked).alias("part"))
    right = asked.select("vec_id", "v", deal(n_asked, 2).alias("part"), all_of(n_blocks).alias("block"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
