"""Ranked lexical search over posting lists cut into geometric blocks.

Documents are indexed in segments of bounded size, each with a posting list per term.  A list is cut into
blocks of similar documents: representatives are spread over the list and every document joins the
one it is nearest to.  A block's summary holds, for every term that a query asks together with the list's,
the largest impact any of its documents has there, so the summary's score bounds the score of each of them from above.  A query walks
the blocks of its terms from the largest bound down and scores a block's documents exactly from the
forward rows; a block is skipped only if its bound is below the score of the k-th document found so far.
No document of the answer can be lost, ties included.

Everything is integer arithmetic.  Queries are taken in groups whose terms make the coordinates of one
index; a group is one pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import slices, stored

K = 50
#: Terms and queries of a group (a query of more terms is a group of its own), and coordinates of a summary.
MAX_TERMS, MAX_QUERIES = 4096, 1024
#: Documents of a block about, and cells of a segment's table of documents by terms at most.
BLOCK, CELLS, SEGMENT = 64, 1 << 23, 2048
_SKETCH = 32
_SPREAD = 64
#: Bytes of a term stay, capital letters are lowered, all others separate.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PARTS = ["ids", "known", "starts", "cols", "impacts", "first", "cuts", "members", "width", "coords", "values"]


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z are lowered."""
    return (text or "").encode().translate(_BYTES).split()


@dataclass(frozen=True)
class Group:
    """Queries whose terms are the columns of one index."""

    columns: dict[bytes, int]
    queries: list[tuple[int, int | None, np.ndarray]]


def groups_of(items: DataFrame) -> Iterator[Group]:
    """The rows of ``items`` (item_id, text) in groups of bounded size, read one after another."""
    columns: dict[bytes, int] = {}
    queries: list[tuple[int, int | None, np.ndarray]] = []
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    for number, r in enumerate(rows.toLocalIterator()):
        own = list(dict.fromkeys(terms_of(r["text"])))
        if queries and (len(queries) >= MAX_QUERIES or len(columns) + sum(t not in columns for t in own) > MAX_TERMS):
            yield Group(columns, queries)
            columns, queries = {}, []
        queries.append((number, r["item_id"], np.array([columns.setdefault(t, len(columns)) for t in own], np.int64)))
    if columns:
        yield Group(columns, queries)


def forward(docs: DataFrame, columns: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), cols and tfs (columns of the group's terms, and how often) of documents with a term."""
    columns = docs.sparkSession.sparkContext.broadcast(columns)  # bounded by MAX_TERMS, or by one query's terms
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = columns.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, cols, tfs = [], [], []
                for text in part.column("text"):
                    words = terms_of(text.as_py())
                    own = [(known[t], c) for t, c in Counter(words).items() if t in known]
                    n.append(len(words))
                    cols.append([c for c, _ in own])
                    tfs.append([t for _, t in own])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cols, lists), pa.array(tfs, lists)], ["doc_id", "n", "cols", "tfs"]
                )

    return plain.mapInArrow(run, "doc_id long, n long, cols array<int>, tfs array<int>").where("n > 0")


def weights_of(n_docs: int, counts: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of every column; 0 where no document holds the term."""
    out = np.zeros(size, np.int64)
    for c, df in counts.items():
        out[c] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


def impacts_of(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * n_docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _blocks(docs: np.ndarray, place: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents by block, starts of the blocks): each joins the nearest of some spread over the list; large blocks are cut."""
    if len(docs) <= block:
        return docs, np.zeros(1, np.int64)
    centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // block)).astype(np.int64)]
    nearest = np.argmax(place[docs] @ place[centres].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    nearest = nearest[order]
    first = np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))
    since = np.arange(len(docs)) - np.repeat(first, np.diff(np.concatenate([first, [len(docs)]])))
    return docs[order], np.flatnonzero(since % (2 * block) == 0)


def partners(group: Group) -> np.ndarray:
    """For every column the coordinates that a query of the group has along with it, as rows of bits."""
    fold = min(len(group.columns), MAX_TERMS)
    out = np.zeros((len(group.columns), fold), bool)
    for _, _, columns in group.queries:
        out[np.ix_(columns, np.unique(columns % fold))] = True
    return np.packbits(out, axis=1)


def build(starts: np.ndarray, cols: np.ndarray, impacts: np.ndarray, weights: np.ndarray, together: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Blocks of every list of a segment and their summaries (of at most MAX_TERMS coordinates, columns folded onto them).

    Every document has a column at least; ``together`` are the :func:`partners`.
    """
    n, size = len(starts) - 1, len(weights)
    row = np.repeat(np.arange(n), np.diff(starts))
    fold = min(size, MAX_TERMS)
    table = np.zeros((n, fold), np.int32)
    np.maximum.at(table, (row, cols % fold), impacts)
    axes = np.random.default_rng(12).standard_normal((size, _SKETCH)).astype(np.float32)
    place = np.add.reduceat((weights[cols] * impacts / 1e6)[:, None].astype(np.float32) * axes[cols], starts[:-1], axis=0)
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(cols, kind="stable")
    ends = np.searchsorted(cols[by_term], np.arange(size + 1))
    first, cuts, members, width, coords, values = [0], [], [], [], [], []
    for t in range(size):
        docs, begin = row[by_term[ends[t] : ends[t + 1]]], np.zeros(0, np.int64)
        if len(docs):
            docs, begin = _blocks(docs, place, block)
            asked = np.flatnonzero(np.unpackbits(together[t], count=fold))
            top = np.maximum.reduceat(table[np.ix_(docs, asked)], begin, axis=0)
            at, where = np.nonzero(top)
            width.append(np.bincount(at, minlength=len(begin)))
            coords.append(asked[where].astype(np.uint16))
            values.append(top[at, where])
            cuts.append(ends[t] + begin)
            members.append(docs)
        first.append(first[-1] + len(begin))
    whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return {
        "starts": starts.astype(np.int32), "cols": cols.astype(np.int32), "impacts": impacts.astype(np.int32), "first": np.array(first, np.int32),
        "cuts": np.append(whole(cuts, np.int32), np.int32(len(cols))), "members": whole(members, np.int32), "width": whole(width, np.int32),
        "coords": whole(coords, np.uint16), "values": whole(values, np.int32),
    }


_KINDS = {"ids": np.int64, "known": np.bool_, "coords": np.uint16}


class Segment:
    """One segment's lists, blocks and summaries, ready for queries."""

    def __init__(self, parts: dict[str, np.ndarray], size: int):
        self.__dict__.update(parts)
        n, self.fold = len(self.starts) - 1, min(size, MAX_TERMS)
        self.table = np.zeros((n, size), np.int32)
        self.table[np.repeat(np.arange(n), np.diff(self.starts)), self.cols] = self.impacts
        owner = np.repeat(np.arange(len(self.width), dtype=np.int32), self.width)
        by = np.argsort(self.coords, kind="stable")
        self.owner, self.top = owner[by], self.values[by]
        self.ends = np.searchsorted(self.coords[by], np.arange(self.fold + 1))

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the query's terms and upper bounds of the scores in them; sums stay far below 2^53."""
        total = np.zeros(len(self.width))
        for c, w in zip((columns % self.fold).tolist(), weights.tolist(), strict=True):
            lo, hi = self.ends[c], self.ends[c + 1]
            total[self.owner[lo:hi]] += w * self.top[lo:hi].astype(np.float64)  # a block has a coordinate once
        blocks = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in columns.tolist()])
        return blocks, total[blocks].astype(np.int64)

    def answer(self, columns: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the segment's documents into ``best``; returns the number of documents scored."""
        blocks, bound = self.bounds(columns, weights)
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        seen = np.zeros(len(self.starts) - 1, bool)
        at, step, scored = 0, 4, 0
        while at < len(blocks):
            near = blocks[at : at + step][bound[at : at + step] >= best.least]
            if not len(near):
                break
            docs = np.concatenate([self.members[self.cuts[b] : self.cuts[b + 1]] for b in near.tolist()])
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            scores = self.table[np.ix_(docs, columns)].astype(np.int64) @ weights
            best.add(scores, self.ids[docs], self.known[docs])
            scored += len(docs)
            at, step = at + step, 2 * step
        return scored


class Best:
    """The ``k`` best documents so far: score falling, then id (null last)."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids, known = (np.concatenate(c) for c in ((self.scores, scores[good]), (self.ids, ids[good]), (self.known, known[good])))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def index(rows: DataFrame, group: Group, weights: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """One row for each segment of the rows of :func:`forward`: forward rows, blocks and summaries, compressed."""
    size = len(weights)
    asked = rows.sparkSession.sparkContext.broadcast(partners(group))  # a bit for two of the group's terms
    most = max(1, min(SEGMENT, CELLS // max(1, size)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, ...]] = []

        def made() -> pa.RecordBatch:
            ids, known, sizes, cols, impacts = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            parts = {"ids": ids, "known": known, **build(np.concatenate([[0], np.cumsum(sizes)]), cols, impacts, weights, asked.value)}
            return pa.RecordBatch.from_arrays([pa.array([z.compress(parts[p].tobytes())], pa.binary()) for p in _PARTS], _PARTS)

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, most - sum(len(h[0]) for h in held))
                start += part.num_rows
                numbers = lambda name: part.column(name).flatten().to_numpy().astype(np.int64)  # noqa: B023, E731
                sizes, ids = np.diff(part.column("cols").offsets.to_numpy()).astype(np.int64), part.column("doc_id")
                n = np.repeat(part.column("n").to_numpy(), sizes)
                held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), sizes, numbers("cols"), impacts_of(numbers("tfs"), n, n_docs, length)))
                if sum(len(h[0]) for h in held) >= most:
                    yield made()
        if held:
            yield made()

    return rows.where(F.size("cols") > 0).mapInArrow(run, ", ".join(f"{p} binary" for p in _PARTS))


def ask(segments: DataFrame, group: Group, weights: np.ndarray, k: int = K) -> DataFrame:
    """query (number), item_id, doc_id, score: each task's ``k`` best of the segments it reads; thresholds go from one to the next."""
    queries = [(q, i, c[weights[c] > 0], weights[c[weights[c] > 0]]) for q, i, c in group.queries]
    queries = [q for q in queries if len(q[2])]
    size = len(weights)

    def run(batches) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                parts = {p: np.frombuffer(z.decompress(batch.column(p)[row].as_py()), _KINDS.get(p, np.int32)) for p in _PARTS}
                segment = Segment(parts, size)
                for (_, _, columns, own), b in zip(queries, best, strict=True):
                    segment.answer(columns, own, b)
        for (number, item_id, *_), b in zip(queries, best, strict=True):
            n = len(b.scores)
            if n:
                columns = [pa.array([number] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(b.ids, pa.int64(), mask=~b.known), pa.array(b.scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return segments.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``.

    ``docs`` is (doc_id, text), ``items`` (item_id, text); other columns are ignored.  Null and blank texts
    have no term: such documents count nowhere, such items have no answer, and no rows give no rows.
    Equal scores go by doc_id, null ids last; documents that repeat are found each, items that repeat
    are answered each.
    """
    spark, out = docs.sparkSession, None
    for group in groups_of(items):
        rows = stored(forward(docs, group.columns), "forward")
        total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        if not total["docs"]:
            break
        counts = dict(rows.select(F.explode("cols").alias("c")).groupBy("c").count().collect())  # one row for each of the group's terms
        weights = weights_of(total["docs"], counts, len(group.columns))
        segments = stored(index(rows, group, weights, total["docs"], total["length"]), "segments")
        found = ask(segments, group, weights, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for keys in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD))], ["query"]):  # in two steps, so that no task ranks what all tasks found
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
