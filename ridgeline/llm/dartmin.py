"""Near-duplicates by DartMinHash.

Each document is a weighted set of five-word shingles.  Every element owns a plane of weight by rank,
cut into cells in which a hash throws a Poisson number of darts; a set sees the darts below its
weights, and of those that a hash sends to one coordinate the dart of least rank is the signature
entry.  Equal entries have the probability of the weighted Jaccard similarity.  Rows that agree in a
whole band are candidates, and every candidate link is checked on the texts before it joins two
documents into a class.

Candidates are not spelled out as all pairs of a bucket.  In star rounds each bucket compares its
members with one root, another one in each band and round; what the found links have joined needs no
more checks.  Only members that remain outside their bucket's largest class are then compared with
the rest of the bucket, so no candidate link between classes is left out.  Pairs of these rounds are
first compared by 2,048 bits of a longer signature, which err once in 80,000 pairs at the least
similarity (the bands themselves once in 17,000), and only then on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import mix, slices, split_words, stored, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
STARS = 2
BITS = 2048
_LEVELS = 4  # rank cells below 1 have widths 1/16, 2/16, 4/16, 8/16; from 15/16 on the width is 1
_U = np.uint64
_TO_UNIT = 2.0**-53


def shingles(offsets: np.ndarray, hashes: np.ndarray, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct shingles (64-bit hashes) and their counts; a shorter text is one shingle."""
    power = [_U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    n = len(hashes) - size + 1
    roll = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        if n > 0:
            roll += hashes[k : k + n] * power[k]
    roll = mix(roll)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1], return_counts=True))
        elif b > a:
            out.append((mix(np.array([sum(int(h) * int(p) for h, p in zip(hashes[a:b], power)) % (1 << 64)], np.uint64)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def _rank_cells(theta: float) -> tuple[np.ndarray, np.ndarray]:
    """(low ends, widths) of the rank cells that begin below ``theta``."""
    low = [(2.0**k - 1) / 16 for k in range(_LEVELS)]
    width = [2.0**k / 16 for k in range(_LEVELS)]
    first = 15 / 16
    more = max(0, math.ceil(theta - first))
    low, width = np.array(low + [first + k for k in range(more)]), np.array(width + [1.0] * more)
    keep = low < theta
    return low[keep], width[keep]


def signature(ids: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` entries of a weighted set with positive weights; the same darts whatever the set."""
    total = float(weights.sum())
    theta = (k * math.log(k) + 2 * k) / total
    cells = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), cells)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    base = mix(ids[owner] + mix((unit + (seed << 32)).astype(np.uint64)))
    while True:
        low, width = _rank_cells(theta)
        h = mix(base[:, None] ^ (np.arange(1, len(low) + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))[None, :])
        u = (h >> _U(11)).astype(np.float64) * _TO_UNIT
        # Poisson by inversion: the number of cumulated probabilities that u exceeds
        term = np.exp(-width)
        cdf = term.copy()
        at = np.nonzero(u > cdf[None, :])
        uu, number, step = u[at], np.ones(len(at[0]), np.int64), 1
        alive = np.arange(len(uu))
        while len(alive) and step < 20:
            term = term * width / step
            cdf = cdf + term
            alive = alive[uu[alive] > cdf[at[1][alive]]]
            number[alive] += 1
            step += 1
        pick = np.repeat(np.arange(len(number)), number)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(number) - number, number)
        dart = mix(h[at][pick] + (nth + 1).astype(np.uint64) * _U(0xA24BAED4963EE407))
        cell, unit_of = at[1][pick], at[0][pick]
        rank = low[cell] + width[cell] * ((dart >> _U(11)).astype(np.float64) * _TO_UNIT)
        again = mix(dart ^ _U(0x5851F42D4C957F2D))
        place = unit[unit_of] + (again >> _U(11)).astype(np.float64) * _TO_UNIT
        keep = np.flatnonzero((rank < theta) & (place < weights[owner[unit_of]]))
        order = keep[np.argsort(-rank[keep], kind="stable")]
        coordinate = ((mix(again) >> _U(33)) % _U(k)).astype(np.int64)
        out, met = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate[order]] = dart[order]  # the last written is the earliest
        met[coordinate[order]] = True
        if met.all():
            return out
        theta *= 1.5


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted distinct elements, counts); empty sets are unlike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    import pyarrow.compute as pc

    offsets, words = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    return shingles(offsets, word_hashes(words))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tkey (digest of the text), n (shingles) and one hash for each band; none for texts without a word."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices(batch, "text"):
                sums, made = [], []
                for ids, counts in _sets(part.column(2)):
                    sums.append(int(counts.sum()))
                    if not len(ids):
                        made.append([])
                        continue
                    sig = signature(ids, counts.astype(np.float64), bands * rows).reshape(bands, rows)
                    h = salt.copy()
                    for r in range(rows):
                        h = mix(h ^ sig[:, r])
                    made.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sums, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "tkey", "n", "bands"]
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, tkey binary, n long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar enough."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                left, right = _sets(part.column(2)), _sets(part.column(3))
                keep = pa.array([similarity(x, y) >= least for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    a = texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _split(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, tkey, n, label) of the buckets that hold several classes; those of them outside the bucket's largest class."""
    parts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = known.join(largest, "bucket").select("bucket", "tkey", "n", "label", "largest")
    return split, split.where("label != largest")


def _bits(texts: DataFrame) -> DataFrame:
    """(tkey, bits): one bit of each entry of a longer signature, packed into longs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for ids, counts in _sets(part.column(1)):
                    odd = mix(signature(ids, counts.astype(np.float64), BITS, seed=2)) >> _U(63)
                    rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64()))], ["tkey", "bits"])

    return texts.select("tkey", "text").mapInArrow(run, "tkey binary, bits array<long>")


def _alike(a: str, b: str, least: float):
    """Whether the bits of two sets agree as those of similar sets do; one pair in 80,000 at the least similarity does not."""
    share = (1 + least) / 2
    fewest = BITS * share - 4.2 * math.sqrt(BITS * share * (1 - share))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.lit(BITS) - differ >= F.lit(fewest)


def _with_root(rows: DataFrame, pool: DataFrame, turn: int, least: float) -> DataFrame:
    """(tkey, x): members of each bucket with one of ``pool``, of another class; another one in each band and turn."""
    columns = F.struct("tkey", "n", "label", *(["bits"] if "bits" in pool.columns else []))
    root = pool.groupBy("bucket").agg(F.min_by(columns, F.xxhash64("tkey", "bucket", F.lit(turn))).alias("root"))
    fits = (F.col("label") != F.col("root.label")) & _close("n", "root.n", least)
    if "bits" in pool.columns:
        fits = fits & _alike("bits", "root.bits", least)
    return rows.join(root, "bucket").where(fits).select("tkey", F.col("root.tkey").alias("x"))


def _across(split: DataFrame, outside: DataFrame, least: float) -> DataFrame:
    """(tkey, x): pairs of different classes in a bucket, one of them outside the largest, whose bits allow the similarity.

    A pair comes from the least of its common buckets only; all of them still hold both classes.
    """
    there = outside.select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("n", "label", "bits", "own")], F.col("tkey").alias("x"))
    fits = (F.col("label") != F.col("label_x")) & _close("n", "n_x", least) & _alike("bits", "bits_x", least)
    fits = fits & (F.array_min(F.array_intersect("own", "own_x")) == F.col("bucket"))
    return split.join(there, "bucket").where(fits).select("tkey", "x")


class _Links:
    """Links found so far, pairs compared so far, and the classes they make."""

    def __init__(self, members: DataFrame, texts: DataFrame, least: float):
        self.members, self.texts, self.least = members, texts, least
        self.edges = self.tested = self.label = None

    def known(self) -> DataFrame:
        if self.label is None:
            return self.members.withColumn("label", F.col("tkey"))
        named = self.members.join(self.label.withColumnRenamed("node", "tkey"), "tkey", "left")
        return named.withColumn("label", F.coalesce("label", "tkey"))

    def compare(self, near: DataFrame) -> None:
        """Check the pairs (tkey, x) that were not checked before, and join what they link."""
        pairs = near.select(F.greatest("tkey", "x").alias("a"), F.least("tkey", "x").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if self.label is not None and pairs.isEmpty():
            return
        found = stored(_verified(pairs, self.texts, self.least), "edges")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        if self.label is None or not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.union(found)
            self.label = stored(components(self.edges), "labels")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): the least node of each component.

    Rounds of the large-star and small-star kind: every node passes the least neighbour it knows to
    its neighbours until each component is one star.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stored(small.where("a != b").distinct(), "links", replaces=before)
        before = new.folder
        # a star has no node that both hangs on another and carries others, and each node hangs on one
        hung = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        settled = hung.where("n > 1").isEmpty() and new.select(F.col("b").alias("a")).join(hung, "a", "left_semi").isEmpty()
        edges = new
        if settled:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _close(a: str, b: str, least: float):
    """Sums of weights that allow the similarity at all."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _row_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """doc_id, tkey, class_id, is_first of every row; see :func:`classes`."""
    sketch = stored(sketches(docs, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = sketch.where("n > 0")
    texts_of = some.groupBy("tkey").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min_by("row", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("row"))
    posted = texts_of.select("tkey", "n", F.posexplode("bands").alias("band", "h")).select("tkey", "n", F.xxhash64("band", "h").alias("bucket"))
    crowded = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(posted.join(crowded, "bucket").drop("size"), "buckets")
    keys = members.select("tkey").distinct()
    texts = stored(
        _keyed(docs).select("tkey", "text").join(keys, "tkey", "left_semi").groupBy("tkey").agg(F.first("text").alias("text")), "texts"
    )
    links = _Links(members, texts, least)
    known = links.known()
    links.compare(_with_root(known, known, 0, least))
    split, _ = _split(links.known())
    own = split.groupBy("tkey").agg(F.collect_set("bucket").alias("own"))  # one for each band at most
    bits = stored(_bits(texts.join(own, "tkey", "left_semi")).join(own, "tkey"), "bits")
    for turn in range(1, stars + 1):
        split, outside = _split(links.known())
        if turn < stars:
            links.compare(_with_root(split.join(bits, "tkey"), outside.join(bits, "tkey"), turn, least))
        else:
            links.compare(_across(split.join(bits, "tkey"), outside.join(bits, "tkey"), least))
    label = links.label
    named = texts_of.join(label.withColumnRenamed("node", "tkey"), "tkey", "left").select("tkey", F.coalesce("label", "tkey").alias("label"), "row")
    # ids and first rows by label, from one row per text and the least id of each text
    low = some.groupBy("tkey").agg(F.min("doc_id").alias("low"))
    named = named.join(low, "tkey")
    heads = named.groupBy("label").agg(F.min("low").alias("class_id"), F.min_by("row", F.coalesce("low", F.lit(2**63 - 1))).alias("first"))
    several = named.join(heads, "label").select("tkey", "class_id", "first")
    plain = sketch.join(several, "tkey", "left")
    alone = F.col("n") == 0
    return plain.select(
        "doc_id", "tkey", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("row") == F.col("first"))).alias("is_first"),
    )


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), is_first (the one row that stands for the class).

    Equal texts share a class, and so do texts joined by links of weighted Jaccard similarity of at
    least ``least``.  Words are lower-cased runs of anything but ASCII white space; texts of fewer
    than five words are one shingle; null, empty and blank texts are no copies of anything, each is a
    class of its own.  Null ids are never a class_id unless nothing else is there.  Rows that repeat
    come out as often, and only one row per class is first.
    """
    return _row_classes(docs, least, bands, rows, stars).drop("tkey")


def firsts(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their class; one each."""
    none = -(2**63)  # stands for a null id
    kept = _row_classes(docs, least).where("is_first").select(F.coalesce("doc_id", F.lit(none)).alias("_id"), F.col("tkey").alias("_tkey"))
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("_id"), key.alias("_tkey"))
    # rows that repeat an id and a text are one row; blank texts are classes of their own but equal rows among them also meet here
    return whole.join(kept.distinct(), ["_id", "_tkey"], "left_semi").groupBy("_id", "_tkey").agg(F.first("_row").alias("_row")).select("_row.*")
