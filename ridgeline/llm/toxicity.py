"""Toxicity by maximum-scoring segments.

Token scores are log-odds with an informative Dirichlet prior, turned into the log-likelihood ratio
of a passage in which a share of the tokens is toxic.  A linear scan (all maximal scoring
subsequences) finds every passage; extreme-value statistics of such segments under clean text say
which are significant; the evidence of a document's significant passages is calibrated to a
probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import coded, slices, split_words, stored

#: Bounds of what is fitted on one machine: labelled documents, and entries of the lexicon.
MAX_LABELLED = 40_000
MAX_LEXICON = 50_000
PRIOR = 100.0
PASSAGE_SHARE = 0.25
#: Words stand for themselves; unknown ones fall back to their first letters, the longer prefix first.
PREFIXES = (7, 5, 4)
LEAST_Z = 2.0
LEAST_DELTA = 2.0
LEAST_DOCUMENTS = 4
#: Copies of one toxic text repeat its words with the same neighbours; a lexicon entry needs this many
#: different left neighbours for each of its toxic documents.
LEAST_CONTEXTS = 0.4
SIGNIFICANT = 0.001
THRESHOLD = 0.7

_SPAN = "array<struct<first_word:int,last_word:int,raw:double,e_value:double>>"


@dataclass
class Model:
    """The lexicon (token -> score, '^' marks prefixes) and the statistics of clean text."""

    words: list[str]
    scores: list[float]
    background: float
    lam: float
    k: float
    intercept: float = -4.0
    slope: float = 2.0


def _words(texts) -> tuple[np.ndarray, pa.Array]:
    """Lower-case runs of letters and digits."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}\p{N}]+", " "))


def _prefix(words: pa.Array, size: int) -> pa.Array:
    """'^' and the first letters of words that are longer; null for others."""
    cut = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, size), "")
    return pc.if_else(pc.greater(pc.utf8_length(words), size), cut, pa.scalar(None, pa.string()))


def _features(words: pa.Array) -> list[pa.Array]:
    return [words, *[_prefix(words, n) for n in PREFIXES]]


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc, toxic, text): distinct texts of at most ``limit`` labelled documents, lowest hash first.

    Rows without id or label are left out; of contradicting labels the toxic one counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "doc_id")  # at most `limit` rows of two numbers
        .groupBy(F.md5("text").alias("doc")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    )


def _counts(train: DataFrame) -> DataFrame:
    """(token, toxic documents, clean documents) over words and prefixes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                offsets, words = _words(part.column(1))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                for tokens in _features(words):
                    keep = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
                    codes, distinct = coded(tokens.filter(pa.array(keep)))
                    pairs = np.unique(row[keep] * max(1, len(distinct)) + codes)
                    r, c = np.divmod(pairs, max(1, len(distinct)))
                    bad = np.bincount(c[toxic[r] == 1], minlength=len(distinct))
                    all_ = np.bincount(c, minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([distinct, pa.array(bad), pa.array(all_ - bad)], ["token", "bad", "good"])

    return (
        train.select("toxic", "text").mapInArrow(run, "token string, bad long, good long")
        .groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )


def _contexts(train: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, n): different left neighbours of the given tokens."""
    wanted = pa.array(tokens, pa.string())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, words = _words(part.column(0))
                first = np.zeros(len(words) + 1, bool)
                first[offsets] = True
                before = pc.if_else(pa.array(first[: len(words)]), "", pa.concat_arrays([pa.array([""]), words])[: len(words)])
                for values in _features(words):
                    hit = pc.is_in(values, value_set=wanted)
                    yield pa.RecordBatch.from_arrays([values.filter(hit), before.filter(hit)], ["token", "before"])

    pairs = train.select("text").mapInArrow(run, "token string, before string").distinct()
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _lexicon(part: DataFrame, max_lexicon: int) -> Model:
    """Lexicon, lambda and K from labelled texts."""
    empty = Model([], [], math.log1p(-PASSAGE_SHARE), 1.0, 1.0)
    sums = part.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    n_bad, n_good = int(sums["bad"] or 0), int(sums["good"] or 0)
    if not n_bad or not n_good:
        return empty
    prior = PRIOR * (F.col("bad") + F.col("good")) / F.lit(float(n_bad + n_good))
    delta = F.log((F.col("bad") + prior) / F.lit(n_bad + PRIOR)) - F.log((F.col("good") + prior) / F.lit(n_good + PRIOR))
    z = delta / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    found = (
        _counts(part).where(F.col("bad") >= LEAST_DOCUMENTS)
        .select("token", "bad", "good", prior.alias("prior"), delta.alias("delta"), z.alias("z"))
        .where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_DELTA)).orderBy(F.desc("z"), "token").limit(max_lexicon).collect()
    )
    varied = {r["token"]: r["n"] for r in _contexts(part.where("toxic = 1"), [r["token"] for r in found]).collect()} if found else {}  # at most a row per entry
    found = [r for r in found if varied.get(r["token"], 0) >= max(LEAST_DOCUMENTS, LEAST_CONTEXTS * r["bad"])]
    if not found:
        return empty
    scores = [math.log(1 - PASSAGE_SHARE + PASSAGE_SHARE * math.exp(min(r["delta"], 20.0))) for r in found]
    model = Model([r["token"] for r in found], scores, empty.background, 1.0, 1.0)
    # clean text: how often each word's score turns up per token
    n_words = part.where("toxic = 0").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"]
    plain = [(s, (r["good"] + r["prior"]) / (n_words + PRIOR)) for r, s in zip(found, scores, strict=True) if not r["token"].startswith("^")]
    model.lam = _karlin(np.array([s for s, _ in plain]), np.array([p for _, p in plain]), model.background)
    # the tail of clean documents' best segments gives K of K m exp(-lambda S)
    tops = scored(part.where("toxic = 0").select(F.lit(0).cast("long").alias("doc_id"), "text"), model, raw=True)
    floor = min(scores)
    tail = tops.agg(F.sum("n_words").alias("m"), F.sum((F.col("best") >= floor).cast("long")).alias("hits")).first()
    model.k = ((tail["hits"] or 0) + 0.5) / (max(1, tail["m"] or 0) * math.exp(-model.lam * floor))
    return model


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON) -> Model:
    """Fit on (doc_id, text) and (doc_id, toxic).

    A lexicon from three quarters of the labelled texts scores the rest, which calibrates the
    probability; the lexicon that is used then comes from all of them.  Without both classes the
    model scores nothing and every document gets the same low score.
    """
    train = stored(labelled(docs, labels, limit), "toxic-train")
    fold = F.pmod(F.crc32("doc"), F.lit(4))
    part = _lexicon(train.where(fold > 0), max_lexicon)
    points = scored(train.where(fold == 0).select(F.col("toxic").cast("long").alias("doc_id"), "text"), part)
    table = points.groupBy("doc_id", F.round("evidence", 1).alias("evidence")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per labelled text
    model = _lexicon(train, max_lexicon)
    model.intercept, model.slope = _logistic(
        np.log1p([r["evidence"] for r in table]), np.array([r["doc_id"] for r in table], float), np.array([r["n"] for r in table], float)
    )
    return model


def _karlin(scores: np.ndarray, share: np.ndarray, background: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 for clean text."""
    if not len(scores):
        return 1.0
    rest = max(1e-9, 1 - share.sum())

    def excess(x: float) -> float:
        return float((share * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(x * background) - 1)

    lo, hi = 1e-3, 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression with a light ridge, Newton's method; slope not negative."""
    if not len(x) or y.min() == y.max():
        return -4.0, 2.0
    a, b = -2.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p)
        ga, gb = (n * (y - p)).sum() - 1e-2 * a, (n * (y - p) * x).sum() - 1e-2 * b
        haa, hab, hbb = w.sum() + 1e-2, (w * x).sum(), (w * x * x).sum() + 1e-2
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def segments(at: np.ndarray, score: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (first, last, sum) of a text.

    ``at`` are the places of the positive tokens; all others score ``background`` < 0, so the linear
    scan need only stop at the positive ones.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for place, s in zip(at.tolist(), score.tolist(), strict=True):
        before = total + background * (place - last - 1)
        total, last = before + s, place
        first, left = place, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((first, place, left, total))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def _scorer(model: Model, raw: bool = False):
    """Function from an array of texts to (words, best segment, evidence, score, significant spans) of each."""
    lexicon = pa.array(model.words, pa.string())
    value = np.array([*model.scores, model.background])

    def score_texts(texts):
        rows = len(texts)
        offsets, words = _words(texts)
        codes, distinct = coded(words)
        found = pc.coalesce(*[pc.index_in(f, value_set=lexicon, skip_nulls=True) for f in _features(distinct)])
        index = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[codes]
        hits = np.flatnonzero(index >= 0)
        owner = np.searchsorted(offsets, hits, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(rows + 1))
        n_words = np.diff(offsets)
        best, evidence, spans = np.zeros(rows), np.zeros(rows), [[] for _ in range(rows)]
        for r in np.unique(owner):
            h = hits[cuts[r] : cuts[r + 1]]
            for first, last, s in segments(h - offsets[r], value[index[h]], model.background):
                best[r] = max(best[r], s)
                nats = model.lam * s - math.log(model.k * int(n_words[r]))
                if not raw and nats >= -math.log(SIGNIFICANT):
                    evidence[r] += nats
                    spans[r].append({"first_word": first, "last_word": last, "raw": s, "e_value": math.exp(-nats)})
        return n_words.astype(np.int64), best, evidence, 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(evidence)))), spans

    return score_texts


def scored(docs: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """(doc_id, n_words, best, evidence, score, spans) of whole texts, one row per row of (doc_id, text).

    Null and empty texts have no segment and get the score of no evidence.  ``spans`` holds every
    significant passage by its first and last word.  ``raw`` leaves significance out (to fit K).
    Rows that repeat come out as often; no rows give no rows; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("raw", pa.float64()), ("e_value", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        score_texts = _scorer(model, raw)
        for batch in batches:
            for part in slices(batch, "text"):
                *numbers, spans = score_texts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, numbers), pa.array(spans, kind)], ["doc_id", "n_words", "best", "evidence", "score", "spans"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, best double, evidence double, score double, spans {_SPAN}"
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        score_texts = _scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(score_texts(part.column("text"))[3] < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Rows whose labels are never used: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels that may be used and score every document: doc_id, held_out, score, predicted, n_words, spans."""
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "spans"
    )
