import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import blockindex as B

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(d, Counter(w), len(w)) for d, t in docs if (w := split(t))]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(split(text)) if b[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ09é \t_/:@[`{~\x00\x7f\x80\xa0ÀI")), max_size=60))
def test_terms(text):
    assert [t.decode() for t in B.terms_of(text)] == TERM.findall(text.translate(LOWER))


def _segment(rng, n=900, size=60, block=16):
    sizes = rng.integers(1, 20, n)
    cols = np.concatenate([rng.choice(size, s, replace=False, p=np.arange(1, size + 1) / (size * (size + 1) / 2)) for s in sizes]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    impacts = rng.integers(1, 10**6, len(cols))
    weights = rng.integers(1, 9000, size)
    queries = [(0, 0, np.array([3, 40, 59])), (1, 1, np.arange(60)[::2]), (2, 2, np.array([50]))]
    parts = B.build(starts, cols, impacts, weights, B.partners(B.Group({bytes([c]): c for c in range(size)}, queries)), block)
    return parts, B.Segment({"ids": np.arange(n), "known": np.ones(n, bool), **parts}, size), weights


@pytest.mark.parametrize("coordinates", [4096, 25])
def test_summaries_bound_every_member_and_lists_are_whole(coordinates, monkeypatch):
    monkeypatch.setattr(B, "MAX_TERMS", coordinates)
    parts, seg, weights = _segment(np.random.default_rng(1))
    for t in range(len(weights)):
        own = [seg.members[seg.cuts[b] : seg.cuts[b + 1]] for b in range(seg.first[t], seg.first[t + 1])]
        assert sorted(np.concatenate(own).tolist()) == np.flatnonzero(seg.table[:, t]).tolist() and max(map(len, own)) <= 32
    for columns in (np.array([3, 40, 59]), np.arange(60)[::2], np.array([50])):
        blocks, bound = seg.bounds(columns, weights[columns])
        for b, most in zip(blocks, bound, strict=True):
            scores = seg.table[seg.members[seg.cuts[b] : seg.cuts[b + 1]]][:, columns].astype(np.int64) @ weights[columns]
            assert most >= scores.max()


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 30, 4000)
    cols = np.stack([kinds * 3, kinds * 3 + 1, kinds * 3 + 2, np.full(4000, 90)], 1).ravel()
    impacts, weights = rng.integers(1, 10**6, len(cols)), np.full(91, 100)
    columns = np.array([0, 1, 2, 90])
    asked = B.partners(B.Group({bytes([c]): c for c in range(91)}, [(0, 0, columns)]))
    seg = B.Segment({"ids": np.arange(4000), "known": np.ones(4000, bool), **B.build(np.arange(0, 16001, 4), cols, impacts, weights, asked)}, 91)
    best = B.Best(10)
    scored = seg.answer(columns, weights[columns], best)
    scores = seg.table[:, columns].astype(np.int64) @ weights[columns]
    order = np.lexsort((np.arange(4000), -scores))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist() and scored < 2000


def test_search_against_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").repartition(3), spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    want = brute(*pairs, 50)
    assert rows_of(B.search(docs, items)) == want
    monkeypatch.setattr(B, "MAX_TERMS", 150)  # several groups, folded coordinates and small segments
    monkeypatch.setattr(B, "CELLS", 20_000)
    monkeypatch.setattr(B, "BLOCK", 8)
    assert rows_of(B.search(docs, items)) == want


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "alpha beta"), (4, "Alpha beta"), (4, "Alpha beta"), (5, "ÄLPHA älpha"), (6, "gamma " * 30_000), (7, "beta")]
    docs += [(10 + k, "same words here") for k in range(60)]
    items = [(1, "ALPHA alpha beta"), (1, "ALPHA alpha beta"), (2, None), (3, "?!"), (4, "nowhere"), (None, "gamma"), (5, "same")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score int, rank int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, query int")
    assert rows_of(B.search(d, i)) == brute(docs, items, 50)
    assert rows_of(B.search(d, i, 3)) == brute(docs, items, 3)
    assert B.search(d.limit(0), i).collect() == [] and B.search(d, i.limit(0)).collect() == []
