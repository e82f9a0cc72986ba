import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import runs


def brute(words, length=6, exponent=4):
    """Every maximal stretch of each period, kept where no smaller period holds."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(length, exponent * q) and not any(all(words[k] == words[k - r] for k in range(s + r, e)) for r in range(1, q)):
                out.append((s, e - s, q))
            s = e - q + 1
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def tiled(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.sampled_from([(6, 4), (4, 2), (2, 2), (9, 3)]))
def test_random_words(rows, rule):
    codes = np.array([c for r in rows for c in r], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    assert runs.runs_of(codes, offsets, *rule) == [brute(r, *rule) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_planted_powers(parts):
    row = [c for root, times in parts for c in root * times]
    assert runs.runs_of(np.array(row, np.int64), np.array([0, len(row)])) == [brute(row)]


def want(doc_id, text):
    words = tiled(doc_id, text)
    found = brute(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 6000").repartition(4)
    got = runs.digest(runs.detect(runs.planted(docs)))
    expected = sorted((want(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert rows_of(got) == expected and sum(r[1] > 0 for r in expected) > 20


def test_edges(spark):
    unary, long = "a " * 30_000, " ".join(f"w{k % 7}" for k in range(20_000))
    data = [(1, None), (2, ""), (3, " \t\n"), (None, "x x x x x x"), (4, unary), (5, long), (6, "a b"), (6, "a b"), (7, "é é é é " * 3), (8, "x x x x x")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in data], "doc_id long, text string, runs int, collapsed string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in runs.detect(docs).collect()}
    assert got[(None, "x")] == [(0, 6, 1)] and got[(4, "a")] == [(0, 30_000, 1)] and got[(8, "x x x x x")] == []
    assert got[(5, "w0 w1 w2 w3 w4 w5 w6")] == [(0, 20_000, 7)] and got[(1, "")] == got[(2, "")] == got[(3, "")] == []
    assert got[(7, "é é")] == [(0, 6, 1)]
    out = runs.digest(runs.detect(runs.planted(docs)))
    small = [r for r in data if len(r[1] or "") < 100]
    assert sorted((r for r in rows_of(out) if r[0] not in (4, 5)), key=str) == sorted((want(*r) for r in small), key=str)
    assert runs.digest(runs.detect(runs.planted(docs.limit(0)))).collect() == []
