import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import dartmin


def brute_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    out = {}
    n = max(1, len(words) - 4) if words else 0
    for k in range(n):
        s = tuple(words[k : k + 5])
        out[s] = out.get(s, 0) + 1
    return out


def brute_similarity(a, b):
    both = sum(min(a[s], b[s]) for s in a if s in b)
    total = sum(a.values()) + sum(b.values())
    return both / (total - both) if total else 0.0


def brute_classes(rows, least=0.8):
    """Least id of each component over all pairs; blank texts stand alone."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i in range(len(rows)):
        for j in {j for x in sets[i] for j in index[x] if j < i}:
            if brute_similarity(sets[i], sets[j]) >= least:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {(rows[i][0], min(groups[find(i)])) for i in range(len(rows))}


def test_similarity_of_sets():
    texts = ["a b c d e f g a b c d e", "a b c d e f g x", "a b", "", "A B"]
    sets = dartmin._sets(pa.array([*texts, None]))
    for i, a in enumerate([*texts, None]):
        for j, b in enumerate([*texts, None]):
            assert dartmin.similarity(sets[i], sets[j]) == pytest.approx(brute_similarity(brute_set(a), brute_set(b)))


@pytest.mark.parametrize("size", [3, 40, 900])
def test_signature_estimates_weighted_similarity(size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64)
    w1, w2 = rng.integers(1, 4, size).astype(float), rng.uniform(0.2, 3.0, size)
    a, b = (ids[:size], w1), (ids[size // 3 : size // 3 + size], w2)
    weight = {i: [x, 0.0] for i, x in zip(a[0].tolist(), w1)}
    for i, x in zip(b[0].tolist(), w2):
        weight.setdefault(i, [0.0, 0.0])[1] = x
    true = sum(min(v) for v in weight.values()) / sum(max(v) for v in weight.values())
    k = 4096
    est = (dartmin.signature(*a, k) == dartmin.signature(*b, k)).mean()
    assert est == pytest.approx(true, abs=4 * (0.25 / k) ** 0.5 + 0.005)
    assert (dartmin.signature(*a, 64) == dartmin.signature(a[0][::-1].copy(), w1[::-1].copy(), 64)).all()


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(30):  # a shared passage alone makes no copy
        rows.append((n, " ".join([*passage, *[word() for _ in range(60)]])))
        n += 1
    base = [word() for _ in range(150)]
    for _ in range(60):  # one large group in which not every pair is similar
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    return rows


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got = dartmin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == brute_classes(rows)
    firsts = [r.class_id for r in got if r.is_first]
    assert sorted(firsts) == sorted({r.class_id for r in got})


def test_one_star_round_leaves_the_rest_to_the_last_step(spark):
    rows = corpus(8)
    got = dartmin.classes(spark.createDataFrame(rows, "doc_id long, text string"), stars=1).collect()
    assert {(r.doc_id, r.class_id) for r in got} == brute_classes(rows)


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.class_id) for r in dartmin.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 9000}" for i in range(50000))
    data = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "One  two"), (None, "one two"), (8, "one two"), (3, long), (4, long + " x"), (11, "p q r s t u")]
    schema = "doc_id long, text string, tkey int, bands string, row long, label string, bucket int, n int"
    docs = spark.createDataFrame([(*d, 1, "x", 2, "y", 3, 4) for d in data], schema)
    got = dartmin.classes(docs).collect()
    assert len(got) == len(data)
    assert {(r.doc_id, r.class_id) for r in got} == {(5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (None, 8), (3, 3), (4, 3), (11, 11)}
    assert sum(r.is_first for r in got) == 6
    kept = dartmin.firsts(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8, 11]
    assert dartmin.classes(docs.limit(0)).collect() == [] and dartmin.firsts(docs.limit(0)).collect() == []


def test_components_of_long_chains(spark):
    edges = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(60)] + [(b"9001", b"9000"), (b"9001", b"9001")]
    got = {bytes(r.node): bytes(r.label) for r in dartmin.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {**{f"{i:04d}".encode(): b"0000" for i in range(61)}, b"9000": b"9000", b"9001": b"9000"}
