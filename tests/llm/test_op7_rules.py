import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    inside = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


TEXT = st.text(alphabet=st.sampled_from("ab é#*&|\n\t\x0b\x0c\r\x1c\xa0 😀"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
def test_statistics_against_brute_force(texts):
    got = rules._row_stats(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert tuple(int(c[k]) for c in got[:5]) == brute(t)


def test_window_keys_are_exact_beyond_the_packed_range():
    rng = np.random.default_rng(1)
    codes, row = rng.integers(0, 3, 300), np.sort(rng.integers(0, 5, 300))
    small, large = rules._window_keys(codes, row, 3), rules._window_keys(codes, row, 2**22)
    same = lambda k: k[:, None] == k[None, :]
    assert (same(small) == same(large)).all()


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rules.classify(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [r for r in got if r.doc_id in quality and not r.base_failed]
    assert sum(r.kept == (quality[r.doc_id] == 1) for r in judged) >= 0.97 * len(judged)


def test_learner_finds_planted_rules():
    rng = np.random.default_rng(2)
    x = {f: rng.uniform(0, 1, 3000) for f in rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["n_words"] > 0.7) & (x["mean_word"] <= 0.2))
    found = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= rules._covered(r.tests, x, 3000)
    assert (hit == bad).mean() > 0.97 and 2 <= len(found) <= 8


def test_learner_keeps_everything_without_signal():
    rng = np.random.default_rng(3)
    x = {f: rng.uniform(0, 1, 2000) for f in rules.FEATURES}
    assert rules.learn(x, rng.uniform(size=2000) < 0.1) == []
    assert rules.learn(x, np.zeros(2000, bool)) == [] and rules.learn({f: v[:0] for f, v in x.items()}, np.zeros(0, bool)) == []


def test_decision_is_ordered(spark):
    t = rules.Test
    list_ = [rules.Rule((t("n_words", True, 10.0), t("n_symbols", True, 0.5)), 1.0, 9), rules.Rule((t("n_words", True, 5.0),), 1.0, 9)]
    df = spark.createDataFrame([(11, 1), (11, 0), (6, 9), (5, 9)], "n_words long, n_symbols long")
    verdict, number = rules.decision(list_)
    assert [tuple(r) for r in df.select(verdict, number).collect()] == [(False, 1), (False, 2), (False, 2), (True, 0)]
    verdict, number = rules.decision([])
    assert [tuple(r) for r in df.select(verdict, number).collect()] == [(True, 0)] * 4


def test_edges(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    good = " ".join(word() for _ in range(80))
    long = " ".join(word() for _ in range(60000))
    data = [(1, None), (2, ""), (None, good), (3, good), (3, good), (4, long), (5, "a b c " * 100), (6, "x\n" * 60)]
    schema = "doc_id long, text string, n_words string, _extra int, base_failed int, kept int"
    docs = spark.createDataFrame([(*d, "z", 1, 2, 3) for d in data], schema)
    none = spark.createDataFrame([(None, 0), (3, None)], "doc_id long, quality int")
    got = sorted(rules.classify(docs, none).collect(), key=lambda r: (r.n_words, r.doc_id or 0))
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((d or 0, *brute(t)) for d, t in data)
    assert {r.doc_id for r in got if r.kept} == {None, 3, 4}
    kept = rules.passing(docs, [])
    assert kept.columns == docs.columns and kept.count() == 4
    assert rules.classify(docs.limit(0), none).collect() == []
