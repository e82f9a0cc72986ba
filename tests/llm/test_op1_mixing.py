from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import mixing
from ridgeline.llm.queries import LANG_WEIGHTS


def shares(rows, dim, weight):
    out = defaultdict(float)
    for r in rows:
        out[r[dim]] += weight(r)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_marginals_reach_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.sample_rates(docs, LANG_WEIGHTS).collect()
    assert len(rows) == docs.count()
    expected = lambda r: r.n_tokens * r.rate
    lang = shares(rows, "lang", expected)
    named = sum(v for k, v in LANG_WEIGHTS.items() if k)
    for k, v in lang.items():
        assert v == pytest.approx(LANG_WEIGHTS[k] / named, abs=1e-4)
    for dim, power in (("source", 0.5), ("topic", 0.7)):
        plain = shares(rows, dim, lambda r: r.n_tokens)
        raised = {k: v**power for k, v in plain.items()}
        got = shares(rows, dim, expected)
        for k, v in got.items():
            assert v == pytest.approx(raised[k] / sum(raised.values()), abs=1e-4)
    assert sum(map(expected, rows)) == pytest.approx(sum(r.n_tokens for r in rows), rel=1e-4)
    assert sum(r.n_tokens * r.copies for r in rows) == pytest.approx(sum(map(expected, rows)), rel=0.03)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)


def test_raking_against_plain_fitting(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(1, 1000, (4, 3, 2))
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(t[i, j, k])) for i, j, k in np.ndindex(t.shape)], "source string, lang string, topic string, tokens long")
    aims = [rng.dirichlet(np.ones(n)) for n in t.shape]
    w = t / t.sum()
    for _ in range(200):
        for axis, aim in enumerate(aims):
            now = w.sum(axis=tuple(a for a in range(3) if a != axis))
            w = w * (aim / now).reshape([-1 if a == axis else 1 for a in range(3)])
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", float(v)) for i, v in enumerate(aim)], "value string, target double") for d, aim in zip(mixing.DIMS, aims)}
    got = np.zeros(t.shape)
    for r in mixing.rake(cells, targets, rounds=30).collect():
        got[int(r.source[1:]), int(r.lang[1:]), int(r.topic[1:])] = r.tokens * r.factor
    assert np.allclose(got / got.sum(), w, atol=1e-6)


def test_capped_rates_spend_the_budget(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100, 50.0), ("b", "x", "t", 1000, 1.0), ("c", "x", "t", 1000, 0.5)], "source string, lang string, topic string, tokens long, factor double")
    got = {r.source: r.rate for r in mixing.rates(cells, 0.5, 1.0).collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx(2 * got["c"])
    assert 100 + 1000 * got["b"] + 1000 * got["c"] == pytest.approx(1050)
    assert {r.rate for r in mixing.rates(cells, 5.0, 1.0).collect()} == {1.0}


def test_capped_cells_leave_reachable_targets_alone(spark):
    # (s0, l0) is capped at once, but s0 and l0 both hold enough elsewhere; topic t1 can not reach its 0.3 of 60 %
    t = {("s0", "l0", "t0"): 60, ("s0", "l1", "t0"): 260, ("s0", "l1", "t1"): 40, ("s1", "l0", "t0"): 280, ("s1", "l1", "t0"): 300, ("s1", "l1", "t1"): 60}
    cells = spark.createDataFrame([(*k, v) for k, v in t.items()], "source string, lang string, topic string, tokens long")
    aims = {"source": {"s0": 0.5, "s1": 0.5}, "lang": {"l0": 0.4, "l1": 0.6}, "topic": {"t0": 0.7, "t1": 0.3}}
    targets = {d: spark.createDataFrame(list(a.items()), "value string, target double") for d, a in aims.items()}
    rows = mixing.rates(mixing.rake_within(cells, targets, 0.6, 1.0), 0.6, 1.0).collect()
    assert all(0 < r.rate <= 1 for r in rows)
    assert sum(r.tokens * r.rate for r in rows) == pytest.approx(600, rel=1e-3)
    aims["topic"] = {"t0": 500 / 600, "t1": 100 / 600}
    for dim, aim in aims.items():
        assert shares(rows, dim, lambda r: r.tokens * r.rate) == pytest.approx(aim, abs=2e-3)


def test_sampled_rows_are_those_of_the_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    options = {"lang_weights": LANG_WEIGHTS, "budget": 0.7, "max_rate": 1.0}
    want = {r.doc_id for r in mixing.sample_rates(docs, **options).collect() if r.copies}
    kept = mixing.sampled(docs, **options)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want) and 0 < len(ids) < docs.count()
    twice = mixing.sampled(docs, LANG_WEIGHTS, budget=2.0)
    rates = {r.doc_id: r.copies for r in mixing.sample_rates(docs, LANG_WEIGHTS, budget=2.0).collect()}
    assert twice.count() == sum(rates.values())


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (mixing.sample_rates(docs), mixing.sampled(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    data = [(1, None, None, None), (2, "", "en", "s"), (None, "a b c", "en", "s"), (3, "x " * 300_000, "de", "s"), (3, "x " * 300_000, "de", "s"), (4, "y z", "en", None)]
    docs = spark.createDataFrame([(*d, 1.0, 2) for d in data], "doc_id long, text string, lang string, source string, rate double, tokens int")
    got = mixing.sample_rates(docs, LANG_WEIGHTS).collect()
    assert len(got) == len(data) and all(r.rate is not None and r.rate >= 0 for r in got)
    assert {(r.source, r.lang) for r in got if r.doc_id == 1} == {("(none)", "(none)")}
    blank = mixing.sample_rates(docs.where("doc_id < 3"), LANG_WEIGHTS).collect()
    assert len(blank) == 2 and {r.n_tokens for r in blank} == {0}
    assert mixing.sample_rates(docs.limit(0), LANG_WEIGHTS).collect() == [] and mixing.sampled(docs.limit(0)).collect() == []
