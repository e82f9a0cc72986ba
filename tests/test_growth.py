"""Work that must not grow faster than the input, and results that must be whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.grid import Tiling
from ridgeline.operators import components, topology
from ridgeline.operators import seeds as S
from ridgeline.operators.quantiles import grouped_quantiles

XYZ = ["i3", "i2", "i1"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_volume_whose_last_slice_is_not_full_makes_the_round_trip(spark, tmp_path):
    from __spark_entry__ import queries

    v = [(k, [float(k), -0.5 * k, 0.25]) for k in range(28)] + [(28, None)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.i3, r.i2, r.i1): r.v for r in queries()["dat_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {(k // 25, k % 25, i): x for k, t in v[:-1] for i, x in enumerate(t)}


def test_quantiles_do_not_broadcast_the_values(spark):
    # 40,000 distinct values a group, far below the broadcast limit of the session
    df = spark.range(80_000).select((F.col("id") % 2).alias("g"), F.sqrt(F.col("id") + 1.0).alias("x"))
    q = grouped_quantiles(df, ["g"], "x", {"p": 0.95})
    got = {r.g: r.p for r in q.collect()}
    x = np.sqrt(np.arange(80_000) + 1.0)
    assert got == pytest.approx({g: np.quantile(x[g::2], 0.95) for g in (0, 1)})
    assert "BroadcastHashJoin" not in plan_of(q) and "ShuffledHashJoin" in plan_of(q)


@pytest.mark.parametrize("slices", [64, 512])
def test_rounds_of_a_plateau_do_not_follow_its_length(spark, slices, monkeypatch):
    calls = []
    halo = S.with_halo
    monkeypatch.setattr(S, "with_halo", lambda *a, **k: (calls.append(1), halo(*a, **k))[1])
    i = F.col("id")
    c = spark.range(slices * 9).select(
        F.floor(i / 9).cast("int").alias("i3"), F.floor(i % 9 / 3).cast("int").alias("i2"), (i % 3).cast("int").alias("i1"),
        i.alias("flat"), F.lit(1.0).alias("score"),
    )
    got = sorted(tuple(r) for r in S.pick_seeds(c, 2, True, Tiling(16, 16)).select(*XYZ).collect())
    assert got == sorted((k, 2, 2) for k in range(slices - 1, -1, -3))
    assert len(calls) <= 1 + np.log2(slices / 16)


def test_settled_rows_are_those_of_the_greedy_choice():
    import pandas as pd

    rng = np.random.default_rng(3)
    pos = rng.permutation(np.stack(np.unravel_index(np.arange(9 * 8 * 7), (9, 8, 7)), 1))[:300]
    pdf = pd.DataFrame(pos, columns=XYZ).assign(flat=np.arange(300), score=rng.integers(0, 5, 300), score2=0.0, fixed=0)
    want, taken = set(), []
    for r in pdf.sort_values(["score", "flat"], ascending=False).itertuples():
        if all(max(abs(r.i3 - a), abs(r.i2 - b), abs(r.i1 - c)) > 2 for a, b, c in taken):
            taken.append((r.i3, r.i2, r.i1))
            want.add(r.flat)
    everywhere = ((-np.inf, np.inf), (-np.inf, np.inf))
    state = S.settle(pdf, 2, True, everywhere)
    assert set(np.flatnonzero(state == 1)) == want and not (state == 0).any()


def test_nodes_without_an_edge_stay_out_of_the_rounds(spark, monkeypatch):
    stored = []
    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda d: (lambda x: (stored.append(x.count()), x)[1])(cut(d)))
    nodes = spark.range(500)
    edges = spark.createDataFrame([(3, 4), (4, 5), (90, 7)], "a long, b long")
    got = {r.id: r.label for r in components.label_graph(nodes, edges).collect()}
    assert got == {k: {4: 3, 5: 3, 90: 7}.get(k, k) for k in range(500)}
    assert max(stored) <= 6


def test_link_topology_looks_links_up_once_and_counts_repeated_cells(spark):
    rows = [  # a square of four cells, one link without a way back, a cell that comes twice, one that stands alone
        (1, 1, None, 2, None, 3), (2, 1, 1, None, None, 4), (3, 1, None, 4, 1, None), (4, 2, 3, None, 2, 1),
        (5, 1, None, 1, None, None), (5, 1, None, 1, None, None), (6, 1, None, None, None, None), (7, 1, 7, None, None, 99),
        (None, 1, None, 1, None, 1),
    ]
    cells = spark.createDataFrame(rows, "cell_id long, skin_id long, ca_id long, cb_id long, cl_id long, cr_id long")
    out = topology.link_topology(cells)
    links = [(r[0], r[1], k, r[2 + k]) for r in rows for k in range(4) if r[2 + k] is not None]
    rev, owners = (1, 0, 3, 2), lambda c: [r for r in rows if r[0] is not None and r[0] == c]
    want = [0] * 7
    touched = set()
    for c, s, k, o in links:
        mine = owners(o)
        back = sum(c is not None and m[2 + rev[k]] == c for m in mine)
        want[0] += max(1, len(mine)) if not back else 0
        want[1] += max(1, back) * (sum(m[1] != s for m in mine) if mine else 1)
        want[2] += max(1, back) * max(1, len(mine)) if c == o else 0
        touched |= {c, o} if mine else set()
    for c in {r[0] for r in rows} - {None}:
        far = lambda a, b: [m[b] for r in rows if r[0] == c and r[a] is not None for m in owners(r[a]) if m[b] is not None]  # noqa: E731, B023
        pairs = [x == y for x in far(5, 3) for y in far(3, 5)]
        want[3], want[4], want[5] = want[3] + len(pairs), want[4] + sum(pairs), want[5] + len(pairs) - sum(pairs)
    want[6] = sum(r[0] is None or r[0] not in touched for r in rows)
    assert list(out.first()) == want
    assert plan_of(out).count("SortMergeJoin") == 0


def test_columns_of_a_case_are_computed_once(spark):
    from ridgeline.sources.cases import case_columns, range_grid

    c = case_columns(range_grid(spark, (3, 4, 5)), "crossing_planes")
    plan = c.select((F.col("ft") + F.col("truth_strike") + F.col("truth_dip")).alias("x")).where("x > 0")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("EXP(") <= 2


def test_the_scan_of_an_image_is_stored_for_its_seeds(spark, tmp_path):
    from driver_queries.scans import seeds_2d

    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=24)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    scan, _ = seeds_2d(spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in plan_of(scan)


def test_distances_are_no_wider_than_the_traces(spark, monkeypatch):
    from ridgeline.operators import distance as D

    p = spark.createDataFrame([(0, 0, 3), (1, 1, 40)], "i3 int, i2 int, i1 int")
    t = spark.createDataFrame([(0, 1, 2), (2, 0, 19)], "i3 int, i2 int, i1 int")
    wide = []
    floor = F.floor
    monkeypatch.setattr(D.F, "floor", lambda x: (wide.append(x._jc.toString() if hasattr(x, "_jc") else str(x)), floor(x))[1])
    got = {(r.i3, r.i2, r.i1): r.d2 for r in D.nearest_distance(p, t, 2).collect()}
    assert got == {(0, 0, 3): 2, (1, 1, 40): 443}
    assert all("20" in w for w in wide)
