import json
import os

import numpy as np
import pytest
from helpers import traces
from pyspark.sql import functions as F

from ridgeline.operators import metrics, topology
from ridgeline.plans import contrasts, gates, surface_graph
from ridgeline.sources import dat, tables

# One value per cell, chosen apart by powers so that every contrast has its own value.
VALUES = {
    "RL-SCAN": 0.5, "Q-SCAN": 3.25, "ORACLE-REF": 21.0, "ORACLE-QUAL": 19.5,
    "RL-REF": 7.0, "RL-QUAL": 4.0, "Q-REF": 12.5, "Q-QUAL": 1.25,
}
EXPECTED = {
    "scanner_only_effect": 3.25 - 0.5, "oracle_workflow_effect": 19.5 - 21.0, "scanner_effect_ref": 12.5 - 7.0, "scanner_effect_qual": 1.25 - 4.0,
    "workflow_effect_rl": 4.0 - 7.0, "workflow_effect_q": 1.25 - 12.5, "end_to_end_delta": 1.25 - 7.0, "scanner_main_effect": (5.5 - 2.75) / 2,
    "workflow_main_effect": (-3.0 - 11.25) / 2, "scanner_workflow_interaction": -2.75 - 5.5,
}
_ROW = "case_id string, trial_id string, seed long, stage string, selection string, metric string, cell_label string, unit string, direction string, value double"


def rows(spark, values=VALUES, direction="lower"):
    return spark.createDataFrame(
        [("c", "t", None, "skin", "all", "m", cell, "u", direction, v) for cell, v in values.items()], _ROW
    )


def test_contrasts_with_hand_computed_values(spark):
    got = {r["contrast_name"]: r for r in contrasts.paired_contrasts(rows(spark)).collect()}
    assert {k: r["raw_value"] for k, r in got.items()} == EXPECTED
    assert got["end_to_end_delta"]["improvement_value"] == 5.75


def test_missing_cell_is_an_error(spark):
    part = {k: v for k, v in VALUES.items() if k != "Q-QUAL"}
    with pytest.raises(Exception, match="missing required cell"):
        contrasts.paired_contrasts(rows(spark, part)).collect()


def test_single_trial_has_zero_spread(spark):
    r = contrasts.aggregate_metrics(rows(spark, {"Q-REF": 6.0})).first()
    assert (r["n"], r["mean"], r["median"], r["std"], r["q25"], r["q75"]) == (1, 6.0, 6.0, 0.0, 6.0, 6.0)


def test_incomplete_group_is_reported(spark):
    df = spark.createDataFrame(
        [("c", "t1", 1, "A"), ("c", "t2", 2, "A"), ("c", "t1", 1, "B")], "case_id string, trial_id string, seed long, cell_label string"
    )
    assert [r["cell_label"] for r in contrasts.incomplete_groups(df, ["case_id", "cell_label"]).collect()] == ["B"]


_METRICS = [
    "skin_buffered_f1_r2", "fvt_positive_buffered_f1_r2", "skin_distance_p95", "fvt_positive_distance_p95", "skin_count",
    "skin_cell_count", "fvt_positive_candidate_count", "skin_over_merge_count", "skin_over_split_count",
]


def summary(spark, case, pipeline="scanner", backend="quality", **changes):
    base = dict(zip(_METRICS, (0.95, 0.95, 1.0, 1.0, 1.0, 100.0, 100.0, 0.0, 0.0)))
    base.update(changes)
    keys = {"case_id": case, "pipeline": pipeline, "input_mode": "x", "workflow_mode": "quality", "scanner_backend": backend,
            "scanner_refinement_factor": "2", "shape_n3": "49", "shape_n2": "49", "shape_n1": "49"}
    cols = [F.lit(v).alias(k) for k, v in {**keys, **base}.items()]
    return spark.range(1).select(*cols, F.lit(bool(changes.get("replaced"))).alias("skin_fallback_replaced_primary"))


def compared(spark, pairs):
    b = c = None
    for left, right in pairs:
        b = left if b is None else b.unionByName(left, allowMissingColumns=True)
        c = right if c is None else c.unionByName(right, allowMissingColumns=True)
    return gates.compare(b, c, [*_METRICS, "skin_fallback_replaced_primary"])


def all_rows(spark, without=(), backend="quality"):
    pairs = []
    for case in gates.ALL_CASES:
        for pipeline in ("scanner", "oracle"):
            if (pipeline, case) not in without:
                pairs.append((summary(spark, case, pipeline, backend), summary(spark, case, pipeline, backend)))
    return compared(spark, pairs)


def test_gate_passes_unchanged_rows_of_all_cases(spark):
    r = gates.gate_verdict(all_rows(spark)).first()
    assert r["passed"] and r["missing_count"] == 0


def test_gate_needs_every_required_row(spark):
    lone = compared(spark, [(summary(spark, "boundary_plane"), summary(spark, "boundary_plane"))])
    assert not gates.gate_verdict(lone).first()["passed"]
    gone = all_rows(spark, without={("oracle", "crossing_planes")})
    assert {r["reason"] for r in gates.coverage(gone).collect()} == {"missing required gate coverage: oracle_49 crossing_planes"}
    other = all_rows(spark, backend="reference-like")
    assert not gates.gate_verdict(other).first()["passed"]
    assert gates.gate_verdict(other, gates.SCANNER_BOUNDARY_REFERENCE_LIKE).first()["passed"]


def test_unchanged_oracle_looks_at_every_metric(spark):
    c = compared(spark, [(summary(spark, "boundary_plane", "oracle", "reference-like"), summary(spark, "boundary_plane", "oracle", "reference-like", skin_count=2.0))])
    got = {r["reason"] for r in gates.gate_reasons(c, gates.SCANNER_BOUNDARY_REFERENCE_LIKE).collect()}
    assert got == {"oracle regression: skin_count"}


def test_gate_needs_the_boundary_row(spark):
    c = compared(spark, [(summary(spark, "curved_surface"), summary(spark, "curved_surface"))])
    assert not gates.gate_verdict(c).first()["passed"]


def test_gate_lists_reasons(spark):
    c = compared(
        spark,
        [
            (summary(spark, "boundary_plane"), summary(spark, "boundary_plane", skin_buffered_f1_r2=0.5, skin_count=9.0)),
            (summary(spark, "parallel_planes"), summary(spark, "parallel_planes", skin_over_merge_count=1.0)),
            (summary(spark, "curved_surface", "oracle"), summary(spark, "curved_surface", "oracle", skin_distance_p95=9.0)),
        ],
    )
    got = {r["reason"] for r in gates.gate_reasons(c).collect()}
    assert got == {
        "skin_buffered_f1_r2 below 0.90", "skin_count above 3",
        "parallel/crossing topology regression: parallel_planes skin_over_merge_count", "oracle regression: skin_distance_p95",
    }


def test_unmatched_rows_are_reported_on_their_side(spark):
    c = gates.compare(summary(spark, "a"), summary(spark, "b"), _METRICS)
    assert {(r["case_id"], r["status"]) for r in c.collect()} == {("a", "missing_candidate"), ("b", "missing_baseline")}


def masks(spark, a, b):
    mk = lambda s: spark.createDataFrame(s, "i3 int, i2 int, i1 int")
    return mk(a), mk(b)


def test_empty_masks_score_zero(spark):
    c, t = masks(spark, [], [])
    r = metrics.buffered_overlap(c, t, 2.0).first()
    assert (r["candidate_count"], r["f1"], r["jaccard"], r["buffered_f1"]) == (0, 0.0, 0.0, 0.0)


def test_one_empty_mask_is_a_diagonal_away(spark):
    c, t = masks(spark, [], [(0, 0, 0)])
    shape = spark.createDataFrame([(4, 4, 4)], "n3 int, n2 int, n1 int")
    r = metrics.surface_distance(c, t, shape).first()
    assert np.isclose(r["hausdorff_p95"], np.sqrt(27.0)) and np.isclose(r["candidate_to_truth_mean"], np.sqrt(27.0))
    assert metrics.surface_distance(c, t, shape, empty_as_null=True).first()["candidate_to_truth_mean"] is None
    none, also = masks(spark, [], [])
    assert metrics.surface_distance(none, also, shape).first()["hausdorff_p95"] == 0.0


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert metrics.normalized_correlation(df, "a", "b").first()["correlation"] == 0.0


def test_overlap_counts_are_consistent(spark):
    c, t = masks(spark, [(0, 0, 0), (0, 0, 5)], [(0, 0, 1), (0, 0, 0)])
    assert contrasts.overlap_violations(metrics.buffered_overlap(c, t, 1.0)).count() == 0


def test_links_by_position_are_reciprocal(spark):
    cells = spark.createDataFrame([(10 * v + w, 1, v, w) for v in range(3) for w in range(3)], "cell_id long, skin_id int, v int, w int")
    r = topology.link_topology(topology.link_by_position(cells)).first()
    assert (r["reciprocal_link_violation_count"], r["quad_closure_match_count"], r["isolated_cell_count"]) == (0, 4, 0)


def test_graph_contract(spark):
    n = spark.createDataFrame(
        [(0, 1.0, 1.0, 1.0, 10.0, 45.0, None, -1, 1, -1, -1), (1, 1.0, float("nan"), 1.0, 360.0, 0.0, 2.0, -1, 7, -1, -1)],
        "node_id long, x1 double, x2 double, x3 double, strike_deg double, dip_deg double, cell_support_weight double,"
        " ca_index long, cb_index long, cl_index long, cr_index long",
    )
    assert {r["rule"] for r in surface_graph.node_violations(n).collect()} == {"nonfinite_position", "strike_range", "dip_range", "support_range"}
    assert {(r["node_id"], r["rule"]) for r in surface_graph.link_violations(n).collect()} == {(0, "one_way_link"), (1, "dangling_link")}


@pytest.mark.parametrize("endian", ["big", "little"])
def test_dat_round_trip_and_pruning(spark, tmp_path, endian):
    a = np.random.default_rng(1).random((7, 4, 5)).astype(np.float32)
    path = str(tmp_path / "v.dat")
    dat.write_dat(traces(spark, v=a), path, a.shape, "v", endian)
    raw = np.fromfile(path, ">f4" if endian == "big" else "<f4").reshape(a.shape)
    assert np.array_equal(raw.astype(np.float32), a)
    df = dat.read_dat(spark, path, a.shape, endian, slab_depth=2)
    assert df.count() == 28
    part = df.where("i3 >= 2 and i3 < 4")
    assert part.count() == 8 and part.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="bytes"):
        dat.read_dat(spark, path, (7, 4, 6), endian).count()


def test_skins_document_round_trip(spark):
    cell = {"x1": 1.5, "x2": 2.0, "x3": 3.0, "i1": 2, "i2": 2, "i3": 3, "fl": 0.5, "fp": 10.0, "ft": 80.0, "generation": "grown", "reskin_support": None}
    doc = {"format_version": 2, "skinning_enabled": True, "skin_count": 1, "skins": [{"skin_index": 0, "cell_count": 1, "cells": [cell]}]}
    cells = tables.parse_skins(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert cells.first()["fl"] == 0.5
    rec = json.loads(tables.skin_records(cells).first()["cell"])
    assert rec["x1"] == 1.5 and rec["generation"] == "grown"


def test_stage_is_written_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.stage(spark, str(tmp_path), "s", {"a": 1}, build).count() == 3
    assert len(calls) == 1
    assert tables.stage(spark, str(tmp_path), "s", {"a": 2}, build).count() == 3 and len(calls) == 2
    assert len(os.listdir(tmp_path)) == 2


def test_manifest_of_a_folder(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    r = dat.file_records(spark, str(tmp_path)).first()
    assert (r["name"], r["bytes"], r["sha256"]) == ("f.bin", 3, hashlib.sha256(b"abc").hexdigest())


def skin_document(**changes):
    cell = {"x1": 1.0, "x2": 2.0, "x3": 3.0, "i1": 1, "i2": 2, "i3": 3, "fl": 0.5, "fp": 0.0, "ft": 0.0, "generation": "grown", "reskin_support": None}
    cell.update(changes.pop("cell", {}))
    doc = {"format_version": 2, "skinning_enabled": True, "skin_count": 1, "skins": [{"skin_index": 0, "cell_count": 1, "cells": [cell]}]}
    return json.dumps({**doc, **changes})


def parse(spark, text, **options):
    return tables.parse_skins(spark.createDataFrame([(text,)], "value string"), **options).collect()


def test_both_versions_of_skin_documents(spark):
    assert parse(spark, skin_document())[0]["generation"] == "grown"
    old = json.loads(skin_document(format_version=1))
    for name in ("generation", "reskin_support"):
        del old["skins"][0]["cells"][0][name]
    assert parse(spark, json.dumps(old))[0]["generation"] is None


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("no json", "format version"), (None, "format version"), (skin_document(format_version=3), "format version"), (skin_document(skinning_enabled=False), "skinning_enabled"),
        (skin_document(skin_count=2), "skin_count"), (skin_document(skins=[{"skin_index": 1, "cell_count": 1, "cells": []}]), "skin_index"),
        (skin_document(skins=[{"skin_index": 0, "cell_count": 0, "cells": []}]), "cell_count"), (skin_document(cell={"generation": "odd"}), "generation"),
        (skin_document(cell={"reskin_support": 0.5}), "reskin_support"), (skin_document(cell={"fl": None}), "lacks a value"),
        (skin_document(cell={"generation": "dense_reskin_observed", "reskin_support": 2.0}), "reskin_support"),
    ],
)
def test_faulty_skin_documents_are_errors(spark, text, reason):
    with pytest.raises(Exception, match=reason):
        parse(spark, text)


def test_skin_cells_outside_the_volume_are_errors(spark):
    with pytest.raises(Exception, match="outside"):
        parse(spark, skin_document(), shape=(3, 9, 9))
    assert parse(spark, skin_document(), shape=(4, 9, 9))


def test_volume_files_by_uri_and_faults(spark, tmp_path):
    a = np.arange(5 * 3 * 4, dtype=np.float32).reshape(5, 3, 4)
    uri = f"file://{tmp_path}/deep/v.dat"
    dat.write_dat(traces(spark, v=a).repartition(3), uri, a.shape, "v", slab_depth=2)
    assert (tmp_path / "deep" / "v.dat").read_bytes() == a.astype(">f4").tobytes()
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["v.dat"]
    rows = dat.read_dat(spark, uri, a.shape, slab_depth=3).collect()
    assert all(r["trace"] == a[r["i3"], r["i2"]].tolist() for r in rows) and len(rows) == 15
    with pytest.raises(Exception, match="no regular file"):
        dat.read_dat(spark, str(tmp_path), a.shape).count()
    gap = traces(spark, v=a).where("not (i3 = 2 and i2 = 1)")
    with pytest.raises(Exception, match="dense"):
        dat.write_dat(gap, f"{tmp_path}/gap.dat", a.shape, "v")
    with pytest.raises(Exception, match="needs"):
        dat.write_dat(traces(spark, v=a[:4]), f"{tmp_path}/short.dat", a.shape, "v")


def test_catalogued_files(spark, tmp_path):
    path, shape = tables.dataset_file("f3d2d", "el.dat", f"{tmp_path}/")
    assert (path, shape) == (f"{tmp_path}/data/2d/f3d2d/el.dat", (1, 440, 222))
    image = np.random.default_rng(1).random((1, 440, 222), np.float32)
    dat.write_dat(traces(spark, v=image), path, shape, "v")
    r = tables.read_dataset(spark, "f3d2d", "el.dat", str(tmp_path)).where("i2 = 7").first()
    assert r["trace"] == image[0, 7].tolist()
    with pytest.raises(ValueError, match="unknown file"):
        tables.dataset_file("f3d", "el.dat", "x")
    with pytest.raises(KeyError):
        tables.dataset_file("other", "el.dat", "x")


def test_bundles_are_checked_against_their_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    parts = {"cells": spark.range(10).toDF("x"), "none": spark.range(0).toDF("y")}
    tables.write_bundle(spark, folder, parts, {"a": 1})
    assert {(r["name"], r["rows"], r["sound"]) for r in tables.check_bundle(spark, folder).collect()} == {("cells", 10, True), ("none", 0, True)}
    spark.range(1, 11).toDF("x").write.mode("overwrite").parquet(f"{folder}/cells")
    assert {(r["name"], r["sound"]) for r in tables.check_bundle(spark, folder).collect()} == {("cells", False), ("none", True)}


def test_canonical_order(spark):
    df = spark.createDataFrame([("b", 2), ("z", 1), ("a", 1), ("b", 1)], "case_id string, seed int")
    got = [tuple(r) for r in tables.canonical_order(df, {"case_id": ["b", "a"]}, "seed").collect()]
    assert got == [("b", 1), ("b", 2), ("a", 1), ("z", 1)]


def test_other_inputs_make_another_stage(spark, tmp_path):
    one, two = spark.range(3), spark.range(4)
    for df, n in ((one, 3), (two, 4), (one, 3)):
        key = {"in": tables.table_fingerprint(df)}
        assert tables.stage(spark, str(tmp_path), "s", {"a": 1}, lambda df=df: df, key).count() == n
