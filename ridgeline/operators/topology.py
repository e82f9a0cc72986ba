"""Skins as tables of cells: sizes, truth components, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.angles import nearest_index
from ridgeline.functions.scores import ratio
from ridgeline.session import cut_lineage

XYZ = ["i3", "i2", "i1"]


def rounded(cells: DataFrame) -> DataFrame:
    """Add the voxel index of each cell position."""
    return cells.withColumns({f"i{k}": nearest_index(f"x{k}") for k in (1, 2, 3)})


def rasterize(cells: DataFrame) -> DataFrame:
    """The set of voxels touched by any cell."""
    return cells.select(*XYZ).distinct()


def skin_topology(cells: DataFrame, small_size: int = 10) -> DataFrame:
    """Sizes, duplicates, and the share of the largest and of small skins (columns skin_id, i3, i2, i1).

    Grouped by (skin, voxel) first, so one huge skin is spread over many tasks.
    """
    per_voxel = cells.groupBy("skin_id", *XYZ).agg(F.count(F.lit(1)).alias("n"))
    sizes = per_voxel.groupBy("skin_id").agg(F.sum("n").alias("n"))
    unique = per_voxel.select(*XYZ).distinct().agg(F.count(F.lit(1)).alias("u")).select("u").scalar()
    s = sizes.agg(
        F.count(F.lit(1)).alias("skin_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("cell_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_skin_size"),
        F.count_if(F.col("n") < small_size).alias("small_skin_count"),
        F.coalesce(F.sum(F.when(F.col("n") < small_size, F.col("n"))), F.lit(0)).alias("small_skin_cell_count"),
    ).withColumn("unique_cell_count", unique)
    return s.withColumns(
        {
            "duplicate_cell_count": F.col("cell_count") - F.col("unique_cell_count"),
            "largest_skin_fraction": ratio("largest_skin_size", "cell_count"),
            "small_skin_cell_fraction": ratio("small_skin_cell_count", "cell_count"),
        }
    )


def _pair_counts(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """(skin_id, truth_id) -> cells, distinct voxels.  truth: i3, i2, i1, truth_id."""
    per_voxel = cells.groupBy("skin_id", *XYZ).agg(F.count(F.lit(1)).alias("n"))
    j = per_voxel.join(truth.where("truth_id > 0").select(*XYZ, "truth_id"), XYZ, "left")
    return j.groupBy("skin_id", F.coalesce("truth_id", F.lit(0)).alias("truth_id")).agg(
        F.sum("n").alias("cells"), F.count(F.lit(1)).alias("voxels")
    )


def skin_components(cells: DataFrame, truth: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Per skin: truth composition, dominant component and purity."""
    p = _pair_counts(cells, truth)
    total = F.sum("cells").over(Window.partitionBy("skin_id"))
    p = p.withColumn("total", total)
    hit = F.col("truth_id") > 0
    best = F.max(F.when(hit, F.struct(F.col("cells"), -F.col("truth_id"))))
    return p.groupBy("skin_id").agg(
        F.max("total").alias("cell_count"),
        F.coalesce(F.sum(F.when(hit, F.col("cells"))), F.lit(0)).alias("truth_cell_count"),
        F.count_if(hit).alias("truth_components_touching"),
        (-best["col2"]).alias("dominant_truth_id"),
        F.coalesce(best["cells"], F.lit(0)).alias("dominant_truth_cell_count"),
        ratio(F.coalesce(best["cells"], F.lit(0)), F.max("total")).alias("purity"),
        F.count_if(hit & (F.col("cells") / F.col("total") >= min_fraction)).alias("qualifying_truth_components"),
    )


def truth_components(cells: DataFrame, truth: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Per truth component: covered voxels, recall, dominant skin."""
    size = truth.where("truth_id > 0").groupBy("truth_id").agg(F.count(F.lit(1)).alias("truth_cell_count"))
    cover = cells.select(*XYZ).distinct().join(truth.where("truth_id > 0").select(*XYZ, "truth_id"), XYZ)
    covered = cover.groupBy("truth_id").agg(F.count(F.lit(1)).alias("covered_cell_count"))
    p = _pair_counts(cells, truth).where("truth_id > 0").join(size, "truth_id")
    best = F.max(F.struct(F.col("voxels"), -F.col("skin_id")))
    by_truth = p.groupBy("truth_id").agg(
        F.count(F.lit(1)).alias("skins_touching"), (-best["col2"]).alias("dominant_skin_id"),
        best["voxels"].alias("dominant_skin_cell_count"),
        F.count_if(F.col("voxels") / F.col("truth_cell_count") >= min_fraction).alias("qualifying_skins"),
    )
    out = size.join(covered, "truth_id", "left").join(by_truth, "truth_id", "left").na.fill(
        0, ["covered_cell_count", "skins_touching", "dominant_skin_cell_count", "qualifying_skins"]
    )
    return out.withColumn("recall", ratio("covered_cell_count", "truth_cell_count"))


def component_topology(cells: DataFrame, truth: DataFrame, min_fraction: float = 0.05) -> DataFrame:
    """Over-merge, over-split, purity and recall in one row."""
    s = skin_components(cells, truth, min_fraction).agg(
        F.count(F.lit(1)).alias("skin_count"),
        F.count_if(F.col("truth_cell_count") > 0).alias("skin_with_truth_count"),
        F.count_if(F.col("qualifying_truth_components") >= 2).alias("over_merge_skin_count"),
        F.coalesce(F.max("truth_components_touching"), F.lit(0)).alias("max_truth_components_per_skin"),
        F.coalesce(F.avg("purity"), F.lit(0.0)).alias("mean_skin_purity"),
        F.coalesce(F.min("purity"), F.lit(0.0)).alias("min_skin_purity"),
    )
    t = truth_components(cells, truth, min_fraction).agg(
        F.count(F.lit(1)).alias("truth_component_count"),
        F.count_if(F.col("covered_cell_count") > 0).alias("covered_truth_component_count"),
        F.count_if(F.col("qualifying_skins") >= 2).alias("over_split_truth_component_count"),
        F.coalesce(F.max("skins_touching"), F.lit(0)).alias("max_skins_per_truth_component"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_truth_component_recall"),
        F.coalesce(F.min("recall"), F.lit(0.0)).alias("min_truth_component_recall"),
    )
    return s.withColumns({c: t.select(c).scalar() for c in t.columns})


LINKS = (("ca", "cb"), ("cb", "ca"), ("cl", "cr"), ("cr", "cl"))


def link_edges(cells: DataFrame) -> DataFrame:
    """One row per non-null link: cell_id, skin_id, link, reverse, other_id."""
    links = F.array(
        *[F.struct(F.lit(a).alias("link"), F.lit(b).alias("reverse"), F.col(f"{a}_id").alias("other_id")) for a, b in LINKS]
    )
    return cells.select("cell_id", "skin_id", F.explode(links).alias("l")).select(
        "cell_id", "skin_id", "l.link", "l.reverse", "l.other_id"
    ).where(F.col("other_id").isNotNull())


def link_topology(cells: DataFrame) -> DataFrame:
    """Reciprocity, cross-skin and self links, quad closure; columns ca_id..cr_id are cell ids."""
    names = [a for a, _ in LINKS]
    # what a link leads to is looked up once, with all that is asked of it; a repeated id is one row with several owners
    owner = cells.where(F.col("cell_id").isNotNull()).groupBy(F.col("cell_id").alias("other_id")).agg(
        F.collect_list(F.struct("skin_id", *[f"{a}_id" for a in names])).alias("_o")
    )
    link = F.array(*[F.struct(F.lit(k).cast("byte").alias("link"), F.col(f"{a}_id").alias("other_id")) for k, a in enumerate(names)])
    e = cells.select("cell_id", "skin_id", F.explode(link).alias("l")).select("cell_id", "skin_id", "l.link", "l.other_id").where(F.col("other_id").isNotNull())
    j = e.join(owner.hint("shuffle_hash"), "other_id", "left")
    ways_by = lambda b: F.size(F.filter("_o", lambda x: x[f"{b}_id"] == F.col("cell_id")))
    back = F.coalesce(*[F.when(F.col("link") == k, ways_by(b)) for k, (_, b) in enumerate(LINKS)])
    # pairs of an edge with its owners and with its ways back, one at least
    j = j.withColumns({"_owners": F.when(F.col("_o").isNull(), 0).otherwise(F.size("_o")), "_back": F.when(F.col("_o").isNull(), 0).otherwise(back)})
    ways, seen = F.greatest("_back", F.lit(1)), F.greatest("_owners", F.lit(1))
    strange = F.size(F.filter("_o", lambda x: x["skin_id"].isNull() | (x["skin_id"] != F.col("skin_id"))))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    a = j.agg(
        total(F.when(F.col("_back") == 0, seen)).alias("reciprocal_link_violation_count"),
        total(ways * F.when(F.col("_owners") == 0, 1).otherwise(strange)).alias("cross_skin_link_count"),
        total(F.when(F.col("cell_id") == F.col("other_id"), ways * seen)).alias("self_link_count"),
    )
    # back at the cell: what it reaches through cr and cb, through cb and cr, and whether any link ends in a cell
    through = lambda here, then: F.when(F.col("link") == names.index(here), F.transform("_o", lambda x: x[f"{then}_id"]))
    known = F.exists("_o", lambda x: x["skin_id"].isNotNull())
    met = j.where(F.col("_owners") > 0).select("cell_id", "other_id", "link", known.alias("t"), F.coalesce(through("cr", "cb"), through("cb", "cr")).alias("far"))
    zero, one, nothing = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(None).cast(cells.schema["cb_id"].dataType)
    ends = met.select("cell_id", "link", "t", F.explode_outer("far").alias("far"))
    count = lambda name: F.when((F.col("link") == names.index(name)) & F.col("far").isNotNull(), one).otherwise(zero)
    notes = (
        cells.select("cell_id", nothing.alias("far"), one.alias("n"), F.lit(False).alias("t"), zero.alias("rb"), zero.alias("br"))
        .unionByName(ends.select("cell_id", "far", zero.alias("n"), "t", count("cr").alias("rb"), count("cb").alias("br")))
        .unionByName(met.where("t").select(F.col("other_id").alias("cell_id")).distinct().select(
            "cell_id", nothing.alias("far"), zero.alias("n"), F.lit(True).alias("t"), zero.alias("rb"), zero.alias("br")))
    )
    sums = [F.sum(c).alias(c) for c in ("n", "rb", "br")]
    by_end = notes.repartition("cell_id").groupBy("cell_id", "far").agg(*sums, F.max("t").alias("t"))
    per = by_end.groupBy("cell_id").agg(*sums, F.max("t").alias("t"), F.sum(F.col("rb") * F.col("br")).alias("m"))
    some = F.col("cell_id").isNotNull()
    q = per.agg(
        total(F.when(some, F.col("rb") * F.col("br"))).alias("n"), total(F.when(some, F.col("m"))).alias("m"),
        total(F.when(~F.col("t") | ~some, F.col("n"))).alias("isolated"),
    )
    n, m = q.select("n").scalar(), q.select("m").scalar()
    return a.withColumns(
        {
            "quad_closure_candidate_count": n, "quad_closure_match_count": m, "quad_closure_mismatch_count": n - m,
            "isolated_cell_count": q.select("isolated").scalar(),
        }
    )


def link_components(cells: DataFrame) -> DataFrame:
    """Per skin: groups of cells joined by its links, the largest group, cells that stand alone."""
    from ridgeline.operators.components import label_graph

    cells = cut_lineage(cells)  # read by the edges, the nodes and the sizes
    # a link and its way back are one edge of the graph
    pair = [F.least("cell_id", "other_id").alias("a"), F.greatest("cell_id", "other_id").alias("b")]
    e = link_edges(cells).where(F.col("cell_id") != F.col("other_id"))
    owner = cells.select(F.col("cell_id").alias("other_id"), F.col("skin_id").alias("_skin"))
    inside = e.select("cell_id", "skin_id", "other_id").join(owner, "other_id").where(F.col("skin_id") == F.col("_skin"))
    labels = label_graph(cells.select(F.col("cell_id").alias("id")), inside.select(*pair).distinct())
    sizes = cells.select("cell_id", "skin_id").join(labels.withColumnRenamed("id", "cell_id"), "cell_id").groupBy("skin_id", "label").agg(F.count(F.lit(1)).alias("cells"))
    return sizes.groupBy("skin_id").agg(
        F.count(F.lit(1)).alias("component_count"), F.max("cells").alias("largest_component"), F.count_if(F.col("cells") == 1).alias("singleton_count")
    )


def link_by_position(cells: DataFrame, v: str = "v", w: str = "w") -> DataFrame:
    """Fill ca/cb (v -/+ 1) and cl/cr (w -/+ 1) inside each skin with windows, no self-join.

    Neighbours along a surface row are adjacent rows of a window over that row.
    """
    along_v = Window.partitionBy("skin_id", w).orderBy(v)
    along_w = Window.partitionBy("skin_id", v).orderBy(w)

    def near(window, axis, k) -> Column:
        move = F.lead if k > 0 else F.lag
        ok = move(axis, 1).over(window) == F.col(axis) + k
        return F.when(ok, move("cell_id", 1).over(window))

    return cells.withColumns(
        {
            "ca_id": near(along_v, v, -1), "cb_id": near(along_v, v, 1),
            "cl_id": near(along_w, w, -1), "cr_id": near(along_w, w, 1),
        }
    )


def generation_counts(cells: DataFrame) -> DataFrame:
    """Cells per generation with mean support."""
    return cells.groupBy("generation").agg(
        F.count(F.lit(1)).alias("cell_count"), F.avg("reskin_support").alias("mean_support")
    )
