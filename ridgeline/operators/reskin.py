"""Smoothing and re-orienting grown surfaces, as joins and aggregations.

Cells are projected on the (dip, strike) grid of their surface's strongest cell; local
offsets are smoothed with likelihood weights by sending each cell's share to the grid
positions around it (a fixed number, summed before the shuffle); angles follow from
differences of the smoothed offsets.  A surface is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.angles import dip_vector, nearest_index, normal_vector, strike_dip_of_surface, strike_vector
from ridgeline.functions.kernels import gaussian_weights
from ridgeline.operators.joins import salted_join
from ridgeline.operators.topology import link_by_position


def _frame() -> dict[str, list[Column]]:
    """Local frame of the seed columns s_fp, s_ft as doubles."""
    return {
        "n": [x.cast("double") for x in normal_vector("s_fp", "s_ft")],
        "d": [x.cast("double") for x in dip_vector("s_fp", "s_ft")],
        "s": [x.cast("double") for x in strike_vector("s_fp")],
    }


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def project_cells(cells: DataFrame) -> DataFrame:
    """Add the local frame and grid position (u, v, w) of each cell; strongest cell per position.

    ``cells``: skin_id, cell_id, x1, x2, x3, fl, fp, ft.  Ties go to the smaller cell_id.
    """
    best = F.max(F.struct(F.col("fl"), -F.col("cell_id"), "x1", "x2", "x3", "fp", "ft")).alias("b")
    seed = cells.groupBy("skin_id").agg(best, F.count(F.lit(1)).alias("skin_size")).select(
        "skin_id", "skin_size", *[F.col(f"b.{c}").alias(f"s_{c}") for c in ("x1", "x2", "x3", "fp", "ft")]
    )
    j = salted_join(cells, seed, "skin_id", ["cell_id"])
    f = _frame()
    off = [(F.col(c).cast("float") - F.col(f"s_{c}").cast("float")).cast("double") for c in ("x1", "x2", "x3")]
    j = j.withColumns(
        {"u": _dot(off, f["n"]), "v": nearest_index(_dot(off, f["d"])), "w": nearest_index(_dot(off, f["s"]))}
    )
    kept = F.max(F.struct(F.col("fl"), -F.col("cell_id"), "u")).alias("k")
    seeds = ["s_x1", "s_x2", "s_x3", "s_fp", "s_ft"]
    one = j.groupBy("skin_id", "v", "w").agg(kept, *[F.first(c).alias(c) for c in seeds], F.first("skin_size").alias("skin_size"))
    return one.select(
        "skin_id", "v", "w", *seeds, "skin_size", (-F.col("k.col2")).alias("cell_id"), F.col("k.fl").alias("fl"), F.col("k.u").alias("u")
    )


def _share(target: Column, source: Column, low: Column, high: Column, weights: list[float]) -> Column:
    """Gaussian share of ``source`` at ``target``; samples beyond the box repeat its edge."""
    r = len(weights) // 2
    w = F.array(*[F.lit(x) for x in weights])
    k = source - target + r
    total = F.lit(sum(weights))
    upto = F.array(*[F.lit(sum(weights[: i + 1])) for i in range(len(weights))])
    before = F.when(k > 0, F.get(upto, k - 1)).otherwise(0.0)
    return (
        F.when((source == low) & (source == high), total)
        .when(source == low, F.get(upto, k))
        .when(source == high, total - before)
        .otherwise(F.get(w, k))
    )


def reskin(cells: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Smoothed, re-oriented and linked cells (skin_id, cell_id, x1..x3, fl, fp, ft, links)."""
    one = project_cells(cells)
    alone = one.where("skin_size <= 1")
    many = one.where("skin_size > 1")
    box = many.groupBy("skin_id").agg(
        *[g(c).alias(f"{c}_{n}") for c in ("v", "w") for g, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    p = salted_join(many, box, "skin_id", ["cell_id"])
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    span = F.sequence(F.lit(-r), F.lit(r))
    weight = F.when(F.col("fl") > 0, F.col("fl").cast("double")).otherwise(1.0)
    out = (
        p.select("skin_id", "v", "w", "u", weight.alias("q"), "v_lo", "v_hi", "w_lo", "w_hi", F.explode(span).alias("dv"))
        .withColumn("tv", F.col("v") + F.col("dv")).where("tv between v_lo and v_hi")
        .withColumn("dw", F.explode(span)).withColumn("tw", F.col("w") + F.col("dw")).where("tw between w_lo and w_hi")
    )
    g = _share(F.col("tv"), F.col("v"), F.col("v_lo"), F.col("v_hi"), weights) * _share(
        F.col("tw"), F.col("w"), F.col("w_lo"), F.col("w_hi"), weights
    )
    own = F.max(F.when((F.col("dv") == 0) & (F.col("dw") == 0), F.col("u")))
    grid = out.groupBy("skin_id", F.col("tv").alias("v"), F.col("tw").alias("w")).agg(
        F.sum(g * F.col("q") * F.col("u")).alias("num"), F.sum(g * F.col("q")).alias("den"), own.alias("own")
    )
    grid = grid.select(
        "skin_id", "v", "w",
        F.when(F.col("den") > 1e-6, F.col("num") / F.col("den")).otherwise(F.coalesce("own", F.lit(0.0))).cast("float").cast("double").alias("z"),
    )
    spots = {"c": (0, 0), "vm": (-1, 0), "vp": (1, 0), "wm": (0, -1), "wp": (0, 1)}
    ask = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in spots.items()]))
    seen = (
        p.select("skin_id", "cell_id", "v", "w", ask.alias("o"))
        .select("skin_id", "cell_id", "o.n", (F.col("v") + F.col("o.a")).alias("v"), (F.col("w") + F.col("o.b")).alias("w"))
        .join(grid, ["skin_id", "v", "w"])
        .groupBy("skin_id", "cell_id").agg(*[F.max(F.when(F.col("n") == n, F.col("z"))).alias(f"z_{n}") for n in spots])
    )
    q = p.join(seen, ["skin_id", "cell_id"])

    def slope(axis: str) -> Column:
        m, c, h = F.col(f"z_{axis}m"), F.col("z_c"), F.col(f"z_{axis}p")
        at, lo, hi = F.col(axis), F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        step = F.when(at == lo, h - c).when(at == hi, c - m).otherwise(0.5 * (h - m))
        return F.when(lo == hi, F.lit(0.0)).otherwise(F.coalesce(step, F.lit(0.0)))

    f = _frame()
    q = q.withColumns({"_dv": slope("v"), "_dw": slope("w")})
    fp, ft = strike_dip_of_surface(f["n"], f["d"], f["s"], F.col("_dv"), F.col("_dw"))
    pos = [
        (F.col(f"s_x{k + 1}") + F.col("z_c") * f["n"][k] + F.col("v") * f["d"][k] + F.col("w") * f["s"][k]).cast("float").alias(f"x{k + 1}")
        for k in range(3)
    ]
    smooth = q.select(
        "skin_id", "cell_id", "v", "w", *pos, "fl", fp.cast("float").alias("fp"), ft.cast("float").alias("ft"),
        F.lit("existing_cells_reskinned").alias("generation"),
    )
    single = alone.select(
        "skin_id", "cell_id", "v", "w", *[F.col(f"s_x{k}").cast("float").alias(f"x{k}") for k in (1, 2, 3)], "fl",
        F.col("s_fp").cast("float").alias("fp"), F.col("s_ft").cast("float").alias("ft"), F.lit("grown").alias("generation"),
    )
    return link_by_position(smooth.unionByName(single))
