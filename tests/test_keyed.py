"""Several volumes side by side: keyed runs equal the runs of each volume alone; keyed top-k; seeded draws."""

import numpy as np
from pyspark.sql import functions as F

from helpers import to_array, traces
from ridgeline.grid import Tiling, flat_index, to_voxels, with_shape
from ridgeline.operators import scan_sweep, voting
from ridgeline.operators.masks import top_k_by_key
from ridgeline.operators.seeds import pick_seeds
from ridgeline.sources.cases import seeded_normal

SHAPE = (7, 8, 9)
ALONE, KEYED = Tiling(4, 4), Tiling(4, 4, ("trial",))


def _seeds(df, tiling):
    c = with_shape(to_voxels(df, ["ft"], list(tiling.keys))).withColumn("flat", flat_index()).where("ft > 0.5")
    c = c.withColumns({"pt": F.lit(30.0), "tt": F.lit(70.0)})
    return pick_seeds(c.select(*tiling.keys, "i3", "i2", "i1", "flat", F.col("ft").alias("score"), "pt", "tt"), 2, True, tiling)


def test_keyed_sweep_seeds_and_votes_equal_single_runs(spark):
    rng = np.random.default_rng(5)
    # the second volume has another range, the third is constant
    volumes = {"a": rng.random(SHAPE, np.float32), "b": (0.6 + 0.3 * rng.random(SHAPE)).astype(np.float32), "c": np.full(SHAPE, 0.25, np.float32)}
    each = {k: traces(spark, ft=v) for k, v in volumes.items()}
    tagged = [d.withColumn("trial", F.lit(k)) for k, d in each.items()]
    stacked = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    sweep = scan_sweep.scan_sweep_3d(stacked, "ft", [20.0, 60.0], [70.0], 1.0, tiling=KEYED).cache()
    seeds = _seeds(stacked, KEYED).cache()
    votes = voting.surface_voting(stacked, seeds, voting.Voter(1, 2, 2), KEYED).cache()
    for k, d in [("b", each["b"])]:
        mine = f"trial = '{k}'"
        one = scan_sweep.scan_sweep_3d(d, "ft", [20.0, 60.0], [70.0], 1.0, tiling=ALONE)
        assert np.array_equal(to_array(sweep.where(mine), "ft", SHAPE), to_array(one, "ft", SHAPE))
        alone = _seeds(d, ALONE)
        flats = lambda s: sorted(r["flat"] for r in s.select("flat").collect())
        assert flats(seeds.where(mine)) == flats(alone)
        want = to_array(voting.surface_voting(d, alone, voting.Voter(1, 2, 2), ALONE), "fv", SHAPE)
        assert np.array_equal(to_array(votes.where(mine), "fv", SHAPE), want)
    assert seeds.where("trial = 'c'").isEmpty() and not seeds.where("trial = 'b'").isEmpty()


def test_top_k_by_key_against_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [(key, i, float(x), k) for key, n, k in (("a", 50, 7), ("b", 20, 30), ("c", 9, 0)) for i, x in enumerate(rng.integers(-2, 6, n))]
    df = spark.createDataFrame(rows, "g string, flat long, x double, k long")
    for positive in (False, True):
        got = {(r["g"], r["flat"]) for r in top_k_by_key(df, "x", "k", ["g"], positive_only=positive).where("mask").collect()}
        want = set()
        for key in "abc":
            pool = sorted(((-x, i, k) for g, i, x, k in rows if g == key and (x > 0 or not positive)))
            want |= {(key, i) for _, i, k in pool[: pool[0][2]]}
        assert got == want


def test_seeded_draws_do_not_depend_on_partitions(spark):
    draw = lambda n: {
        (r["seed"], r["id"]): r["z"]
        for r in spark.range(0, 4000, 1, n).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("z", seeded_normal("seed", "id")).collect()
    }
    a, b = draw(1), draw(7)
    assert a == b
    z = np.array([v for (s, _), v in a.items() if s == 1])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and a[(1, 5)] != a[(2, 5)]
