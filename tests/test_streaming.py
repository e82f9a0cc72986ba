import numpy as np
from helpers import traces
from pyspark.sql import functions as F

from ridgeline.streaming.slabs import read_slabs, slab_summary, write_summary


def test_summary_grows_with_the_slabs(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(6, 3, 5)).astype(np.float32)
    a[0, 0, 0] = 0.0
    df = traces(spark, trace=a).withColumn("stage", F.lit("fv")).select("stage", "i3", "i2", "trace")
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for lo in (0, 3):
        df.where((F.col("i3") >= lo) & (F.col("i3") < lo + 3)).write.mode("append").parquet(src)
        write_summary(read_slabs(spark, src, 1), out, ck).awaitTermination()
        r, seen = spark.read.parquet(out).first(), a[: lo + 3].astype(float)
        assert r["n"] == seen.size
        assert np.allclose([r["mean"], r["std"], r["max_absolute"]], [seen.mean(), seen.std(), np.abs(seen).max()], atol=1e-6)
        assert np.isclose(r["epsilon_nonzero_fraction"], (np.abs(seen) > 1e-6).mean())
    assert slab_summary(spark.read.parquet(src)).count() == 1
