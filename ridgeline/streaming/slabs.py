"""Running summary of a volume whose slabs land as files.

Each micro-batch reduces its traces to one partial row per stage before the shuffle;
the state kept between batches is a handful of sums per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SLAB_SCHEMA = "stage string, i3 int, i2 int, trace array<float>"


def read_slabs(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Parquet slabs (stage, i3, i2, trace) as a stream."""
    return spark.readStream.schema(SLAB_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def slab_summary(slabs: DataFrame, epsilon: float = 1.0e-6) -> DataFrame:
    """Per stage: samples, mean, population std, largest |value|, non-empty fraction."""
    part = slabs.select(
        "stage", F.size("trace").alias("n"),
        F.aggregate("trace", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("s"),
        F.aggregate("trace", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("q"),
        F.array_max(F.transform("trace", lambda x: F.abs(x))).cast("double").alias("m"),
        F.size(F.filter("trace", lambda x: F.abs(x) > F.lit(epsilon).cast("float"))).alias("k"),
    )
    g = part.groupBy("stage").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("max_absolute"), F.sum("k").alias("k")
    )
    mean = F.col("s") / F.col("n")
    return g.select(
        "stage", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"),
        "max_absolute", (F.col("k") / F.col("n")).alias("epsilon_nonzero_fraction"),
    )


def write_summary(slabs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep ``out`` at the summary of all slabs seen; processes what is there and stops."""

    def replace(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return (
        slab_summary(slabs).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
