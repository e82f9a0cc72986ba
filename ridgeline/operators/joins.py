"""Join helper for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame, small: DataFrame, key: str | list[str], spread: list[str], salts: int = SALTS
) -> DataFrame:
    """Inner join on ``key`` when one key may hold much of ``big``.

    Rows of ``big`` are spread over ``salts`` sub-keys by the columns ``spread``;
    ``small`` (one row per key) is repeated for each.
    """
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
