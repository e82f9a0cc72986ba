"""Contracts of a surface graph and a warp input, as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_violations(nodes: DataFrame) -> DataFrame:
    """(node_id, rule) for nodes outside their ranges.

    Columns: node_id, x1, x2, x3, strike_deg, dip_deg, cell_support_weight.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = {
        "nonfinite_position": ~(finite("x1") & finite("x2") & finite("x3")),
        "strike_range": ~((F.col("strike_deg") >= 0) & (F.col("strike_deg") < 360)),
        "dip_range": ~((F.col("dip_deg") > 0) & (F.col("dip_deg") <= 90)),
        "support_range": F.col("cell_support_weight").isNotNull() & ~F.col("cell_support_weight").between(0, 1),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return nodes.select("node_id", F.explode(broken).alias("rule"))


def link_violations(nodes: DataFrame) -> DataFrame:
    """(node_id, rule) for links that leave the table or are not answered; -1 is no link."""
    pairs = (("ca_index", "cb_index"), ("cb_index", "ca_index"), ("cl_index", "cr_index"), ("cr_index", "cl_index"))
    links = F.array(
        *[F.struct(F.lit(a).alias("link"), F.lit(b).alias("back"), F.col(a).alias("other")) for a, b in pairs]
    )
    e = nodes.select("node_id", F.explode(links).alias("l")).select("node_id", "l.*").where("other <> -1")
    ids = nodes.select(F.col("node_id").alias("other"), F.lit(True).alias("known"))
    answer = e.select(
        F.col("other").alias("node_id"), F.col("link").alias("back"), F.col("node_id").alias("other"), F.lit(True).alias("answered")
    )
    j = e.join(ids, "other", "left").join(answer, ["node_id", "back", "other"], "left")
    rule = F.when(F.col("known").isNull(), "dangling_link").when(F.col("answered").isNull(), "one_way_link")
    return j.select("node_id", "link", rule.alias("rule")).where("rule is not null")


def warp_rows(rows: DataFrame) -> DataFrame:
    """Rows of a warp result whose validity flag and NaN pattern disagree (valid, value)."""
    missing = F.isnan("value")
    return rows.where((F.col("valid") & missing) | (~F.col("valid") & ~missing))


def correlation_gain(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Correlation after minus before; NULL where either is missing."""
    return rows.withColumn("correlation_gain", F.col(after) - F.col(before))
