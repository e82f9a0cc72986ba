"""Skins as JSON, metric tables, content-addressed stages and manifests."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format versions of the skin document; generations a cell may have, and those that carry a support.
SKINS_VERSIONS = (1, 2)
GENERATIONS = ("grown", "existing_cells_reskinned", "dense_reskin_observed", "dense_reskin_generated", "connected_component")
DENSE_GENERATIONS = ("dense_reskin_observed", "dense_reskin_generated")
_CELL = (
    "x1 double, x2 double, x3 double, i1 int, i2 int, i3 int, fl double, fp double, ft double, "
    "generation string, reskin_support double"
)
_CELL_FIELDS = [f.split() for f in _CELL.split(", ")]
SKINS_SCHEMA = (
    "format_version int, skinning_enabled boolean, skin_count int, skins array<struct<skin_index: int, "
    "cell_count: int, cells: array<struct<" + ", ".join(f"{n}: {t}" for n, t in _CELL_FIELDS) + ">>>>"
)


def _skin_fault(d: Column, shape: tuple[int, int, int] | None) -> Column:
    """What is wrong with a parsed document, or NULL."""
    order = lambda c: F.struct(c["i3"], c["i2"], c["i1"])
    dense = lambda c: c["generation"].isin(*DENSE_GENERATIONS)
    v2 = d["format_version"] == 2
    no_generation = lambda c: v2 & ~F.coalesce(c["generation"].isin(*GENERATIONS), F.lit(False))
    support = lambda c: v2 & F.when(dense(c), ~F.coalesce(c["reskin_support"].between(0.0, 1.0), F.lit(False))).otherwise(c["reskin_support"].isNotNull())
    hole = lambda c: F.exists(F.array(*[c[n].isNull() for n in ("x1", "x2", "x3", "i1", "i2", "i3", "fl", "fp", "ft")]), lambda x: x)
    cells = F.flatten(F.transform(d["skins"], lambda s: s["cells"]))
    rules = [
        (~F.coalesce(d["format_version"].isin(*SKINS_VERSIONS), F.lit(False)), "no skin document of format version 1 or 2"),
        (~F.coalesce(d["skinning_enabled"], F.lit(False)), "skinning_enabled must be true"),
        (~F.coalesce(d["skin_count"] == F.size(d["skins"]), F.lit(False)), "skin_count mismatch"),
        (F.exists(F.transform(d["skins"], lambda s, k: F.coalesce(s["skin_index"] != k, F.lit(True))), lambda x: x), "skin_index mismatch"),
        (F.exists(d["skins"], lambda s: ~F.coalesce((s["cell_count"] == F.size(s["cells"])) & (s["cell_count"] >= 1), F.lit(False))), "cell_count mismatch"),
        (F.exists(cells, hole), "a cell lacks a value"),
        (F.exists(cells, no_generation), "cell generation is invalid"),
        (F.exists(cells, support), "cell reskin_support does not go with its generation"),
        (F.exists(d["skins"], lambda s: F.transform(s["cells"], order) != F.array_sort(F.transform(s["cells"], order))), "cell order is not canonical"),
    ]
    if shape is not None:
        out = lambda c: F.exists(F.array(*[~c[i].between(0, n - 1) for i, n in zip(("i3", "i2", "i1"), shape)]), lambda x: x)
        rules.append((F.exists(cells, out), "cell outside the volume"))
    fault = None
    for wrong, text in rules:
        fault = F.when(wrong, text) if fault is None else fault.when(wrong, text)
    return fault


def parse_skins(df: DataFrame, col: str = "value", shape: tuple[int, int, int] | None = None) -> DataFrame:
    """JSON documents -> one row per cell (skin_id, cell fields).

    Versions 1 (cells without generation and support) and 2 are read; anything else, a count that
    does not hold, an empty skin or cells out of order end the query with the reason.  NULL is no
    document and an error too.
    """
    doc = df.select(F.from_json(col, SKINS_SCHEMA).alias("d"))
    fault = _skin_fault(F.col("d"), shape)
    skins = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("skin document: "), fault))).otherwise(F.col("d.skins"))
    skin = doc.select(F.explode(skins).alias("s"))
    return skin.select(F.col("s.skin_index").alias("skin_id"), F.explode("s.cells").alias("c")).select("skin_id", "c.*")


def skin_records(cells: DataFrame) -> DataFrame:
    """One JSON record per cell in canonical order inside its skin; the table form of the document.

    A skin may be larger than a task, so skins are not assembled into single documents:
    records are range-partitioned by (skin, i3, i2, i1) and written as JSON lines.
    """
    fields = [n for n, _ in _CELL_FIELDS]
    ordered = cells.repartitionByRange("skin_id", "i3", "i2", "i1").sortWithinPartitions("skin_id", "i3", "i2", "i1")
    return ordered.select("skin_id", F.to_json(F.struct(*fields)).alias("cell"))


def read_summary(spark: SparkSession, path: str, variant: str, schema: str) -> DataFrame:
    """Summary CSV rows of one variant."""
    return spark.read.csv(path, header=True, schema=schema).where(F.col("variant") == variant)


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metric rows as CSV (with header) or JSON lines, one file per partition."""
    w = df.write.mode("errorifexists")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def fingerprint(config: dict) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_fingerprint(*cols: str):
    """SHA-256 of the canonical JSON of some columns, as an expression."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def write_bundle(spark: SparkSession, folder: str, parts: dict[str, DataFrame], settings: dict) -> DataFrame:
    """Write named tables and then their manifest; a bundle without a manifest is unfinished.

    The manifest has a row per table: name, rows, digest (order-free over its rows) and the
    fingerprint of ``settings``.
    """
    for name, df in parts.items():
        df.write.parquet(f"{folder}/{name}")
    made = reduce(lambda a, b: a.unionByName(b), [_digest(spark.read.parquet(f"{folder}/{name}"), name) for name in parts])
    manifest = made.withColumn("settings", F.lit(fingerprint(settings)))
    manifest.write.json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def _digest(df: DataFrame, name: str) -> DataFrame:
    """Rows and the sum of row hashes, which does not depend on their order."""
    whole = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).cast("string").alias("digest"))


def table_fingerprint(df: DataFrame) -> str:
    """Rows and order-free digest of a table, as a stage's input key."""
    r = _digest(df, "").first()
    return f"{r['rows']}-{r['digest']}"


def check_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """name, rows, sound: whether each table of the manifest still is what was written."""
    manifest = spark.read.schema("name string, rows bigint, digest string, settings string").json(f"{folder}/manifest")
    names = [r["name"] for r in manifest.select("name").collect()]  # a few tables
    now = reduce(lambda a, b: a.unionByName(b), [_digest(spark.read.parquet(f"{folder}/{n}"), n) for n in names])
    j = manifest.join(now.select("name", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")), "name", "left")
    return j.select("name", "rows", (F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest"))).alias("sound"))


def canonical_order(df: DataFrame, ranks: dict[str, list[str]], *more: str) -> DataFrame:
    """Rows in registry order: by the place of each key column's value in its list, unknown values last, then ``more``."""
    keys = []
    for col, values in ranks.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
        keys += [F.when(place > 0, place).otherwise(len(values) + 1), F.col(col)]
    return df.orderBy(*keys, *more)


# Shapes (i3, i2, i1) and files of the public example volumes and images, big-endian float32.
CATALOG = {
    "f3d": ((420, 400, 100), "", ("xs.dat", "ep.dat", "fl.dat", "fv.dat", "fvt.dat")),
    "f3d2d": ((1, 440, 222), "data/2d/f3d2d", ("f3d75s.dat", "el.dat", "ft.dat", "pt.dat", "fv.dat", "fvt.dat")),
    "campos": ((1, 550, 300), "data/2d/campos", ("camposL.dat", "gx373.dat", "el.dat", "ft.dat", "pt.dat", "fv.dat", "fvt.dat")),
}


def dataset_file(dataset: str, name: str, root: str) -> tuple[str, tuple[int, int, int]]:
    """(path, shape) of a catalogued file below ``root``."""
    if dataset not in CATALOG:
        raise KeyError(f"unknown dataset: {dataset}")
    shape, below, names = CATALOG[dataset]
    if name not in names:
        raise ValueError(f"unknown file of {dataset}: {name}; expected one of {', '.join(names)}")
    return "/".join(x.rstrip("/") for x in (root, below, name) if x), shape


def read_dataset(spark: SparkSession, dataset: str, name: str, root: str) -> DataFrame:
    """A catalogued file as traces; its size must fit the catalogued shape."""
    from ridgeline.sources.dat import read_dat

    path, shape = dataset_file(dataset, name, root)
    return read_dat(spark, path, shape)


def stage(spark: SparkSession, root: str, name: str, config: dict, build, inputs: dict[str, str] | None = None) -> DataFrame:
    """Write-or-reuse: a stage table under a folder named by what it depends on.

    ``inputs`` names the fingerprints of the tables it is built from (see ``table_fingerprint``), so
    that other inputs make another stage.

    ``build()`` runs only when no committed table exists; a killed attempt leaves no
    ``_SUCCESS`` and is written again.
    """
    path = f"{root}/{name}-{fingerprint({'config': config, 'inputs': inputs or {}})[:16]}"
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
