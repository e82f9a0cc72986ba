"""Sharding with fixed virtual slots.

Records are hashed by id into thousands of slots, whatever the number of shards.  Bytes are summed per slot,
and a small versioned map says which shard holds which slot.  The first map deals slots out from the
largest down, each to the shard that is least full; a later version is an edit of the one before: a slot
moves only if its shard is gone or over its share, all others stay.

A slot that holds far more rows than others (one id, or none, on many rows) is split into shares by a hash
of the whole record and its place in the table, so no key has to fit into one shard.  Shards are written as
files of bounded size; rows are numbered inside each file while it is written, and a manifest of the files'
row counts turns that into gapless numbers per shard.

Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm.common import new_folder, stored

SLOTS = 4096
#: Shares of a slot at most (a power of two), and how many times the mean of rows make a slot hot.
SHARES, HOT, LEAST_ROWS = 64, 4, 16
FILE_BYTES = 64 << 20
OVERHEAD = 8
LAW = "bytes"


@dataclass(frozen=True)
class Shards:
    """A folder with the records (``records``), the map's versions (``map``) and the manifest (``manifest``)."""

    folder: str
    schema: StructType


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string").cast("binary")), F.lit(0)).cast("long") + OVERHEAD


def _keyed(docs: DataFrame, slots: int) -> DataFrame:
    """(record, size, vslot, fine, at): ``fine`` splits hot slots, ``at`` in [0, 1) spreads a slot over files."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.monotonically_increasing_id().alias("row"))
    own = F.xxhash64("record.doc_id", F.col("record.text").cast("string"), "row")
    return whole.select(
        "record", _size("record.text").alias("size"), F.pmod(F.xxhash64(F.col("record.doc_id").cast("long")), F.lit(slots)).cast("int").alias("vslot"),
        F.pmod(own, F.lit(SHARES)).cast("int").alias("fine"), (F.pmod(F.shiftright(own, 8), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("at"),
    )


def units(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, share, shares, rows, bytes): rows and bytes of every slot, hot ones by share; at most 1.5 times ``slots`` rows."""
    fine = stored(_keyed(docs, slots).groupBy("vslot", "fine").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "slot-bytes")
    mean = fine.agg(F.greatest(F.coalesce(F.sum("rows"), F.lit(0)) / F.lit(slots), F.lit(LEAST_ROWS)).alias("mean")).first()["mean"]
    times = F.sum("rows").over(Window.partitionBy("vslot")) / F.lit(HOT * mean)
    shares = F.when(times > 1, F.least(F.lit(SHARES), F.pow(F.lit(2), F.ceil(F.log2(times))).cast("int"))).otherwise(1)
    return fine.withColumn("shares", shares).groupBy("vslot", F.pmod("fine", "shares").alias("share"), "shares").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def edited(sized: DataFrame, n_shards: int, before: DataFrame | None = None) -> DataFrame:
    """(vslot, share, shares, rows, bytes, shard): the map of ``n_shards`` over the units, as an edit of the map ``before``.

    A unit stays where it is while its shard, counted from the largest unit down, is within an even
    share of all bytes; the others go, the largest first, to the shard that is least full then.
    """
    if before is None:
        placed = sized.withColumn("shard", F.lit(None).cast("int"))
    else:
        placed = sized.join(before.select("vslot", "share", "shard"), ["vslot", "share"], "left").withColumn("shard", F.when(F.col("shard") < n_shards, F.col("shard")))
    order = [F.desc("bytes"), F.col("vslot"), F.col("share")]
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    even = F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards)
    # at most 1.5 times the slots: a bounded number of rows, so one task may see them all
    placed = placed.withColumn("kept", F.col("shard").isNotNull() & ((filled <= even) | (filled == F.col("bytes"))))
    unit = F.struct((-F.col("bytes")).alias("less"), "vslot", "share", "shares", "rows", "bytes")
    loads = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.aggregate(F.filter("stay", lambda u: u["shard"] == s), F.lit(0).cast("long"), lambda a, u: a + u["bytes"]))

    def deal(state: Column, u: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == least, x + u["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.array_append(state["to"], least).alias("to"))

    gathered = placed.agg(
        F.array_sort(F.collect_list(F.when(~F.col("kept"), unit))).alias("free"), F.collect_list(F.when(F.col("kept"), F.struct("shard", "bytes"))).alias("stay")
    ).withColumn("loads", loads)
    dealt = gathered.withColumn("to", F.aggregate("free", F.struct("loads", F.expr("cast(array() as array<int>)").alias("to")), deal)["to"])
    moved = dealt.select(F.posexplode(F.arrays_zip("free", "to"))).select(*[f"col.free.{c}" for c in ("vslot", "share", "shares", "rows", "bytes")], F.col("col.to").alias("shard"))
    return placed.where("kept").select("vslot", "share", "shares", "rows", "bytes", "shard").unionByName(moved)


def store_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Write a version of the map (never over another one) and read it back."""
    path = f"{folder}/map/version={version}"
    slot_map.coalesce(1).write.parquet(path)
    return slot_map.sparkSession.read.schema(slot_map.schema).parquet(path)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/map/version={version}")


def write_shards(docs: DataFrame, n_shards: int, folder: str | None = None, slots: int = SLOTS, file_bytes: int = FILE_BYTES) -> Shards:
    """Write ``docs`` (doc_id, text and any other columns) in ``n_shards`` shards of near equal bytes, with map version 1 and manifest.

    A record's size is the bytes of its text and ``OVERHEAD``; null text has none.  Null and repeated ids
    are hashed like others, their slots are split where they are hot; equal rows are written each; other
    columns, whatever their names, are kept as given; no rows write no shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    slot_map = store_map(edited(units(docs, slots), n_shards), folder, 1)
    start = F.coalesce(F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot", "share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = slot_map.withColumn("start", start).groupBy("vslot").agg(F.first("shares").alias("n"), F.array_sort(F.collect_list(F.struct("share", "shard", "start", "bytes"))).alias("units"))
    files = slot_map.groupBy("shard").agg(F.ceil(F.sum("bytes") / file_bytes).alias("files")).agg(F.sum("files").alias("files")).first()["files"] or 1
    rows = _keyed(docs, slots).join(F.broadcast(lines), "vslot")  # one line a slot
    # where the second look at a row gives another share than the first, one without rows then, the first unit takes it
    own = F.coalesce(F.get(F.filter("units", lambda u: u["share"] == F.pmod(F.col("fine"), F.col("n"))), F.lit(0)), F.get("units", F.lit(0)))
    placed = rows.withColumn("own", own).select(
        "record", "size", "vslot", "own.share", "own.shard", F.floor((F.col("own.start") + F.col("at") * F.col("own.bytes")) / file_bytes).cast("int").alias("file")
    )
    # three times as many tasks as files: few tasks then take more than one
    dealt = placed.repartition(min(100_000, 3 * int(files)), "shard", "file")
    order = Window.partitionBy("shard", "file").orderBy("vslot", "record.doc_id", "size")
    written = dealt.withColumn("place", F.row_number().over(order) - 1)
    written.write.partitionBy("shard").parquet(f"{folder}/records")
    shards = Shards(folder, written.schema)
    counts = _records(spark, shards).groupBy("shard", "file").agg(F.count(F.lit(1)).alias("records"))
    first = F.coalesce(F.sum("records").over(Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("first_slot", first).write.parquet(f"{folder}/manifest")
    return shards


def _records(spark: SparkSession, shards: Shards) -> DataFrame:
    return spark.read.schema(shards.schema).parquet(f"{shards.folder}/records")


def read_shards(spark: SparkSession, shards: Shards) -> DataFrame:
    """record, size, vslot, share, shard and slot (0, 1, ... in each shard) of everything written."""
    manifest = spark.read.schema("shard int, file int, records long, first_slot long").parquet(f"{shards.folder}/manifest")
    return _records(spark, shards).join(manifest, ["shard", "file"]).select("record", "size", "vslot", "share", "shard", (F.col("first_slot") + F.col("place")).alias("slot"))


def digest(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``), vslot and next_shard of every record read back.

    ``next_shard`` is its shard in version 2 of the map, an edit for one shard more; odd rows are
    treated as in :func:`write_shards`.
    """
    spark = docs.sparkSession
    shards = write_shards(docs, n_shards)
    now = load_map(spark, shards.folder, 1)
    then = store_map(edited(now.drop("shard"), n_shards + 1, now), shards.folder, 2)
    rows = read_shards(spark, shards).join(then.select("vslot", "share", F.col("shard").alias("next_shard")), ["vslot", "share"], "left")
    text = F.coalesce(F.col("record.text").cast("string"), F.lit(""))
    return rows.select(
        F.col("record.doc_id").cast("long").alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard",
    )
