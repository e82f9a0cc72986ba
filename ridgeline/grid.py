"""Grid layouts, halo tiles and shapes.

A neighbourhood operator needs the traces around each trace.  Instead of one shuffle per
axis, traces are sent once to square tiles of the ``(i3, i2)`` plane together with a halo
as wide as the stencil, so a whole chain of passes along i3, i2 and i1 costs a single
exchange of compact rows, and no task ever holds more than a tile: long lines and hot
axes are cut up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

I3, I2, I1 = "i3", "i2", "i1"
TILE3, TILE2, CORE = "_tile3", "_tile2", "_core"


@dataclass(frozen=True)
class Tiling:
    """Tile edge lengths, and extra key columns (case, volume) handled side by side."""

    block3: int = 64
    block2: int = 64
    keys: tuple[str, ...] = ()

    @property
    def tile_cols(self) -> list[str]:
        return [*self.keys, TILE3, TILE2]


DEFAULT_TILING = Tiling()


def with_halo(df: DataFrame, r3: int, r2: int, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """Replicate rows into every tile whose core or halo they belong to.

    Adds the tile columns and ``_core`` (true in exactly one copy), then hash
    partitions by tile.  Replication is ``(1+2*r3/block3)*(1+2*r2/block2)``.
    """

    def tiles(index: str, radius: int, block: int) -> Column:
        lo = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(index) - radius) / block))
        hi = F.floor((F.col(index) + radius) / block)
        return F.explode(F.sequence(lo.cast("int"), hi.cast("int")))

    out = df.withColumn(TILE3, tiles(I3, r3, tiling.block3))
    out = out.withColumn(TILE2, tiles(I2, r2, tiling.block2))
    core = (F.floor(F.col(I3) / tiling.block3) == F.col(TILE3)) & (
        F.floor(F.col(I2) / tiling.block2) == F.col(TILE2)
    )
    # An explicit count: the work per byte is high, so small tiles must not be coalesced.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn(CORE, core).repartition(n, *tiling.tile_cols)


# ---------------------------------------------------------------- layouts


def to_voxels(df: DataFrame, cols: list[str], extra: list[str] | None = None) -> DataFrame:
    """Trace layout -> voxel layout; one narrow, code-generated explode, no shuffle."""
    extra = extra or []
    n = F.size(cols[0])
    index = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias(I1)
    out = df.select(*extra, I3, I2, *cols, index)
    return out.select(*extra, I3, I2, I1, *[F.get(c, F.col(I1)).alias(c) for c in cols])


def to_traces(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Voxel layout -> trace layout; group size is one trace, bounded by n1."""
    packed = F.array_sort(F.collect_list(F.struct(I1, *cols)))
    out = df.groupBy(*keys, I3, I2).agg(packed.alias("_p"))
    return out.select(*keys, I3, I2, *[F.col("_p").getField(c).alias(c) for c in cols])


def shape_of(df: DataFrame) -> DataFrame:
    """One row ``n3, n2, n1`` of a dense voxel or trace DataFrame."""
    is_trace = I1 not in df.columns
    if is_trace:
        arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
        n1 = F.max(F.size(arrays[0]))
    else:
        n1 = F.max(I1) + 1
    return df.agg((F.max(I3) + 1).alias("n3"), (F.max(I2) + 1).alias("n2"), n1.alias("n1"))


def scalar(df: DataFrame, name: str) -> Column:
    """A one-row result as a scalar subquery: no join, computed once per plan."""
    return df.select(name).scalar()


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later columns use them.

    Expressions of plain columns are copied into each of their uses; a few layers of that grow past what
    the code generator compiles, and the rows are interpreted.  An explode of one element keeps them apart.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")
    return df.select("*", one).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in cols])


def with_shape(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Add the columns n3, n2, n1 through scalar subqueries; ``source``: what to take them from (traces are cheaper)."""
    s = shape_of(df if source is None else source)
    return df.withColumns({n: scalar(s, n) for n in ("n3", "n2", "n1")})


def key_ddl(df: DataFrame, keys: tuple[str, ...]) -> str:
    """The head of a schema string for the key columns of ``df``."""
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def with_totals(df: DataFrame, source: DataFrame, keys: tuple[str, ...], **aggs: Column) -> DataFrame:
    """Add aggregates of ``source`` as columns: of its rows of the same keys, or of all rows without keys."""
    named = [e.alias(n) for n, e in aggs.items()]
    if keys:
        return df.join(F.broadcast(source.groupBy(*keys).agg(*named)), list(keys))  # one short row a key; the volume itself must not be broadcast
    one = source.agg(*named)
    return df.withColumns({n: scalar(one, n) for n in aggs})


def flat_index(n2: Column | str = "n2", n1: Column | str = "n1") -> Column:
    """C-order flat index of a voxel."""
    n2c = F.col(n2) if isinstance(n2, str) else n2
    n1c = F.col(n1) if isinstance(n1, str) else n1
    return (F.col(I3).cast("bigint") * n2c + F.col(I2)) * n1c + F.col(I1)


def axis_range(span: tuple[int | None, int | None] | None, size: int, axis: str) -> tuple[int, int]:
    """``[lo, hi)`` of an axis from a slice's ends: None is the end, negative counts from it, empty or outside is an error."""
    lo, hi = span or (None, None)
    lo, hi = (0 if lo is None else lo), (size if hi is None else hi)
    lo, hi = (lo + size if lo < 0 else lo), (hi + size if hi < 0 else hi)
    if not (0 <= lo <= size and 0 <= hi <= size):
        raise ValueError(f"{axis} range is outside the axis of {size}")
    if lo >= hi:
        raise ValueError(f"{axis} range must not be empty")
    return lo, hi


def slice_region(df: DataFrame, shape: tuple[int, int, int], i3=None, i2=None, i1=None) -> DataFrame:
    """:func:`region` with slice rules for each axis of a volume of this shape."""
    spans = {a: axis_range(s, n, a) for a, s, n in zip((I3, I2, I1), (i3, i2, i1), shape)}
    return region(df, **{a: spans[a] for a in spans})


def centered_crop(shape: tuple[int, int, int], center: tuple[int, int, int], crop: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Ranges of a crop around a centre, moved inwards where it would leave the volume."""
    out = []
    for n, c, w in zip(shape, center, crop):
        if w > n or not 0 <= c < n:
            raise ValueError("the crop or its centre does not fit the volume")
        lo = min(max(c - w // 2, 0), n - w)
        out.append((lo, lo + w))
    return out


def region(df: DataFrame, i3=None, i2=None, i1=None) -> DataFrame:
    """Sub-cube ``[lo, hi)`` per axis; i3/i2 ranges reach the scan as pushed filters."""
    out = df
    for name, span in ((I3, i3), (I2, i2)):
        if span is not None:
            out = out.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    if i1 is not None:
        if I1 in df.columns:
            out = out.where((F.col(I1) >= i1[0]) & (F.col(I1) < i1[1]))
        else:
            arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
            out = out.withColumns(
                {a: F.slice(a, i1[0] + 1, i1[1] - i1[0]) for a in arrays}
            )
    return out
