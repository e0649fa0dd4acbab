"""Axis covers: which blocks and patches each coordinate belongs to.

A cover is one small table per axis, joined to voxels on the coordinate.  It has a row for each
coordinate and patch it lies in, so its size is that of an axis, not of the volume; up to
``COVER_ROWS`` rows it is broadcast, and beyond that the same rows are computed per voxel by arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import JobConfig
from ..functions.grid import axis_blocks, axis_cover, axis_starts

#: Rows of a cover that may be broadcast (40 bytes each).
COVER_ROWS = 250_000
AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Axis:
    name: str
    extent: int
    block: int
    patch: int
    overlap: int
    halo: int
    trim: int
    floor: float

    @property
    def rows(self) -> int:
        """An upper bound on the rows of the cover, without building it."""
        per_block = len(axis_starts(min(self.extent, self.block + 2 * self.halo), self.patch, self.overlap)) * self.patch
        return -(-self.extent // self.block) * per_block


def axes_of(cfg: JobConfig, shape: tuple[int, int, int]) -> list[Axis]:
    trim = cfg.trim_voxels if cfg.seam_mode == "trim" else 0
    return [Axis(n, e, b, p, cfg.overlap, cfg.halo, trim or 0, cfg.min_blend_weight) for n, e, b, p in zip(AXES, shape, cfg.block, cfg.patch)]


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows that become part of the plan itself, handed over in one Arrow table."""
    kinds = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), schema)


def cover_frame(spark: SparkSession, axis: Axis) -> DataFrame:
    """``g_a, k_a, s_a, j_a, w_a, keep_a, core_a, win_a`` for axis ``a``."""
    n = axis.name
    schema = T.StructType(
        [T.StructField(f"g_{n}", T.LongType()), *[T.StructField(f"{c}_{n}", T.IntegerType()) for c in "ksj"], T.StructField(f"w_{n}", T.DoubleType()), *[T.StructField(f"{c}_{n}", T.BooleanType()) for c in ("keep", "core", "win")]]
    )
    return local_frame(spark, axis_cover(axis.extent, axis.block, axis.patch, axis.overlap, axis.halo, axis.trim, axis.floor), schema)


def halo_frame(spark: SparkSession, axis: Axis) -> DataFrame:
    """``g_a, k_a, core_a``: the widened blocks of each coordinate."""
    n = axis.name
    rows = [(g, b.k, b.core.start <= g < b.core.stop) for b in axis_blocks(axis.extent, axis.block, axis.halo) for g in range(*b.wide)]
    schema = T.StructType([T.StructField(f"g_{n}", T.LongType()), T.StructField(f"k_{n}", T.IntegerType()), T.StructField(f"core_{n}", T.BooleanType())])
    return local_frame(spark, rows, schema)


def _blocks_of(g: Column, axis: Axis) -> Column:
    """Indices of the blocks whose widened span holds ``g``."""
    last = -(-axis.extent // axis.block) - 1
    first = F.greatest(F.lit(0), F.floor((g - axis.halo) / axis.block))
    return F.sequence(first.cast("int"), F.least(F.lit(last), F.floor((g + axis.halo) / axis.block)).cast("int"))


def halo_column(g: Column, axis: Axis) -> Column:
    def one(k: Column) -> Column:
        start = k.cast("long") * axis.block
        return F.struct(k.alias("k"), ((g >= start) & (g < F.least(start + axis.block, F.lit(axis.extent)))).alias("core"))

    return F.transform(_blocks_of(g, axis), one)


def cover_column(g: Column, axis: Axis) -> Column:
    """The rows of ``cover_frame`` for ``g`` as an array of structs."""
    patch, overlap, stride = axis.patch, axis.overlap, max(1, axis.patch - axis.overlap)

    def of_block(k: Column) -> Column:
        start = k.cast("long") * axis.block
        stop = F.least(start + axis.block, F.lit(axis.extent))
        wide = F.greatest(F.lit(0), start - axis.halo)
        length = F.least(F.lit(axis.extent), stop + axis.halo) - wide
        at, last = g - wide, F.greatest(F.lit(0), length - patch)
        low = F.greatest(F.lit(0), F.floor((at - patch + stride) / stride))  # first regular start that reaches g
        high = F.least(F.floor(at / stride), F.floor(last / stride))
        regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * stride)).otherwise(F.array().cast("array<bigint>"))
        tail = F.when((at >= last) & (at < last + patch), F.array(last)).otherwise(F.array().cast("array<bigint>"))
        starts = F.array_distinct(F.concat(regular, tail))
        core = (g >= start) & (g < stop)

        def of_patch(s: Column) -> Column:
            valid, j = F.least(F.lit(patch), length - s), at - s
            after = length - (s + valid)

            def ramp(size: Column, t: Column) -> Column:
                return F.when(t < size, F.lit(0.5) - F.lit(0.5) * F.cos(F.pi() * (t + 1) / (size + 1))).otherwise(F.lit(1.0))

            w = F.greatest(F.lit(float(axis.floor)), ramp(F.least(F.lit(overlap), s), j) * ramp(F.least(F.lit(overlap), after), valid - 1 - j))
            keep = (j >= F.when(s == 0, 0).otherwise(axis.trim)) & (j < valid - F.when(after == 0, 0).otherwise(axis.trim))
            return F.struct(k.alias("k"), s.cast("int").alias("s"), j.cast("int").alias("j"), w.alias("w"), keep.alias("keep"), core.alias("core"))

        rows = F.transform(starts, of_patch)
        best = F.array_max(F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: r["s"]))
        return F.transform(rows, lambda r: F.struct(r["k"], r["s"], r["j"], r["w"], r["keep"], r["core"], (r["keep"] & (r["s"] == best)).alias("win")))

    return F.flatten(F.transform(_blocks_of(g, axis), of_block))


def fan_out(voxels: DataFrame, axes: list[Axis], patches: bool = True, limit: int = COVER_ROWS) -> DataFrame:
    """Voxels joined to their blocks (``patches=False``) or to their patches on every axis."""
    spark = voxels.sparkSession
    names = ("k", "s", "j", "w", "keep", "core", "win") if patches else ("k", "core")
    for axis in axes:
        n = axis.name
        if axis.rows <= limit:
            cover = (cover_frame if patches else halo_frame)(spark, axis)
            voxels = voxels.join(F.broadcast(cover), voxels[n] == cover[f"g_{n}"]).drop(f"g_{n}")
        else:
            column = (cover_column if patches else halo_column)(F.col(n), axis)
            voxels = voxels.withColumn("_cover", F.explode(column))
            voxels = voxels.select(*[c for c in voxels.columns if c != "_cover"], *[F.col(f"_cover.{c}").alias(f"{c}_{n}") for c in names])
    return voxels
