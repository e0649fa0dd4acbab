"""Voxel rows: statistics, normalisation, models and stitching as DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.scalars import clip, denormalize, normalize, saturate
from .cover import Axis, axes_of, fan_out
from .models import Model
from .quantiles import quantiles

BLOCK = ["k_z", "k_y", "k_x"]
VOXEL = ["z", "y", "x"]


def select_plane(volume: DataFrame, t: int, c: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """One (t, c) plane; the filter reaches the scan, and prunes where t and c partition the files."""
    if shape is not None and not (0 <= t < shape[0] and 0 <= c < shape[1]):
        raise IndexError(f"plane ({t}, {c}) is outside the volume {shape}")
    return volume.where((F.col("t") == t) & (F.col("c") == c)).select("z", "y", "x", F.col("p").cast("double").alias("p"))


def plane_shape(voxels: DataFrame) -> tuple[int, int, int]:
    """Extents of a dense plane that starts at 0."""
    row = voxels.agg(*[F.max(a) for a in VOXEL]).first()
    if row[0] is None:
        raise ValueError("the plane has no voxels")
    return tuple(int(v) + 1 for v in row)


def block_statistics(voxels: DataFrame, axes: list[Axis], lower: float, upper: float) -> DataFrame:
    """``k_z, k_y, k_x, mn, mx, n_voxels``: exact interpolated percentiles over each block with its halo, by
    histograms that are refined: no block's values meet in one place."""
    wide = fan_out(voxels.select(*VOXEL, "p"), axes, patches=False)
    found = quantiles(wide, BLOCK, "p", (lower / 100.0, upper / 100.0))
    return found.select(*BLOCK, F.col("q")[0].alias("mn"), F.col("q")[1].alias("mx"), F.col("n").alias("n_voxels"))


def normalized(rows: DataFrame, voxels: DataFrame, axes: list[Axis], cfg: JobConfig) -> DataFrame:
    """Adds ``mn, mx`` and ``q``, the normalised and clipped value, to rows that carry block keys."""
    if cfg.normalize == "percentile":
        stats = block_statistics(voxels, axes, cfg.norm_lower, cfg.norm_upper).drop("n_voxels")
        rows = rows.join(stats, BLOCK)
        q = normalize(F.col("p"), F.col("mn"), F.col("mx"), cfg.eps)
    elif cfg.normalize == "global":
        low, high = float(cfg.norm_lower), float(cfg.norm_upper)
        rows = rows.withColumns({"mn": F.lit(low), "mx": F.lit(high)})
        q = normalize(clip(F.col("p"), low, high), F.col("mn"), F.col("mx"), cfg.eps)
    else:
        rows = rows.withColumns({"mn": F.lit(0.0), "mx": F.lit(1.0)})
        q = F.col("p")
    bounds = cfg.clip_bounds
    return rows.withColumn("q", clip(q, float(bounds[0]), float(bounds[1])) if bounds else q)


def normalize_blocks(voxels: DataFrame, cfg: JobConfig, shape: tuple[int, int, int]) -> DataFrame:
    """Core voxels with their normalised value: ``z, y, x, k_z, k_y, k_x, p, mn, mx, q``."""
    axes = axes_of(cfg, shape)
    core = fan_out(voxels, axes, patches=False).where("core_z AND core_y AND core_x")
    return normalized(core, voxels, axes, cfg).select(*VOXEL, *BLOCK, "p", "mn", "mx", "q")


def predictions(voxels: DataFrame, cfg: JobConfig, model: Model, shape: tuple[int, int, int]) -> DataFrame:
    """One row for each voxel, block and patch, with ``r0 .. rn`` of the model."""
    if model.expression is None:
        raise TypeError("tensor models run on chunks (operators.tensor)")
    axes = axes_of(cfg, shape)
    rows = normalized(fan_out(voxels, axes), voxels, axes, cfg)
    size = math.prod(cfg.patch)
    outputs = model.expression(F.col("q"), size)
    if cfg.output_denormalize:
        outputs = [denormalize(o, F.col("mn"), F.col("mx"), cfg.eps) for o in outputs]
    return rows.withColumns({f"r{i}": o for i, o in enumerate(outputs)})


def stitch(rows: DataFrame, cfg: JobConfig, channels: int, form: str = "separable") -> DataFrame:
    """Core voxels ``z, y, x, r0 ..``.

    Trimmed seams: of the patches that keep a voxel the one with the greatest start wins.  Kept sets are
    products of axis sets, so the winner is known per axis (``separable``) and needs no shuffle;
    ``max_by`` states the rule directly.  Blended seams: weighted means."""
    core = rows.where("core_z AND core_y AND core_x")
    if cfg.seam_mode == "trim" and form == "separable":
        return core.where("win_z AND win_y AND win_x").select(*VOXEL, *[f"r{i}" for i in range(channels)])
    if cfg.seam_mode == "trim":
        kept = core.where("keep_z AND keep_y AND keep_x")
        order = F.struct("s_z", "s_y", "s_x")
        return kept.groupBy(*VOXEL).agg(*[F.max_by(f"r{i}", order).alias(f"r{i}") for i in range(channels)])
    w = F.col("w_z") * F.col("w_y") * F.col("w_x")
    sums = core.groupBy(*VOXEL).agg(F.sum(w).alias("_w"), *[F.sum(F.col(f"r{i}") * w).alias(f"r{i}") for i in range(channels)])
    return sums.select(*VOXEL, *[(F.col(f"r{i}") / F.greatest(F.col("_w"), F.lit(cfg.eps))).alias(f"r{i}") for i in range(channels)])


def infer(voxels: DataFrame, cfg: JobConfig, model: Model, shape: tuple[int, int, int] | None = None, dtype: str = "float64", form: str = "separable") -> DataFrame:
    """``z, y, x, channel, v``: the whole job on voxel rows.

    Point-wise models under trimmed seams see each core voxel once: the patch fan-out is skipped, since
    every patch would give the same value.  That is a rewrite; ``form`` other than ``separable`` keeps
    the full plan."""
    shape = shape or plane_shape(voxels)
    if model.kind == "pointwise" and cfg.seam_mode == "trim" and form == "separable":
        rows = normalize_blocks(voxels, cfg, shape)
        outputs = model.expression(F.col("q"), math.prod(cfg.patch))
        if cfg.output_denormalize:
            outputs = [denormalize(o, F.col("mn"), F.col("mx"), cfg.eps) for o in outputs]
        out = rows.select(*VOXEL, *[o.alias(f"r{i}") for i, o in enumerate(outputs)])
    else:
        out = stitch(predictions(voxels, cfg, model, shape), cfg, model.channels, form)
    return by_channel(out, model.channels, dtype)


def by_channel(stitched: DataFrame, channels: int, dtype: str = "float64") -> DataFrame:
    """One row for each voxel and channel, cast to the output type."""
    values = F.posexplode(F.array(*[F.col(f"r{i}") for i in range(channels)])).alias("channel", "v")
    return stitched.select(*VOXEL, values).withColumn("v", saturate(F.col("v"), dtype))


def patches_per_block(axes: list[Axis], rows: DataFrame) -> DataFrame:
    """``k_z, k_y, k_x, count``: distinct patches of each block among prediction rows."""
    return rows.groupBy(*BLOCK).agg(F.countDistinct("s_z", "s_y", "s_x").alias("count"))


def downsample(voxels: DataFrame, factors: tuple[int, int, int], value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """The next pyramid level: means over boxes; border boxes average the voxels they have."""
    cells = [F.expr(f"{a} div {int(f)}").alias(a) for a, f in zip(VOXEL, factors)]
    return voxels.groupBy(*keys, *cells).agg(F.avg(value).alias(value))
