"""Chunk rows: whole jobs on dense blocks, one shuffle, any model.

A chunk row holds a dense box of a plane.  Each chunk is cut into the parts that neighbouring widened
blocks need; a block is then put together, normalised, tiled, run in batches and stitched in one task.
A task's memory is one widened block, whatever the volume.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.grid import AxisBlock, Span, axis_starts, blend_ramp, kept_span, valid_size
from .models import Model
from .tiles import TILE, array_of, batch_of, is_binary, rows_of, saturated, tile_voxels

CHUNK_SCHEMA = "t int, c int, z0 long, y0 long, x0 long, nz int, ny int, nx int, data array<float>"
OUT_SCHEMA = "channel int, z0 long, y0 long, x0 long, nz int, ny int, nx int, data array<double>"
_PART_SCHEMA = f"k_z int, k_y int, k_x int, {TILE}"
OUT_TILES = f"channel int, {TILE}, clipped long"


def to_chunks(voxels: DataFrame, chunk: tuple[int, int, int], keys: tuple[str, ...] = ("t", "c")) -> DataFrame:
    """Voxel rows to chunk rows (dense boxes only; a chunk is bounded, so is each group)."""
    cells = [F.expr(f"{a} div {n}").alias(f"c_{a}") for a, n in zip("zyx", chunk)]
    grouped = voxels.groupBy(*keys, *cells).agg(
        F.sort_array(F.collect_list(F.struct("z", "y", "x", F.col("p").cast("float").alias("p")))).alias("v"), *[F.min(a).alias(f"{a}0") for a in "zyx"], *[(F.max(a) - F.min(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"]
    )
    return grouped.select(*keys, "z0", "y0", "x0", "nz", "ny", "nx", F.transform("v", lambda s: s["p"]).alias("data"))


def to_voxels(chunks: DataFrame, value: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows or tiles to voxel rows."""
    if is_binary(chunks):
        return tile_voxels(chunks, value, keys)
    each = chunks.select(*keys, "z0", "y0", "x0", "ny", "nx", F.posexplode("data").alias("i", value))
    return each.select(
        *keys, (F.col("z0") + F.expr("i div (ny * nx)")).alias("z"), (F.col("y0") + F.expr("(i div nx) % ny")).alias("y"), (F.col("x0") + F.expr("i % nx")).alias("x"), value
    )


def chunk_extents(chunks: DataFrame) -> tuple[int, int, int]:
    """Extents of a dense plane of chunks that starts at 0, from their corners alone."""
    row = chunks.agg(*[F.max(F.col(f"{a}0") + F.col(f"n{a}")) for a in "zyx"]).first()
    if row[0] is None:
        raise ValueError("the plane has no chunks")
    return tuple(int(v) for v in row)


def scaled(value: np.ndarray, cfg: JobConfig, bounds: tuple[float, float] | None) -> tuple[np.ndarray, float, float]:
    """Normalised voxels, and the offset and scale that take a result back; ``bounds`` are the block's percentiles."""
    low, high = bounds or (0.0, 1.0)
    if cfg.normalize == "global":
        low, high = float(cfg.norm_lower), float(cfg.norm_upper)
        value = np.clip(value, low, high)
    scale = max(high - low, cfg.eps) if cfg.normalize in ("percentile", "global") else 1.0
    value = (value - low) / scale
    if cfg.clip_bounds:
        value = np.clip(value, *cfg.clip_bounds)
    return value, low, scale


def axis_patches(length: int, axis: int, cfg: JobConfig) -> list[tuple[int, int, Span, np.ndarray]]:
    """Start, valid size, kept offsets and weights of a block's patches along one axis."""
    entries = []
    for s in axis_starts(length, cfg.patch[axis], cfg.overlap):
        v = valid_size(s, cfg.patch[axis], length)
        entries.append((s, v, kept_span(s, v, length, cfg.trim_voxels or 0), blend_ramp(s, v, length, cfg.overlap, cfg.min_blend_weight)))
    return entries


def stitched(value: np.ndarray, per_axis: list[list[tuple]], cfg: JobConfig, model: Model, low: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The model's patches put together: sums by channel, and weights.  Starts are offsets in ``value``."""
    shape = value.shape
    total, weight = np.zeros((model.channels, *shape)), np.zeros(shape)
    todo = list(itertools.product(*per_axis))
    for at in range(0, len(todo), cfg.batch_size):
        part = todo[at : at + cfg.batch_size]
        batch = np.zeros((len(part), 1, *cfg.patch))
        for i, axes in enumerate(part):
            batch[(i, 0, *[slice(0, v) for _, v, _, _ in axes])] = value[tuple(slice(s, s + v) for s, v, _, _ in axes)]
        result = np.asarray(model.tensor(batch), dtype=np.float64)
        if result.ndim == 4:
            result = result[:, None]
        if result.ndim != 5 or result.shape[1] != model.channels:
            raise ValueError(f"model output {result.shape} does not match {model.channels} channels")
        if cfg.output_denormalize:
            result = result * scale + low
        for i, axes in enumerate(part):
            if cfg.seam_mode == "trim":
                inside = tuple(slice(k.start, k.stop) for _, _, k, _ in axes)
                place = tuple(slice(s + k.start, s + k.stop) for s, _, k, _ in axes)
                total[(slice(None), *place)] = result[(i, slice(None), *inside)]
                weight[place] = 1.0
            else:
                w = axes[0][3][:, None, None] * axes[1][3][None, :, None] * axes[2][3][None, None, :]
                place = tuple(slice(s, s + v) for s, v, _, _ in axes)
                total[(slice(None), *place)] += result[(i, slice(None), *[slice(0, v) for _, v, _, _ in axes])] * w
                weight[place] += w
    return total, weight


def run_block(volume: np.ndarray, cores: tuple, wides: tuple, cfg: JobConfig, model: Model) -> np.ndarray:
    """``(channels, z, y, x)`` of a block's core from its widened voxels.

    Statistics are those of the widened block in double; patches that reach beyond it are filled with
    zeros; equal starts win by order, so results do not depend on batches."""
    value = volume.astype(np.float64)
    bounds = tuple(float(x) for x in np.percentile(value, [cfg.norm_lower, cfg.norm_upper])) if cfg.normalize == "percentile" else None
    value, low, scale = scaled(value, cfg, bounds)
    per_axis = [axis_patches(length, axis, cfg) for axis, length in enumerate(value.shape)]
    total, weight = stitched(value, per_axis, cfg, model, low, scale)
    total /= np.maximum(weight, cfg.eps)
    crop = tuple(slice(c.start - w.start, c.stop - w.start) for c, w in zip(cores, wides))
    return total[(slice(None), *crop)]


def axis_block(axis: int, k: int, cfg: JobConfig, shape: tuple[int, int, int]) -> AxisBlock:
    """A block's core and widened core along one axis."""
    n, b, h = shape[axis], cfg.block[axis], cfg.halo
    core = (k * b, min(n, (k + 1) * b))
    return AxisBlock(k, Span(*core), Span(max(0, core[0] - h), min(n, core[1] + h)))


def block_parts(chunks: DataFrame, cfg: JobConfig, shape: tuple[int, int, int]) -> DataFrame:
    """``k_z, k_y, k_x`` and TILE: each chunk cut into the parts that widened blocks need."""

    def touching(axis: int, start: int, size: int) -> list[tuple[int, int, int]]:
        n, b, h = shape[axis], cfg.block[axis], cfg.halo
        first, last = max(0, (start - h) // b), min(-(-n // b) - 1, (start + size - 1 + h) // b)
        blocks = [axis_block(axis, k, cfg, shape) for k in range(first, last + 1)]
        return [(x.k, max(start, x.wide.start), min(start + size, x.wide.stop)) for x in blocks if x.wide.start < start + size and start < x.wide.stop]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                data, origin = array_of(row), (row["z0"], row["y0"], row["x0"])
                for parts in itertools.product(*(touching(a, origin[a], data.shape[a]) for a in range(3))):
                    piece = data[tuple(slice(lo - o, hi - o) for (_, lo, hi), o in zip(parts, origin))]
                    yield batch_of([(*[k for k, _, _ in parts], *[lo for _, lo, _ in parts], *piece.shape, piece.dtype.str, piece.tobytes())], _PART_SCHEMA)

    columns = ["z0", "y0", "x0", "nz", "ny", "nx", *(["dtype"] if is_binary(chunks) else []), "data"]
    return chunks.select(*columns).mapInArrow(split, _PART_SCHEMA)


def infer_tiles(chunks: DataFrame, cfg: JobConfig, model: Model, shape: tuple[int, int, int], dtype: str = "float32") -> DataFrame:
    """``channel``, TILE and ``clipped``: the block cores of one plane's chunks or tiles, of the output type;
    ``clipped`` counts the values beyond its range.  Blocks are Arrow buffers from end to end."""

    def solve(name: tuple, group: pa.Table) -> pa.Table:
        blocks = [axis_block(a, k.as_py(), cfg, shape) for a, k in enumerate(name)]
        volume = None
        for row in rows_of(group):
            part = array_of(row)
            volume = np.zeros([b.wide.stop - b.wide.start for b in blocks], part.dtype) if volume is None else volume
            volume[tuple(slice(o - b.wide.start, o - b.wide.start + n) for o, n, b in zip((row["z0"], row["y0"], row["x0"]), part.shape, blocks))] = part
        result = run_block(volume, tuple(b.core for b in blocks), tuple(b.wide for b in blocks), cfg, model)
        rows = []
        for i, values in enumerate(result):
            out = saturated(values, dtype)
            cut = 0 if out.dtype.kind == "f" else int(((values < np.iinfo(out.dtype).min) | (values > np.iinfo(out.dtype).max)).sum())
            rows.append((i, *[b.core.start for b in blocks], *out.shape, out.dtype.str, out.tobytes(), cut))
        return pa.Table.from_batches([batch_of(rows, OUT_TILES)])

    return block_parts(chunks, cfg, shape).groupBy("k_z", "k_y", "k_x").applyInArrow(solve, OUT_TILES)


def infer_chunks(chunks: DataFrame, cfg: JobConfig, model: Model, shape: tuple[int, int, int]) -> DataFrame:
    """The same as rows with a list of doubles: ``channel, z0, y0, x0, nz, ny, nx, data``."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v.as_buffer(), np.float64) for v in batch.column("data")]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    tiles = infer_tiles(chunks, cfg, model, shape, "float64")
    return tiles.select("channel", "z0", "y0", "x0", "nz", "ny", "nx", "data").mapInArrow(listed, OUT_SCHEMA)
