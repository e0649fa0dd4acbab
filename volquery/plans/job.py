"""Running a job from a volume to one or more stores."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.grid import throughput_mb_s
from ..functions.scalars import saturate
from ..operators.bricks import TASK_BYTES, infer_bricks, part_for
from ..operators.metadata import image_metadata
from ..operators.models import Model, load_model
from ..operators.tensor import chunk_extents, infer_chunks, infer_tiles, to_chunks, to_voxels
from ..operators.tiles import TYPES, dividing_levels, downsample_tiles, is_binary, level_shape, pyramid_in_tiles, retile, to_tiles
from ..operators.voxels import downsample, infer, plane_shape, select_plane
from ..sources.array_store import Grid, grid_for, read_array, read_grid, write_arrays
from ..sources.json_files import write_json, write_metrics
from ..sources.volumes import array_path, is_chunked, new_grid, open_chunks, open_volume, parse_spec, write_channels

LOG = logging.getLogger(__name__)


@dataclass
class JobResult:
    """``voxels``, ``blocks`` (rows of the result: voxels or blocks) and ``clipped`` (values cut by the output
    type; of chunked jobs) are counted by the job itself, over all channels."""

    seconds: float
    mb_per_second: float
    shape: tuple[int, int, int]
    voxels: int = 0
    blocks: int = 0
    clipped: int = 0


def plan(spark: SparkSession, source: DataFrame, cfg: JobConfig, model: Model, dtype: str = "float32", shape: tuple[int, int, int] | None = None) -> tuple[DataFrame, tuple[int, int, int]]:
    """``z, y, x, channel, v`` of one plane, and its extents.  Models with a column expression run on
    voxel rows, tensor models on chunks of a block each."""
    plane = select_plane(source, cfg.t_idx, cfg.c_idx)
    shape = shape or plane_shape(plane)
    if model.expression is not None:
        return infer(plane, cfg, model, shape, dtype), shape
    chunks = to_chunks(plane.withColumns({"t": F.lit(cfg.t_idx), "c": F.lit(cfg.c_idx)}), cfg.block)
    voxels = to_voxels(infer_chunks(chunks, cfg, model, shape), "v", ("channel",))
    return voxels.select("z", "y", "x", "channel", saturate(F.col("v"), dtype).alias("v")), shape


def plan_chunks(chunks: DataFrame, cfg: JobConfig, model: Model, dtype: str = "float32", shape: tuple[int, int, int] | None = None, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, tuple[int, int, int]]:
    """``channel``, tiles and ``clipped`` of one plane, and its extents: dense blocks in, dense blocks out, with
    any model.  Voxels are never rows; the one shuffle carries the parts of widened blocks.  Blocks of over
    ``task_bytes`` of doubles are worked on in bricks."""
    plane = chunks.where((F.col("t") == cfg.t_idx) & (F.col("c") == cfg.c_idx))
    shape = shape or chunk_extents(plane)
    part = part_for(cfg, model.channels, task_bytes)
    return (infer_bricks(plane, cfg, model, shape, part, dtype) if part else infer_tiles(plane, cfg, model, shape, dtype)), shape


def counted(result: DataFrame) -> tuple[DataFrame, Observation]:
    """The result, and what passes while it is written: voxels, rows and clipped values."""
    seen = Observation("volquery-job")
    tiles = "data" in result.columns
    voxels = F.sum(F.col("nz").cast("long") * F.col("ny") * F.col("nx")) if tiles else F.count("*")
    clipped = F.sum("clipped") if "clipped" in result.columns else F.sum(F.lit(0))
    return result.observe(seen, voxels.alias("voxels"), F.count("*").alias("blocks"), clipped.alias("clipped")).drop("clipped"), seen


def write_result(tiles: DataFrame, specs: list[dict[str, Any]], cfg: JobConfig, shape: tuple[int, int, int], dtype: str, mode: str, part: tuple[int, int, int] | None = None) -> None:
    """Tiles to array stores, channel n to store n.  A store is made if its specification says ``create``, or
    replaced if it says ``delete_existing``; else the plane is written into the one that is there.  Tiles are blocks, or ``part`` of
    them."""
    if len({(bool(s.get("create")), bool(s.get("delete_existing"))) for s in specs}) > 1:
        raise ValueError("the stores of a job are all made, all replaced or all written into")
    first = specs[0]
    paths = [array_path(s) for s in specs]
    making = first.get("create") or first.get("delete_existing") or mode == "overwrite"
    placing = "overwrite" if first.get("delete_existing") or mode == "overwrite" else "create" if making else "update"
    grid = (new_grid(first) or grid_for(shape, tuple(min(64, n) for n in shape), TYPES[dtype])) if making else read_grid(paths[0])
    if grid.shape[2:] != tuple(shape):
        raise ValueError(f"a store of {grid.shape[2:]} voxels cannot hold a plane of {tuple(shape)}")
    if not (cfg.t_idx < grid.shape[0] and cfg.c_idx < grid.shape[1]):
        raise IndexError(f"plane ({cfg.t_idx}, {cfg.c_idx}) is outside the store {grid.shape[:2]}")
    placed = tiles.withColumns({"t": F.lit(cfg.t_idx), "c": F.lit(cfg.c_idx)})
    sides = [(b, n, s) for tile in (cfg.block, part or cfg.block) for b, n, s in zip(tile, grid.chunks[2:], shape)]
    if any(b % n and b < s for b, n, s in sides):
        placed = retile(placed, grid.chunks[2:], ("channel", "t", "c"))
    write_arrays(placed, paths, grid if making else None, placing)


def run(spark: SparkSession, source: DataFrame | str | dict[str, Any], sinks: list[Any] | Any, cfg: JobConfig, model: Model | str, weights: str | None = None, dtype: str = "float32", metrics: str | None = None, mode: str = "errorifexists", itemsize: int = 2, task_bytes: int = TASK_BYTES) -> JobResult:
    """Channel n of the model goes to sink n: a folder of parquet, or an array store by its specification
    (``{"driver": "zarr", ...}``, as a mapping or JSON text).

    Folders take the form of the source: tiles of a chunked volume (array stores, ``"form": "chunks"``), voxel
    rows of any other; array stores take tiles of either.  A failed task fails the job; the number of channels
    is checked before anything is written, and all stores of a job appear together.  Dense blocks of over
    ``task_bytes`` of doubles are worked on in bricks."""
    sinks = [sinks] if isinstance(sinks, (str, dict)) else list(sinks)
    specs = [parse_spec(spark, s) if isinstance(s, dict) or s.lstrip()[:1] == "{" else {"path": s} for s in sinks]
    model = load_model(model, weights, spark) if isinstance(model, str) else model
    if model.channels != len(specs):
        raise ValueError(f"the model has {model.channels} channels, the job names {len(specs)} stores")
    arrays = [bool(array_path(s)) for s in specs]
    if any(arrays) != all(arrays):
        raise ValueError("the stores of a job are all arrays or all folders")
    started = time.perf_counter()
    source = source if isinstance(source, DataFrame) else parse_spec(spark, source)
    if isinstance(source, dict) and is_chunked(source):
        chunks, stated = open_chunks(spark, source)
        result, shape = plan_chunks(chunks, cfg, model, dtype, stated, task_bytes)
    else:
        volume = source if isinstance(source, DataFrame) else open_volume(spark, source)
        if all(arrays):
            plane = volume.where((F.col("t") == cfg.t_idx) & (F.col("c") == cfg.c_idx))
            result, shape = plan_chunks(to_tiles(plane, part_for(cfg, model.channels, task_bytes) or cfg.block), cfg, model, dtype, task_bytes=task_bytes)
        else:
            result, shape = plan(spark, volume, cfg, model, dtype)
    result, seen = counted(result)
    if all(arrays):
        write_result(result, specs, cfg, shape, dtype, mode, part_for(cfg, model.channels, task_bytes))
    elif len(specs) > 1:
        write_channels(result, [s["path"] for s in specs], mode)
    else:
        result.drop("channel").write.mode(mode).parquet(specs[0]["path"])
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    seconds = time.perf_counter() - started
    rate = throughput_mb_s(shape, itemsize, seconds)
    LOG.info("%s voxels in %.2f s: %.2f MB/s; %s", shape, seconds, rate, counts)
    if metrics:
        write_metrics(spark, metrics, {}, {"seconds": [seconds], "mb_per_second": [rate]} | {k: [v] for k, v in counts.items()})
    return JobResult(seconds, rate, shape, **counts)


def build_pyramid(spark: SparkSession, store: str, root: str, name: str, factors: list[tuple[int, int, int]], levels: int, voxel: tuple[float, float, float], chunk: tuple[int, int, int, int, int] = (1, 1, 64, 64, 64)) -> dict[str, Any]:
    """Mean pyramid of a written store, each level from the one before, with its attributes."""
    base = spark.read.parquet(store)
    if "data" in base.columns:
        return _build_from_tiles(spark, base, root, name, factors, levels, voxel, chunk)
    shape = (1, 1, *plane_shape(base))
    attributes = image_metadata(name, levels, factors, voxel, shape, chunk)
    current = base
    for level in range(1, levels):
        step = downsample(current, factors[min(level - 1, len(factors) - 1)])
        step.write.mode("overwrite").parquet(f"{root}/{level}")
        current = spark.read.parquet(f"{root}/{level}")
    write_json(spark, f"{root}/.zattrs", attributes)
    return attributes


def _build_from_tiles(spark: SparkSession, base: DataFrame, root: str, name: str, factors: list[tuple[int, int, int]], levels: int, voxel: tuple[float, float, float], chunk: tuple[int, ...]) -> dict[str, Any]:
    """The pyramid of a store of blocks: blocks in, blocks out."""
    shape = chunk_extents(base)
    base = base if is_binary(base) else to_tiles(to_voxels(base, "v"), chunk[2:], keys=(), value="v")
    attributes = image_metadata(name, levels, factors, voxel, (1, 1, *shape), chunk)
    tile = tuple(int(n) for n in base.agg(*[F.max(f"n{a}") for a in "zyx"]).first())
    # tiles of one grid, as jobs write them, start at multiples of their size
    aligned = base.where(" OR ".join(f"{a}0 % {n} <> 0" for a, n in zip("zyx", tile))).isEmpty()
    whole = dividing_levels(tile, factors, levels) if aligned else 0
    if whole:
        # one pass: every level that divides a tile goes to its folder
        every = pyramid_in_tiles(base, factors, whole)
        write_channels(every.withColumn("channel", F.col("level") - 1).drop("level"), [f"{root}/{n}" for n in range(1, whole + 1)], "overwrite")
    for level in range(whole + 1, levels):
        current = spark.read.parquet(f"{root}/{level - 1}") if level > 1 else base
        downsample_tiles(current, factors[min(level - 1, len(factors) - 1)], tile).write.mode("overwrite").parquet(f"{root}/{level}")
    write_json(spark, f"{root}/.zattrs", attributes)
    return attributes


def build_array_pyramid(spark: SparkSession, root: str, name: str, factors: list[tuple[int, int, int]], levels: int, voxel: tuple[float, float, float], t: int = 0, c: int = 0) -> dict[str, Any]:
    """Levels 1 .. of the array store ``root/0``, as arrays of its chunks and type, and the attributes of the group."""
    base = read_grid(f"{root}/0")
    chunks = base.chunks[2:]
    attributes = image_metadata(name, levels, factors, voxel, base.shape, base.chunks)
    for level in range(1, levels):
        above = read_array(spark, f"{root}/{level - 1}").where((F.col("t") == t) & (F.col("c") == c))
        step = downsample_tiles(above, factors[min(level - 1, len(factors) - 1)], chunks)
        grid = Grid((*base.shape[:2], *level_shape(base.shape[2:], factors, level)), base.chunks, "<f8", 5, {"id": "zstd", "level": 3})
        write_arrays(step.withColumns({"t": F.lit(t), "c": F.lit(c)}), [f"{root}/{level}"], grid, "overwrite")
    write_json(spark, f"{root}/.zattrs", attributes)
    return attributes
