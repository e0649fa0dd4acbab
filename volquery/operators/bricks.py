"""Blocks beyond a task's memory: bricks of patches, and cells of partial sums.

The patches of a block are dealt to bricks, runs of neighbouring patches on each axis that span at most
``part`` voxels (one patch where that is larger).  A task holds one brick: its voxels, and the sums of what
the model makes of its patches.  The sums are cut into cells of ``part`` voxels of the block's core; a second
grouping adds the bricks that reach into a cell.  Weights are products of the axes' weights, so they are
computed, not shuffled.  Under trimmed seams each voxel has one brick, that of the patch with the last word.
Percentiles of the widened block come from refined histograms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig, Triple
from ..functions.grid import AxisBlock, Span, ceil_div
from .models import Model
from .quantiles import quantiles
from .tensor import OUT_TILES, axis_block, axis_patches, block_parts, scaled, stitched
from .tiles import BOX, CORNER, SIZE, TILE, array_of, batch_of, is_binary, rows_of, saturated

#: Bytes of doubles that a task may hold for a whole widened block.
TASK_BYTES = 1 << 30
_BLOCK, _BRICK, _CELL = ("k_z", "k_y", "k_x"), ("b_z", "b_y", "b_x"), ("c_z", "c_y", "c_x")
_INTS = {names: ", ".join(f"{n} int" for n in names) for names in (_BLOCK, _BRICK, _CELL)}
_PARTS = f"{_INTS[_BLOCK]}, {_INTS[_BRICK]}, {TILE}"
_SUMS = f"channel int, {_INTS[_BLOCK]}, {_INTS[_CELL]}, {_INTS[_BRICK]}, {BOX}, sums binary"
_VALUES = 1 << 18


class Brick(NamedTuple):
    """Neighbouring patches on one axis: the voxels they read and give (of the volume), and the patches,
    with starts inside the brick."""

    reads: Span
    gives: Span
    patches: list[tuple[int, int, Span, np.ndarray]]


class AxisBricks(NamedTuple):
    block: AxisBlock
    bricks: list[Brick]
    cells: list[Span]
    weight: np.ndarray


def task_bytes_of(sides: Triple, channels: int) -> int:
    """Bytes of doubles of a task: voxels in two forms, weights, and each channel's sums."""
    return 8 * math.prod(sides) * (3 + channels)


def part_for(cfg: JobConfig, channels: int, task_bytes: int = TASK_BYTES) -> Triple | None:
    """Largest part, by halving the block's longest side, that fits a task; none if the whole block fits.
    A part is never smaller than a patch."""
    if task_bytes_of(tuple(b + 2 * cfg.halo for b in cfg.block), channels) <= task_bytes:
        return None
    part = list(cfg.block)
    while task_bytes_of(tuple(part), channels) > task_bytes:
        free = [a for a in range(3) if ceil_div(part[a], 2) >= cfg.patch[a]]
        if not free:
            break
        longest = max(free, key=lambda a: part[a])
        part[longest] = ceil_div(part[longest], 2)
    return tuple(part)


def axis_bricks(axis: int, k: int, cfg: JobConfig, shape: Triple, part: int) -> AxisBricks:
    """A block's bricks and cells along one axis."""
    block = axis_block(axis, k, cfg, shape)
    origin, length = block.wide.start, block.length
    patches = axis_patches(length, axis, cfg)
    weight = np.ones(length)
    if cfg.seam_mode == "trim":
        # the last word on a voxel is that of the patch that starts furthest on
        ends = [s + kept.start for s, _, kept, _ in patches[1:]] + [length]
        patches = [(s, v, Span(kept.start, min(kept.stop, end - s)), ramp) for (s, v, kept, ramp), end in zip(patches, ends)]
    else:
        weight[:] = 0.0
        for s, v, _, ramp in patches:
            weight[s : s + v] += ramp
    runs: list[list] = []
    for entry in patches:
        if not runs or entry[0] + entry[1] - runs[-1][0][0] > part:
            runs.append([])
        runs[-1].append(entry)
    bricks = []
    for run in runs:
        first, last = run[0], run[-1]
        reads = Span(origin + first[0], origin + last[0] + last[1])
        gives = Span(reads.start + first[2].start, origin + last[0] + last[2].stop) if cfg.seam_mode == "trim" else reads
        gives = Span(max(gives.start, block.core.start), min(gives.stop, block.core.stop))
        bricks.append(Brick(reads, gives, [(s - first[0], v, kept, ramp) for s, v, kept, ramp in run]))
    cells = [Span(at, min(at + part, block.core.stop)) for at in range(block.core.start, block.core.stop, part)]
    return AxisBricks(block, bricks, cells, weight[block.core.start - origin : block.core.stop - origin])


def _axes(cfg: JobConfig, shape: Triple, part: Triple) -> Callable[[int, int], AxisBricks]:
    """``axis_bricks`` of one task, each computed once."""
    known: dict[tuple[int, int], AxisBricks] = {}

    def of(axis: int, k: int) -> AxisBricks:
        if (axis, k) not in known:
            known[axis, k] = axis_bricks(axis, k, cfg, shape, part[axis])
        return known[axis, k]

    return of


def _meet(a: Span, b: Span) -> Span:
    return Span(max(a.start, b.start), min(a.stop, b.stop))


def brick_parts(chunks: DataFrame, cfg: JobConfig, shape: Triple, part: Triple) -> DataFrame:
    """Block, brick and TILE: each chunk cut into the parts that bricks read."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _axes(cfg, shape, part)

        def touching(axis: int, run: Span) -> list[tuple[int, int, Span]]:
            b, h = cfg.block[axis], cfg.halo
            blocks = range(max(0, (run.start - h) // b), min(ceil_div(shape[axis], b) - 1, (run.stop - 1 + h) // b) + 1)
            met = [(k, i, _meet(run, brick.reads)) for k in blocks for i, brick in enumerate(of(axis, k).bricks)]
            return [m for m in met if m[2].start < m[2].stop]

        for batch in batches:
            for row in rows_of(batch):
                data, origin = array_of(row), [row[c] for c in CORNER]
                for met in itertools.product(*(touching(a, Span(o, o + n)) for a, (o, n) in enumerate(zip(origin, data.shape)))):
                    piece = data[tuple(slice(m[2].start - o, m[2].stop - o) for m, o in zip(met, origin))]
                    named = (*[m[0] for m in met], *[m[1] for m in met], *[m[2].start for m in met])
                    yield batch_of([(*named, *piece.shape, piece.dtype.str, piece.tobytes())], _PARTS)

    columns = [*CORNER, *SIZE, *(["dtype"] if is_binary(chunks) else []), "data"]
    return chunks.select(*columns).mapInArrow(split, _PARTS)


def brick_bounds(chunks: DataFrame, cfg: JobConfig, shape: Triple, part: Triple) -> DataFrame:
    """Block, brick, ``low`` and ``high``: the percentiles of each widened block, once for each of its bricks."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                flat = array_of(row).ravel()
                for at in range(0, len(flat), _VALUES):
                    piece = flat[at : at + _VALUES].astype(np.float64)
                    named = {k: pa.array(np.full(len(piece), row[k], np.int32)) for k in _BLOCK}
                    yield pa.RecordBatch.from_pydict(named | {"p": pa.array(piece)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _axes(cfg, shape, part)
        for batch in batches:
            for *k, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = itertools.product(*(range(len(of(a, n).bricks)) for a, n in enumerate(k)))
                yield batch_of([(*k, *b, low, high) for b in numbers], f"{_INTS[_BLOCK]}, {_INTS[_BRICK]}, low double, high double")

    rows = block_parts(chunks, cfg, shape).mapInArrow(values, f"{_INTS[_BLOCK]}, p double")
    found = quantiles(rows, _BLOCK, "p", (cfg.norm_lower / 100, cfg.norm_upper / 100))
    bounds = found.select(*_BLOCK, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return bounds.mapInArrow(each, f"{_INTS[_BLOCK]}, {_INTS[_BRICK]}, low double, high double")


def infer_bricks(chunks: DataFrame, cfg: JobConfig, model: Model, shape: Triple, part: Triple, dtype: str = "float32") -> DataFrame:
    """The rows of ``infer_tiles`` (``channel``, TILE, ``clipped``) in cells of ``part``, of blocks of any size.

    Equal to whole blocks but for the rounding of sums.  Chunks or tiles must cover the plane once: a brick
    with voxels missing fails the job.  Voxels must be finite where percentiles are taken; no chunks give no
    rows."""
    percentile = cfg.normalize == "percentile"

    def solve(name: tuple, group: pa.Table) -> pa.Table:
        k, b = [v.as_py() for v in name[:3]], [v.as_py() for v in name[3:]]
        of = _axes(cfg, shape, part)
        axes = [of(a, n) for a, n in enumerate(k)]
        bricks = [axis.bricks[n] for axis, n in zip(axes, b)]
        volume, filled = np.zeros([x.reads.stop - x.reads.start for x in bricks]), 0
        for row in rows_of(group):
            piece = array_of(row)
            volume[tuple(slice(row[c] - x.reads.start, row[c] - x.reads.start + n) for c, n, x in zip(CORNER, piece.shape, bricks))] = piece
            filled += piece.size
        if filled != volume.size:
            raise ValueError(f"brick {b} of block {k} has {filled} of {volume.size} voxels")
        bounds = (group.column("low")[0].as_py(), group.column("high")[0].as_py()) if percentile else None
        value, low, scale = scaled(volume, cfg, bounds)
        del volume
        total, _ = stitched(value, [x.patches for x in bricks], cfg, model, low, scale)
        rows = []
        for cells in itertools.product(*(enumerate(axis.cells) for axis in axes)):
            met = [_meet(span, x.gives) for (_, span), x in zip(cells, bricks)]
            if any(m.start >= m.stop for m in met):
                continue
            inside = tuple(slice(m.start - x.reads.start, m.stop - x.reads.start) for m, x in zip(met, bricks))
            for channel, values in enumerate(total):
                piece = values[inside]
                rows.append((channel, *k, *[n for n, _ in cells], *b, *[m.start for m in met], *piece.shape, piece.tobytes()))
        return pa.Table.from_batches([batch_of(rows, _SUMS)])

    def add(name: tuple, group: pa.Table) -> pa.Table:
        channel, *rest = (v.as_py() for v in name)
        of = _axes(cfg, shape, part)
        axes = [of(a, n) for a, n in enumerate(rest[:3])]
        cell = [axis.cells[n] for axis, n in zip(axes, rest[3:])]
        wanted = math.prod(sum(1 for x in axis.bricks if max(x.gives.start, span.start) < min(x.gives.stop, span.stop)) for axis, span in zip(axes, cell))
        if group.num_rows != wanted:
            raise ValueError(f"cell {rest[3:]} of block {rest[:3]} has {group.num_rows} of {wanted} bricks")
        total = np.zeros([c.stop - c.start for c in cell])
        for row in rows_of(group.sort_by([(n, "ascending") for n in _BRICK])):  # sums do not depend on arrival
            place = tuple(slice(row[c] - x.start, row[c] - x.start + row[n]) for c, n, x in zip(CORNER, SIZE, cell))
            total[place] += np.frombuffer(row["sums"]).reshape([row[n] for n in SIZE])
        w = [axis.weight[c.start - axis.block.core.start : c.stop - axis.block.core.start] for axis, c in zip(axes, cell)]
        total /= np.maximum(w[0][:, None, None] * w[1][None, :, None] * w[2][None, None, :], cfg.eps)
        out = saturated(total, dtype)
        cut = 0 if out.dtype.kind == "f" else int(((total < np.iinfo(out.dtype).min) | (total > np.iinfo(out.dtype).max)).sum())
        return pa.Table.from_batches([batch_of([(channel, *[c.start for c in cell], *out.shape, out.dtype.str, out.tobytes(), cut)], OUT_TILES)])

    parts = brick_parts(chunks, cfg, shape, part)
    if percentile:
        # the bounds grow with the blocks: joined on the grouping's keys, so that voxels are shuffled once
        parts = parts.join(brick_bounds(chunks, cfg, shape, part).hint("merge"), [*_BLOCK, *_BRICK])
    sums = parts.groupBy(*_BLOCK, *_BRICK).applyInArrow(solve, _SUMS)
    return sums.groupBy("channel", *_BLOCK, *_CELL).applyInArrow(add, OUT_TILES)
