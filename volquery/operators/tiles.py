"""Tiles: chunk rows whose voxels are binary, C order, of a stated type (``dtype``, as NumPy names it).

``[keys,] z0, y0, x0, nz, ny, nx, dtype, data``.  They go between Spark and NumPy as Arrow buffers, so a
block of any size is one value, never an array of boxed numbers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNER, SIZE = ("z0", "y0", "x0"), ("nz", "ny", "nx")
BOX = "z0 long, y0 long, x0 long, nz int, ny int, nx int"
TILE = f"{BOX}, dtype string, data binary"
_KEY = ("k_z", "k_y", "k_x")
#: NumPy names of the output types.
TYPES = {"uint8": "|u1", "int8": "|i1", "uint16": "<u2", "int16": "<i2", "uint32": "<u4", "int32": "<i4", "uint64": "<u8", "int64": "<i8", "float32": "<f4", "float64": "<f8"}


def saturated(values: np.ndarray, dtype: str) -> np.ndarray:
    """As ``scalars.saturate``: integers are clipped and cut toward zero, NaN becomes 0."""
    kind = np.dtype(TYPES.get(dtype, dtype))
    if kind.kind == "f":
        return values.astype(kind)
    low, high = np.iinfo(kind).min, np.iinfo(kind).max
    number = np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)
    inside = (number > float(low)) & (number < float(high))
    out = np.where(inside, number, 0.0).astype(kind)
    out[number >= float(high)], out[number <= float(low)] = high, low
    return out


def array_of(row: dict) -> np.ndarray:
    """The voxels of a row of a tile or, where ``data`` is a list, of a chunk."""
    data = row["data"]
    flat = np.frombuffer(data, np.dtype(row["dtype"])) if isinstance(data, bytes) else np.asarray(data, np.float32)
    return flat.reshape([row[n] for n in SIZE])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows as dicts; lists of numbers stay NumPy arrays."""
    names = batch.schema.names
    lists = pa.types.is_list(batch.schema.field("data").type) if "data" in names else False
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in names if n != "data" or not lists}
        if lists:
            row["data"] = batch.column("data")[i].values.to_numpy(zero_copy_only=False)
        yield row


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _kinds(frame: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {frame.schema[k].dataType.simpleString()}, " for k in keys)


def is_binary(frame: DataFrame) -> bool:
    return isinstance(frame.schema["data"].dataType, T.BinaryType)


def to_tiles(voxels: DataFrame, tile: tuple[int, int, int], dtype: str = "<f8", keys: tuple[str, ...] = ("t", "c"), value: str = "p") -> DataFrame:
    """Voxel rows to tiles of at most ``tile`` voxels; what has no row is 0."""
    schema = _kinds(voxels, keys) + TILE

    def put(name: tuple, group: pa.Table) -> pa.Table:
        at = np.stack([group.column(a).to_numpy() for a in "zyx"]).astype(np.int64)
        corner = at.min(axis=1)
        out = np.zeros(at.max(axis=1) - corner + 1, np.dtype(dtype))
        out[tuple(at - corner[:, None])] = saturated(group.column(value).to_numpy().astype(np.float64), dtype)
        row = (*[k.as_py() for k in name[: len(keys)]], *corner.tolist(), *out.shape, dtype, out.tobytes())
        return pa.Table.from_batches([batch_of([row], schema)])

    cells = [F.expr(f"{a} div {n}").alias(k) for a, n, k in zip("zyx", tile, _KEY)]
    return voxels.select(*keys, *cells, "z", "y", "x", value).groupBy(*keys, *_KEY).applyInArrow(put, schema)


def tile_voxels(tiles: DataFrame, value: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, z, y, x, value`` (double) of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(rows_of(batch)):
                voxels = array_of(row)
                at = np.indices(voxels.shape, np.int64).reshape(3, -1)
                named = {k: batch.column(k).take(pa.array(np.full(voxels.size, i))) for k in keys}
                named |= {a: pa.array(at[n] + row[c]) for n, (a, c) in enumerate(zip("zyx", CORNER))}
                yield pa.RecordBatch.from_pydict(named | {value: pa.array(voxels.ravel().astype(np.float64))})

    return tiles.select(*keys, *CORNER, *SIZE, "dtype", "data").mapInArrow(run, f"{_kinds(tiles, keys)}z long, y long, x long, {value} double")


def box_of(chunks: DataFrame, t: int, c: int, box: Sequence[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """The tiles of a box (``[start, stop)`` by axis) of one plane, cut to it.  The filters are on corners,
    which array stores turn into chunk numbers and parquet into row groups: what does not touch the box is
    not read."""
    touching = (F.col("t") == t) & (F.col("c") == c)
    for a, (start, stop) in zip("zyx", box):
        far = F.col(f"{a}1") if f"{a}1" in chunks.columns else F.col(f"{a}0") + F.col(f"n{a}")
        touching &= (F.col(f"{a}0") < stop) & (far > start)
    found = chunks.where(touching)
    schema = _kinds(chunks, keys) + TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                voxels, corner = array_of(row), [row[k] for k in CORNER]
                inside = tuple(slice(max(0, a - o), b - o) for (a, b), o in zip(box, corner))
                part = np.ascontiguousarray(voxels[inside])
                yield batch_of([(*[row[k] for k in keys], *[max(a, o) for (a, _), o in zip(box, corner)], *part.shape, part.dtype.str, part.tobytes())], schema)

    return found.select(*keys, *CORNER, *SIZE, *(["dtype"] if "dtype" in chunks.columns else []), "data").mapInArrow(run, schema)


def _spans(start: int, stop: int, size: int) -> list[tuple[int, int, int]]:
    """Cells of ``size`` that a run touches, with the part of it in each."""
    return [(k, max(start, k * size), min(stop, (k + 1) * size)) for k in range(start // size, (stop - 1) // size + 1)]


def _regrouped(tiles: DataFrame, keys: tuple[str, ...], cut: Callable[[dict], Iterator[tuple]], join: Callable[[pa.Table], tuple], parts: str) -> DataFrame:
    """Tiles cut into parts with the cell of each (``cut``), and put together by cell (``join``)."""
    named = _kinds(tiles, keys)
    dealt, out = f"{named}k_z long, k_y long, k_x long, {parts}", named + TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield batch_of([(*[row[k] for k in keys], *part) for part in cut(row)], dealt)

    def put(name: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch_of([(*[k.as_py() for k in name[: len(keys)]], *join(group))], out)])

    return tiles.select(*keys, *CORNER, *SIZE, "dtype", "data").mapInArrow(run, dealt).groupBy(*keys, *_KEY).applyInArrow(put, out)


def retile(tiles: DataFrame, size: tuple[int, int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """The same voxels in tiles on a grid of ``size``: one shuffle, one tile in memory."""

    def cut(row: dict) -> Iterator[tuple]:
        voxels, corner = array_of(row), [row[k] for k in CORNER]
        for part in itertools.product(*[_spans(o, o + n, s) for o, n, s in zip(corner, voxels.shape, size)]):
            piece = voxels[tuple(slice(a - o, b - o) for (_, a, b), o in zip(part, corner))]
            yield (*[k for k, _, _ in part], *[a for _, a, _ in part], *piece.shape, row["dtype"], piece.tobytes())

    def join(group: pa.Table) -> tuple:
        rows = list(rows_of(group))
        low = [min(r[c] for r in rows) for c in CORNER]
        high = [max(r[c] + r[n] for r in rows) for c, n in zip(CORNER, SIZE)]
        out = np.zeros([b - a for a, b in zip(low, high)], np.dtype(rows[0]["dtype"]))
        for r in rows:
            out[tuple(slice(r[c] - a, r[c] - a + r[n]) for c, n, a in zip(CORNER, SIZE, low))] = array_of(r)
        return (*low, *out.shape, rows[0]["dtype"], out.tobytes())

    return _regrouped(tiles, keys, cut, join, TILE)


def _box_sums(values: np.ndarray, corner: Sequence[int], factors: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the voxels of each box of ``factors`` that a tile touches."""
    sums, counts = values.astype(np.float64), np.ones((1, 1, 1))
    for axis, (o, n, f) in enumerate(zip(corner, values.shape, factors)):
        edges = np.maximum(np.arange(o // f, (o + n - 1) // f + 1) * f - o, 0)
        sums = np.add.reduceat(sums, edges, axis=axis)
        each = np.diff(np.append(edges, n)).astype(np.float64)
        counts = counts * each.reshape([-1 if a == axis else 1 for a in range(3)])
    return sums, counts


def downsample_tiles(tiles: DataFrame, factors: tuple[int, int, int], size: tuple[int, int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """The next pyramid level in tiles of ``size``: means over boxes, border boxes of the voxels they have.
    Tiles give sums and counts of the boxes they touch, so a box may lie across any number of tiles; what
    is shuffled is as large as the result."""

    def cut(row: dict) -> Iterator[tuple]:
        sums, counts = _box_sums(array_of(row), [row[k] for k in CORNER], factors)
        counts = np.broadcast_to(counts, sums.shape)
        corner = [row[k] // f for k, f in zip(CORNER, factors)]
        for part in itertools.product(*[_spans(o, o + n, s) for o, n, s in zip(corner, sums.shape, size)]):
            inside = tuple(slice(a - o, b - o) for (_, a, b), o in zip(part, corner))
            yield (*[k for k, _, _ in part], *[a for _, a, _ in part], *sums[inside].shape, sums[inside].tobytes(), counts[inside].astype(np.int32).tobytes())

    def join(group: pa.Table) -> tuple:
        rows = list(rows_of(group))
        low = [min(r[c] for r in rows) for c in CORNER]
        high = [max(r[c] + r[n] for r in rows) for c, n in zip(CORNER, SIZE)]
        total, count = np.zeros([b - a for a, b in zip(low, high)]), np.zeros([b - a for a, b in zip(low, high)], np.int64)
        for r in sorted(rows, key=lambda r: (r["z0"], r["y0"], r["x0"], r["sums"])):  # sums do not depend on arrival
            place = tuple(slice(r[c] - a, r[c] - a + r[n]) for c, n, a in zip(CORNER, SIZE, low))
            shape = [r[n] for n in SIZE]
            total[place] += np.frombuffer(r["sums"]).reshape(shape)
            count[place] += np.frombuffer(r["counts"], np.int32).reshape(shape)
        return (*low, *total.shape, "<f8", (total / np.maximum(count, 1)).tobytes())

    return _regrouped(tiles, keys, cut, join, f"{BOX}, sums binary, counts binary")


def dividing_levels(tile: Sequence[int], factors: Sequence[Sequence[int]], levels: int) -> int:
    """How many levels have no box across two tiles of a grid of ``tile``."""
    reach = [1, 1, 1]
    for level in range(1, levels):
        reach = [r * f for r, f in zip(reach, factors[min(level - 1, len(factors) - 1)])]
        if any(n % r for n, r in zip(tile, reach)):
            return level - 1
    return levels - 1


def pyramid_in_tiles(tiles: DataFrame, factors: Sequence[Sequence[int]], levels: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``level, keys, TILE``: levels 1 to ``levels`` of tiles that they divide, in one pass and without a shuffle."""
    schema = f"level int, {_kinds(tiles, keys)}{TILE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                voxels, corner = array_of(row), [row[k] for k in CORNER]
                for level in range(1, levels + 1):
                    step = factors[min(level - 1, len(factors) - 1)]
                    sums, counts = _box_sums(voxels, corner, step)
                    voxels, corner = sums / counts, [o // f for o, f in zip(corner, step)]
                    yield batch_of([(level, *[row[k] for k in keys], *corner, *voxels.shape, "<f8", voxels.tobytes())], schema)

    return tiles.select(*keys, *CORNER, *SIZE, "dtype", "data").mapInArrow(run, schema)


def level_shape(shape: Sequence[int], factors: Sequence[Sequence[int]], level: int) -> tuple[int, ...]:
    out = tuple(shape)
    for n in range(1, level + 1):
        out = tuple(math.ceil(s / f) for s, f in zip(out, factors[min(n - 1, len(factors) - 1)]))
    return out
