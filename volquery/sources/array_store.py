"""Chunk-grid array stores (Zarr version 2 layout) as a Spark data source.

An array is a folder with a JSON header and one file for each chunk; a chunk that has no file holds the
fill value.  The reader plans its partitions from the header alone, as ranges of chunk numbers: nothing is
listed.  Filters on ``t, c`` and on the corners of boxes become ranges of chunk indices, so chunks outside
them are never opened.  The writer puts chunks in a staging folder beside each store, and publishes all
stores or none once every chunk of every plane written is there.

Folders are reached by ``pyarrow.fs`` (paths, and the URIs it knows), on the driver and on executors: they
must share them.
"""

from __future__ import annotations

import bz2
import gzip
import itertools
import json
import lzma
import math
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "chunkgrid"
#: One row for each plane of a chunk: corner, size, far corner, and voxels in C order of type ``dtype``.
SCHEMA = "t int, c int, z0 long, y0 long, x0 long, nz int, ny int, nx int, z1 long, y1 long, x1 long, dtype string, data binary"
AXES = ("t", "c", "z", "y", "x")
HEADER = ".zarray"
#: Bytes of voxels read by a task.
TASK_BYTES = 64 << 20
#: Codec numbers of a Blosc frame (its flags' highest three bits).  Fixed values.
BLOSC_CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _files(path: str) -> tuple[fs.FileSystem, str]:
    for hadoop, own in (("s3a://", "s3://"), ("file:///", "/"), ("file:/", "/")):
        if path.startswith(hadoop):
            path = own + path[len(hadoop) :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(files: fs.FileSystem, path: str) -> bytes | None:
    try:
        with files.open_input_stream(path, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def _write(files: fs.FileSystem, path: str, data: bytes) -> None:
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path, compression=None) as stream:
        stream.write(data)


def put_file(path: str, data: bytes) -> None:
    files, inner = _files(path)
    _write(files, inner, data)


def blosc_decode(frame: bytes) -> bytes:
    """The bytes of a Blosc (version 1) frame whose codec is one of BLOSC_CODECS, shuffled by bytes or not."""
    flags, width = frame[2], frame[3]
    size, block, _ = np.frombuffer(frame, "<u4", 3, 4).tolist()
    if flags & 2:  # stored
        return frame[16 : 16 + size]
    if flags & 4:
        raise ValueError("bit-shuffled chunks are not supported")
    if flags >> 5 not in BLOSC_CODECS:
        raise ValueError(f"no codec for number {flags >> 5} of a Blosc frame")
    codec = BLOSC_CODECS[flags >> 5]
    out = bytearray()
    for start, at in zip(range(0, size, block), np.frombuffer(frame, "<u4", -(-size // block), 16).tolist()):
        length = min(block, size - start)
        # whole blocks are split in one stream for each byte of a value, unless the flag says they are not
        streams = width if not flags & 16 and length == block and length % width == 0 else 1
        parts = []
        for _ in range(streams):
            packed = int.from_bytes(frame[at : at + 4], "little")
            data, at = frame[at + 4 : at + 4 + packed], at + 4 + packed
            plain = length // streams
            parts.append(data if packed == plain else zlib.decompress(data) if codec == "zlib" else pa.Codec(codec).decompress(data, plain, asbytes=True))
        whole = b"".join(parts)
        if flags & 1 and width > 1:
            body = length - length % width
            whole = np.frombuffer(whole[:body], np.uint8).reshape(width, -1).T.tobytes() + whole[body:]
        out += whole
    return bytes(out)


def decode(data: bytes, compressor: dict[str, Any] | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    readers = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "blosc": blosc_decode}
    if kind not in readers:
        raise ValueError(f"no reader for chunks compressed by {kind!r}; there are: {', '.join(k for k in readers if k)}, zstd")
    return readers[kind](data)


def encode(data: bytes, compressor: dict[str, Any] | None) -> bytes:
    kind = compressor["id"] if compressor else None
    level = (compressor or {}).get("level", 5)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    writers = {None: bytes, "zlib": lambda d: zlib.compress(d, level), "gzip": lambda d: gzip.compress(d, level, mtime=0), "bz2": lambda d: bz2.compress(d, max(1, level))}
    if kind not in writers:
        raise ValueError(f"no writer for chunks compressed by {kind!r}; there are: {', '.join(k for k in writers if k)}, zstd")
    return writers[kind](data)


@dataclass(frozen=True)
class Grid:
    """What a header says.  ``shape`` and ``chunks`` have five axes; arrays of fewer get leading ones."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    axes: int = 5
    compressor: dict[str, Any] | None = None
    fill: Any = 0
    order: str = "C"
    separator: str = "."

    @classmethod
    def parse(cls, body: bytes) -> Grid:
        head = json.loads(body)
        if head.get("zarr_format") != 2 or head.get("filters"):
            raise ValueError("only arrays of format 2 without filters can be read")
        n = len(head["shape"])
        if not 1 <= n <= 5 or len(head["chunks"]) != n:
            raise ValueError(f"an array of {n} axes is no volume")
        lead = (1,) * (5 - n)
        fill = head.get("fill_value")
        return cls(lead + tuple(head["shape"]), lead + tuple(head["chunks"]), head["dtype"], n, head.get("compressor"), 0 if fill is None else fill, head.get("order", "C"), head.get("dimension_separator", "."))

    def header(self) -> bytes:
        lead = 5 - self.axes
        head = {"zarr_format": 2, "shape": self.shape[lead:], "chunks": self.chunks[lead:], "dtype": self.dtype, "compressor": self.compressor, "fill_value": self.fill, "order": self.order, "filters": None, "dimension_separator": self.separator}
        return json.dumps(head, indent=1).encode()

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    @property
    def chunk_bytes(self) -> int:
        return math.prod(self.chunks) * np.dtype(self.dtype).itemsize

    def key(self, index: Sequence[int]) -> str:
        return self.separator.join(map(str, index[5 - self.axes :]))

    def empty(self, shape: Sequence[int]) -> np.ndarray:
        return np.full(shape, float(self.fill) if isinstance(self.fill, str) else self.fill, np.dtype(self.dtype))

    def decoded(self, data: bytes | None) -> np.ndarray:
        if data is None:
            return self.empty(self.chunks)
        return np.frombuffer(decode(data, self.compressor), np.dtype(self.dtype)).reshape(self.chunks, order=self.order)

    def encoded(self, chunk: np.ndarray) -> bytes:
        return encode(chunk.tobytes(order=self.order), self.compressor)


def read_grid(path: str) -> Grid:
    files, root = _files(path)
    body = _read(files, f"{root}/{HEADER}")
    if body is None:
        raise FileNotFoundError(f"{path}/{HEADER}")
    return Grid.parse(body)


@dataclass
class Chunks(InputPartition):
    """A run of chunk numbers of a box of the grid."""

    start: int
    stop: int


class GridReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes
        self.grid = read_grid(path)
        self.box = [[0, n] for n in self.grid.counts]  # chunk indices

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the box.  All filters are applied again to the rows, so a box may be too large, never too small."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            axis = AXES.index(name[0]) if name and name[0] in AXES and name[1:] in ("", "0", "1") else None
            if axis is not None:
                values = [f.value] if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) else list(f.value) if isinstance(f, In) else []
                if values and all(isinstance(v, int) for v in values):
                    self._narrow(axis, name[1:], f, min(values), max(values))
            yield f

    def _narrow(self, axis: int, corner: str, f: Filter, low: int, high: int) -> None:
        size = self.grid.chunks[axis]
        above = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual))
        below = isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual))
        if above:
            low += isinstance(f, GreaterThan)
            # a far corner of at least ``low`` is one of a chunk that ends there or beyond
            first = (low - 1) // size if corner == "1" else low // size if corner == "" else -(-low // size)
            self.box[axis][0] = max(self.box[axis][0], first)
        if below:
            high -= isinstance(f, LessThan)
            last = high // size
            if corner == "1" and high < self.grid.shape[axis]:
                last -= 1  # a chunk that starts within the last ``size`` voxels below ends beyond
            self.box[axis][1] = min(self.box[axis][1], last + 1)

    def partitions(self) -> list[Chunks]:
        total = math.prod(max(0, b - a) for a, b in self.box)
        step = max(1, self.task_bytes // self.grid.chunk_bytes)
        return [Chunks(a, min(total, a + step)) for a in range(0, total, step)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Chunks):  # an empty box
            return
        grid, (files, root) = self.grid, _files(self.path)
        sizes = [b - a for a, b in self.box]
        for number in range(partition.start, partition.stop):
            index = [int(i) + a for i, (a, _) in zip(np.unravel_index(number, sizes), self.box)]
            chunk = grid.decoded(_read(files, f"{root}/{grid.key(index)}"))
            start = [i * c for i, c in zip(index, grid.chunks)]
            stop = [min(n, s + c) for n, s, c in zip(grid.shape, start, grid.chunks)]
            for t, c in itertools.product(range(start[0], stop[0]), range(start[1], stop[1])):
                tile = chunk[(t - start[0], c - start[1], *[slice(0, b - a) for a, b in zip(start[2:], stop[2:])])]
                row = (t, c, *start[2:], *tile.shape, *stop[2:], grid.dtype, np.ascontiguousarray(tile).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=_NAMES)


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in SCHEMA.split(", ")]


@dataclass
class Written(WriterCommitMessage):
    """Chunks that a task has put in staging: (store, key)."""

    keys: list[tuple[int, str]]
    planes: list[tuple[int, int, int]]


class GridWriter(DataSourceArrowWriter):
    """Tiles (``[channel,] t, c, z0, y0, x0, nz, ny, nx, data`` and a ``dtype``) to one store for each channel.

    ``create`` makes new stores and fails where one is; ``overwrite`` replaces stores; ``update`` writes
    planes of stores that exist.  Tiles must cover whole chunks, and all of a plane that they touch.  A chunk
    of fill values alone has no file."""

    def __init__(self, paths: list[str], grid: Grid | None, mode: str):
        self.paths, self.mode, self.token = paths, mode, uuid.uuid4().hex
        there = [_read(files, f"{root}/{HEADER}") is not None for files, root in map(_files, paths)]
        if mode == "create" and any(there):
            raise FileExistsError(f"there is an array at {[p for p, x in zip(paths, there) if x]}")
        if mode == "update":
            self.grids = [read_grid(p) for p in paths]
        elif grid is None:
            raise ValueError("a new array needs a shape, chunks and a dtype")
        else:
            self.grids = [grid] * len(paths)

    def _staging(self, store: int) -> str:
        return f"{_files(self.paths[store])[1].rstrip('/')}._staging-{self.token}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        keys, planes = [], set()
        for batch in batches:
            for row in batch.to_pylist():
                store = row.get("channel", 0)
                if not 0 <= store < len(self.paths):
                    raise ValueError(f"the tiles have a channel {store}, the job names {len(self.paths)} stores")
                grid, files = self.grids[store], _files(self.paths[store])[0]
                tile = np.frombuffer(row["data"], np.dtype(row.get("dtype") or grid.dtype)).reshape(row["nz"], row["ny"], row["nx"])
                planes.add((store, row["t"], row["c"]))
                for key, chunk in self._chunks(grid, tile, (row["t"], row["c"]), (row["z0"], row["y0"], row["x0"])):
                    keys.append((store, key))
                    data = grid.encoded(chunk)
                    if (chunk == grid.empty(())).all():
                        data = b""  # published as no file
                    _write(files, f"{self._staging(store)}/{key}", data)
        return Written(keys, sorted(planes))

    @staticmethod
    def _chunks(grid: Grid, tile: np.ndarray, plane: tuple[int, int], corner: tuple[int, int, int]) -> Iterator[tuple[str, np.ndarray]]:
        if grid.chunks[:2] != (1, 1):
            raise ValueError("chunks of several planes cannot be written by plane")
        spans = []
        for at, n, size, whole in zip(corner, tile.shape, grid.chunks[2:], grid.shape[2:]):
            if at % size or ((at + n) % size and at + n != whole) or at + n > whole:
                raise ValueError(f"a tile from {at} to {at + n} does not cover whole chunks of {size} in {whole}")
            spans.append([(k, k * size - at, min(n, (k + 1) * size - at)) for k in range(at // size, -(-(at + n) // size))])
        for parts in itertools.product(*spans):
            part = tile[tuple(slice(a, b) for _, a, b in parts)]
            chunk = part.astype(np.dtype(grid.dtype), copy=False)
            if part.shape != grid.chunks[2:]:
                whole = grid.empty(grid.chunks[2:])
                whole[tuple(slice(0, n) for n in part.shape)] = chunk
                chunk = whole
            yield grid.key((*plane, *[k for k, _, _ in parts])), chunk

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        keys, planes = {k for m in done for k in m.keys}, {p for m in done for p in m.planes}
        for store, path in enumerate(self.paths):
            mine = [p for p in planes if p[0] == store]
            wanted = len(mine) * math.prod(self.grids[store].counts[2:])
            have = sum(1 for s, _ in keys if s == store)
            if not mine or have != wanted:
                self.abort(messages)
                raise ValueError(f"{path} would have {have} of {wanted} chunks in {len(mine)} planes; nothing is published")
        with ThreadPoolExecutor(16) as pool:
            for store, path in enumerate(self.paths):
                files, root = _files(path)
                self._publish(pool, files, root.rstrip("/"), store, [k for s, k in sorted(keys) if s == store])

    def _publish(self, pool: ThreadPoolExecutor, files: fs.FileSystem, root: str, store: int, keys: list[str]) -> None:
        staging = self._staging(store)

        def settle(key: str) -> None:
            there = f"{staging}/{key}"
            if not files.get_file_info(there).size:
                files.delete_file(there)
            elif self.mode == "update":
                if self.grids[store].separator == "/":
                    files.create_dir(f"{root}/{key}".rsplit("/", 1)[0], recursive=True)
                files.move(there, f"{root}/{key}")
                return
            if self.mode == "update" and files.get_file_info(f"{root}/{key}").type == fs.FileType.File:
                files.delete_file(f"{root}/{key}")

        list(pool.map(settle, keys))
        if self.mode == "update":
            files.delete_dir(staging)
            return
        _write(files, f"{staging}/{HEADER}", self.grids[store].header())
        if self.mode == "overwrite" and files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)
        files.move(staging, root)  # the store appears at once, whole

    def abort(self, messages: list[Written | None]) -> None:
        for store, path in enumerate(self.paths):
            files, _ = _files(path)
            if files.get_file_info(self._staging(store)).type == fs.FileType.Directory:
                files.delete_dir(self._staging(store))


class ChunkGrid(DataSource):
    """``spark.read.format("chunkgrid").load(path)`` and ``df.write.format("chunkgrid")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> GridReader:
        return GridReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: Any, overwrite: bool) -> GridWriter:
        o = self.options
        paths = json.loads(o["paths"]) if "paths" in o else [o["path"]]
        return GridWriter(paths, Grid.parse(o["header"].encode()) if "header" in o else None, "overwrite" if overwrite else o.get("placing", "create"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkGrid)
    # without it filters are applied to rows only, and every chunk is read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_array(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of SCHEMA, one for each plane of a chunk."""
    register(spark)
    return spark.read.format(FORMAT).option("task_bytes", task_bytes).load(path)


def write_arrays(tiles: DataFrame, paths: list[str], grid: Grid | None = None, mode: str = "create") -> None:
    """Tiles to array stores, channel n to store n, in one pass: all are published or none."""
    register(tiles.sparkSession)
    writer = tiles.write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").option("paths", json.dumps(paths)).option("placing", mode)
    writer = writer if grid is None else writer.option("header", grid.header().decode())
    writer.save()


def grid_for(shape: Sequence[int], chunks: Sequence[int], dtype: str = "<u2", compressor: dict[str, Any] | None = None, fill: Any = 0, separator: str = ".") -> Grid:
    """A new array of two leading axes for planes (t, c) and three for voxels."""
    lead = (1,) * (5 - len(shape))
    return replace(Grid((*lead, *shape), (*lead, *chunks), dtype), compressor=compressor or {"id": "zstd", "level": 3}, fill=fill, separator=separator)
