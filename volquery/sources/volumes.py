"""Volumes: opened from a specification, read as voxel or chunk rows, written by plane and channel."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tensor import to_voxels
from ..operators.tiles import box_of
from .array_store import Grid, read_array, read_grid
from .json_files import read_json


def parse_spec(spark: SparkSession, spec: str | dict[str, Any]) -> dict[str, Any]:
    """A mapping as it is, inline JSON (text that starts with ``{`` or ``[``), or the path of a file."""
    if not isinstance(spec, str):
        return spec
    if spec.lstrip()[:1] in ("{", "["):
        return json.loads(spec)
    return read_json(spark, spec)


CHUNK_COLUMNS = ("t", "c", "z0", "y0", "x0", "nz", "ny", "nx", "data")
ARRAY = "zarr"


def array_path(spec: dict[str, Any]) -> str | None:
    """The folder that a specification of an array store names, by ``path`` or by its ``kvstore``."""
    if spec.get("driver") != ARRAY:
        return None
    store = spec.get("kvstore", {})
    return spec.get("path") or store.get("path") if not isinstance(store, str) else store


def new_grid(spec: dict[str, Any]) -> Grid | None:
    """The array that the ``metadata`` of a specification describes."""
    head = spec.get("metadata")
    return Grid.parse(json.dumps({"zarr_format": 2, "compressor": {"id": "zstd", "level": 3}, "fill_value": 0, **head}).encode()) if head else None


def open_chunks(spark: SparkSession, spec: str | dict[str, Any]) -> tuple[DataFrame, tuple[int, int, int] | None]:
    """Chunk rows of the volume that a specification names, and the extents where they are known without a
    scan: of an array store from its header, of chunks in files (``"form": "chunks"``) if it states them
    (``"shape": [z, y, x]``)."""
    spec = parse_spec(spark, spec)
    if path := array_path(spec):
        return read_array(spark, path), read_grid(path).shape[2:]
    frame = spark.read.format(spec.get("driver", "parquet")).options(**spec.get("options", {})).load(spec["path"])
    missing = set(CHUNK_COLUMNS) - set(frame.columns)
    if missing:
        raise ValueError(f"the volume lacks {sorted(missing)}")
    kept = [*CHUNK_COLUMNS, *(["dtype"] if "dtype" in frame.columns else [])]
    return frame.select(*kept), tuple(spec["shape"]) if "shape" in spec else None


def is_chunked(spec: dict[str, Any]) -> bool:
    return spec.get("driver") == ARRAY or spec.get("form") == "chunks"


def open_box(spark: SparkSession, spec: str | dict[str, Any], t: int, c: int, box: list[tuple[int, int]]) -> DataFrame:
    """Voxel rows of a box of one plane; of chunked volumes only chunks that touch it are read."""
    spec = parse_spec(spark, spec)
    if is_chunked(spec):
        return to_voxels(box_of(open_chunks(spark, spec)[0], t, c, box), "p")
    inside = (F.col("t") == t) & (F.col("c") == c)
    for a, (start, stop) in zip("zyx", box):
        inside &= (F.col(a) >= start) & (F.col(a) < stop)
    return open_volume(spark, spec).where(inside).select("z", "y", "x", F.col("p").cast("double").alias("p"))


def open_volume(spark: SparkSession, spec: str | dict[str, Any]) -> DataFrame:
    """``t, c, z, y, x, p`` rows of the volume a specification names.

    ``{"driver": "parquet", "path": ..., "form": "voxels" | "chunks"}``, ``{"driver": "memory", "rows":
    [...]}`` (t, c, z, y, x, p), ``{"driver": "zarr", "path": ...}``, or any other Spark source by ``driver``
    and ``options``."""
    spec = parse_spec(spark, spec)
    if array_path(spec):
        return to_voxels(open_chunks(spark, spec)[0], "p", ("t", "c"))
    driver = spec.get("driver", "parquet")
    if driver == "memory":
        return spark.createDataFrame([tuple(r) for r in spec["rows"]], "t int, c int, z long, y long, x long, p double")
    frame = spark.read.format(driver).options(**spec.get("options", {})).load(spec["path"])
    if spec.get("form", "voxels") == "chunks":
        return to_voxels(frame, keys=("t", "c"))
    missing = {"t", "c", "z", "y", "x", "p"} - set(frame.columns)
    if missing:
        raise ValueError(f"the volume lacks {sorted(missing)}")
    return frame


def write_volume(rows: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ("t", "c")) -> None:
    """Voxel or chunk rows in folders by plane (or ``channel``).  ``overwrite`` replaces only the planes
    that ``rows`` holds."""
    writer = rows.write.mode(mode).partitionBy(*by)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_channels(rows: DataFrame, paths: list[str], mode: str = "errorifexists") -> None:
    """Channel n to store n in one pass: rows go to a staging folder by channel, and once there are as many
    channels as stores its parts are moved to them.  A channel too few or too many, or a store that is in
    the way, leaves no store; with ``append`` the files join those of a store."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    stores = [of(p) for p in paths]
    files = stores[0].getFileSystem(conf)
    there = [p for p, s in zip(paths, stores) if files.exists(s)]
    if there and mode == "errorifexists":
        raise FileExistsError(f"there is a store at {there}")
    staging = of(f"{paths[0].rstrip('/')}._staging-{uuid.uuid4().hex}")
    try:
        rows.write.partitionBy("channel").parquet(staging.toString())
        found = sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(staging) if "=" in f.getPath().getName())
        if found != list(range(len(paths))):
            raise ValueError(f"the model gives channels {found}, the job names {len(paths)} stores")
        for channel, store in enumerate(stores):
            part = of(staging, f"channel={channel}")
            if mode == "overwrite":
                files.delete(store, True)
            if files.exists(store):
                for f in files.listStatus(part):
                    files.rename(f.getPath(), of(store, f.getPath().getName()))
            else:
                files.mkdirs(store.getParent())
                files.rename(part, store)
    finally:
        files.delete(staging, True)
