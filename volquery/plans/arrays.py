"""Registered queries over array stores and streams of tiles, with the SQL of the volume they hold."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bricks import task_bytes_of
from ..operators.models import MODELS
from ..operators.tensor import to_voxels
from ..operators.tiles import tile_voxels, to_tiles
from ..operators.voxels import plane_shape
from ..sources import fixtures
from ..sources.array_store import grid_for, put_file, read_array, write_arrays
from ..sources.image_groups import group_documents, image_levels
from ..sources.scratch import scratch_folder
from ..sources.volumes import open_box, open_volume
from ..streaming.completeness import run_to_end
from ..streaming.tiles import read_patches, stitch_tiles
from . import oracle
from .catalogue import G1, G2, G4, _pyramid_sql, _seam_sql, _seams, config, query, tidy
from .job import build_array_pyramid, plan_chunks, run

CHUNK = (8, 5, 5)
_EVENTS = oracle.VOLUMES["events"]


def _stored(spark: SparkSession, sf_dir: str, path: str, volume: str = "events", chunk: tuple[int, int, int] = CHUNK, planes: int = 1) -> str:
    """A volume as an array store; plane c holds its values times c + 1."""
    rows = (fixtures.events_volume if volume == "events" else fixtures.vectors_volume)(spark, sf_dir)
    shape = plane_shape(rows)
    every = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(planes - 1)))).withColumn("p", F.col("p") * (F.col("c") + 1))
    write_arrays(to_tiles(every, chunk), [path], grid_for((1, planes, *shape), (1, 1, *chunk), "<f8"))
    return path


@query(f"SELECT c::BIGINT AS c, z, y, x, p * (c + 1) AS p FROM ({_EVENTS}), range(0, 2) t(c)")
def array_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both planes of a chunk-grid array store, ragged at its end, opened by a specification."""
    path = _stored(spark, sf_dir, f"{scratch_folder(spark, 'arrays')}/a", planes=2)
    return tidy(open_volume(spark, {"driver": "zarr", "path": path}).select("c", "z", "y", "x", "p"))


@query(f"SELECT z, y, x, p FROM ({_EVENTS}) WHERE z BETWEEN 3 AND 20 AND y BETWEEN 4 AND 6 AND x < 3")
def array_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a plane; chunks that do not touch it are not read."""
    path = _stored(spark, sf_dir, f"{scratch_folder(spark, 'arrays')}/a", planes=2)
    return open_box(spark, {"driver": "zarr", "path": path}, 0, 0, [(3, 21), (4, 7), (0, 3)])


@query(_seam_sql("vectors", G4, "demean", oracle.TRIM, "off"))
def job_array_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job from array store to array store."""
    root = scratch_folder(spark, "arrays")
    source = _stored(spark, sf_dir, f"{root}/in", "vectors", (5, 8, 4))
    sink = {"driver": "zarr", "path": f"{root}/out", "create": True}
    run(spark, {"driver": "zarr", "path": source}, sink, config(G4, normalize=False), "patch-demean", dtype="float64")
    return _seams(to_voxels(read_array(spark, f"{root}/out"), "v"))


def _in_bricks(spark: SparkSession, sf_dir: str, volume: str, g: dict, model: str, **more) -> DataFrame:
    """A chunked job whose tasks hold a part of a block only."""
    rows = (fixtures.events_volume if volume == "events" else fixtures.vectors_volume)(spark, sf_dir)
    tiles, _ = plan_chunks(to_tiles(rows, CHUNK), config(g, **more), MODELS.load(model), "float64", plane_shape(rows), task_bytes_of(tuple(n + 1 for n in g["patch"]), 1))
    return _seams(tile_voxels(tiles, "v"))


@query(_seam_sql("events", G2, "demean", oracle.blend(1e-6)))
def bricks_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks beyond a task's memory, in bricks of patches: blended, with percentiles of the whole block."""
    return _in_bricks(spark, sf_dir, "events", G2, "patch-demean", seam_mode="blend")


@query(_seam_sql("vectors", G4, "demean", oracle.TRIM, "off"))
def bricks_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with trimmed seams."""
    return _in_bricks(spark, sf_dir, "vectors", G4, "patch-demean", normalize=False)


@query("SELECT count(*) AS voxels, ceil((max(event_id) // 100 + 1) / 10.0)::BIGINT AS blocks, count(*) FILTER (value > 127 OR value < -128) AS clipped FROM events")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job counts while it writes: voxels, blocks, and values cut by the output type."""
    root = scratch_folder(spark, "arrays")
    source = _stored(spark, sf_dir, f"{root}/in")
    done = run(spark, {"driver": "zarr", "path": source}, {"driver": "zarr", "path": f"{root}/out", "create": True}, config(G1, normalize=False), "identity", dtype="int8")
    return spark.createDataFrame([(done.voxels, done.blocks, done.clipped)], "voxels long, blocks long, clipped long")


@query(f"SELECT 1::BIGINT AS level, * FROM ({_pyramid_sql(2)}) UNION ALL SELECT 2, * FROM ({_pyramid_sql(3)})")
def array_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of an array store, made of sums and counts of blocks: voxels are rows only to be compared."""
    root = scratch_folder(spark, "arrays")
    _stored(spark, sf_dir, f"{root}/0")
    build_array_pyramid(spark, root, "events", [(2, 2, 2)], 3, (0.5, 0.25, 0.25))
    levels = [tile_voxels(read_array(spark, f"{root}/{n}"), "v").select(F.lit(n).cast("long").alias("level"), "z", "y", "x", F.round("v", 9).alias("v")) for n in (1, 2)]
    return levels[0].unionByName(levels[1])


@query(f"SELECT z // 10 AS block, z, y, x, p FROM ({_EVENTS})")
def stream_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten planes, each plane a patch, streamed out of order and stitched from map state."""
    root = scratch_folder(spark, "stream")
    planes = to_tiles(fixtures.events_volume(spark, sf_dir), (1, 10, 10))
    size = planes.groupBy(F.expr("z0 div 10").alias("block")).agg(F.count("*").alias("total"))
    rows = planes.withColumn("block", F.expr("z0 div 10")).join(size, "block")
    rows = rows.select(
        "block", (F.col("z0") % 10 + 1).alias("patch"), "total", F.col("total").cast("int").alias("size_z"), F.lit(10).alias("size_y"), F.lit(10).alias("size_x"), (F.col("z0") % 10).cast("int").alias("at_z"), F.lit(0).alias("at_y"),
        F.lit(0).alias("at_x"), F.col("nz").alias("n_z"), F.col("ny").alias("n_y"), F.col("nx").alias("n_x"), "dtype", "data",
    )
    rows.orderBy(F.xxhash64("block", "patch")).repartition(3).write.parquet(f"{root}/in")
    run_to_end(stitch_tiles(read_patches(spark, f"{root}/in")), f"{root}/state", f"{root}/out")
    done = spark.read.parquet(f"{root}/out").where("complete")
    tiles = done.select("block", (F.col("block") * 10).alias("z0"), F.lit(0).cast("long").alias("y0"), F.lit(0).cast("long").alias("x0"), "nz", "ny", "nx", "dtype", "data")
    return tile_voxels(tiles, "p", ("block",)).select("block", "z", "y", "x", "p")


@query(
    """SELECT p_partkey::BIGINT AS part, i::BIGINT AS level, p_size * 0.5 * 2 ** i AS scale_z, CASE WHEN i > 0 THEN 2 END::BIGINT AS factor_z, NULL::VARCHAR AS reason FROM part, range(0, 3) t(i) WHERE p_size % 10 > 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, CASE WHEN p_size % 20 = 0 THEN 'no attributes' ELSE 'not JSON' END FROM part WHERE p_size % 10 = 0"""
)
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image group a part, some without attributes and some with broken ones, read as a table of levels."""
    root = scratch_folder(spark, "groups")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                sets = [{"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0, *[size * 0.5 * 2.0**i] * 3]}]} for i in range(3)]
                body = json.dumps({"multiscales": [{"name": path, "datasets": sets}]}).encode()
                if size % 20:
                    put_file(f"{path}/.zattrs", body if size % 10 else body[:-1])
            yield batch.select(["path"])

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit(f"{root}/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size"))
    parts.mapInArrow(write, "path string").write.parquet(f"{root}/written")
    levels = image_levels(group_documents(spark.read.parquet(f"{root}/written")))
    key = F.substring_index("path", "/", -1).cast("long").alias("part")
    return levels.select(key, F.col("level").cast("long").alias("level"), F.col("scale")[0].alias("scale_z"), F.col("factor")[0].alias("factor_z"), "reason")
