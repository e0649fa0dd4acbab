"""Registered queries that go through stores: jobs, pyramids and documents are written, then read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import pyramid_spec
from ..operators.tensor import to_chunks, to_voxels
from ..operators.voxels import select_plane
from ..sources import fixtures
from ..sources.json_files import metrics_samples, pyramid_attributes, write_samples
from ..sources.lookups import read_gpu_csv
from ..sources.scratch import scratch_folder
from ..sources.volumes import open_volume, write_volume
from . import oracle
from .catalogue import _GPU, _HEADS, G1, G4, RING, _gpu_rows, _pyramid_sql, _seam_sql, _seams, config, query, tidy
from .job import build_pyramid, run

# --- volumes and jobs ---------------------------------------------------------------------------------


@query("SELECT 0::BIGINT AS c, * FROM (" + oracle.VOLUMES["sizes"] + ") UNION ALL SELECT 1, * FROM (" + oracle.VOLUMES["prices"] + ")")
def volume_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of a volume in folders by plane, opened by a specification."""
    root = scratch_folder(spark, "volume")
    write_volume(fixtures.parts_volume(spark, sf_dir), f"{root}/in")
    volume = open_volume(spark, json.dumps({"path": f"{root}/in"}))
    planes = [select_plane(volume, 0, c).select(F.lit(c).cast("long").alias("c"), "z", "y", "x", "p") for c in (0, 1)]
    return tidy(planes[0].unionByName(planes[1]))


@query(_seam_sql("events", G1, "affine", oracle.TRIM))
def job_voxel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job from a stored volume of voxel rows to a store."""
    root = scratch_folder(spark, "job")
    write_volume(fixtures.events_volume(spark, sf_dir), f"{root}/in")
    run(spark, {"path": f"{root}/in"}, f"{root}/out", config(G1), "affine", dtype="float64")
    return _seams(spark.read.parquet(f"{root}/out"))


@query(_seam_sql("vectors", G4, "demean", oracle.TRIM, "off"))
def job_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job from stored chunks to a store of dense blocks."""
    root = scratch_folder(spark, "job")
    to_chunks(fixtures.vectors_volume(spark, sf_dir), G4["block"]).write.parquet(f"{root}/in")
    run(spark, {"path": f"{root}/in", "form": "chunks"}, f"{root}/out", config(G4, normalize=False), "patch-demean", dtype="float64")
    return _seams(to_voxels(spark.read.parquet(f"{root}/out"), "v"))


@query(
    f"""WITH vox AS ({oracle.VOLUMES['vectors']}), heads AS (SELECT z, y, x, 0 AS channel, p * 2 + 1 AS h FROM vox UNION ALL SELECT z, y, x, 1, -(p * 2) FROM vox UNION ALL SELECT z, y, x, 2, p * 2 * (p * 2) FROM vox)
SELECT channel::BIGINT AS store, count(*) AS n, min(z) AS first_z, max(z) AS last_z, round(min(greatest(0.01, least(0.99, 1 / (1 + exp(-h))))), 6) AS low, round(max(greatest(0.01, least(0.99, 1 / (1 + exp(-h))))), 6) AS high,
  round(avg(greatest(0.01, least(0.99, 1 / (1 + exp(-h))))), 6) AS mean FROM heads GROUP BY channel"""
)
def job_channel_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel n of a job goes to store n; what each store holds."""
    root = scratch_folder(spark, "job")
    write_volume(fixtures.vectors_volume(spark, sf_dir), f"{root}/in")
    stores = [f"{root}/head{n}" for n in range(3)]
    run(spark, {"path": f"{root}/in"}, stores, config(G4, normalize=False), _HEADS, dtype="float64")
    held = [spark.read.parquet(path).select(F.lit(n).cast("long").alias("store"), "z", "v") for n, path in enumerate(stores)]
    every = held[0].unionByName(held[1]).unionByName(held[2])
    return every.groupBy("store").agg(
        F.count("*").alias("n"), F.min("z").alias("first_z"), F.max("z").alias("last_z"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.avg("v"), 6).alias("mean")
    )


# --- pyramids -----------------------------------------------------------------------------------------

VOXEL = (0.5, 0.25, 0.25)
LEVELS = 3


def _pyramid_group(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_folder(spark, "pyramid")
    level = select_plane(fixtures.events_volume(spark, sf_dir), 0, 0)
    level.withColumnRenamed("p", "v").write.parquet(f"{root}/0")
    build_pyramid(spark, f"{root}/0", root, "events", [(2, 2, 2)], LEVELS, VOXEL)
    return root


@query(f"SELECT 1::BIGINT AS level, * FROM ({_pyramid_sql(2)}) UNION ALL SELECT 2, * FROM ({_pyramid_sql(3)})")
def pyramid_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a pyramid as they are stored, each made from the one before."""
    root = _pyramid_group(spark, sf_dir)
    levels = [spark.read.parquet(f"{root}/{n}").select(F.lit(n).cast("long").alias("level"), "z", "y", "x", F.round("v", 9).alias("v")) for n in range(1, LEVELS)]
    return tidy(levels[0].unionByName(levels[1]))


_CHANGE = "struct<type:string, scale:array<double>, translation:array<double>>"
_IMAGE = f"struct<name:string, version:string, axes:array<struct<name:string>>, datasets:array<struct<path:string, coordinateTransformations:array<{_CHANGE}>>>>"
_GROUP = f"multiscales array<{_IMAGE}>, omero struct<channels:array<struct<label:string, color:string>>>"


@query(
    f"""SELECT '/events' AS name, '0.4' AS version, 'tczyx' AS axes, i::VARCHAR AS path, {VOXEL[0]} * 2.0 ** i AS scale_z, {VOXEL[2]} * 2.0 ** i AS scale_x,
  {VOXEL[0]} * (2.0 ** i - 1) / 2 AS origin_z, {VOXEL[2]} * (2.0 ** i - 1) / 2 AS origin_x, 'Channel:events:0' AS label, '000000' AS color, 2::BIGINT AS factor, {LEVELS}::BIGINT AS levels FROM range(0, {LEVELS}) t(i)"""
)
def pyramid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored attributes of an image group, one row a level, with the factors that a reader infers.  The
    document has one entry a level, whatever the volume."""
    document = pyramid_attributes(spark, f"{_pyramid_group(spark, sf_dir)}/0")
    spec = pyramid_spec(document)
    rows = spark.createDataFrame([(json.dumps(document),)], "body string")
    parsed = rows.select(F.from_json("body", _GROUP).alias("d"))
    image = parsed.select(F.explode("d.multiscales").alias("m"), F.col("d.omero.channels")[0].alias("c"))
    each = image.select("c", F.col("m.name").alias("name"), F.col("m.version").alias("version"), F.array_join(F.transform("m.axes", lambda a: a["name"]), "").alias("axes"), F.explode("m.datasets").alias("s"))
    scale, origin = F.col("s.coordinateTransformations")[0]["scale"], F.col("s.coordinateTransformations")[1]["translation"]
    return each.select(
        "name", "version", "axes", F.col("s.path").alias("path"), scale[2].alias("scale_z"), scale[4].alias("scale_x"), origin[2].alias("origin_z"), origin[4].alias("origin_x"),
        F.col("c.label").alias("label"), F.col("c.color").alias("color"), F.lit(spec["factors"][0][0]).cast("long").alias("factor"), F.lit(spec["levels"]).cast("long").alias("levels"),
    )


# --- telemetry files ----------------------------------------------------------------------------------

_LATEST = f"SELECT event_id::DOUBLE AS t, value, user_id::DOUBLE AS device FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= {RING}"


@query(f"WITH s AS ({_LATEST}) SELECT 'queue' AS monitor, 'value' AS series, t, value FROM s UNION ALL SELECT 'queue', 'device', t, device FROM s UNION ALL SELECT 'system', 'value', t, value FROM s")
def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both monitors' newest samples, as many as a monitor keeps, written as a metrics document and scanned."""
    path = f"{scratch_folder(spark, 'metrics')}/metrics"
    newest = fixtures.event_samples(spark, sf_dir).orderBy(F.desc("event_id")).limit(RING)  # the monitor's ring buffer
    samples = newest.select(F.col("event_id").cast("double").alias("t"), "value", F.col("device").cast("double").alias("device"))
    write_samples(path, samples, ("value", "device"), samples, ("value",))
    return metrics_samples(spark, path)


@query(f"SELECT epoch_us(ts) AS us, gpu_index::BIGINT AS gpu_index, 'Device ' || gpu_index AS name, mem::DOUBLE AS memory_mib, util::DOUBLE AS utilization FROM ({_GPU})")
def gpu_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler's files, with the spaces it puts after commas."""
    path = f"{scratch_folder(spark, 'sampler')}/csv"
    _gpu_rows(spark, sf_dir).drop("event_id").write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    rows = read_gpu_csv(spark, path)
    return tidy(rows.select(F.unix_micros("ts").alias("us"), F.col("index").alias("gpu_index"), "name", "memory_mib", "utilization"))
