"""Registered queries of the tiling engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import JobConfig
from ..functions.scalars import base_sample, decoder_weights, downscale_factor, hex_color, is_cuda, sample_id, saturate, sigmoid
from ..operators import telemetry, tiling
from ..operators.cover import axes_of, cover_frame
from ..operators.metadata import origins, scales
from ..operators.models import MODELS, shared_expression
from ..operators.tensor import infer_chunks, to_chunks, to_voxels
from ..operators.voxels import BLOCK, block_statistics, downsample, infer, normalize_blocks, patches_per_block, plane_shape, predictions, select_plane
from ..sources import fixtures
from ..sources.lookups import parse_gpu_rows, with_aliases
from ..sources.scratch import scratch_folder
from ..streaming.completeness import read_predictions, run_to_end, stitch_when_complete
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

G1 = {"block": (10, 10, 10), "patch": (6, 6, 6), "overlap": 2, "trim": 1, "halo": 1}
G2 = {"block": (10, 5, 5), "patch": (4, 4, 4), "overlap": 2, "trim": 1, "halo": 1}
G3 = {"block": (10, 8, 10), "patch": (8, 8, 8), "overlap": 4, "trim": 1, "halo": 2}
G4 = {"block": (10, 8, 8), "patch": (6, 6, 6), "overlap": 2, "trim": 1, "halo": 1}


def config(g: dict, **more) -> JobConfig:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return JobConfig(block=g["block"], patch=g["patch"], overlap=g["overlap"], halo=g["halo"], **({"trim_voxels": g["trim"]} | more))


def sql_geometry(volume: str, g: dict, floor: float = 0.05) -> str:
    return oracle.geometry(volume, g["block"], g["patch"], g["overlap"], g["halo"], g["trim"], floor)


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Means over patches are often exact halves of the last digit kept; this moves them off the edge, the same
#: way in either engine.
NUDGE = 1.047e-8


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as in the SQL."""
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema])


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits) + F.lit(0.0)  # no negative zeros


def plane(spark: SparkSession, sf_dir: str, volume: str) -> DataFrame:
    if volume in ("sizes", "prices"):
        return select_plane(fixtures.parts_volume(spark, sf_dir), 0, 0 if volume == "sizes" else 1)
    maker = {"events": fixtures.events_volume, "vectors": fixtures.vectors_volume, "ragged": fixtures.ragged_volume}[volume]
    return select_plane(maker(spark, sf_dir), 0, 0)


# --- scans and tiling -------------------------------------------------------------------------------


@query(oracle.VOLUMES["prices"])
def plane_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(plane(spark, sf_dir, "prices"))


_AXIS_COLUMNS = ", ".join(f"{b}.k AS k_{a}, {b}.bs AS start_{a}, {b}.be AS stop_{a}, {b}.lo AS lo_{a}, {b}.hi AS hi_{a}, {b}.bs - {b}.lo AS left_{a}" for a, b in (("z", "bz"), ("y", "ky"), ("x", "kx")))


def _grid_sql(g: dict) -> str:
    return (
        sql_geometry("events", g)
        + f""", cnt AS (SELECT (SELECT count(*) FROM blk_y) AS ny, (SELECT count(*) FROM blk_x) AS nx)
SELECT (bz.k * ny + ky.k) * nx + kx.k AS k, {_AXIS_COLUMNS} FROM blk_z bz, blk_y ky, blk_x kx, cnt"""
    )


def _grid(spark: SparkSession, sf_dir: str, g: dict) -> DataFrame:
    return tiling.block_grid(spark, plane_shape(plane(spark, sf_dir, "events")), g["block"], g["halo"])


@query(_grid_sql(G2 | {"halo": 0}))
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, G2 | {"halo": 0})


@query(_grid_sql(G2))
def block_grid_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, G2)


_PATCHES_SQL = (
    sql_geometry("events", G2)
    + """, cnt AS (SELECT (SELECT count(*) FROM blk_y) AS ny, (SELECT count(*) FROM blk_x) AS nx),
pats AS (SELECT (z.k * ny + y.k) * nx + x.k AS k, z.s AS s_z, y.s AS s_y, x.s AS s_x, z.v AS v_z, y.v AS v_y, x.v AS v_x FROM pat_z z, pat_y y, pat_x x, cnt),
nums AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s_z, s_y, s_x) - 1 AS n FROM pats)
"""
)


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.patch_table(_grid(spark, sf_dir, G2), G2["patch"], G2["overlap"])


@query(_PATCHES_SQL + "SELECT * FROM nums")
def patch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_patches(spark, sf_dir))


@query(_PATCHES_SQL + "SELECT k, count(*) AS total FROM pats GROUP BY k")
def patch_count_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.patches_of_blocks(_patches(spark, sf_dir))


@query(_PATCHES_SQL + "SELECT k, n // 4 AS batch, count(*) AS n_patches FROM nums GROUP BY ALL")
def patch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.micro_batches(_patches(spark, sf_dir), 4)


@query(_grid_sql(G2).replace("SELECT (bz.k", "SELECT k % 3 AS shard, count(*) AS blocks, min(k) AS first_block FROM (SELECT (bz.k") + ") GROUP BY ALL")
def writer_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, G2).groupBy(tiling.shard(F.col("k"), 3).alias("shard")).agg(F.count("*").alias("blocks"), F.min("k").alias("first_block"))


@query(_grid_sql(G2).replace("SELECT (bz.k", "SELECT k % 4 AS worker, k, start_z, start_y, start_x FROM (SELECT (bz.k") + ")")
def prep_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, G2).select(tiling.shard(F.col("k"), 4).alias("worker"), "k", "start_z", "start_y", "start_x")


def _axis_rows(spark: SparkSession, sf_dir: str, g: dict, **more) -> DataFrame:
    return cover_frame(spark, axes_of(config(g, **more), plane_shape(plane(spark, sf_dir, "events")))[0])


@query(sql_geometry("events", G1) + "SELECT g, k, s, j, round(w, 9) AS w FROM cov_z")
def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _axis_rows(spark, sf_dir, G1, seam_mode="blend")
    return tidy(c.select(F.col("g_z").alias("g"), F.col("k_z").alias("k"), F.col("s_z").alias("s"), F.col("j_z").alias("j"), F.round("w_z", 9).alias("w")))


@query(sql_geometry("events", G1) + "SELECT g, k, s, keep, core, keep AND s = max(CASE WHEN keep THEN s END) OVER (PARTITION BY k, g) AS win FROM cov_z")
def trim_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _axis_rows(spark, sf_dir, G1)
    return tidy(c.select(F.col("g_z").alias("g"), F.col("k_z").alias("k"), F.col("s_z").alias("s"), F.col("keep_z").alias("keep"), F.col("core_z").alias("core"), F.col("win_z").alias("win")))


# --- statistics and normalisation -------------------------------------------------------------------


def _stats_sql(volume: str, g: dict) -> str:
    return sql_geometry(volume, g) + oracle.WIDE + oracle.stats(0.5, 99.9) + "SELECT k_z, k_y, k_x, round(mn, 6) AS mn, round(mx, 6) AS mx, n_voxels FROM st"


def _stats(spark: SparkSession, sf_dir: str, volume: str, g: dict) -> DataFrame:
    voxels = plane(spark, sf_dir, volume)
    found = block_statistics(voxels, axes_of(config(g), plane_shape(voxels)), 0.5, 99.9)
    return tidy(found.select(*BLOCK, F.round("mn", 6).alias("mn"), F.round("mx", 6).alias("mx"), "n_voxels"))


@query(_stats_sql("events", G1))
def block_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "events", G1)


@query(_stats_sql("vectors", G4))
def block_percentiles_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "vectors", G4)


def _normalized(spark: SparkSession, sf_dir: str, volume: str, cfg: JobConfig) -> DataFrame:
    voxels = plane(spark, sf_dir, volume)
    return normalize_blocks(voxels, cfg, plane_shape(voxels))


_Q = "(p - mn) / greatest(mx - mn, 1e-6)"


@query(sql_geometry("events", G1) + oracle.WIDE + oracle.stats(0.5, 99.9) + f"SELECT z, y, x, round({_Q}, 6) + 0.0 AS q FROM wide JOIN st USING (k_z, k_y, k_x) WHERE core")
def normalize_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_normalized(spark, sf_dir, "events", config(G1)).select("z", "y", "x", rounded("q").alias("q")))


@query(f"SELECT z, y, x, round((greatest(5.0, least(20.0, p)) - 5.0) / 15.0, 6) + 0.0 AS q FROM ({oracle.VOLUMES['events']})")
def normalize_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = config(G1, normalize="global", norm_lower=5.0, norm_upper=20.0)
    return tidy(_normalized(spark, sf_dir, "events", cfg).select("z", "y", "x", rounded("q").alias("q")))


@query(f"SELECT z, y, x, greatest(10.0, least(30.0, p)) AS q FROM ({oracle.VOLUMES['sizes']})")
def normalize_off_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_normalized(spark, sf_dir, "sizes", config(G1, normalize=False, clip_norm=(10.0, 30.0))).select("z", "y", "x", "q"))


@query(sql_geometry("events", G1) + oracle.WIDE + oracle.stats(0.5, 99.9) + f"SELECT z, y, x, round(greatest(0.0, least(1.0, {_Q})), 6) + 0.0 AS q FROM wide JOIN st USING (k_z, k_y, k_x) WHERE core")
def normalize_clip_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_normalized(spark, sf_dir, "events", config(G1, clip_norm=True)).select("z", "y", "x", rounded("q").alias("q")))


@query(f"SELECT z, y, x, round(p + 1.047e-8, 6) AS v FROM ({oracle.VOLUMES['events']})")
def denormalize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "events"), config(G1), MODELS.load("identity")))


# --- stitching and whole jobs -----------------------------------------------------------------------


def _seams(result: DataFrame) -> DataFrame:
    return tidy(result.select("z", "y", "x", rounded(F.col("v") + NUDGE).alias("v")))


def _seam_sql(volume: str, g: dict, model: str, tail: str, normalize: str = "percentile", denormalize: bool = True) -> str:
    size = g["patch"][0] * g["patch"][1] * g["patch"][2]
    if normalize == "percentile":
        return sql_geometry(volume, g) + oracle.WIDE + oracle.stats(0.5, 99.9) + oracle.COVER + oracle.model_rows(_Q, model, size, "greatest(mx - mn, 1e-6)", "mn", True, denormalize) + tail
    if normalize == "off":
        return sql_geometry(volume, g) + oracle.COVER + oracle.model_rows("p", model, size, "1.0", "0.0", False, denormalize) + tail
    return sql_geometry(volume, g) + oracle.COVER + oracle.model_rows("(greatest(100.0, least(1000.0, p)) - 100.0) / 900.0", model, size, "900.0", "100.0", False, denormalize) + tail


@query(_seam_sql("events", G2, "demean", oracle.TRIM))
def stitch_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "events"), config(G2), MODELS.load("patch-demean"), form="max_by"))


@query(_seam_sql("events", G2, "demean", oracle.TRIM))
def stitch_trim_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "events"), config(G2), MODELS.load("patch-demean")))


@query(_seam_sql("ragged", G3, "demean", oracle.TRIM))
def stitch_trim_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "ragged"), config(G3), MODELS.load("patch-demean")))


@query(_seam_sql("events", G2, "demean", oracle.blend(1e-6)))
def stitch_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "events"), config(G2, seam_mode="blend"), MODELS.load("patch-demean")))


@query("SELECT (SELECT max(event_id) + 1 FROM events) AS n_voxels, 0::BIGINT AS n_gaps, 0::BIGINT AS n_differences")
def stitch_identity_gapcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of 1 or more through the identity: no zeros, no differences, every voxel once."""
    voxels = plane(spark, sf_dir, "events").withColumn("p", F.col("p") + 1)
    out = infer(voxels, config(G2, seam_mode="blend"), MODELS.load("identity"))
    both = voxels.join(out, ["z", "y", "x"], "full")
    return both.agg(F.count("v").alias("n_voxels"), F.count_if(F.coalesce("v", F.lit(0.0)) == 0).alias("n_gaps"), F.count_if(F.abs(F.coalesce(F.col("v"), F.lit(0.0)) - F.col("p")) > 1e-6).alias("n_differences"))


@query(
    sql_geometry("events", G1)
    + oracle.COVER
    + """
SELECT k_z, k_y, k_x, count(DISTINCT [s_z, s_y, s_x]) AS count FROM inc GROUP BY k_z, k_y, k_x"""
)
def patch_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = plane(spark, sf_dir, "events")
    shape = plane_shape(voxels)
    cfg = config(G1, normalize=False)
    return tidy(patches_per_block(axes_of(cfg, shape), predictions(voxels, cfg, MODELS.load("identity"), shape)))


@query(_seam_sql("events", G1, "affine", oracle.TRIM))
def infer_percentile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(infer(plane(spark, sf_dir, "events"), config(G1), MODELS.load("affine")))


@query(_seam_sql("prices", G2, "demean", oracle.blend(1e-6), "global", False))
def infer_global_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = config(G2, seam_mode="blend", normalize="global", norm_lower=100.0, norm_upper=1000.0, output_denormalize=False)
    return _seams(infer(plane(spark, sf_dir, "prices"), cfg, MODELS.load("patch-demean")))


def _chunked(spark: SparkSession, sf_dir: str, volume: str, cfg: JobConfig, model: str) -> DataFrame:
    voxels = plane(spark, sf_dir, volume)
    shape = plane_shape(voxels)
    chunks = to_chunks(voxels.withColumns({"t": F.lit(0), "c": F.lit(0)}), cfg.block)
    return to_voxels(infer_chunks(chunks, cfg, MODELS.load(model), shape), "v", ("channel",))


# chunks hold single-precision voxels
@query(_seam_sql("vectors", G4, "demean", oracle.TRIM, "off"))
def infer_chunks_demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(_chunked(spark, sf_dir, "vectors", config(G4, normalize=False), "patch-demean"))


def _box_sql() -> str:
    """The 3 x 3 x 3 mean inside each patch: neighbours are voxels of the same patch."""
    return (
        sql_geometry("vectors", G4)
        + oracle.COVER
        + """,
box AS (SELECT a.z, a.y, a.x, a.core, a.keep, a.s_z, a.s_y, a.s_x, sum(b.p) / 27.0 AS r FROM inc a JOIN inc b USING (k_z, k_y, k_x, s_z, s_y, s_x)
  WHERE abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.k_z, a.k_y, a.k_x, a.z, a.y, a.x, a.core, a.keep, a.s_z, a.s_y, a.s_x),
pred AS (SELECT * FROM box)"""
        + oracle.TRIM
    )


@query(_box_sql())
def infer_tensor_boxmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seams(_chunked(spark, sf_dir, "vectors", config(G4, normalize=False), "box-mean3"))


_HEADS = shared_expression(lambda v: v * 2.0, [lambda e: e + 1.0, lambda e: -e, lambda e: e * e], to_probability=True)


@query(
    f"""WITH vox AS ({oracle.VOLUMES['vectors']}), heads AS (SELECT z, y, x, 0 AS channel, p * 2 + 1 AS h FROM vox UNION ALL SELECT z, y, x, 1, -(p * 2) FROM vox UNION ALL SELECT z, y, x, 2, p * 2 * (p * 2) FROM vox)
SELECT z, y, x, channel::BIGINT AS channel, round(greatest(0.01, least(0.99, 1 / (1 + exp(-h)))), 6) AS v FROM heads"""
)
def multi_output_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infer(plane(spark, sf_dir, "vectors"), config(G4, normalize=False), _HEADS)
    return tidy(out.select("z", "y", "x", "channel", F.round("v", 6).alias("v")))


@query(f"SELECT z, y, x, trunc(greatest(0.0, least(255.0, p * 40.0 - 100.0)))::BIGINT AS v, trunc(greatest(-128.0, least(127.0, p * 40.0 - 100.0)))::BIGINT AS s FROM ({oracle.VOLUMES['events']})")
def integer_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("p") * 40.0 - 100.0
    return tidy(plane(spark, sf_dir, "events").select("z", "y", "x", saturate(value, "uint8").alias("v"), saturate(value, "int8").alias("s")))


@query(f"SELECT z, y, x, round(1 / (1 + exp(-p)), 6) AS v FROM ({oracle.VOLUMES['vectors']})")
def sigmoid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(plane(spark, sf_dir, "vectors").select("z", "y", "x", F.round(sigmoid(F.col("p")), 6).alias("v")))


@query(
    f"""WITH vox AS (SELECT 0 AS t, 0 AS c, * FROM ({oracle.VOLUMES['events']}))
SELECT (sum(p) * 0 + count(*))::BIGINT AS voxels, round(count(*) * 2 / 1e6 / 2.5, 9) AS mb_per_second FROM vox"""
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = plane(spark, sf_dir, "events").agg(F.count("*").alias("voxels"))
    return n.select("voxels", F.round(F.col("voxels") * 2 / F.lit(1e6) / F.lit(2.5), 9).alias("mb_per_second"))


@query(f"SELECT z, y, x, p::FLOAT::DOUBLE AS p FROM ({oracle.VOLUMES['ragged']})")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel rows to chunks that fit nothing, and back; chunks hold single precision."""
    chunks = to_chunks(plane(spark, sf_dir, "ragged").withColumns({"t": F.lit(0), "c": F.lit(0)}), (7, 5, 6))
    return tidy(to_voxels(chunks).select("z", "y", "x", F.col("p").cast("double").alias("p")))


# --- lookups, names, pyramids and metadata ----------------------------------------------------------

_SAMPLES = "SELECT n_name || CASE WHEN n_nationkey % 3 = 0 THEN '_processed_2024-0' || (n_nationkey % 9 + 1)::VARCHAR || '-15_run' ELSE '' END AS sample_id, c::INTEGER AS channel, (n_nationkey + c)::DOUBLE AS p_low, (n_nationkey * 10 + 50 + c)::DOUBLE AS p_high FROM nation, range(0, 2) t(c)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    mark = F.when(k % 3 == 0, F.concat(F.lit("_processed_2024-0"), (k % 9 + 1).cast("string"), F.lit("-15_run"))).otherwise("")
    c = F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")
    return n.select(F.concat("n_name", mark).alias("sample_id"), k.alias("k"), c).select("sample_id", "channel", (F.col("k") + F.col("channel")).cast("double").alias("p_low"), (F.col("k") * 10 + 50 + F.col("channel")).cast("double").alias("p_high"))


@query(
    f"""WITH s AS ({_SAMPLES}), a AS (SELECT sample_id AS whole, sample_id, channel, p_low, p_high FROM s UNION SELECT sample_id, regexp_replace(sample_id, '_processed_\\d{{4}}-\\d{{2}}-\\d{{2}}.*$', ''), channel, p_low, p_high FROM s)
SELECT sample_id, channel::BIGINT AS channel, p_low, p_high FROM a QUALIFY row_number() OVER (PARTITION BY sample_id, channel ORDER BY (whole = sample_id) DESC, whole DESC) = 1"""
)
def sample_percentile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(with_aliases(_samples(spark, sf_dir)))


@query(
    """SELECT n_name AS name, 'S_' || n_nationkey || '_processed_2025-01-02_x' AS sample, 'S_' || n_nationkey AS base, lpad(lower(to_hex(n_nationkey * 4097)), 6, '0') AS color,
  (greatest(1, round_even(n_nationkey / 4.0, 0)))::BIGINT AS factor, n_nationkey % 2 = 0 AS cuda FROM nation"""
)
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    uri = F.concat(F.lit("s3://bucket/S_"), k.cast("string"), F.lit("_processed_2025-01-02_x/image/0"))
    sample = sample_id(uri)
    device = F.when(k % 2 == 0, F.concat(F.lit("CUDA:"), k.cast("string"))).otherwise("cpu")
    return tidy(n.select(F.col("n_name").alias("name"), sample.alias("sample"), base_sample(sample).alias("base"), hex_color(k * 4097).alias("color"), downscale_factor(k / 4.0).alias("factor"), is_cuda(device).alias("cuda")))


@query("SELECT n_name AS name, n_nationkey::BIGINT AS w, CASE WHEN n_nationkey % 2 = 0 THEN 'model' ELSE 'plain' END AS kept FROM nation")
def decoder_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights under the decoder's prefix, the longer prefix first, with the prefix removed."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    plain = F.create_map(F.concat(F.lit("decoder."), "n_name"), F.struct(k.alias("w"), F.lit("plain").alias("kept")), F.lit("encoder.x"), F.struct(F.lit(-1).alias("w"), F.lit("no").alias("kept")))
    model = F.create_map(F.concat(F.lit("model.decoder."), "n_name"), F.struct(k.alias("w"), F.lit("model").alias("kept")))
    state = F.when(k % 2 == 0, F.map_concat(plain, model)).otherwise(plain)
    return tidy(n.select(F.explode(decoder_weights(state)).alias("name", "v")).select("name", "v.w", "v.kept"))


def _pyramid_sql(levels: int) -> str:
    out = f"WITH l0 AS (SELECT z, y, x, p AS v FROM ({oracle.VOLUMES['events']}))"
    for i in range(1, levels):
        out += f", l{i} AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM l{i - 1} GROUP BY ALL)"
    return out + f" SELECT z, y, x, round(v, 9) AS v FROM l{levels - 1}"


def _pyramid(spark: SparkSession, sf_dir: str, levels: int) -> DataFrame:
    level = plane(spark, sf_dir, "events").withColumnRenamed("p", "v")
    for _ in range(levels - 1):
        level = downsample(level, (2, 2, 2))
    return tidy(level.select("z", "y", "x", F.round("v", 9).alias("v")))


@query(_pyramid_sql(2))
def pyramid_mean_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pyramid(spark, sf_dir, 2)


@query(_pyramid_sql(3))
def pyramid_mean_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pyramid(spark, sf_dir, 3)


@query(
    """WITH n AS (SELECT (max(event_id) // 100 + 1) AS z FROM events), l AS (SELECT i, z, 2.0 ** i AS f FROM n, range(0, 4) t(i))
SELECT i AS level, 0.5 * f AS scale_z, 0.25 * f AS scale_y, ceil(z / f)::BIGINT AS size_z, ceil(10 / f)::BIGINT AS size_y, least(64, ceil(z / f))::BIGINT AS chunk_z FROM l"""
)
def pyramid_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = (1, 1, *plane_shape(plane(spark, sf_dir, "events")))
    rows = [(i, s["scale"][2], s["scale"][3], s["shape"][2], s["shape"][3], s["chunk"][2]) for i, s in enumerate(scales(4, [(2, 2, 2)], (0.5, 0.25, 0.25), (1, 1, 64, 64, 64), shape))]
    return spark.createDataFrame(rows, "level long, scale_z double, scale_y double, size_z long, size_y long, chunk_z long")


@query("SELECT i AS level, 10 + 0.25 * (2.0 ** i - 1) AS origin_z, 0.125 * (2.0 ** i - 1) AS origin_y FROM range(0, 4) t(i)")
def pyramid_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, o[2], o[3]) for i, o in enumerate(origins(4, [(2, 2, 2)], (0.5, 0.25, 0.25), (10.0, 0.0, 0.0)))]
    return spark.createDataFrame(rows, "level long, origin_z double, origin_y double")


# --- telemetry ---------------------------------------------------------------------------------------

#: Samples that a monitor keeps of each series.
RING = 10_000
_TS = "SELECT event_id, ts, event_type AS series, user_id AS device, value FROM events"


@query(f"SELECT event_id, series, round(avg(value) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ({_TS})")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = telemetry.rolling_mean(fixtures.event_samples(spark, sf_dir), 4, order=("event_id",))
    return smooth.select("event_id", "series", F.round("smooth", 6).alias("smooth"))


@query(f"SELECT series, round(avg(value), 6) AS mean, max(value) AS peak, round(max(value) * 1.1, 6) AS axis_top, count(*) AS n FROM ({_TS}) GROUP BY series")
def series_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.series_mean(fixtures.event_samples(spark, sf_dir))
    return found.select("series", F.round("mean", 6).alias("mean"), "peak", F.round("axis_top", 6).alias("axis_top"), "n")


@query(
    f"""WITH s AS (SELECT *, CASE WHEN event_id % 7 = 3 THEN NULL ELSE round(value * 1000000) END AS bytes, event_id / 4.0 AS t FROM ({_TS})),
p AS (SELECT *, last_value(bytes IGNORE NULLS) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, t - lag(t) OVER (PARTITION BY series ORDER BY event_id) AS dt FROM s)
SELECT event_id, series, round(coalesce(CASE WHEN dt > 0 THEN greatest(0, (bytes - before) / 1048576.0 / dt) END, 0), 6) AS mib_s FROM p"""
)
def io_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fixtures.event_samples(spark, sf_dir)
    counter = F.when(F.col("event_id") % 7 != 3, F.round(F.col("value") * 1000000))
    samples = samples.withColumns({"bytes": counter, "t": F.col("event_id") / 4.0})
    rates = telemetry.io_rate(samples, "bytes", order=("event_id",))
    return rates.select("event_id", "series", F.round("mib_s", 6).alias("mib_s"))


@query(f"SELECT event_id, round(value * 100 / 8, 9) AS percent FROM ({_TS})")
def cpu_per_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of one core to percent of the machine."""
    return fixtures.event_samples(spark, sf_dir).select("event_id", F.round(telemetry.cpu_per_core(F.col("value") * 100, 8), 9).alias("percent"))


@query(f"SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS t FROM ({_TS})")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.relative_time(fixtures.event_samples(spark, sf_dir)).select("event_id", F.round("t", 6).alias("t"))


@query(f"SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) AS t FROM ({_TS})")
def monitor_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the start of a monitor."""
    start = F.lit("2024-01-01 00:00:00").cast(fixtures.event_samples(spark, sf_dir).schema["ts"].dataType)
    return telemetry.relative_time(fixtures.event_samples(spark, sf_dir), first=start).select("event_id", F.round("t", 6).alias("t"))


@query("SELECT max(event_id // 100) + 1 AS nz, 10::BIGINT AS ny, 10::BIGINT AS nx FROM events")
def chunk_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of a volume from the corners of its chunks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("event_id")
    voxels = e.select(F.floor(at / 100).cast("long").alias("z"), F.floor(at / 10).cast("long") % 10, (at % 10).alias("x"), F.col("value").alias("p")).toDF("z", "y", "x", "p")
    chunks = to_chunks(voxels.withColumns({"t": F.lit(0), "c": F.lit(0)}), (8, 5, 5))
    return chunks.agg(*[F.max(F.col(f"{a}0") + F.col(f"n{a}")).alias(f"n{a}") for a in "zyx"])


@query(f"SELECT series, list(event_id ORDER BY event_id) AS times, list(value ORDER BY event_id) AS values FROM (FROM ({_TS}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY event_id DESC) <= {RING}) GROUP BY series")
def series_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = telemetry.keep_last(fixtures.event_samples(spark, sf_dir), RING, order=("event_id",))  # a snapshot is a ring buffer
    return telemetry.series_pivot(samples, at="event_id")


@query(f"SELECT event_id, series, value FROM ({_TS}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY event_id DESC) <= 100")
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.keep_last(fixtures.event_samples(spark, sf_dir), 100, order=("event_id",)).select("event_id", "series", "value")


@query(f"SELECT event_id, series, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY event_id) = 1 THEN 0.0 ELSE value END AS value FROM ({_TS})")
def first_sample_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.first_sample_zero(fixtures.event_samples(spark, sf_dir), order=("event_id",)).select("event_id", "series", "value")


_GPU = "SELECT event_id, ts, event_id % 3 AS gpu_index, (event_id // 3) AS nth, CASE WHEN event_id < (SELECT max(event_id) // 2 FROM events) THEN floor(value) ELSE 0 END AS mem, event_id % 101 AS util FROM events"


def _gpu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler's rows with units, made of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = e.agg((F.floor(F.max("event_id") / 2)).alias("half"))
    e = e.crossJoin(F.broadcast(half))  # a single row
    memory = F.when(F.col("event_id") < F.col("half"), F.floor("value")).otherwise(0)
    return e.select(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("timestamp"), (F.col("event_id") % 3).cast("string").alias(" index"), F.concat(F.lit(" Device "), (F.col("event_id") % 3).cast("string")).alias(" name"),
        F.concat(F.lit(" "), memory.cast("string"), F.lit(" MiB")).alias(" memory.used [MiB]"), F.concat(F.lit(" "), (F.col("event_id") % 101).cast("string"), F.lit(" %")).alias(" utilization.gpu [%]"), "event_id",
    )


@query(f"SELECT epoch_us(ts) AS us, 'GPU ' || gpu_index || ' — Device ' || gpu_index AS gpu, mem::DOUBLE AS memory_mib, util::DOUBLE AS utilization FROM ({_GPU})")
def gpu_csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.gpu_series(parse_gpu_rows(_gpu_rows(spark, sf_dir)))
    return rows.select(F.unix_micros("ts").alias("us"), "gpu", "memory_mib", "utilization")


@query(
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY gpu_index ORDER BY event_id) - 1 AS i FROM ({_GPU})),
b AS (SELECT min(n) AS shortest, max(last) AS last FROM (SELECT gpu_index, count(*) AS n, max(i) FILTER (mem > 0) AS last FROM g GROUP BY gpu_index))
SELECT gpu_index, i, mem::DOUBLE AS memory_mib FROM g, b WHERE b.last IS NULL OR i < least(b.last + 2, b.shortest)"""
)
def idle_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _gpu_rows(spark, sf_dir)
    parsed = parse_gpu_rows(source)
    rows = telemetry.idle_truncate(parsed, by="index", order=("ts",))
    return tidy(rows.select(F.col("index").alias("gpu_index"), "i", "memory_mib"))


# --- streaming --------------------------------------------------------------------------------------


@query(f"SELECT z AS block, 5::BIGINT AS patches, (y * 10 + x)::BIGINT AS cell, round(p + 5, 6) AS value FROM ({oracle.VOLUMES['events']})")
def stream_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five patches for each plane, each adding its number, streamed out of order."""
    voxels = plane(spark, sf_dir, "events")
    cells = voxels.groupBy("z").agg(F.sort_array(F.collect_list(F.struct((F.col("y") * 10 + F.col("x")).alias("cell"), "p"))).alias("v"))
    rows = cells.select(F.col("z").alias("block"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("patch"), "v")
    rows = rows.select("block", F.col("patch").cast("long").alias("patch"), F.lit(5).cast("long").alias("total"), F.transform("v", lambda s: s["cell"]).alias("cell"), F.transform("v", lambda s: s["p"] + F.col("patch")).alias("value"))
    root = scratch_folder(spark, "stream")
    rows.orderBy(F.xxhash64("block", "patch")).repartition(3).write.parquet(f"{root}/in")
    run_to_end(stitch_when_complete(read_predictions(spark, f"{root}/in")), f"{root}/state", f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("block", "patches", "cell", F.round("value", 6).alias("value"))

