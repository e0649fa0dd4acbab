"""Tiles: boxes, new grids, pyramids on blocks, and jobs between array stores."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_array_store import tiles, volume_of
from volquery.config import JobConfig
from volquery.functions.scalars import saturate
from volquery.operators.models import MODELS, load_model, shared_expression
from volquery.operators.network import FileNetwork, Layers, conv3d, load_encoder, load_head, network, repeated, stripped
from volquery.operators.tensor import infer_chunks, infer_tiles, to_voxels
from volquery.operators.tiles import array_of, box_of, dividing_levels, downsample_tiles, level_shape, pyramid_in_tiles, retile, saturated, tile_voxels, to_tiles
from volquery.operators.voxels import downsample
from volquery.plans.heads import HeadsJob, model_of, parse_args, run_heads
from volquery.plans.job import build_array_pyramid, build_pyramid, run
from volquery.sources.array_store import grid_for, read_array, read_grid, write_arrays
from volquery.sources.json_files import write_json
from volquery.sources.volumes import open_box, open_volume

SHAPE = (21, 14, 9)


def dense(frame, shape, value="p"):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r["z"], r["y"], r["x"]] = r[value]
    return out


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(5).integers(1, 65535, SHAPE).astype("<u2")


@pytest.fixture(scope="module")
def store(spark, volume, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "in.zarr")
    write_arrays(tiles(spark, volume, (10, 10, 10)), [path], grid_for(SHAPE, (5, 5, 5)))
    return path


def test_saturation_equals_the_column_form(spark):
    values = [-1e30, -300.7, -0.5, 0.0, 0.9, 127.2, 128.0, 65534.9, 65535.5, 3e9, 1e19, 1e30, float("nan"), float("inf"), -float("inf")]
    for dtype in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float32", "float64"):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        wanted = [r.v for r in frame.select("i", saturate(F.col("v"), dtype).alias("v")).orderBy("i").collect()]
        got = saturated(np.array(values), dtype)
        assert [str(float(g)) for g in got] == [str(float(w)) for w in wanted], dtype


def test_boxes(spark, store, volume):
    for box in ([(3, 11), (0, 6), (4, 9)], [(0, 21), (0, 14), (0, 9)], [(20, 21), (13, 14), (8, 9)]):
        wanted = volume[tuple(slice(a, b) for a, b in box)].astype(float)
        got = dense(open_box(spark, {"driver": "zarr", "path": store}, 0, 0, box), SHAPE)[tuple(slice(a, b) for a, b in box)]
        assert (got == wanted).all()
    assert open_box(spark, {"driver": "zarr", "path": store}, 0, 1, [(0, 9)] * 3).count() == 0
    assert box_of(read_array(spark, store), 0, 0, [(3, 11), (0, 6), (4, 9)]).count() == 3 * 2 * 2
    rows = open_volume(spark, {"driver": "zarr", "kvstore": {"driver": "file", "path": store}})
    assert rows.columns == ["t", "c", "z", "y", "x", "p"] and (dense(rows, SHAPE) == volume).all()
    rows = [(0, 0, z, y, x, float(volume[z, y, x])) for z, y, x in np.ndindex(4, 4, 4)]
    memory = {"driver": "memory", "rows": rows}
    assert open_box(spark, memory, 0, 0, [(1, 3), (0, 2), (2, 4)]).count() == 8


def test_new_grids(spark, store, volume):
    plane = read_array(spark, store)
    for size in ((7, 4, 9), (3, 14, 2), (50, 50, 50)):
        moved = retile(plane, size, ("t", "c"))
        rows = moved.collect()
        assert all(r["z0"] % size[0] == 0 and r["nz"] <= size[0] for r in rows) and len(rows) == np.prod([-(-n // s) for n, s in zip(SHAPE, size)])
        assert (dense(tile_voxels(moved), SHAPE) == volume).all()
    again = to_tiles(tile_voxels(plane, "p", ("t", "c")), (8, 8, 8), "<u2")
    assert (dense(tile_voxels(again), SHAPE) == volume).all() and {r["dtype"] for r in again.collect()} == {"<u2"}
    assert array_of({"data": [1.0, 2.0], "nz": 1, "ny": 2, "nx": 1}).shape == (1, 2, 1)


@pytest.mark.parametrize("factors", [[(2, 2, 2)], [(2, 2, 2), (3, 1, 2)]])
def test_pyramids_on_blocks_equal_voxel_rows(spark, store, volume, factors):
    voxels = tile_voxels(read_array(spark, store), "v")
    blocks = read_array(spark, store)
    for level in range(1, 4):
        step = factors[min(level - 1, len(factors) - 1)]
        voxels, blocks = downsample(voxels, step), downsample_tiles(blocks, step, (4, 3, 5))
        shape = level_shape(SHAPE, factors, level)
        assert np.allclose(dense(tile_voxels(blocks, "v"), shape, "v"), dense(voxels, shape, "v"), equal_nan=False)
    aligned = retile(read_array(spark, store), (12, 8, 4))
    assert dividing_levels((12, 8, 4), factors, 4) == 2 and dividing_levels((5, 4, 4), factors, 4) == 0
    every, voxels = pyramid_in_tiles(aligned, factors, 2), tile_voxels(read_array(spark, store), "v")
    assert "Exchange" not in every.select("level")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    for level in (1, 2):
        voxels = downsample(voxels, factors[min(level - 1, len(factors) - 1)])
        shape = level_shape(SHAPE, factors, level)
        assert np.allclose(dense(tile_voxels(every.where(F.col("level") == level), "v"), shape, "v"), dense(voxels, shape, "v"))


CFG = {"patch": (6, 6, 6), "overlap": 2, "block": (10, 10, 10), "trim_voxels": 1}


def test_jobs_between_array_stores(spark, store, volume, tmp_path):
    """As in the plain pipeline: what an identity model is given comes back, without gaps."""
    out = {"driver": "zarr", "kvstore": {"driver": "file", "path": f"{tmp_path}/out"}, "metadata": {"shape": [1, 1, *SHAPE], "chunks": [1, 1, 5, 5, 5], "dtype": "<u2"}, "create": True}
    result = run(spark, {"driver": "zarr", "path": store}, out, JobConfig(**CFG, normalize=False), "identity", dtype="uint16", metrics=f"{tmp_path}/metrics.json")
    assert (volume_of(read_array(spark, f"{tmp_path}/out"), SHAPE) == volume).all()
    assert (result.voxels, result.blocks, result.clipped) == (volume.size, 3 * 2 * 1, 0)
    assert json.load(open(f"{tmp_path}/metrics.json"))["system_monitor"]["voxels"] == [volume.size]
    with pytest.raises(Exception, match="there is an array"):
        run(spark, {"driver": "zarr", "path": store}, out, JobConfig(**CFG, normalize=False), "identity", dtype="uint16")
    # a block that is no multiple of the chunks, into a store of two planes that is there
    write_arrays(tiles(spark, volume, (10, 10, 10)), [f"{tmp_path}/two"], grid_for((1, 2, *SHAPE), (1, 1, 5, 5, 5)))
    run(spark, {"driver": "zarr", "path": store}, json.dumps({"driver": "zarr", "path": f"{tmp_path}/two"}), JobConfig(**CFG | {"block": (8, 7, 9)}, normalize=False), "identity", dtype="uint16")
    assert (volume_of(read_array(spark, f"{tmp_path}/two").where("c = 0"), SHAPE) == volume).all() and len(os.listdir(f"{tmp_path}/two")) == 5 * 3 * 2 + 1
    # values beyond the type are counted
    gained = run(spark, {"driver": "zarr", "path": store}, dict(out, path=f"{tmp_path}/small", kvstore={}, metadata={"shape": [1, 1, *SHAPE], "chunks": [1, 1, 21, 14, 9], "dtype": "|u1"}), JobConfig(**CFG, normalize=False), "identity", dtype="uint8")
    assert gained.clipped == int((volume > 255).sum())
    # voxel rows go to arrays too, and two channels to two stores
    rows = [(0, 0, z, y, x, float(volume[z, y, x])) for z, y, x in np.ndindex(*SHAPE)]
    two = [{"driver": "zarr", "path": f"{tmp_path}/{n}", "create": True} for n in "ab"]
    run(spark, spark.createDataFrame(rows, "t int, c int, z long, y long, x long, p double"), two, JobConfig(**CFG, normalize=False), repeated(MODELS.load("identity"), 2), dtype="float32")
    assert (volume_of(read_array(spark, f"{tmp_path}/b"), SHAPE) == volume).all() and read_grid(f"{tmp_path}/a").dtype == "<f4"
    with pytest.raises(ValueError, match="all arrays or all folders"):
        run(spark, {"driver": "zarr", "path": store}, [two[0], f"{tmp_path}/x"], JobConfig(**CFG), repeated(MODELS.load("identity"), 2))
    with pytest.raises(ValueError, match="cannot hold"):
        run(spark, {"driver": "zarr", "path": store}, dict(out, path=f"{tmp_path}/y", metadata={"shape": [1, 1, 9, 9, 9], "chunks": [1, 1, 3, 3, 3], "dtype": "<u2"}), JobConfig(**CFG), "identity")


def test_lists_and_tiles_agree(spark, store):
    cfg = JobConfig(**CFG, seam_mode="trim")
    plane = read_array(spark, store).where("t = 0 AND c = 0")
    model = MODELS.load("box-mean3")
    a, b = to_voxels(infer_chunks(plane, cfg, model, SHAPE), "v"), tile_voxels(infer_tiles(plane, cfg, model, SHAPE, "float64"), "v")
    assert (dense(a, SHAPE, "v") == dense(b, SHAPE, "v")).all()


def test_channel_stores_appear_together(spark, tmp_path):
    rows = [[0, 0, z, y, x, float(z)] for z, y, x in np.ndindex(8, 6, 6)]
    two = shared_expression(lambda v: v, [lambda e: e, lambda e: e + 1])
    cfg = JobConfig(**CFG | {"block": (8, 8, 8)}, normalize=False)
    with pytest.raises(ValueError, match="channels"):
        from volquery.sources.volumes import write_channels

        write_channels(spark.createDataFrame([(0, 1.0), (2, 2.0)], "channel int, v double"), [f"{tmp_path}/p", f"{tmp_path}/q"])
    assert os.listdir(tmp_path) == []
    run(spark, {"driver": "memory", "rows": rows}, [f"{tmp_path}/a", f"{tmp_path}/b"], cfg, two, dtype="float64")
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and spark.read.parquet(f"{tmp_path}/b").agg(F.max("v")).first()[0] == 8
    with pytest.raises(FileExistsError):
        run(spark, {"driver": "memory", "rows": rows}, [f"{tmp_path}/c", f"{tmp_path}/b"], cfg, two)
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_pyramid_of_an_array_group(spark, store, volume, tmp_path):
    os.symlink(store, f"{tmp_path}/0")
    attributes = build_array_pyramid(spark, str(tmp_path), "brain", [(2, 2, 2)], 3, (1.0, 0.5, 0.5))
    assert len(attributes["multiscales"][0]["datasets"]) == 3 and json.load(open(f"{tmp_path}/.zattrs")) == json.loads(json.dumps(attributes))
    voxels = downsample(tile_voxels(read_array(spark, store), "v"), (2, 2, 2))
    assert read_grid(f"{tmp_path}/2").shape == (1, 1, 6, 4, 3)
    assert np.allclose(volume_of(read_array(spark, f"{tmp_path}/1"), (11, 7, 5)), dense(voxels, (11, 7, 5), "v"))


# --- networks -----------------------------------------------------------------------------------------


def plain_conv(x, w, b):
    n, _, *shape = x.shape
    out = np.zeros((n, len(w), *shape))
    reach = [k // 2 for k in w.shape[2:]]
    for i, o, *at in np.ndindex(n, len(w), *shape):
        total = b[o]
        for c, *d in np.ndindex(*w.shape[1:]):
            p = [a + e - r for a, e, r in zip(at, d, reach)]
            if all(0 <= q < s for q, s in zip(p, shape)):
                total += w[(o, c, *d)] * x[(i, c, *p)]
        out[(i, o, *at)] = total
    return out


@pytest.fixture
def checkpoints(tmp_path):
    rng = np.random.default_rng(6)
    a = {"encoder.0.weight": rng.normal(size=(3, 1, 3, 3, 3)), "encoder.0.bias": rng.normal(size=3), "mask_token": np.zeros(2)}
    np.savez(tmp_path / "encoder.npz", **a)
    heads = []
    for n, prefix in enumerate(("model.decoder.", "decoder.", "")):
        head = {f"{prefix}0.weight": rng.normal(size=(4, 3, 3, 3, 3)), f"{prefix}0.bias": rng.normal(size=4), f"{prefix}1.weight": rng.normal(size=(1, 4, 1, 1, 1)), f"{prefix}1.bias": rng.normal(size=1)}
        head |= {"encoder.9.weight": np.ones(1)} if prefix else {"extra": np.ones(1)}
        os.makedirs(tmp_path / f"h{n}")
        np.savez(tmp_path / f"h{n}" / "head.npz", **head)  # equal names in different folders
        heads.append(str(tmp_path / f"h{n}" / "head.npz"))
    return str(tmp_path / "encoder.npz"), heads


def test_convolution():
    rng = np.random.default_rng(7)
    for kernel in ((3, 3, 3), (1, 1, 1), (3, 1, 5)):
        x, w, b = rng.normal(size=(2, 2, 4, 3, 5)), rng.normal(size=(3, 2, *kernel)), rng.normal(size=3)
        assert np.allclose(conv3d(x, w, b), plain_conv(x, w, b))


def test_loading_is_not_strict(caplog):
    head = load_head({"decoder.0.weight": np.ones((4, 3, 3, 3, 3)), "decoder.1.bias": np.ones(2), "decoder.odd": np.ones(1), "x": np.ones(1)}, 3)
    assert "lacks 3 arrays" in caplog.text and "2 arrays ignored" in caplog.text
    assert (head.weights[1][0] == 0).all() and (head.weights[0][0] == 1).all()
    assert stripped({"model.decoder.a": 1, "decoder.b": 2, "c": 3}) == {"a": 1} and stripped({"c": 3}) == {"c": 3}
    with pytest.raises(ValueError, match="lacks layers"):
        load_encoder({"encoder.0.weight": np.ones((1, 1, 1, 1, 1))})


def test_a_network_from_checkpoints(spark, checkpoints, store):
    encoder, heads = checkpoints
    model = network(spark, encoder, heads)
    batch = np.random.default_rng(8).normal(size=(2, 1, 4, 4, 4))
    held = [dict(np.load(p)) for p in (encoder, *heads)]
    coded = np.maximum(plain_conv(batch, held[0]["encoder.0.weight"], held[0]["encoder.0.bias"]), 0)
    for n, prefix in enumerate(("model.decoder.", "decoder.", "")):
        h = held[n + 1]
        raw = plain_conv(np.maximum(plain_conv(coded, h[f"{prefix}0.weight"], h[f"{prefix}0.bias"]), 0), h[f"{prefix}1.weight"], h[f"{prefix}1.bias"])
        assert np.allclose(model.tensor(batch)[:, n], np.clip(1 / (1 + np.exp(-raw[:, 0])), 0.01, 0.99))
    assert isinstance(model.tensor, FileNetwork) and isinstance(load_encoder(held[0]), Layers)
    out = infer_tiles(read_array(spark, store), JobConfig(**CFG, normalize="global", norm_lower=0, norm_upper=65535, output_denormalize=False), model, SHAPE)
    assert {r.channel for r in out.select("channel").collect()} == {0, 1, 2}
    with pytest.raises(FileNotFoundError):
        network(spark, encoder, ["/nowhere.npz"])


def heads_args(source, percentiles, output, *more):
    return ["--source", source, "--percentiles", percentiles, "--output", output, "--heads", "a", "b", "c", "--sample", "s1", "--form", "array", "--patch", "6", "6", "6", "--overlap", "2", "--block", "10", "10", "10", *more]


def test_three_heads_from_the_command_line(spark, checkpoints, store, volume, tmp_path):
    encoder, heads = checkpoints
    os.makedirs(f"{tmp_path}/group")
    os.symlink(store, f"{tmp_path}/group/0")
    write_json(spark, f"{tmp_path}/group/.zattrs", {"multiscales": [{"datasets": [{"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 2.0**i, 2.0**i, 2.0**i]}]} for i in range(3)]}]})
    os.makedirs(f"{tmp_path}/percentiles")
    np.savez(f"{tmp_path}/percentiles/s1_percentiles.npz", combined_percentiles=np.array([[100.0, 60000.0]]))
    for name, more in (("net", ["--weights", encoder, "--head-weights", *heads]), ("plain", [])):
        job, args = parse_args(heads_args(f"{tmp_path}/group/0", f"{tmp_path}/percentiles", f"{tmp_path}/{name}", *more))
        result, written = run_heads(spark, job, model_of(spark, job, args))
        assert result.voxels == 3 * volume.size and set(written) == {"a", "b", "c"}
        for head in "abc":
            assert read_grid(f"{tmp_path}/{name}/{head}/2").shape == (1, 1, 6, 4, 3) and len(written[head]["multiscales"][0]["datasets"]) == 3
    a, b = (volume_of(read_array(spark, f"{tmp_path}/net/{h}/0"), SHAPE) for h in "ab")
    assert a.min() >= 0.0099 and a.max() <= 0.9901 and not np.allclose(a, b)
    plain = volume_of(read_array(spark, f"{tmp_path}/plain/c/0"), SHAPE)
    assert np.allclose(plain, np.clip((volume.astype(float) - 100) / 59900, 0, 1), atol=1e-6)
    job, args = parse_args(heads_args("x", "y", "z", "--weights", encoder, "--head-weights", heads[0]))
    with pytest.raises(ValueError, match="3 heads need"):
        model_of(spark, job, args)
    with pytest.raises(ValueError, match="names for"):
        run_heads(spark, HeadsJob("x", "y", "z", ["a", "b"]), MODELS.load("identity"))


def test_weights_from_where_spark_reads(spark, tmp_path):
    np.save(tmp_path / "w.npy", np.array([2.0, 1.0]))
    for path in (str(tmp_path / "w.npy"), f"file://{tmp_path}/w.npy"):
        assert (load_model("affine", path, spark).tensor(np.ones(2)) == 3).all()
    with pytest.raises(FileNotFoundError):
        load_model("affine", "file:///nowhere/w.npy", spark)


def test_pyramids_of_stored_blocks(spark, store, volume, tmp_path):
    retile(read_array(spark, store), (12, 8, 4)).write.parquet(f"{tmp_path}/0")
    build_pyramid(spark, f"{tmp_path}/0", str(tmp_path), "brain", [(2, 2, 2)], 4, (1.0, 0.5, 0.5))
    voxels = tile_voxels(read_array(spark, store), "v")
    for level in (1, 2, 3):
        voxels = downsample(voxels, (2, 2, 2))
        shape = level_shape(SHAPE, [(2, 2, 2)], level)
        assert np.allclose(dense(tile_voxels(spark.read.parquet(f"{tmp_path}/{level}"), "v"), shape, "v"), dense(voxels, shape, "v"))
