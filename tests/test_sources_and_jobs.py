import json

import numpy as np
import pytest

from volquery.cli import config_from, parse_args
from volquery.config import JobConfig
from volquery.operators import metadata
from volquery.operators.models import MODELS, shared_expression
from volquery.operators.tensor import to_chunks, to_voxels
from volquery.plans.job import build_pyramid, run
from volquery.sources.json_files import metrics_samples, pyramid_attributes, read_json, write_json, write_metrics
from volquery.sources.lookups import read_gpu_csv, read_percentiles, sample_bounds
from volquery.sources.volumes import open_volume, parse_spec, write_volume

SHAPE = (12, 8, 8)
CFG = {"patch": (6, 6, 6), "overlap": 2, "block": (8, 8, 8), "trim_voxels": 1}


@pytest.fixture(scope="module")
def rows():
    values = np.random.default_rng(2).integers(1, 65535, SHAPE)
    return [[0, 0, z, y, x, float(values[z, y, x])] for z, y, x in np.ndindex(*SHAPE)]


def test_specifications(spark, tmp_path, rows):
    spec = {"driver": "memory", "rows": rows[:3]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    for form in (spec, json.dumps(spec), "  " + json.dumps(spec), str(tmp_path / "spec.json")):
        assert parse_spec(spark, form) == spec
    assert open_volume(spark, spec).count() == 3
    with pytest.raises(FileNotFoundError):
        parse_spec(spark, str(tmp_path / "none.json"))


def test_planes_are_partitions(spark, tmp_path, rows):
    two = [*rows, *[[0, 1, *r[2:5], r[5] + 1] for r in rows]]
    write_volume(open_volume(spark, {"driver": "memory", "rows": two}), str(tmp_path / "v"))
    frame = open_volume(spark, {"path": str(tmp_path / "v")})
    plan = frame.where("t = 0 AND c = 1").select("p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t" in plan and "ReadSchema: struct<p:double>" in plan
    write_volume(frame.where("c = 1").selectExpr("t", "c", "z", "y", "x", "p * 0 AS p"), str(tmp_path / "w"), "overwrite")
    with pytest.raises(Exception, match="(?i)exist"):
        write_volume(frame, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="lacks"):
        open_volume(spark, {"path": str(tmp_path / "v" / "t=0" / "c=1")})


def test_run_writes_what_it_read(spark, tmp_path, rows):
    result = run(spark, {"driver": "memory", "rows": rows}, str(tmp_path / "out"), JobConfig(**CFG, normalize=False), "identity", dtype="uint16", metrics=str(tmp_path / "m" / "metrics.json"))
    got = {(r.z, r.y, r.x): r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r[2:5]): int(r[5]) for r in rows} and result.shape == SHAPE and result.mb_per_second > 0
    assert json.loads((tmp_path / "m" / "metrics.json").read_text())["system_monitor"]["seconds"]


def test_run_fans_out_and_counts_channels(spark, tmp_path, rows):
    two = shared_expression(lambda v: v, [lambda e: e, lambda e: e + 1])
    source = {"driver": "memory", "rows": rows}
    run(spark, source, [str(tmp_path / "a"), str(tmp_path / "b")], JobConfig(**CFG), two, dtype="float64")
    a, b = (spark.read.parquet(str(tmp_path / n)).count() for n in "ab")
    assert a == b == len(rows)
    with pytest.raises(ValueError, match="channels"):
        run(spark, source, str(tmp_path / "c"), JobConfig(**CFG), two)
    run(spark, source, str(tmp_path / "d"), JobConfig(**CFG), "box-mean3")  # a tensor model takes the chunk route
    assert spark.read.parquet(str(tmp_path / "d")).count() == len(rows)


def test_pyramid_store(spark, tmp_path, rows):
    run(spark, {"driver": "memory", "rows": rows}, str(tmp_path / "0"), JobConfig(**CFG, normalize=False), "identity", dtype="float64")
    attributes = build_pyramid(spark, str(tmp_path / "0"), str(tmp_path), "brain", [(2, 2, 2)], 3, (1.0, 0.5, 0.5))
    assert [spark.read.parquet(str(tmp_path / str(i))).count() for i in range(3)] == [768, 6 * 4 * 4, 3 * 2 * 2]
    assert pyramid_attributes(spark, str(tmp_path / "2")) == json.loads(json.dumps(attributes))
    assert metadata.pyramid_spec(attributes) == {"voxel": (1.0, 0.5, 0.5), "factors": [(2, 2, 2), (2, 2, 2)], "levels": 3}


def test_metadata_rules():
    assert metadata.pyramid_spec({"multiscales": [{"datasets": [{}]}]}) is None
    ome = {"attributes": {"ome": {"multiscales": [{"datasets": [{"coordinateTransformations": [{"type": "scale", "scale": [1, 1, 1.0, 1.0, 1.0]}]}, {"coordinateTransformations": [{"type": "scale", "scale": [1, 1, 2.5, 3.5, 0.4]}]}]}]}}}
    assert metadata.pyramid_spec(ome)["factors"] == [(2, 4, 1)]  # half to even, at least 1
    assert metadata.axes_for("0.1") is None and [a["name"] for a in metadata.axes_for("0.4")] == list("tczyx")
    document = metadata.omero("img", 2)
    assert [c["label"] for c in document["channels"]] == ["Channel:img:0", "Channel:img:1"] and document["channels"][1]["color"] == "000001"
    levels = metadata.scales(3, [(2, 2, 2), (4, 1, 1)], (1.0, 1.0, 1.0), (1, 1, 8, 8, 8), (1, 1, 9, 9, 9))
    assert [s["shape"][2:] for s in levels] == [[9, 9, 9], [5, 5, 5], [2, 5, 5]] and levels[2]["scale"] == [1, 1, 8, 2, 2] and levels[0]["chunk"] == [1, 1, 8, 8, 8]
    assert metadata.origins(2, [(2, 2, 4)], (1.0, 1.0, 0.5), (0.0, 0.0, 0.0))[1] == [0, 0, 0.5, 0.5, 0.75]
    for bad, error in (({"color": "fff"}, ValueError), ({"window": {"min": 0}}, KeyError), ({"window": {"min": "0", "max": 1, "start": 0, "end": 1}}, TypeError), ({"window": 3}, TypeError)):
        with pytest.raises(error):
            metadata.check_omero({"channels": [bad]})


def test_json_documents(spark, tmp_path):
    write_json(spark, str(tmp_path / "a" / "x.json"), {"k": [1]})
    assert read_json(spark, str(tmp_path / "a"), "x.json") == read_json(spark, str(tmp_path / "a" / "x.json"), "x.json") == {"k": [1]}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="not JSON"):
        read_json(spark, str(tmp_path / "bad.json"))
    assert write_metrics(spark, "nosuchscheme://x/y", {}, {}) is False
    write_json(spark, str(tmp_path / "m.json"), {"queue_monitor": {"timestamps": [0.0, 1.0], "queues": {"prep": [3, None], "w0": []}}, "system_monitor": {"timestamps": [0.5], "cpu": [7.0]}})
    found = {(r.monitor, r.series, r.t): r.value for r in metrics_samples(spark, str(tmp_path / "m.json")).collect()}
    assert found == {("queue", "prep", 0.0): 3.0, ("queue", "prep", 1.0): None, ("system", "cpu", 0.5): 7.0}


def test_percentile_lookup(spark, tmp_path):
    for name, low in (("S1_processed_2024-01-02_a", 1.0), ("S1_processed_2024-03-04_b", 2.0), ("S2", 3.0)):
        np.savez(tmp_path / f"{name}_percentiles.npz", combined_percentiles=np.array([[low, low + 10], [low + 1, low + 20]]))
    (tmp_path / "other.npz").write_bytes(b"no")
    found = read_percentiles(spark, str(tmp_path))
    assert found.count() == 6
    assert sample_bounds(found, "S1", 0) == (2.0, 12.0) and sample_bounds(found, "S2", 1) == (4.0, 23.0)
    with pytest.raises(KeyError, match="S2"):
        sample_bounds(found, "S9", 0)


def test_gpu_csv(spark, tmp_path):
    (tmp_path / "gpu.csv").write_text("timestamp, index, name, memory.used [MiB], utilization.gpu [%]\n2024/01/02 03:04:05.678, 0, A10G, 12 MiB, 34 %\n2024/01/02 03:04:06, 1, A10G, 0 MiB, 0 %\n")
    rows = read_gpu_csv(spark, str(tmp_path / "gpu.csv")).orderBy("index").collect()
    assert [(r["index"], r["name"], r["memory_mib"], r["utilization"]) for r in rows] == [(0, "A10G", 12.0, 34.0), (1, "A10G", 0.0, 0.0)]
    assert rows[0].ts.microsecond == 678000 and rows[1].ts.second == 6
    (tmp_path / "bad.csv").write_text("timestamp, index\n1, 2\n")
    with pytest.raises(ValueError, match="lacks"):
        read_gpu_csv(spark, str(tmp_path / "bad.csv"))


def test_command_line(tmp_path):
    base = ["--in-spec", "{}", "--out-spec", "a", "b", "--model-type", "identity"]
    args = parse_args(base)
    assert config_from(args).output_denormalize and args.out_spec == ["a", "b"] and config_from(args).batch_size == 64
    more = config_from(parse_args([*base, "--no-output-denormalize", "--clip-norm", "--normalize", "false", "--patch", "32", "32", "32"]))
    assert not more.output_denormalize and more.clip_norm is True and more.normalize is False and more.patch == (32, 32, 32)
    assert config_from(parse_args([*base, "--clip-norm", "0", "5"])).clip_norm == (0.0, 5.0)
    with pytest.raises(ValueError):
        config_from(parse_args([*base, "--clip-norm", "3"]))
    assert MODELS.names()


def test_multi_head_job(spark, tmp_path, rows):
    from volquery.plans.heads import parse_args as heads_args
    from volquery.plans.heads import run_heads, sample_of

    assert sample_of(spark, "s3://bucket/S7_processed_2024-01-01/image/0") == "S7_processed_2024-01-01"
    root = tmp_path / "image"
    write_volume(open_volume(spark, {"driver": "memory", "rows": rows}), str(root / "0"))
    write_json(spark, str(root / ".zattrs"), metadata.image_metadata("in", 2, [(2, 2, 2)], (1.0, 0.5, 0.5), (1, 1, *SHAPE), (1, 1, 8, 8, 8)))
    (tmp_path / "p").mkdir()
    np.savez(tmp_path / "p" / "S7_processed_2024-01-01_percentiles.npz", combined_percentiles=np.array([[0.0, 70000.0]]))
    job, _ = heads_args(["--source", str(root / "0"), "--percentiles", str(tmp_path / "p"), "--output", str(tmp_path / "o"), "--heads", "soma", "axon", "--sample", "S7", "--patch", "6", "6", "6", "--overlap", "2", "--block", "8", "8", "8"])
    model = shared_expression(lambda v: v, [lambda e: e, lambda e: 1.0 - e])
    result, written = run_heads(spark, job, model)
    assert result.shape == SHAPE and set(written) == {"soma", "axon"}
    both = spark.read.parquet(str(tmp_path / "o" / "soma" / "0")).join(spark.read.parquet(str(tmp_path / "o" / "axon" / "0")).withColumnRenamed("v", "w"), ["z", "y", "x"])
    assert both.where("abs(v + w - 1) > 1e-6").count() == 0 and both.count() == len(rows)
    assert spark.read.parquet(str(tmp_path / "o" / "axon" / "1")).count() == 6 * 4 * 4
    with pytest.raises(ValueError, match="names"):
        run_heads(spark, job, MODELS.load("identity"))
    with pytest.raises(ValueError, match="single plane"):
        run_heads(spark, job, model, c_idx=1)


@pytest.mark.parametrize("model", ["affine", "patch-demean"])
def test_chunk_jobs_equal_voxel_jobs(spark, tmp_path, model):
    """Dense blocks in and out, with and without stated extents, give the voxels of the voxel job."""
    rng = np.random.default_rng(6)
    rows = [(0, 0, z, y, x, float(rng.integers(1, 60000))) for z in range(13) for y in range(11) for x in range(9)]
    voxels = spark.createDataFrame(rows, "t int, c int, z long, y long, x long, p double")
    to_chunks(voxels, (5, 4, 9)).write.parquet(str(tmp_path / "in"))
    cfg = JobConfig(patch=(6, 6, 6), overlap=2, trim_voxels=1, block=(8, 8, 8), normalize="global", norm_lower=0.0, norm_upper=65535.0)
    run(spark, voxels, str(tmp_path / "v"), cfg, model)
    want = {(r.z, r.y, r.x): r.v for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    for i, more in enumerate(({}, {"shape": [13, 11, 9]})):
        run(spark, {"path": str(tmp_path / "in"), "form": "chunks", **more}, str(tmp_path / f"c{i}"), cfg, model)
        out = spark.read.parquet(str(tmp_path / f"c{i}"))
        assert "data" in out.columns and out.count() == 8  # a row for each block
        got = {(r.z, r.y, r.x): r.v for r in to_voxels(out, "v").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-3 + 1e-5 * abs(want[k]) for k in want)
