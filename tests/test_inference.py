"""Whole jobs against an independent block loop, on ragged volumes with contextual models."""

import itertools
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from volquery.config import JobConfig
from volquery.operators.cover import axes_of, fan_out
from volquery.operators.models import MODELS, Model, SharedEncoder, load_model, shared_expression
from volquery.operators.tensor import infer_chunks, to_chunks, to_voxels
from volquery.operators.voxels import downsample, infer, select_plane

SHAPE = (13, 11, 9)


def make(**more):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return JobConfig(**({"block": (6, 8, 9), "patch": (5, 4, 4), "overlap": 2, "trim_voxels": 1, "halo": 2} | more))


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(5).integers(1, 65535, SHAPE).astype(float)


@pytest.fixture(scope="module")
def voxels(spark, volume):
    rows = [(0, 0, z, y, x, float(volume[z, y, x])) for z, y, x in np.ndindex(*SHAPE)]
    return spark.createDataFrame(rows, "t int, c int, z long, y long, x long, p double").cache()


def loop(volume, cfg, model):
    """Written from the rules alone: blocks, halo, statistics, zero-padded patches, seams, crop."""
    out = np.full((model.channels, *volume.shape), np.nan)
    for origin in itertools.product(*(range(0, n, b) for n, b in zip(volume.shape, cfg.block))):
        stop = [min(o + b, n) for o, b, n in zip(origin, cfg.block, volume.shape)]
        lo = [max(0, o - cfg.halo) for o in origin]
        hi = [min(n, s + cfg.halo) for s, n in zip(stop, volume.shape)]
        block = volume[tuple(slice(a, b) for a, b in zip(lo, hi))]
        mn, mx = 0.0, 1.0
        if cfg.normalize == "percentile":
            mn, mx = np.percentile(block, cfg.norm_lower), np.percentile(block, cfg.norm_upper)
        if cfg.normalize == "global":
            mn, mx = cfg.norm_lower, cfg.norm_upper
            block = np.minimum(np.maximum(block, mn), mx)
        scale = max(mx - mn, cfg.eps)
        if cfg.normalize:
            block = (block - mn) / scale
        if cfg.clip_bounds:
            block = np.clip(block, *cfg.clip_bounds)
        value, weight = np.zeros((model.channels, *block.shape)), np.zeros(block.shape)
        starts = []
        for n, p in zip(block.shape, cfg.patch):
            at = [0] if n <= p else sorted({*range(0, n - p + 1, p - cfg.overlap), n - p})
            starts.append(at)
        for s in itertools.product(*starts):
            patch = np.zeros(cfg.patch)
            part = block[tuple(slice(a, a + p) for a, p in zip(s, cfg.patch))]
            patch[tuple(slice(0, n) for n in part.shape)] = part
            got = model.tensor(patch[None, None])[0]
            got = got * scale + mn if cfg.output_denormalize else got
            for local in np.ndindex(*part.shape):
                at = tuple(a + i for a, i in zip(s, local))
                if cfg.seam_mode == "trim":
                    t = cfg.trim_voxels
                    if all((a == 0 or i >= t) and (a + v == n or i < v - t) for a, i, v, n in zip(s, local, part.shape, block.shape)):
                        value[(slice(None), *at)], weight[at] = got[(slice(None), *local)], 1.0
                else:
                    w = 1.0
                    for a, i, v, n in zip(s, local, part.shape, block.shape):
                        axis, left, right = 1.0, min(cfg.overlap, a), min(cfg.overlap, n - a - v)
                        if i < left:
                            axis *= 0.5 - 0.5 * np.cos(np.pi * (i + 1) / (left + 1))
                        if v - 1 - i < right:
                            axis *= 0.5 - 0.5 * np.cos(np.pi * (v - i) / (right + 1))
                        w *= max(axis, cfg.min_blend_weight)
                    value[(slice(None), *at)] += got[(slice(None), *local)] * w
                    weight[at] += w
        value /= np.maximum(weight, cfg.eps)
        inner = tuple(slice(o - a, e - a) for o, a, e in zip(origin, lo, stop))
        out[(slice(None), *[slice(o, e) for o, e in zip(origin, stop)])] = value[(slice(None), *inner)]
    return out


def dense(frame, channels=1):
    out = np.full((channels, *SHAPE), np.nan)
    for r in frame.collect():
        assert np.isnan(out[r.channel, r.z, r.y, r.x])  # every voxel once
        out[r.channel, r.z, r.y, r.x] = r.v
    return out


CASES = [
    {}, {"seam_mode": "blend"}, {"normalize": False}, {"normalize": "global", "norm_lower": 1000.0, "norm_upper": 50000.0}, {"clip_norm": True, "output_denormalize": False},
    {"block": (13, 11, 9), "patch": (8, 8, 8), "overlap": 4, "halo": 1}, {"block": (9, 9, 9), "patch": (9, 9, 9), "halo": 0, "trim_voxels": 0}, {"seam_mode": "blend", "clip_norm": (0.2, 0.8)},
]


@pytest.mark.parametrize("more", CASES)
def test_voxel_rows_match_the_loop(voxels, volume, more):
    cfg, model = make(**more), MODELS.load("patch-demean")
    got = dense(infer(select_plane(voxels, 0, 0), cfg, model))
    np.testing.assert_allclose(got, loop(volume, cfg, model), atol=1e-6)


@pytest.mark.parametrize("more", CASES[:5])
@pytest.mark.parametrize("name", ["box-mean3", "patch-demean"])
def test_chunks_match_the_loop(voxels, volume, more, name):
    cfg, model = make(**more), MODELS.load(name)
    chunks = to_chunks(voxels, (5, 11, 4))  # chunks need not be blocks
    got = dense(to_voxels(infer_chunks(chunks, cfg, model, SHAPE), "v", ("channel",)))
    np.testing.assert_allclose(got, loop(volume, cfg, model), atol=1e-6)


@pytest.mark.parametrize("more", CASES[:4])
def test_identity_gives_the_input_back(voxels, volume, more):
    cfg = make(**(more | {"clip_norm": False}))
    if cfg.normalize == "global":
        cfg.norm_lower, cfg.norm_upper = 0.0, 70000.0
    got = dense(infer(select_plane(voxels, 0, 0), cfg, MODELS.load("identity"), dtype="uint16"))
    assert (np.abs(got[0] - volume) <= 1).all() and (got > 0).all()  # cut toward zero; no gaps


def test_winner_per_axis_equals_winner_by_order(voxels):
    cfg, model, plane = make(), MODELS.load("patch-demean"), select_plane(voxels, 0, 0)
    a, b = (dense(infer(plane, cfg, model, form=form)) for form in ("separable", "max_by"))
    np.testing.assert_allclose(a, b, rtol=1e-12)  # patch sums add up in any order


def test_pointwise_rewrite_equals_the_full_plan(voxels):
    cfg, model, plane = make(), MODELS.load("affine"), select_plane(voxels, 0, 0)
    a, b = (dense(infer(plane, cfg, model, form=form)) for form in ("separable", "max_by"))
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_fan_out_does_not_depend_on_the_broadcast(voxels):
    axes, plane = axes_of(make(), SHAPE), select_plane(voxels, 0, 0)
    a, b = (sorted(map(str, fan_out(plane, axes, limit=n).select("z", "y", "x", "k_z", "s_z", "s_y", "j_x", "win_x").collect())) for n in (10**6, 0))
    assert a == b


def test_several_heads(voxels, volume):
    cfg = make(normalize=False)
    columns = shared_expression(lambda v: v / 65535.0, [lambda e: e, lambda e: 1.0 - e], to_probability=True)
    got = dense(infer(select_plane(voxels, 0, 0), cfg, columns), 2)
    encoder = SharedEncoder(lambda b: b / 65535.0, [lambda e: e, lambda e: 1.0 - e], to_probability=True)
    np.testing.assert_allclose(got, loop(volume, cfg, encoder.model()), atol=1e-9)


def test_shared_encoder_protocol():
    batch = np.random.default_rng(1).normal(size=(2, 1, 8, 8, 8))
    out = SharedEncoder(lambda b: b, [lambda x: x, lambda x: x])(batch)
    assert out.shape == (2, 2, 8, 8, 8) and (out[:, 0:1] == batch).all() and (out[:, 1:2] == batch).all()
    coded = SharedEncoder(lambda b: (b, 0, 0, 0, b * 2), [lambda latent, hidden: hidden - latent, lambda x: x[0]])(batch)
    assert np.allclose(coded[:, 0:1], batch) and np.allclose(coded[:, 1:2], batch)


def test_wrong_channel_count_fails(voxels):
    bad = Model("tensor", channels=2, tensor=lambda b: b)
    with pytest.raises(Exception, match="does not match 2 channels"):
        infer_chunks(to_chunks(voxels, (13, 11, 9)), make(), bad, SHAPE).count()


def test_planes_and_registry(voxels, tmp_path):
    with pytest.raises(IndexError):
        select_plane(voxels, 1, 0, (1, 1))
    with pytest.raises(KeyError, match="identity"):
        MODELS.load("nothing")
    with pytest.raises(FileNotFoundError):
        load_model("affine", str(tmp_path / "none.npy"))
    np.save(tmp_path / "w.npy", np.array([3.0, 1.0]))
    assert load_model("affine", str(tmp_path / "w.npy")).tensor(np.array([2.0]))[0] == 7.0
    assert MODELS.names()[:2] == ["identity", "affine"]


def test_downsample_borders(voxels, volume):
    rows = downsample(select_plane(voxels, 0, 0).withColumnRenamed("p", "v"), (2, 2, 2)).collect()
    assert len(rows) == 7 * 6 * 5
    last = next(r for r in rows if (r.z, r.y, r.x) == (6, 5, 4))
    assert last.v == volume[12, 10, 8]


def test_rows_do_not_depend_on_partitions(voxels):
    cfg, model = make(seam_mode="blend"), MODELS.load("patch-demean")
    a = dense(infer(select_plane(voxels.repartition(1), 0, 0), cfg, model))
    b = dense(infer(select_plane(voxels.repartition(7, F.col("x")), 0, 0), cfg, model))
    np.testing.assert_allclose(a, b, rtol=1e-9)
