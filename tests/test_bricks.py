"""Blocks worked on in bricks against whole blocks."""

import re
import warnings

import numpy as np
import pytest

from tests.test_array_store import tiles
from volquery.config import JobConfig
from volquery.operators.bricks import axis_bricks, brick_parts, infer_bricks, part_for, task_bytes_of
from volquery.operators.models import MODELS, Model
from volquery.operators.tensor import infer_tiles
from volquery.operators.tiles import array_of
from volquery.plans.job import plan_chunks, run
from volquery.sources.array_store import grid_for, read_array, read_grid, write_arrays

SHAPE = (23, 17, 12)


def config(**more):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return JobConfig(**({"patch": (6, 5, 4), "overlap": 2, "block": (16, 17, 8), "trim_voxels": 1, "batch_size": 3} | more))


def two_channels():
    """Both depend on the whole patch."""

    def run(batch):
        middle = batch.mean(axis=(2, 3, 4), keepdims=True)
        return np.concatenate([batch - middle, 2.0 * batch + middle], axis=1)

    return Model("twice", tensor=run, channels=2)


def dense(frame, shape, channels):
    out, seen = np.full((channels, *shape), np.nan), np.zeros((channels, *shape), int)
    for row in (r.asDict() for r in frame.collect()):
        row["data"] = bytes(row["data"])
        place = (row["channel"], *[slice(row[f"{a}0"], row[f"{a}0"] + row[f"n{a}"]) for a in "zyx"])
        out[place] = array_of(row)
        seen[place] += 1
    assert (seen == 1).all()
    return out


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(7).integers(1, 65535, SHAPE).astype("<u2")


CASES = [
    {}, {"normalize": False}, {"normalize": "global", "norm_lower": 900.0, "norm_upper": 50000.0, "clip_norm": True}, {"output_denormalize": False, "clip_norm": (0.1, 0.8)},
    {"patch": (16, 17, 8), "overlap": 4, "trim_voxels": 2}, {"block": (23, 17, 12)},
]


@pytest.mark.parametrize("case, seam", [(0, "trim"), (0, "blend"), (1, "blend"), (2, "trim"), (3, "blend"), (4, "trim"), (4, "blend"), (5, "trim")])
def test_equal_to_whole_blocks(spark, volume, seam, case):
    cfg = config(seam_mode=seam, **CASES[case])
    model = two_channels()
    chunks = tiles(spark, volume, (7, 9, 5))
    wanted = dense(infer_tiles(chunks, cfg, model, SHAPE, "float64"), SHAPE, 2)
    for part in ((8, 9, 4), (1, 1, 1)) if case < 1 else ((7, 9, 5),):
        got = dense(infer_bricks(chunks, cfg, model, SHAPE, part, "float64"), SHAPE, 2)
        assert got == pytest.approx(wanted, rel=1e-9, abs=1e-7), part


def test_integers_and_clipped_values(spark, volume):
    cfg = config(normalize=False)
    chunks = tiles(spark, volume, (10, 10, 10))
    whole, parts = (f.cache() for f in (infer_tiles(chunks, cfg, MODELS.load("identity"), SHAPE, "int16"), infer_bricks(chunks, cfg, MODELS.load("identity"), SHAPE, (8, 8, 8), "int16")))
    assert (dense(parts, SHAPE, 1) == dense(whole, SHAPE, 1)).all()
    assert sum(r.clipped for r in parts.collect()) == sum(r.clipped for r in whole.collect()) == int((volume > 32767).sum())


@pytest.mark.parametrize("seam", ["trim", "blend"])
def test_bricks_of_an_axis(seam):
    cfg = config(seam_mode=seam)
    for extent in (1, 3, 6, 7, 16, 17, 40):
        for part in (1, 6, 9, 16, 99):
            for k in range(-(-extent // 16)):
                axis = axis_bricks(0, k, cfg, (extent, 17, 12), part)
                core = list(range(*axis.block.core))
                assert [g for cell in axis.cells for g in range(*cell)] == core
                given = [g for b in axis.bricks for g in range(*b.gives)]
                assert (given == core) if seam == "trim" else (set(given) == set(core))
                for b in axis.bricks:
                    assert b.reads.stop - b.reads.start <= max(part, 6) and b.reads.start <= b.gives.start and b.gives.stop <= b.reads.stop
                assert len(axis.weight) == len(core) and (axis.weight > 0).all()


def test_parts():
    cfg = config(patch=(64, 64, 64), overlap=10, block=(256, 256, 256), trim_voxels=5)
    assert part_for(cfg, 1) is None and part_for(cfg, 5) is not None
    for limit in (1 << 29, 1 << 26, 1 << 24):
        part = part_for(cfg, 1, limit)
        assert task_bytes_of(part, 1) <= limit and all(256 % p == 0 for p in part)
    assert part_for(cfg, 1, 1) == (64, 64, 64)


def test_missing_voxels_fail_the_job(spark, volume):
    chunks = tiles(spark, volume, (7, 9, 5)).where("NOT (z0 = 7 AND y0 = 0 AND x0 = 5)")
    with pytest.raises(Exception, match="voxels|bricks"):
        infer_bricks(chunks, config(normalize=False), MODELS.load("identity"), SHAPE, (8, 9, 4)).collect()


def test_no_chunks(spark, volume):
    assert infer_bricks(tiles(spark, volume, (7, 9, 5)).where("z0 < 0"), config(), MODELS.load("identity"), SHAPE, (8, 9, 4)).count() == 0


def test_voxels_are_shuffled_once_before_the_model(spark, volume):
    """The join with the bounds and the grouping by brick share one exchange of the parts."""
    cfg, part = config(), (8, 9, 4)
    plan = infer_bricks(tiles(spark, volume, (7, 9, 5)), cfg, MODELS.load("identity"), SHAPE, part)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    by_brick = re.findall(r"Exchange hashpartitioning\(k_z#\d+, k_y#\d+, k_x#\d+, b_z#", physical)
    assert len(by_brick) == 2 and "Broadcast" not in physical


def test_a_job_between_array_stores(spark, volume, tmp_path):
    """The job takes bricks where a block is over the limit, whatever the chunks of the store."""
    write_arrays(tiles(spark, volume, (10, 10, 10)), [str(tmp_path / "in")], grid_for(SHAPE, (5, 5, 5)))
    source = {"driver": "zarr", "path": str(tmp_path / "in")}
    cfg = config(seam_mode="blend", block=(16, 16, 8))
    for name, limit in (("whole", 1 << 30), ("bricks", task_bytes_of((8, 8, 8), 1))):
        sink = {"driver": "zarr", "path": str(tmp_path / name), "create": True, "metadata": {"shape": [1, 1, *SHAPE], "chunks": [1, 1, 8, 16, 8], "dtype": "<f4"}}
        done = run(spark, source, sink, cfg, "patch-demean", task_bytes=limit)
        assert done.voxels == volume.size
    assert read_grid(str(tmp_path / "bricks")).chunks[2:] == (8, 16, 8)
    got, wanted = (dense(read_array(spark, str(tmp_path / n)).selectExpr("0 AS channel", "*"), SHAPE, 1) for n in ("bricks", "whole"))
    assert got == pytest.approx(wanted, rel=1e-6, abs=1e-3)


def test_parts_of_a_brick_fit_it(spark, volume):
    cfg = config()
    widest = brick_parts(tiles(spark, volume, SHAPE), cfg, SHAPE, (8, 9, 5)).selectExpr("max(nz) AS z", "max(ny) AS y", "max(nx) AS x").first()
    assert (widest.z, widest.y, widest.x) <= (8, 9, 5)
