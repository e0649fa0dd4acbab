import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from volquery.functions import grid
from volquery.operators.cover import Axis, cover_column, cover_frame
from volquery.operators.tiling import block_grid, patch_table


@pytest.mark.parametrize("length, patch, overlap, starts", [(32, 16, 4, [0, 12, 16]), (10, 4, 1, [0, 3, 6]), (266, 64, 10, [0, 54, 108, 162, 202]), (12, 6, 2, [0, 4, 6]), (6, 6, 2, [0]), (3, 6, 2, [0])])
def test_axis_starts(length, patch, overlap, starts):
    assert grid.axis_starts(length, patch, overlap) == starts


def test_patches_of_a_cube():
    assert len(grid.patch_starts((32, 32, 32), (16, 16, 16), 4)) == 27
    assert grid.patch_starts((10, 10, 10), (4, 4, 4), 1)[:3] == [(0, 0, 0), (0, 0, 3), (0, 0, 6)]
    assert [len(b) for b in grid.batches(list(range(27)), 4)] == [4] * 6 + [3]


def test_blocks_are_clipped_and_widened():
    blocks = grid.axis_blocks(25, 10, 3)
    assert [(b.core, b.wide) for b in blocks] == [((0, 10), (0, 13)), ((10, 20), (7, 23)), ((20, 25), (17, 25))]
    assert [i for i, _ in grid.iter_blocks((25, 10, 20), (10, 10, 10))][:3] == [(0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_blend_ramp():
    ramp = grid.blend_ramp(4, 6, 20, 2, 0.05)
    np.testing.assert_allclose(ramp, [0.25, 0.75, 1, 1, 0.75, 0.25])
    assert grid.blend_ramp(0, 6, 20, 2, 0.05)[0] == 1 and grid.blend_ramp(14, 6, 20, 2, 0.05)[-1] == 1
    assert grid.blend_ramp(4, 6, 20, 2, 0.5).min() == 0.5


def test_shards():
    assert grid.shard_of(7, 3) == 1
    with pytest.raises(ZeroDivisionError):
        grid.shard_of(7, 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(2, 12), st.integers(0, 6), st.integers(0, 3), st.integers(0, 3))
def test_covers_leave_no_gap(extent, patch, overlap, trim, more):
    overlap = min(overlap, patch - 1)
    trim = min(trim, overlap // 2)
    cover = grid.axis_cover(extent, patch + more, patch, overlap, trim + more, trim, 0.05)
    winners = [r.g for r in cover if r.core and r.win]
    assert sorted(winners) == list(range(extent))  # each coordinate has one last word
    assert all(r.w > 0 for r in cover)


@pytest.mark.parametrize("axis", [Axis("z", 25, 10, 6, 2, 1, 1, 0.05), Axis("z", 23, 8, 8, 4, 2, 1, 0.05), Axis("z", 5, 10, 8, 2, 3, 1, 0.05), Axis("z", 40, 7, 4, 1, 9, 0, 0.3)])
def test_cover_by_arithmetic_equals_the_table(spark, axis):
    from pyspark.sql import functions as F

    table = {tuple(r[:1]) + tuple(round(x, 12) if isinstance(x, float) else x for x in r[1:]) for r in cover_frame(spark, axis).collect()}
    rows = spark.range(axis.extent).select(F.col("id").alias("g"), F.explode(cover_column(F.col("id"), axis)).alias("r")).select("g", "r.*").collect()
    assert {tuple(r[:1]) + tuple(round(x, 12) if isinstance(x, float) else x for x in r[1:]) for r in rows} == table
    assert len(rows) == len(table) <= axis.rows


def test_block_and_patch_tables(spark):
    blocks = block_grid(spark, (25, 12, 9), (10, 6, 9), 2)
    rows = blocks.orderBy("k").collect()
    expected = list(grid.iter_blocks((25, 12, 9), (10, 6, 9)))
    assert [(r.k_z, r.k_y, r.k_x) for r in rows] == [i for i, _ in expected]
    assert [(r.start_z, r.stop_z) for r in rows] == [tuple(s[0]) for _, s in expected]
    patches = patch_table(blocks, (6, 6, 6), 2).collect()
    for r in rows:
        mine = sorted((p.n, (p.s_z, p.s_y, p.s_x)) for p in patches if p.k == r.k)
        shape = (r.hi_z - r.lo_z, r.hi_y - r.lo_y, r.hi_x - r.lo_x)
        assert [s for _, s in mine] == grid.patch_starts(shape, (6, 6, 6), 2)
        assert [n for n, _ in mine] == list(range(len(mine)))
