"""Quantiles by refined histograms against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volquery.operators import quantiles as q
from volquery.operators.voxels import block_statistics
from volquery.operators.cover import axes_of
from volquery.config import JobConfig


def cases():
    rng = np.random.default_rng(1)
    return {
        "one": [5.0], "two": [1.0, 2.0], "equal": [3.5] * 40, "ints": rng.integers(0, 65536, 700).astype(float).tolist(), "normal": rng.normal(size=501).tolist(),
        "wide": (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist(), "skewed": [0.0] * 400 + [1e-300, 1e300, -1e300], "close": (1.0 + np.arange(200) * 2.0**-52).tolist(), "huge": [-1.7e308, 1.7e308, 0.0],
        "negative": (-rng.exponential(size=333)).tolist(),
    }


@pytest.mark.parametrize("buckets", [1 << 16, 3])
def test_equal_to_sorted_values(spark, buckets):
    held = cases()
    if buckets == 3:
        held = {k: v for k, v in held.items() if k not in ("wide", "skewed", "huge", "ints")}
    rows = [(k, i % 2, v) for k, values in held.items() for i, v in enumerate(values)] + [(None, 0, 1.0), ("null", 0, None)]
    frame = spark.createDataFrame(rows, "k string, half int, v double").repartition(5)
    shares = (0.0, 0.005, 0.5, 0.77, 0.999, 1.0)
    found = {(r.k, r.half): r for r in q.quantiles(frame, ["k", "half"], "v", shares, buckets=buckets).collect()}
    assert len(found) == sum(len({i % 2 for i in range(len(v))}) for v in held.values())
    for k, values in held.items():
        for half in (0, 1):
            mine = sorted(values[half::2])
            if not mine:
                continue
            wanted = []
            for s in shares:
                place = s * (len(mine) - 1)
                low, high, part = mine[int(np.floor(place))], mine[int(np.ceil(place))], place - np.floor(place)
                wanted.append(low if low == high else low * (1 - part) + high * part)
            assert found[k, half].n == len(mine) and found[k, half].q == pytest.approx(wanted, rel=1e-12, abs=0), (k, half)


def test_no_rows(spark):
    assert q.quantiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", (0.5,)).count() == 0


def test_a_block_of_256_cubed(spark):
    """16.8 million distinct doubles in one block."""
    n = 256**3
    values = spark.range(n).select(F.lit(0).alias("k"), ((F.col("id") * 11400714819 % n).cast("double") * 0.37).alias("v"))
    row = q.quantiles(values, ["k"], "v", (0.005, 0.999)).first()
    assert row.n == n and row.q == pytest.approx([0.005 * (n - 1) * 0.37, 0.999 * (n - 1) * 0.37], rel=1e-12)


def test_statistics_of_blocks(spark):
    shape = (9, 7, 5)
    volume = np.random.default_rng(2).normal(size=shape)
    rows = spark.createDataFrame([(z, y, x, float(volume[z, y, x])) for z, y, x in np.ndindex(*shape)], "z long, y long, x long, p double")
    cfg = JobConfig(patch=(4, 4, 4), overlap=2, block=(5, 4, 5), trim_voxels=1)
    found = {(r.k_z, r.k_y, r.k_x): r for r in block_statistics(rows, axes_of(cfg, shape), 0.5, 99.9).collect()}
    for (z, y, x), r in found.items():
        part = volume[tuple(slice(max(0, k * b - cfg.halo), (k + 1) * b + cfg.halo) for k, b in zip((z, y, x), cfg.block))]
        assert (r.mn, r.mx) == pytest.approx(tuple(np.percentile(part, [0.5, 99.9]))) and r.n_voxels == part.size
