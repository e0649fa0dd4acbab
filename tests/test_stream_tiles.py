"""Stitching a stream of tiles: out of order, over restarts, and blocks that never complete."""

import random

import numpy as np
import pytest

from volquery.functions.grid import axis_starts, kept_span, valid_size
from volquery.streaming.completeness import run_to_end
from volquery.streaming.tiles import PATCH_SCHEMA, read_patches, stitch_tiles, stitched

SHAPE, PATCH = (20, 12, 12), 8


def patches_of(block, volume):
    """The kept parts of overlapping patches, numbered from 1."""
    axes = []
    for n in volume.shape:
        entries = []
        for s in axis_starts(n, PATCH, 2):
            kept = kept_span(s, valid_size(s, PATCH, n), n, 1)
            entries.append((s + kept.start, kept.stop - kept.start))
        axes.append(entries)
    parts = [(z, y, x) for z in axes[0] for y in axes[1] for x in axes[2]]
    rows = []
    for i, ((z, nz), (y, ny), (x, nx)) in enumerate(parts, 1):
        data = volume[z : z + nz, y : y + ny, x : x + nx]
        rows.append((block, i, len(parts), *volume.shape, z, y, x, nz, ny, nx, "<u2", bytearray(data.tobytes())))
    return rows


def write(spark, rows, folder, step):
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], PATCH_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_blocks_leave_when_complete_and_over_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    volumes = {b: rng.integers(1, 60000, SHAPE).astype("<u2") for b in range(5)}
    rows = [r for b, v in volumes.items() for r in patches_of(b, v)]
    rows = [r for r in rows if not (r[0] == 3 and r[1] in (2, 5))] + rows[:3]  # one block never completes, some patches come twice
    random.Random(2).shuffle(rows)
    half = len(rows) // 2
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    write(spark, rows[:half], folder, 25)
    run_to_end(stitch_tiles(read_patches(spark, folder)), state, out)
    first = spark.read.parquet(out).count()
    write(spark, rows[half:], folder, 25)
    run_to_end(stitch_tiles(read_patches(spark, folder)), state, out)  # from the checkpoint
    got = {r.block: r for r in spark.read.parquet(out).where("complete").collect()}
    assert first < 4 and sorted(got) == [0, 1, 2, 4]
    for b, r in got.items():
        assert (np.frombuffer(r.data, r.dtype).reshape(r.nz, r.ny, r.nx) == volumes[b]).all() and r.patches == len(patches_of(b, volumes[b])) and r.missing == []


def test_what_a_block_lacks_is_reported(spark, tmp_path):
    volume = np.ones(SHAPE, "<u2")
    rows = [r for r in patches_of(9, volume) if r[1] not in (2, 5)]
    folder = str(tmp_path / "in")
    write(spark, rows, folder, 50)
    query = stitch_tiles(read_patches(spark, folder), wait_seconds=1.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            write(spark, patches_of(10, volume)[:1], folder, 1)  # time passes with data
            found = spark.read.schema("block long, complete boolean, missing array<long>, patches long").parquet(str(tmp_path / "o")).where("block = 9").collect() if (tmp_path / "o").exists() else []
            if found:
                break
    finally:
        query.stop()
    assert [(r.complete, r.missing, r.patches) for r in found] == [(False, [2, 5], len(rows))]


def test_later_patches_win():
    one, two = np.full((2, 2, 2), 1, "<u2").tobytes(), np.full((2, 2, 2), 2, "<u2").tobytes()
    out = stitched((3, 2, 2), [(0, 0, 0, 2, 2, 2, one), (1, 0, 0, 2, 2, 2, two)], "<u2")
    assert out[:, 0, 0].tolist() == [1, 2, 2]
    with pytest.raises(ValueError):
        stitched((1, 1, 1), [(0, 0, 0, 2, 2, 2, one)], "<u2")
