"""Chunk-grid array stores: round trips, boxes, published formats, and stores that appear whole or not at all."""

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from volquery.sources.array_store import Grid, GridReader, SCHEMA, blosc_decode, grid_for, read_array, read_grid, write_arrays

TILE = "channel int, t int, c int, z0 long, y0 long, x0 long, nz int, ny int, nx int, dtype string, data binary"


def tiles(spark, volume, block, channel=0, plane=(0, 0), parallel=3):
    rows = []
    for z in range(0, volume.shape[0], block[0]):
        for y in range(0, volume.shape[1], block[1]):
            for x in range(0, volume.shape[2], block[2]):
                part = volume[z : z + block[0], y : y + block[1], x : x + block[2]]
                rows.append((channel, *plane, z, y, x, *part.shape, part.dtype.str, bytearray(part.tobytes())))
    return spark.createDataFrame(rows, TILE).repartition(parallel)


def volume_of(frame, shape):
    out = np.zeros(shape)
    for r in frame.collect():
        part = np.frombuffer(r["data"], r["dtype"]).reshape(r["nz"], r["ny"], r["nx"])
        out[r["z0"] : r["z1"], r["y0"] : r["y1"], r["x0"] : r["x1"]] = part
    return out


@pytest.mark.parametrize("compressor, separator", [({"id": "zstd"}, "."), ({"id": "zlib", "level": 1}, "/"), ({"id": "gzip"}, "."), ({"id": "bz2"}, ".")])
def test_ragged_volume_round_trip(spark, tmp_path, compressor, separator):
    volume = np.random.default_rng(1).integers(1, 65535, (37, 22, 13)).astype("<u2")
    path = f"{tmp_path}/a.zarr"
    write_arrays(tiles(spark, volume, (20, 10, 10)), [path], grid_for(volume.shape, (10, 5, 10), "<u2", compressor, separator=separator))
    found = read_array(spark, path, task_bytes=2000)
    assert (volume_of(found, volume.shape) == volume).all()
    assert found.count() == 4 * 5 * 2 and found.rdd.getNumPartitions() > 5
    head = json.load(open(f"{path}/.zarray"))
    assert head["shape"] == [1, 1, 37, 22, 13] and head["dtype"] == "<u2" and head["zarr_format"] == 2
    assert not [p for p in os.listdir(tmp_path) if "_staging" in p]


def test_missing_chunks_are_fill_values_and_nothing_is_listed(spark, tmp_path):
    grid = grid_for((160, 160, 160), (10, 10, 10), "<u2", fill=7)
    os.makedirs(f"{tmp_path}/sparse")
    open(f"{tmp_path}/sparse/.zarray", "wb").write(grid.header())
    one = np.arange(1000, dtype="<u2").reshape(1, 1, 10, 10, 10)
    open(f"{tmp_path}/sparse/0.0.3.4.5", "wb").write(grid.encoded(one))
    found = read_array(spark, f"{tmp_path}/sparse", task_bytes=1 << 20)
    assert found.count() == 4096
    whole = volume_of(found.where("z0 = 30"), (160, 160, 160))
    assert (whole[30:40, 40:50, 50:60] == one[0, 0]).all() and (whole[30:40, :40] == 7).all()
    # chunks of fill values get no file
    volume = np.full((20, 10, 10), 7, "<u2")
    volume[10:] = 9
    write_arrays(tiles(spark, volume, (10, 10, 10)), [f"{tmp_path}/filled"], grid_for(volume.shape, (10, 10, 10), "<u2", fill=7))
    assert sorted(os.listdir(f"{tmp_path}/filled")) == [".zarray", "0.0.1.0.0"]
    assert (volume_of(read_array(spark, f"{tmp_path}/filled"), volume.shape) == volume).all()


def scanned(frame):
    """Rows that the scan itself gives, before any filter."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_box_reads_only_the_chunks_it_touches(spark, tmp_path):
    volume = np.random.default_rng(2).integers(0, 9, (40, 40, 35)).astype("<u2")
    write_arrays(tiles(spark, volume, (20, 20, 35)), [f"{tmp_path}/a"], grid_for(volume.shape, (10, 10, 10)))
    found = read_array(spark, f"{tmp_path}/a")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned(found) == 64
        box = found.where("t = 0 AND c = 0 AND z1 > 12 AND z0 < 20 AND y1 > 0 AND y0 < 10 AND x1 > 30 AND x0 < 35")
        assert scanned(box) == 1 and box.count() == 1
        assert scanned(found.where("z0 >= 11 AND z0 <= 29")) == 16 and scanned(found.where("x1 <= 34")) == 48
        assert scanned(found.where("x1 >= 35")) == 16 and scanned(found.where("z0 in (0, 10)")) == 32
        assert scanned(found.where("c = 3")) == 0 and found.where("z0 > 900").count() == 0
        for text in ("z1 > 10", "z1 >= 10", "z1 = 20", "z0 > 9", "z0 < 10", "x1 = 35", "x1 < 35", "x1 <= 10", "z0 = 5", "y1 in (10, 40)"):
            assert found.where(text).count() == sum(1 for r in found.collect() if eval(text.replace(" = ", " == "), {**r.asDict()})), text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_published_layouts(spark, tmp_path):
    """Three axes, Fortran order, big-endian values, no compressor, NaN fill; several planes in a chunk."""
    os.makedirs(f"{tmp_path}/f")
    volume = np.random.default_rng(3).normal(size=(6, 4, 5)).astype(">f4")
    head = {"zarr_format": 2, "shape": [6, 4, 5], "chunks": [4, 4, 4], "dtype": ">f4", "compressor": None, "fill_value": "NaN", "order": "F", "filters": None}
    json.dump(head, open(f"{tmp_path}/f/.zarray", "w"))
    for z in range(2):
        part = np.full((4, 4, 4), np.nan, ">f4")
        part[: 6 - 4 * z if z else 4] = volume[4 * z : 4 * z + 4, :, :4]
        open(f"{tmp_path}/f/{z}.0.0", "wb").write(part.tobytes(order="F"))
    found = volume_of(read_array(spark, f"{tmp_path}/f"), volume.shape)
    assert np.array_equal(found[:, :, :4], volume[:, :, :4].astype(float)) and np.isnan(found[:, :, 4]).all()
    os.makedirs(f"{tmp_path}/p")
    planes = np.arange(3 * 2 * 8).reshape(3, 2, 2, 2, 2).astype("<i4")
    json.dump({"zarr_format": 2, "shape": [3, 2, 2, 2, 2], "chunks": [2, 2, 2, 2, 2], "dtype": "<i4", "compressor": {"id": "zlib"}, "fill_value": None, "order": "C", "filters": None}, open(f"{tmp_path}/p/.zarray", "w"))
    for t in range(2):
        part = np.zeros((2, 2, 2, 2, 2), "<i4")
        part[: len(planes[2 * t :][:2])] = planes[2 * t :][:2]
        open(f"{tmp_path}/p/{t}.0.0.0.0", "wb").write(zlib.compress(part.tobytes()))
    rows = read_array(spark, f"{tmp_path}/p").collect()
    assert len(rows) == 6 and all((np.frombuffer(r["data"], "<i4") == planes[r["t"], r["c"]].ravel()).all() for r in rows)
    assert len(read_array(spark, f"{tmp_path}/p").where("t = 2").collect()) == 2


def blosc_frame(data, width, block, codec, split, shuffle):
    """A frame as the published description has it."""
    number = {"lz4_raw": 1, "zlib": 3, "zstd": 4}[codec]
    flags = (1 if shuffle else 0) | (0 if split else 16) | number << 5
    blocks, at = [], 16 + 4 * -(-len(data) // block)
    starts = []
    for i in range(0, len(data), block):
        part = data[i : i + block]
        if shuffle:
            body = len(part) - len(part) % width
            part = np.frombuffer(part[:body], np.uint8).reshape(-1, width).T.tobytes() + part[body:]
        n = width if split and len(part) == block and len(part) % width == 0 else 1
        out = b""
        for k in range(n):
            stream = part[k * len(part) // n : (k + 1) * len(part) // n]
            packed = zlib.compress(stream) if codec == "zlib" else pa.Codec(codec).compress(stream, asbytes=True)
            packed = packed if len(packed) < len(stream) else stream
            out += len(packed).to_bytes(4, "little") + packed
        starts.append(at)
        blocks.append(out)
        at += len(out)
    head = bytes([2, 1, flags, width]) + b"".join(n.to_bytes(4, "little") for n in (len(data), block, at))
    return head + b"".join(s.to_bytes(4, "little") for s in starts) + b"".join(blocks)


@pytest.mark.parametrize("codec", ["lz4_raw", "zlib", "zstd"])
@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("shuffle", [True, False])
def test_blosc_frames(codec, split, shuffle):
    data = (np.arange(5000) // 3 + np.random.default_rng(4).integers(0, 3, 5000)).astype("<u2").tobytes()
    assert blosc_decode(blosc_frame(data, 2, 4096, codec, split, shuffle)) == data
    assert blosc_decode(bytes([2, 1, 2, 2]) + b"".join(n.to_bytes(4, "little") for n in (6, 6, 22)) + b"abcdef") == b"abcdef"


def test_all_stores_are_published_or_none(spark, tmp_path):
    a = np.arange(800, dtype="<u2").reshape(10, 10, 8)
    grid = grid_for(a.shape, (5, 5, 4))
    both = tiles(spark, a, (5, 5, 8), 0).unionByName(tiles(spark, a + 1, (5, 5, 8), 1))
    paths = [f"{tmp_path}/one", f"{tmp_path}/two"]
    with pytest.raises(Exception, match="7 of 8|6 of 8|of 8 chunks"):
        write_arrays(both.where("NOT (channel = 1 AND z0 = 5 AND y0 = 5)"), paths, grid)
    with pytest.raises(Exception, match="does not cover whole chunks"):
        write_arrays(tiles(spark, a, (4, 5, 8)), paths[:1], grid)
    with pytest.raises(Exception, match="channel 1"):
        write_arrays(both, paths[:1], grid)
    assert os.listdir(tmp_path) == []
    write_arrays(both, paths, grid)
    assert (volume_of(read_array(spark, paths[1]), a.shape) == a + 1).all()
    with pytest.raises(Exception, match="there is an array"):
        write_arrays(both, paths, grid)
    write_arrays(tiles(spark, a + 5, (5, 5, 8)), paths[:1], grid, "overwrite")
    assert (volume_of(read_array(spark, paths[0]), a.shape) == a + 5).all()


def test_planes_share_a_store(spark, tmp_path):
    a = np.arange(64, dtype="<u2").reshape(4, 4, 4)
    grid = grid_for((2, 2, 4, 4, 4), (1, 1, 2, 4, 4))
    write_arrays(tiles(spark, a, (4, 4, 4)), [f"{tmp_path}/s"], grid)
    write_arrays(tiles(spark, a * 2, (2, 4, 4), plane=(1, 1)), [f"{tmp_path}/s"], mode="update")
    found = read_array(spark, f"{tmp_path}/s")
    assert (volume_of(found.where("t = 0 AND c = 0"), a.shape) == a).all() and (volume_of(found.where("t = 1 AND c = 1"), a.shape) == 2 * a).all()
    assert (volume_of(found.where("t = 1 AND c = 0"), a.shape) == 0).all()
    write_arrays(tiles(spark, a * 0, (4, 4, 4), plane=(1, 1)), [f"{tmp_path}/s"], mode="update")
    assert (volume_of(found.where("t = 1 AND c = 1"), a.shape) == 0).all() and not os.path.exists(f"{tmp_path}/s/1.1.0.0.0")


def test_headers():
    grid = grid_for((5, 6, 7), (2, 3, 4), "<f4", fill="NaN")
    assert Grid.parse(grid.header()) == grid and grid.counts == (1, 1, 3, 2, 2) and SCHEMA.count(",") == 12
    with pytest.raises(ValueError, match="format 2"):
        Grid.parse(b'{"zarr_format": 3, "shape": [1], "chunks": [1]}')
    with pytest.raises(FileNotFoundError):
        read_grid("/nowhere/at/all")
    with pytest.raises(FileNotFoundError):
        GridReader("file:///nowhere/at/all", 1)
