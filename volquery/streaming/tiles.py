"""Stitching a stream of predicted patches, block by block, with state kept by patch.

A patch arrives as a tile of the block it belongs to, with the part of it that is kept.  Each block's patches
are entries of a map state, so a micro-batch writes what it brings and not the block again; when the last
is there, the tiles are put in place as arrays and the block leaves.  A block that does not complete in
time leaves too, as a report of the patches it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: ``at_*``: where the kept part starts in the block; ``n_*``: its size; ``data``: its voxels, of type ``dtype``.
PATCH_SCHEMA = "block long, patch long, total long, size_z int, size_y int, size_x int, at_z int, at_y int, at_x int, n_z int, n_y int, n_x int, dtype string, data binary"
BLOCK_SCHEMA = "block long, patches long, complete boolean, missing array<long>, nz int, ny int, nx int, dtype string, data binary"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACE = ["at_z", "at_y", "at_x", "n_z", "n_y", "n_x"]


def stitched(shape: tuple[int, int, int], parts: list[tuple], dtype: str) -> np.ndarray:
    """Parts in order of their patches: where two keep a voxel the later one wins."""
    out = np.zeros(shape, np.dtype(dtype))
    for z, y, x, nz, ny, nx, data in parts:
        out[z : z + nz, y : y + ny, x : x + nx] = np.frombuffer(data, out.dtype).reshape(nz, ny, nx)
    return out


class BlockStitcher(StatefulProcessor):
    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tiles = handle.getMapState("tiles", "patch long", "at_z int, at_y int, at_x int, n_z int, n_y int, n_x int, data binary")
        self.block = handle.getValueState("block", "total long, seen long, size_z int, size_y int, size_x int, dtype string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.block.get() if self.block.exists() else None
        total, seen, shape, dtype = (known[0], known[1], known[2:5], known[5]) if known else (0, 0, None, None)
        for frame in rows:
            for row in frame.itertuples(index=False):
                total, shape, dtype = int(row.total), (int(row.size_z), int(row.size_y), int(row.size_x)), row.dtype
                patch = (int(row.patch),)
                if not self.tiles.containsKey(patch):  # else delivered again
                    self.tiles.updateValue(patch, (*[int(getattr(row, c)) for c in _PLACE], bytes(row.data)))
                    seen += 1
        if seen >= total:
            parts = [v for _, v in sorted(self.tiles.iterator(), key=lambda e: e[0])]
            self._forget()
            yield self._row(key, len(parts), True, [], stitched(shape, parts, dtype), dtype)
            return
        self.block.update((total, seen, *shape, dtype))
        if self.wait_ms is not None:
            self._stop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.block.exists():
            return
        total = self.block.get()[0]
        there = {k[0] for k in self.tiles.keys()}
        self._forget()
        # patches are numbered from 1
        yield self._row(key, len(there), False, [p for p in range(1, total + 1) if p not in there], None, None)

    def _forget(self) -> None:
        self.tiles.clear()
        self.block.clear()
        if self.wait_ms is not None:
            self._stop_timers()

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _row(key: Any, patches: int, complete: bool, missing: list[int], voxels: np.ndarray | None, dtype: str | None) -> pd.DataFrame:
        shape = voxels.shape if voxels is not None else (0, 0, 0)
        row = (int(key[0]), patches, complete, missing, *shape, dtype, voxels.tobytes() if voxels is not None else None)
        return pd.DataFrame([row], columns=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def stitch_tiles(patches: DataFrame, wait_seconds: float | None = None) -> DataFrame:
    """``BLOCK_SCHEMA``: each block once, when all its patches (PATCH_SCHEMA, any order, any number of
    micro-batches) have come, or without voxels and with what it lacks once nothing has come for it in
    ``wait_seconds``.  Without a time to wait, blocks stay until they complete, and a run over what is there
    can end (timers keep a query running).  Patches that come twice count once; those of a block that has
    left start it again."""
    patches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = None if wait_seconds is None else int(wait_seconds * 1000)
    return patches.groupBy("block").transformWithStateInPandas(BlockStitcher(wait), BLOCK_SCHEMA, "append", "none" if wait is None else "processingTime")


def read_patches(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream; ``files_per_trigger`` bounds what is in flight."""
    return spark.readStream.schema(PATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
