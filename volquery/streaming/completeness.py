"""Emit-when-complete stitching of a stream of patch predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A patch prediction: its block, its place in the block's order, the block's patch count, one voxel of
#: the block (``cell``) and the value the patch gives it.
PREDICTION_SCHEMA = "block long, patch long, total long, cell array<long>, value array<double>"
RESULT_SCHEMA = "block long, patches long, cell long, value double"
_STATE = "patches array<long>, cell array<long>, best array<long>, value array<double>"


def _complete(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()
    best: dict[int, tuple[int, float]] = {}
    if state.exists:
        patches, cells, order, values = state.get
        seen, best = set(patches), {c: (o, v) for c, o, v in zip(cells, order, values)}
    total = 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            total = int(row.total)
            if row.patch in seen:  # delivered again
                continue
            seen.add(int(row.patch))
            for c, v in zip(row.cell, row.value):
                if int(c) not in best or best[int(c)][0] < row.patch:
                    best[int(c)] = (int(row.patch), float(v))
    if seen and len(seen) >= total:
        state.remove()
        cells = sorted(best)
        yield pd.DataFrame({"block": key[0], "patches": len(seen), "cell": cells, "value": [best[c][1] for c in cells]})
    else:
        cells = sorted(best)
        state.update((sorted(seen), cells, [best[c][0] for c in cells], [best[c][1] for c in cells]))


def stitch_when_complete(predictions: DataFrame) -> DataFrame:
    """Every block once, when all its patches have come, in any order and over any number of
    micro-batches; the last patch in order wins a voxel.  State is dropped as a block leaves; patches
    that come twice count once."""
    return predictions.groupBy("block").applyInPandasWithState(_complete, RESULT_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def read_predictions(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream; ``files_per_trigger`` bounds what is in flight."""
    return spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_end(stream: DataFrame, checkpoint: str, output: str) -> None:
    """All that is there, in bounded micro-batches, then stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def sample_stream(spark: SparkSession, rows_per_second: int = 2) -> DataFrame:
    """A clock of samples: ``t`` (seconds since the first), ``n``."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("n"))

