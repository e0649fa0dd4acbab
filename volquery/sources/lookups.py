"""Percentile lookups by sample, and device sampler files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_sample, unitless, wall_clock

GPU_COLUMNS = ("timestamp", "index", "name", "memory.used [MiB]", "utilization.gpu [%]")


def read_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, channel, p_low, p_high`` of all ``*_percentiles.npz`` files in a folder."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                sample = path.rsplit("/", 1)[-1].removesuffix("_percentiles.npz")
                table = np.load(io.BytesIO(content))["combined_percentiles"]
                yield pd.DataFrame({"sample_id": sample, "channel": np.arange(len(table), dtype=np.int32), "p_low": table[:, 0].astype(float), "p_high": table[:, 1].astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_percentiles.npz").load(folder)
    return files.select("path", "content").mapInPandas(load, "sample_id string, channel int, p_low double, p_high double")


def with_aliases(percentiles: DataFrame) -> DataFrame:
    """Every sample also under its name without the mark of a processing run.  An exact name beats an
    alias, then the greatest full name wins."""
    names = F.explode(F.array_distinct(F.array(F.col("sample_id"), base_sample(F.col("sample_id")))))
    rows = percentiles.select(F.col("sample_id").alias("full"), names.alias("sample_id"), "channel", "p_low", "p_high")
    order = Window.partitionBy("sample_id", "channel").orderBy(F.desc(F.col("full") == F.col("sample_id")), F.desc("full"))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("sample_id", "channel", "p_low", "p_high")


def sample_bounds(percentiles: DataFrame, sample: str, channel: int) -> tuple[float, float]:
    row = with_aliases(percentiles).where((F.col("sample_id") == sample) & (F.col("channel") == channel)).first()
    if row is None:
        known = [r[0] for r in with_aliases(percentiles).select("sample_id").distinct().orderBy("sample_id").limit(10).collect()]
        raise KeyError(f"no percentiles of {sample!r}, channel {channel}; some samples: {known}")
    return row["p_low"], row["p_high"]


def parse_gpu_rows(rows: DataFrame) -> DataFrame:
    """``ts, index, name, memory_mib, utilization`` from the sampler's text columns."""
    missing = [c for c in GPU_COLUMNS if c not in {x.strip() for x in rows.columns}]
    if missing:
        raise ValueError(f"the sampler file lacks {missing}")
    at = {c.strip(): F.col(f"`{c}`") for c in rows.columns}
    return rows.select(
        wall_clock(at["timestamp"]).alias("ts"), F.trim(at["index"]).cast("int").alias("index"), F.trim(at["name"]).alias("name"),
        unitless(at["memory.used [MiB]"], " MiB").alias("memory_mib"), unitless(at["utilization.gpu [%]"], " %").alias("utilization"),
    )


def read_gpu_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_gpu_rows(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
