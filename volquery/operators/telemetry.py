"""Telemetry: rates, rolling means, series and idle truncation over sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, numbered, previous, ranged, with_neighbours

MIB = 1024 * 1024
#: Up to so many newest rows a window keeps them, as its limit acts before the shuffle.
RING_ROWS = 10_000


def rolling_mean(samples: DataFrame, window: int, value: str = "value", by: Sequence[str] = ("series",), order: Sequence[str] = ("ts",), out: str = "smooth") -> DataFrame:
    """Centred mean over ``window // 2`` samples on each side; windows of 1 or less change nothing.  A series
    is spread over range partitions, which lend each other half a window of rows."""
    if window <= 1:
        return samples.withColumn(out, F.col(value).cast("double"))
    half = window // 2
    rows = with_neighbours(ranged(samples, by, order), by, order, half)
    frame = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn(out, F.avg(value).over(frame)).where("NOT _guest").drop("_guest", PART)


def series_mean(samples: DataFrame, value: str = "value", by: Sequence[str] = ("series",)) -> DataFrame:
    return samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), (F.max(value) * 1.1).alias("axis_top"), F.count("*").alias("n"))


def io_rate(samples: DataFrame, counter: str = "value", by: Sequence[str] = ("series",), at: str = "t", order: Sequence[str] = ("t",), interval: float | None = None, out: str = "mib_s") -> DataFrame:
    """MiB per second since the sample before with a counter.  Rollbacks and first samples read 0, and so
    do missing counters, which do not move the reference point; where time stands still the rate is 0,
    or taken over ``interval`` if that is given.  A series is spread over range partitions, which hand on
    their last known counter and their last sample's time."""
    rows = previous(ranged(samples, by, order), by, order, {"_counter": counter}, {"_at": at})
    elapsed = F.col(at).cast("double") - F.col("_at").cast("double")
    if interval is not None:
        elapsed = F.when(elapsed <= 0, F.lit(interval)).otherwise(elapsed)
    rate = F.when(elapsed > 0, F.greatest(F.lit(0.0), (F.col(counter) - F.col("_counter")) / F.lit(float(MIB)) / elapsed))
    return rows.withColumn(out, F.coalesce(rate, F.lit(0.0))).drop("_counter", "_at", PART)


def relative_time(samples: DataFrame, ts: str = "ts", out: str = "t", first: Column | None = None) -> DataFrame:
    """Seconds since ``first``, such as the start of a monitor, or else since the first sample of the whole
    table (one row, joined back as a scalar)."""
    if first is not None:
        since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
        return samples.withColumn(out, since / F.lit(1e6))
    start = samples.agg(F.min(ts).alias("_start"))
    joined = samples.crossJoin(F.broadcast(start))  # a single row
    return joined.withColumn(out, (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / F.lit(1e6)).drop("_start")


def series_pivot(samples: DataFrame, value: str = "value", by: str = "series", at: str = "t") -> DataFrame:
    """One row per series with its times and values in order: the shape of a metrics snapshot.  A
    snapshot is bounded by the monitor's ring buffer; keep the last samples first."""
    rows = samples.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v")))).alias("s"))
    return rows.select(by, F.transform("s", lambda x: x["t"]).alias("times"), F.transform("s", lambda x: x["v"]).alias("values"))


def keep_last(samples: DataFrame, n: int | None, by: Sequence[str] = ("series",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest ``n`` samples of each series; no limit for null or negative ``n``.  Places count from the
    end, over range partitions of a series."""
    if n is None or n < 0:
        return samples
    newest = [F.desc(c) for c in order]
    w = Window.partitionBy(*by).orderBy(*newest)
    if n <= RING_ROWS:  # the limit acts in every task before the shuffle: a task then holds n rows of each task's
        return samples.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")
    rows = numbered(ranged(samples, by, order), by, order, "_nth")
    sizes = rows.groupBy(*[F.col(c).alias(f"_r_{c}") for c in by]).agg(F.max("_nth").alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return rows.join(sizes, same).where(F.col("_nth") > F.col("_last") - n).drop("_nth", "_last", PART, *[f"_r_{c}" for c in by])


def first_sample_zero(samples: DataFrame, value: str = "value", by: Sequence[str] = ("series",), order: Sequence[str] = ("ts",), out: str = "value") -> DataFrame:
    """The first processor sample of a series is meaningless and reads 0.  Firsts are found by an aggregate
    that combines before its shuffle and has one row a series, so a hot series fills no single task; samples
    that tie for the first all read 0, samples without a series keep their values."""
    firsts = samples.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    joined = samples.join(firsts, list(by), "left")
    return joined.withColumn(out, F.when(F.struct(*order) == F.col("_first"), F.lit(0.0)).otherwise(F.col(value))).drop("_first")


def cpu_per_core(percent: Column, cores: int) -> Column:
    """Percent of one core to percent of the machine."""
    return percent / F.lit(float(cores))


def idle_truncate(samples: DataFrame, memory: str = "memory_mib", by: str = "gpu", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Samples up to two past the last one with memory in use on any device, aligned by ordinal and no
    further than the shortest series; all of them if memory was never used."""
    placed = numbered(ranged(samples, [by], order), [by], order, "i").drop(PART)
    sizes = placed.groupBy(by).agg(F.count("*").alias("n"), F.max(F.when(F.col(memory) > 0, F.col("i"))).alias("last"))
    bound = sizes.agg(F.min("n").alias("shortest"), F.max("last").alias("last"))
    limit = F.when(F.col("last").isNull(), F.lit(2**62)).otherwise(F.least(F.col("last") + 2, F.col("shortest")))
    return placed.crossJoin(F.broadcast(bound.select(limit.alias("_limit")))).where(F.col("i") < F.col("_limit")).drop("_limit")


def gpu_series(rows: DataFrame) -> DataFrame:
    """Adds the series name of a device: index and model."""
    return rows.withColumn("gpu", F.concat(F.lit("GPU "), F.col("index").cast("string"), F.lit(" — "), F.col("name")))
