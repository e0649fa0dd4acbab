"""Exact interpolated quantiles of groups by refined histograms.

The two ranks around each quantile are looked for in a range of values, at first all of a group.  A pass
counts the range's rows in BUCKETS equal parts (combined before the shuffle) and keeps the part that holds
the rank, narrowed to the least and greatest value in it; a range of a single value is an answer.  Memory
does not depend on the number of rows or distinct values; integers of 16 bits take one pass, doubles as a rule
two or three.  Each pass reads only the rows that are still in some range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder

BUCKETS = 1 << 16


def _stored(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], out: str = "q", buckets: int = BUCKETS) -> DataFrame:
    """``by, n, out``: the number of values of each group and, for each of ``shares`` (0 to 1), the value at
    place ``share * (n - 1)``, between two neighbours by their distance.  Null values and keys are left
    out; values must be finite."""
    v, low, high = F.col(value), F.col("_low"), F.col("_high")
    rows = rows.select(*by, value).where(" AND ".join(f"{c} IS NOT NULL" for c in (*by, value)))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    places = F.array(*[F.lit(float(s)) * (F.col("n") - 1) for s in shares])
    asked = groups.select(*by, "n", "_low", "_high", F.posexplode(places).alias("_share", "_place"))
    floor = F.floor("_place").cast("long")
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("_side"), floor.alias("_rank")), F.struct(F.lit(1).alias("_side"), F.ceil("_place").cast("long").alias("_rank")))).alias("_r")
    found = _stored(asked.select(*by, "n", "_share", "_place", "_low", "_high", ranks).select(*by, "n", "_share", "_place", "_low", "_high", "_r.*"), "ranks")
    done = found.where("_low = _high")
    open_ = found.where("_low < _high")
    inside = rows
    while not open_.isEmpty():
        ranges = open_.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_low", "_high").distinct()
        same = [F.col(c) == F.col(f"_b_{c}") for c in by]
        inside = inside.join(ranges, same).where((v >= low) & (v <= high))
        # quarters: the difference of two finite doubles may be none
        part = F.floor((v / 4 - low / 4) / (high / 4 - low / 4) * buckets).cast("int")
        counted = inside.groupBy(*by, "_low", "_high", F.least(part, F.lit(buckets - 1)).alias("_part")).agg(F.count("*").alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to"))
        # at most ``buckets`` rows of a range
        before = F.sum("_n").over(Window.partitionBy(*by, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        counted = counted.withColumn("_before", F.coalesce(before, F.lit(0)))
        held = open_.join(counted, [*by, "_low", "_high"]).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        step = _stored(held.select(*by, "n", "_share", "_place", F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_side", (F.col("_rank") - F.col("_before")).alias("_rank")), "ranks")
        done, open_ = done.unionByName(step.where("_low = _high")), step.where("_low < _high")
        # what is in no chosen part is read no more; ranges only shrink, so the next pass starts from these
        kept = step.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_low").alias("_a"), F.col("_high").alias("_z")).where("_a < _z").distinct()
        rest = inside.drop("_low", "_high", *[f"_b_{c}" for c in by]).join(kept, same)
        inside = _stored(rest.where((v >= F.col("_a")) & (v <= F.col("_z"))).select(*by, value), "inside")
    ends = done.groupBy(*by, "n", "_share", "_place").agg(F.max(F.when(F.col("_side") == 0, F.col("_low"))).alias("_lo"), F.max(F.when(F.col("_side") == 1, F.col("_low"))).alias("_hi"))
    share = F.col("_place") - F.floor("_place")
    at = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * (1 - share) + F.col("_hi") * share)
    listed = F.sort_array(F.collect_list(F.struct("_share", at.alias("_v"))))  # one entry a share
    return ends.groupBy(*by, "n").agg(F.transform(listed, lambda x: x["_v"]).alias(out))
