"""Windows over ordered series of any length, with edges carried between range partitions.

Rows are sorted into ranges of (series, order), so a series as long as the table spreads over all tasks, and
the ranges are stored: ``_part`` numbers them in order.  A window then runs inside each range of each series,
and what it needs from before or after comes from summaries of a few rows a range: running sums, last known
values, or as many rows at the edges as the window reaches.  Ties in the order lie in one range.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder

PART = "_part"


def ranged(samples: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The samples with ``_part``, stored in ranges of (by, order)."""
    spark = samples.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_folder(spark, "ranges")
    samples.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _alike(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A left join in which nulls are equal; the columns of ``right`` are dropped."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    return left.join(named, same, "left").drop(*[f"_r_{c}" for c in columns])


def carried(rows: DataFrame, by: Sequence[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``by, _part`` and what earlier ranges of the series leave to each: ``summary`` are aggregates of a range,
    ``carry`` expressions of these, over the ranges before (see ``before``).  A row a range and series."""
    totals = rows.groupBy(*by, PART).agg(*[c.alias(n) for n, c in summary.items()])
    return totals.select(*by, PART, *[c.alias(n) for n, c in carry.items()])


def before(by: Sequence[str]) -> Window:
    """The earlier ranges of a series."""
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The place of each row in its series, from 0."""
    offsets = carried(rows, by, {"_n": F.count("*")}, {"_offset": F.coalesce(F.sum("_n").over(before(by)), F.lit(0))})
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order)) - 1)
    return _alike(inside, offsets, [*by, PART]).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], known: dict[str, str], lagged: dict[str, str]) -> DataFrame:
    """Adds, for each row, the last value of ``known`` columns that is not null and the last value of
    ``lagged`` columns, of the rows before it in its series (output name to column)."""
    at = F.struct(*order)
    summary = {f"_k_{n}": F.max_by(c, F.when(F.col(c).isNotNull(), at)) for n, c in known.items()} | {f"_l_{n}": F.max_by(F.struct(c), at) for n, c in lagged.items()}
    carry = {f"_b_{n}": F.last(f"_k_{n}", ignorenulls=True).over(before(by)) for n in known}
    carry |= {f"_b_{n}": F.last(f"_l_{n}").over(before(by)) for n in lagged}
    edges = carried(rows, by, summary, carry)
    w = Window.partitionBy(*by, PART).orderBy(*order)
    inside = {f"_i_{n}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, c in known.items()}
    inside |= {f"_i_{n}": F.lag(F.struct(c)).over(w) for n, c in lagged.items()}
    joined = _alike(rows.withColumns(inside), edges, [*by, PART])
    out = {n: F.coalesce(f"_i_{n}", f"_b_{n}") for n in known} | {n: F.coalesce(f"_i_{n}", f"_b_{n}")[c] for n, c in lagged.items()}
    return joined.withColumns(out).drop(*[f"_{k}_{n}" for k in "ib" for n in (*known, *lagged)])


def with_neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], reach: int) -> DataFrame:
    """The rows, and copies of those that lie within ``reach`` rows of another range of the series, in that
    range (``_guest``).  A range gives at most ``reach`` rows to either side."""
    columns = [c for c in rows.columns if c != PART]
    body = F.struct(*[F.col(c) for c in columns])
    w = Window.partitionBy(*by, PART)
    ends = rows.withColumns({"_up": F.row_number().over(w.orderBy(*order)), "_down": F.row_number().over(w.orderBy(*[F.desc_nulls_last(c) for c in order]))})
    ends = ends.where((F.col("_up") <= reach) | (F.col("_down") <= reach))
    head = F.sort_array(F.collect_list(F.when(F.col("_up") <= reach, F.struct("_up", body.alias("row")))))
    tail = F.sort_array(F.collect_list(F.when(F.col("_down") <= reach, F.struct((-F.col("_down")).alias("_up"), body.alias("row")))))
    lists = ends.groupBy(*by, PART).agg(head.alias("_head"), tail.alias("_tail"))  # ``reach`` rows each
    series = Window.partitionBy(*by).orderBy(PART)
    # every range has a row, so the ``reach`` ranges next to one hold all that it can need
    earlier = F.flatten(F.collect_list("_tail").over(series.rowsBetween(-reach, -1)))
    later = F.flatten(F.collect_list("_head").over(series.rowsBetween(1, reach)))
    near = F.concat(F.slice(earlier, F.greatest(F.lit(1), F.size(earlier) - (reach - 1)), F.lit(reach)), F.slice(later, 1, reach))
    guests = lists.select(F.col(PART), near.alias("_near")).select(PART, F.explode("_near").alias("_g")).select("_g.row.*", PART)
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
