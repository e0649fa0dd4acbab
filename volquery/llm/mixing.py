"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time.  Its integral gives the source's cumulative
token demand; inverting that demand turns a document's place in its source's stream into a training
position, and range-sorting by position gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, prefix_sums, row_slices, text_buffers, word_bounds

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Piecewise linear schedules (training time, relative weight), one for each weight: the first kind of
#: source fades, the second grows, the third peaks in the middle.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)


def word_sizes(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus ``size``, the number of words of the whole text (null: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [word_bounds(*text_buffers(part.column("_text")))[2] for part in row_slices(batch, "_text")]
            sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"size": pa.array(sizes)})

    narrow = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInArrow(count, f"{schema}, size bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, source_start, kind, target``.

    Targets share ``share`` times all words by weight; a target stops at ``cap`` times its source's
    size and what it leaves is shared again among the others until none is above its cap."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(sources, [F.col("source").asc_nulls_last()], ["one", "source_size"], "mix-sources")
    kind = (F.col("before_one") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)
    ranked = ranked.select("source", "source_size", F.col("before_source_size").alias("source_start"), kind.alias("kind"), weight.alias("weight"))
    ranked = cut(ranked, "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words per unit of weight for the sources below their caps
    while True:
        capped = F.col("weight") * F.lit(level) >= F.lit(cap) * F.col("source_size")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        room = share * total - cap * (row["full"] or 0)
        new = room / row["open"] if row["open"] else level
        if not row["open"] or new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), F.lit(float(cap)) * F.col("source_size"))
    return ranked.select("source", "source_size", "source_start", "kind", target.alias("target"))


def invert_demand(fraction: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The training time at which a source with this schedule has used ``fraction`` of its demand."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole, used, out = math.fsum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:]), areas):
        slope = (w1 - w0) / (t1 - t0)
        left = fraction * whole - used  # area still to use inside this segment: w0 x + slope x^2 / 2
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * left))
        time = F.lit(t0) + (F.lit(2.0) * left / F.greatest(F.lit(w0) + root, F.lit(1e-300)))
        time = F.least(F.lit(t1), time)
        out = F.when(fraction < (used + area) / whole, time) if out is None else out.when(fraction < (used + area) / whole, time)
        used += area
    return out.otherwise(F.lit(schedule[-1][0]))


def mix(sizes: DataFrame, key: str = "doc_id", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, cap: float = 2.0, seed: int = 7, name: str = "mix") -> DataFrame:
    """The mix as one row per input row, range-sorted by ``position``.

    Input: ``key``, ``source`` (may be null: a source of its own, last) and ``size`` (words).  Output:
    ``key, source, size, source_size, target, taken, passes, position, position_2``.

    A source's documents, in a keyed random order, form a stream that is gone through again until the
    source's target is met; the document at the end is cut, so ``taken`` (words used, repeats counted)
    adds up to the target to within one word, and is at most ``cap`` (here 2) times the size.
    ``position`` is the training time (0 to 1) of the first use, ``position_2`` of the second (null
    if not used).  Empty documents take nothing and have no position; they come last.  Repeated rows
    are mixed as rows of their own.  Reruns agree: the order is a hash of the key, then all columns."""
    targets = source_targets(sizes, weights, share, cap)
    shuffled = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    keyed = sizes.select(F.col(key).alias("_key"), "source", "size", shuffled.alias("_order"))
    order = [F.col("source").asc_nulls_last(), F.col("_order"), F.col("_key"), F.col("size")]
    placed = prefix_sums(keyed, order, ["size"], name)
    joined = placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    start = F.col("before_size") - F.col("source_start")
    goal = F.floor(F.col("target")).cast("long")
    used = [F.greatest(F.lit(0), F.least(F.col("size"), goal - start - F.lit(k) * F.col("source_size"))) for k in range(math.ceil(cap))]

    def position(k: int) -> Column:
        at = (start + F.lit(k) * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
        time = None
        for i, schedule in enumerate(schedules):
            t = invert_demand(at, schedule)
            time = F.when(F.col("kind") % len(schedules) == i, t) if time is None else time.when(F.col("kind") % len(schedules) == i, t)
        return F.when(used[k] > 0, time)

    taken = used[0]
    for u in used[1:]:
        taken = taken + u
    out = joined.select(
        F.col("_key").alias(key), "source", F.col("size"), "source_size", "target", taken.cast("long").alias("taken"),
        sum((F.when(u > 0, 1).otherwise(0) for u in used[1:]), F.when(used[0] > 0, 1).otherwise(0)).alias("passes"),
        position(0).alias("position"), (position(1) if len(used) > 1 else F.lit(None).cast("double")).alias("position_2"),
    )
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("position").asc_nulls_last(), F.col(key)]
    return out.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _time_sql(fraction: str, schedule: Sequence[tuple[float, float]]) -> str:
    """``invert_demand`` as SQL."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole, used, cases = math.fsum(areas), 0.0, ""
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:]), areas):
        slope, left = (w1 - w0) / (t1 - t0), f"({fraction} * {whole!r}::DOUBLE - {used!r}::DOUBLE)"
        root = f"sqrt(greatest(0.0, {w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {left}))"
        cases += f" WHEN {fraction} < {(used + area) / whole!r}::DOUBLE THEN least({t1!r}::DOUBLE, {t0!r}::DOUBLE + 2.0::DOUBLE * {left} / ({w0!r}::DOUBLE + {root}))"
        used += area
    return f"CASE{cases} ELSE {schedule[-1][0]!r}::DOUBLE END"


def _position_sql(use: int) -> str:
    at = f"((start + {use} * source_size) / target)"
    kinds = " ".join(f"WHEN {i} THEN {_time_sql(at, s)}" for i, s in enumerate(SCHEDULES))
    return f"CASE WHEN use_{use} > 0 THEN round(CASE kind % {len(SCHEDULES)} {kinds} END, 9) END"


#: The mix of ``documents`` with the default settings.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws('-', '7', doc_id)) AS o FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS kind FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][kind + 1]::DOUBLE AS weight FROM src),
lv AS (SELECT 0.0::DOUBLE AS level, 0 AS n UNION ALL
  SELECT coalesce((SELECT (1.5 * sum(source_size) - 2 * coalesce(sum(source_size) FILTER (weight * level >= 2 * source_size), 0)) / sum(weight) FILTER (weight * level < 2 * source_size) FROM w), level), n + 1 FROM lv WHERE n < 60),
t AS (SELECT source, source_size, kind, least(weight * (SELECT max(level) FROM lv), 2.0 * source_size) AS target FROM w),
s AS (SELECT d.*, source_size, kind, target, (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS use_0, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS use_1 FROM s)
SELECT doc_id, size, source_size, target, use_0 + use_1 AS taken, {_position_sql(0)} AS position, {_position_sql(1)} AS position_2 FROM u
"""
