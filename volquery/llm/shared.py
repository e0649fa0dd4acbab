"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cover import local_frame
from ..sources.scratch import scratch_folder

#: The white space of the word definition used throughout: [^\x20\x09-\x0D]+
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
#: Texts are worked on in runs of whole rows of about this many bytes, which bounds NumPy temporaries.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of at most ``limit`` bytes (one row at least) for what is run inside: memory then
    depends neither on the rows' lengths nor on how many fit the usual 10,000 to a batch."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(limit)):
        yield


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at a table that survives
    the loss of executors.  The table is deleted when the application ends, the shuffle files behind it as
    soon as it is written."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    with small_batches(spark), _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame from ``cut`` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the rows (nulls are empty)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of whole rows with about ``limit`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each row.  Rows are apart even
    where one ends and the next begins with a word."""
    ink = ~IS_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = ink[edges]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    edges = edges[edges > 0]
    ends[edges - 1] = ink[edges - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, stops, counts


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def prefix_sums(df: DataFrame, order: list[str | Column], values: list[str], name: str) -> DataFrame:
    """Adds ``before_<value>``: the exclusive running total of each value in the global order.

    Two passes.  The first range-partitions and sorts the rows and keeps running totals inside each
    partition, in one stream.  Partition totals (one row per partition) become offsets.  No task sees
    more than its own range, so an arbitrarily hot leading key only needs a finer second key."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = list(df.schema.fields)
    local_fields = [T.StructField(f"before_{v}", T.LongType()) for v in values]
    schema = T.StructType([*fields, *local_fields, T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, part = dict.fromkeys(values, 0), task_id()
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for v in values:
                x = pc.fill_null(columns[v], 0).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(x)
                columns[f"before_{v}"] = pa.array(sums - x + totals[v])
                totals[v] += int(sums[-1]) if len(sums) else 0
            columns["_part"] = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_pydict(columns)

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = cut(ranged.mapInArrow(run, schema), name)
    sums = local.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_part").collect()
    totals, rows = dict.fromkeys(values, 0), []
    for row in sums:
        rows.append((row["_part"], *[totals[v] for v in values]))
        for v in values:
            totals[v] += row[v] or 0
    offsets = T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"_at_{v}", T.LongType()) for v in values]])
    at = local_frame(spark, rows, offsets)
    # one row per partition of the range exchange: bounded by its partition count
    joined = local.join(F.broadcast(at), "_part")
    return joined.select(*[f.name for f in fields], *[(F.col(f"before_{v}") + F.col(f"_at_{v}")).alias(f"before_{v}") for v in values])

