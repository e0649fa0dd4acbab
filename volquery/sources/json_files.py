"""Small JSON documents through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _file_system(spark, path)
    return fs.exists(jpath)


def read_json(spark: SparkSession, path: str, key: str = "") -> Any:
    """The document at ``path/key``, or at ``path`` if that is a document itself."""
    joined = f"{path.rstrip('/')}/{key}" if key else path
    if key and not exists(spark, joined) and exists(spark, path):
        joined = path
    if not exists(spark, joined):
        raise FileNotFoundError(joined)
    jpath, fs = _file_system(spark, joined)  # Spark's readers skip names that begin with a dot
    stream = fs.open(jpath)
    try:
        content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    try:
        return json.loads(content)
    except json.JSONDecodeError as error:
        raise ValueError(f"{joined} is not JSON: {error}") from error


def write_json(spark: SparkSession, path: str, document: Any) -> None:
    jpath, fs = _file_system(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(json.dumps(document, indent=2).encode()))
    finally:
        stream.close()


def write_metrics(spark: SparkSession, path: str, queues: Any, system: Any) -> bool:
    """Telemetry is not worth a job: failures are logged, not raised."""
    try:
        write_json(spark, path, {"queue_monitor": queues, "system_monitor": system})
        return True
    except Exception:
        LOG.exception("metrics could not be written to %s", path)
        return False


def write_samples(path: str, queues: DataFrame, queue_columns: Sequence[str], system: DataFrame, system_columns: Sequence[str], at: str = "t") -> None:
    """The document that ``metrics_samples`` reads, of one row a sample instant and one column a series.  It is
    one row: keep to what a monitor's ring buffer holds."""

    def monitor(samples: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        rows = samples.agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), *columns))).alias("s"))
        series = {c: F.col(f"s.{c}").cast("array<double>") for c in columns}
        times = F.col("s.t").cast("array<double>")
        if name == "queue_monitor":
            return rows.select(F.struct(times.alias("timestamps"), F.struct(*[v.alias(c) for c, v in series.items()]).alias("queues")).alias(name))
        return rows.select(F.struct(times.alias("timestamps"), *[v.alias(c) for c, v in series.items()]).alias(name))

    # a single row on either side
    both = monitor(queues, queue_columns, "queue_monitor").crossJoin(monitor(system, system_columns, "system_monitor"))
    both.write.json(path)


def metrics_samples(spark: SparkSession, path: str) -> DataFrame:
    """``monitor, series, t, value`` of a metrics document: queue sizes and system counters."""
    numbers = "array<double>"
    schema = f"queue_monitor struct<timestamps:{numbers},queues:map<string,{numbers}>>, system_monitor map<string,{numbers}>"
    document = spark.read.schema(schema).json(path, multiLine=True)
    queues = document.select(F.col("queue_monitor.timestamps").alias("ts"), F.explode("queue_monitor.queues").alias("series", "values"), F.lit("queue").alias("monitor"))
    system = document.select(F.element_at("system_monitor", "timestamps").alias("ts"), F.explode(F.map_filter("system_monitor", lambda k, v: k != "timestamps")).alias("series", "values"), F.lit("system").alias("monitor"))
    both = queues.unionByName(system).where(F.size("values") > 0)
    zipped = both.select("monitor", "series", F.explode(F.arrays_zip(F.col("ts").alias("t"), F.col("values").alias("value"))).alias("s"))
    return zipped.select("monitor", "series", "s.t", "s.value")


def pyramid_attributes(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The attributes of the image group that holds a level, in either format's file."""
    root = path.rstrip("/")
    head, _, tail = root.rpartition("/")
    root = head if tail.isdigit() else root
    for name in ("zarr.json", ".zattrs"):
        if exists(spark, f"{root}/{name}"):
            return read_json(spark, f"{root}/{name}")
    return None
