"""Dense volumes over ordinary tables with dense integer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 events to a z plane of 10 x 10; the value is the voxel."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.lit(0).alias("t"), F.lit(0).alias("c"), F.expr("event_id div 100").alias("z"), F.expr("(event_id div 10) % 10").alias("y"), F.expr("event_id % 10").alias("x"), F.col("value").alias("p"))


def vectors_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector of 64 to a z plane of 8 x 8."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select(F.lit(0).alias("t"), F.lit(0).alias("c"), F.col("vec_id").alias("z"), F.expr("cast(i div 8 as bigint)").alias("y"), F.expr("cast(i % 8 as bigint)").alias("x"), F.col("v").cast("double").alias("p"))


def parts_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels over part keys: size and retail price."""
    p = _table(spark, sf_dir, "part")
    at = [F.expr("p_partkey div 100").alias("z"), F.expr("(p_partkey div 10) % 10").alias("y"), F.expr("p_partkey % 10").alias("x")]
    both = F.posexplode(F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))).alias("c", "p")
    return p.select(F.lit(0).alias("t"), *at, both)


def ragged_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 events to a z plane of 8 x 5: narrower than a patch, and no whole number of blocks deep."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.lit(0).alias("t"), F.lit(0).alias("c"), F.expr("event_id div 40").alias("z"), F.expr("(event_id div 5) % 8").alias("y"), F.expr("event_id % 5").alias("x"), F.col("value").alias("p"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: ``event_id, ts, series, device, value``."""
    return _table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("series"), F.col("user_id").alias("device"), "value")
