"""Block and patch tables: tiling as table-generating operators, computed per row by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import ceil_div

Triple = tuple[int, int, int]


def block_grid(spark: SparkSession, shape: Triple, block: Triple, halo: int = 0) -> DataFrame:
    """One row per block, the last axis fastest: ``k``, and ``k_a, start_a, stop_a, lo_a, hi_a, left_a``
    of each axis: index, core, widened span and how much of it lies before the core."""
    counts = [ceil_div(n, b) for n, b in zip(shape, block)]
    out = spark.range(counts[0] * counts[1] * counts[2]).withColumnRenamed("id", "k")
    index = {"z": f"k div {counts[1] * counts[2]}", "y": f"(k div {counts[2]}) % {counts[1]}", "x": f"k % {counts[2]}"}
    for (a, expression), n, b in zip(index.items(), shape, block):
        k = F.expr(expression)
        start, stop = k * b, F.least((k + 1) * b, F.lit(n).cast("long"))
        lo, hi = F.greatest(start - halo, F.lit(0).cast("long")), F.least(stop + halo, F.lit(n).cast("long"))
        out = out.withColumns({f"k_{a}": k, f"start_{a}": start, f"stop_{a}": stop, f"lo_{a}": lo, f"hi_{a}": hi, f"left_{a}": start - lo})
    return out


def starts_column(length: Column, patch: int, overlap: int) -> Column:
    """Patch starts of an axis as an array."""
    stride, length = max(1, patch - overlap), length.cast("long")
    last = length - patch
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")), F.lit(stride).cast("long"))
    return F.when(length <= patch, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def patch_table(blocks: DataFrame, patch: Triple, overlap: int) -> DataFrame:
    """One row per patch of every block: ``k, n, s_a, v_a``; ``n`` numbers a block's patches in order."""
    lengths = {a: F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "zyx"}
    each = blocks.select("k", *[lengths[a].alias(f"len_{a}") for a in "zyx"])
    for a, p in zip("zyx", patch):
        each = each.withColumn(f"starts_{a}", starts_column(F.col(f"len_{a}"), p, overlap))
    for a in "zyx":
        each = each.select("*", F.posexplode(f"starts_{a}").alias(f"i_{a}", f"s_{a}"))
    number = (F.col("i_z") * F.size("starts_y") + F.col("i_y")) * F.size("starts_x") + F.col("i_x")
    valid = [(F.least(F.col(f"s_{a}") + p, F.col(f"len_{a}")) - F.col(f"s_{a}")).alias(f"v_{a}") for a, p in zip("zyx", patch)]
    return each.select("k", number.cast("long").alias("n"), "s_z", "s_y", "s_x", *valid)


def micro_batches(patches: DataFrame, size: int) -> DataFrame:
    """``k, batch, n_patches``: batches never span blocks."""
    return patches.groupBy("k", F.floor(F.col("n") / size).cast("long").alias("batch")).agg(F.count("*").alias("n_patches"))


def patches_of_blocks(patches: DataFrame) -> DataFrame:
    return patches.groupBy("k").agg(F.count("*").alias("total"))


def shard(linear: Column, shards: int) -> Column:
    """The writer of a block, or the reader under strided partitioning."""
    if shards < 1:
        raise ZeroDivisionError("at least one shard is needed")
    return F.pmod(linear, F.lit(shards)).cast("long")
