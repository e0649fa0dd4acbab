"""The attributes of many image groups as a table: read on executors, checked and unnested by column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .array_store import _files, _read

#: Where a group keeps its attributes, in order.
NAMES = ("zarr.json", ".zattrs")
_SCALES = "array<struct<name:string, datasets:array<struct<path:string, coordinateTransformations:array<struct<type:string, scale:array<double>>>>>>>"
_PLAIN = f"multiscales:{_SCALES}, ome:struct<multiscales:{_SCALES}>"
#: Both nestings: attributes at the top, or below ``attributes`` and ``ome``.
SCHEMA = f"struct<{_PLAIN}, attributes:struct<{_PLAIN}>>"


def group_documents(groups: DataFrame, path: str = "path") -> DataFrame:
    """``path, file, body``: the first attribute file that each group has; nulls where it has none.  One task
    reads the groups of its partition; only small documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for root in batch.column(0).to_pylist():
                files, inner = _files(root.rstrip("/"))
                held = next(((n, b) for n in NAMES if (b := _read(files, f"{inner}/{n}")) is not None), (None, None))
                found.append((root, held[0], held[1].decode("utf-8", "replace") if held[1] is not None else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 3, names=["path", "file", "body"])

    return groups.select(F.col(path).alias("path")).where("path IS NOT NULL").mapInArrow(run, "path string, file string, body string")


def image_levels(documents: DataFrame) -> DataFrame:
    """``path, reason, level, dataset, scale, factor``: a row for each level of each group's image, with its
    voxel size (z, y, x) and the whole factors to the level before; a group whose attributes do not say so has
    one row with the reason."""
    parsed = documents.withColumn("_d", F.from_json("body", SCHEMA))
    image = F.coalesce(*[F.col(f"_d.{p}multiscales")[0] for p in ("attributes.ome.", "attributes.", "ome.", "")])
    sets = image["datasets"]
    sizes = F.transform(sets, lambda s: F.slice(F.get(F.filter(s["coordinateTransformations"], lambda t: t["type"] == "scale"), F.lit(0))["scale"], -3, 3))
    good = F.forall("_sizes", lambda v: F.coalesce(F.size(v) == 3, F.lit(False)) & F.forall(F.coalesce(v, F.array()), lambda x: F.coalesce(x > 0, F.lit(False))))
    is_json = F.try_parse_json("body").isNotNull()
    reason = (
        F.when(F.col("body").isNull(), "no attributes").when(~is_json, "not JSON").when(F.col("_sets").isNull(), "no image").when(F.size("_sets") < 2, "fewer than two levels").when(~F.coalesce(good, F.lit(False)), "a level without scale")
    )
    held = parsed.withColumns({"_sets": sets, "_sizes": F.when(sets.isNotNull(), sizes)}).withColumn("reason", reason)
    bad = held.where("reason IS NOT NULL").select("path", "reason", *[F.lit(None).cast(t).alias(n) for n, t in (("level", "int"), ("dataset", "string"), ("scale", "array<double>"), ("factor", "array<bigint>"))])
    names = F.transform("_sets", lambda s: s["path"])
    each = held.where("reason IS NULL").select("path", "reason", F.posexplode(F.arrays_zip(names.alias("dataset"), F.col("_sizes").alias("scale"))).alias("level", "_s"))
    each = each.select("path", "reason", "level", F.col("_s")["dataset"].alias("dataset"), F.col("_s")["scale"].alias("scale"))
    before = F.lag("scale").over(Window.partitionBy("path").orderBy("level"))  # a group has few levels
    factor = F.zip_with("scale", before, lambda b, a: F.greatest(F.lit(1), F.bround(b / a).cast("bigint")))
    return bad.unionByName(each.withColumn("factor", F.when(F.col("level") > 0, factor)))
