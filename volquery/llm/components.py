"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut

#: Links that a task holds at a time.
HELD = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of the links ``u, v`` to the smallest node that they connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        tops = label[a], label[b]
        for top in tops:
            np.minimum.at(label, top, low)
        while (label[label] != label).any():
            label = label[label]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]) for i in (0, 1)))

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n >= HELD:
            held = [joined()]
            n = len(held[0][0])
            if n > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held, n = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], ["u", "v"])


def connected_components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """``node, root``: every node of a link and the smallest node of its component.

    Alternating large-star and small-star steps: each node's neighbours are linked to its smallest
    neighbour, first the larger ones, then the smaller ones, until every link is (node, root).  Between
    rounds each task puts a forest in place of the links that it reads, ``HELD`` at a time.  A step
    is one group-by for minima (combined before the shuffle) and one join, which adaptive execution can
    split; neighbour lists are never built, and links never get more.  Rounds grow with the logarithm of a
    component's size; the minima that begin a round tell whether it is needed."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    small = None
    while True:
        edges = cut(edges.mapInArrow(_forests, "u bigint, v bigint"), name)  # v < u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        least = cut(least.select("u", F.least("low", "u").alias("m"), F.expr("low < u AND low < high").alias("open")), name)
        if small is not None:
            drop_cut(small)
        if least.where("open").isEmpty():  # below each node stands its root alone
            drop_cut(edges)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        # large star: larger neighbours v of u point to the smallest node around u
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        # small star: smaller neighbours of u, and u itself in place of the smallest, point to the smallest
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), name)
        for old in (edges, least, large, low):
            drop_cut(old)
        edges = small
