"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance
of two such vectors never exceeds the Hamming distance, so links at 3 or fewer bits lie within 3 of
each other, and, of the two halves of the vector, within 1 in at least one.  A grid whose cells are
half vectors finds them: every fingerprint is at home in one cell of each half and visits the cells one
step up.  Pairs that meet are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, row_slices

SHINGLE = 3
RADIUS = 3
#: Fingerprints of one cell that are compared in one piece; larger cells are split in chunks and all
#: pairs of chunks are compared, so this bounds memory and drops nothing.
CHUNK = 2048


def fingerprint_bytes(text: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of one text: ASCII lower case, words apart at ASCII space, XXH64 (seed 42)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    array = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(array), 65536):
        bits = np.unpackbits(array[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = (votes * 2 > len(array)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp``: fingerprints as signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                texts = pc.fill_null(rows.column("_text"), "").cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint_bytes(t) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({key: rows.column(key), "fp": pa.array(fps)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _half_vectors(half: np.ndarray) -> np.ndarray:
    """Popcounts of the 16 two-bit segments of 32-bit halves, packed in two bits each."""
    low = half & np.uint64(0x55555555)
    high = (half >> np.uint64(1)) & np.uint64(0x55555555)
    return low + high  # two-bit fields, each 0, 1 or 2: no carries


def grid_cells(fps: DataFrame) -> DataFrame:
    """``cell, fp, home``: for each half, the home cell and the cells one step up in one segment.  Of
    two vectors one step apart the lower one visits the upper one's home, so one direction will do."""
    steps = (np.uint64(1) << np.arange(0, 32, 2, dtype=np.uint64)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").slice(at, 20_000).to_numpy().view(np.uint64)
                for side in (0, 1):
                    vector = _half_vectors((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))
                    counts = (vector[:, None] >> np.arange(0, 32, 2, dtype=np.uint64)) & np.uint64(3)
                    row, segment = np.nonzero(counts < 2)
                    cells = np.concatenate([vector, vector[row] + steps[segment]]) | np.uint64(side << 32)
                    home = np.zeros(len(cells), dtype=bool)
                    home[: len(vector)] = True
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.view(np.int64)), "fp": pa.array(np.concatenate([fp, fp[row]]).view(np.int64)), "home": pa.array(home)})

    return fps.select("fp").mapInArrow(run, "cell bigint, fp bigint, home boolean")


def _forest(homes: np.ndarray, others: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links of a spanning forest of the verified pairs between ``homes`` and ``others`` (with
    ``same``: also among ``homes``).  Breadth first: each step compares one fingerprint with those not
    reached yet, so dense groups cost little more than their size, and never list their pairs."""
    nodes = np.concatenate([homes, others])
    is_home = np.zeros(len(nodes), dtype=bool)
    is_home[: len(homes)] = True
    left = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[x]) <= RADIUS
            if is_home[x] and not same:
                near &= ~is_home[left]
            elif not is_home[x]:
                near &= is_home[left]
            found = left[near]
            if len(found):
                out.extend((int(nodes[x]), int(nodes[y])) for y in found)
                stack.extend(found.tolist())
                left = left[~near]
    return out


def _links_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (cell, ci, cj) in; links out.  A group has two chunks at most."""
    carry: pa.Table | None = None

    def solve(frame: pa.Table) -> pa.RecordBatch:
        cell, ci, cj = (frame.column(c).to_numpy() for c in ("cell", "ci", "cj"))
        fp, home, chunk = frame.column("fp").to_numpy().view(np.uint64), frame.column("home").to_numpy(), frame.column("chunk").to_numpy()
        change = np.flatnonzero((cell[1:] != cell[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])) + 1
        edges = np.concatenate([[0], change, [len(cell)]])
        links: list[tuple[int, int]] = []
        size = np.diff(edges)
        # groups of two, the most common, all at once
        two = edges[:-1][size == 2]
        ok = (home[two] | home[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS)
        links.extend(zip(fp[two[ok]].tolist(), fp[two[ok] + 1].tolist()))
        for a, b in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist()):
            h, f = home[a:b], fp[a:b]
            if ci[a] == cj[a]:
                links.extend(_forest(f[h], f[~h], True))
            else:  # pairs across the two chunks: homes of either with all of the other
                c = chunk[a:b] == ci[a]
                links.extend(_cross(f[c], h[c], f[~c], h[~c]))
        flat = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(flat[:, 0], flat[:, 1])), "b": pa.array(np.maximum(flat[:, 0], flat[:, 1]))})

    for batch in batches:
        whole = pa.Table.from_batches([batch])
        whole = pa.concat_tables([carry, whole]).combine_chunks() if carry is not None and carry.num_rows else whole
        if not whole.num_rows:
            continue
        last = [whole.column(c)[-1].as_py() for c in ("cell", "ci", "cj")]
        same = np.logical_and.reduce([whole.column(c).to_numpy() == v for c, v in zip(("cell", "ci", "cj"), last)])
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        carry = whole.slice(cut_at)
        if cut_at:
            yield solve(whole.slice(0, cut_at))
    if carry is not None and carry.num_rows:
        yield solve(carry)


def _cross(fa: np.ndarray, ha: np.ndarray, fb: np.ndarray, hb: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the verified pairs between two chunks."""
    nodes, home = np.concatenate([fa, fb]), np.concatenate([ha, hb])
    side = np.arange(len(nodes)) >= len(fa)
    left, out = np.arange(len(nodes)), []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = (np.bitwise_count(nodes[left] ^ nodes[x]) <= RADIUS) & (side[left] != side[x])
            if not home[x]:
                near &= home[left]
            found = left[near]
            if len(found):
                out.extend((int(nodes[x]), int(nodes[y])) for y in found)
                stack.extend(found.tolist())
                left = left[~near]
    return out


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that connect just the fingerprints that chains of links at RADIUS bits connect.
    ``fps`` has distinct values in ``fp``."""
    cells = grid_cells(fps)
    # cells in which something can meet: two fingerprints at least, one of them at home
    active = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home")
    active = cut(active.select("cell", "n"), "simhash-cells")
    met = cells.join(active.hint("merge"), "cell")  # grows with the fingerprints: never broadcast
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = met.select("cell", "fp", "home", "chunk", other.alias("o"))
    met = met.select("cell", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), "chunk", "fp", "home")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "cell", "ci", "cj").sortWithinPartitions("cell", "ci", "cj")
    return met.mapInArrow(_links_of_groups, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component``: one row per input row.  ``component`` is the smallest key that chains of
    links reach, the row itself included.

    Rows with equal fingerprints are one node, so groups of copies of any size cost one fingerprint.
    Null and blank texts have fingerprint 0 and are linked like any other; null keys are ignored when
    components are named (a component of null keys only is named null); repeated rows stay."""
    table = cut(fingerprints(docs, key, text), "simhash-fp")
    nodes = cut(table.groupBy("fp").agg(F.min(key).alias("smallest")), "simhash-nodes")
    found = cut(links(nodes), "simhash-links")
    component = connected_components(found, "a", "b")  # node, root: only nodes that have links
    linked = component.join(nodes, component["node"] == nodes["fp"]).select("root", "fp", "smallest")
    roots = linked.groupBy("root").agg(F.min("smallest").alias("component"))
    renamed = linked.join(roots, "root").select("fp", "component")
    names = cut(nodes.join(renamed, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "smallest").alias("component")), "simhash-names")
    return table.join(names, table["fp"] == names["_fp"]).select(key, "fp", "component")
