"""Repeated passages: every byte covered by a string of ``length`` bytes that starts in two places.

Windows of ``length`` bytes are dealt by their least q-gram hash, so equal windows always meet.  Only
keys whose q-gram occurs twice or more in the corpus are looked at; runs of windows with one key are
cut out as pieces, equal pieces are counted, and the distinct pieces of a key go through a run-length
index (``run_length_index``) that tells exactly which of their windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .run_length_index import repeated_starts
from .shared import cut

LENGTH = 400
GRAM = 128
#: Windows worked on at once in a long text, and the longest piece.
BLOCK, PIECE = 1 << 18, 1 << 15
#: Places from which a key is split further, by the least hashes in other orders: two, and one more each
#: time the places double, up to SPLITS.
HOT, SPLITS = 1 << 12, 16
#: Bytes of distinct pieces of one key in a chunk; larger keys are split in chunks and all pairs of chunks
#: are indexed, so the windows of one key never meet in one task.
CHUNK = 1 << 17
#: Bytes of small groups that share an index.
INDEX = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), np.uint64(base))]), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    powers, inverse = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    return _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])


def sliding(x: np.ndarray, width: int, ufunc: np.ufunc, pad: int) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, in two passes over blocks of that width."""
    n = len(x)
    whole = np.full(-(-n // width) * width, np.uint64(pad), dtype=np.uint64)
    whole[:n] = x
    grid = whole.reshape(-1, width)
    left = ufunc.accumulate(grid, axis=1).ravel()
    right = ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(right[: n - width + 1], left[width - 1 : n])


TOP = (1 << 64) - 1


def occurrences(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hashes of the q-grams that are least in some window: one entry for each place."""
    found, width = [], length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        hashes = gram_hashes(data[at : at + BLOCK + length - 1], gram)
        least = sliding(hashes, width, np.minimum, TOP)
        around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        found.append(hashes[sliding(around, width, np.maximum, 0) == hashes])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def segments(data: np.ndarray, keys: np.ndarray, splits: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``key, start, count, twice``: runs of windows with one key among ``keys`` (sorted), and whether the
    key's q-gram occurs twice in the run.  A key is split by the least hashes in as many other orders as
    ``splits`` says; equal windows agree in these too."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        hashes = gram_hashes(data[at : at + BLOCK + length - 1], gram)
        key = least = sliding(hashes, width, np.minimum, TOP)
        if not len(keys):
            continue
        listed = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        wanted = keys[listed] == key
        if not wanted.any():
            continue
        times = np.where(wanted, splits[listed], 0)
        for i in range(int(times.max())):
            again = sliding(_mix(hashes ^ _mix(np.full(1, i + 1, np.uint64) * np.uint64(_BASE))), width, np.minimum, TOP)
            key = np.where(times > i, _mix(key * np.uint64(31) + again), key)
        change = np.flatnonzero((key[1:] != key[:-1]) | (wanted[1:] != wanted[:-1])) + 1
        start = np.concatenate([[0], change])
        count = np.diff(np.append(start, len(key)))
        start, count = start[wanted[start]], count[wanted[start]]
        parts = -(-count // PIECE)
        if (parts > 1).any():
            row = np.repeat(np.arange(len(start)), parts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, count = start[row] + step * PIECE, np.minimum(PIECE, count[row] - step * PIECE)
        twice = [np.count_nonzero(hashes[a : a + n + width - 1] == least[a]) > 1 for a, n in zip(start.tolist(), count.tolist())]
        out.append((key[start], start + at, count, np.array(twice, dtype=bool)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _listed(lists: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one text in order, and how often each is split."""
    fields = pa.RecordBatch.from_struct_array(lists[row].values)
    keys = fields.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], fields.column("splits").to_numpy()[order]


def scan_texts(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                part = [x.as_buffer() for x in texts.slice(at, 512)]
                keys = [occurrences(np.frombuffer(x, np.uint8), length, gram).view(np.int64) for x in part]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        key: batch.column(key).slice(at, 512), "_id": batch.column("_id").slice(at, 512), "n_bytes": pa.array([x.size for x in part], pa.int64()),
                        "_sha": pa.array([hashlib.sha256(x).digest() for x in part], pa.binary()), "_keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(key, body.alias("_text")).withColumn("_id", text_id(F.col("_text")))
    return narrow.mapInArrow(run, f"`{key}` {kind}, _id binary, n_bytes bigint, _sha binary, _keys array<bigint>")


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, tuple]]:
    for batch in batches:
        texts, keys = batch.column("_text").cast(pa.binary()), batch.column("_keys")
        for row in range(batch.num_rows):
            data = np.frombuffer(texts[row].as_buffer(), np.uint8)
            yield batch, row, data, segments(data, *_listed(keys, row), length, gram)


def piece_owners(suspects: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, piece, _id, start, n, twice``: the pieces of all suspect texts, by the hash of their bytes."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {"key": [], "piece": [], "_id": [], "start": [], "n": [], "twice": []}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(np.concatenate(rows["key"]).view(np.int64)), "piece": pa.array(rows["piece"], pa.binary()), "_id": pa.array(rows["_id"], pa.binary()),
                    "start": pa.array(np.concatenate(rows["start"])), "n": pa.array(np.concatenate(rows["n"])), "twice": pa.array(np.concatenate(rows["twice"])),
                }
            )
            for x in rows.values():
                x.clear()
            return out

        for batch, row, data, (key, start, count, twice) in _pieces(batches, length, gram):
            raw, name = data.tobytes(), batch.column("_id")[row].as_py()
            rows["key"].append(key)
            rows["start"].append(start)
            rows["n"].append(count)
            rows["twice"].append(twice)
            rows["piece"] += [xxhash.xxh3_128_digest(raw[a : a + n + length - 1]) for a, n in zip(start.tolist(), count.tolist())]
            rows["_id"] += [name] * len(key)
            if len(rows["piece"]) > 20_000:
                yield flush()
        if rows["piece"]:
            yield flush()

    return suspects.mapInArrow(run, "key bigint, piece binary, _id binary, start bigint, n bigint, twice boolean")


def chosen_pieces(chosen: DataFrame, length: int) -> DataFrame:
    """Bytes of the pieces listed with each text, for each group they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            for row in range(batch.num_rows):
                raw = texts[row].as_py()
                listed = pa.RecordBatch.from_struct_array(batch.column("_list")[row].values)
                data = [raw[a : a + n + length - 1] for a, n in zip(listed.column("start").to_pylist(), listed.column("n").to_pylist())]
                held.append(pa.RecordBatch.from_pydict({c: listed.column(c) for c in ("key", "piece", "chunk", "chunks")} | {"bytes": pa.array(data, pa.binary())}))
                size += sum(map(len, data))
                if size > INDEX:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return chosen.mapInArrow(run, "key bigint, piece binary, chunk int, chunks int, bytes binary")


def index_groups(groups: DataFrame, length: int) -> DataFrame:
    """``key, piece, lo, hi``: intervals of repeated windows.  Rows come sorted by (key, ci, cj); whole
    groups are put together until they fill an index, as windows of different keys never match.  Groups of
    one key share chunks, so they never share an index: each piece stands in it once."""
    names = ("key", "ci", "cj")

    def solve(table: pa.Table) -> pa.RecordBatch:
        data = [np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()]
        found = repeated_starts(data, length)
        row, lo, hi = [], [], []
        for i, marks in enumerate(found):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
            row += [i] * (len(edges) // 2)
            lo.append(edges[::2])
            hi.append(edges[1::2])
        at = pa.array(row, pa.int64())
        out = {c: table.column(c).combine_chunks().take(at) for c in ("key", "piece")}
        return pa.RecordBatch.from_pydict(out | {"lo": pa.array(np.concatenate(lo).astype(np.int64)), "hi": pa.array(np.concatenate(hi).astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64))])
            for a, b in zip(edges[:-1], edges[1:]):
                group = tuple(keys[:, a])
                if held and group != last and (size >= INDEX or group[0] == last[0]):
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(int(a), int(b - a)))
                size, last = size + int(lengths[b] - lengths[a]), group
        if held:
            yield solve(pa.Table.from_batches(held))

    return groups.mapInArrow(run, "key bigint, piece binary, lo bigint, hi bigint")


def cut_out(marked: DataFrame, length: int) -> DataFrame:
    """``_id, n_removed, n_spans, _kept, text``: bytes that no marked window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("_text").cast(pa.binary()), []
            for row in range(batch.num_rows):
                data = np.frombuffer(texts[row].as_buffer(), np.uint8)
                marks = pa.RecordBatch.from_struct_array(batch.column("_marks")[row].values)
                delta = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(delta, marks.column("lo").to_numpy(), 1)
                np.add.at(delta, marks.column("hi").to_numpy() + length - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).digest()))
            n, spans, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "_kept": pa.array(sha, pa.binary())})

    return marked.mapInArrow(run, "_id binary, n_removed bigint, n_spans bigint, _kept binary")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256``: one row per input row.

    Texts that occur twice are repeated as a whole (from ``length`` bytes on) and take part once.  A null
    text is empty; null keys and repeated rows are rows like others; texts shorter than ``length`` keep
    everything; longer ones are looked at whole, in blocks; an empty table gives no rows."""
    spark = docs.sparkSession
    scanned = cut(scan_texts(docs, key, text, length, gram), "repeats-scan")
    texts = cut(scanned.groupBy("_id").agg(F.count("*").alias("copies"), F.min(key).alias("_first"), F.first("_keys").alias("_keys")), "repeats-texts")
    each = texts.select("_id", F.explode("_keys").alias("key"))
    repeated = cut(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeats-keys")
    splits = F.when(F.col("n") > hot, F.least(F.lit(SPLITS), 2 + F.floor(F.log2(F.col("n") / hot)))).otherwise(0).cast("int")
    listed = each.distinct().join(repeated, "key").groupBy("_id").agg(F.collect_list(F.struct("key", splits.alias("splits"))).alias("_keys"))  # of one text
    listed = cut(listed.join(texts.select(F.col("_id").alias("_id2"), "_first"), F.col("_id") == F.col("_id2")).drop("_id2"), "repeats-listed")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_id", text_id(F.col("_text")))
    suspects = rows.join(listed, "_id").where(F.col("_key").eqNullSafe(F.col("_first"))).select("_id", "_text", "_keys")
    suspects = cut(suspects, "repeats-suspects")

    owners = cut(piece_owners(suspects, length, gram), "repeats-owners")
    pieces = owners.groupBy("key", "piece").agg(F.count("*").alias("uses"), F.min(F.struct("_id", "start", "n", "twice")).alias("at"))
    pieces = cut(pieces.select("key", "piece", "uses", "at.*"), "repeats-pieces")
    # an index is of use where a key has several pieces, or where one piece may repeat inside itself
    sizes = pieces.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.col("n") + length).alias("bytes"))
    sizes = cut(sizes.where("k > 1"), "repeats-sizes")
    alone = F.col("k").isNull() & (F.col("uses") == 1) & F.col("twice")
    joined = pieces.join(sizes, "key", "left")
    chosen = joined.where(F.col("k").isNotNull() | alone)
    chunks = F.coalesce(F.ceil(F.col("bytes") / chunk), F.lit(1)).cast("int")
    chunk_of = F.pmod(F.xxhash64("piece"), chunks).cast("int")
    chosen = chosen.select("_id", F.struct("key", "piece", "start", "n", chunk_of.alias("chunk"), chunks.alias("chunks")).alias("p"))
    by_text = cut(chosen.groupBy("_id").agg(F.collect_list("p").alias("_list")), "repeats-chosen")  # of one text
    parts = chosen_pieces(suspects.select("_id", "_text").join(by_text, "_id").select("_text", "_list"), length)
    grouped = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grouped = grouped.select("key", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), "piece", "bytes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = grouped.repartition(n, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
    marks = index_groups(grouped, length).unionByName(pieces.where("uses > 1").select("key", "piece", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    marks = cut(marks, "repeats-marks")

    single = texts.where("copies = 1").select("_id")
    placed = owners.join(single, "_id", "left_semi").join(marks, ["key", "piece"]).select("_id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    by_text = cut(placed.distinct().groupBy("_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_marks")), "repeats-placed")  # of one text
    results = cut(cut_out(suspects.select("_id", "_text").join(by_text, "_id"), length), "repeats-results")

    names = texts.select("_id", "copies").join(results, "_id", "left")
    names = cut(names.withColumnRenamed("_id", "_text_id"), "repeats-names")
    out = scanned.drop("_keys").join(names, F.col("_id") == F.col("_text_id"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        key, "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.lower(F.hex(F.coalesce("_kept", "_sha")))).alias("kept_sha256"),
    )
