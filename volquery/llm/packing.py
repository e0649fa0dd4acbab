"""Packing: concatenate and cut.

All documents form one stream of tokens.  Partition token totals, summed in a second pass, give each
document its global offset; fixed windows cut the stream, and a document that crosses a window's edge
leaves a boundary record (a piece) in each window.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cover import local_frame
from .shared import cut, row_slices, task_id
from .word_bpe import WordBpe

WINDOW = 4096
END_ID = 2
#: Text worked on at once; words are encoded once in it.
TEXT_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def _tables(path: str) -> tuple:
    """Tables of a tokenizer file, kept on the driver."""
    return WordBpe.load(path).tables()


def encode_texts(bpe: WordBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each closed by END_ID; the n + 1 offsets of the rows.

    The tokenizer drops white space and never merges or composes across it, so the ids of a text are
    those of its words in order; each distinct word is encoded once."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    row_ends = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(row_ends[0], row_ends[-1] - row_ends[0]))
    row_ends = row_ends - row_ends[0]
    del split
    flat, at, sizes = bpe.words(coded.dictionary)
    code = coded.indices.to_numpy(zero_copy_only=False)
    del coded
    n = sizes.astype(np.int32)[code]
    word_ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    # token i of word j: flat[at[code[j]] + i]; each row gets one more id at its end
    source = np.repeat((at[code] - word_ends[:-1]).astype(np.int32), n)
    del code, n
    source += np.arange(len(source), dtype=np.int32)
    offsets = word_ends[row_ends] + np.arange(len(row_ends))
    out = np.full(offsets[-1], END_ID, dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[offsets[1:] - 1] = False
    out[inside] = flat[source]
    return out, offsets


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, name: str = "tokens") -> DataFrame:
    """Table ``key, ids, _part, _start``: the ids of each document closed by id 2, and its place (the
    ids before it) in its partition.  Written once, so the order of the stream is settled with it."""
    # the vocabulary is of fixed size, so its broadcast is bounded
    shared = docs.sparkSession.sparkContext.broadcast(_tables(path or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total, part = WordBpe(*shared.value), 0, task_id()
        for batch in batches:
            for rows in row_slices(batch, "_text", TEXT_BYTES):
                ids, offsets = encode_texts(bpe, rows.column("_text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(
                    {key: rows.column(key), "ids": lists, "_part": pa.array(np.full(rows.num_rows, part, np.int32)), "_start": pa.array(offsets[:-1] + total)}
                )
                total += int(offsets[-1])
                del ids, lists
                pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(key, F.col(text).alias("_text"))
    return cut(narrow.mapInArrow(run, f"`{key}` {kind}, ids array<int>, _part int, _start bigint"), name)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, keep_ids: bool = True, name: str = "tokens") -> DataFrame:
    """Pieces ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and their ``ids``).

    Every row of ``docs`` is packed; a null text is empty and so is its single id 2, repeated keys
    are documents of their own, an empty table gives no pieces.  All windows are full but the last,
    so padding is less than one window in all."""
    spark = docs.sparkSession
    tokens = tokenize(docs, key, text, path, name)
    totals = tokens.groupBy("_part").agg(F.max(F.col("_start") + F.size("ids")).alias("n")).orderBy("_part").collect()
    rows, at = [], 0  # one row per input partition
    for row in totals:
        rows.append((row["_part"], at))
        at += row["n"]
    offsets = local_frame(spark, rows, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(key), batch.column("ids")
            begins = batch.column("_begin").to_numpy()
            ends_of = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            n = np.diff(ends_of)
            first, last = begins // window, (begins + n - 1) // window
            count = last - first + 1
            doc = np.repeat(np.arange(len(n)), count)
            sequence = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
            lo = np.maximum(sequence * window, begins[doc])
            hi = np.minimum((sequence + 1) * window, (begins + n)[doc])
            start = lo - begins[doc]
            left = ends_of[doc] + start
            crc = [zlib.crc32(values[a:b]) for a, b in zip(left.tolist(), (left + hi - lo).tolist())]
            columns = {
                key: keys.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(hi - lo), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(n[doc]), "sequence_id": pa.array(sequence), "offset": pa.array(lo - sequence * window),
            }
            if keep_ids:  # the pieces of a document follow each other, so the ids stay in place
                edges = np.append(left, left[-1] + (hi - lo)[-1]) if len(left) else np.zeros(1, np.int64)
                columns["ids"] = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(values[edges[0] : edges[-1]].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    joined = tokens.join(F.broadcast(offsets), "_part")
    placed = joined.select(key, "ids", (F.col("_start") + F.col("_at")).alias("_begin"))
    pieces = placed.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
    return pieces if keep_ids else cut(pieces, f"{name}-pieces")  # small, and made in small batches
