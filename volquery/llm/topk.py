"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of W 64-bit words is cut into m segments of about log2(n) bits each (n distinct codes), and one
corpus-wide table has every code under the value of each of its segments.  Search radii grow together:
in round r a query probes, in every segment, the values at exactly r bits from its own.  A code at
distance d has some segment within d // m bits, so after round r everything within m * (r + 1) - 1 bits
has been seen, and a query stops when that covers the k-th distance it has verified.

Radii of few values share a round.  Probes of values that no code has are dropped where they are made, by
bitmaps of bounded size.  All probes of a round are one join.  A pair that meets in several segments or rounds is verified where it
meets first, so it is looked at once.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

TOP = 10
#: Narrowest and widest segment, in bits.
LEAST_BITS, MOST_BITS = 8, 32
#: Codes of one bucket that are searched in one piece, and queries of one code that are answered in one;
#: more are split by a hash, so a crowded bucket or a very common query spreads over tasks.
CHUNK = 4096
#: Probes made at once, and the values of a segment that a query may probe in one round.
PROBES, TOGETHER = 1 << 17, 1024
#: Bytes of the bitmaps of occupied values.
OCCUPIED = 8 << 20


@dataclass(frozen=True)
class Segment:
    """Bits ``low`` to ``low + bits - 1`` of a word."""

    word: int
    low: int
    bits: int

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    def value(self, code: Column) -> Column:
        return F.shiftrightunsigned(code[self.word], self.low).bitwiseAND(F.lit(self.mask))


def segments(words: int, codes: int) -> list[Segment]:
    """Segments of nearly log2(``codes``) bits; none crosses a word."""
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(2, codes)))))
    edges = np.linspace(0, 64, max(1, round(64 / bits)) + 1).astype(int).tolist()
    return [Segment(w, a, b - a) for w in range(words) for a, b in itertools.pairwise(edges)]


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, code``: one bit for each dimension, 1 where the value is above 0 (null and NaN: 0), packed
    in 64-bit words.  Rows with a null vector have no code and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_vector")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.nan_to_num(pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False), nan=0.0) > 0
            words = np.maximum(1, -(-sizes // 64))
            ends = np.concatenate([[0], np.cumsum(words)])
            bits = np.zeros(int(ends[-1]) * 64, dtype=bool)
            shift = np.repeat(ends[:-1] * 64 - (np.cumsum(sizes) - sizes), sizes)
            bits[np.arange(len(values)) + shift] = values
            codes = np.packbits(bits, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "code": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, F.col(vector).alias("_vector")).where("_vector IS NOT NULL").mapInArrow(run, f"`{key}` {kind}, code array<bigint>")


def masks(bits: int, radius: int) -> Iterator[np.ndarray]:
    """All numbers of ``bits`` bits with ``radius`` of them set, in pieces."""
    chosen = itertools.combinations(range(bits), radius)
    while piece := list(itertools.islice(chosen, PROBES)):
        places = np.array(piece, dtype=np.int64).reshape(len(piece), radius)
        yield (np.int64(1) << places).sum(axis=1)


def occupied(buckets: DataFrame, parts: list[Segment]) -> list[np.ndarray]:
    """For each segment a bitmap of the values that some code has (of their low bits, where there are more
    values than bits).  All together are at most OCCUPIED bytes, whatever the number of codes."""
    bits = min(MOST_BITS, max(6, int(math.log2(OCCUPIED * 8 / len(parts)))))
    slot = F.col("value").bitwiseAND(F.lit((1 << min(bits, max(p.bits for p in parts))) - 1))
    one = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    words = buckets.withColumn("_slot", slot).groupBy("segment", F.shiftright("_slot", 6).alias("word")).agg(F.bit_or(one).alias("held")).toArrow()
    out = [np.zeros(max(1, (1 << min(bits, p.bits)) >> 6), np.uint64) for p in parts]
    segment, word, held = (words.column(c).to_numpy() for c in ("segment", "word", "held"))
    for i, bitmap in enumerate(out):
        mine = segment == i
        bitmap[word[mine]] = held[mine].view(np.uint64)
    return out


def probes(asked: DataFrame, parts: list[Segment], radii: range, bitmaps: list[np.ndarray]) -> DataFrame:
    """``segment, value, radius, query, bound``: the values at ``radii`` bits in every segment, without those
    that no code has."""
    shared = asked.sparkSession.sparkContext.broadcast(bitmaps)  # OCCUPIED bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("query").flatten().to_numpy().reshape(batch.num_rows, -1)
            for (i, part), radius in itertools.product(enumerate(parts), radii):
                own = (codes[:, part.word].view(np.uint64) >> np.uint64(part.low)).astype(np.int64) & part.mask
                bitmap = shared.value[i]
                for mask in masks(part.bits, radius):
                    step = max(1, PROBES // len(mask))
                    for at in range(0, len(own), step):
                        value = (own[at : at + step, None] ^ mask[None, :]).ravel()
                        slot = value & (len(bitmap) * 64 - 1)
                        some = np.flatnonzero((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                        row = pa.array(at + some // len(mask))
                        fixed = {"segment": pa.array(np.full(len(some), i, np.int32)), "value": pa.array(value[some]), "radius": pa.array(np.full(len(some), radius, np.int32))}
                        yield pa.RecordBatch.from_pydict(fixed | {c: batch.column(c).take(row) for c in ("query", "bound")})

    return asked.select("query", "bound").mapInArrow(run, "segment int, value bigint, radius int, query array<bigint>, bound int")


def rounds(bits: int) -> Iterator[range]:
    """Radii from 0 to ``bits``, as many to a round as have TOGETHER values or fewer."""
    first = 0
    while first <= bits:
        last, values = first, math.comb(bits, first)
        while last < bits and values + math.comb(bits, last + 1) <= TOGETHER:
            last += 1
            values += math.comb(bits, last)
        yield range(first, last + 1)
        first = last + 1


def _all(tests: list[Column]) -> Column:
    return functools.reduce(operator.and_, tests)


def first_meetings(met: DataFrame, parts: list[Segment], words: int) -> DataFrame:
    """Of rows ``segment, radius, query, code`` those where the pair meets for the first time, with its distance:
    every segment differs in ``radius`` bits or more, those before this one in more."""
    differing = F.array(*[F.col("query")[w].bitwiseXOR(F.col("code")[w]) for w in range(words)])
    apart = met.withColumn("_x", differing)
    distance = functools.reduce(operator.add, [F.bit_count(F.col("_x")[w]) for w in range(words)])
    counts = [F.bit_count(p.value(F.col("_x"))) for p in parts]
    first = _all([c >= F.when(F.col("segment") > i, F.col("radius") + 1).otherwise(F.col("radius")) for i, c in enumerate(counts)])
    return apart.where(first).withColumn("distance", distance.cast("int"))


def search(codes: DataFrame, words: int, k: int, key: str, chunk: int, name: str) -> DataFrame:
    """``query, distance, key, rank`` for each distinct code of a query among ``key, code, _is_query``."""
    far = words * 64
    first = Window.partitionBy("code").orderBy(F.col(key).asc_nulls_last())
    # a code shared by any number of rows needs its first k keys; the limit acts before the shuffle too
    named = codes.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k)
    items = F.sort_array(F.collect_list(F.struct("_nth", F.col(key).alias("key"))))
    nodes = cut(named.groupBy("code").agg(F.transform(items, lambda x: x["key"]).alias("keys")), f"{name}-nodes")
    asked = cut(codes.where("_is_query").select(F.col("code").alias("query"), F.lit(far).alias("bound")).distinct(), f"{name}-queries")

    parts = segments(words, nodes.count())
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), p.value(F.col("code")).alias("value")) for i, p in enumerate(parts)]))
    listed = nodes.select("code", "keys", entry.alias("at")).select("at.*", "code", "keys")
    buckets = cut(listed.groupBy("segment", "value").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), f"{name}-buckets")
    index = listed.join(buckets.hint("merge"), ["segment", "value"])
    index = cut(index.select("segment", "value", F.pmod(F.xxhash64("code"), "chunks").cast("int").alias("chunk"), "code", "keys"), f"{name}-index")

    nearest = Window.partitionBy("query").orderBy("distance", F.col("key").asc_nulls_last())
    best, settled = None, []
    bitmaps = occupied(buckets, parts)
    for radii in rounds(max(p.bits for p in parts)):
        hit = probes(asked, parts, radii, bitmaps).join(buckets.hint("merge"), ["segment", "value"])
        hit = hit.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = hit.join(index.hint("merge"), ["segment", "value", "chunk"])
        near = first_meetings(met, parts, words).where("distance <= bound")
        near = near.select("query", "distance", F.explode("keys").alias("key"))
        near = near if best is None else near.unionByName(best.select("query", "distance", "key"))
        near = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        whole = Window.partitionBy("query")
        near = near.withColumn("n", F.count("*").over(whole)).withColumn("worst", F.max("distance").over(whole))
        near = cut(near, f"{name}-best")
        covered = len(parts) * (radii[-1] + 1) - 1
        done = (F.col("n") >= k) & (F.col("worst") <= covered)
        settled.append(near.where(done))
        best = near.where(~done)
        left = best.groupBy("query").agg(F.first("n").alias("n"), F.first("worst").alias("worst"))
        asked = cut(left.select("query", F.when(F.col("n") >= k, F.col("worst")).otherwise(far).alias("bound")), f"{name}-open")
        if asked.isEmpty():
            break
    else:
        settled.append(best)  # every bucket has been searched
    found = functools.reduce(DataFrame.unionByName, settled)
    return found.select("query", "distance", "key", "rank")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, key: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, name: str = "topk") -> DataFrame:
    """``query_id, rank, key, distance`` for the rows where ``is_query`` (of the key) holds: the k nearest
    rows of each query row by Hamming distance, the query itself included; ties go to the smaller key.

    Equal vectors are one code, searched once and kept with its first k keys, so copies cannot crowd a
    task; buckets and queries beyond ``chunk`` are split.  Null vectors neither ask nor answer; null keys
    answer after all others; repeated rows are rows, and queries that repeat ask once (a key with several
    vectors asks for each); vectors of any length are coded whole, and codes of different lengths in words
    are not compared; with fewer than k rows all are returned; an empty table gives no rows."""
    codes = sign_codes(vectors, key, vector)
    codes = cut(codes.withColumn("_is_query", F.coalesce(is_query, F.lit(False))), f"{name}-codes")
    widths = [r["w"] for r in codes.where("_is_query").select(F.size("code").alias("w")).distinct().collect()]  # one for each length
    out = []
    for words in widths:
        mine = codes.where(F.size("code") == words)
        best = search(mine, words, k, key, chunk, name)
        # a code that very many queries share is answered in pieces
        pieces = mine.where("_is_query").groupBy("code").agg(F.ceil(F.count("*") / chunk).cast("int").alias("pieces"))
        answers = best.join(pieces.hint("merge"), best["query"] == pieces["code"])
        answers = answers.select("query", "distance", F.col("key").alias("_key"), "rank", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("_piece"))
        queries = mine.where("_is_query").select(F.col(key).alias("query_id"), "code").distinct().join(pieces.withColumnRenamed("code", "_code").hint("merge"), F.col("code") == F.col("_code"))
        queries = queries.select("query_id", "code", F.pmod(F.xxhash64("query_id"), "pieces").cast("int").alias("_of"))
        met = queries.join(answers.hint("merge"), (F.col("code") == F.col("query")) & (F.col("_of") == F.col("_piece")))
        out.append(met.select("query_id", "rank", F.col("_key").alias(key), "distance"))
    if not out:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, distance int")
    return functools.reduce(DataFrame.unionByName, out)


#: The same search by comparing all pairs.
ORACLE_SQL = f"""
WITH codes AS (
  SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM codes q, codes c WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id, distance
FROM near QUALIFY rank <= {TOP}
"""
