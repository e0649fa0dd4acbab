"""Hard-negative mining by bit-sliced integer inner products.

Components become integers, and the rows searched are cut in bit-planes (two's complement, the sign first).
The product of an anchor with a plane adds that plane's share to all scores at once; what the planes to come
can still add lies between known bounds, so every score has an interval, which halves with each plane.  A
candidate goes once its interval cannot reach a window of scores that is asked for, or once enough others
certainly rank before it in every window it could reach.  When few are left the planes are multiplied for
these pairs only; after the last plane the scores are exact.

Positives are the best rows of the anchor's label in a window without bounds, negatives the best rows of
other labels in one window for each positive.  Both searches deal rows in blocks of bounded size, and send
every anchor past each block: anchors are moved, rows are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop_cut

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative has at least 50 and at most 95 hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Components held in a block of rows, and the fewest rows that are worth a block.
VALUES, LEAST_ROWS = 1 << 19, 512
#: Anchors multiplied at once, and the share of pairs below which they are followed one by one.
ANCHORS, SPARSE = 128, 0.1
#: Components of this magnitude or more have squares that do not fit a long.
TOO_LARGE = 1 << 31
LONG = np.iinfo(np.int64)


def planes(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """Weight, bits and the most that all lower bits can add, of each bit-plane from the sign down."""
    bits = int(np.where(rows < 0, ~rows, rows).max(initial=0)).bit_length()
    yield -(1 << bits), rows < 0, (1 << bits) - 1
    for b in range(bits - 1, -1, -1):
        yield 1 << b, ((rows >> b) & 1).astype(bool), (1 << b) - 1


def kth_largest(of: np.ndarray, value: np.ndarray, groups: int, k: int, least: int) -> np.ndarray:
    """The k-th largest value of each group, ``least`` where it has fewer."""
    order = np.lexsort((-value, of))
    starts = np.searchsorted(of[order], np.arange(groups + 1))
    at = starts[:-1] + k - 1
    out = np.full(groups, least, value.dtype)
    out[at < starts[1:]] = value[order[at[at < starts[1:]]]]
    return out


def possible(of: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, k: int, least: int) -> np.ndarray:
    """Which candidates (``of`` an anchor, score between ``low`` and ``high``) can still be among the best k
    of a window (``windows[anchor, w]``: its least and its greatest score)."""
    alive = np.zeros(len(of), bool)
    for w in range(windows.shape[1]):
        floor, roof = windows[of, w, 0], windows[of, w, 1]
        may = (high >= floor) & (low <= roof)
        sure = (low >= floor) & (high <= roof)
        bar = kth_largest(of[sure], low[sure], len(windows), k, least)
        alive |= may & (high >= bar[of])
    return alive


def best_in_windows(anchors: np.ndarray, windows: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Anchor, window, row and score of the best k ``allowed`` rows in each window; ties to the smaller id."""
    size = rows.shape[1]
    largest = int(np.abs(anchors).max(initial=0))
    wide = size * largest * (2 * int(np.where(rows < 0, ~rows, rows).max(initial=0)) + 2) >= 1 << 62
    exact, least = (object, -(1 << 200)) if wide else (np.int64, LONG.min)
    real = np.float32 if size * largest < 1 << 24 else np.float64
    factors = anchors.astype(real)
    up, down = (np.clip(anchors, *c).astype(exact).sum(axis=1) for c in ((0, None), (None, 0)))
    windows = windows.astype(exact)
    score = np.zeros((len(anchors), len(rows)), exact)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for weight, bits, rest in planes(rows):
        if pairs is None:
            score += weight * (factors @ bits.astype(real).T).astype(np.int64).astype(exact)
            if not rest:
                break
            if allowed.mean() < SPARSE:
                pairs = np.nonzero(allowed)
            else:
                # the bar needs only lower bounds of the best, so dense pruning looks at one window's reach
                low, high = score + (rest * down)[:, None], score + (rest * up)[:, None]
                allowed = allowed & (high >= windows[:, :, 0].min(axis=1)[:, None]) & (low <= windows[:, :, 1].max(axis=1)[:, None])
                if windows.shape[1] == 1 and allowed.shape[1] > k:
                    sure = allowed & (low >= windows[:, 0, :1]) & (high <= windows[:, 0, 1:])
                    bar = np.partition(np.where(sure, low, least), -k, axis=1)[:, -k]
                    allowed &= high >= bar[:, None]
                if allowed.mean() < SPARSE:
                    pairs = np.nonzero(allowed)
            if pairs is not None:
                of, row = pairs
                value = score[of, row]
        else:
            value = value + weight * np.einsum("ij,ij->i", factors[of], bits[row].astype(real), optimize=True).astype(np.int64).astype(exact)
        if pairs is not None:
            keep = possible(of, value + rest * down[of], value + rest * up[of], windows, k, least)
            of, row, value = of[keep], row[keep], value[keep]
            pairs = of, row
    if pairs is None:
        of, row = np.nonzero(allowed)
        value = score[of, row]
    out = []
    for w in range(windows.shape[1]):
        inside = np.flatnonzero((value >= windows[of, w, 0]) & (value <= windows[of, w, 1]) & (value >= LONG.min) & (value <= LONG.max))
        order = inside[np.lexsort((ids[row[inside]], -value[inside], of[inside]))]
        starts = np.searchsorted(of[order], np.arange(len(anchors) + 1))
        nth = np.arange(len(order)) - starts[of[order]]
        order = order[nth < k]
        out.append((of[order], np.full(len(order), w), row[order], value[order]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def integer_vectors(vectors: DataFrame, is_anchor: Column, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """``_row, _asks, id, label, size, code``: the rows that take part, repeats once, with floor(scale * x)."""
    real = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    plain = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) * scale < TOO_LARGE, F.lit(False)))  # NaN is the largest value
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & plain).select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), real.alias("code"), F.coalesce(is_anchor, F.lit(False)).alias("_asks"))
    rows = rows.where(F.size("code") > 0).dropDuplicates(["id", "label", "code"])
    return rows.select(F.monotonically_increasing_id().alias("_row"), "_asks", "id", "label", F.size("code").alias("size"), "code")


def searched(rows: DataFrame, asked: DataFrame, k: int, same: bool, values: int, name: str) -> DataFrame:
    """``_row, window, id, score, rank``: the best k rows of each window of each row of ``asked`` (``_row, id,
    label, size, code, windows``) among the rows of its label, or of other labels; never those of its own id."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks of bounded size; of small tables more, so that they use the machines there are
    blocks = F.greatest(F.ceil(F.count("*") * F.col("size") / values), F.least(F.lit(n), F.ceil(F.count("*") / LEAST_ROWS))).cast("int").alias("blocks")
    sizes = rows.groupBy("size").agg(blocks)
    no_windows = F.lit(None).cast("array<array<bigint>>").alias("windows")
    held = rows.join(sizes, "size").select("size", F.pmod(F.xxhash64("_row"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "_row", "id", "label", "code", no_windows)
    sent = asked.join(sizes, "size").select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "_row", "id", "label", "code", "windows")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("code").flatten().to_numpy().reshape(batch.num_rows, -1)

    def answers(block: list[pa.RecordBatch], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels = (np.concatenate([b.column(c).to_numpy() for b in block]) for c in ("id", "label"))
        codes = np.concatenate([matrix(b) for b in block])
        for at in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(at, ANCHORS)
            lists = part.column("windows").flatten().flatten().to_numpy().reshape(part.num_rows, -1, 2)
            own, its = part.column("id").to_numpy(), part.column("label").to_numpy()
            allowed = ((its[:, None] == labels[None, :]) == same) & (own[:, None] != ids[None, :])
            of, window, row, score = best_in_windows(matrix(part), lists, codes, ids, allowed, k)
            yield pa.RecordBatch.from_pydict({"_row": part.column("_row").take(pa.array(of)), "window": pa.array(window.astype(np.int32)), "id": pa.array(ids[row]), "score": pa.array(score.astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        last, open_ = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("size", "block", "kind")])
            edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):
                size, number, kind = names[:, x].tolist()
                if (size, number) != last:
                    block, last = [], (size, number)
                if kind == 0:
                    block.append(batch.slice(x, y - x))
                elif block:
                    yield from answers(block, batch.slice(x, y - x))

    met = held.unionByName(sent).repartition(n, "size", "block").sortWithinPartitions("size", "block", "kind")
    found = met.mapInArrow(run, "_row bigint, window int, id bigint, score bigint")
    best = Window.partitionBy("_row", "window").orderBy(F.desc("score"), "id")
    return cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), name)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, values: int = VALUES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where
    ``is_anchor`` (of the key) holds and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels with LEAST to MOST hundredths of the positive's score.

    Scores are exact integer inner products; higher ones come first, ties by smaller key.  Rows with a null
    key, label, vector or component, a component that is not finite or, scaled, 2^31 or more, or no component
    at all take no part.  Rows equal in key, label and vector count once; a key with several labels or vectors
    asks for each of them; rows of the anchor's key are never its answers.  Vectors of different lengths are
    not compared.  Scores that do not fit a long are left out.  An anchor without positives or a positive
    without negatives has no rows; other columns, whatever their names, are ignored; an empty table gives no
    rows."""
    rows = cut(integer_vectors(vectors, is_anchor, key, label, vector, scale), "negatives-rows")
    anchors = rows.where("_asks").drop("_asks")
    rows = rows.drop("_asks")
    whole = F.array(F.array(F.lit(int(LONG.min)), F.lit(int(LONG.max))))
    good = searched(rows, anchors.withColumn("windows", whole), positives, True, values, "negatives-positive")
    p = F.col("score")
    # from LEAST * p to MOST * p hundredths, as whole numbers; of positives that none can satisfy, nothing is asked
    exact = p.cast("decimal(19,0)")
    reach = F.array(F.ceil(exact * LEAST / 100).cast("bigint"), F.floor(exact * MOST / 100).cast("bigint"))
    wanted = good.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive"), p.alias("score"), reach.alias("window")))).alias("asks"))  # ``positives`` at most
    asks = cut(anchors.join(wanted, "_row").select(*rows.columns, "asks"), "negatives-asks")
    nothing = F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))  # a window without scores
    windows = F.concat("asks.window", F.array_repeat(nothing, F.lit(positives) - F.size("asks")))
    bad = searched(rows, asks.withColumn("windows", windows).drop("asks"), negatives, False, values, "negatives-negative")
    pairs = asks.select("_row", F.col("id").alias("anchor_id"), F.posexplode("asks").alias("window", "ask"))
    out = pairs.join(bad.select("_row", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["_row", "window"])
    drop_cut(good)
    return out.select("anchor_id", F.col("ask.positive").alias("positive_id"), "rank", "negative_id", F.col("ask.score").alias("positive_score"), "negative_score")


#: The same by comparing all pairs.
ORACLE_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         list_sum(list_transform(range(len(a.code)), lambda i: a.code[i + 1] * r.code[i + 1]))::BIGINT AS score
  FROM rows a, rows r WHERE a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
found AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}
"""
