"""Quality rules: plain counts, then a hashed n-gram logistic regression against a fixed threshold.

The model sees averages of hashed word unigrams, word bigrams and character 4-grams, so a text's logit is a
sum of mean weights and whole texts of any length are scored in one stream of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import SYMBOL, Profile
from .shared import cut, row_slices

BUCKETS = 1 << 15  # of each kind
KINDS = 3
CHARS = 4  # code points of a character n-gram
#: Bound on labelled rows used in training: the first by a hash of the key.
MAX_TRAIN = 3000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.3
CALIBRATION_SHARE = 4  # one labelled row in so many is for calibration


def _mix(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)  # 15 bits


def code_points(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (its UTF-8 bytes), and its row."""
    starts = np.flatnonzero((p.data & 0xC0) != 0x80)
    size = np.diff(np.append(starts, len(p.data)))
    padded = np.concatenate([p.data, np.zeros(4, np.uint8)]).astype(np.uint64)
    value = padded[starts]
    for i in range(1, 4):
        value |= np.where(size > i, padded[starts + i] << np.uint64(8 * i), np.uint64(0))
    return value, p.row_of_byte[starts]


def grams(p: Profile) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram, for each kind."""
    import xxhash

    word_hash = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in p.words], dtype=np.uint64)
    h = word_hash[p.codes] if len(p.codes) else np.zeros(0, np.uint64)
    inside = p.row_of_word[1:] == p.row_of_word[:-1]
    pairs = (h[:-1] * np.uint64(31) + h[1:])[inside]
    chars, row = code_points(p)
    n = max(0, len(chars) - CHARS + 1)
    four = np.zeros(n, np.uint64)
    for i in range(CHARS):
        four = four * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + n]
    whole = row[:n] == row[CHARS - 1 :] if n else np.zeros(0, bool)
    four, row = four[whole], row[:n][whole]
    return [(p.row_of_word, _mix(h)), (p.row_of_word[1:][inside], _mix(pairs) + BUCKETS), (row, _mix(four) + 2 * BUCKETS)]


@dataclass
class NgramModel:
    weights: np.ndarray  # KINDS x BUCKETS
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def logits(self, p: Profile) -> np.ndarray:
        rows = len(p.n_words)
        out = np.full(rows, self.bias)
        for row, bucket in grams(p):
            n = np.bincount(row, minlength=rows)
            out += np.bincount(row, weights=self.weights[bucket], minlength=rows) / np.maximum(n, 1)
        return out

    def probability(self, p: Profile) -> np.ndarray:
        return sigmoid(self.slope * self.logits(p) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def sparse_rows(labelled: DataFrame) -> pa.Table:
    """``y, bucket, value`` of the (bounded) training rows; the features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                p, n = Profile(rows.column("_text")), rows.num_rows
                keys, values = [], []
                for row, bucket in grams(p):
                    key, count = np.unique(row * (KINDS * BUCKETS) + bucket, return_counts=True)
                    keys.append(key)
                    values.append(count / np.maximum(1, np.bincount(row, minlength=n))[key // (KINDS * BUCKETS)])
                key, value = np.concatenate(keys), np.concatenate(values)
                order = np.argsort(key, kind="stable")
                ends = np.searchsorted(key[order] // (KINDS * BUCKETS), np.arange(n + 1)).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array((key[order] % (KINDS * BUCKETS)).astype(np.int32)))
                shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order].astype(np.float32)))
                yield pa.RecordBatch.from_pydict({"y": rows.column("y"), "bucket": buckets, "value": shares})

    return labelled.mapInArrow(run, "y int, bucket array<int>, value array<float>").toArrow()


def fit(rows: pa.Table, ridge: float = 1e-3, steps: int = 120) -> NgramModel:
    """Full-batch gradient descent with momentum on standardised shares, then Platt calibration on the
    rows left out of it.  Without both labels the model keeps everything."""
    if rows.num_rows < 8 or len(set(rows.column("y").to_pylist())) < 2:
        return NgramModel(np.zeros(KINDS * BUCKETS), 4.0)
    y = rows.column("y").to_numpy().astype(float)
    lists = rows.column("bucket").combine_chunks()
    bucket, value = lists.flatten().to_numpy().astype(np.int64), rows.column("value").combine_chunks().flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    train = np.arange(len(y)) % CALIBRATION_SHARE != 0
    width, n = KINDS * BUCKETS, int(train.sum())
    mine = train[row]
    mean = np.bincount(bucket[mine], weights=value[mine], minlength=width) / n
    scale = np.sqrt(np.maximum(np.bincount(bucket[mine], weights=value[mine] ** 2, minlength=width) / n - mean**2, 0))
    scale = np.where(scale > 0, 1 / (scale + 1e-4), 0.0) / np.sqrt(len(bucket) / len(y))
    x = value * scale[bucket]
    balance = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-3), 0.5 / max(1 - y[train].mean(), 1e-3)) * train
    weights, bias, speed, drift = np.zeros(width), 0.0, np.zeros(width), 0.0
    for _ in range(steps):
        logit = np.bincount(row, weights=x * weights[bucket], minlength=len(y)) + bias
        error = (sigmoid(logit) - y) * balance / n
        gradient = np.bincount(bucket, weights=x * error[row], minlength=width) + ridge * weights
        speed, drift = 0.9 * speed - 2.0 * gradient, 0.9 * drift - 0.5 * error.sum()
        weights, bias = weights + speed, bias + drift
    logit = np.bincount(row, weights=x * weights[bucket], minlength=len(y)) + bias
    slope, shift = platt(logit[~train], y[~train])
    return NgramModel(weights * scale, bias, slope, shift)


def platt(logit: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through left-out logits, with smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logit + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * logit).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Counts and verdict for every row: ``key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, probability, kept``.

    Null and empty texts have no words and fail; texts of any length are counted and scored whole; an empty
    table gives no rows.  Null keys and labels are not trained on; of several
    labels of a key the mean counts, 1 from a half on; repeated rows are judged each.  Without labels of
    both kinds only the plain rules decide."""
    chosen = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key IS NOT NULL AND _label IS NOT NULL")
    chosen = chosen.groupBy("_key").agg((F.avg("_label") >= 0.5).cast("int").alias("y"))
    chosen = cut(chosen.orderBy(F.xxhash64("_key"), "_key").limit(max_train), "rules-labels")
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    # max_train rows at most: a bounded broadcast
    labelled = texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_key"]).groupBy("_key").agg(F.first("y").alias("y"), F.max("_text").alias("_text"))
    model = fit(sparse_rows(labelled.orderBy("_key").select("y", "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                p = Profile(rows.column("_text"))
                failed = (p.n_words < MIN_WORDS) | (100 * p.n_repeat_words > MAX_REPEAT_PERCENT * p.n_words)
                probability = model.probability(p)
                yield pa.RecordBatch.from_pydict(
                    {
                        key: rows.column("_doc"), "n_words": pa.array(p.n_words), "word_chars": pa.array(p.word_chars.astype(np.int64)), "n_symbols": pa.array(p.classes[:, SYMBOL].astype(np.int64)),
                        "n_dup_lines": pa.array(p.n_dup_lines), "n_repeat_words": pa.array(p.n_repeat_words), "base_failed": pa.array(failed),
                        "probability": pa.array(probability), "kept": pa.array(~failed & (probability >= threshold)),
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"`{key}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean")
