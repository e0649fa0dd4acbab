"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal
equations, isotonic calibration.

No statistic uses labels, language, source or keys.  The normal equations are sums, so training reads
every labelled row once and keeps one matrix per partition, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import BREAK, DIGIT, LEAD, LOWER, N_CLASSES, OTHER, SHOUT, STOP, SYMBOL, UPPER, Profile
from .shared import cut, row_slices

N_FEATURES = 256
SEED = 20
GAMMA = 0.05
RIDGES = (1e-3, 1e-2, 1e-1, 1.0)
FOLDS = 2
#: Groups in which partition matrices are added up before they reach the driver.
SUM_GROUPS = 16
#: Score bins of the calibration curve, whatever the number of rows.
BINS = 512
THRESHOLD = 0.3


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of document statistics, all bounded or logarithmic; zeros for an empty text."""
    p = Profile(texts)
    c = p.classes.astype(np.float64)
    size = np.maximum(1, c.sum(axis=1))
    words = np.maximum(1, p.n_words)
    lines = np.maximum(1, p.n_lines)
    columns = [
        np.log1p(c.sum(axis=1)) / 5, np.log1p(p.n_words) / 5, np.log1p(p.n_lines) / 5, np.minimum(20, p.word_chars / words) / 5,
        c[:, LOWER] / size, c[:, UPPER] / size * 3, c[:, DIGIT] / size * 5, np.minimum(2, c[:, SYMBOL] / words) * 3,
        np.minimum(2, c[:, SHOUT] / words) * 3, np.minimum(2, c[:, STOP] / words), c[:, OTHER] / size * 5, c[:, LEAD] / size * 3,
        c[:, BREAK] / size * 5, p.n_distinct / words, p.top_word / words, p.n_repeat_words / words, p.n_dup_lines / lines, np.log1p(p.n_words / lines) / 3,
    ]
    out = np.stack(columns, axis=1)
    out[p.n_words == 0] = 0
    return out.astype(np.float32)


N_STATISTICS = 18
assert N_CLASSES == 11


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, *carry, stats``: one array of N_STATISTICS floats for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "_text"):
                flat = statistics(rows.column("_text")).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * N_STATISTICS), pa.array(flat))
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in (key, *carry)} | {"stats": lists})

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return docs.select(key, *carry, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, stats array<float>")


@dataclass
class FourierRidge:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and a constant
    knots: np.ndarray  # calibration: raw score to probability
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        frequency = rng.normal(scale=np.sqrt(2 * GAMMA), size=(stats.shape[1], N_FEATURES))
        phase = rng.uniform(0, 2 * np.pi, N_FEATURES)
        x = np.clip((stats - self.center) / self.scale, -6, 6)
        return np.concatenate([np.cos(x @ frequency + phase) * np.sqrt(2 / N_FEATURES), np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of ``values`` in order."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _stack(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def fit(labelled: DataFrame) -> FourierRidge:
    """Train on all rows of ``labelled`` (``stats, y`` in 0 and 1, ``fold`` in 0 and 1).

    Without rows the model scores 0.5 everywhere."""
    sums = [F.sum("y").alias("y"), F.count("*").alias("n")]
    for i in range(N_STATISTICS):
        x = F.col("stats")[i].cast("double")
        sums += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = labelled.agg(*sums).first()
    model = FourierRidge(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(N_FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not row["n"]:
        return model
    model.center = np.array([row[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.array([max(row[f"s{i}"], 0.02) for i in range(N_STATISTICS)])
    width = N_FEATURES + 1

    def partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment, square = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width)), np.zeros((FOLDS, 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, y, fold = model.features(_stack(part.column("stats"), N_STATISTICS)), part.column("y").to_numpy(zero_copy_only=False).astype(float), part.column("fold").to_numpy()
                for k in range(FOLDS):
                    zk, yk = z[fold == k], y[fold == k]
                    gram[k] += zk.T @ zk
                    moment[k] += yk @ zk
                    square[k] += [yk @ yk, len(yk)]
        flat = np.concatenate([gram.ravel(), moment.ravel(), square.ravel()])
        yield pa.RecordBatch.from_pydict({"sums": pa.ListArray.from_arrays(pa.array(np.array([0, len(flat)], np.int32)), pa.array(flat))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("sums").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.ListArray.from_arrays(pa.array(np.array([0, len(total)], np.int32)), pa.array(total))})

    partial = labelled.select("stats", "y", "fold").mapInArrow(partition_sums, "sums array<double>")
    grouped = partial.repartition(SUM_GROUPS).mapInArrow(add, "sums array<double>")  # one matrix a partition in, SUM_GROUPS out
    total = np.zeros(FOLDS * (width * width + width + 2))
    for chunk in grouped.toArrow().column("sums").chunks:
        total += chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(axis=0)
    gram, rest = total[: FOLDS * width * width].reshape(FOLDS, width, width), total[FOLDS * width * width :]
    moment, square = rest[: FOLDS * width].reshape(FOLDS, width), rest[FOLDS * width :].reshape(FOLDS, 2)

    def solve(g: np.ndarray, m: np.ndarray, n: float, ridge: float) -> np.ndarray:
        penalty = np.eye(width) * ridge * max(n, 1) / N_FEATURES
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(g + penalty, m)

    def loss(ridge: float) -> float:  # of each fold under the other's weights
        out = 0.0
        for k in range(FOLDS):
            w = solve(gram.sum(0) - gram[k], moment.sum(0) - moment[k], square[:, 1].sum() - square[k, 1], ridge)
            out += square[k, 0] - 2 * w @ moment[k] + w @ gram[k] @ w
        return out

    ridge = min(RIDGES, key=loss)
    model.weights = solve(gram.sum(0), moment.sum(0), square[:, 1].sum(), ridge)
    others = [solve(gram.sum(0) - gram[k], moment.sum(0) - moment[k], square[:, 1].sum() - square[k, 1], ridge) for k in range(FOLDS)]

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = _stack(batch.column("stats"), N_STATISTICS), batch.column("fold").to_numpy()
            z = model.features(stats)
            raw = np.where(fold == 0, z @ others[0], z @ others[1])
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "raw": pa.array(raw), "y": batch.column("y")})

    bins = labelled.select("stats", "y", "fold").mapInArrow(outside, "bin int, raw double, y int").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n"))
    found = sorted((r["raw"], r["y"], r["n"]) for r in bins.collect())  # BINS rows at most
    raw, y, n = (np.array(x, dtype=float) for x in zip(*found))
    model.knots, model.levels = raw, isotonic(y, n)
    return model


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the key as text divides by 5.  Null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, carry: tuple[str, ...] = (), name: str = "quality") -> DataFrame:
    """``key, *carry, held_out, score, predicted``: one row per row of ``docs``.

    ``score`` is the calibrated probability of label 1; ``predicted`` is 1 from ``threshold`` on.  Empty
    and null texts are scored as texts without words.  Labels that are null count as absent; several
    labels of a key count as their mean, 1 from a half on; repeated rows are scored each."""
    stats = cut(document_statistics(docs, key, text, carry), f"{name}-stats")
    train = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_label IS NOT NULL AND _key IS NOT NULL").where(~held_out(F.col("_key")))
    train = train.groupBy("_key").agg((F.avg("_label") >= 0.5).cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("_key"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = cut(stats.join(train, stats[key] == train["_key"]).select("stats", "y", fold), f"{name}-labelled")
    model = fit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                score = model.score(_stack(part.column("stats"), N_STATISTICS))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in (key, *carry, "held_out")} | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return stats.select(key, *carry, "stats", held_out(F.col(key)).alias("held_out")).mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")
