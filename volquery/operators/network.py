"""A convolution encoder and heads read from checkpoints, run on NumPy batches inside tasks.

A checkpoint is an ``.npz`` of arrays named ``<layer>.weight`` (out, in, k, k, k) and ``<layer>.bias``; a
head's may carry one of PREFIXES, and then only what carries it counts.  Heads load non-strictly: what a
checkpoint lacks stays 0 and what does not fit is ignored, both are logged.

Files go to executors with ``addFile`` and are loaded once in each Python worker.
"""

from __future__ import annotations

import functools
import logging
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .models import Model, SharedEncoder

LOG = logging.getLogger(__name__)
#: Of a head inside a larger checkpoint, the more specific first.
PREFIXES = ("model.decoder.", "decoder.")
FEATURES = 4


def conv3d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``(n, in, z, y, x)`` to ``(n, out, z, y, x)``, zeros beyond the border; odd kernels."""
    pads = [(k // 2, k // 2) for k in weight.shape[2:]]
    padded = np.pad(x, [(0, 0), (0, 0), *pads])
    out = np.zeros((len(x), weight.shape[0], *x.shape[2:]), np.result_type(x, weight))
    for at in np.ndindex(*weight.shape[2:]):
        seen = padded[(slice(None), slice(None), *[slice(o, o + n) for o, n in zip(at, x.shape[2:])])]
        out += np.einsum("oi,nizyx->nozyx", weight[(slice(None), slice(None), *at)], seen, optimize=True)
    return out + bias[None, :, None, None, None]


@dataclass(frozen=True)
class Layers:
    """Convolutions one after the other, with negative values cut between them."""

    weights: tuple[tuple[np.ndarray, np.ndarray], ...]
    last_linear: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (weight, bias) in enumerate(self.weights):
            x = conv3d(x, weight, bias)
            if not self.last_linear or i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x


def stripped(arrays: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Only what carries a prefix, without it; everything where nothing does."""
    for prefix in PREFIXES:
        mine = {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}
        if mine:
            return mine
    return dict(arrays)


def load_encoder(arrays: Mapping[str, np.ndarray]) -> Layers:
    mine = {k.removeprefix("encoder."): v for k, v in arrays.items() if k.startswith("encoder.")} or dict(arrays)
    count = len({k.split(".")[0] for k in mine if k.endswith(".weight")})
    if not count or any(f"{i}.{p}" not in mine for i in range(count) for p in ("weight", "bias")):
        raise ValueError("the encoder's checkpoint lacks layers")
    return Layers(tuple((mine[f"{i}.weight"], mine[f"{i}.bias"]) for i in range(count)), last_linear=False)


def load_head(arrays: Mapping[str, np.ndarray], inputs: int, features: int = FEATURES, name: str = "") -> Layers:
    """A hidden layer of ``features`` and an output of one channel."""
    mine = stripped(arrays)
    shapes = {"0.weight": (features, inputs, 3, 3, 3), "0.bias": (features,), "1.weight": (1, features, 1, 1, 1), "1.bias": (1,)}
    missing = [k for k, shape in shapes.items() if k not in mine or mine[k].shape != shape]
    unknown = [k for k in mine if k not in shapes or k in missing]
    if missing:
        LOG.warning("head %s lacks %d arrays, which stay 0: %s", name, len(missing), missing[:5])
    if unknown:
        LOG.warning("head %s: %d arrays ignored", name, len(unknown))
    full = {k: np.zeros(shape) if k in missing else mine[k] for k, shape in shapes.items()}
    return Layers(tuple((full[f"{i}.weight"], full[f"{i}.bias"]) for i in range(2)))


@functools.lru_cache(maxsize=2)
def _loaded(encoder: str, heads: tuple[str, ...], to_probability: bool, features: int) -> SharedEncoder:
    def arrays(name: str) -> dict[str, np.ndarray]:
        with np.load(SparkFiles.get(name)) as held:
            return {k: held[k].astype(np.float64) for k in held.files}

    coder = load_encoder(arrays(encoder))
    channels = coder.weights[-1][0].shape[0]
    return SharedEncoder(coder, [load_head(arrays(h), channels, features, h) for h in heads], to_probability)


@dataclass(frozen=True)
class FileNetwork:
    """Names of added files; the arrays are read where batches are run."""

    encoder: str
    heads: tuple[str, ...]
    to_probability: bool = True
    features: int = FEATURES

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return _loaded(self.encoder, self.heads, self.to_probability, self.features)(batch)


def _added(spark: SparkSession, path: str) -> str:
    """Add a file under a name of its own: heads of several folders may share one."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    source = of(path)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(source):
        raise FileNotFoundError(path)
    name = f"{uuid.uuid4().hex}-{source.getName()}"
    local = f"{tempfile.gettempdir()}/{name}"
    files.copyToLocalFile(False, source, of(f"file://{local}"), True)
    spark.sparkContext.addFile(local)
    return name


def network(spark: SparkSession, encoder: str, heads: Sequence[str], to_probability: bool = True, features: int = FEATURES) -> Model:
    """The model of an encoder's checkpoint and one checkpoint for each head, wherever Spark reads files."""
    names = [_added(spark, p) for p in (encoder, *heads)]
    return Model("tensor", channels=len(heads), tensor=FileNetwork(names[0], tuple(names[1:]), to_probability, features))


def repeated(model: Model, heads: int) -> Model:
    """A model of one channel, given to each of several heads."""
    if model.channels == heads or model.channels != 1:
        return model
    one, expression = model.tensor, model.expression
    many = (lambda b: np.concatenate([one(b)] * heads, axis=1)) if one else None
    columns = (lambda v, n: expression(v, n) * heads) if expression else None
    return Model(model.kind, channels=heads, expression=columns, tensor=many)
