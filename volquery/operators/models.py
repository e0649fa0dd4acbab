"""The model registry and the models that stand in for networks.

A model says how it is applied: ``pointwise`` models are column expressions of a voxel, ``patch`` models
column expressions over a patch (zero-padded voxels count), ``tensor`` models take and return NumPy
batches ``(n, 1, z, y, x) -> (n, channels, z, y, x)``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import probability

PATCH_KEYS = ("k_z", "k_y", "k_x", "s_z", "s_y", "s_x")


@dataclass
class Model:
    """``expression(value, voxels_of_a_patch)`` gives one column for each channel; ``tensor(batch)`` the
    same on arrays."""

    kind: str
    channels: int = 1
    expression: Callable[[Column, int], list[Column]] | None = None
    tensor: Callable[[np.ndarray], np.ndarray] | None = None


class Registry:
    """Loaders of models by name.  Registering a name again replaces its loader."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[str | None], Model]] = {}

    def register(self, name: str) -> Callable:
        def keep(loader: Callable[[str | None], Model]) -> Callable[[str | None], Model]:
            self._loaders[name] = loader
            return loader

        return keep

    def load(self, name: str, weights: str | None = None) -> Model:
        if name not in self._loaders:
            raise KeyError(f"no model named {name!r}; there are: {', '.join(self._loaders) or 'none'}")
        return self._loaders[name](weights)

    def names(self) -> list[str]:
        return list(self._loaders)


MODELS = Registry()


def load_model(name: str, weights: str | None = None, spark: SparkSession | None = None) -> Model:
    """The model, its weights fetched from wherever Spark reads files (``addFile``): a local path, a shared
    folder or an object store.  Executors get the weights with the model, not by path."""
    if weights is not None:
        weights = fetched(spark, weights) if spark is not None else weights
        if not os.path.exists(weights):
            raise FileNotFoundError(weights)
    return MODELS.load(name, weights)


def fetched(spark: SparkSession, path: str) -> str:
    """The driver's copy of a file that Spark can read."""
    if os.path.exists(path):
        return path
    try:
        spark.sparkContext.addFile(path)
    except Exception as error:
        raise FileNotFoundError(path) from error
    return SparkFiles.get(path.rsplit("/", 1)[-1])


@MODELS.register("identity")
def identity(weights: str | None = None) -> Model:
    return Model("pointwise", expression=lambda v, n: [v], tensor=lambda b: b)


@MODELS.register("affine")
def affine(weights: str | None = None) -> Model:
    """``gain * v + bias``, by default 0.5 and 0.25, or the two numbers of a ``.npy`` file."""
    gain, bias = (0.5, 0.25) if weights is None else (float(x) for x in np.load(weights))
    return Model("pointwise", expression=lambda v, n: [v * gain + bias], tensor=lambda b: b * gain + bias)


@MODELS.register("threshold")
def threshold(weights: str | None = None) -> Model:
    cut = 0.5 if weights is None else float(np.load(weights))
    return Model("pointwise", expression=lambda v, n: [F.when(v > cut, 1.0).otherwise(0.0)], tensor=lambda b: (b > cut).astype(b.dtype))


def _patch_mean(value: Column, n: int) -> Column:
    # zero padding is part of the patch: divide by its full size
    return F.sum(value).over(Window.partitionBy(*PATCH_KEYS)) / F.lit(float(n))


@MODELS.register("patch-demean")
def patch_demean(weights: str | None = None) -> Model:
    return Model("patch", expression=lambda v, n: [v - _patch_mean(v, n)], tensor=lambda b: b - b.mean(axis=(2, 3, 4), keepdims=True))


@MODELS.register("box-mean3")
def box_mean3(weights: str | None = None) -> Model:
    """The mean of the 27 voxels around each, zeros beyond the patch."""

    def run(batch: np.ndarray) -> np.ndarray:
        out = batch.astype(np.float64)
        for axis in (2, 3, 4):
            padded = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in range(5)])
            n = out.shape[axis]
            out = sum(np.take(padded, np.arange(i, i + n), axis=axis) for i in range(3))
        return out / 27.0

    return Model("tensor", tensor=run)


@dataclass
class SharedEncoder:
    """One encoder and several heads on its output, optionally squeezed to probabilities.

    The encoder may return a tuple of five or more: its first entry is the latent code and its fifth the
    hidden features, and heads get both by name; a head that cannot take them is called with the plain
    output.  The encoder is evaluated once."""

    encoder: Callable[[Any], Any]
    heads: list[Callable[..., Any]] = field(default_factory=list)
    to_probability: bool = False

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        coded = self.encoder(batch)
        outputs = []
        for head in self.heads:
            if isinstance(coded, tuple) and len(coded) >= 5:
                try:
                    outputs.append(head(latent=coded[0], hidden=coded[4]))
                    continue
                except TypeError:
                    pass
            outputs.append(head(coded))
        stacked = np.concatenate([x[:, :1] for x in outputs], axis=1)
        return np.clip(1 / (1 + np.exp(-stacked)), 0.01, 0.99) if self.to_probability else stacked

    def model(self) -> Model:
        return Model("tensor", channels=len(self.heads), tensor=self)


def shared_expression(encoder: Callable[[Column], Column], heads: list[Callable[[Column], Column]], to_probability: bool = False) -> Model:
    """The same as column expressions: heads share the encoder's column, which is computed once."""

    def channels(value: Column, n: int) -> list[Column]:
        out = [head(encoder(value)) for head in heads]
        return [probability(x) for x in out] if to_probability else out

    return Model("pointwise", channels=len(heads), expression=channels)
