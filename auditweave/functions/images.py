"""Perceptual hash and classical descriptor of decoded images (NumPy within Arrow batches)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """An RGB array of floats in 0..255 from Spark's image rows (BGR, grey or BGRA bytes); null if it wasn't decoded."""
    if height is None or height <= 0 or width <= 0 or not data:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1] if channels >= 3 else None


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def resize(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area averages; where the image is smaller, nearest values."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        w = np.clip(np.minimum(np.arange(n) + 1, edges[1:, None]) - np.maximum(np.arange(n), edges[:-1, None]), 0, None)
        return w / w.sum(1, keepdims=True)

    out = np.tensordot(weights(a.shape[0], rows), a, axes=(1, 0))
    return np.moveaxis(np.tensordot(weights(a.shape[1], columns), out, axes=(1, 1)), 0, 1)


@lru_cache(4)
def cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))


def perceptual_hash(rgb: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """The low frequencies of a cosine transform against their median, as 64 bits in a signed long."""
    n = size * factor
    low = (cosines(n) @ resize(grey(rgb), n, n) @ cosines(n).T)[:size, :size]
    return int(np.frombuffer(np.packbits((low > np.median(low)).ravel()).tobytes(), ">i8")[0])


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def structure(rgb: np.ndarray) -> np.ndarray:
    """16 x 16 grey values, centred, of unit deviation."""
    g = resize(grey(rgb), 16, 16) / 255
    g = g - g.mean()
    return (g / g.std() if g.std() > 1e-6 else g).ravel()


def chromaticity(rgb: np.ndarray) -> np.ndarray:
    """8 x 8 shares of red and green, centred."""
    small = resize(rgb, 8, 8)
    share = small[:, :, :2] / np.maximum(small.sum(2, keepdims=True), 1e-6)
    return (share - share.mean((0, 1))).transpose(2, 0, 1).ravel()


def gradients(rgb: np.ndarray, cells: int = 4, bins: int = 8) -> np.ndarray:
    """Histograms of unsigned orientations, weighted by magnitude, in a grid of cells."""
    dy, dx = np.gradient(resize(grey(rgb), 64, 64) / 255)
    which = np.minimum((np.mod(np.arctan2(dy, dx), np.pi) / np.pi * bins).astype(int), bins - 1)
    row, column = np.indices(which.shape) * cells // 64
    return np.bincount(((row * cells + column) * bins + which).ravel(), np.hypot(dx, dy).ravel(), cells * cells * bins)


def descriptor(rgb: np.ndarray) -> np.ndarray:
    """512 numbers of unit norm: structure, chromaticity and gradients, each of unit norm before."""
    return unit(np.concatenate([unit(structure(rgb)), unit(chromaticity(rgb)), unit(gradients(rgb))])).astype(np.float32)


def phash(image: Column) -> Column:
    def run(image: pd.DataFrame) -> pd.Series:
        found = (pixels(*x) for x in image[["height", "width", "nChannels", "data"]].itertuples(index=False))
        return pd.Series([None if p is None else perceptual_hash(p) for p in found], dtype="Int64")

    return F.pandas_udf(run, "bigint")(image)


def embedding(image: Column) -> Column:
    """The classical descriptor; zeros where the image can't be read."""

    def run(image: pd.DataFrame) -> pd.Series:
        found = (pixels(*x) for x in image[["height", "width", "nChannels", "data"]].itertuples(index=False))
        return pd.Series([np.zeros(512, np.float32) if p is None else descriptor(p) for p in found])

    return F.pandas_udf(run, "array<float>")(image)


def tensor(image: Column, side: int) -> Column:
    """side x side RGB values in 0..1, row by row, as a flat array; zeros where the image can't be read."""

    def run(image: pd.DataFrame) -> pd.Series:
        found = (pixels(*x) for x in image[["height", "width", "nChannels", "data"]].itertuples(index=False))
        return pd.Series([np.zeros(side * side * 3, np.float32) if p is None else (resize(p, side, side) / 255).astype(np.float32).ravel() for p in found])

    return F.pandas_udf(run, "array<float>")(image)


def learned(make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = 224, batch: int = 32) -> Callable[[Column], Column]:
    """A vectoriser for PROVIDERS from a model of one's own: make_predict loads it, once in each worker, and returns a function from images (n, side,
    side, 3) to vectors (n, width).

    A file that can't be read has no vector: it is corrupt, whatever the model makes of zeros."""

    def vectors(image: Column) -> Column:
        model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[side, side, 3]])
        return model(tensor(image, side))

    return vectors


#: What computes a vector for an image struct, by name: a function of a column, or None for no vectors.
PROVIDERS = {"classical": embedding, "off": None}


def provider(name: str = "auto"):
    """(name, function) of the vectoriser to use: `auto` takes a registered learned one, else the classical descriptor.

    A learned one is registered in PROVIDERS under "learned"; asked for by name and missing, there are no vectors."""
    if name == "auto":
        name = "learned" if "learned" in PROVIDERS else "classical"
    return (name, PROVIDERS[name]) if name in PROVIDERS else ("none", None)
