"""Image kernels in numpy behind Arrow UDFs: gray, stretch, resize, fingerprint, similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIZE = 256
SIMILAR = 0.9
_KINDS = ("bool", "uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64")


def grayscale(image: np.ndarray) -> np.ndarray:
    """Mean over channels."""
    if image.ndim not in (2, 3):
        raise ValueError("an image has two or three dimensions")
    return image if image.ndim == 2 else image.mean(axis=2)


def stretch(image: np.ndarray) -> np.ndarray:
    """Smallest value to 0, largest to 255, truncated; a flat image is 0."""
    image = image.astype(np.float64)
    low, high = image.min(), image.max()
    if high == low:
        return np.zeros(image.shape, np.uint8)
    return ((image - low) / (high - low) * 255.0).astype(np.uint8)


def resize(image: np.ndarray, height: int = SIZE, width: int = SIZE) -> np.ndarray:
    """Bilinear with half-pixel centres, rounded."""

    def weights(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    (r0, r1, fr), (c0, c1, fc) = weights(image.shape[0], height), weights(image.shape[1], width)
    image = image.astype(np.float64)
    rows = image[r0] * (1 - fr)[:, None] + image[r1] * fr[:, None]
    columns = np.ascontiguousarray(rows.T)  # whole lines are gathered much faster than single numbers
    wide = columns[c0] * (1 - fc)[:, None]
    wide += columns[c1] * fc[:, None]
    return np.ascontiguousarray(np.rint(wide, out=wide).astype(np.uint8).T)


def fingerprint(image: np.ndarray) -> str:
    """SHA-256 of the stretched gray image at 256 x 256; the same pixels in any integer kind agree."""
    if image.dtype.name not in _KINDS:
        raise ValueError(f"unsupported pixel kind {image.dtype}")
    return hashlib.sha256(resize(stretch(grayscale(image))).tobytes()).hexdigest()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean-centred normalised cross-correlation of equal shapes; 0 if either is flat."""
    x, y = a.astype(np.float64).ravel() - a.mean(), b.astype(np.float64).ravel() - b.mean()
    norm = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / norm) if norm else 0.0


def is_template(image: np.ndarray, template: np.ndarray) -> bool:
    return similarity(resize(stretch(grayscale(image))), template) > SIMILAR


@F.pandas_udf(StringType())
def image_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Fingerprint of raw 8-bit pixels as the image source gives them; null for a broken image."""
    return pd.Series([fingerprint(np.frombuffer(d, np.uint8).reshape(h, w, c)) if h > 0 and w > 0 and c > 0 else None for h, w, c, d in zip(height, width, channels, data)])


def bit_depth(kind: Column) -> Column:
    return F.when(kind == "bool", 1).otherwise(F.regexp_extract(kind, r"(\d+)$", 1).try_cast("int"))


def correlation(a: Column, b: Column) -> Column:
    """``similarity`` of two array columns with built-in functions."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    ma, mb = total(a) / F.size(a), total(b) / F.size(b)
    xy = total(F.zip_with(a, b, lambda x, y: (x.cast("double") - ma) * (y.cast("double") - mb)))
    xx = total(F.transform(a, lambda x: (x.cast("double") - ma) * (x.cast("double") - ma)))
    yy = total(F.transform(b, lambda y: (y.cast("double") - mb) * (y.cast("double") - mb)))
    return xy / F.sqrt(xx * yy)


def dummy_image(size: tuple[int, int] = (256, 256)) -> np.ndarray:
    """An image without content, of not-a-number throughout."""
    return np.full(size, np.nan)
