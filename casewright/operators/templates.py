"""Images against a template image: one bounded broadcast, one vectorised kernel over the image source.

The template is read once, its size is checked before its bytes are fetched, and only its gray, stretched pixels at the
kernel's size travel to the tasks.  Every image of a batch is brought to that size and correlated with it at once.
A broken image is like no template and is invalid by itself; a flat one is like nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import images as I
from casewright.operators.registry import member_flag
from casewright.operators.sessions import valid_new
from casewright.sources.png import decode_png

LARGEST = 1 << 24


def prepared(image: np.ndarray, size: int = I.SIZE) -> np.ndarray:
    """Gray, stretched to 0..255 and brought to ``size`` x ``size``."""
    return I.resize(I.stretch(I.grayscale(image)), size, size)


def read_template(spark: SparkSession, path: str, size: int = I.SIZE) -> np.ndarray:
    """The prepared pixels of one PNG file; a file over ``LARGEST`` bytes is refused before it is read."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("length").limit(2).collect()
    if len(found) != 1 or found[0].length > LARGEST:
        raise ValueError(f"{path} is not one image of at most {LARGEST} bytes")
    return prepared(decode_png(bytes(files.select("content").first().content)), size)


def template_similarity(template: np.ndarray, height: Column, width: Column, channels: Column, data: Column) -> Column:
    """Correlation of raw 8-bit pixels with the template; null for a broken image."""
    if template.nbytes > LARGEST:
        raise ValueError("the template is too large to be sent to every task")
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast(template)

    @F.arrow_udf(T.DoubleType())
    def kernel(h: pa.Array, w: pa.Array, n: pa.Array, pixels: pa.Array) -> pa.Array:
        known = shared.value.astype(np.float64)
        known = (known - known.mean()).ravel()
        own = np.zeros((len(h), known.size))
        whole = np.zeros(len(h), bool)
        for i, (a, b, c, raw) in enumerate(zip(*(x.to_pylist() for x in (h, w, n, pixels)))):
            if a and b and c and a > 0 and raw is not None and len(raw) == a * b * c:
                own[i] = prepared(np.frombuffer(raw, np.uint8).reshape(a, b, c), shared.value.shape[0]).ravel()
                whole[i] = True
        own -= own.mean(1, keepdims=True)
        norm = np.sqrt((own * own).sum(1) * (known @ known))
        values = np.divide(own @ known, norm, out=np.zeros(len(own)), where=norm > 0)
        return pa.array(values, mask=~whole)

    return kernel(height, width, channels, data)


def measured_images(images: DataFrame, template: np.ndarray) -> DataFrame:
    """``images`` of the image source with ``digest`` and ``similarity`` in place of their pixels: all that is ever asked of
    them, so that a caller who needs it twice keeps it instead of reading the images again."""
    hashed = images.withColumn("digest", I.image_hash("height", "width", "nChannels", "data"))
    likeness = template_similarity(template, F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))
    return hashed.withColumn("similarity", likeness).drop("data")


def judged(measured: DataFrame, hashes: DataFrame, similar: float = I.SIMILAR) -> DataFrame:
    """Measured images with ``seen``, ``is_template`` and ``is_valid``.

    ``hashes`` is the registry with the column NAME; an image is valid that can be read, is not seen and like no template.
    """
    flagged = member_flag(measured, "digest", hashes, "seen", ignore_case=False)
    marked = flagged.withColumn("is_template", F.coalesce(F.col("similarity") > similar, F.lit(False)))
    return marked.withColumn("is_valid", (F.col("height") > 0) & valid_new("seen", "is_template"))


def judged_images(images: DataFrame, template: np.ndarray, hashes: DataFrame, similar: float = I.SIMILAR) -> DataFrame:
    """``images`` of the image source, measured and judged."""
    return judged(measured_images(images, template), hashes, similar)
