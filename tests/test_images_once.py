"""Images are read once, by a few tasks a core, and resized as before."""

import numpy as np

from casewright.functions import images as I
from casewright.plans import files
from casewright.sources import listings
from casewright.sources.png import encode_png


def plain(image, height, width):
    """Bilinear with half-pixel centres, number by number."""
    out = np.zeros((height, width), np.uint8)
    for i in range(height):
        for j in range(width):
            y, x = (min(max((k + 0.5) * n / m - 0.5, 0), n - 1) for k, n, m in ((i, image.shape[0], height), (j, image.shape[1], width)))
            a, b = int(y), int(x)
            lower = [image[a, k] * (1 - (y - a)) + image[min(a + 1, image.shape[0] - 1), k] * (y - a) for k in (b, min(b + 1, image.shape[1] - 1))]
            out[i, j] = np.rint(lower[0] * (1 - (x - b)) + lower[1] * (x - b))
    return out


def test_resize_equals_plain_bilinear():
    r = np.random.default_rng(5)
    for shape, size in (((8, 8), (32, 32)), ((5, 9), (16, 7)), ((40, 3), (8, 8)), ((1, 1), (4, 6))):
        image = r.integers(0, 256, shape).astype(np.float64)
        got = I.resize(image, *size)
        assert (got == plain(image, *size)).all() and got.flags["C_CONTIGUOUS"]


def test_template_images_reads_the_images_once(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i}.png").write_bytes(encode_png(np.full((2, 2), i % 256, np.uint8)))
    read = listings.images(spark, str(tmp_path))
    assert read.count() == 300 and read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    plan = files.QUERIES["template_images"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "image.origin" not in plan and "FileScan image" not in plan and "Python" not in plan
