"""Listings, range reads, broken images, the template filter and headers for stills."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.functions import images as I
from casewright.operators import headers, templates
from casewright.sources import dicom, listings
from casewright.sources.file_heads import file_heads
from casewright.sources.png import encode_png


def test_heads_read_a_few_bytes_only(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.MP4").write_bytes(b"\0\0\0\x18ftypisom" + b"x" * 100)
    (tmp_path / "b.mp4").write_bytes(b"junk")
    with open(tmp_path / "huge.mp4", "wb") as f:  # three sparse gigabytes: more than one row could hold
        f.write(b"\0\0\0\x18ftypmp42")
        f.truncate(3 << 30)
    (tmp_path / "c.jpg").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.head)) for r in file_heads(spark, str(tmp_path), ".mp4", 6).collect()}
    assert got == {"a.MP4": (112, b"\0\0\0\x18ft"), "b.mp4": (4, b"junk"), "huge.mp4": (3 << 30, b"\0\0\0\x18ft")}
    assert {r.path.rsplit("/", 1)[1]: r.is_valid for r in listings.playable_videos(spark, str(tmp_path)).collect()} == {"a.MP4": True, "b.mp4": False, "huge.mp4": True}
    (tmp_path / "none").mkdir()
    assert listings.playable_videos(spark, str(tmp_path / "none")).count() == 0


def test_positions_and_at_least_one(spark, tmp_path):
    import os

    for i, name in enumerate(("z.jpg", "a.JPEG", "m.mp4", "b.mp4")):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_700_000_000 + 90_000 * i, 1_700_000_000 + 90_000 * i))
    rows = listings.media_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.position) for r in rows] == [("z.jpg", 1), ("a.JPEG", 2), ("m.mp4", 3), ("b.mp4", 4)]
    assert listings.at_least_one(listings.media_files(spark, str(tmp_path)), "MP4").count() == 4
    (tmp_path / "m.mp4").unlink()
    (tmp_path / "b.mp4").unlink()
    with pytest.raises(FileNotFoundError, match="no MP4"):
        listings.at_least_one(listings.media_files(spark, str(tmp_path)), "MP4")


def test_template_filter_over_the_image_source(spark, tmp_path):
    r = np.random.default_rng(3)
    template = r.integers(0, 256, (32, 32)).astype(np.uint8)
    close, other, seen = np.clip(template + r.integers(0, 9, template.shape), 0, 255).astype(np.uint8), r.integers(0, 256, (20, 30, 3)).astype(np.uint8), r.integers(0, 256, (9, 9)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "template.png").write_bytes(encode_png(template))
    for name, image in {"close": close, "other": other, "seen": seen, "flat": np.full((8, 8), 7, np.uint8)}.items():
        (tmp_path / f"in/{name}.png").write_bytes(encode_png(image))
    (tmp_path / "in/broken.png").write_bytes(b"\x89PNG no image")
    known = spark.createDataFrame([(I.fingerprint(np.repeat(seen[:, :, None], 1, 2)),)], "NAME string")
    read = templates.read_template(spark, str(tmp_path / "template.png"))
    judged = templates.judged_images(listings.images(spark, str(tmp_path / "in")).drop("is_valid"), read, known)
    got = {x.origin.rsplit("/", 1)[1][:-4]: x for x in judged.collect()}
    assert {k: v.is_valid for k, v in got.items()} == {"close": False, "other": True, "seen": False, "flat": True, "broken": False}
    assert got["close"].is_template and got["seen"].seen and got["broken"].similarity is None and got["broken"].digest is None
    for name, image in {"close": close, "other": other}.items():
        gray = templates.prepared(image[:, :, ::-1] if image.ndim == 3 else image)
        assert abs(got[name].similarity - I.similarity(gray, read)) < 1e-9
    with pytest.raises(ValueError, match="not one image"):
        templates.read_template(spark, str(tmp_path / "in"))


def test_still_header_round_trip(spark):
    c = lambda s: F.lit(s)
    tags = headers.still_header(c("1_2_3"), c("2_25_9"), c("2_25_8"), F.lit(4), c("20240305"), c("101112.000"), c("site"), c("/in/x y.jpg"), c("20250101"), c("000000.000"))
    df = spark.range(1).select(dicom.encode(tags, F.lit(2), F.lit(3), F.lit(b"abcdef"), F.lit(False)).alias("content"))
    got = df.select(dicom.decode(F.col("content")).alias("h")).first().h
    plain = {k: v.value for k, v in got.tags.items()}
    assert got.error is None and (got.rows, got.cols, bytes(got.pixels)) == (2, 3, b"abcdef")
    assert plain["0020000E"] == "1.2.3" and plain["0020000D"] == plain["00020012"] == "2.25.9" and plain["00204000"] == "/in/x y.jpg"
    assert plain["00100010"] == headers.REDACTED and plain["00080008"] == "ORIGINAL\\PRIMARY\\ARTHRO_DIAGN_IMG" and plain["00200013"] == "4"
