"""PNG and base64 images by numpy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """8-bit gray, RGB or RGBA without interlacing, as height x width x channels."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, header = 8, [], None
    while at < len(raw):
        (size,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("unsupported PNG")
    n = _CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        above = out[y - 1].astype(np.int64) if y else np.zeros(width * n, np.int64)
        if kind in (0, 2):
            out[y] = line + (above if kind == 2 else 0)
            continue
        row = np.zeros(width * n, np.int64)
        for x in range(width * n):
            left = row[x - n] if x >= n else 0
            corner = above[x - n] if x >= n else 0
            if kind == 1:
                guess = left
            elif kind == 3:
                guess = (left + above[x]) // 2
            else:
                p = left + above[x] - corner
                guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
            row[x] = (line[x] + guess) & 255
        out[y] = row
    return out.reshape(height, width, n)


def encode_png(image: np.ndarray) -> bytes:
    """Gray or RGB 8-bit pixels as an unfiltered PNG."""
    image = image if image.ndim == 3 else image[:, :, None]
    colour = {v: k for k, v in _CHANNELS.items()}[image.shape[2]]
    rows = np.concatenate([np.zeros((image.shape[0], 1), np.uint8), image.reshape(image.shape[0], -1)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def _encoded(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else encode_png(np.asarray(p, np.uint8).reshape(h, w)) for p, h, w in zip(pixels, height, width)])


def png_bytes(pixels: Column, height: Column, width: Column) -> Column:
    """A gray PNG of an array of 0 to 255, row by row."""
    return _encoded(pixels, height, width)


def label_image(text: Column, size: int = 512) -> Column:
    """Base64 PNG text as raw RGB pixels of ``size`` x ``size``."""

    @F.pandas_udf("binary")
    def decode(raw: pd.Series) -> pd.Series:
        from casewright.functions.images import resize

        def one(b: bytes) -> bytes:
            image = decode_png(bytes(b))
            rgb = np.repeat(image[:, :, :1], 3, 2) if image.shape[2] < 3 else image[:, :, :3]
            return np.stack([resize(rgb[:, :, k], size, size) for k in range(3)], 2).tobytes()

        return raw.map(one, na_action="ignore")

    return decode(F.unbase64(text))
