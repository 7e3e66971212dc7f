"""Pictures: decoding, resampling, and the whole preprocessing against a plain walk over pixels."""

import random
import struct
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from offerlake.operators.images import EMPTY, binarize, otsu_threshold, preprocess_images, resample_nearest, threshold_of, with_empty
from offerlake.sources.images import read_images


def png(rows):
    """RGBA rows as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6, 0, 0, 0)
    body = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_read_images_keeps_alpha_and_skips_what_is_none(spark, tmp_path):
    rows = [[(255, 0, 0, 255), (0, 255, 0, 128)], [(0, 0, 255, 0), (1, 2, 3, 4)]]
    (tmp_path / "a.png").write_bytes(png(rows))
    (tmp_path / "b.png").write_bytes(b"prose")
    got = read_images(spark, str(tmp_path)).collect()
    assert [(r.height, r.width, bytes(r.pixels)) for r in got] == [(2, 2, bytes(sum((list(p) for row in rows for p in row), [])))]


def test_resampling():
    rgba = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    assert resample_nearest(rgba, 1) is rgba
    big = resample_nearest(rgba, 3.0)
    assert big.shape == (6, 9, 4) and (big[5, 8] == rgba[1, 2]).all() and (big[2, 3] == rgba[0, 1]).all()
    assert resample_nearest(rgba, 0.5).shape == (1, 2, 4) and resample_nearest(rgba, 0.01).shape == (1, 1, 4)


def plain(rows, height, width):
    """Enlarge three times, over white, luma, threshold, polarity."""
    over = [[round(c * (p[3] / 255) + 255 * (1 - p[3] / 255)) for c in p[:3]] for p in rows]
    gray = [min(255, max(0, round(0.299 * r + 0.587 * g + 0.114 * b))) for r, g, b in over]
    big = [gray[y // 3 * width + x // 3] for y in range(3 * height) for x in range(3 * width)]
    best, most = 0, -1.0
    for level in range(256):
        low, high = [v for v in big if v <= level], [v for v in big if v > level]
        if low and high:
            variance = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if variance > most * (1 + 1e-12):
                best, most = level, variance
    dark = sum(v <= best for v in big)
    inverse = dark * 2 > len(big)
    return best, inverse, bytes(0 if (v <= best) != inverse else 255 for v in big)


def test_preprocessing(spark):
    draw = random.Random(2)
    rows = []
    for i in range(12):
        h, w = draw.randint(1, 4), draw.randint(1, 5)
        pixels = [tuple(draw.choice([0, 30, 200, 255]) for _ in range(4)) for _ in range(h * w)]
        rows.append((i, h, w, bytearray(sum((list(p) for p in pixels), [])), pixels))
    df = spark.createDataFrame([r[:4] for r in rows], "image int, height int, width int, pixels binary")
    got = {r.image: r for r in preprocess_images(df).collect()}
    for i, h, w, _, pixels in rows:
        assert (got[i].threshold, got[i].light_on_dark, bytes(got[i].pixels)) == plain(pixels, h, w) and (got[i].height, got[i].width) == (3 * h, 3 * w)
    wide = spark.createDataFrame([(1, 1000, 9000, bytearray(bytes([9, 9, 9, 255]) * 9_000_000))], "image int, height int, width int, pixels binary")
    r = preprocess_images(wide).first()
    assert (r.height, r.width) == (667, 6000) and set(r.pixels) == {0} | set() or set(r.pixels) == {255}


def test_thresholds_of_groups_without_pixels(spark):
    pixels = spark.createDataFrame([("a", 20), ("a", 22), ("a", 230), ("b", 7)], "g string, level int")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    got = {r.g: r.threshold for r in with_empty(otsu_threshold(pixels, "g", "level"), groups, "g").collect()}
    assert got == {"a": 22, "b": 0, "c": EMPTY} and threshold_of(np.zeros((0, 0), np.int64)) == EMPTY
    assert spark.range(1).select(binarize(F.lit(5), F.lit(9), F.lit(False)), binarize(F.lit(5), F.lit(9), F.lit(True))).first() == (0, 255)


def test_small_pictures_take_little_time_each(spark):
    """Pictures of one size are worked on together; one at a time these take minutes."""
    n = 60_000
    level = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i * i * 37 + F.col("id") * 13) % 256)
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.concat(F.repeat(F.lpad(F.hex(v), 2, "0"), 3), F.lit("FF"))), ""))
    rows = spark.range(n).select(F.col("id").alias("image"), F.lit(1).alias("height"), F.lit(4).alias("width"), pixels.alias("pixels"))
    began = time.time()
    got = preprocess_images(rows).agg(F.count(F.lit(1)), F.sum("height"), F.sum(F.length("pixels"))).first()
    assert tuple(got) == (n, 3 * n, 36 * n) and time.time() - began < 30
