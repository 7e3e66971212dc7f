"""Pictures cut into tiles are preprocessed as whole ones."""

import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from offerlake.operators import images as K


def cut(picture, rows, columns):
    """(y, x, tile) of a grid of about equal tiles."""
    ys, xs = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(picture.shape[:2], (rows, columns), strict=True))
    return [(int(a), int(c), picture[a:b, c:d]) for a, b in zip(ys[:-1], ys[1:], strict=True) for c, d in zip(xs[:-1], xs[1:], strict=True) if b > a and d > c]


@pytest.mark.parametrize("most", [4_000_000, 900])
def test_sixteen_tiles_equal_the_whole(spark, monkeypatch, most):
    """With the second bound pictures are shrunk, some tiles to nothing."""
    monkeypatch.setattr(K, "MAX_PIXELS", most)
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 256, (h, w, 4)).astype(np.uint8) for h, w in ((40, 60), (17, 4), (64, 64), (1, 16), (90, 31))] + [np.full((20, 20, 4), 255, np.uint8)]
    pictures[0][:, :, :3] //= 3  # mostly dark
    whole = spark.createDataFrame([(i, *p.shape[:2], p.tobytes()) for i, p in enumerate(pictures)], "image long, height int, width int, pixels binary")
    tiles = [(i, *p.shape[:2], y, x, *t.shape[:2], t.tobytes()) for i, p in enumerate(pictures) for y, x, t in cut(p, 4, 4)]
    got = {}
    for r in K.preprocess_tiles(spark.createDataFrame(tiles, "image long, height int, width int, y int, x int, tile_height int, tile_width int, pixels binary").repartition(5)).collect():
        got.setdefault(r.image, []).append(r)
    for r in K.preprocess_images(whole).collect():
        out = np.zeros((r.height, r.width), np.uint8)
        for t in got[r.image]:
            out[t.y : t.y + t.height, t.x : t.x + t.width] = np.frombuffer(t.pixels, np.uint8).reshape(t.height, t.width)
        assert (out == np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)).all()
        assert {(t.threshold, t.light_on_dark) for t in got[r.image]} == {(r.threshold, r.light_on_dark)}
        assert sum(t.height * t.width for t in got[r.image]) == r.height * r.width


def test_no_tiles(spark):
    assert K.preprocess_tiles(spark.createDataFrame([], "image string, height int, width int, y int, x int, tile_height int, tile_width int, pixels binary")).collect() == []


def test_small_tiles_take_little_time_each(spark):
    """Tiles of one size and place are worked on together, and give only the levels that they have."""
    n = 30_000
    tiles = spark.range(n).select(F.floor(F.col("id") / 2).alias("image"), F.lit(1).alias("height"), F.lit(4).alias("width"), F.lit(0).alias("y"), (F.col("id") % 2 * 2).cast("int").alias("x"), F.lit(1).alias("tile_height"), F.lit(2).alias("tile_width"), F.unhex(F.lit("000000FFFFFFFFFF")).alias("pixels"))
    began = time.time()
    got = K.preprocess_tiles(tiles).agg(F.count(F.lit(1)), F.sum(F.length("pixels")), F.sum("threshold"), F.sum("x")).first()
    assert tuple(got) == (n, 18 * n, 0, 3 * n) and time.time() - began < 30
