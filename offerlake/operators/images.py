"""Pictures of messages and the words read in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import clean_value, strip_non_content, tag_attributes
from ..functions.text import trim
from ..functions.values import FURNITURE
from ..jobs.tables import written

MAX_IMAGES, MIN_WIDTH, MIN_HEIGHT = 25, 200, 100
MIN_BYTES, MAX_BYTES = 6_000, 8_000_000
MAX_PIXELS, ENLARGE, EMPTY = 4_000_000, 3.0, 128
TOGETHER = 1_000_000


def _size(c: Column) -> Column:
    return F.regexp_extract(trim(c), r"(?i)\A([0-9]+)(?:px)?\z", 1)


def remote_images(messages: DataFrame) -> DataFrame:
    """(message_id, ord, url, width, height, pixel_area) of pictures by address: each address once a message, no
    furniture by name, and none declared smaller than 200 by 100."""
    rows = messages.select("message_id", F.posexplode(tag_attributes(strip_non_content(F.col("html")), "img")).alias("ord", "a"))
    value = lambda k: clean_value(F.coalesce(F.col("a")[k], F.lit("")))
    rows = rows.select("message_id", "ord", value("src").alias("url"), F.concat_ws(" ", *[value(k) for k in ("src", "class", "id", "alt")]).alias("names"), *[F.nullif(_size(value(k)), F.lit("")).cast("bigint").alias(k) for k in ("width", "height")])
    good = rows.filter(F.col("url").rlike("(?i)^https?://") & ~F.col("names").rlike(FURNITURE) & F.coalesce(F.col("width") >= MIN_WIDTH, F.lit(True)) & F.coalesce(F.col("height") >= MIN_HEIGHT, F.lit(True)))
    first = good.groupBy("message_id", "url").agg(F.min_by(F.struct("ord", "width", "height"), "ord").alias("i"))
    return first.select("message_id", "i.ord", "url", "i.width", "i.height", (F.col("i.width") * F.col("i.height")).alias("pixel_area"))


def select_images(images: DataFrame, limit: int = MAX_IMAGES) -> DataFrame:
    """At most ``limit`` pictures (message_id, ord, source, byte_size, pixel_area) a message: inline ones first, large ones first."""
    size = F.coalesce(F.when(F.col("source") == "inline", F.col("byte_size")).otherwise(F.col("pixel_area")), F.lit(-1))
    order = Window.partitionBy("message_id").orderBy(F.desc(F.col("source") == "inline"), F.desc(size), "ord")
    return images.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def readable_bytes(size: Column) -> Column:
    return size.between(MIN_BYTES, MAX_BYTES)


def base64_bytes(data: Column) -> Column:
    """About how many bytes base64 text stands for."""
    return F.floor(F.length(data) * 3 / 4).cast("bigint")


def image_bytes_filter(images: DataFrame) -> DataFrame:
    """Pictures (byte_size, data) whose bytes, as declared or by their base64 text, can hold words; unknown sizes stay."""
    return images.filter(F.coalesce(readable_bytes(F.coalesce(F.col("byte_size"), base64_bytes(F.col("data")))), F.lit(True)))


def inline_images(parts: DataFrame) -> DataFrame:
    """Pictures among message parts, also below attachments: message_id, path, mime_type, attachment_id, data, byte_size.

    They have data of their own or an attachment's id, no name of page furniture, and no declared size that is too small.
    """
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    data, kept = F.nullif(F.col("body.data"), F.lit("")), F.nullif(F.col("body.attachmentId"), F.lit(""))
    good = mime.startswith("image/") & (data.isNotNull() | kept.isNotNull()) & ~F.coalesce("filename", F.lit("")).rlike(FURNITURE) & F.coalesce(F.col("body.size") >= MIN_BYTES, F.lit(True))
    return parts.filter(good).select("message_id", "path", mime.alias("mime_type"), kept.alias("attachment_id"), data.alias("data"), F.col("body.size").alias("byte_size"))


def word_survives(text: Column, confidence: Column) -> Column:
    return confidence >= F.when(F.upper(text).rlike("[O0I1S5B8]"), 85).otherwise(70)


def usable_text(words: DataFrame, image: list[str], floor: float = 60) -> DataFrame:
    """One row a picture of ``words`` (image columns, pos, text, confidence): mean confidence, text.

    A mean under ``floor`` discards the picture's text; else words must be sure, those with glyphs that are
    easily taken for others surer.
    """
    good = word_survives(F.col("text"), F.col("confidence")) & (trim(F.col("text")) != "")
    kept = F.array_sort(F.collect_list(F.when(good, F.struct("pos", trim(F.col("text")).alias("w")))))
    rows = words.groupBy(*image).agg(F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n_words"), kept.alias("kept"))
    return rows.select(*image, "mean", "n_words", F.when(F.col("mean") < floor, "").otherwise(F.array_join(F.transform("kept", lambda x: x["w"]), " ")).alias("text"))


def ocr_runs(images: DataFrame) -> DataFrame:
    """One row a message of ``usable_text`` rows (message_id, image, mean, n_words, text): read, accepted, mean, text."""
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("image", "text"))))
    return images.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("text") != "").alias("n_accepted"), F.avg("mean").alias("mean"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))


def otsu_threshold(pixels: DataFrame, group: str, level: str) -> DataFrame:
    """(group, threshold): the level from 0 to 255 that parts a group's levels with the largest between-class variance.

    The windows run over at most 256 counts a group. The first of equal levels counts; with one level it is 0.
    """
    return threshold_of_counts(pixels.groupBy(group, F.col(level).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")), group)


def threshold_of_counts(counts: DataFrame, group: str) -> DataFrame:
    """As ``otsu_threshold``, of counts (group, level, n) that are summed over parts of a group."""
    upto = Window.partitionBy(group).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(group)
    rows = counts.select(group, "level", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s"), F.sum("n").over(everything).alias("wt"), F.sum(F.col("n") * F.col("level")).over(everything).alias("st"))
    low, high = F.col("s") / F.col("w"), (F.col("st") - F.col("s")) / (F.col("wt") - F.col("w"))
    variance = F.col("w").cast("double") * (F.col("wt") - F.col("w")) * (low - high) * (low - high)
    rows = rows.withColumn("variance", F.when(F.col("w") < F.col("wt"), variance).otherwise(F.lit(0.0)))
    best = F.max_by("level", F.struct("variance", -F.col("level")))
    return rows.groupBy(group).agg(F.when(F.max("variance") > 0, best).otherwise(F.lit(0)).alias("threshold"))


def with_empty(thresholds: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Thresholds of all ``groups``: 128 where a group has no pixels."""
    return groups.select(group).distinct().join(thresholds, group, "left").withColumn("threshold", F.coalesce("threshold", F.lit(EMPTY)))


def binarize(level: Column, threshold: Column, light_on_dark: Column) -> Column:
    """0 for ink, 255 for paper, whichever of them is dark."""
    return F.when((level <= threshold) != light_on_dark, 0).otherwise(255)


def polarity(pixels: DataFrame, thresholds: DataFrame, group: str, level: str) -> DataFrame:
    """(group, threshold, light_on_dark): more than half of the pixels at or under the threshold are a dark ground."""
    rows = pixels.select(group, F.col(level).cast("int").alias("level")).join(thresholds, group)
    return rows.groupBy(group, "threshold").agg((F.count_if(F.col("level") <= F.col("threshold")) * 2 > F.count(F.lit(1))).alias("light_on_dark"))


def luma(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """Luma of a pixel over white, rounded half to even at each step, as clamped bytes are."""
    over = lambda c: F.bround(c * (alpha / 255) + F.lit(255.0) * (1 - alpha / 255))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(over(r) * 0.299 + over(g) * 0.587 + over(b) * 0.114))).cast("bigint")


def scale_factor(width: Column, height: Column, most: float = ENLARGE) -> Column:
    """How much to enlarge a picture; less than 1 where it has too many pixels."""
    pixels = width.cast("double") * height
    return F.when(pixels <= 0, F.lit(most)).otherwise(F.least(F.lit(most), F.sqrt(F.lit(float(MAX_PIXELS)) / pixels)))


def scaled(length: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length * factor + 0.5)).cast("bigint")


def resample_nearest(rgba: np.ndarray, factor: float) -> np.ndarray:
    """Height x width x 4 bytes, each from the nearest pixel before it."""
    if factor == 1:
        return rgba
    at = [np.minimum(n - 1, np.floor(np.arange(max(1, int(np.floor(n * factor + 0.5)))) / factor).astype(np.int64)) for n in rgba.shape[:2]]
    return rgba[at[0][:, None], at[1][None, :]]


def flatten_alpha(rgba: np.ndarray) -> np.ndarray:
    alpha = rgba[..., 3:] / 255
    return np.rint(rgba[..., :3] * alpha + 255 * (1 - alpha))


def threshold_of(levels: np.ndarray) -> int:
    """As ``otsu_threshold``, of one picture."""
    return int(thresholds_of(np.bincount(levels.ravel(), minlength=256)[None])[0])


def thresholds_of(counts: np.ndarray) -> np.ndarray:
    """As ``threshold_of``, of pictures given as rows of 256 counts."""
    n = counts.astype(float)
    low, total = np.cumsum(n, axis=1), np.cumsum(n * np.arange(256), axis=1)
    high = low[:, -1:] - low
    inside = (low > 0) & (high > 0)
    mean = np.divide(total, low, out=np.zeros(n.shape), where=low > 0) - np.divide(total[:, -1:] - total, high, out=np.zeros(n.shape), where=high > 0)
    return np.where(low[:, -1] > 0, np.argmax(np.where(inside, low * high * mean**2, 0), axis=1), EMPTY)


def _gray(rgb: np.ndarray) -> np.ndarray:
    """Levels of pixels, summed in the same order whatever the shape."""
    return np.clip(np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114), 0, 255).astype(np.uint8)


def _histograms(levels: np.ndarray) -> np.ndarray:
    """256 counts a picture of pictures of one shape."""
    n = len(levels)
    return np.bincount((levels.reshape(n, -1) + np.arange(n)[:, None] * 256).ravel(), minlength=n * 256).reshape(n, 256)


def _alike(batch: pd.DataFrame, shape: list[str], pixels: Callable[..., int]) -> Iterator[tuple[tuple[int, ...], pd.DataFrame]]:
    """Rows of a batch whose ``shape`` columns are equal, at most 1,024 and about ``TOGETHER`` of their ``pixels`` at a time."""
    for key, rows in batch.groupby(shape, sort=False, dropna=False):
        step = min(1024, max(1, TOGETHER // max(1, pixels(*key))))
        for i in range(0, len(rows), step):
            yield key, rows.iloc[i : i + step]


def preprocess_images(images: DataFrame) -> DataFrame:
    """Black words on white of pictures (image, height, width, pixels: rows of RGBA bytes): image, height, width, pixels
    (a byte each), threshold, light_on_dark.

    Shrinks before alpha is flattened onto white and enlarges after it, takes luma, the threshold and the polarity.
    Small pictures of one size are worked on together, large ones one at a time.
    """
    kind = images.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), rows in _alike(batch, ["height", "width"], lambda h, w: min(MAX_PIXELS, 9 * h * w)):
                n = len(rows)
                rgba = np.frombuffer(b"".join(rows["pixels"]), dtype=np.uint8).reshape(n, h, w, 4)
                factor = min(ENLARGE, (MAX_PIXELS / (h * w)) ** 0.5) if h * w else ENLARGE
                # a gray pixel depends on its own color only, so that a picture can be enlarged when it is gray
                if factor < 1:
                    gray = _gray(flatten_alpha(np.stack([resample_nearest(p, factor) for p in rgba])))
                else:
                    gray = _gray(flatten_alpha(rgba))
                    if factor != 1 and h * w:
                        (_, y), (_, x) = _places(h, factor, 0, h), _places(w, factor, 0, w)
                        gray = gray[:, y[:, None], x[None, :]]
                thresholds = thresholds_of(_histograms(gray))
                dark = gray <= thresholds[:, None, None]
                light = dark.sum(axis=(1, 2)) * 2 > dark[0].size
                out = np.where(dark != light[:, None, None], 0, 255).astype(np.uint8)
                yield pd.DataFrame({"image": rows["image"].array, "height": gray.shape[1], "width": gray.shape[2], "pixels": [p.tobytes() for p in out], "threshold": thresholds, "light_on_dark": light})

    return images.select("image", "height", "width", "pixels").mapInPandas(run, f"image {kind}, height int, width int, pixels binary, threshold int, light_on_dark boolean")


def _places(length: int, factor: float, start: int, size: int) -> tuple[int, np.ndarray]:
    """Of ``length`` pixels that are resampled, where those begin that come from ``size`` pixels at ``start``, and their sources within these."""
    at = np.minimum(length - 1, np.floor(np.arange(max(1, int(np.floor(length * factor + 0.5)))) / factor).astype(np.int64)) if factor != 1 else np.arange(length)
    first, last = np.searchsorted(at, [start, start + size])
    return int(first), at[first:last] - start


def preprocess_tiles(tiles: DataFrame) -> DataFrame:
    """As ``preprocess_images``, of pictures that come as tiles (image, height, width, y, x, tile_height, tile_width, pixels), too large for a row.

    ``height`` and ``width`` are those of the picture, ``y`` and ``x`` the tile's place in it. Tiles are resampled and made gray by
    themselves, as the nearest pixel is always one of some tile's own. Their histograms are summed by picture for its threshold and polarity, which go
    back to the tiles. Gives image, y, x, height, width (of the tile, as resampled), pixels, threshold, light_on_dark; tiles that get no pixel are left out.
    """
    kind = tiles.schema["image"].dataType.simpleString()

    def gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (height, width, y, x, h, w), rows in _alike(batch, ["height", "width", "y", "x", "tile_height", "tile_width"], lambda _h, _w, _y, _x, h, w: 9 * h * w):
                factor = min(ENLARGE, (MAX_PIXELS / (height * width)) ** 0.5)
                (y, ys), (x, xs) = _places(height, factor, y, h), _places(width, factor, x, w)
                if not len(ys) or not len(xs):
                    continue
                n = len(rows)
                levels = _gray(flatten_alpha(np.frombuffer(b"".join(rows["pixels"]), dtype=np.uint8).reshape(n, h, w, 4)))[:, ys[:, None], xs[None, :]]
                counts = _histograms(levels)
                # only levels that occur, as a small tile has few
                tile, level = np.nonzero(counts)
                cuts = np.searchsorted(tile, np.arange(1, n))
                yield pd.DataFrame({"image": rows["image"].array, "y": y, "x": x, "height": levels.shape[1], "width": levels.shape[2], "pixels": [p.tobytes() for p in levels], "levels": np.split(level.astype(np.int32), cuts), "counts": np.split(counts[tile, level], cuts)})

    def ink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for p, t, light in zip(batch["pixels"], batch["threshold"].tolist(), batch["light_on_dark"].tolist(), strict=True):
                # bytes.translate, as most tiles may be small
                said.append(p.translate(_table(t, light)))
            yield batch.assign(pixels=said)

    place = f"image {kind}, y int, x int, height int, width int, pixels binary"
    grays = written(tiles.select("image", "height", "width", "y", "x", "tile_height", "tile_width", "pixels").mapInPandas(gray, f"{place}, levels array<int>, counts array<bigint>"))
    counts = grays.select("image", F.inline(F.arrays_zip(F.col("levels").alias("level"), F.col("counts").alias("n")))).groupBy("image", "level").agg(F.sum("n").alias("n"))
    found = counts.join(threshold_of_counts(counts, "image"), "image")
    found = found.groupBy("image", "threshold").agg((F.sum(F.when(F.col("level") <= F.col("threshold"), F.col("n")).otherwise(0)) * 2 > F.sum("n")).alias("light_on_dark"))
    joined = grays.drop("levels", "counts").join(found.select("image", F.col("threshold").cast("int").alias("threshold"), "light_on_dark"), "image")
    return joined.select("image", "y", "x", "height", "width", "pixels", "threshold", "light_on_dark").mapInPandas(ink, f"{place}, threshold int, light_on_dark boolean")


@lru_cache(512)
def _table(threshold: int, light_on_dark: bool) -> bytes:
    """The byte that each level becomes."""
    return bytes(0 if (level <= threshold) != light_on_dark else 255 for level in range(256))
