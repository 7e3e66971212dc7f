"""Pictures as RGBA bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def _rgba(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw: bytes, n: int) -> bytes:
        stored = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        out = np.full((len(stored), 4), 255, dtype=np.uint8)
        out[:, :3] = stored if n == 1 else stored[:, 2::-1]
        if n == 4:
            out[:, 3] = stored[:, 3]
        return out.tobytes()

    return pd.Series([one(r, n) for r, n in zip(data, channels, strict=True)])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, height, width, pixels) of the pictures under a path, decoded: image is their address. What is no picture is left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return found.select(F.col("origin").alias("image"), "height", "width", _rgba("data", "nChannels").alias("pixels"))
