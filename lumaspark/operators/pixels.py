"""Model input planes from decoded images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Channel means and deviations (red, green, blue) of the training images.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"),
                      F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def normalize_pixels(images: DataFrame, key: str = "origin") -> DataFrame:
    """(key, height, width, planes): red, green and blue planes in a row, each scaled by its
    mean and deviation. Input pixels are interleaved blue, green, red and perhaps alpha,
    as Spark's image source gives them; alpha is dropped."""
    kind = dict(images.dtypes)[key]
    scale = np.array([1.0 / (255.0 * d) for d in DEVIATION])
    shift = np.array([m / d for m, d in zip(MEAN, DEVIATION)])

    def run(batches):
        for pdf in batches:
            planes = []
            for data, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"]):
                px = np.frombuffer(data, dtype=np.uint8).reshape(h * w, c)
                rgb = px[:, [2, 1, 0]] if c >= 3 else np.repeat(px[:, :1], 3, axis=1)
                planes.append((rgb * scale - shift).T.astype(np.float32).ravel())
            yield pd.DataFrame({key: pdf[key], "height": pdf["height"], "width": pdf["width"], "planes": planes})

    cols = images.select(key, "height", "width", "channels", "data")
    return cols.mapInPandas(run, f"{key} {kind}, height int, width int, planes array<float>")
