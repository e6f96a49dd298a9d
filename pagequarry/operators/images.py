"""Images as rows (image, height, width, channels, data) and operators that take their pixels in Arrow batches.

``data`` holds bytes row by row, channels in the order red, green, blue. Images meet their boxes by key, so an image is
a row and no page is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import pixels

SCHEMA = "image string, height int, width int, channels int, data binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; a file that is none keeps its name, and nulls."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    rows = raw.select(F.col("origin").alias("image"), F.when(F.col("height") > 0, F.col("height")).alias("height"), F.when(F.col("width") > 0, F.col("width")).alias("width"), F.when(F.col("nChannels") > 0, F.col("nChannels")).alias("channels"), F.when(F.col("height") > 0, F.col("data")).alias("data"))
    # the reader stores blue first
    return map_images(rows, lambda image, _: image[..., [2, 1, 0] + list(range(3, image.shape[2]))] if image.shape[2] >= 3 else image)


def pixels_of(row) -> np.ndarray | None:
    if row.data is None or pd.isna(row.height):
        return None
    return np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels))


def _flat(name: str, image: np.ndarray | None) -> tuple:
    if image is None:
        return name, None, None, None, None
    image = image[..., None] if image.ndim == 2 else image
    return name, *image.shape, np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for n in ("height", "width", "channels"):
        frame[n] = frame[n].astype("Int32")
    return frame


def map_images(images: DataFrame, fn: Callable[[np.ndarray, str], np.ndarray]) -> DataFrame:
    """Each image under ``fn(pixels, name)``; images without pixels stay so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = pixels_of(r)
                rows.append(_flat(r.image, None if image is None else fn(image, r.image)))
            yield _frame(rows, ["image", "height", "width", "channels", "data"])

    return images.select("image", "height", "width", "channels", "data").mapInPandas(run, SCHEMA)


def _with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    box = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.array("x0", "y0", "x1", "y1").alias("b")))), lambda v: v)
    return images.join(boxes.groupBy("image").agg(box.alias("boxes")), "image", "left").select("image", "height", "width", "channels", "data", "boxes")


def crop_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row for each box (image, idx, relative x0, y0, x1, y1) that meets an image, with the pixels there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = pixels_of(r)
                if image is None or r.boxes is None:
                    continue
                parts = pixels.crops(image, np.array([b["b"] for b in r.boxes], np.float64))
                yield _frame([(r.image, int(b["idx"]), *_flat("", p)[1:]) for b, p in zip(r.boxes, parts)], ["image", "idx", "height", "width", "channels", "data"])

    return _with_boxes(images, boxes).mapInPandas(run, "image string, idx long, height int, width int, channels int, data binary")


def mask_images(images: DataFrame, boxes: DataFrame, fill: int = 255) -> DataFrame:
    """Images with their boxes filled; images without boxes stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = pixels_of(r)
                if image is not None and r.boxes is not None:
                    image = pixels.mask(image, np.array([b["b"] for b in r.boxes], np.float64), fill)
                rows.append(_flat(r.image, image))
            yield _frame(rows, ["image", "height", "width", "channels", "data"])

    return _with_boxes(images, boxes).mapInPandas(run, SCHEMA)


def fit_images(images: DataFrame, height: int, width: int, symmetric: bool = True) -> DataFrame:
    """Images brought to one size, their proportions kept."""
    return map_images(images, lambda image, _: pixels.fit(image, height, width, symmetric)[0])


def map_boxes(maps: DataFrame, threshold: float = 0.3, least_score: float = 0.1, unclip: float = 1.5) -> DataFrame:
    """Boxes of probability maps (image, height, width, prob array): (image, idx, x0, y0, x1, y1, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                prob = np.asarray(r.prob, np.float64).reshape(int(r.height), int(r.width))
                found += [(r.image, k, *box) for k, box in enumerate(pixels.map_boxes(prob, threshold, least_score, unclip))]
            yield pd.DataFrame(found, columns=["image", "idx", "x0", "y0", "x1", "y1", "score"]).astype({"idx": "int64"})

    return maps.where("prob is not null").select("image", "height", "width", "prob").mapInPandas(run, "image string, idx long, x0 double, y0 double, x1 double, y1 double, score double")


def cell_morphology(size: int = 3, height: int = 40, width: int = 20):
    """A column function: places set on a grid give struct(n, n_dilated, n_eroded)."""

    @F.pandas_udf("n int, n_dilated int, n_eroded int")
    def run(places: pd.Series) -> pd.DataFrame:
        rows = []
        for p in places:
            grid = np.zeros(height * width, np.int64)
            grid[np.asarray(p, int)] = 1
            grid = grid.reshape(height, width)
            rows.append((int(grid.sum()), int(pixels.dilate(grid, size).sum()), int(pixels.erode(grid, size).sum())))
        return pd.DataFrame(rows, columns=["n", "n_dilated", "n_eroded"])

    return run
