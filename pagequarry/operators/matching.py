"""Spatial joins within pages and the metrics that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.geometry import iou
from pagequarry.operators.assemble import PAGE

BOX = ["x0", "y0", "x1", "y1"]
#: Pages are cut into bands of this height, so that overlap joins have a second equality key.
BANDS = 20


def _banded(df: DataFrame) -> DataFrame:
    return df.withColumn("_band", F.explode(F.sequence(F.floor(F.col("y0") * BANDS), F.floor(F.col("y1") * BANDS))))


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Overlapping pairs of one page with their IoU.

    Pairs meet by page and band, in the band of the lower of the two tops, so each pair comes once.
    """
    a = _banded(left.select(*PAGE, F.col(left_id).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in BOX]).withColumnsRenamed({"a_y0": "y0", "a_y1": "y1"})).withColumnsRenamed({"y0": "a_y0", "y1": "a_y1"})
    b = _banded(right.select(*PAGE, F.col(right_id).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in BOX]).withColumnsRenamed({"b_y0": "y0", "b_y1": "y1"})).withColumnsRenamed({"y0": "b_y0", "y1": "b_y1"})
    meet = a.join(b, [*PAGE, "_band"]).where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    once = meet.where(F.col("_band") == F.floor(F.greatest("a_y0", "b_y0") * BANDS))
    return once.select(*PAGE, "a_id", "b_id", *[f"{s}_{c}" for s in "ab" for c in BOX], iou("a_", "b_").alias("iou"))


def ratio(top: Column, under: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(top, under), 6)


def contained(points: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    """Words with the box that holds their centre."""
    b = boxes.select(*PAGE, box_id, *[F.col(c).alias(f"_b{c}") for c in BOX])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return points.join(b, PAGE).where((cx >= F.col("_bx0")) & (cx <= F.col("_bx1")) & (cy >= F.col("_by0")) & (cy <= F.col("_by1"))).drop(*[f"_b{c}" for c in BOX])


def coverage_labels(lines: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines with the type of the region that covers most of them, if that is ``least`` or more of the line."""
    r = regions.select(*PAGE, "region_idx", "type", *[F.col(c).alias(f"_r{c}") for c in BOX])
    w = F.greatest(F.lit(0.0), F.least("x1", "_rx1") - F.greatest("x0", "_rx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "_ry1") - F.greatest("y0", "_ry0"))
    share = w * h / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    best = lines.join(r, PAGE).withColumn("_s", share).where(F.col("_s") >= least).groupBy(*PAGE, "row", "sub").agg(F.max_by("type", F.struct("_s", -F.col("region_idx"))).alias("label"))
    return lines.join(best, [*PAGE, "row", "sub"], "left")
