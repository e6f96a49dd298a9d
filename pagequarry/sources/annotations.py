"""Readers of common annotation formats as flat tables, one row for each word or box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGON = "array<array<double>>"


def detection_labels(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of image name to {img_dimensions, img_hash, polygons} gives (image, box_idx, poly)."""
    entry = f"map<string, struct<img_dimensions:array<int>, img_hash:string, polygons:array<{_POLYGON}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("image", "v"))
    return raw.select("image", F.posexplode("v.polygons").alias("box_idx", "poly"))


def recognition_labels(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of image name to text gives (image, text)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("image", "text"))


def corner_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of eight corner coordinates and a text that may hold commas: (image, box_idx, poly, text)."""
    parts = F.split("value", ",", 9)
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("image"), F.array(*[F.array(number(k), number(k + 1)) for k in (1, 3, 5, 7)]).alias("poly"), F.try_element_at(parts, F.lit(9)).alias("text"))
    return rows.where("text is not null")


def form_json(spark: SparkSession, path: str) -> DataFrame:
    """Forms with words of their own boxes: (form_id, label, box, text); empty words go."""
    schema = "form array<struct<id:int,label:string,words:array<struct<box:array<int>,text:string>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("form").alias("f")).select("f.id", "f.label", F.explode("f.words").alias("w")).select(F.col("id").alias("form_id"), "label", "w.box", "w.text").where("text <> ''")


def receipt_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of one image each: (file_name, box, text, label)."""
    schema = "file_name string, height int, width int, annotations array<struct<box:array<double>,text:string,label:int>>"
    return spark.read.schema(schema).json(path).select("file_name", F.explode("annotations").alias("a")).select("file_name", "a.box", "a.text", "a.label")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, height, width, channels and BGR bytes."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
