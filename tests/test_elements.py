"""Literal cases of page elements."""

from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import elements


def test_layout_elements_default_class_and_score(spark):
    df = spark.createDataFrame([(0, 0, [[0.1, 0.1, 0.2, 0.2], [0.3, 0.3, 0.4, 0.4]], ["Title", None], [0.4, None]), (1, 0, [], [], [])], "doc_id long, page_idx int, boxes array<array<double>>, class_names array<string>, scores array<double>")
    assert [(r.type, r.confidence, r.x0) for r in elements.layout_elements(df).orderBy("region_idx").collect()] == [("Title", 0.4, 0.1), ("", 1.0, 0.3)]
    assert elements.layout_elements(df, 0.4).count() == 1


def test_rejoined_crops(spark):
    df = spark.createDataFrame([(0, 0, "alone", 0.9, 0.0), (1, 1, "Qingroo", 0.5, 0.5), (1, 0, "readingZ", 0.7, 0.5)], "crop int, tile int, value string, confidence double, last_overlap double")
    pair = spark.createDataFrame([("readingZ", "Qingroo")], "a string, b string").select(T.join_overlapping(F.col("a"), F.col("b"), 0.5)).first()[0]
    assert {(r.crop, r.value, r.confidence) for r in elements.rejoin(df, 0.5).collect()} == {(0, "alone", 0.9), (1, pair, 0.5)}


def test_vocabulary_union(spark):
    assert spark.range(1).select(elements.vocabulary_union(F.lit("abca"), F.lit(""), F.lit("bd"))).first()[0] == "abcd"


def test_smallest_region_wins(spark):
    words = spark.createDataFrame([(0, 0, 1, 0.4, 0.4, 0.5, 0.5), (0, 0, 2, 0.8, 0.8, 0.9, 0.9), (0, 0, 3, 0.95, 0.0, 1.0, 0.05)], "doc_id long, page_idx int, p long, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(0, 0, 0, "Text", 0.0, 0.1, 0.94, 1.0), (0, 0, 1, "Table", 0.3, 0.3, 0.6, 0.6)], "doc_id long, page_idx int, region_idx int, type string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.p, r.region) for r in elements.region_at(words, regions).collect()} == {(1, "Table"), (2, "Text"), (3, None)}
