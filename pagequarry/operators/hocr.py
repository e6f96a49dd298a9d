"""Pages as hOCR documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import geometry as G
from pagequarry.functions import text as T
from pagequarry.operators.assemble import PAGE

CAPABILITIES = "ocr_page ocr_carea ocr_par ocr_line ocrx_word"
_LINE = "; baseline 0 0; x_size 0; x_descenders 0; x_ascenders 0"
_BOUNDS = ("x0", "y0", "x1", "y1")


def _attribute(c: Column) -> Column:
    return F.replace(T.escape_html(c), F.lit('"'), F.lit("&quot;"))


def element(tag: str, kind: str, name: Column, title: Column, content: Column, filled: bool = False) -> Column:
    """An element with its class, id and title; ``content`` is XML. Empty elements close themselves; content that is
    known to be there (``filled``) is not looked at, as it would be made again at each level of nesting."""
    opened = F.concat(F.lit(f'<{tag} class="{kind}" id="'), _attribute(name), F.lit('" title="'), title, F.lit('"'))
    if filled:
        return F.concat(opened, F.lit(">"), content, F.lit(f"</{tag}>"))
    return F.concat(opened, F.when(content == "", F.lit(" />")).otherwise(F.concat(F.lit(">"), content, F.lit(f"</{tag}>"))))


def document(body: Column, page_idx: Column, height: int, width: int, language: Column, title: str, system: str, inside: bool = True) -> Column:
    """The whole file of a page; ``body`` goes into the page's element, or after it if not ``inside``."""
    lang = F.coalesce(F.nullif(language, F.lit("")), F.lit("en"))
    head = F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?>\n<html xmlns=\"http://www.w3.org/1999/xhtml\" xml:lang=\""), _attribute(lang), F.lit('"><head>'), F.lit("<title>"), T.escape_html(F.lit(title)), F.lit('</title><meta http-equiv="Content-Type" content="text/html; charset=utf-8" />'), F.lit('<meta name="ocr-system" content="'), _attribute(F.lit(system)), F.lit(f'" /><meta name="ocr-capabilities" content="{CAPABILITIES}" /></head><body>'))
    page = element("div", "ocr_page", F.concat(F.lit("page_"), (page_idx + 1).cast("string")), F.lit(f"image; bbox 0 0 {width} {height}; ppageno 0"), body if inside else F.lit(""))
    return F.concat(head, page, F.lit("") if inside else body, F.lit("</body></html>"))


def _sure(confidence: Column) -> Column:
    return F.concat(F.lit("; x_wconf "), F.rint(confidence * 100).cast("int").cast("string"))


def _in_order(key: list[str], c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, c.alias("_x")))), lambda v: v["_x"]), "")


def table_parts(cells: DataFrame, height: int, width: int) -> DataFrame:
    """One text area a table of (page, segment, row_start, col_start, value, confidence, box), a line for each row.

    Tables of a page are numbered by ``segment``; a table without a box of its own is bounded by its cells.
    """
    bbox = lambda: G.pixel_box([F.col(n) for n in _BOUNDS], F.lit(height), F.lit(width))
    bounds = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    numbered = cells.withColumn("_t", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("segment")))
    numbered = numbered.withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE, "_t", "row_start").orderBy("col_start", "x0", "value")))
    cell = element("span", "ocrx_word", F.concat(F.lit("table_"), s("_t"), F.lit("_cell_"), s(F.col("row_start") + 1), F.lit("_"), s("_k")), F.concat(bbox(), _sure(F.col("confidence"))), T.escape_html(F.col("value")))
    rows = numbered.withColumn("_c", cell).groupBy(*PAGE, "segment", "_t", "row_start").agg(_in_order(["_k"], F.col("_c")).alias("_c"), *bounds)
    line = element("span", "ocr_line", F.concat(F.lit("table_"), s("_t"), F.lit("_row_"), s(F.col("row_start") + 1)), F.concat(bbox(), F.lit(_LINE)), F.col("_c"), filled=True)
    whole = rows.withColumn("_c", line).groupBy(*PAGE, "segment", "_t").agg(_in_order(["row_start"], F.col("_c")).alias("_c"), *bounds)
    par = element("p", "ocr_par", F.concat(F.lit("table_par_"), s("_t")), bbox(), F.col("_c"), filled=True)
    return whole.select(*PAGE, "segment", element("div", "ocr_carea", F.concat(F.lit("table_"), s("_t")), bbox(), par, filled=True).alias("part"))


def page_hocr(words: DataFrame, height: int, width: int, language: Column | None = None, title: str = "hOCR", system: str = "pagequarry", tables: DataFrame | None = None) -> DataFrame:
    """One row for each page with its ``export``: text areas, paragraphs, lines and words with running numbers.

    ``words`` have segment (place of their block on the page), ord (of the line in it), place (in the line), value,
    confidence and a box; ``tables`` are cells as ``table_parts`` takes them, placed by their segment. All
    groups are keyed by the page, so pages are shuffled once. Null values are empty texts.
    """
    bbox = lambda: G.pixel_box([F.col(n) for n in _BOUNDS], F.lit(height), F.lit(width))
    bounds = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    number = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("segment", "ord", "place")
    rows = words.select(*PAGE, "segment", "ord", "place", F.coalesce("value", F.lit("")).alias("value"), "confidence", *_BOUNDS)
    rows = rows.withColumns({"_w": F.row_number().over(order), "_l": F.dense_rank().over(page.orderBy("segment", "ord")), "_b": F.dense_rank().over(page.orderBy("segment"))})
    word = element("span", "ocrx_word", number("word_", "_w"), F.concat(bbox(), _sure(F.col("confidence"))), T.escape_html(F.col("value")))
    lines = rows.withColumn("_c", word).groupBy(*PAGE, "segment", "_b", "_l").agg(_in_order(["_w"], F.col("_c")).alias("_c"), *bounds)
    line = element("span", "ocr_line", number("line_", "_l"), F.concat(bbox(), F.lit(_LINE)), F.col("_c"), filled=True)
    blocks = lines.withColumn("_c", line).groupBy(*PAGE, "segment", "_b").agg(_in_order(["_l"], F.col("_c")).alias("_c"), *bounds)
    par = element("p", "ocr_par", number("par_", "_b"), bbox(), F.col("_c"), filled=True)
    parts = blocks.select(*PAGE, "segment", element("div", "ocr_carea", number("block_", "_b"), bbox(), par, filled=True).alias("part"))
    if tables is not None:
        parts = parts.unionByName(table_parts(tables, height, width))
    pages = parts.groupBy(*PAGE).agg(_in_order(["segment"], F.col("part")).alias("_c"))
    spoken = language if language is not None else F.lit(None).cast("string")
    return pages.select(*PAGE, document(F.col("_c"), F.col("page_idx"), height, width, spoken, title, system).alias("export"))


def class_hocr(predictions: DataFrame, height: int, width: int, title: str = "hOCR", system: str = "pagequarry") -> DataFrame:
    """One row for each page of predictions (class, ord, value, confidence, box): one area each, numbered over the
    page by class and ``ord``, after the page's element."""
    bbox = G.pixel_box([F.col(n) for n in _BOUNDS], F.lit(height), F.lit(width))
    rows = predictions.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("class", "ord")))
    name = lambda kind: F.concat(F.col("class"), F.lit(f"_{kind}_"), F.col("_n").cast("string"))
    word = element("span", "ocrx_word", name("word"), F.concat(bbox, _sure(F.col("confidence"))), T.escape_html(F.coalesce("value", F.lit(""))))
    line = element("span", "ocr_line", name("line"), F.concat(bbox, F.lit(_LINE)), word, filled=True)
    area = element("div", "ocr_carea", name("prediction"), bbox, element("p", "ocr_par", name("par"), bbox, line, filled=True), filled=True)
    pages = rows.withColumn("_c", area).groupBy(*PAGE).agg(_in_order(["_n"], F.col("_c")).alias("_c"))
    return pages.select(*PAGE, document(F.col("_c"), F.col("page_idx"), height, width, F.lit(None).cast("string"), title, system, inside=False).alias("export"))
