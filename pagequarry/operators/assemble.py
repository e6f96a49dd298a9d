"""Words to rows, lines and page texts. A page is the unit of every group, so groups are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]
#: Horizontal gap, as a share of the page's width, at which a line breaks.
PARAGRAPH_BREAK = 0.035


def rows_of(words: DataFrame) -> DataFrame:
    """Words with ``row``: in reading order a word joins the current row while its centre is less than half the
    median height from the row's mean centre. Ties in order are broken by ``p``.

    A page's words meet once, whole; the fold keeps only where rows start, so it is linear in the words."""
    height = F.median(F.col("y1") - F.col("y0"))
    rest = [c for c in words.columns if c not in PAGE]
    pages = words.groupBy(*PAGE).agg(height.alias("_m"), F.collect_list(F.struct(*rest)).alias("_w")).withColumn("_med", F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0)))
    keyed = F.transform("_w", lambda w: F.struct((w["x0"] + 2 * w["y1"] / F.col("_med")).alias("k"), w["p"].alias("p"), w.alias("w")))
    pages = pages.select(*PAGE, "_med", F.array_sort(keyed).alias("_a"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("starts"))

    def step(a, x):
        yc = (x["w"]["y0"] + x["w"]["y1"]) / 2
        new = (a["n"] == 0) | (F.abs(yc - F.try_divide(a["sum"], a["n"])) >= F.col("_med") / 2)
        starts = F.when(new, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"])
        return F.struct((a["i"] + 1).alias("i"), (F.when(new, 0).otherwise(a["n"]) + 1).alias("n"), (F.when(new, 0.0).otherwise(a["sum"]) + yc).alias("sum"), starts.alias("starts"))

    cut = pages.withColumn("_s", F.aggregate("_a", start, step, lambda a: a["starts"])).select(*PAGE, "_a", F.col("_s"), F.posexplode("_s").alias("row", "_from"))
    stop = F.coalesce(F.get("_s", F.col("row") + 1), F.size("_a"))
    placed = cut.select(*PAGE, "row", F.explode(F.slice("_a", F.col("_from") + 1, stop - F.col("_from"))).alias("_x"))
    return placed.select(*PAGE, "_x.w.*", "row")


def sub_lines(rows: DataFrame, break_dist: float = PARAGRAPH_BREAK) -> DataFrame:
    """Rows with ``sub``: a row breaks where the gap to the word before is ``break_dist`` or more."""
    w = Window.partitionBy(*PAGE, "row").orderBy("x0", "p")
    gap = F.col("x0") - F.lag("x1").over(w)
    return rows.withColumn("_g", F.when(gap >= break_dist, 1).otherwise(0)).withColumn("sub", F.sum("_g").over(w).cast("int")).drop("_g")


def lines_of(words: DataFrame) -> DataFrame:
    """One row for each line: text, box, number of words, mean confidence."""
    placed = sub_lines(rows_of(words.select(*PAGE, "p", "value", "x0", "y0", "x1", "y1", "confidence")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "p", "value"))), lambda v: v["value"]), " ")
    return placed.groupBy(*PAGE, "row", "sub").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_words"), F.avg("confidence").alias("confidence"))


def page_text(words: DataFrame) -> DataFrame:
    """One row for each page: its lines, one below the other."""
    return lines_of(words).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "sub", "text"))), lambda v: v["text"]), "\n").alias("text"))
