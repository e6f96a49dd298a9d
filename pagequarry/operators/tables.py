"""Tables of cells: their words, their grid and its renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators.assemble import PAGE
from pagequarry.operators.matching import contained

TABLE = [*PAGE, "table_idx"]


def filled(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with value and confidence: their words in reading order, and the words' mean or else the cell's score.

    Words lie in a row while their centre is less than half the median height below the row's mean centre.
    """
    held = contained(words, cells.select(*PAGE, "cell_idx", "x0", "y0", "x1", "y1"), "cell_idx")
    cy = (F.col("y0") + F.col("y1")) / 2
    got = held.groupBy(*PAGE, "cell_idx").agg(
        F.median(F.col("y1") - F.col("y0")).alias("_m"),
        F.array_sort(F.collect_list(F.struct(cy.alias("y"), F.col("p"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("value")))).alias("_w"),
        F.avg("confidence").alias("_c"),
    )
    height = F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0))
    start = F.struct(F.lit(0).alias("row"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<row:int,x:double,p:bigint,value:string>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        new = (a["n"] > 0) & (w["y"] - F.try_divide(a["sum"], a["n"]) >= height / 2)
        row = a["row"] + F.when(new, 1).otherwise(0)
        placed = F.struct(row.alias("row"), w["x"].alias("x"), w["p"].cast("bigint").alias("p"), w["value"].alias("value"))
        return F.struct(row.alias("row"), (F.when(new, 0).otherwise(a["n"]) + 1).alias("n"), (F.when(new, 0.0).otherwise(a["sum"]) + w["y"]).alias("sum"), F.concat(a["out"], F.array(placed)).alias("out"))

    ordered = F.array_sort(F.aggregate("_w", start, step, lambda a: a["out"]))
    texts = got.select(*PAGE, "cell_idx", F.array_join(F.transform(ordered, lambda w: w["value"]), " ").alias("value"), "_c")
    return cells.join(texts, [*PAGE, "cell_idx"], "left").withColumn("value", F.coalesce("value", F.lit(""))).withColumn("confidence", F.coalesce("_c", "score")).drop("_c")


def localized(cells: DataFrame) -> DataFrame:
    """One row for each table: its cells with rows and columns counted from 0, its size, extent and mean cell score."""
    low = cells.groupBy(*TABLE).agg(F.min("row_start").alias("_r"), F.min("col_start").alias("_c"))
    moved = cells.join(low, TABLE)
    for name in ("row_start", "row_end"):
        moved = moved.withColumn(name, F.col(name) - F.col("_r"))
    for name in ("col_start", "col_end"):
        moved = moved.withColumn(name, F.col(name) - F.col("_c"))
    cell = F.struct("cell_idx", "row_start", "row_end", "col_start", "col_end", "value", "confidence")
    return moved.groupBy(*TABLE).agg(
        (F.max("row_end") + 1).alias("num_rows"),
        (F.max("col_end") + 1).alias("num_cols"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.avg("score").alias("confidence"),
        F.array_sort(F.collect_list(cell)).alias("cells"),
    )


def grid(cells: Column, num_rows: Column, num_cols: Column) -> Column:
    """Rows of texts: a cell's stands at its top left, the last of several wins, cells beyond the size are passed over."""

    def at(r: Column, c: Column) -> Column:
        here = F.filter(cells, lambda x: (x["row_start"] == r) & (x["col_start"] == c))
        return F.coalesce(F.get(F.transform(here, lambda x: x["value"]), F.size(here) - 1), F.lit(""))

    rows, cols = F.sequence(F.lit(0), num_rows - 1), F.sequence(F.lit(0), num_cols - 1)
    return F.transform(rows, lambda r: F.transform(cols, lambda c: at(r, c)))


def plain(rows: Column, row_break: str = "\n", col_break: str = "\t") -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, col_break)), row_break)


def _one_line(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def markdown(rows: Column) -> Column:
    """A table whose first row is its header."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda v: _one_line(F.regexp_replace(v, T.MARKDOWN_SPECIAL, r"\\$1"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    made = F.transform(rows, row)
    return F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, F.lit(2), F.size(made))), "\n")


def asciidoc(rows: Column) -> Column:
    made = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda v: F.concat(F.lit("|"), _one_line(T.escape_asciidoc(v)))), " "))
    return F.array_join(F.concat(F.array(F.lit("|===")), F.slice(made, 1, 1), F.array(F.lit("")), F.slice(made, F.lit(2), F.size(made)), F.array(F.lit("|==="))), "\n")


def html(rows: Column) -> Column:
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda v: F.concat(F.lit(f"<{tag}>"), F.trim(T.escape_html(v)), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    made = F.transform(rows, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td")))
    return F.concat(F.lit("<table>\n"), F.array_join(made, "\n"), F.lit("\n</table>"))
